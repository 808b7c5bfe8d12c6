"""Poses on a clock of their own: each row takes the pose of its moment, between recorded ones by spherical interpolation.

Rows and recorded poses are merged by ranges of time. A range takes on the last pose of those before it and the first of those after it, one row a range; so neither
a moment with most of the rows nor a long silence of the tracker makes a task of its own, and nothing is joined by an inequality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark import storage
from gridlark.functions.pose import NORM_LEAST

AXES = "xyzw"
#: Cosine of half the angle from which on a chord stands in for the arc (the sine in the arc's denominator vanishes there).
NEARLY_ONE = 0.9995
POSE = "struct<x: float, y: float, z: float, w: float>"
MOMENT = f"struct<at: bigint, pose: {POSE}>"


def _dot(a: Column, b: Column) -> Column:
    x, y, z, w = (a[c] * b[c] for c in AXES)
    return x + y + z + w


def slerp(a: Column, b: Column, share: Column) -> Column:
    """The unit quaternion ``share`` of the shorter way from a to b, in double precision; both must have a length. The result is FLOAT."""

    def let(value: Column, body) -> Column:  # a value by name: an expression used twice would be computed twice
        return F.transform(F.array(value), body)[0]

    def scaled(q: Column, by: Column) -> Column:
        return F.struct(*[(q[c] / by).alias(c) for c in AXES])

    def doubled(q: Column) -> Column:
        return F.struct(*[q[c].cast("double").alias(c) for c in AXES])

    def unit(q: Column) -> Column:
        return let(q, lambda v: let(F.sqrt(_dot(v, v)), lambda n: scaled(v, n)))

    def arc(v: Column) -> Column:
        near = F.abs(v["cos"])
        angle = F.acos(F.least(near, F.lit(1.0)))
        straight = near > NEARLY_ONE
        keep = F.when(straight, 1 - v["share"]).otherwise(F.sin((1 - v["share"]) * angle))
        take = F.when(straight, v["share"]).otherwise(F.sin(v["share"] * angle)) * F.when(v["cos"] < 0, -1.0).otherwise(1.0)
        both = F.struct(keep.alias("k"), take.alias("t"))
        return let(both, lambda s: unit(F.struct(*[(v["a"][c] * s["k"] + v["b"][c] * s["t"]).alias(c) for c in AXES])))

    ends = let(F.struct(unit(doubled(a)).alias("a"), unit(doubled(b)).alias("b"), share.alias("share")), lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"), v["share"].alias("share"), _dot(v["a"], v["b"]).alias("cos")))
    return let(ends, arc).cast(POSE)


def _has_length(q: Column) -> Column:
    return F.sqrt(sum((q[c].cast("double") * q[c].cast("double") for c in AXES), F.lit(0.0))) > NORM_LEAST


def between(moment: Column, before: Column, after: Column, bridge_ns: int | None = None) -> Column:
    """The pose at a moment from those recorded last before or at it and first after it (each at, pose; null where there is none)."""
    # nanoseconds since the epoch lose their last digits as doubles and may overflow as differences
    at, first, last = (c.cast("decimal(20,0)") for c in (moment, before["at"], after["at"]))
    whole, passed = (last - first).cast("double"), (at - first).cast("double")
    nearer = F.when(passed <= whole - passed, before["pose"]).otherwise(after["pose"])
    apart = ~_has_length(before["pose"]) | ~_has_length(after["pose"])
    if bridge_ns is not None:
        apart = apart | (whole > bridge_ns)
    way = F.when(apart, nearer).otherwise(slerp(before["pose"], after["pose"], passed / whole))
    found = F.when(before.isNull(), after["pose"]).when(after.isNull() | (passed == 0), before["pose"]).otherwise(way)
    return F.when(moment.isNotNull(), found)


def poses_at(rows: DataFrame, track: DataFrame, ts: str = "timestamp_ns", apart: str = "frame_id", to: str = "pose", bridge_ns: int | None = None) -> DataFrame:
    """rows with ``to``, the pose of their moment ``ts`` (nanoseconds); a column of that name is replaced, all others stay as they are.

    track: timestamp_ns and pose. Before the first and after the last recorded pose that one holds, at a recorded moment the pose as it was recorded; between two of them the
    result is a unit quaternion on the shorter arc. Neighbours more than ``bridge_ns`` apart (tracking was lost), or one of them without a length, aren't bridged: the nearer one
    holds, the earlier of two as near. Of several poses of one moment the greatest counts, by x, y, z, w. Poses without a time, null, or with null or non-finite components don't
    count. Rows without a time, and all rows if no pose counts, get null. ``apart`` is any column that tells rows of one moment apart, so that they can be dealt.

    One range shuffle of rows and poses, written; poses of one moment are reduced before it by a partial aggregate.
    """
    q = F.col("pose")
    # a NaN or infinity times zero is NaN, and so would be the sum
    sound = ~F.isnan(sum((q[c].cast("double") * 0.0 for c in AXES), F.lit(0.0)))
    known = track.where(F.col("timestamp_ns").isNotNull() & sound).select(F.col("timestamp_ns").cast("long").alias("_at"), q.cast(POSE).alias("_pose"))
    known = known.groupBy("_at").agg(F.max("_pose").alias("_pose"))
    names = [c for c in rows.columns if c != to]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    kept = rows.select(F.col(f"`{ts}`").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.xxhash64(F.col(f"`{apart}`")).alias("_apart"), F.lit(None).cast(MOMENT).alias("_seen"), row.alias("_row"))
    marks = known.select("_at", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_apart"), F.struct(F.col("_at").alias("at"), F.col("_pose").alias("pose")).alias("_seen"), F.lit(None).alias("_row"))
    both = storage.ranged(kept.unionByName(marks), "_at", "_kind", "_apart")
    part = storage.PART
    # an order from each end: a frame that is open to its far side would be computed anew for each row
    ahead = Window.partitionBy(part).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(part).orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_before", F.last("_seen", ignorenulls=True).over(ahead)).withColumn("_after", F.last("_seen", ignorenulls=True).over(back)).where("_kind = 1")
    ends = both.groupBy(part).agg(F.max("_seen").alias("last"), F.min("_seen").alias("first"))  # structs are ordered by their time, and nulls don't count
    up, down = Window.orderBy(part), Window.orderBy(F.desc(part))
    others = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (up, down))
    carried = ends.select(part, *[F.last(c, ignorenulls=True).over(w).alias(n) for c, w, n in zip(("last", "first"), others, ("_earlier", "_later"), strict=True)])
    met = inside.join(F.broadcast(carried), part)  # one row a range
    pose = between(F.col("_at"), F.coalesce("_before", "_earlier"), F.coalesce("_after", "_later"), bridge_ns)
    return met.select(*[F.col("_row")[c].alias(c) for c in names], pose.alias(to))
