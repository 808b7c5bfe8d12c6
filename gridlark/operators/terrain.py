"""Grid stages: height map, terrain, slope, roughness, step height, danger, ray cast, drivability code.

A frame's terrain travels as one row with a dense array of its cells, from which each cell's window is cut out (``windows``). So cells are neither
multiplied nor shuffled for the three metrics, and the work is linear in them. A neighbour outside the grid is the mirrored cell, once per offset that leads to
it; for a gradient that makes the missing neighbour the cell itself, which is what a one-sided difference needs.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark import storage
from gridlark.functions.floats import f32
from gridlark.grid import F32, ROUGH_HALF, STEP_HALF, STEP_NEIGHBOURS, Grid

#: Height of cells without points; weights of slope, roughness and step height.
EMPTY_HEIGHT = -0.3
WEIGHTS = (0.3, 0.3, 0.4)
INF = float("inf")


def over(c: Column, limit: np.float32) -> Column:
    """The value, or infinity where it exceeds its limit."""
    return F.when(c > float(limit), F.lit(INF)).otherwise(c)


def polar_bin(polar: DataFrame, g: Grid) -> DataFrame:
    """Adds the bins i and j, which may lie outside the grid."""

    def bin_(name: str, start: np.float32, step: np.float32) -> Column:
        return F.floor((F.col(name) - f32(start)) * f32(F32(1) / step)).cast("long")

    return polar.select("*", bin_("r", g.r_min, g.dr).alias("i"), bin_("theta", g.theta_min, g.dtheta).alias("j"))


def height_map(polar: DataFrame, g: Grid) -> DataFrame:
    """Highest point of each cell that has any."""
    inside = F.col("i").between(0, g.nr - 1) & F.col("j").between(0, g.nt - 1)
    return polar_bin(polar, g).where(inside).groupBy("frame_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).agg(F.max("z").alias("z_max"))


def dense(heights: DataFrame, frames: DataFrame, g: Grid) -> DataFrame:
    """One row a frame: frame_id and z, the heights of all cells, row by row; null without points. What lies between two known cells is filled up with nulls, in one pass."""
    cell = F.struct((F.col("i") * g.nt + F.col("j")).alias("k"), "z_max")
    known = heights.groupBy("frame_id").agg(F.sort_array(F.collect_list(cell)).alias("e"))

    def nulls(n: Column) -> Column:
        return F.array_repeat(F.lit(None).cast("float"), n)

    def filled(e: Column, at: Column) -> Column:
        before = F.when(at > 0, F.get("e", at - 1)["k"]).otherwise(-1)
        return F.concat(nulls(e["k"] - before - 1), F.array(e["z_max"]))

    last = F.coalesce(F.element_at("e", -1)["k"], F.lit(-1))
    z = F.flatten(F.concat(F.transform("e", filled), F.array(nulls(g.nr * g.nt - 1 - last))))
    # A frame is one small row here and many cells later on, so adaptive execution mustn't put the frames together by their size now: their number of partitions is stated.
    n = storage.partitions(frames.sparkSession, 0, 1)
    rows = frames.select("frame_id").repartition(n, "frame_id").join(known, "frame_id", "left")
    return rows.select("frame_id", F.when(F.col("e").isNull(), nulls(F.lit(g.nr * g.nt))).otherwise(z).alias("z"))


def terrain(heights: DataFrame, frames: DataFrame, g: Grid) -> DataFrame:
    """Every cell of every frame: its height or that of empty ground, and whether it was seen."""
    cells = dense(heights, frames, g).select("frame_id", F.posexplode("z").alias("k", "z_max"))
    i, j = F.expr(f"int(k div {g.nt})").alias("i"), (F.col("k") % g.nt).alias("j")
    return cells.select("frame_id", i, j, "z_max", F.coalesce("z_max", f32(EMPTY_HEIGHT)).alias("terrain"), F.col("z_max").isNotNull().alias("valid"))


def gradient(t: DataFrame, g: Grid) -> DataFrame:
    """Height differences along both axes by window functions; one-sided at the ends, none on an axis of one cell."""

    def along(axis: str, other: str, step: np.float32) -> Column:
        w = Window.partitionBy("frame_id", other).orderBy(axis)
        before, after = F.lag("terrain").over(w), F.lead("terrain").over(w)
        rise = (F.coalesce(after, "terrain") - F.coalesce(before, "terrain")).cast("double")
        run = F.when(before.isNull() | after.isNull(), float(step)).otherwise(float(F32(2) * step))
        return rise / run

    return t.select("frame_id", "i", "j", along("i", "j", g.dr).alias("dz_dr"), along("j", "i", g.dtheta).alias("dz_dtheta"))


def metrics(t: DataFrame, g: Grid) -> DataFrame:
    """t, of all cells of each frame, with slope, roughness and step_height; a metric over its limit is infinite."""
    cells = t.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("i", "j", "terrain", "valid"))).alias("c"))
    return metrics_of(cells.select("frame_id", F.transform("c", lambda c: F.when(c["valid"], c["terrain"])).alias("z")), g)


def mirrored_index(at: Column, size: int) -> Column:
    """``grid.reflected`` as an expression."""
    if size == 1:
        return F.lit(0)
    return F.when(at < 0, -at - 1).when(at >= size, 2 * size - 1 - at).otherwise(at)


def windows(rows: DataFrame, g: Grid) -> DataFrame:
    """One row a frame and cell: frame_id, i, j, z (null without points) and v, the terrain in the step window around it, row by row.

    A frame's array becomes its grid's rows, framed by their mirrored edges; as many neighbouring rows as the window is high are a band, one for each grid row, and a
    band is cut into windows. A row carries a band at most, and arrays are only read by index (``slice`` would copy them whole), so the work is linear in the cells.
    """
    span, reach = 2 * STEP_HALF + 1, F.lit(STEP_HALF)

    def framed(i: Column) -> Column:
        first = mirrored_index(i, g.nr) * g.nt
        return F.transform(F.sequence(-reach, g.nt - 1 + reach), lambda j: F.coalesce(F.get("z", first + mirrored_index(j, g.nt)), f32(EMPTY_HEIGHT)))

    def band(i: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.lit(g.nt - 1)), lambda j: F.get("z", i * g.nt + j))
        return F.struct(i.alias("i"), own.alias("own"), *[F.get("framed", i + k).alias(f"row{k}") for k in range(span)])

    def window(j: Column) -> Column:
        return F.struct(j.alias("j"), F.get("own", j).alias("z"), F.array(*[F.get(f"row{k}", j + l) for k in range(span) for l in range(span)]).alias("v"))

    # Out of generators, arrays are plain columns to the optimizer, which could otherwise put their making into the loops that read them.
    whole = F.struct("z", F.transform(F.sequence(-reach, g.nr - 1 + reach), framed).alias("framed"))
    rows = rows.select("frame_id", F.inline(F.array(whole)))
    rows = rows.select("frame_id", F.inline(F.transform(F.sequence(F.lit(0), F.lit(g.nr - 1)), band)))
    return rows.select("frame_id", "i", F.inline(F.transform(F.sequence(F.lit(0), F.lit(g.nt - 1)), window)))


def metrics_of(rows: DataFrame, g: Grid) -> DataFrame:
    """frame_id, i, j, terrain, valid, slope, roughness, step_height from dense rows."""
    width = 2 * STEP_HALF + 1
    spark = rows.sparkSession

    def offset(di: int, dj: int) -> int:
        return (di + STEP_HALF) * width + dj + STEP_HALF

    def at(di: int, dj: int) -> Column:
        return F.get("v", F.lit(offset(di, dj)))

    # One row for each row and column of the grid is broadcast.
    cells = windows(rows, g).join(F.broadcast(g.ranges(spark)), "i").join(F.broadcast(g.bearings(spark)), "j")
    middle = F.lit(offset(0, 0))
    own = {"x": F.get("r", middle) * F.get("c", middle), "y": F.get("r", middle) * F.get("s", middle)}
    cells = cells.select("*", at(0, 0).alias("terrain"), F.col("z").isNotNull().alias("valid"), *[c.alias(n) for n, c in own.items()])

    def rise(step: np.float32, after: Column, before: Column, inner: Column) -> Column:
        return (after - before).cast("double") / F.when(inner, float(F32(2) * step)).otherwise(float(step))

    reach = range(-ROUGH_HALF, ROUGH_HALF + 1)
    close = [at(di, dj).cast("double") for di in reach for dj in reach]

    def climb(z: Column, k: Column) -> Column:
        """The height difference to a neighbour, if it is too high and too steep. Heights come first: where they say no, nothing else is computed."""
        dz = F.abs(F.col("terrain") - z)
        dx, dy = (F.col(own) - F.get("r", k) * F.get(axis, k) for own, axis in (("x", "c"), ("y", "s")))
        d = F.sqrt(dx * dx + dy * dy)
        return F.when((dz > f32(g.step_limit)) & (d > 0) & (F.atan2(dz.cast("double"), d) > float(g.slope_limit)), dz)

    dzdr = rise(g.dr, at(1, 0), at(-1, 0), F.col("i").between(1, g.nr - 2))
    dzdt = rise(g.dtheta, at(0, 1), at(0, -1), F.col("j").between(1, g.nt - 2))
    m = cells.select(
        "frame_id", "i", "j", "terrain", "valid", dzdr.alias("dzdr"), (dzdt / F.col("r_c").cast("double")).alias("arc"),
        reduce(add, close).alias("total"), reduce(add, [v * v for v in close]).alias("squares"), F.array_compact(F.transform("v", climb)).alias("climbs"),
    )
    h = F.coalesce(F.array_max("climbs"), F.lit(0.0).cast("float")).cast("double")
    n = len(close)
    rough = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / n - F.pow(F.col("total") / n, 2)))
    step = F.least(h, h * F.size("climbs") / STEP_NEIGHBOURS)
    return m.select(
        "frame_id", "i", "j", "terrain", "valid",
        over(F.atan(F.sqrt(F.col("dzdr") * F.col("dzdr") + F.col("arc") * F.col("arc"))), g.slope_limit).alias("slope"), over(rough, g.rough_limit).alias("roughness"), over(step, g.step_limit).alias("step_height"),
    )


def danger(m: DataFrame, g: Grid) -> DataFrame:
    """Adds danger and whether a seen cell is too dangerous."""
    a, b, c = WEIGHTS
    d = a * F.col("slope") / float(g.slope_limit) + b * F.col("roughness") / float(g.rough_limit) + c * F.col("step_height") / float(g.step_limit)
    return m.withColumn("danger", d).withColumn("nontraversable", F.col("valid") & (F.col("danger") > float(g.danger_limit)))


def first_obstacle(n: DataFrame) -> DataFrame:
    """Per bearing with an obstacle, its nearest one's range bin."""
    return n.where("nontraversable").groupBy("frame_id", "j").agg(F.min("i").alias("closest"))


def ray_cast(n: DataFrame) -> DataFrame:
    """Adds observed: the cell lies before its bearing's first obstacle. A bearing without obstacle has no observed cell."""
    closest = F.min(F.when(F.col("nontraversable"), F.col("i"))).over(Window.partitionBy("frame_id", "j"))
    return n.withColumn("observed", F.coalesce(F.col("i") < closest, F.lit(False)))


def codes(n: DataFrame) -> DataFrame:
    """Adds code: 1 for an obstacle, 0 for free, NaN for unknown."""
    return n.withColumn("code", F.when(F.col("nontraversable"), 1.0).when(F.col("observed"), 0.0).otherwise(float("nan")).cast("float"))


def grid_of(polar: DataFrame, frames: DataFrame, g: Grid) -> DataFrame:
    """All grid stages: frame_id, i, j, terrain, valid, the metrics, danger, nontraversable, observed, code."""
    return codes(ray_cast(danger(metrics_of(dense(height_map(polar, g), frames, g), g), g)))


def colorize(grid: DataFrame) -> DataFrame:
    """Colour class and RGB of each code, as files and as the viewer show it (fixed values)."""
    unknown, free = F.isnan("code"), F.col("code") <= 0.5

    def pick(a, b, c) -> Column:
        return F.when(unknown, a).when(free, b).otherwise(c)

    return grid.select(
        "frame_id", "i", "j", pick("unknown", "free", "blocked").alias("class"),
        pick(128, 0, 220).alias("red"), pick(128, 200, 0).alias("green"), pick(128, 0, 0).alias("blue"),
    )


def mirrored(grid: DataFrame, g: Grid) -> DataFrame:
    """Row and column at which the viewer paints each cell: both axes are turned round."""
    return grid.withColumn("row", F.lit(g.nr - 1) - F.col("i")).withColumn("col", F.lit(g.nt - 1) - F.col("j"))


def upscaled(cells: DataFrame, factor: int = 8) -> DataFrame:
    """Each painted cell as factor x factor equal pixels."""
    offsets = F.array([F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(factor) for b in range(factor)])
    return cells.withColumn("o", F.explode(offsets)).select(
        *[c for c in cells.columns if c not in ("row", "col")], (F.col("row") * factor + F.col("o.dy")).alias("row"), (F.col("col") * factor + F.col("o.dx")).alias("col")
    )
