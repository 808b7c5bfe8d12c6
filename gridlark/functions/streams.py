"""Sequence, rate and conflation measures over ordered packet or frame tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark import storage

WRAP = 1 << 32


def seq_gaps(packets: DataFrame, sender: str = "sender", arrival: str = "arrival", seq: str = "seq") -> DataFrame:
    """Per sender: packets and lost ones, counted modulo 2^32 in order of arrival.

    A repeated packet adds 2^32 - 1 and a late one subtracts, modulo the wrap. What lies between neighbours adds up to what lies between the first and the last
    packet, so no order is needed but for these two: partial aggregates, of which one row a sender is shuffled. Packets without a number don't count.
    """
    at = [F.min_by(seq, arrival).alias("first"), F.max_by(seq, arrival).alias("last")]
    ends = packets.where(F.col(seq).isNotNull()).groupBy(sender).agg(F.count("*").alias("packets"), *at)
    return ends.select(sender, "packets", F.pmod(F.col("last") - F.col("first") - (F.col("packets") - 1), F.lit(WRAP)).alias("lost"))


def next_at_least(moments: DataFrame, ts: str, ahead: int, most: int) -> DataFrame:
    """Each moment of a table of distinct ones and next, the first one at least so much later (null if there is none).

    Moments and moments shifted by ``ahead`` are merged by ranges of time; of each range only its first moment meets the others'.
    """
    at = F.col(ts)
    both = moments.select(at.alias("at"), F.lit(1).alias("real"), at.alias("of")).unionByName(moments.select((at + ahead).alias("at"), F.lit(0).alias("real"), at.alias("of")))
    rows = storage.ranged(both, "at", "real", most=2 * most)  # a moment comes behind what is shifted to it
    backwards = Window.partitionBy(storage.PART).orderBy(F.desc("at"), F.desc("real")).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("near", F.min(F.when(F.col("real") == 1, F.col("at"))).over(backwards)).where("real = 0")
    later = Window.orderBy(F.desc(storage.PART)).rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(storage.PART).agg(F.min(F.when(F.col("real") == 1, F.col("at"))).alias("first"))
    first = first.select(storage.PART, F.min("first").over(later).alias("beyond"))  # one row a range
    return inside.join(F.broadcast(first), storage.PART).select(F.col("of").alias(ts), F.coalesce("near", "beyond").alias("next"))


def rate_windows(shown: DataFrame, ts: str = "timestamp_ns", width: int = 1_000_000_000) -> DataFrame:
    """The viewer's rates: start_ns, end_ns, frames, fps of each window.

    A window is open until the first frame at least ``width`` after its start; that frame is its last one, and the next window starts there. The rate is by the time
    that really passed. The first frame starts the first window and counts in it; a window that no frame closes has no rate. Frames without a time don't count.

    Each moment's successor is known by a merge; those that are starts are found by doubling: after k rounds, which are written tables, all starts within
    2^k windows of the first one. Frames inside a window are counted by ordinals.
    """
    numbered = storage.ordinal(shown.where(F.col(ts).isNotNull()).select(F.col(ts).cast("long").alias(ts)), ts, to="n")
    moments = storage.written(numbered.groupBy(ts).agg(F.min("n").alias("n")), "moments")
    count = moments.count()
    jumps = storage.written(next_at_least(moments.select(ts), ts, width, count).where("next IS NOT NULL"), "jumps")
    steps = jumps
    starts, known = storage.written(moments.agg(F.min(ts).alias("start")).where("start IS NOT NULL"), "starts"), 0
    while (found := starts.count()) > known:
        known = found
        more = starts.join(jumps, F.col("start") == F.col(ts)).select(F.col("next").alias("start"))
        grown = storage.written(starts.unionByName(more).distinct(), "starts")
        twice = storage.written(jumps.join(jumps.select(F.col(ts).alias("next"), F.col("next").alias("after")), "next").select(ts, F.col("after").alias("next")), "jumps")
        storage.drop_written(starts, *([jumps] if jumps is not steps else []))
        starts, jumps = grown, twice
    ends = starts.join(steps, F.col("start") == F.col(ts)).select("start", F.col("next").alias("end"))
    before = moments.select(F.col(ts).alias("start"), F.col("n").alias("n_start"))
    rows = ends.join(before, "start").join(moments.select(F.col(ts).alias("end"), F.col("n").alias("n_end")), "end")
    frames = F.col("n_end") - F.col("n_start") + F.when(F.col("n_start") == 0, 1).otherwise(0)
    return rows.select(F.col("start").alias("start_ns"), F.col("end").alias("end_ns"), frames.alias("frames"), (frames / ((F.col("end") - F.col("start")) / 1e9)).alias("fps"))


def finite_before(points: DataFrame, finite: Column, *order: str, group: str = "frame_id", to: str = "slot") -> DataFrame:
    """Adds how many rows of the group before this one, in a total order, satisfy ``finite``: where stream compaction puts them.

    Groups beyond ``RANGE_ROWS`` are dealt by ranges; the sums of their ranges are added up in a small table.
    """
    rows = points.withColumn("_f", finite.cast("long"))
    few = storage.largest_group(points, group) <= storage.RANGE_ROWS
    rows = rows.withColumn(storage.PART, F.lit(0)) if few else storage.ranged(rows, group, *order)
    inside = F.sum("_f").over(Window.partitionBy(group, storage.PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    if few:
        return rows.withColumn(to, F.col("_inside")).drop("_f", "_inside", storage.PART)
    before = Window.partitionBy(group).orderBy(storage.PART).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(group, storage.PART).agg(F.sum("_f").alias("_n")).select(group, storage.PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(base, [group, storage.PART]).withColumn(to, F.col("_base") + F.col("_inside")).drop("_f", "_inside", "_base", storage.PART)


def conflate(results: DataFrame, window: str = "batch", order: str = "timestamp_ns") -> DataFrame:
    """The newest result of each window, and how many older ones it superseded."""
    return results.groupBy(window).agg(F.max_by(F.struct("*"), order).alias("newest"), (F.count("*") - 1).alias("dropped"))


def fps(frames: DataFrame, captured: str = "captured", processed: str = "processed") -> DataFrame:
    """Captured and processed frames, elapsed seconds and both rates; rates are null if no time has passed."""
    seconds = (F.max("timestamp_ns") - F.min("timestamp_ns")).cast("double") / 1e9
    m = frames.agg(F.sum(captured).alias("frames_captured"), F.sum(processed).alias("frames_processed"), seconds.alias("elapsed_s"))
    positive = F.when(F.col("elapsed_s") > 0, F.col("elapsed_s"))
    return m.select("*", (F.col("frames_captured") / positive).alias("source_fps"), (F.col("frames_processed") / positive).alias("pipeline_fps"))


def viewer_fps(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Frames shown in each second that has any."""
    return events.groupBy(F.window(ts, "1 second").alias("w")).agg(F.count("*").alias("fps")).select(F.col("w.start").alias("second"), "fps")
