"""Structured Streaming forms: grids per micro-batch or per closed frame, sequence gaps and rates as keyed state, replay.

Batch and stream run the same pipeline functions. Two ways lead from a stream of points to grids:

* ``grid_stream``: a frame's points arrive in one micro-batch (one file per frame, or one trigger).
* ``frame_stream``: they may arrive in several. Points are counted by voxel in the state store, where counts just add up, and a frame is closed by the
  event-time watermark; then its voxels come out together and become its grid. Frames come from a stream of their own, so one without points gives its dense grid too.

A micro-batch takes the part of the mailbox between producer and consumer: with ``conflate`` only its newest frame reaches the sink and the older ones are counted
as dropped; without it every frame is delivered, the last ones too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridlark.config import PipelineConfig
from gridlark.functions import streams
from gridlark.operators import points as P
from gridlark.plans import pipeline
from gridlark.sources.recorded import event_time


def newest(results: DataFrame) -> tuple[DataFrame, int]:
    """The result with the latest time stamp (of equal ones that with the greatest frame_id), and how many it superseded."""
    counts = results.agg(F.count("*").alias("n"), F.max(F.struct("timestamp_ns", "frame_id")).alias("last")).first()
    if not counts["n"]:
        return results, 0
    return results.where((F.col("timestamp_ns") == counts["last"]["timestamp_ns"]) & (F.col("frame_id") == counts["last"]["frame_id"])), counts["n"] - 1


def delivered(results: DataFrame, number: int, sink: Callable[..., None], conflate: bool, on_batch: Callable[[int, int], None] | None) -> None:
    """Hands a micro-batch's results to the sink."""
    results = results.persist()
    try:
        kept, dropped = newest(results) if conflate else (results, 0)
        sink(kept, number)
        if on_batch:
            on_batch(results.count(), dropped)
    finally:
        results.unpersist()


def grid_stream(
    points: DataFrame, frames: DataFrame, config: PipelineConfig, sink: Callable[..., None], checkpoint: str, conflate: bool = True,
    on_batch: Callable[[int, int], None] | None = None, interval: str | None = None,
) -> StreamingQuery:
    """Starts the query: points is a stream, frames a table of poses. ``interval`` paces it; otherwise it runs through what there is and ends.

    The sink gets results and the batch's number; on_batch gets the frames that a batch had and those that newer ones superseded.
    """

    def each(batch: DataFrame, number: int) -> None:
        seen = frames.join(batch.select("frame_id").distinct(), "frame_id", "left_semi")
        delivered(pipeline.results(batch, seen, config), number, sink, conflate, on_batch)

    writer = points.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def voxel_stream(points: DataFrame, arriving: DataFrame, frames: DataFrame, config: PipelineConfig, late: str) -> DataFrame:
    """frame_id, ts, ix, iy, iz, n of closed frames, from streams of points and frames in whatever pieces they arrive; each frame also has a row without indices.

    frames is the table of poses behind ``arriving``. Only counts are kept as state, one a voxel of an open frame. A point whose frame has closed is late and dropped by
    the watermark. Both streams have a watermark and the slower one counts, so frames that run ahead of their points close nothing.
    """
    level = P.voxel_index(P.tilt_compensate(P.extract_xyz(points), frames, few_frames=None), config.voxel_filter)
    timed = level.join(F.broadcast(event_time(frames).select("frame_id", "ts")), "frame_id").select("frame_id", "ts", "ix", "iy", "iz", F.lit(1).alias("one"))
    none = F.lit(None).cast("long")
    marks = event_time(arriving).select("frame_id", "ts", none.alias("ix"), none.alias("iy"), none.alias("iz"), F.lit(0).alias("one"))
    both = timed.withWatermark("ts", late).unionByName(marks.withWatermark("ts", late))
    return both.groupBy("frame_id", "ts", "ix", "iy", "iz").agg(F.sum("one").alias("n"))


def frame_stream(
    points: DataFrame, arriving: DataFrame, frames: DataFrame, config: PipelineConfig, sink: Callable[..., None], checkpoint: str, late: str = "2 seconds", conflate: bool = True,
    on_batch: Callable[[int, int], None] | None = None, interval: str | None = None,
) -> StreamingQuery:
    """As ``grid_stream``, for frames whose points come in several micro-batches: a frame is delivered once, when event time is ``late`` past it in both streams."""

    def each(batch: DataFrame, number: int) -> None:
        voxels = batch.persist()
        try:
            closed = frames.join(voxels.where("ix IS NULL").select("frame_id"), "frame_id", "left_semi")
            delivered(pipeline.results_of_voxels(voxels.where("ix IS NOT NULL"), closed, config), number, sink, conflate, on_batch)
        finally:
            voxels.unpersist()

    counted = voxel_stream(points, arriving, frames, config, late)
    writer = counted.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def gap_stream(packets: DataFrame) -> DataFrame:
    """Running totals per sender of a stream of (sender, arrival, seq): packets, and lost ones modulo 2^32; for update mode.

    The state of a sender is its count, first and last packet by arrival, so packets that come in a later micro-batch than later ones change nothing in the end.
    """
    return streams.seq_gaps(packets)


def gap_sessions(packets: DataFrame, ts: str = "ts", silent: str = "10 minutes", late: str = "10 seconds") -> DataFrame:
    """The same for append mode: a sender's session ends when it is silent for so long, and its state goes. packets: sender, arrival, seq, ts."""
    rows = packets.where("seq IS NOT NULL").withWatermark(ts, late).groupBy("sender", F.session_window(ts, silent).alias("w"))
    ends = rows.agg(F.count("*").alias("packets"), F.min_by("seq", "arrival").alias("first"), F.max_by("seq", "arrival").alias("last"))
    lost = F.pmod(F.col("last") - F.col("first") - (F.col("packets") - 1), F.lit(streams.WRAP))
    return ends.select("sender", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "packets", lost.alias("lost"))


RATES = "viewer long, start_ns long, end_ns long, frames long, fps double"


def rate_window_stream(shown: DataFrame, width: int = 1_000_000_000) -> DataFrame:
    """The windows of ``streams.rate_windows`` for each viewer of a stream of (viewer, timestamp_ns), as they are closed; for append mode.

    Frames must arrive in order of time from one micro-batch to the next. A viewer's state is its open window's start and count.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([p["timestamp_ns"].to_numpy() for p in parts]))
        start, count = state.get if state.exists else (int(times[0]), 0)
        rows, at = [], 0
        while (end := int(np.searchsorted(times, start + width))) < len(times):
            count += end + 1 - at
            rows.append((key[0], start, int(times[end]), count, count / ((int(times[end]) - start) / 1e9)))
            start, count, at = int(times[end]), 0, end + 1
        state.update((start, count + len(times) - at))
        yield pd.DataFrame(rows, columns=["viewer", "start_ns", "end_ns", "frames", "fps"])

    kept = shown.where("timestamp_ns IS NOT NULL").select("viewer", "timestamp_ns")
    return kept.groupBy("viewer").applyInPandasWithState(update, RATES, "start long, count long", "append", GroupStateTimeout.NoTimeout)


def rate_stream(shown: DataFrame, ts: str = "ts", late: str = "5 seconds") -> DataFrame:
    """Frames per second of a stream, by event time; a second is final once the watermark has passed it."""
    return shown.withWatermark(ts, late).groupBy(F.window(ts, "1 second").alias("w")).agg(F.count("*").alias("fps")).select(F.col("w.start").alias("second"), "fps")


def without_replays(frames: DataFrame, ts: str = "ts", late: str = "10 seconds") -> DataFrame:
    """Each frame once, also if the source delivers it again within the watermark."""
    return frames.withWatermark(ts, late).dropDuplicatesWithinWatermark(["frame_id"])
