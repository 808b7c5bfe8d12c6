"""The pipeline from its configuration: settings, recorded source, frame skip, grids, sink, metrics.

``python -m gridlark.runner CONFIG [--stream]``. The source is the folder that ``zed.svo_path`` names, with the tables ``points`` and
``frames`` (and ``poses``, where these have a clock of their own) of a recording (``sources.recorded``). In batch all frames are delivered. As a stream the points' files are replayed, each
with whole frames, and of a micro-batch only the newest result reaches the sink; one follows the other and the replay ends. With ``svo_real_time`` frames come at the
recording's own pace (``sources.paced``), and micro-batches start at the rate of ``zed.fps``.
"""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gridlark import config as settings
from gridlark.config import PipelineConfig
from gridlark.plans import pipeline
from gridlark.sinks import files
from gridlark.sources import recorded
from gridlark.sources.paced import PacedRecording
from gridlark.storage import new_path, scratch
from gridlark.streaming import live


@dataclass
class Metrics:
    frames_captured: int = 0
    frames_processed: int = 0
    frames_dropped: int = 0
    elapsed_s: float = 0.0
    stages: dict[str, int] = field(default_factory=dict)

    def rate(self, frames: int) -> float:
        return frames / self.elapsed_s if self.elapsed_s > 0 else 0.0

    def report(self) -> str:
        return (
            f"frames captured {self.frames_captured}, processed {self.frames_processed}, dropped {self.frames_dropped}; "
            f"{self.elapsed_s:.2f} s; source {self.rate(self.frames_captured):.1f} fps, pipeline {self.rate(self.frames_processed):.1f} fps"
            + "".join(f"; {n} {stage}" for stage, n in self.stages.items())
        )


def source(spark: SparkSession, config: PipelineConfig) -> tuple[str, DataFrame]:
    """The points' path and the frames that are to be processed; settings that name no known unit, system, mode or resolution are refused."""
    config.validate()
    if not config.zed.svo_path:
        raise ValueError("zed.svo_path must name a recording: there is no camera here")
    frames = recorded.read_frames(spark, config.zed.svo_path)
    return f"{config.zed.svo_path}/points", recorded.skip(frames, config.zed.frame_skip)


def run(spark: SparkSession, config: PipelineConfig) -> Metrics:
    """All frames of the recording, in one batch. Frames and the rows of each stage are counted as they pass (``pipeline.Seen``)."""
    began = time.monotonic()
    path, frames = source(spark, config)
    points = recorded.read_points(spark, path).join(frames.select("frame_id"), "frame_id", "left_semi")
    seen = pipeline.Seen()
    with scratch(spark):
        files.sink_of(config, spark)(pipeline.results(points, frames, config, seen))
        stages = seen.counts()
    n = stages.pop("frames")
    return Metrics(n, n, 0, time.monotonic() - began, stages)


def replay(spark: SparkSession, config: PipelineConfig, checkpoint: str | None = None, conflate: bool = True, seconds: float | None = None) -> Metrics:
    """The recording as a stream; ``seconds`` ends one that is paced. With a checkpoint a later call goes on where this one ended."""
    began, m = time.monotonic(), Metrics()
    path, frames = source(spark, config)
    frames = frames.persist()
    checkpoint = checkpoint or new_path(spark, "replay")

    def count(n: int, dropped: int) -> None:
        m.frames_captured, m.frames_processed, m.frames_dropped = m.frames_captured + n, m.frames_processed + n, m.frames_dropped + dropped

    sink = files.sink_of(config, spark, f"{checkpoint}/sink")
    interval = f"{1000 // max(config.zed.fps, 1)} milliseconds" if config.zed.svo_real_time else None
    if interval:
        spark.dataSource.register(PacedRecording)
        points = spark.readStream.format("paced_recording").option("path", config.zed.svo_path).load()
        points = points.join(frames.select("frame_id"), "frame_id", "left_semi")
    else:
        points = recorded.stream_points(spark, path)
    query = live.grid_stream(points, frames, config, sink, f"{checkpoint}/query", conflate, count, interval)
    try:
        query.awaitTermination(seconds) if seconds else query.awaitTermination()
    finally:
        query.stop()
        frames.unpersist()
    m.elapsed_s = time.monotonic() - began
    return m


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridlark.runner")
    parser.add_argument("config")
    parser.add_argument("--stream", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("gridlark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print((replay if args.stream else run)(spark, settings.load(args.config)).report())


if __name__ == "__main__":
    main()
