"""Recorded point clouds: Parquet tables of points and frames, in batch or as a stream of files, with frame skipping."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators.poses import poses_at
from gridlark.storage import ordinal, partitions

POINTS = "frame_id long, pixel_id long, x float, y float, z float, w float"
POSES = "timestamp_ns long, pose struct<x: float, y: float, z: float, w: float>"
FRAMES = "frame_id long, timestamp_ns long, pose struct<x: float, y: float, z: float, w: float>"
NAMES = [c.split()[0] for c in POINTS.split(", ")]
#: The layout of a written recording: frames in a folder (the number is part of the folders' name, so that readers know it), points a file should hold at most, and bytes
#: in a row group (less than a frame at full resolution).
SPAN, SPAN_FRAMES, FILE_POINTS, GROUP_BYTES = "span_of_", 100, 5_000_000, 16 << 20


def write_recording(points: DataFrame, frames: DataFrame, path: str, poses: DataFrame | None = None, span_frames: int = SPAN_FRAMES, file_points: int = FILE_POINTS) -> None:
    """Writes a recording so that a range of frames is found without reading the rest: tables points, frames and, if given, poses below ``path``, which must not hold them yet.

    Points lie in a folder for each ``span_frames`` frames, sorted by frame and pixel in files of about ``file_points``: folders are left out when a query is planned, row groups and
    pages by their statistics when it runs. One range shuffle; a frame with most of the points is cut over several files. Points without a frame are kept, in a folder of their
    own. The frames come last, so a recording that has them is whole.
    """
    order = ["frame_id", "pixel_id"]
    rows = points.select(*NAMES).repartitionByRange(partitions(points.sparkSession, points.count(), file_points), *order)
    # as long as rows are sorted by the folder first, Spark doesn't sort them anew
    span = f"{SPAN}{span_frames}"
    rows = rows.withColumn(span, F.expr(f"frame_id div {span_frames}")).sortWithinPartitions(span, *order)
    rows.write.partitionBy(span).option("parquet.block.size", GROUP_BYTES).option("maxRecordsPerFile", file_points).parquet(f"{path}/points")
    if poses is not None:
        _sorted(poses, POSES).write.parquet(f"{path}/poses")
    _sorted(frames, FRAMES).write.parquet(f"{path}/frames")


def _sorted(table: DataFrame, schema: str) -> DataFrame:
    """A small table of a recording, by ranges of time."""
    return table.select(*[c for c in ("frame_id", "timestamp_ns", "pose") if c in schema]).repartitionByRange("timestamp_ns").sortWithinPartitions("timestamp_ns")


def read_points(spark: SparkSession, path: str, frames: tuple[int, int] | None = None) -> DataFrame:
    """A recording's points; with ``frames`` those of frames from the first to the last, for which only folders and row groups are read that may hold them."""
    rows = spark.read.schema(POINTS).parquet(path)
    if frames is None:
        return rows.select(*NAMES)
    rows = rows.where(F.col("frame_id").between(*frames))
    for span in (c for c in rows.columns if c.startswith(SPAN)):
        size = int(span.removeprefix(SPAN))
        rows = rows.where(F.col(span).between(*(f // size if f >= 0 else -(-f // size) for f in frames)))  # towards zero, as ``div``
    return rows.select(*NAMES)


def stream_points(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A replay: so many files per trigger; the query's trigger interval sets the pace. Written recordings have files that a frame may reach beyond: ``streaming.frame_stream`` takes them."""
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path).select(*NAMES)


def stream_frames(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The recording's frames as a stream."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The recording's frames. Where it has a table ``poses`` on a clock of its own, they take theirs from it, and a frame without a time has the identity, as all have if it is empty."""
    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames")
    try:
        track = spark.read.schema(POSES).parquet(f"{path}/poses")
    except AnalysisException as why:
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        return frames
    still = F.expr("named_struct('x', 0f, 'y', 0f, 'z', 0f, 'w', 1f)")
    return poses_at(frames, track).withColumn("pose", F.coalesce("pose", still))


def event_time(frames: DataFrame) -> DataFrame:
    """Adds ts, the time stamp in microseconds (the nanoseconds stay in timestamp_ns)."""
    return frames.withColumn("ts", F.expr("timestamp_micros((timestamp_ns - pmod(timestamp_ns, 1000)) div 1000)"))


def skip(frames: DataFrame, k: int, *order: str) -> DataFrame:
    """Every (k+1)-th frame in a total order (by default time stamp, then frame_id): k are dropped before each one kept, and an
    incomplete group at the end is dropped."""
    if k == 0:
        return frames
    return ordinal(frames, *(order or ("timestamp_ns", "frame_id")), to="_ordinal").where(F.pmod("_ordinal", F.lit(k + 1)) == k).drop("_ordinal")
