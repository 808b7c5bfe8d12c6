"""Recordings as files: what a range of frames leaves unread."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridlark.sources import recorded

FRAMES = 60


@pytest.fixture(scope="module")
def clouds(spark):
    """Frames of 200 points, one of which has as many as all others, and points without a frame."""
    rows = spark.range(FRAMES * 200).select((F.col("id") % FRAMES - 20).alias("frame_id"), F.col("id").alias("pixel_id"))
    rows = rows.unionByName(spark.range(FRAMES * 200).select(F.lit(7).cast("long").alias("frame_id"), (F.col("id") + 1_000_000).alias("pixel_id")))
    rows = rows.unionByName(spark.createDataFrame([(None, 1), (None, None)], "frame_id long, pixel_id long"))
    points = rows.select("*", *[F.rand(k).cast("float").alias(c) for k, c in enumerate("xyzw")], F.lit("x").alias("span_of_10"))
    frames = spark.range(FRAMES).select((F.col("id") - 20).alias("frame_id"), F.col("id").alias("timestamp_ns"), F.expr("named_struct('x', 0f, 'y', 0f, 'z', 0f, 'w', 1f)").alias("pose"))
    return points, frames


@pytest.fixture(scope="module")
def recording(spark, clouds, tmp_path_factory):
    path = tmp_path_factory.mktemp("written")
    recorded.write_recording(*clouds, str(path), poses=clouds[1].select("timestamp_ns", "pose"), span_frames=10, file_points=3_000)
    return path


def test_all_comes_back(spark, clouds, recording):
    points, frames = clouds
    back = recorded.read_points(spark, str(recording / "points"))
    wanted = points.select("frame_id", "pixel_id", *"xyzw")
    assert back.columns == wanted.columns
    assert back.count() == 2 * FRAMES * 200 + 2 and not back.exceptAll(wanted).count()
    got = recorded.read_frames(spark, str(recording))
    assert got.columns == ["frame_id", "timestamp_ns", "pose"] and sorted(got.collect()) == sorted(frames.collect())
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        recorded.write_recording(*clouds, str(recording))


@pytest.mark.parametrize("first, last", [(-20, -1), (-5, 5), (7, 7), (0, 19), (38, 100), (100, 200)])
def test_ranges_hold_their_frames(spark, recording, first, last):
    whole = {f: 200 * (1 + FRAMES * (f == 7)) for f in range(-20, FRAMES - 20)}
    got = recorded.read_points(spark, str(recording / "points"), (first, last)).groupBy("frame_id").count().collect()
    assert {r.frame_id: r["count"] for r in got} == {f: n for f, n in whole.items() if first <= f <= last}


def test_other_folders_aren_t_opened(spark, clouds, tmp_path):
    recorded.write_recording(*clouds, str(tmp_path), span_frames=10, file_points=3_000)
    for f in (tmp_path / "points").glob("*/*.parquet"):
        if f.parent.name not in ("span_of_10=2", "span_of_10=3"):
            f.write_bytes(b"no parquet")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert recorded.read_points(spark, str(tmp_path / "points"), (20, 39)).count() == 20 * 200
    with pytest.raises(Exception, match="CANNOT_READ|not a Parquet file"):
        recorded.read_points(spark, str(tmp_path / "points"), (19, 39)).count()


def test_a_large_frame_is_cut_and_files_are_sorted(recording):
    files = {f: pq.read_table(f, columns=["frame_id", "pixel_id"], partitioning=None) for f in Path(recording, "points").glob("*/*.parquet")}
    assert sum(7 in t["frame_id"].to_pylist() for t in files.values()) >= 4 and max(map(len, files.values())) <= 3_000
    for t in files.values():
        keys = [(a is not None, a or 0, b is not None, b or 0) for a, b in zip(t["frame_id"].to_pylist(), t["pixel_id"].to_pylist(), strict=True)]
        assert keys == sorted(keys)


def test_plain_tables_and_empty_ones(spark, clouds, tmp_path):
    clouds[0].select("frame_id", "pixel_id", *"xyzw").write.parquet(str(tmp_path / "plain"))
    assert recorded.read_points(spark, str(tmp_path / "plain"), (8, 9)).count() == 400
    recorded.write_recording(clouds[0].where("false"), clouds[1].where("false"), str(tmp_path / "none"))
    assert recorded.read_points(spark, str(tmp_path / "none" / "points"), (0, 9)).count() == 0
