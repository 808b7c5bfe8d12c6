"""Recordings replayed at their own pace."""

import time

import pytest
from pyspark.sql import functions as F

from gridlark.sources import paced, recorded

SECOND = 10**9
STAMPS = [10, 10, 13, 14, 21]  # seconds


@pytest.fixture(scope="module")
def recording(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("paced"))
    frames = spark.createDataFrame([(k, s * SECOND, (0.0, 0.0, 0.0, 1.0)) for k, s in enumerate(STAMPS)], recorded.FRAMES)
    frames.repartition(2).write.parquet(f"{path}/frames")
    points = spark.createDataFrame([(f, p, 0.5, 0.1 * p, 0.0, 1.0) for f in range(5) for p in range(40)], recorded.POINTS)
    points.repartitionByRange(3, "frame_id").sortWithinPartitions("frame_id").write.parquet(f"{path}/points")
    return path


def reader(path, now, **options):
    return paced.PacedReader({"path": path, **options}, clock=lambda: now[0])


def frames_of(r, start, end):
    return sorted({f for p in r.partitions(start, end) for b in r.read(p) for f in b.column(0).to_pylist()})


def test_frames_are_due_as_they_were_recorded(recording):
    now = [1000.0]
    r = reader(recording, now)
    at, seen = r.initialOffset(), []
    for t in (0, 2.9, 3, 3.5, 4, 10.9, 11, 60):
        now[0] = 1000.0 + t
        end = r.latestOffset()
        seen.append(frames_of(r, at, end))
        at = end
    assert seen == [[0, 1], [], [2], [], [3], [], [4], []]
    assert r.latestOffset() == {"after": 21 * SECOND}


def test_speed_restarts_and_skips(recording):
    now = [50.0]
    fast = reader(recording, now, speed="2", began_ms="50000")
    now[0] = 52.0
    assert frames_of(fast, fast.initialOffset(), fast.latestOffset()) == [0, 1, 2, 3]
    again = reader(recording, now, speed="2", began_ms="50000")  # a restart goes by the same clock
    assert again.latestOffset() == fast.latestOffset() and frames_of(again, fast.latestOffset(), again.latestOffset()) == []
    skipping = reader(recording, now, speed="100", began_ms="0", frame_skip="1")
    assert frames_of(skipping, skipping.initialOffset(), skipping.latestOffset()) == [1, 3]
    assert frames_of(skipping, {"after": 10 * SECOND}, skipping.latestOffset()) == [3]


def test_only_row_groups_with_due_frames_are_read(recording):
    r = reader(recording, [1e9], began_ms="0")
    assert len(r.partitions({"after": 20 * SECOND}, r.latestOffset())) == 1
    rows = [b for p in r.partitions(r.initialOffset(), r.latestOffset()) for b in r.read(p)]
    assert sum(b.num_rows for b in rows) == 200


def test_a_query_runs_at_the_recording_s_pace(spark, recording, tmp_path):
    spark.dataSource.register(paced.PacedRecording)
    stream = spark.readStream.format("paced_recording").option("path", recording).option("speed", "2").load()
    seen = {}

    def each(batch, number):
        for r in batch.groupBy("frame_id").agg(F.count("*").alias("n")).collect():
            seen[r.frame_id] = seen.get(r.frame_id, 0) + r.n
        if seen.get(4):
            seen["end"] = time.time()

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).start()
    began = time.time()
    while "end" not in seen and time.time() - began < 60:
        time.sleep(0.2)
    query.stop()
    assert {k: n for k, n in seen.items() if k != "end"} == dict.fromkeys(range(5), 40)
    assert seen["end"] - began > 3  # eleven seconds of recording at twice its speed
