"""Poses on a clock of their own, against a plain model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark import storage
from gridlark.operators import poses
from gridlark.sources import recorded

NAN, INF = float("nan"), float("inf")
TRACK = "timestamp_ns long, pose struct<x: float, y: float, z: float, w: float>"
ROWS = "frame_id long, timestamp_ns long, _at string"


def turned(a, b, share):
    """Rotation by ``share`` of the turn from a to b: powers of the quotient, a form without sines of the quotient's half angle in the denominator."""
    a, b = (np.array(q, np.float64) / np.linalg.norm(q) for q in (a, b))
    if a @ b < 0:
        b = -b
    across = b - (a @ b) * a
    if not np.linalg.norm(across):
        return a
    angle = np.arctan2(np.linalg.norm(across), a @ b) * share
    return np.cos(angle) * a + np.sin(angle) * across / np.linalg.norm(across)


def model(at, track, bridge=None):
    track = [(t, p) for t, p in track if t is not None and p is not None and all(x is not None and np.isfinite(x) for x in p)]
    if at is None or not track:
        return None
    first = {t: max(p for u, p in track if u == t) for t, _ in track}
    before, after = max((t for t in first if t <= at), default=None), min((t for t in first if t > at), default=None)
    if before == at or after is None:
        return first[before]
    if before is None:
        return first[after]
    if (bridge is not None and after - before > bridge) or not all(np.linalg.norm(first[t]) > 1e-6 for t in (before, after)):
        return first[before if at - before <= after - at else after]
    return tuple(turned(first[before], first[after], (at - before) / (after - before)))


@pytest.mark.parametrize("bridge", [None, 40])
@pytest.mark.parametrize("rows_each", [15, 1_000_000])
def test_poses_agree_with_a_plain_model(spark, monkeypatch, rows_each, bridge):
    monkeypatch.setattr(storage, "RANGE_ROWS", rows_each)
    rng, epoch = random.Random(5), 1_705_232_584_597_200_001
    track = [(epoch + rng.randrange(1000), tuple(float(np.float32(rng.uniform(-1, 1))) for _ in range(4))) for _ in range(60)]
    track += [(epoch + 500, (0.0, 0.0, 0.0, 0.0)), (epoch + 510, (NAN, 0.0, 0.0, 1.0)), (epoch + 511, (0.0, INF, 0.0, 1.0)), (epoch + 512, (None, 0.0, 0.0, 1.0)), (None, (0.0, 0.0, 0.0, 1.0)), (epoch + 513, None), track[0], (track[0][0], (0.0, 0.0, 0.0, 1.0))]
    hot = track[3][0] + 1
    rows = [(k, rng.choice([hot, hot, epoch + rng.randrange(-50, 1050), track[rng.randrange(60)][0], None]), "x") for k in range(300)]  # frame_id alone orders them
    got = poses.poses_at(spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(track, TRACK), bridge_ns=bridge)
    assert got.columns == ["frame_id", "timestamp_ns", "_at", "pose"]
    got = got.collect()
    assert sorted((r.frame_id, r.timestamp_ns, r._at) for r in got) == rows
    for r in got:
        wanted = model(r.timestamp_ns, track, bridge)
        assert (r.pose is None) == (wanted is None)
        assert wanted is None or np.allclose(tuple(r.pose), wanted, atol=1e-5), (r, wanted)


def test_without_poses_or_rows(spark):
    rows, track = spark.createDataFrame([(1, 5, "x"), (1, 5, "x")], ROWS), spark.createDataFrame([(5, (0.0, 0.0, 0.0, 2.0))], TRACK)
    assert [r.pose for r in poses.poses_at(rows, track.where("false")).collect()] == [None, None]
    assert [tuple(r.pose) for r in poses.poses_at(rows, track).collect()] == [(0.0, 0.0, 0.0, 2.0)] * 2
    assert poses.poses_at(rows.where("false"), track).count() == 0
    far = spark.createDataFrame([(-(1 << 63), (0.0, 0.0, 0.0, 1.0)), ((1 << 63) - 1, (1.0, 0.0, 0.0, 0.0))], TRACK)
    assert np.allclose(tuple(poses.poses_at(rows, far).first().pose), (np.sqrt(0.5), 0, 0, np.sqrt(0.5)), atol=1e-6)


def test_replaced_poses_are_those_of_the_track(spark):
    frames = spark.createDataFrame([(1, 10, (0.0, 0.0, 0.0, 1.0)), (2, 15, None)], recorded.FRAMES)
    got = poses.poses_at(frames, spark.createDataFrame([(10, (1.0, 0.0, 0.0, 0.0)), (20, (0.0, 1.0, 0.0, 0.0))], TRACK)).orderBy("frame_id")
    assert got.columns == ["frame_id", "timestamp_ns", "pose"]
    assert np.allclose([tuple(p) for (p,) in got.select("pose").collect()], [(1, 0, 0, 0), (np.sqrt(0.5), np.sqrt(0.5), 0, 0)], atol=1e-6)


def test_a_recording_with_a_track_of_its_own(spark, tmp_path):
    frames = spark.createDataFrame([(1, 10, None), (2, 15, None), (3, None, None)], recorded.FRAMES)
    frames.write.parquet(str(tmp_path / "frames"))
    assert [r.pose for r in recorded.read_frames(spark, str(tmp_path)).collect()] == [None] * 3
    spark.createDataFrame([(10, (1.0, 0.0, 0.0, 0.0)), (20, (0.0, 1.0, 0.0, 0.0))], TRACK).write.parquet(str(tmp_path / "poses"))
    got = recorded.read_frames(spark, str(tmp_path)).orderBy("frame_id").collect()
    assert np.allclose([tuple(r.pose) for r in got], [(1, 0, 0, 0), (np.sqrt(0.5), np.sqrt(0.5), 0, 0), (0, 0, 0, 1)], atol=1e-6)
