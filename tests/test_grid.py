"""Point and grid stages on hand-written rows, and against a plain numpy model."""

import math

import numpy as np
import pytest

from gridlark import config
from gridlark.functions import packets
from gridlark.grid import Grid, reflected
from gridlark.operators import points as P
from gridlark.operators import terrain as T
from gridlark.plans import pipeline

C = config.PipelineConfig()
G = Grid.of(C.traversability)
INF, NAN = float("inf"), float("nan")


def small(nr, nt):
    return Grid.of(config.GridConfig(r_max_m=0.3 + 0.1 * nr - 0.05, theta_min_deg=0.0, theta_max_deg=5.0 * nt - 2.5))


def frames(spark, ids=(1,), q=(0.0, 0.0, 0.0, 1.0)):
    return spark.createDataFrame([(i, i * 1000, q) for i in ids], "frame_id long, timestamp_ns long, pose struct<x: float, y: float, z: float, w: float>")


def test_default_grid_counts_bins_in_single_precision():
    assert (G.nr, G.nt) == (17, 19)


def test_reflection_repeats_the_edge():
    assert [reflected(i, 5) for i in range(-2, 7)] == [1, 0, 0, 1, 2, 3, 4, 4, 3]
    assert reflected(3, 1) == 0


def test_only_finite_points_stay(spark):
    bad = [(1, i, *(v if k == axis else 1.0 for k in range(3)), 0.0) for i, (axis, v) in enumerate((a, v) for a in range(3) for v in (NAN, INF, -INF))]
    rows = spark.createDataFrame([*bad, (1, 90, 1.0, 2.0, 3.0, NAN)], "frame_id long, pixel_id long, x float, y float, z float, w float")
    assert [tuple(r) for r in P.extract_xyz(rows).collect()] == [(1, 1.0, 2.0, 3.0)]


@pytest.mark.parametrize("q, turned", [((0, 0, 0, 1), (1, 2, 3)), ((0, 0, 0.70710678, 0.70710678), (1, 2, 3)), ((0, 0, 0, 0), (1, 2, 3)), ((0, 0, 0, 4), (1, 2, 3)), ((0.70710678, 0, 0, 0.70710678), (1, -3, 2))])
def test_tilt_keeps_yaw_out(spark, q, turned):
    p = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "frame_id long, x float, y float, z float")
    got = P.tilt_compensate(p, frames(spark, q=tuple(map(float, q)))).first()
    assert np.allclose(got[1:], turned, atol=1e-5)


def test_voxels_need_three_points_and_floor_downwards(spark):
    rows = [(1, -0.01, 0.01, 0.01)] * 2 + [(1, -0.01, 0.06, 0.01)] * 3 + [(1, 0.051, 0.0, 0.0)] * 4
    got = P.voxel_filter(spark.createDataFrame(rows, "frame_id long, x float, y float, z float"), C.voxel_filter).collect()
    assert sorted((r.ix, r.iy, r.iz, r.n) for r in got) == [(-1, 1, 0, 3), (1, 0, 0, 4)]
    assert {round(r.x, 4) for r in got} == {-0.025, 0.075}


def test_polar_limits_are_strict(spark):
    rows = [(1, 1.0, 0.0, z) for z in (0.45, -0.45, 0.44)] + [(1, 0.1, 0.0, 0.0), (1, -1.0, 1.0, 0.0)]
    got = P.polarize(spark.createDataFrame(rows, "frame_id long, x float, y float, z float"), C.polarize).collect()
    assert sorted(round(r.theta, 4) for r in got) == [0.0, round(3 * math.pi / 4, 4)]


def coded(spark, nr, nt, blocked, valid=None):
    rows = [(1, i, j, (i, j) in blocked, valid is None or (i, j) in valid) for i in range(nr) for j in range(nt)]
    df = spark.createDataFrame(rows, "frame_id long, i int, j int, nontraversable boolean, valid boolean")
    return {(r.i, r.j): r.code for r in T.codes(T.ray_cast(df)).collect()}


def test_ray_cast_frees_cells_before_the_first_obstacle_only(spark):
    got = coded(spark, 4, 3, {(0, 0), (2, 1), (3, 1)})
    assert [got[i, 1] for i in range(4)] == [0, 0, 1, 1]
    assert got[0, 0] == 1 and math.isnan(got[1, 0])
    assert all(math.isnan(got[i, 2]) for i in range(4))


def model(z, g):
    """Slope, roughness, step height of a terrain, cell by cell."""
    nr, nt = z.shape
    out = np.zeros((3, nr, nt))
    for i in range(nr):
        for j in range(nt):
            def along(a, b, n, k, step):
                if n == 1:
                    return 0.0
                return (float(b) - float(a)) / float(step if k in (0, n - 1) else np.float32(2) * step)
            dr = along(z[max(i - 1, 0), j], z[min(i + 1, nr - 1), j], nr, i, g.dr)
            dt = along(z[i, max(j - 1, 0)], z[i, min(j + 1, nt - 1)], nt, j, g.dtheta)
            slope = math.atan(math.hypot(dr, dt / float(g.centre(i, j)[0])))
            near = [float(z[reflected(i + a, nr), reflected(j + b, nt)]) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            rises, count = [0.0], 0
            for a in range(-2, 3):
                for b in range(-2, 3):
                    u, v = reflected(i + a, nr), reflected(j + b, nt)
                    dxy = math.dist(g.centre(i, j)[2:], g.centre(u, v)[2:])
                    dz = abs(np.float32(z[i, j]) - np.float32(z[u, v]))
                    if dxy > 0 and dz > g.step_limit and math.atan2(float(dz), dxy) > g.slope_limit:
                        rises.append(float(dz))
                        count += 1
            h = max(rises)
            for k, (x, top) in enumerate(((slope, g.slope_limit), (float(np.std(near)), g.rough_limit), (min(h, h * count / 24), g.step_limit))):
                out[k, i, j] = INF if x > float(top) else x
    return out


@pytest.mark.parametrize("nr, nt", [(1, 1), (1, 5), (5, 1), (2, 2), (5, 6)])
def test_metrics_agree_with_a_plain_model(spark, nr, nt):
    g = small(nr, nt)
    assert (g.nr, g.nt) == (nr, nt)
    z = np.random.default_rng(nr * 10 + nt).choice(np.array([-0.3, -0.28, 0.0, 0.05, 0.2], np.float32), (nr, nt))
    rows = [(1, i, j, float(z[i, j]), True) for i in range(nr) for j in range(nt)]
    got = T.metrics(spark.createDataFrame(rows, "frame_id long, i int, j int, terrain float, valid boolean"), g).collect()
    wanted = model(z, g)
    for r in got:
        assert np.allclose([r.slope, r.roughness, r.step_height], wanted[:, r.i, r.j], atol=1e-4), (r, wanted[:, r.i, r.j])


def test_a_frame_without_points_gives_a_full_unknown_grid(spark):
    none = spark.createDataFrame([], "frame_id long, pixel_id long, x float, y float, z float, w float")
    got = pipeline.grids(none, frames(spark, (1, 2)), C).collect()
    assert len(got) == 2 * G.nr * G.nt
    assert all(math.isnan(r.code) and round(r.terrain, 4) == -0.3 and not r.valid for r in got)


def test_packets_come_back_and_bad_ones_are_skipped(spark):
    none = spark.createDataFrame([], "frame_id long, pixel_id long, x float, y float, z float, w float")
    results = packets.with_sequence(pipeline.results(none, frames(spark, (200, 129)), C))
    sent = packets.encoded(results).select("payload").collect()
    good = bytes(sent[0].payload)
    assert len(good) == 2760 and good[:4] == b"VART"
    rows = [(good,), (good[:23],), (good[:-1],), (b"\x00" + good[1:],), (b"",)]
    got = packets.decoded(spark.createDataFrame(rows, "payload binary")).collect()
    assert len(got) == 1 and (got[0].nr, got[0].nt) == (17, 19)
    assert all(map(math.isnan, got[0].trav_grid)) and np.allclose(got[0].height_map, -0.3)


def test_config_overlays_defaults(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("zed: {resolution: VGA, frame_skip: 1}\nconsumer: Disk\ntraversability: {r_max_m: 3}\n")
    c = config.load(str(path))
    assert (c.zed.w, c.zed.h, c.zed.frame_skip, c.traversability.r_max_m) == (672, 376, 1, 3.0)
    assert config.consumer_kind(c.consumer) == "disk" and config.consumer_kind("x") == "null"
    assert config.load(str(tmp_path / "none.yaml")) == config.PipelineConfig()
    path.write_text("zed: {fps: many}\n")
    with pytest.raises(TypeError):
        config.load(str(path))


def test_larger_grids_agree_too_and_cost_their_cells(spark):
    g = small(40, 30)
    z = np.random.default_rng(7).choice(np.array([-0.3, -0.28, 0.0, 0.05, 0.2, np.nan], np.float32), (40, 30))
    rows = [(1, i, j, float(z[i, j])) for i in range(40) for j in range(30) if not np.isnan(z[i, j])]
    heights = spark.createDataFrame(rows, "frame_id long, i int, j int, z_max float")
    got = T.metrics_of(T.dense(heights, frames(spark), g), g).collect()
    wanted = model(np.where(np.isnan(z), np.float32(T.EMPTY_HEIGHT), z), g)
    assert len(got) == 1200 and all(r.valid == (not np.isnan(z[r.i, r.j])) for r in got)
    for r in got:
        assert np.allclose([r.slope, r.roughness, r.step_height], wanted[:, r.i, r.j], atol=1e-4), (r, wanted[:, r.i, r.j])
    fine = small(400, 400)  # as one frame's whole array in each cell's row this would be 100 GB
    assert T.grid_of(spark.createDataFrame([(1, 1.0, 0.5, 0.1)], "frame_id long, r float, theta float, z float"), frames(spark), fine).where("valid").count() == 1
