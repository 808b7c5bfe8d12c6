"""Point stages: finite points, levelled points, voxels, polar points. Each is a DataFrame -> DataFrame function.

Only the voxel stage shuffles, and it does so after a map-side count. Frames never meet, so ``frame_id`` is part of every key,
but raw points are not dealt by it: a frame with most of the points would land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.config import PolarConfig, VoxelConfig
from gridlark.functions.floats import div, f32, is_finite, single
from gridlark.functions.pose import MATRIX, tilt_matrices

#: Rows of poses that may be broadcast (about 50 bytes each); beyond that the join shuffles.
BROADCAST_FRAMES = 200_000
KEY_OFFSET, KEY_BITS = 1 << 20, 21


def extract_xyz(points: DataFrame) -> DataFrame:
    """Points whose three coordinates are finite; the packed colour is dropped, so that a scan doesn't read it."""
    return points.where(is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z"))).select("frame_id", "x", "y", "z")


def tilt_compensate(points: DataFrame, frames: DataFrame, few_frames: bool | None = None) -> DataFrame:
    """Points rotated by their frame's tilt. ``few_frames``: the pose table is known to fit a broadcast (counted if None)."""
    matrices = tilt_matrices(frames)
    if few_frames is None:
        few_frames = frames.limit(BROADCAST_FRAMES + 1).count() <= BROADCAST_FRAMES
    # From a generator the elements are plain columns to the optimizer. As aliases of expressions each would double the
    # equivalent predicates that it derives from the later filters on height and range, 2 ** 9 times in all.
    matrices = matrices.select("frame_id", F.inline(F.array(F.struct(*MATRIX))))
    joined = points.join(F.broadcast(matrices) if few_frames else matrices, "frame_id")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    rows = [(F.col(f"r{i}0") * x + F.col(f"r{i}1") * y + F.col(f"r{i}2") * z).alias(n) for i, n in enumerate("xyz")]
    return joined.select("frame_id", *rows)


def voxel_index(points: DataFrame, c: VoxelConfig) -> DataFrame:
    sizes = {"x": c.voxel_size_x, "y": c.voxel_size_y, "z": c.voxel_size_z}
    return points.select("*", *[F.floor(div(F.col(a), f32(s))).cast("long").alias(f"i{a}") for a, s in sizes.items()])


def voxel_key(ix, iy, iz):
    """The three indices in one 63-bit key, z major."""
    shifted = [c + F.lit(KEY_OFFSET) for c in (ix, iy, iz)]
    return F.shiftleft(shifted[2], 2 * KEY_BITS).bitwiseOR(F.shiftleft(shifted[1], KEY_BITS)).bitwiseOR(shifted[0])


def voxel_of_key(key):
    """The indices back from a key, by name."""
    mask = F.lit((1 << KEY_BITS) - 1)
    return {a: F.shiftright(key, n * KEY_BITS).bitwiseAND(mask) - F.lit(KEY_OFFSET) for n, a in enumerate(("ix", "iy", "iz"))}


def voxel_count(points: DataFrame, c: VoxelConfig) -> DataFrame:
    return voxel_index(points, c).groupBy("frame_id", "ix", "iy", "iz").agg(F.count("*").alias("n"))


def with_centres(counted: DataFrame, c: VoxelConfig) -> DataFrame:
    """Voxels with their centres x, y, z.

    The centres come from a generator: later filters on them stay above the count, where there are few rows. The optimizer
    would otherwise rewrite them over the raw coordinates and evaluate them for every point.
    """
    sizes = {"x": c.voxel_size_x, "y": c.voxel_size_y, "z": c.voxel_size_z}
    centres = [((single(F.col(f"i{a}")) + f32(0.5)) * f32(s)).alias(a) for a, s in sizes.items()]
    return counted.select("frame_id", "ix", "iy", "iz", "n", F.inline(F.array(F.struct(*centres))))


def voxel_filter(points: DataFrame, c: VoxelConfig) -> DataFrame:
    """Centres of voxels with enough points."""
    return with_centres(voxel_count(points, c).where(F.col("n") >= c.min_points_per_voxel), c)


def _range() -> Column:
    return single(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))


def in_band(c: PolarConfig) -> Column:
    """Whether a point lies inside the height band and beyond the least range."""
    return (F.abs("z") < f32(c.z_threshold)) & (_range() > f32(c.min_range))


def polarize(voxels: DataFrame, c: PolarConfig) -> DataFrame:
    """Range, bearing and height of points inside the height band and beyond the least range."""
    return voxels.where(in_band(c)).select("frame_id", _range().alias("r"), single(F.atan2("y", "x")).alias("theta"), "z")
