"""Camera poses: quaternion expressions in single precision on the small table of frames.

The tilt keeps pitch and roll and takes yaw out by multiplying the pose with the conjugate yaw from the right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.floats import div, f32, single

NORM_LEAST = 1e-6
MATRIX = [f"r{i}{j}" for i in range(3) for j in range(3)]


def normalized(q: Column) -> Column:
    """The unit quaternion; one of (almost) no length stays as it is."""
    x, y, z, w = (q[c] for c in "xyzw")
    norm = single(F.sqrt(x * x + y * y + z * z + w * w))
    return F.when(norm > f32(NORM_LEAST), F.struct(*[div(q[c], norm).alias(c) for c in "xyzw"])).otherwise(F.struct(*[q[c].alias(c) for c in "xyzw"]))


def yaw(q: Column) -> Column:
    x, y, z, w = (q[c] for c in "xyzw")
    two = f32(2)
    return single(F.atan2(two * (w * z + x * y), f32(1) - two * (y * y + z * z)))


def without_yaw(q: Column, angle: Column) -> Column:
    x, y, z, w = (q[c] for c in "xyzw")
    half = angle * f32(0.5)
    s, c = single(F.sin(half)), single(F.cos(half))
    return F.struct((x * c - y * s).alias("x"), (x * s + y * c).alias("y"), (z * c - w * s).alias("z"), (w * c + z * s).alias("w"))


def rotation(q: Column) -> dict[str, Column]:
    x, y, z, w = (q[c] for c in "xyzw")
    one, two = f32(1), f32(2)
    return {
        "r00": one - two * (y * y + z * z), "r01": two * (x * y - w * z), "r02": two * (x * z + w * y),
        "r10": two * (x * y + w * z), "r11": one - two * (x * x + z * z), "r12": two * (y * z - w * x),
        "r20": two * (x * z - w * y), "r21": two * (y * z + w * x), "r22": one - two * (x * x + y * y),
    }


def steps(frames: DataFrame) -> DataFrame:
    """frames with unit (normalised pose), yaw and tilt (the pose without yaw)."""
    return frames.withColumn("unit", normalized(F.col("pose"))).withColumn("yaw", yaw(F.col("unit"))).withColumn("tilt", without_yaw(F.col("unit"), F.col("yaw")))


def tilt_matrices(frames: DataFrame) -> DataFrame:
    """frame_id and the nine elements of the tilt's rotation matrix."""
    return steps(frames).select("frame_id", *[c.alias(n) for n, c in rotation(F.col("tilt")).items()])
