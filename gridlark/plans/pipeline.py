"""The whole pipeline as one plan: points and poses in, grids out. Batch and streaming use the same function."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridlark.config import PipelineConfig
from gridlark.functions.packets import packed
from gridlark.grid import Grid
from gridlark.operators import points as P
from gridlark.operators import terrain as T


#: Takes a stage's name and its rows, and returns them, counted or not.
See = Callable[[str, DataFrame], DataFrame]


class Seen:
    """Counts what passes each stage in the very pass that computes the results, so that nothing is computed or kept a second time for it.

    A stage's rows are counted by the tasks that make them, and known when the first write of the results has ended. Rows of stages below a shuffle count
    again where Spark repeats such tasks after a lost executor; the results themselves don't.
    """

    def __init__(self) -> None:
        self.stages: dict[str, Observation] = {}

    def __call__(self, stage: str, rows: DataFrame) -> DataFrame:
        self.stages[stage] = Observation()
        return rows.observe(self.stages[stage], F.count(F.lit(1)).alias("n"))

    def counts(self) -> dict[str, int]:
        """Rows by stage; only after the results have been written."""
        return {stage: _counted(o) for stage, o in self.stages.items()}


def _counted(seen: Observation) -> int:
    """What was counted. Adaptive execution leaves out what comes after an empty shuffle; such a stage had no rows, and its observation has none to show."""
    try:
        return seen.get["n"]
    except Py4JJavaError as why:
        if why.java_exception.getClass().getSimpleName() != "AssertionError":
            raise
        return 0


def unseen(stage: str, rows: DataFrame) -> DataFrame:
    return rows


def polar_points(points: DataFrame, frames: DataFrame, c: PipelineConfig, see: See = unseen) -> DataFrame:
    finite = see("finite points", P.extract_xyz(see("points", points)))
    voxels = see("voxels", P.voxel_filter(P.tilt_compensate(finite, frames), c.voxel_filter))
    return see("polar points", P.polarize(voxels, c.polarize))


def grids(points: DataFrame, frames: DataFrame, c: PipelineConfig, see: See = unseen) -> DataFrame:
    """One row per frame and cell, for every frame of ``frames``."""
    return T.grid_of(polar_points(points, frames, c, see), frames, Grid.of(c.traversability))


def results(points: DataFrame, frames: DataFrame, c: PipelineConfig, see: See = unseen) -> DataFrame:
    """One row per frame, with dense arrays. ``see`` is shown the rows of each stage (``Seen`` counts them)."""
    return see("frames", packed(grids(points, frames, c, see), frames, Grid.of(c.traversability)))


def results_of_voxels(counted: DataFrame, frames: DataFrame, c: PipelineConfig) -> DataFrame:
    """As ``results``, from the points' counts by voxel (frame_id, ix, iy, iz, n)."""
    g = Grid.of(c.traversability)
    enough = counted.where(F.col("n") >= c.voxel_filter.min_points_per_voxel)
    polar = P.polarize(P.with_centres(enough, c.voxel_filter), c.polarize)
    return packed(T.grid_of(polar, frames, g), frames, g)


def stage_counts(points: DataFrame, frames: DataFrame, c: PipelineConfig) -> DataFrame:
    """Per frame: finite points, kept voxels, polar points. One pass over the points: all three are sums over voxel counts."""
    counted = P.voxel_count(P.tilt_compensate(P.extract_xyz(points), frames), c.voxel_filter)
    kept = F.col("n") >= c.voxel_filter.min_points_per_voxel
    rows = P.with_centres(counted, c.voxel_filter).groupBy("frame_id").agg(
        F.sum("n").alias("finite_count"), F.count_if(kept).alias("voxel_count"), F.count_if(kept & P.in_band(c.polarize)).alias("polar_count")
    )
    return frames.select("frame_id").join(rows, "frame_id", "left").na.fill(0)
