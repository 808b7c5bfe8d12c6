"""The polar grid's fixed geometry: extents in float32, and cells and neighbours as small DataFrames.

Its size is set by the configuration alone. The pipeline broadcasts one row for each row and column of it, not for each cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridlark.config import GridConfig

F32 = np.float32
PI = F32(3.14159265358979323846)
#: Half-widths of the roughness and step-height windows, and neighbours that a step height is scaled by.
ROUGH_HALF, STEP_HALF = 1, 2
STEP_NEIGHBOURS = (2 * STEP_HALF + 1) ** 2 - 1


def radians(degrees: float) -> np.float32:
    return F32(degrees) * PI / F32(180)


def count_bins(start: np.float32, stop: np.float32, step: np.float32) -> int:
    """Bins between the edges start, start + step, ... below stop + step, added up in float32."""
    edges, x, end = 0, start, F32(stop + step)
    while x < end:
        edges += 1
        x = F32(x + step)
    return max(edges - 1, 0)


def reflected(index: int, size: int) -> int:
    """Index into an axis whose ends are mirrored with the edge repeated."""
    if size <= 1:
        return 0
    if index < 0:
        return -index - 1
    return 2 * size - index - 1 if index >= size else index


@dataclass(frozen=True)
class Grid:
    r_min: np.float32
    theta_min: np.float32
    dr: np.float32
    dtheta: np.float32
    nr: int
    nt: int
    slope_limit: np.float32
    rough_limit: np.float32
    step_limit: np.float32
    danger_limit: np.float32

    @classmethod
    def of(cls, c: GridConfig) -> Grid:
        c.validate()
        r_min, dr, t_min, dt = F32(c.r_min_m), F32(c.polar_grid_size_r_m), radians(c.theta_min_deg), radians(c.polar_grid_size_theta_deg)
        return cls(
            r_min, t_min, dr, dt,
            count_bins(r_min, F32(c.r_max_m), dr), count_bins(t_min, radians(c.theta_max_deg), dt),
            radians(c.scrit_deg), F32(c.rcrit_m), F32(c.hcrit_m), F32(c.danger_threshold),
        )

    def edges(self) -> tuple[list[float], list[float]]:
        """Bin edges of both axes, each start + k * step in float32."""
        r = [float(self.r_min + F32(k) * self.dr) for k in range(self.nr + 1)]
        return r, [float(self.theta_min + F32(k) * self.dtheta) for k in range(self.nt + 1)]

    def centre(self, i: int, j: int) -> tuple[np.float32, np.float32, float, float]:
        """Range and bearing of a cell's centre in float32, and its plane coordinates in double precision."""
        r = self.r_min + (F32(i) + F32(0.5)) * self.dr
        t = self.theta_min + (F32(j) + F32(0.5)) * self.dtheta
        return r, t, float(r) * float(F32(np.cos(np.float64(t)))), float(r) * float(F32(np.sin(np.float64(t))))

    def cells(self, spark: SparkSession) -> DataFrame:
        """i, j and the cell's centre."""
        rows = [(i, j, *map(float, self.centre(i, j))) for i in range(self.nr) for j in range(self.nt)]
        return spark.createDataFrame(rows, "i int, j int, r_c float, theta_c float, x_c double, y_c double")

    def neighbours(self, spark: SparkSession) -> DataFrame:
        """(i, j) -> (ri, rj) for every offset (di, dj) of the step window, mirrored at the ends.

        A mirrored cell stands once for every offset that leads to it. ``dxy`` is the distance between the centres.
        """
        at = {(i, j): self.centre(i, j)[2:] for i in range(self.nr) for j in range(self.nt)}
        reach = range(-STEP_HALF, STEP_HALF + 1)
        rows = []
        for i, j in at:
            for di in reach:
                for dj in reach:
                    n = reflected(i + di, self.nr), reflected(j + dj, self.nt)
                    (x, y), (u, v) = at[i, j], at[n]
                    rows.append((i, j, di, dj, *n, float(np.sqrt((x - u) ** 2 + (y - v) ** 2))))
        return spark.createDataFrame(rows, "i int, j int, di int, dj int, ri int, rj int, dxy double")

    def ranges(self, spark: SparkSession) -> DataFrame:
        """i, r_c (the range of its cells' centres) and r: for each offset of the step window, row by row, that of the cell it leads to, mirrored at the ends."""
        at = [float(self.centre(i, 0)[0]) for i in range(self.nr)]
        reach = range(-STEP_HALF, STEP_HALF + 1)
        return spark.createDataFrame([(i, at[i], [at[reflected(i + di, self.nr)] for di in reach for _ in reach]) for i in range(self.nr)], "i int, r_c float, r array<double>")

    def bearings(self, spark: SparkSession) -> DataFrame:
        """j and, of single precision, c and s: for each offset of the step window, row by row, cosine and sine of the bearing of the cell it leads to."""
        angles = [self.centre(0, j)[1] for j in range(self.nt)]
        c, s = ([float(F32(f(np.float64(t)))) for t in angles] for f in (np.cos, np.sin))
        reach = range(-STEP_HALF, STEP_HALF + 1)
        rows = [(j, *([x[reflected(j + dj, self.nt)] for _ in reach for dj in reach] for x in (c, s))) for j in range(self.nt)]
        return spark.createDataFrame(rows, "j int, c array<double>, s array<double>")
