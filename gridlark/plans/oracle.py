"""The grid pipeline as DuckDB SQL: a chain of common table expressions from which each query selects."""

from __future__ import annotations

from gridlark.config import PipelineConfig
from gridlark.functions.floats import sql
from gridlark.functions.pose import NORM_LEAST
from gridlark.grid import F32, STEP_NEIGHBOURS, Grid
from gridlark.operators.points import KEY_BITS, KEY_OFFSET
from gridlark.operators.poses import NEARLY_ONE
from gridlark.operators.terrain import EMPTY_HEIGHT, WEIGHTS
from gridlark.sources.synthetic import FRAMES_SQL, POINTS_SQL

C = PipelineConfig()
G = Grid.of(C.traversability)
V, P = C.voxel_filter, C.polarize


def dbl(x) -> str:
    return f"{float(x)!r}::DOUBLE"


POSE = f"""
normed AS (
  SELECT *, sqrt(qx * qx + qy * qy + qz * qz + qw * qw)::FLOAT AS norm FROM frames),
unit AS (
  SELECT frame_id, timestamp_ns, {", ".join(f"CASE WHEN norm > {sql(NORM_LEAST)} THEN (q{a} / norm)::FLOAT ELSE q{a} END AS {a}" for a in "xyzw")} FROM normed),
yawed AS (
  SELECT *, atan2(2::FLOAT * (w * z + x * y), 1::FLOAT - 2::FLOAT * (y * y + z * z))::FLOAT AS yaw FROM unit),
halved AS (SELECT *, sin(yaw * {sql(0.5)})::FLOAT AS s, cos(yaw * {sql(0.5)})::FLOAT AS c FROM yawed),
tilt AS (
  SELECT frame_id, x * c - y * s AS x, x * s + y * c AS y, z * c - w * s AS z, w * c + z * s AS w FROM halved),
matrix AS (
  SELECT frame_id,
    1::FLOAT - 2::FLOAT * (y * y + z * z) AS r00, 2::FLOAT * (x * y - w * z) AS r01, 2::FLOAT * (x * z + w * y) AS r02,
    2::FLOAT * (x * y + w * z) AS r10, 1::FLOAT - 2::FLOAT * (x * x + z * z) AS r11, 2::FLOAT * (y * z - w * x) AS r12,
    2::FLOAT * (x * z - w * y) AS r20, 2::FLOAT * (y * z + w * x) AS r21, 1::FLOAT - 2::FLOAT * (x * x + y * y) AS r22
  FROM tilt)"""

CLOUD = f"""
finite AS (SELECT frame_id, pixel_id, x, y, z FROM points WHERE isfinite(x) AND isfinite(y) AND isfinite(z)),
level AS (
  SELECT frame_id, pixel_id, r00 * x + r01 * y + r02 * z AS x, r10 * x + r11 * y + r12 * z AS y, r20 * x + r21 * y + r22 * z AS z
  FROM finite JOIN matrix USING (frame_id)),
indexed AS (
  SELECT *, {", ".join(f"floor(({a} / {sql(getattr(V, 'voxel_size_' + a))})::FLOAT)::BIGINT AS i{a}" for a in "xyz")} FROM level),
counted AS (SELECT frame_id, ix, iy, iz, count(*) AS n FROM indexed GROUP BY ALL),
voxels AS (
  SELECT frame_id, ix, iy, iz, n, {", ".join(f"(i{a}::FLOAT + {sql(0.5)}) * {sql(getattr(V, 'voxel_size_' + a))} AS {a}" for a in "xyz")}
  FROM counted WHERE n >= {V.min_points_per_voxel}),
ranged AS (SELECT *, sqrt(x * x + y * y)::FLOAT AS r FROM voxels),
polar AS (
  SELECT frame_id, r, atan2(y, x)::FLOAT AS theta, z FROM ranged WHERE abs(z) < {sql(P.z_threshold)} AND r > {sql(P.min_range)}),
binned AS (
  SELECT *, floor((r - {sql(G.r_min)}) * {sql(F32(1) / G.dr)})::BIGINT AS i, floor((theta - ({sql(G.theta_min)})) * {sql(F32(1) / G.dtheta)})::BIGINT AS j
  FROM polar),
height AS (
  SELECT frame_id, i::INTEGER AS i, j::INTEGER AS j, max(z) AS z_max FROM binned
  WHERE i BETWEEN 0 AND {G.nr - 1} AND j BETWEEN 0 AND {G.nt - 1} GROUP BY ALL)"""

GRID = f"""
cells AS (
  SELECT i::INTEGER AS i, j::INTEGER AS j, {sql(G.r_min)} + (i::FLOAT + {sql(0.5)}) * {sql(G.dr)} AS r_c,
         {sql(G.theta_min)} + (j::FLOAT + {sql(0.5)}) * {sql(G.dtheta)} AS theta_c
  FROM range({G.nr}) a(i), range({G.nt}) b(j)),
centres AS (SELECT *, r_c::DOUBLE * cos(theta_c)::FLOAT::DOUBLE AS x_c, r_c::DOUBLE * sin(theta_c)::FLOAT::DOUBLE AS y_c FROM cells),
offsets AS (SELECT di::INTEGER AS di, dj::INTEGER AS dj FROM range(-2, 3) a(di), range(-2, 3) b(dj)),
turned AS (
  SELECT i, j, di, dj,
    CASE WHEN i + di < 0 THEN -(i + di) - 1 WHEN i + di >= {G.nr} THEN {2 * G.nr - 1} - (i + di) ELSE i + di END AS ri,
    CASE WHEN j + dj < 0 THEN -(j + dj) - 1 WHEN j + dj >= {G.nt} THEN {2 * G.nt - 1} - (j + dj) ELSE j + dj END AS rj
  FROM cells, offsets),
near AS (
  SELECT t.*, sqrt((a.x_c - b.x_c) ** 2 + (a.y_c - b.y_c) ** 2) AS dxy
  FROM turned t JOIN centres a USING (i, j) JOIN centres b ON b.i = t.ri AND b.j = t.rj),
terrain AS (
  SELECT f.frame_id, c.i, c.j, h.z_max, coalesce(h.z_max, {sql(EMPTY_HEIGHT)}) AS terrain, h.z_max IS NOT NULL AS valid
  FROM frames f CROSS JOIN cells c LEFT JOIN height h ON h.frame_id = f.frame_id AND h.i = c.i AND h.j = c.j),
gradient AS (
  SELECT frame_id, i, j,
    (coalesce(lead(terrain) OVER a, terrain) - coalesce(lag(terrain) OVER a, terrain))::DOUBLE
      / CASE WHEN i IN (0, {G.nr - 1}) THEN {dbl(G.dr)} ELSE {dbl(F32(2) * G.dr)} END AS dz_dr,
    (coalesce(lead(terrain) OVER b, terrain) - coalesce(lag(terrain) OVER b, terrain))::DOUBLE
      / CASE WHEN j IN (0, {G.nt - 1}) THEN {dbl(G.dtheta)} ELSE {dbl(F32(2) * G.dtheta)} END AS dz_dtheta
  FROM terrain WINDOW a AS (PARTITION BY frame_id, j ORDER BY i), b AS (PARTITION BY frame_id, i ORDER BY j)),
sloped AS (
  SELECT g.frame_id, g.i, g.j, atan(sqrt(dz_dr * dz_dr + (dz_dtheta / r_c::DOUBLE) * (dz_dtheta / r_c::DOUBLE))) AS v
  FROM gradient g JOIN cells c USING (i, j)),
slope AS (SELECT frame_id, i, j, CASE WHEN v > {dbl(G.slope_limit)} THEN 'Infinity'::DOUBLE ELSE v END AS slope FROM sloped),
around AS (
  SELECT t.frame_id, t.i, t.j, t.terrain, n.di, n.dj, n.dxy, o.terrain AS z_n, abs(t.terrain - o.terrain) AS dz
  FROM terrain t JOIN near n USING (i, j) JOIN terrain o ON o.frame_id = t.frame_id AND o.i = n.ri AND o.j = n.rj),
spread AS (
  SELECT frame_id, i, j, sqrt(greatest(0, sum(z_n::DOUBLE * z_n::DOUBLE) / 9 - (sum(z_n::DOUBLE) / 9) ** 2)) AS v
  FROM around WHERE abs(di) <= 1 AND abs(dj) <= 1 GROUP BY ALL),
roughness AS (SELECT frame_id, i, j, CASE WHEN v > {dbl(G.rough_limit)} THEN 'Infinity'::DOUBLE ELSE v END AS roughness FROM spread),
climbs AS (
  SELECT frame_id, i, j, coalesce(max(dz) FILTER (p), 0)::DOUBLE AS h, count(*) FILTER (p) AS c
  FROM (SELECT *, dxy > 0 AND dz > {sql(G.step_limit)} AND atan2(dz::DOUBLE, dxy) > {dbl(G.slope_limit)} AS p FROM around) GROUP BY ALL),
step AS (
  SELECT frame_id, i, j, CASE WHEN least(h, h * c / {STEP_NEIGHBOURS}) > {dbl(G.step_limit)} THEN 'Infinity'::DOUBLE
    ELSE least(h, h * c / {STEP_NEIGHBOURS}) END AS step_height FROM climbs),
risk AS (
  SELECT t.*, slope, roughness, step_height,
    {dbl(WEIGHTS[0])} * slope / {dbl(G.slope_limit)} + {dbl(WEIGHTS[1])} * roughness / {dbl(G.rough_limit)} + {dbl(WEIGHTS[2])} * step_height / {dbl(G.step_limit)} AS danger
  FROM terrain t JOIN slope USING (frame_id, i, j) JOIN roughness USING (frame_id, i, j) JOIN step USING (frame_id, i, j)),
blocked AS (SELECT *, valid AND danger > {dbl(G.danger_limit)} AS nontraversable FROM risk),
seen AS (
  SELECT *, coalesce(i < min(i) FILTER (nontraversable) OVER (PARTITION BY frame_id, j), false) AS observed FROM blocked),
coded AS (SELECT *, CASE WHEN nontraversable THEN 1::DOUBLE WHEN observed THEN 0::DOUBLE END AS code FROM seen)"""


def quaternion(end: str) -> str:
    """A recorded pose of ``ASOF`` as it is."""
    return "{" + ", ".join(f"'{c}': {end}{c}" for c in "xyzw") + "}"


def _length(end: str) -> str:
    return f"sqrt({' + '.join(f'{end}{c}::DOUBLE * {end}{c}::DOUBLE' for c in 'xyzw')})"


#: Every event between the recorded poses before (t0, p) and after it (t1, n), as unit quaternions u and s, and how much of each it takes.
ASOF = f"""
track AS (
  SELECT t, UNNEST(q) FROM (
    SELECT timestamp_ns AS t, max({{{", ".join(f"'{c}': (CASE frame_id % 2 WHEN 1 THEN -1 ELSE 1 END * q{c})::FLOAT" for c in "xyzw")}}}) AS q FROM frames GROUP BY 1)),
moments AS (SELECT event_id AS frame_id, epoch_us(ts) * 1000 AS timestamp_ns FROM events),
ends AS (
  SELECT m.*, p.t AS t0, n.t AS t1, {", ".join(f"{e}.{c} AS {k}{c}" for e, k in (("p", "p"), ("n", "n")) for c in "xyzw")}
  FROM moments m ASOF LEFT JOIN track p ON m.timestamp_ns >= p.t ASOF LEFT JOIN track n ON m.timestamp_ns < n.t),
units AS (
  SELECT *, t1 - t0 AS whole, {", ".join(f"{e}{c} / {_length(e)} AS {u}{c}" for e, u in (("p", "u"), ("n", "s")) for c in "xyzw")} FROM ends),
angles AS (
  SELECT *, (timestamp_ns - t0) / whole::DOUBLE AS part, ux * sx + uy * sy + uz * sz + uw * sw AS d FROM units),
shares AS (
  SELECT *, CASE WHEN abs(d) > {NEARLY_ONE} THEN 1 - part ELSE sin((1 - part) * acos(least(abs(d), 1))) END AS keep,
    CASE WHEN d < 0 THEN -1 ELSE 1 END * CASE WHEN abs(d) > {NEARLY_ONE} THEN part ELSE sin(part * acos(least(abs(d), 1))) END AS take
  FROM angles)"""


def chain(select: str, *more: str) -> str:
    """The text of a query on any of the tables above."""
    return "WITH " + ",".join((POINTS_SQL, FRAMES_SQL, POSE, CLOUD, GRID, *more)) + "\n" + select


KEY = f"(((iz + {KEY_OFFSET}) << {2 * KEY_BITS}) | ((iy + {KEY_OFFSET}) << {KEY_BITS}) | (ix + {KEY_OFFSET}))"
