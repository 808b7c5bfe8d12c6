"""The registered queries of the grid engine, one per operator, and their SQL equivalents.

Queries run over whole tables. FLOAT results are compared as DOUBLE, double results are rounded to six places, and unknown
codes are null rather than NaN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark import config, storage
from gridlark.functions import packets, pose, streams
from gridlark.operators import points as P
from gridlark.operators import poses
from gridlark.operators import terrain as T
from gridlark.plans import oracle as O
from gridlark.plans import pipeline
from gridlark.sinks import files
from gridlark.sources import recorded, synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C, G = O.C, O.G


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def wide(*names: str) -> list[Column]:
    return [F.col(n).cast("double").alias(n) for n in names]


def rounded(*names: str) -> list[Column]:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def wide_sql(*names: str) -> str:
    return ", ".join(f"{n}::DOUBLE AS {n}" for n in names)


def rounded_sql(*names: str) -> str:
    return ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in names)


def cloud(spark, d):
    return synthetic.points(spark, d), synthetic.frames(spark, d)


def leveled(spark, d):
    points, frames = cloud(spark, d)
    return P.tilt_compensate(P.extract_xyz(points), frames)


def voxels(spark, d):
    return P.voxel_filter(leveled(spark, d), C.voxel_filter)


def polar(spark, d):
    return P.polarize(voxels(spark, d), C.polarize)


def ground(spark, d):
    return T.terrain(T.height_map(polar(spark, d), G), synthetic.frames(spark, d), G)


def measured(spark, d):
    return T.metrics_of(T.dense(T.height_map(polar(spark, d), G), synthetic.frames(spark, d), G), G)


def full_grid(spark, d):
    return T.grid_of(polar(spark, d), synthetic.frames(spark, d), G)


def known(name: str = "code") -> Column:
    """A code as DOUBLE, null where unknown."""
    return F.when(~F.isnan(name), F.col(name).cast("double")).alias(name)


# Sources


@query(O.chain("SELECT frame_id, count(*) AS points, count(DISTINCT pixel_id) AS pixels, sum(w)::DOUBLE AS sum_w FROM points GROUP BY frame_id"))
def scan_points(spark, d):
    return synthetic.points(spark, d).groupBy("frame_id").agg(F.count("*").alias("points"), F.count_distinct("pixel_id").alias("pixels"), F.sum("w").cast("double").alias("sum_w"))


@query(O.chain("SELECT frame_id, count(*) AS points, count(DISTINCT pixel_id) AS pixels, sum(w)::DOUBLE AS sum_w, count_if(isnan(x)) AS unseen FROM points GROUP BY frame_id"))
def recording_ranges(spark, d):
    """The cloud written as a recording, and read back in two ranges of frames that together are all of it."""
    points, frames = cloud(spark, d)
    path = storage.new_path(spark, "recording")
    recorded.write_recording(points, frames, path)
    least, middle, last = recorded.read_points(spark, f"{path}/points").agg(F.min("frame_id"), F.floor(F.avg("frame_id")), F.max("frame_id")).first()
    halves = [recorded.read_points(spark, f"{path}/points", r) for r in ((least, middle), (middle + 1, last))] if least is not None else [recorded.read_points(spark, f"{path}/points")]
    sums = [h.groupBy("frame_id").agg(F.count("*").alias("points"), F.count_distinct("pixel_id").alias("pixels"), F.sum("w").cast("double").alias("sum_w"), F.count_if(F.isnan("x")).alias("unseen")) for h in halves]
    return sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events) WHERE k % 3 = 2")
def frame_skip(spark, d):
    at = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.struct("ts", "event_id").alias("timestamp_ns"))
    return recorded.skip(at, 2, "timestamp_ns").select("event_id")


@query(O.chain(f"SELECT frame_id, timestamp_ns, {wide_sql('qx', 'qy', 'qz', 'qw')}, count(*) AS points FROM points JOIN frames USING (frame_id) GROUP BY ALL"))
def pose_join(spark, d):
    points, frames = cloud(spark, d)
    flat = frames.select("frame_id", "timestamp_ns", *[F.col(f"pose.{c}").cast("double").alias(f"q{c}") for c in "xyzw"])
    return points.groupBy("frame_id").agg(F.count("*").alias("points")).join(flat, "frame_id")


@query(O.chain("SELECT frame_id, timestamp_ns, make_timestamp(timestamp_ns // 1000) AS ts FROM frames"))
def frame_ts(spark, d):
    return recorded.event_time(synthetic.frames(spark, d)).select("frame_id", "timestamp_ns", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT * FROM (VALUES ('VGA', 672, 376), ('SVGA', 800, 600), ('HD720', 1280, 720), ('HD1080', 1920, 1080), ('HD2K', 2208, 1242), ('other', 1920, 1080)) t(resolution, w, h)")
def resolution_dims(spark, d):
    return spark.createDataFrame([(n, *config.resolution_dims(n)) for n in (*config.RESOLUTIONS, "other")], "resolution string, w int, h int")


# Poses


@query(O.chain(f"SELECT frame_id, {wide_sql('x', 'y', 'z', 'w')} FROM unit"))
def quat_normalize(spark, d):
    return pose.steps(synthetic.frames(spark, d)).select("frame_id", "unit.*").select("frame_id", *wide(*"xyzw"))


@query(O.chain(f"SELECT frame_id, {rounded_sql('yaw')} FROM yawed"))
def quat_yaw(spark, d):
    return pose.steps(synthetic.frames(spark, d)).select("frame_id", *rounded("yaw"))


@query(O.chain(f"SELECT frame_id, {rounded_sql('x', 'y', 'z', 'w')} FROM tilt"))
def quat_deyaw(spark, d):
    return pose.steps(synthetic.frames(spark, d)).select("frame_id", "tilt.*").select("frame_id", *rounded(*"xyzw"))


@query(O.chain(f"SELECT frame_id, {rounded_sql(*pose.MATRIX)} FROM matrix"))
def tilt_matrix(spark, d):
    return pose.tilt_matrices(synthetic.frames(spark, d)).select("frame_id", *rounded(*pose.MATRIX))


#: Neighbouring poses further apart than this aren't bridged in ``pose_asof``.
BRIDGE_NS = 130_000_000_000_000


@query(
    O.chain(
        f"""SELECT frame_id, timestamp_ns, {rounded_sql("x", "y", "z", "w")} FROM (
  SELECT frame_id, timestamp_ns, UNNEST(CASE
    WHEN t0 IS NULL THEN {O.quaternion("n")} WHEN t1 IS NULL OR t0 = timestamp_ns THEN {O.quaternion("p")}
    WHEN whole > {BRIDGE_NS} THEN CASE WHEN timestamp_ns - t0 <= t1 - timestamp_ns THEN {O.quaternion("p")} ELSE {O.quaternion("n")} END
    ELSE {{{", ".join(f"'{c}': (v{c} / sqrt(vx * vx + vy * vy + vz * vz + vw * vw))::FLOAT" for c in "xyzw")}}} END)
  FROM (SELECT *, {", ".join(f"u{c} * keep + s{c} * take AS v{c}" for c in "xyzw")} FROM shares))""",
        O.ASOF,
    )
)
def pose_asof(spark, d):
    """Events as moments of their own, between the frames' poses; every other pose has the opposite sign, which is the same turn."""
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("frame_id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"))
    sign = F.when(F.col("frame_id") % 2 == 1, -1.0).otherwise(1.0).cast("float")
    track = synthetic.frames(spark, d).select("timestamp_ns", F.struct(*[(F.col(f"pose.{c}") * sign).alias(c) for c in "xyzw"]).alias("pose"))
    return poses.poses_at(events, track, bridge_ns=BRIDGE_NS).select("frame_id", "timestamp_ns", "pose.*").select("frame_id", "timestamp_ns", *rounded(*"xyzw"))


# Points


@query(O.chain(f"SELECT frame_id, {wide_sql('x', 'y', 'z')} FROM finite"))
def extract_xyz(spark, d):
    return P.extract_xyz(synthetic.points(spark, d)).select("frame_id", *wide("x", "y", "z"))


@query(O.chain(f"SELECT frame_id, {wide_sql('x', 'y', 'z')} FROM level"))
def tilt_compensate(spark, d):
    return leveled(spark, d).select("frame_id", *wide("x", "y", "z"))


@query(O.chain("SELECT frame_id, ix, iy, iz FROM indexed"))
def voxel_index(spark, d):
    return P.voxel_index(leveled(spark, d), C.voxel_filter).select("frame_id", "ix", "iy", "iz")


@query(O.chain(f"SELECT frame_id, {O.KEY} AS key, ix, iy, iz FROM counted"))
def voxel_key(spark, d):
    keys = P.voxel_count(leveled(spark, d), C.voxel_filter).select("frame_id", P.voxel_key(F.col("ix"), F.col("iy"), F.col("iz")).alias("key"))
    return keys.select("frame_id", "key", *[c.alias(n) for n, c in P.voxel_of_key(F.col("key")).items()])


@query(O.chain("SELECT * FROM counted"))
def voxel_count(spark, d):
    return P.voxel_count(leveled(spark, d), C.voxel_filter)


@query(O.chain(f"SELECT frame_id, n, {wide_sql('x', 'y', 'z')} FROM voxels"))
def voxel_filter(spark, d):
    return voxels(spark, d).select("frame_id", "n", *wide("x", "y", "z"))


@query(O.chain(f"SELECT frame_id, ix, iy, iz, {O.KEY} AS key FROM voxels ORDER BY frame_id, iz, iy, ix"))
def voxel_sorted(spark, d):
    key = P.voxel_key(F.col("ix"), F.col("iy"), F.col("iz")).alias("key")
    return voxels(spark, d).select("frame_id", "ix", "iy", "iz", key).orderBy("frame_id", "key")


@query(O.chain("SELECT frame_id, pixel_id, (sum(f) OVER (PARTITION BY frame_id ORDER BY pixel_id, y, z ROWS UNBOUNDED PRECEDING) - f)::BIGINT AS slot FROM (SELECT *, (isfinite(x) AND isfinite(y) AND isfinite(z))::INTEGER AS f FROM points)"))
def compaction_offsets(spark, d):
    """The explicit form of stream compaction; the pipeline itself only filters."""
    points = synthetic.points(spark, d)
    finite = P.is_finite(F.col("x")) & P.is_finite(F.col("y")) & P.is_finite(F.col("z"))
    return streams.finite_before(points, finite, "pixel_id", "y", "z").select("frame_id", "pixel_id", "slot")


@query(O.chain(f"SELECT frame_id, {rounded_sql('r', 'theta', 'z')} FROM polar"))
def polarize(spark, d):
    return polar(spark, d).select("frame_id", *rounded("r", "theta", "z"))


# Grid


@query(O.chain(f"SELECT frame_id, i, j, {rounded_sql('r', 'theta')} FROM binned"))
def polar_bin(spark, d):
    return T.polar_bin(polar(spark, d), G).select("frame_id", "i", "j", *rounded("r", "theta"))


@query(f"""
WITH RECURSIVE r(k, x) AS (SELECT 0, {O.sql(G.r_min)} UNION ALL SELECT k + 1, x + {O.sql(G.dr)} FROM r WHERE x + {O.sql(G.dr)} < {O.sql(C.traversability.r_max_m)} + {O.sql(G.dr)}),
t(k, x) AS (SELECT 0, {O.sql(G.theta_min)} UNION ALL SELECT k + 1, x + {O.sql(G.dtheta)} FROM t WHERE x + {O.sql(G.dtheta)} < {O.sql(-G.theta_min)} + {O.sql(G.dtheta)})
SELECT (SELECT max(k) FROM r)::INTEGER AS r_bins, (SELECT max(k) FROM t)::INTEGER AS theta_bins""")
def bin_counts(spark, d):
    return spark.createDataFrame([(G.nr, G.nt)], "r_bins int, theta_bins int")


@query(
    f"SELECT 'r' AS axis, k::INTEGER AS k, ({O.sql(G.r_min)} + k::FLOAT * {O.sql(G.dr)})::DOUBLE AS edge FROM range({G.nr + 1}) t(k) "
    f"UNION ALL SELECT 'theta', k::INTEGER, ({O.sql(G.theta_min)} + k::FLOAT * {O.sql(G.dtheta)})::DOUBLE FROM range({G.nt + 1}) t(k)"
)
def grid_edges(spark, d):
    return spark.createDataFrame([(axis, k, e) for axis, es in zip(("r", "theta"), G.edges(), strict=True) for k, e in enumerate(es)], "axis string, k int, edge double")


@query(O.chain(f"SELECT i, j, {rounded_sql('r_c', 'theta_c', 'x_c', 'y_c')} FROM centres"))
def cell_centers(spark, d):
    return G.cells(spark).select("i", "j", *rounded("r_c", "theta_c", "x_c", "y_c"))


@query(O.chain(f"SELECT i, j, di, dj, ri, rj, {rounded_sql('dxy')} FROM near"))
def neighbor_table(spark, d):
    return G.neighbours(spark).select("i", "j", "di", "dj", "ri", "rj", *rounded("dxy"))


@query(O.chain(f"SELECT frame_id, i, j, {wide_sql('z_max')} FROM height"))
def height_map(spark, d):
    return T.height_map(polar(spark, d), G).select("frame_id", "i", "j", *wide("z_max"))


@query(O.chain(f"SELECT frame_id, i, j, {wide_sql('terrain')}, valid FROM terrain"))
def terrain_fill(spark, d):
    return ground(spark, d).select("frame_id", "i", "j", *wide("terrain"), "valid")


@query(O.chain(f"SELECT frame_id, i, j, {rounded_sql('dz_dr', 'dz_dtheta')} FROM gradient"))
def gradient(spark, d):
    return T.gradient(ground(spark, d), G).select("frame_id", "i", "j", *rounded("dz_dr", "dz_dtheta"))


@query(O.chain(f"SELECT frame_id, i, j, {rounded_sql('slope')} FROM slope"))
def slope(spark, d):
    return measured(spark, d).select("frame_id", "i", "j", *rounded("slope"))


@query(O.chain(f"SELECT frame_id, i, j, {rounded_sql('roughness')} FROM roughness"))
def roughness(spark, d):
    return measured(spark, d).select("frame_id", "i", "j", *rounded("roughness"))


@query(O.chain(f"SELECT frame_id, i, j, {rounded_sql('step_height')} FROM step"))
def step_height(spark, d):
    return measured(spark, d).select("frame_id", "i", "j", *rounded("step_height"))


@query(O.chain(f"SELECT frame_id, i, j, {rounded_sql('danger')} FROM risk"))
def danger(spark, d):
    return T.danger(measured(spark, d), G).select("frame_id", "i", "j", *rounded("danger"))


@query(O.chain("SELECT frame_id, i, j, nontraversable FROM blocked"))
def nontraversable(spark, d):
    return T.danger(measured(spark, d), G).select("frame_id", "i", "j", "nontraversable")


@query(O.chain("SELECT frame_id, j, min(i) AS closest FROM blocked WHERE nontraversable GROUP BY ALL"))
def first_obstacle(spark, d):
    return T.first_obstacle(T.danger(measured(spark, d), G))


@query(O.chain("SELECT frame_id, i, j, observed FROM seen"))
def ray_cast(spark, d):
    return T.ray_cast(T.danger(measured(spark, d), G)).select("frame_id", "i", "j", "observed")


@query(O.chain(f"SELECT frame_id, i, j, {wide_sql('terrain')}, valid, code FROM coded"))
def trav_grid(spark, d):
    return full_grid(spark, d).select("frame_id", "i", "j", *wide("terrain"), "valid", known())


# Presentation and packets


COLOUR_SQL = "CASE WHEN code IS NULL THEN {} WHEN code <= 0.5 THEN {} ELSE {} END"


@query(O.chain("SELECT frame_id, i, j, " + ", ".join(COLOUR_SQL.format(*v) + f" AS {n}" for n, v in (("class", ("'unknown'", "'free'", "'blocked'")), ("red", (128, 0, 220)), ("green", (128, 200, 0)), ("blue", (128, 0, 0)))) + " FROM coded"))
def colorize(spark, d):
    return T.colorize(full_grid(spark, d))


@query(O.chain(f"SELECT frame_id, {G.nr - 1} - i AS row, {G.nt - 1} - j AS col, code FROM coded"))
def grid_mirror(spark, d):
    return T.mirrored(full_grid(spark, d), G).select("frame_id", "row", "col", known())


@query(O.chain(f"SELECT frame_id, (({G.nr - 1} - i) * 8 + y)::INTEGER AS row, (({G.nt - 1} - j) * 8 + x)::INTEGER AS col, code FROM coded, range(8) a(y), range(8) b(x)"))
def grid_upscale(spark, d):
    return T.upscaled(T.mirrored(full_grid(spark, d), G).select("frame_id", "row", "col", known()))


@query(O.chain("SELECT frame_id, i, string_agg(CASE WHEN code IS NULL THEN 'nan' WHEN code > 0.5 THEN '1' ELSE '0' END, ',' ORDER BY j) AS line FROM coded GROUP BY ALL"))
def csv_rows(spark, d):
    return files.csv_rows(full_grid(spark, d))


def packed_results(spark, d):
    return packets.packed(full_grid(spark, d), synthetic.frames(spark, d), G)


@query(O.chain("SELECT frame_id, timestamp_ns, variant, variant IN ('good', 'empty') AS ok FROM frames, (VALUES ('good'), ('short grid'), ('short heights'), ('edges'), ('bins'), ('negative'), ('too large'), ('empty')) v(variant)"))
def layout_check(spark, d):
    """Every result as it is and damaged in several ways."""
    r = packed_results(spark, d)
    none = F.array().cast("array<float>")

    def filled(n: int) -> Column:
        return F.array_repeat(F.lit(0.0).cast("float"), n)

    large = {"trav_grid": filled(10_000), "height_map": filled(10_000), "r_edges": filled(101), "theta_edges": filled(101), "r_bins": F.lit(100), "theta_bins": F.lit(100)}
    variants = {
        "good": {},
        "short grid": {"trav_grid": F.slice("trav_grid", 1, G.nr * G.nt - 1)},
        "short heights": {"height_map": F.slice("height_map", 2, G.nr * G.nt - 1)},
        "edges": {"theta_edges": F.concat("theta_edges", filled(1))},
        "bins": {"r_bins": F.lit(G.nt), "theta_bins": F.lit(G.nr)},
        "negative": {"r_bins": F.lit(-1), "theta_bins": F.lit(-1), "trav_grid": filled(1), "height_map": filled(1), "r_edges": none, "theta_edges": none},
        "too large": large,
        "empty": {"trav_grid": none, "height_map": none, "r_edges": filled(1), "theta_edges": filled(1), "r_bins": F.lit(0), "theta_bins": F.lit(0)},
    }
    rows = [F.struct(F.lit(v).alias("variant"), *[new.get(c, F.col(c)).alias(c) for c in large]) for v, new in variants.items()]
    return r.select("frame_id", "timestamp_ns", F.inline(F.array(*rows))).select("frame_id", "timestamp_ns", "variant", packets.layout_ok().alias("ok"))


@query("SELECT nr, nt, 24 + 8 * nr * nt + 4 * (nr + 1) + 4 * (nt + 1) AS bytes FROM (SELECT p_partkey % 40 AS nr, p_size::BIGINT AS nt FROM part)")
def packet_size(spark, d):
    sizes = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 40).alias("nr"), F.col("p_size").cast("long").alias("nt"))
    return sizes.select("nr", "nt", packets.packet_size(F.col("nr"), F.col("nt")).alias("bytes"))


@query(O.chain(f"SELECT frame_id, i, j, code, {wide_sql('terrain')} FROM coded"))
def packet_roundtrip(spark, d):
    """Encoded as datagrams, decoded again, one row per cell."""
    sent = packets.encoded(packets.with_sequence(packed_results(spark, d))).select("frame_id", "payload")
    got = packets.decoded(sent).select("frame_id", F.col("nt").cast("int").alias("theta_bins"), "trav_grid", "height_map")
    return packets.unpacked(got).select("frame_id", "i", "j", known(), *wide("terrain"))


def packet_stream(spark, d, floats: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Packets of small grids, one per event. Some are cut short, mislabelled or of a wrong length, some claim enormous grids, and some
    have time stamps that only unsigned numbers hold. floats: the bits of each float by packet and position; otherwise all are zero."""
    events = spark.read.parquet(f"{d}/events.parquet")

    def number(c, n: int) -> Column:
        return F.unhex(packets.swapped(F.lpad(F.hex(c), 2 * n, "0"), n))

    def zeros(n: Column) -> Column:
        return F.unhex(F.repeat(F.lit("00"), n))

    k = F.col("event_id")
    stamp = F.when(k % 19 == 4, F.lit(-1).cast("long") - k).otherwise(F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    nr, nt = k % 4, k % 3
    huge = k % 23 == 6
    claimed = [F.when(huge, F.lit(4294967295)).otherwise(n) for n in (nr, nt)]
    count = 2 * nr * nt + nr + nt + 2
    body = zeros((4 * count).cast("int"))
    if floats:
        bits = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda at: packets.swapped(F.lpad(F.hex(floats(k, at)), 8, "0"), 4))
        body = F.unhex(F.array_join(bits, ""))
    whole = F.concat(number(F.lit(packets.MAGIC).cast("long"), 4), number(k, 4), number(stamp, 8), *(number(n.cast("long"), 4) for n in claimed), body)
    broken = F.when(k % 11 == 3, F.substring(whole, 1, 23)).when(k % 13 == 5, F.substring(whole, 1, 30)).when(k % 17 == 2, F.concat(F.unhex(F.lit("00")), F.substring(whole, 2, 1000))).when(k % 29 == 7, F.unhex(F.lit("")))
    # out of a generator a payload is a plain column, as a received one would be; as an expression it would be repeated wherever bytes are read from it
    return events.select(k.alias("arrival"), F.col("user_id").alias("sender"), F.inline(F.array(F.struct(F.coalesce(broken, whole).alias("payload")))))


#: Which packets of ``packet_stream`` are well-formed, in SQL.
WELL_FORMED = "event_id % 11 <> 3 AND event_id % 13 <> 5 AND event_id % 17 <> 2 AND event_id % 23 <> 6 AND event_id % 29 <> 7"


@query(
    "SELECT event_id AS arrival, event_id AS seq, CASE WHEN event_id % 19 = 4 THEN (18446744073709551615 - event_id)::VARCHAR ELSE (epoch_us(ts) * 1000)::VARCHAR END AS timestamp_ns, "
    f"event_id % 4 AS nr, event_id % 3 AS nt FROM events WHERE {WELL_FORMED}"
)
def packet_decode(spark, d):
    """The time stamp as text: both engines show all 64 unsigned bits of it alike."""
    return packets.headers(packet_stream(spark, d)).select("arrival", "seq", F.col("timestamp_ns").cast("string").alias("timestamp_ns"), "nr", "nt")


#: Bits of zeros, infinities, the least and greatest numbers below the normal ones, a NaN and one, which turn up among others.
SPECIAL = (0, 1 << 31, 0x7F800000, 0xFF800000, 1, 0x807FFFFF, 0x7FC00000, 0x3F800000)
MIXED = "(event_id % 1048576 * 2654435761 + place * 668265263) % 4294967296"


@query(
    f"""WITH sent AS (SELECT event_id, unnest(range(2 * (event_id % 4) * (event_id % 3) + event_id % 4 + event_id % 3 + 2)) AS place FROM events WHERE {WELL_FORMED}),
bits AS (SELECT event_id, place, CASE WHEN (event_id + place) % 7 = 0 THEN {list(SPECIAL)}[event_id // 7 % {len(SPECIAL)} + 1] ELSE {MIXED} END::BIGINT AS b FROM sent),
parts AS (SELECT event_id, place, b >> 31 AS s, (b >> 23) & 255 AS e, b & 8388607 AS m FROM bits)
SELECT event_id AS arrival, place::INTEGER AS place, CASE s WHEN 1 THEN -1.0 ELSE 1.0 END::DOUBLE *
  CASE WHEN e < 255 THEN (m + CASE WHEN e > 0 THEN 8388608 ELSE 0 END) * pow(2.0::DOUBLE, greatest(e, 1) - 150) WHEN m = 0 THEN 'Infinity'::DOUBLE END AS value FROM parts"""
)
def packet_values(spark, d):
    """All floats of packets with any bits there are, put together again by arithmetic in SQL; null where they are no number."""

    def bits(event: Column, at: Column) -> Column:
        special = F.get(F.array(*[F.lit(b).cast("long") for b in SPECIAL]), F.floor(event / 7) % len(SPECIAL))
        mixed = (event % 1048576 * F.lit(2654435761).cast("long") + at * F.lit(668265263).cast("long")) % F.lit(4294967296).cast("long")
        return F.when((event + at) % 7 == 0, special).otherwise(mixed)

    got = packets.decoded(packet_stream(spark, d, bits))
    values = got.select("arrival", F.posexplode(F.concat("trav_grid", "height_map", "r_edges", "theta_edges")).alias("place", "value"))
    return values.select("arrival", "place", known("value"))


# Measures


@query(
    O.chain(
        "SELECT frame_id, (SELECT count(*) FROM finite x WHERE x.frame_id = f.frame_id) AS finite_count, (SELECT count(*) FROM voxels x WHERE x.frame_id = f.frame_id) AS voxel_count, "
        "(SELECT count(*) FROM polar x WHERE x.frame_id = f.frame_id) AS polar_count FROM frames f"
    )
)
def stage_counts(spark, d):
    return pipeline.stage_counts(*cloud(spark, d), C)


@query(
    "SELECT count(*) AS frames_captured, sum((event_id % 5 <> 0)::INTEGER)::BIGINT AS frames_processed, round(e, 6) AS elapsed_s, round(count(*) / e, 6) AS source_fps, "
    "round(sum((event_id % 5 <> 0)::INTEGER) / e, 6) AS pipeline_fps FROM events, (SELECT (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS e FROM events) GROUP BY e"
)
def fps_metrics(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"), F.lit(1).alias("captured"), (F.col("event_id") % 5 != 0).cast("int").alias("processed"))
    return streams.fps(events).select("frames_captured", "frames_processed", *rounded("elapsed_s", "source_fps", "pipeline_fps"))


@query("SELECT event_id // 16 AS batch, max(event_id) AS newest, count(*) - 1 AS dropped FROM events GROUP BY 1")
def conflate_drops(spark, d):
    """Micro-batches of sixteen publications: the newest survives."""
    events = spark.read.parquet(f"{d}/events.parquet").select(F.expr("event_id div 16").alias("batch"), "event_id", F.struct("ts", "event_id").alias("timestamp_ns"))
    return streams.conflate(events).select("batch", F.col("newest.event_id").alias("newest"), "dropped")


@query(
    "SELECT user_id AS sender, count(*) AS packets, (coalesce(sum(((event_id - before - 1) % 4294967296 + 4294967296) % 4294967296), 0) % 4294967296)::BIGINT AS lost "
    "FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1"
)
def seq_gaps(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("sender"), F.struct("ts", "event_id").alias("arrival"), F.col("event_id").alias("seq"))
    return streams.seq_gaps(events)


@query("SELECT date_trunc('second', ts) AS second, count(*) AS fps FROM events GROUP BY 1")
def viewer_fps(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"))
    return streams.viewer_fps(events).select(F.col("second").cast("timestamp_ntz").alias("second"), "fps")


@query(
    """WITH RECURSIVE shown AS (SELECT epoch_us(ts) * 1000 AS t FROM events),
moments AS MATERIALIZED (SELECT t, min(k) AS n FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k FROM shown) GROUP BY t),
jumps AS MATERIALIZED (SELECT a.t, b.t AS next, a.n AS n, b.n AS n_next FROM moments a ASOF JOIN moments b ON a.t + 1000000000 <= b.t),
windows AS (
  SELECT * FROM jumps WHERE n = 0
  UNION ALL SELECT j.* FROM windows w JOIN jumps j ON j.t = w.next)
SELECT t AS start_ns, next AS end_ns, n_next - n + (n = 0)::INTEGER AS frames, round((n_next - n + (n = 0)::INTEGER) / ((next - t) / 1e9), 6) AS fps FROM windows"""
)
def viewer_rate(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"))
    return streams.rate_windows(events).select("start_ns", "end_ns", "frames", *rounded("fps"))
