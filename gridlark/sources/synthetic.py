"""A deterministic point cloud from the order-line table, in integers, so that SQL engines agree on it.

Frames follow each other in the order key, so many keys to a frame: their number grows with the table. Every order line gives eight
points; some coordinates are NaN or infinite. Poses are small unnormalised tilts with a yaw; time stamps are those of the first event
of as many events a frame, and the packet stream comes from the event table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_PER_LINE = 8
ORDERS_PER_FRAME, EVENTS_PER_FRAME = 750, 500


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, pixel_id, x, y, z, w."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    cores = spark.sparkContext.defaultParallelism
    if lines.rdd.getNumPartitions() < cores:  # a file of a single row group is a single task; larger tables aren't moved
        lines = lines.repartition(cores, "l_orderkey", "l_linenumber")
    rows = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(POINTS_PER_LINE - 1))).alias("k"))
    return rows.selectExpr(
        f"l_orderkey div {ORDERS_PER_FRAME} as frame_id",
        "l_orderkey * 64 + l_linenumber * 8 + k as pixel_id",
        "l_orderkey % 97 as nan_when_0",
        "l_orderkey % 89 as inf_when_0",
        "100 + (l_orderkey * 7919 + l_partkey * 104729 + k * 15485863) % 2100 as x_mm",
        "(l_suppkey * 32452843 + l_partkey * 49979687 + l_orderkey * 86028121 + k * 67867967) % 4000 - 2000 as y_mm",
        "(l_partkey * 31 + l_orderkey * 17 + k * 7) % 20 as jit",
    ).selectExpr(
        "frame_id",
        "pixel_id",
        # Out of a generator the coordinates are plain columns, as they would be in a stored cloud. As expressions they would be repeated in every
        # later one, until the generated code is too large to be compiled.
        "inline(array(named_struct("
        "'x', case when nan_when_0 = 0 then float('NaN') else cast(cast(x_mm as float) / cast(1000 as float) as float) end, "
        "'y', cast(cast(y_mm as float) / cast(1000 as float) as float), "
        "'z', case when inf_when_0 = 0 then float('Infinity') else cast(cast(case when ((x_mm div 300) * 3 + ((y_mm + 2000) div 250) * 5 + frame_id) % 7 = 0 "
        "then 60 + jit else -299 + jit end as float) / cast(1000 as float) as float) end, "
        "'w', cast(jit as float))))",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, timestamp_ns, pose."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(f"event_id div {EVENTS_PER_FRAME} as frame_id", "unix_micros(cast(ts as timestamp)) * 1000 as timestamp_ns")
    return events.groupBy("frame_id").agg(F.min("timestamp_ns").alias("timestamp_ns")).selectExpr(
        "frame_id",
        "timestamp_ns",
        "named_struct('x', cast(cast((frame_id * 3) % 7 - 3 as float) / cast(100 as float) as float), "
        "'y', cast(cast((frame_id * 5) % 7 - 3 as float) / cast(100 as float) as float), "
        "'z', cast(cast((frame_id * 2) % 5 as float) / cast(10 as float) as float), 'w', cast(1 as float)) as pose",
    )


#: The same in DuckDB's SQL.
POINTS_SQL = f"""
raw_mm AS (
  SELECT l_orderkey // {ORDERS_PER_FRAME} AS frame_id, l_orderkey * 64 + l_linenumber * 8 + k AS pixel_id,
         l_orderkey % 97 AS nan_when_0, l_orderkey % 89 AS inf_when_0,
         100 + (l_orderkey * 7919 + l_partkey * 104729 + k * 15485863) % 2100 AS x_mm,
         (l_suppkey * 32452843 + l_partkey * 49979687 + l_orderkey * 86028121 + k * 67867967) % 4000 - 2000 AS y_mm,
         (l_partkey * 31 + l_orderkey * 17 + k * 7) % 20 AS jit
  FROM lineitem, (SELECT unnest(range({POINTS_PER_LINE})) AS k)),
points AS (
  SELECT frame_id, pixel_id,
         CASE WHEN nan_when_0 = 0 THEN 'NaN'::FLOAT ELSE (x_mm::FLOAT / 1000::FLOAT)::FLOAT END AS x,
         (y_mm::FLOAT / 1000::FLOAT)::FLOAT AS y,
         CASE WHEN inf_when_0 = 0 THEN 'Infinity'::FLOAT ELSE
           ((CASE WHEN ((x_mm // 300) * 3 + ((y_mm + 2000) // 250) * 5 + frame_id) % 7 = 0 THEN 60 + jit ELSE -299 + jit END)::FLOAT
            / 1000::FLOAT)::FLOAT END AS z,
         jit::FLOAT AS w
  FROM raw_mm)"""
FRAMES_SQL = f"""
frames AS (
  SELECT frame_id, timestamp_ns, (((frame_id * 3) % 7 - 3)::FLOAT / 100::FLOAT)::FLOAT AS qx,
         (((frame_id * 5) % 7 - 3)::FLOAT / 100::FLOAT)::FLOAT AS qy, (((frame_id * 2) % 5)::FLOAT / 10::FLOAT)::FLOAT AS qz, 1::FLOAT AS qw
  FROM (SELECT event_id // {EVENTS_PER_FRAME} AS frame_id, min(epoch_us(ts)) * 1000 AS timestamp_ns FROM events GROUP BY 1))"""
