"""Helpers shared by the operators: tables, bounded Arrow batches, names of added columns, ASCII lower-casing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy a row. One with fewer splits than the session has cores is dealt over all of them; larger ones stay."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Arrow batches that Python gets: rows, and bytes beyond which a batch ends early. Long texts would make the default batches large.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same DataFrame, whose session hands rows to Python in batches of a bounded size.

    The result is computed later, so the settings have to stay: they are required ones. Smaller values that the session already has are kept.
    """
    conf = df.sparkSession.conf
    for name, most in BATCH_SETTINGS.items():
        now = conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


def unused(df: DataFrame, name: str) -> str:
    """The name for a column to add: with underscores behind it as long as the input has a column of that name in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)
