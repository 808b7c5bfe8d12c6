"""Written intermediate tables in the folder that driver and executors share, and global order without a global task.

A written table cuts the lineage: a lost executor costs a reread, and what reads it twice isn't computed twice.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a range of ``ranged`` should hold at most, so that the number of ranges follows the table.
RANGE_ROWS = 1_000_000
#: A key with more than this share of a table's rows is hot; there are fewer than HOT such keys.
HOT = 256
PART = "_part"
#: Folders of local sessions without a named one, by application.
_own: dict[str, str] = {}
#: Paths that this process has made and not deleted, by ``_plain``, and the folder of the innermost ``scratch``.
_made: dict[str, str] = {}
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, with its file system.

    A name without a scheme belongs to the default file system. Only a session on one machine may do without the setting: it
    gets a folder of its own. Elsewhere executors would write to their own disks, so that is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="gridlark-")
        found = _own[app]
    return qualified(spark, found)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system; one without a scheme belongs to the session's default file system."""
    if "://" not in path:
        name = spark._jvm.org.apache.hadoop.fs.Path(path)
        scheme, _, rest = name.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(name).toString().partition(":")
        path = f"{scheme}:{rest}" if rest.startswith("//") else f"{scheme}://{rest}"
    return path.rstrip("/")


def output_folder(spark: SparkSession, path: str) -> str:
    """Where executors write files for good: a folder of the default file system, or as its scheme says. A cluster's executors don't share their local disks."""
    found = qualified(spark, path)
    master = spark.sparkContext.master
    if found.startswith("file:") and "://" not in path and master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{path} is on each machine's own disk: name a folder that all executors share, with its scheme")
    return found


#: Schemes as Hadoop names them and as Arrow does.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def arrow_folder(uri: str):
    """(Arrow's file system, path) of a folder; says so where Arrow can't reach it."""
    from pyarrow.fs import FileSystem
    from pyarrow.lib import ArrowException

    scheme, _, rest = uri.partition("://")
    try:
        return FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{rest}")
    except (ArrowException, ValueError) as why:
        raise RuntimeError(f"files can't be written to {uri} from tasks ({why}): name a folder of file, hdfs, s3, gs or abfs") from why


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, or in that of the ``scratch`` around the call."""
    path = f"{_scope.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[_plain(path)] = path
    return path


def _plain(path: str) -> str:
    """A path in one spelling: however many slashes it is written with, and whether or not its characters are escaped."""
    scheme, _, rest = path.partition(":")
    return f"{scheme}:{re.sub('/+', '/', unquote(rest)).rstrip('/')}"


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a path that ``new_path`` made, with all in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gone = _plain(path)
    for p in [p for p in _made if p == gone or p.startswith(gone + "/")]:
        del _made[p]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What is written inside the block lies in one folder, which is deleted when the block ends.

    Results must be computed or written to a path made before the block, since DataFrames that read the folder's tables can't be used after it.
    """
    folder = new_path(spark, "run")
    before = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(before)
        _delete(spark, folder)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder (or to a path of ``new_path``) and reads it back."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """``written``, and integer aggregates of the table (0 where there are none) from the pass that writes it, so that it isn't read once more for them.

    They are gathered by the tasks that write, of which Spark takes each partition's once.
    """
    seen = Observation()
    table = written(df.observe(seen, *[c.alias(k) for k, c in sums.items()]), name)
    try:
        found = seen.get
    except Py4JJavaError as why:  # adaptive execution leaves out what comes after an empty shuffle: no rows, and no observation
        if why.java_exception.getClass().getSimpleName() != "AssertionError":
            raise
        found = {}
    return table, {k: found.get(k) or 0 for k in sums}


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made in this process; only once nothing reads them any more.

    A DataFrame that reads anything else, such as a source table, is refused, and then nothing is deleted.
    """
    for df in tables:
        found = {_plain(f.rsplit("/", 1)[0]) for f in df.inputFiles()}
        foreign = sorted(found - _made.keys())
        if foreign:
            raise ValueError(f"not written here, so not deleted: {', '.join(foreign)}")
        for path in found:
            _delete(df.sparkSession, _made[path])


def partitions(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions for a shuffle: the session's number, or more where the table is larger."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_each))


def ranged(df: DataFrame, *order: str, rows_each: int | None = None, most: int | None = None) -> DataFrame:
    """df, dealt by ranges of a total order and written, with the range's number as ``PART``: ranges follow each other in that order.

    most: a known bound of its rows, where counting them would compute them once more.
    """
    n = partitions(df.sparkSession, df.count() if most is None else most, rows_each or RANGE_ROWS)
    return written(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), "ranged")


def ordinal(df: DataFrame, *order: str, to: str) -> DataFrame:
    """df with its rows' numbers from 0 in a total order. A table beyond ``RANGE_ROWS`` is dealt by ranges, of which only the sizes meet in one task."""
    if df.limit(RANGE_ROWS + 1).count() <= RANGE_ROWS:
        return df.withColumn(to, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    rows = ranged(df, *order)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(PART).agg(F.count("*").alias("_n")).select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(PART).orderBy(*order)) - 1
    numbered = rows.withColumn("_inside", inside).join(F.broadcast(base), PART)  # base: one row a range
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_base") + F.col("_inside")).alias(to))


def largest_group(df: DataFrame, key: str) -> int:
    """Rows of the most frequent key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def spread_join(many: DataFrame, one: DataFrame, on: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """many joined (inner or left) with ``one``, which has a bounded number of rows a key, without a task of its own for a hot key.

    hot (from a written table): the keys that have more than one HOTth of the rows of ``many``, so fewer than HOT; None where there are known to be none. Their
    rows of ``one`` are broadcast; all others are joined by a shuffle. Null keys match nothing and aren't shuffled.
    """
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    if (hot is None or hot.isEmpty()) and (how == "inner" or many.where(missing).isEmpty()):
        return many.join(one, on, how)
    hot = one.limit(0).select(*on) if hot is None else hot.select(*on)
    marked = many.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    few = one.join(F.broadcast(hot), on, "left_semi")
    apart = marked.where(F.col("_hot") | missing).drop("_hot").join(F.broadcast(few), on, how)
    return apart.unionByName(marked.where(F.col("_hot").isNull() & ~missing).drop("_hot").join(one, on, how))
