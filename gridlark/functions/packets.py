"""The result packet: little-endian header (magic, sequence, time stamp, rows, columns), codes, heights, both axes' edges.

Header checks are SQL expressions; the float payload goes through numpy in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructField, StructType

from gridlark.grid import Grid
from gridlark.storage import ordinal, written

# Fixed values of the wire format.
MAGIC = 0x54524156
HEADER_BYTES, MAX_BYTES = 24, 65_507
HEADER = np.dtype([("magic", "<u4"), ("seq", "<u4"), ("timestamp_ns", "<u8"), ("nr", "<u4"), ("nt", "<u4")])


def packet_size(nr: Column, nt: Column) -> Column:
    nr, nt = nr.cast("long"), nt.cast("long")
    return F.lit(HEADER_BYTES).cast("long") + 8 * nr * nt + 4 * (nr + 1) + 4 * (nt + 1)


def packed(grid: DataFrame, frames: DataFrame, g: Grid) -> DataFrame:
    """One row per frame: the dense arrays in row-major order, the edges and the grid's size."""
    cell = F.struct("i", "j", "code", "terrain")
    rows = grid.groupBy("frame_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    r, t = g.edges()
    return rows.join(frames.select("frame_id", "timestamp_ns"), "frame_id").select(
        "frame_id", "timestamp_ns",
        F.transform("cells", lambda c: c["code"]).alias("trav_grid"), F.transform("cells", lambda c: c["terrain"]).alias("height_map"),
        F.array(*[F.lit(x).cast("float") for x in r]).alias("r_edges"), F.array(*[F.lit(x).cast("float") for x in t]).alias("theta_edges"),
        F.lit(g.nr).alias("r_bins"), F.lit(g.nt).alias("theta_bins"),
    )


def unpacked(results: DataFrame) -> DataFrame:
    """Back to one row per cell."""
    cells = results.select("frame_id", "theta_bins", F.posexplode(F.arrays_zip("trav_grid", "height_map")).alias("at", "c"))
    return cells.select("frame_id", F.expr("int(at div theta_bins)").alias("i"), F.expr("int(at % theta_bins)").alias("j"), F.col("c.trav_grid").alias("code"), F.col("c.height_map").alias("terrain"))


def layout_ok() -> Column:
    """Whether a packed result is consistent and fits a datagram."""
    n = F.col("r_bins").cast("long") * F.col("theta_bins")
    sizes = (F.size("trav_grid") == n) & (F.size("height_map") == n) & (F.size("r_edges") == F.col("r_bins") + 1) & (F.size("theta_edges") == F.col("theta_bins") + 1)
    return (F.col("r_bins") >= 0) & (F.col("theta_bins") >= 0) & sizes & (packet_size(F.col("r_bins"), F.col("theta_bins")) <= MAX_BYTES)


@F.pandas_udf(BinaryType())
def _encode(seq: pd.Series, stamp: pd.Series, nr: pd.Series, nt: pd.Series, trav: pd.Series, height: pd.Series, r: pd.Series, t: pd.Series) -> pd.Series:
    out = []
    for s, ns, rows, cols, *arrays in zip(seq, stamp, nr, nt, trav, height, r, t, strict=True):
        head = np.array([(MAGIC, int(s) & 0xFFFFFFFF, int(ns), rows, cols)], HEADER)
        out.append(head.tobytes() + b"".join(np.asarray(a, "<f4").tobytes() for a in arrays))
    return pd.Series(out, dtype=object)


def encoded(results: DataFrame) -> DataFrame:
    """results (with a column seq) plus payload."""
    return results.withColumn("payload", _encode("seq", "timestamp_ns", "r_bins", "theta_bins", "trav_grid", "height_map", "r_edges", "theta_edges"))


def swapped(hexed: Column, n: int) -> Column:
    """The hexadecimal text of n bytes with the bytes in the opposite order (``reverse`` would keep UTF-8 sequences together)."""
    return F.concat(*[F.substring(hexed, 2 * k + 1, 2) for k in reversed(range(n))])


def little_endian(payload: Column, at: int, n: int) -> Column:
    """An unsigned number of n bytes at a 0-based offset: BIGINT up to four bytes, else DECIMAL(20, 0), which holds all of eight. Null if cut short."""
    whole = F.when(F.length(payload) >= at + n, F.conv(swapped(F.hex(F.substring(payload, at + 1, n)), n), 16, 10).cast("decimal(20,0)"))
    return whole.cast("long") if n <= 4 else whole


def headers(packets: DataFrame) -> DataFrame:
    """Packets that are whole and well-formed, with their header's fields; all others are dropped.

    Fields are unsigned: seq, nr and nt are BIGINT, timestamp_ns is DECIMAL(20, 0).
    """
    p = F.col("payload")
    fields = packets.where(little_endian(p, 0, 4) == MAGIC).select("*", little_endian(p, 4, 4).alias("seq"), little_endian(p, 8, 8).alias("timestamp_ns"), little_endian(p, 16, 4).alias("nr"), little_endian(p, 20, 4).alias("nt"))
    nr, nt = (F.col(c).cast("decimal(10,0)") for c in ("nr", "nt"))
    return fields.where(F.length(p) == HEADER_BYTES + 4 * (2 * nr * nt + nr + nt + 2))


DECODED = StructType([StructField(n, ArrayType(FloatType())) for n in ("trav_grid", "height_map", "r_edges", "theta_edges")])


@F.pandas_udf(DECODED)
def _decode(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for payloads, nrs, nts in batches:
        rows = []
        for payload, nr, nt in zip(payloads, nrs, nts, strict=True):
            flat = np.frombuffer(payload, "<f4", offset=HEADER_BYTES)
            rows.append(np.split(flat, np.cumsum([nr * nt, nr * nt, nr + 1])))
        yield pd.DataFrame(rows, columns=["trav_grid", "height_map", "r_edges", "theta_edges"])


def decoded(packets: DataFrame) -> DataFrame:
    """Valid packets with header fields and arrays."""
    return headers(packets).withColumn("body", _decode("payload", "nr", "nt")).select("*", "body.*").drop("body")


def with_sequence(results: DataFrame) -> DataFrame:
    """Numbers results in order of time (then frame) from 0; results that don't fit a datagram get no number and aren't sent."""
    return numbered(results.where(layout_ok()), "seq")


def numbered(results: DataFrame, to: str) -> DataFrame:
    """results with their numbers in order of time. The order is found on keys alone; the arrays stay where they are.

    results are read twice, so they are written first unless they are cached.
    """
    held = results if results.is_cached else written(results, "results")
    keys = ordinal(held.select("frame_id", "timestamp_ns"), "timestamp_ns", "frame_id", to=to)
    return held.join(keys.select("frame_id", to), "frame_id")
