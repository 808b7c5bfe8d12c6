"""Sinks: nothing, CSV grids, PNG pictures, datagrams. A sink is a callable on a DataFrame, fit for ``foreachBatch``."""

from __future__ import annotations

import socket
import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridlark.config import PipelineConfig, consumer_kind
from gridlark.functions import packets
from gridlark.sinks.committed import GridFiles
from gridlark.storage import output_folder, written

#: Pixels per cell, and colours of unknown, free and blocked cells.
SCALE = 8
COLOURS = ((128, 128, 128), (0, 200, 0), (220, 0, 0))
HOST, PORT = "127.0.0.1", 5005

#: Takes results and, from a stream, their batch's number.
Sink = Callable[..., None]


def discard(results: DataFrame, batch: int | None = None) -> None:
    results.write.format("noop").mode("overwrite").save()


def csv_rows(grid: DataFrame) -> DataFrame:
    """One line of text per frame and row of the grid: codes as 0, 1 or nan, by column."""
    shown = F.when(F.isnan("code"), "nan").when(F.col("code") > 0.5, "1").otherwise("0")
    row = F.sort_array(F.collect_list(F.struct("j", shown.alias("v"))))
    return grid.groupBy("frame_id", "i").agg(F.array_join(F.transform(row, lambda c: c["v"]), ",").alias("line"))


def png(nr: int, nt: int, codes: np.ndarray, scale: int = SCALE) -> bytes:
    """The grid's picture: one colour per cell, each scale x scale pixels."""
    kinds = np.where(np.isnan(codes), 0, np.where(codes <= 0.5, 1, 2)).reshape(nr, nt)
    pixels = np.array(COLOURS, np.uint8)[kinds].repeat(scale, 0).repeat(scale, 1)
    lines = np.concatenate([np.zeros((len(pixels), 1), np.uint8), pixels.reshape(len(pixels), -1)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", nt * scale, nr * scale, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def csv_text(nr: int, nt: int, codes: np.ndarray) -> bytes:
    words = np.where(np.isnan(codes), "nan", np.where(codes > 0.5, "1", "0")).reshape(nr, nt)
    return "".join(",".join(row) + "\n" for row in words).encode()


def write_files(results: DataFrame, folder: str, images: bool, first: int = 0) -> int:
    """Writes frame_<index>.png or .csv for each packed result, from the executors, below a URI (``committed``: all or none); returns how many.

    Results are numbered by their frames' time stamps from ``first`` on; only these keys are put into a global order. They are counted as they are written.
    """
    rows = packets.numbered(results, "file_index").withColumn("file_index", F.col("file_index") + first)
    seen = Observation()
    rows = rows.select("file_index", "trav_grid", "r_bins", "theta_bins").observe(seen, F.count(F.lit(1)).alias("n"))
    results.sparkSession.dataSource.register(GridFiles)
    rows.write.format("grid_files").option("path", folder).option("images", str(images).lower()).mode("append").save()
    return seen.get["n"]


def send(results: DataFrame, host: str = HOST, port: int = PORT, first_seq: int = 0) -> int:
    """Sends results that fit a datagram, in order of time, from the driver; returns the next sequence number.

    Rows come to the driver one partition at a time, from a written table, so that sending waits for nothing to be computed; a sequence number is used up by a whole
    datagram only.
    """
    seq = first_seq
    results = results if results.is_cached else written(results, "results")
    fit = results.where(packets.layout_ok()).withColumn("seq", F.lit(0).cast("long"))
    rows = packets.encoded(fit).select("timestamp_ns", "payload").orderBy("timestamp_ns")
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.setblocking(False)
        for row in rows.toLocalIterator():
            payload = bytearray(row.payload)
            struct.pack_into("<I", payload, 4, seq & 0xFFFFFFFF)
            try:
                if s.sendto(payload, (host, port)) == len(payload):
                    seq += 1
            except OSError:
                continue
    return seq


class Counts:
    """How many results a sink has taken, batch by batch, kept below ``state`` so that they survive a restart.

    A batch that is repeated after a failure starts from the count before it and so writes the same names again.
    """

    def __init__(self, spark: SparkSession, state: str | None = None):
        self.spark, self.state, self.now = spark, state, 0

    def before(self, batch: int | None) -> int:
        if self.state is None or batch is None:
            return self.now
        if batch == 0:
            return 0
        try:
            return self.spark.read.parquet(f"{self.state}/{batch - 1}").first()["n"]
        except AnalysisException as why:
            if why.getCondition() != "PATH_NOT_FOUND":
                raise
            if not self.now:
                raise RuntimeError(f"the count before batch {batch} is lost from {self.state}: its files would be numbered from 0 again") from why
            return self.now

    def after(self, batch: int | None, n: int) -> None:
        self.now = n
        if self.state is not None and batch is not None:
            self.spark.range(1).select(F.lit(n).cast("long").alias("n")).write.mode("overwrite").parquet(f"{self.state}/{batch}")


def sink_of(config: PipelineConfig, spark: SparkSession, state: str | None = None) -> Sink:
    """The sink that the configuration names. It counts what it has written; with a folder for its state also across restarts."""
    kind, counts = consumer_kind(config.consumer), Counts(spark, state)

    def disk(results: DataFrame, batch: int | None = None) -> None:
        first = counts.before(batch)
        folder = output_folder(spark, config.disk_writer.output_dir)
        counts.after(batch, first + write_files(results, folder, config.disk_writer.write_images, first))

    def network(results: DataFrame, batch: int | None = None) -> None:
        counts.after(batch, send(results, first_seq=counts.before(batch)))

    return {"disk": disk, "network": network}.get(kind, discard)
