"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A data file is a run of frames: the payload's length (8 bytes), its masked checksum (4), the payload, its masked
checksum (4); all numbers are little-endian. The payload is one document's ids, 2 bytes each (4 if the vocabulary
needs it). The checksum is CRC-32, rotated and offset like the masks of the usual record files so that the checksum
of data holding checksums stays sound. An index file has one entry of 24 bytes per frame: document id, offset in the data file, number of ids.

Documents are dealt to files by ranges of doc_id (and, where rows share one, of text), so that the files in order hold ascending ids; a file is written
under a name of the task's attempt and then renamed, and the manifest names the attempt's file, so that a repeated
attempt or a lost executor leaves no half file in use.

Defined results: a null text is an empty one and has the end id alone. Repeated doc_ids are ordered by text and stay
rows of their own. A null doc_id comes first (kept as the least 64-bit integer in the index). An empty table has no
files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm import vocab
from gridlark.llm.common import in_small_batches
from gridlark.storage import new_path, partitions, written

MASK_DELTA = 0xA282EAD8
INDEX_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_ids", "<u8")])
NO_ID = -(1 << 63)
#: Bytes read at once from a data file, documents in one, and characters of a text that the deal to files looks at.
READ_BYTES, FILE_DOCS, PREFIX = 4 << 20, 100_000, 32


class BadRecord(ValueError):
    """A frame whose checksum doesn't hold or which is cut short."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_frame(source, at: int | None = None) -> bytes | None:
    """The next frame's payload, or that at an offset; None at the end."""
    if at is not None:
        source.seek(at)
    head = source.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise BadRecord("length checksum")
    n = struct.unpack("<Q", head[:8])[0]
    body = source.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
        raise BadRecord("payload checksum")
    return body[:n]


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


MANIFEST = "part int, file string, n_records long, n_ids long, n_bytes long"


def write(docs: DataFrame, path: str, vocabulary: str, cut: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes all documents below ``path``; returns the manifest, one row per data file, itself written there."""
    rows = in_small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    n = partitions(docs.sparkSession, docs.count(), FILE_DOCS)
    # Rows that share an id may go to several files: the prefix follows the order of texts, and keeps the sampled bounds short.
    dealt = rows.repartitionByRange(n, F.col("doc_id"), F.substring("text", 1, PREFIX)).sortWithinPartitions("doc_id", "text")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part, encoder = TaskContext.get().partitionId(), vocab.encoder(vocabulary, cut)
        end = np.array([end_id], encoder.dtype).tobytes()
        fs, root = _store(path)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        records = ids = size = 0
        with fs.open_output_stream(f"{root}/.{name}.data") as data, fs.open_output_stream(f"{root}/.{name}.index") as index:
            while first is not None:
                keys = first.column(0).to_pylist()
                for at in range(0, len(keys), vocab.GROUP):
                    payloads = [x + end for x in encoder.encode(first.column(1).slice(at, vocab.GROUP).to_pylist())]
                    frames = [frame(p) for p in payloads]
                    entries = np.zeros(len(frames), INDEX_ENTRY)
                    entries["doc_id"] = [NO_ID if k is None else k for k in keys[at : at + vocab.GROUP]]
                    lengths = np.array([len(f) for f in frames])
                    entries["offset"] = size + np.cumsum(lengths) - lengths
                    entries["n_ids"] = (lengths - 16) // encoder.dtype.itemsize
                    data.write(b"".join(frames))
                    index.write(entries.tobytes())
                    records, ids, size = records + len(frames), ids + int(entries["n_ids"].sum()), size + int(lengths.sum())
                first = next((b for b in batches if b.num_rows), None)
        for kind in ("index", "data"):
            fs.move(f"{root}/.{name}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_records": [records], "n_ids": [ids], "n_bytes": [size]})

    return written(dealt.mapInArrow(store, MANIFEST), "records-manifest")


RECORDS = "doc_id long, start long, n_tokens long, ids binary"


def read(spark: SparkSession, path: str, manifest: DataFrame, width: int = 2) -> DataFrame:
    """All records of the files that the manifest names: doc_id, start (ids of all records before), n_tokens, ids (binary).

    Files are dealt to tasks by ranges of their numbers, one each; a start is the sum of the manifest's counts before the file plus that inside it.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(manifest.count(), 1)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _records(path, row["file"], row["first"], row["n_records"], width)

    return files.select("part", "file", "first", "n_records").repartitionByRange(n, "part").mapInArrow(load, RECORDS)


def _records(path: str, name: str, start: int, wanted: int, width: int) -> Iterator[pa.RecordBatch]:
    fs, root = _store(path)
    with fs.open_input_stream(f"{root}/{name}.index") as index, fs.open_input_stream(f"{root}/{name}.data", buffer_size=READ_BYTES) as data:
        done = 0
        while raw := index.read(INDEX_ENTRY.itemsize * vocab.GROUP):
            entries = np.frombuffer(raw, INDEX_ENTRY)
            payloads = [read_frame(data) for _ in entries]
            counts = np.array([len(p) // width for p in payloads], np.int64)
            if (counts != entries["n_ids"]).any():
                raise BadRecord("index and data differ")
            starts = start + np.cumsum(counts) - counts
            start, done = start + int(counts.sum()), done + len(entries)
            keys = entries["doc_id"]
            yield pa.RecordBatch.from_arrays([pa.array(keys, mask=keys == NO_ID), pa.array(starts), pa.array(counts), pa.array(payloads, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
        if done != wanted:
            raise BadRecord("index is cut short")


def fetch(path: str, name: str, offsets: list[int]) -> Iterator[bytes]:
    """Payloads at the given offsets of one data file, in that order: the shuffled read."""
    fs, root = _store(path)
    with fs.open_input_file(f"{root}/{name}.data") as data:
        for at in offsets:
            yield read_frame(data, at)


def write_and_read(docs: DataFrame, vocabulary: str, cut: str, end_id: int) -> DataFrame:
    """Writes all documents into a new place of the shared folder and reads every record back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-records")
    return read(spark, path, write(docs, path, vocabulary, cut, end_id))


def ids_crc32(df: DataFrame, ids_col: str = "ids", width: int = 2, to: str = "ids_crc32") -> DataFrame:
    """Adds the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    kind = f"<u{width}"

    @F.pandas_udf("long")
    def crc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in column], dtype="int64")

    return df.withColumn(to, crc(F.col(ids_col)))
