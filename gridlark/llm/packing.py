"""Best-fit packing by a length histogram.

Documents are encoded and cut into pieces of at most ``capacity`` tokens (a longer document's first piece may be
shorter, all others are full). The plan is made from counts of lengths alone, of which there are at most ``capacity``: lengths in
descending order, each placed into the open sequences with the least room that it fits, all equal sequences at once. A plan row
says which ranks of a length go to which sequences at which offset; pieces then take their places by a join on
length and rank within length. Ranks need no global sort: a piece's rank is its rank inside its task plus the
number of equally long pieces in the tasks before, so a length that most pieces share is dealt over all tasks.

Defined results: a null text is an empty one and has the end id alone; repeated rows are packed each for itself; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm import vocab
from gridlark.llm.common import in_small_batches
from gridlark.storage import written

CAPACITY = 2048
#: Counts by task and length that may be broadcast (20 bytes each).
BROADCAST_COUNTS = 1_000_000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, part int, place long"
PLAN = "length int, rank_from long, rank_to long, first_sequence long, first_offset int, per_sequence int"


def pieces(docs: DataFrame, vocabulary: str, cut: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, with the task they come from (part) and their rank there among equally long ones (place)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = vocab.encoder(vocabulary, cut), TaskContext.get().partitionId()
        placed = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for key, data in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids = vocab.wide(data, encoder.dtype, end_id)
                n = len(ids) // 4
                start, stop, k = 0, n % capacity or capacity, 0
                while start < n:
                    span = ids[4 * start : 4 * stop]
                    rows.append((key, k, start, stop - start, zlib.crc32(span), np.frombuffer(span, "<u4").astype(encoder.dtype).tobytes() if keep_ids else None))
                    start, stop, k = stop, stop + capacity, k + 1
            if not rows:
                continue
            columns = list(zip(*rows, strict=True))
            places = np.empty(len(rows), np.int64)
            for i, length in enumerate(columns[3]):
                places[i] = placed[length]
                placed[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(rows), part, np.int32)), pa.array(places)], names=[c.split()[0] for c in PIECES.split(", ")])

    rows = in_small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return written(rows.mapInArrow(cut_up, PIECES), "pieces")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths; rows as in PLAN.

    Rank q of a row's range goes to sequence first_sequence + (q - rank_from) // per_sequence, at offset
    first_offset + (q - rank_from) % per_sequence * length. The number of rows depends on the capacity, not on the counts.
    """
    out, sequences = [], 0
    groups: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, number of sequences)
    rooms: list[int] = []  # a heap of the rooms that have groups

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                heappush(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        too_small = []
        while left:
            while rooms and rooms[0] < length:
                too_small.append(heappop(rooms))
            if rooms:
                room = rooms[0]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    heappop(rooms)
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = room // length
            used = min(left, n * each)
            out.append((length, rank, rank + used, first, capacity - room, each))
            full, rest = divmod(used, each)
            leave(room - each * length, first, full)
            leave(room - rest * length if rest else 0, first + full, 1)
            touched = full + bool(rest)
            leave(room, first + touched, n - touched)
            rank, left = rank + used, left - used
        for room in too_small:
            heappush(rooms, room)
    return out


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    The histogram, at most ``capacity`` rows, and the plan made from it, whose rows its capacity bounds, are all that
    the driver holds. They are broadcast, and so are counts by task and length up to ``BROADCAST_COUNTS``; more are joined by merging.
    """
    spark = cut.sparkSession
    here = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(here.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    base = counts.select("part", "length", "base")
    base = F.broadcast(base) if counts.count() <= BROADCAST_COUNTS else base.hint("merge")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = spark.createDataFrame(plan(histogram, capacity), PLAN)
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    at = F.col("rank") - F.col("rank_from")
    taken = ranked.join(F.broadcast(rows.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (at >= 0) & (F.col("rank") < F.col("rank_to")))
    return taken.select(
        *[c for c in cut.columns if c not in ("part", "place")],
        (F.col("first_sequence") + F.expr("(rank - rank_from) div per_sequence")).alias("sequence_id"),
        (F.col("first_offset") + at % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str, cut: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset."""
    return place(pieces(docs, vocabulary, cut, end_id, capacity, keep_ids), capacity)


def assemble(packed: DataFrame) -> DataFrame:
    """Per sequence: its ids, joined in order of offset (at most ``capacity`` of them), and where its pieces start."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("p"), F.sum("length").alias("n_tokens")).select(
        "sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("offsets")
    )
