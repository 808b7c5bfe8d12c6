"""Nearest neighbours by inner product with cross-polytope hashing, multiprobe tables and exact reranking.

1. Equal vectors form one class, which keeps the ``top + 1`` smallest ids of its rows: no search needs more of them, since ties go to
   smaller ids. A vector that fills a third of the table is one row from here on.
2. Inner products become angles: classes are put into bands by their length (within a factor of 2), and inside a band of greatest
   length M a vector x becomes the unit vector (x / M, sqrt(1 - |x|^2 / M^2)), a query q becomes (q / |q|, 0). A query is asked
   in all bands. Vectors of different dimensions never meet.
3. In each of ``TABLES`` tables a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) sends a vector to its
   nearest signed axis; with ``hashes`` of them a bucket is a tuple of axes. A query probes the buckets of the axes nearest to it,
   best sum of coordinates first. Classes and queries keep lists of bucket numbers; vectors are dealt to buckets in one shuffle.
4. A bucket is dealt in blocks of members and chunks of queries, each cell of a bounded size. Inside a cell a matrix product finds what can
   be among a query's ``top + 1`` best classes; their products are then summed in double precision in order of the coordinates, from
   the original vectors. So nothing grows with the product of a bucket's sides. The cells' best are merged.
5. A query that thereby finds fewer than ``top`` rows, though its dimension has more, is compared with all classes of its dimension,
   in the same kind of cells.

The share of buckets that a query probes in a table is measured in every run: up to ``SAMPLED`` queries of a dimension are compared with
all its classes, and the share is the least at which ``TARGET`` of their true neighbours lie in a probed bucket.

Defined results: vectors that are null, empty, zero, or hold nulls or non-finite numbers, and null ids, take no part. Every other row
is a candidate, and a query if the condition says so, also where rows share an id or are repeated; only the query's own row is no
candidate of it, so a repeated row finds its copies, and its results are repeated. A query without candidates has no rows. Empty tables
give none. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.common import in_small_batches
from gridlark.storage import drop_written, partitions, written

TABLES = 8
#: Queries that the share is measured on, the recall it is chosen for, and numbers that all sampled vectors, or the probes made at once, may have together.
SAMPLED, TARGET, NUMBERS = 128, 0.95, 1 << 22
#: Classes a bucket should hold about, beyond which a further hash makes buckets finer.
LOAD = 2000
#: Members and queries of a cell.
BLOCK, CHUNK = 4096, 1024
#: Buckets whose numbers of blocks and chunks may be broadcast (24 bytes each), and cells that a task compares, about.
BROADCAST_BUCKETS, TASK_CELLS = 1_000_000, 256
#: Rows hashed at once.
GROUP = 256
SEED = 20


def signs(dim: int, table: int, hash_: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, table, hash_]).choice([-1.0, 1.0], (3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row, in log2(dim) passes."""
    n, dim = x.shape
    half = 1
    while half < dim:
        x = x.reshape(n, dim // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(n, dim) / math.sqrt(dim)


def rotated(x: np.ndarray, table: int, hash_: int) -> np.ndarray:
    for s in signs(x.shape[1], table, hash_):
        x = hadamard(x * s)
    return x


def padded_dim(dim: int) -> int:
    """The power of two that holds a vector and its added coordinate."""
    return 1 << dim.bit_length()


def codes(unit: np.ndarray, table: int, hashes: int) -> np.ndarray:
    """Each row's bucket: the nearest signed axis of each hash as a digit."""
    dim = unit.shape[1]
    out = np.zeros(len(unit), np.int64)
    for h in range(hashes):
        y = rotated(unit, table, h)
        at = np.abs(y).argmax(1)
        out = out * (2 * dim) + np.where(y[np.arange(len(y)), at] >= 0, at, at + dim)
    return out


def probed(dim: int, hashes: int, share: float) -> int:
    """Buckets that a query looks into in a table."""
    return min((2 * dim) ** hashes, math.ceil(share * (2 * dim) ** hashes))


def rank_pairs(lefts: int, rights: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranks (from 0) in two falling lists whose sums can be among the ``wanted`` greatest: others have as many pairs of lesser ranks before them."""
    spans = np.minimum(rights, wanted // np.arange(1, min(lefts, wanted) + 1))
    left = np.repeat(np.arange(len(spans)), spans)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(spans) - spans, spans)


def probes(unit: np.ndarray, table: int, hashes: int, share: float) -> np.ndarray:
    """Each row's buckets to look into, nearest first. Tuples of axes are extended by a hash at a time, and only those made that can still be among the nearest."""
    dim = unit.shape[1]
    wanted = probed(dim, hashes, share)
    found, score = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for h in range(hashes):
        y = rotated(unit, table, h)
        both = np.concatenate([y, -y], axis=1)
        axes = np.argsort(-both, axis=1, kind="stable")[:, :wanted]
        left, right = rank_pairs(score.shape[1], axes.shape[1], wanted)
        score = score[:, left] + np.take_along_axis(both, axes, 1)[:, right]
        best = np.argsort(-score, axis=1, kind="stable")[:, :wanted]
        score = np.take_along_axis(score, best, 1)
        found = np.take_along_axis(found, left[best], 1) * (2 * dim) + np.take_along_axis(axes, right[best], 1)
    return found


def at_once(dim: int, hashes: int, share: float, bands: int) -> int:
    """Queries whose probes are made and held at once: for few buckets ``GROUP``, for many so that their numbers stay below ``NUMBERS``, or one query's."""
    wanted = probed(dim, hashes, share)
    numbers = len(rank_pairs(min(wanted, (2 * dim) ** (hashes - 1)), 2 * dim, wanted)[0]) + TABLES * bands * wanted
    return max(1, min(GROUP, NUMBERS // numbers))


def lengths(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    return top[:, 0] * np.sqrt(((x / top) ** 2).sum(axis=1))


def hash_plan(n: int, dim: int) -> int:
    """Hashes in a bucket for n classes."""
    return max(1, round(math.log(max(n, 1) / LOAD) / math.log(2 * padded_dim(dim)))) if n > LOAD else 1


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0)


def classes_of(vectors: DataFrame, top: int) -> DataFrame:
    """class_id, vector, ids (of the top + 1 rows with the smallest), first_id, length, dim, band of each distinct vector."""
    kind = dict(vectors.dtypes)["vector"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            norm = np.array([lengths(np.array([v], np.float64))[0] for v in rows], np.float64)
            band = np.floor(np.log2(norm) + 0.5).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm, pa.float64()), pa.array(band)], names=["vector", "ids", "length", "band"])

    smallest = Window.partitionBy("vector").orderBy("id")
    few = vectors.withColumn("k", F.row_number().over(smallest)).where(F.col("k") <= top + 1)
    grouped = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    measured = grouped.mapInArrow(measure, f"vector {kind}, ids array<long>, length double, band int")
    return written(measured.select(F.monotonically_increasing_id().alias("class_id"), "*", F.col("ids")[0].alias("first_id"), F.size("vector").alias("dim")), "vector-classes")


def hashed(classes: DataFrame, greatest: dict[tuple[int, int], float], plans: dict[int, tuple[int, float]], as_queries: bool) -> DataFrame:
    """dim, class_id, first_id, vector, places: the buckets it lies in (or, as a query, looks into). A place numbers band, table and bucket of a dimension."""
    kind = dict(classes.dtypes)["vector"]
    order = {key: i for i, key in enumerate(sorted(greatest))}
    bands = {dim: [b for d, b in order if d == dim] for dim, _ in order}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, GROUP):
                batch = whole.slice(start, GROUP)
                dims, band = batch.column(0).to_numpy(), batch.column(4).to_numpy()
                norms = batch.column(5).to_numpy()
                vectors = batch.column(3).to_pylist()
                for dim in np.unique(dims):
                    dim = int(dim)
                    hashes, share = plans[dim]
                    size = (2 * padded_dim(dim)) ** hashes
                    each = at_once(padded_dim(dim), hashes, share, len(bands[dim])) if as_queries else GROUP
                    of_dim = np.flatnonzero(dims == dim)
                    for at in np.split(of_dim, range(each, len(of_dim), each)):
                        unit = np.zeros((len(at), padded_dim(dim)))
                        unit[:, :dim] = np.array([vectors[i] for i in at])
                        if as_queries:
                            unit /= norms[at][:, None]
                        else:
                            top = np.array([greatest[dim, int(b)] for b in band[at]])
                            unit /= top[:, None]
                            unit[:, dim] = np.sqrt(np.maximum(0.0, 1.0 - (norms[at] / top) ** 2))
                            own = np.array([order[dim, int(b)] for b in band[at]])
                        places = []
                        for table in range(TABLES):
                            if as_queries:
                                found = probes(unit, table, hashes, share)
                                places += [(order[dim, b] * TABLES + table) * size + found for b in bands[dim]]
                            else:
                                places.append(((own * TABLES + table) * size + codes(unit, table, hashes))[:, None])
                        rows, flat = batch.take(pa.array(at)), np.concatenate(places, axis=1)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.reshape(-1)))
                        yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(4)), lists], names=["dim", "class_id", "first_id", "vector", "places"])

    return classes.select("dim", "class_id", "first_id", "vector", "band", "length").mapInArrow(run, f"dim int, class_id long, first_id long, vector {kind}, places array<long>")


def depths(query: np.ndarray, members: np.ndarray, hashes: int) -> np.ndarray:
    """How many of its buckets the unit vector ``query`` probes before it gets to each member, in the table where these are fewest."""
    least = np.full(len(members), np.iinfo(np.int64).max)
    for table in range(TABLES):
        sums = np.zeros(1)
        for h in range(hashes):
            y = rotated(query[None, :], table, h)[0]
            sums = (sums[:, None] + np.concatenate([y, -y])).reshape(-1)
        least = np.minimum(least, len(sums) - np.searchsorted(np.sort(sums), sums[codes(members, table, hashes)], "right"))
    return least


def measured_plans(classes: DataFrame, queries: DataFrame, greatest: dict[tuple[int, int], float], plans: dict[int, int], top: int) -> dict[int, tuple[int, float]]:
    """Hashes and the share of buckets by dimension: the share that sampled queries (some of the classes) need for a recall of ``TARGET``."""
    most = min(SAMPLED, NUMBERS // sum(plans))
    if not most:  # so many dimensions that there is no room for samples
        return {dim: (hashes, 1.0) for dim, hashes in plans.items()}
    some = Window.partitionBy("dim").orderBy(F.xxhash64("class_id"), "class_id")
    picked = queries.select("class_id", "vector", "dim").withColumn("k", F.row_number().over(some)).where(F.col("k") <= most).collect()
    sample = {dim: ([r["class_id"] for r in picked if r["dim"] == dim], np.array([r["vector"] for r in picked if r["dim"] == dim], np.float64)) for dim in {r["dim"] for r in picked}}
    shared = classes.sparkSession.sparkContext.broadcast(sample)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best classes of each sampled query in a task."""
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dims, ids, vectors = batch.column(2).to_numpy(), batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                asked, x = shared.value[int(dim)]
                scores = x @ np.array([vectors[i] for i in at], np.float64).T
                scores[np.array(asked)[:, None] == ids[at]] = -np.inf
                held = best.get(int(dim), (np.zeros((len(asked), 0), np.int64), np.zeros((len(asked), 0))))
                found, scores = np.concatenate([held[0], np.broadcast_to(ids[at], scores.shape)], axis=1), np.concatenate([held[1], scores], axis=1)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :top]
                best[int(dim)] = np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)
        for dim, (found, scores) in best.items():
            i, j = np.nonzero(scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(found[i, j]), pa.array(scores[i, j])], names=["dim", "i", "class_id", "score"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, i, members in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                query, unit = np.zeros(padded_dim(dim)), np.zeros((len(members), padded_dim(dim)))
                query[:dim] = shared.value[dim][1][i]
                query /= lengths(query[None, :])[0]
                longest = np.array([greatest[dim, m["band"]] for m in members])
                unit[:, :dim] = np.array([m["vector"] for m in members]) / longest[:, None]
                unit[:, dim] = np.sqrt(np.maximum(0.0, 1.0 - (np.array([m["length"] for m in members]) / longest) ** 2))
                found = depths(query, unit, plans[dim])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), dim, np.int32)), pa.array(found)], names=["dim", "depth"])

    first = Window.partitionBy("dim", "i").orderBy(F.desc("score"), "class_id")
    near = classes.where(F.col("dim").isin(*sample)).select("class_id", "vector", "dim").mapInArrow(compare, "dim int, i int, class_id long, score double")
    true = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= top).select("i", "class_id")
    members = classes.join(F.broadcast(true), "class_id").groupBy("dim", "i").agg(F.collect_list(F.struct("vector", "band", "length")).alias("members"))
    out = {dim: (hashes, 1.0) for dim, hashes in plans.items()}
    needed: dict[int, list[int]] = {}
    for r in members.mapInArrow(measure, "dim int, depth long").collect():  # SAMPLED * top rows a dimension
        needed.setdefault(r["dim"], []).append(r["depth"])
    for dim, found in needed.items():
        at = sorted(found)[math.ceil(TARGET * len(found)) - 1]
        out[dim] = plans[dim], min(1.0, (at + 1) / (2 * padded_dim(dim)) ** plans[dim])
    return out


def cells(members: DataFrame, queries: DataFrame) -> tuple[DataFrame, int]:
    """Deals buckets that have both sides to cells of a bounded size: dim, place, block, chunk, is_query and the row; and their number."""
    keys = ["dim", "place"]

    def placed(side: DataFrame, *more: str) -> DataFrame:
        return side.select("dim", *more, F.explode("places").alias("place"))

    sizes = placed(members).groupBy(*keys).agg(F.count("*").alias("m")).join(placed(queries).groupBy(*keys).agg(F.count("*").alias("q")), keys)
    sizes = written(sizes.select(*keys, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("q") / CHUNK).cast("int").alias("chunks")), "bucket-sizes")
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("blocks").cast("long") * F.col("chunks")), F.lit(0))).first()
    sizes = F.broadcast(sizes) if n <= BROADCAST_BUCKETS else sizes

    def dealt(side: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        rows = placed(side, "class_id", "first_id", "vector").join(sizes, keys)
        mine = F.pmod(F.xxhash64("class_id"), F.col(own)).cast("int")
        to = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        rows = rows.select(*keys, "class_id", "first_id", "vector", mine.alias("mine"), to.alias("to"))
        block, chunk = ("to", "mine") if is_query else ("mine", "to")
        return rows.select(*keys, F.col(block).alias("block"), F.col(chunk).alias("chunk"), F.lit(is_query).alias("is_query"), "class_id", "first_id", "vector")

    return dealt(members, "blocks", "chunks", False).unionByName(dealt(queries, "chunks", "blocks", True)), total


def whole_cells(classes: DataFrame, asked: DataFrame, sizes: dict[int, int]) -> tuple[DataFrame, int]:
    """As ``cells``, for queries (class_id, dim) that are compared with all classes of their dimension; sizes has the number of classes."""
    counts = asked.groupBy("dim").agg(F.count("*").alias("q")).collect()
    grid = [(r["dim"], math.ceil(sizes[r["dim"]] / BLOCK), math.ceil(r["q"] / CHUNK)) for r in counts]
    rows = classes.join(F.broadcast(classes.sparkSession.createDataFrame(grid, "dim int, blocks int, chunks int")), "dim")

    def dealt(side: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("class_id"), F.col(own)).cast("int").alias("chunk" if is_query else "block")
        to = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("block" if is_query else "chunk")
        both = side.select("dim", F.lit(-1).cast("long").alias("place"), mine, to, F.lit(is_query).alias("is_query"), "class_id", "first_id", "vector")
        return both.select("dim", "place", "block", "chunk", "is_query", "class_id", "first_id", "vector")

    queries = rows.join(asked.select("class_id"), "class_id", "left_semi")
    return dealt(rows, "blocks", "chunks", False).unionByName(dealt(queries, "chunks", "blocks", True)), sum(b * c for _, b, c in grid)


FOUND = "query long, class_id long, first_id long, score double"


def best_in_cells(dealt: DataFrame, n_cells: int, top: int) -> DataFrame:
    """The best ``top + 1`` classes of each query in each cell."""
    where = ["dim", "place", "block", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, is_query), rows in _runs(batches):
            if not is_query:
                members, (ids, firsts, vectors) = rows[0], rows[1:]
                continue
            if rows[0] == members:
                yield _best(rows[1], rows[3], ids, firsts, vectors, top)

    n = partitions(dealt.sparkSession, n_cells, TASK_CELLS)
    placed = dealt.repartition(n, *where).sortWithinPartitions(*where, "is_query")
    return placed.mapInArrow(run, FOUND)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of rows of one cell and one side: ((cell, is_query), [cell, class ids, first ids, vectors])."""
    held, parts = None, []

    def flush():
        ids, firsts, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
        return held, [held[0], ids, firsts, vectors]

    for batch in batches:
        keys = np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(5)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            key = tuple(keys[a, :4].tolist()), bool(keys[a, 4])
            if held is not None and held != key:
                yield flush()
                parts = []
            held = key
            flat = batch.column(7).slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
            parts.append((batch.column(5).slice(a, b - a).to_numpy(), batch.column(6).slice(a, b - a).to_numpy(), flat.astype(np.float64).reshape(b - a, -1)))
    if held is not None:
        yield flush()


def _best(queries, query_vectors, ids, firsts, vectors, top: int) -> pa.RecordBatch:
    """The best ``top + 1`` of the members for each query, ties to the smaller first id."""
    out, longest = [], lengths(vectors).max()
    for at in range(0, len(queries), 256):
        part = query_vectors[at : at + 256]
        rough = part @ vectors.T
        if rough.shape[1] > top + 1:
            # What rounding can make of a sum of products, in whatever order, is far below this part of the product of the lengths.
            slack = 4 * vectors.shape[1] * np.finfo(np.float64).eps * lengths(part) * longest
            least = np.partition(rough, rough.shape[1] - top - 1, axis=1)[:, rough.shape[1] - top - 1] - slack
            q, m = np.nonzero(rough >= least[:, None])
        else:
            q, m = (x.ravel() for x in np.indices(rough.shape))
        score = np.zeros(len(q))
        for k in range(vectors.shape[1]):  # in order of the coordinates, so that a pair's score is the same wherever it is computed
            score += part[q, k] * vectors[m, k]
        order = np.lexsort((firsts[m], -score, q))
        q, m, score = q[order], m[order], score[order]
        first = np.searchsorted(q, np.arange(len(part)))
        keep = np.arange(len(q)) - first[q] <= top
        out.append((queries[at : at + 256][q[keep]], ids[m[keep]], firsts[m[keep]], score[keep]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query", "class_id", "first_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20) -> DataFrame:
    """query_id, rank (from 1), the found id under its own name, score. ``is_query`` is a condition on a column named id."""
    # Single-precision vectors travel as they are, in half the bytes; all arithmetic is in double precision.
    vector = F.col(f"`{vector_col}`")
    if dict(vectors.dtypes)[vector_col] != "array<float>":
        vector = vector.cast("array<double>")
    rows = in_small_batches(vectors).select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    classes = classes_of(rows, top)
    # Both sides of this join are plain shuffles, so that a very common vector is split by the session's handling of skewed joins.
    asked = rows.where(is_query).join(classes.select("vector", "class_id"), "vector")
    asked = written(asked.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("query_id"), F.col("class_id").alias("query")), "asked")

    # By length of vectors and exponent of their norm: at most some hundred rows for a table of one dimension.
    stats = classes.groupBy("dim", "band").agg(F.max("length").alias("top"), F.count("*").alias("n"), F.sum(F.size("ids")).alias("n_ids")).collect()
    sizes = {d: sum(r["n"] for r in stats if r["dim"] == d) for d in {r["dim"] for r in stats}}
    greatest = {(r["dim"], r["band"]): r["top"] for r in stats}

    def merged(found: DataFrame) -> DataFrame:
        """The best ``top + 1`` rows of each queried class: query, class_id, score, id, first (of the class's rows with that id)."""
        best = Window.partitionBy("query").orderBy(F.desc("score"), "first_id", "class_id")
        few = found.withColumn("k", F.dense_rank().over(best)).where(F.col("k") <= top + 1).select("query", "class_id", "score").distinct()
        ids = few.join(classes.select("class_id", "ids"), "class_id").select("query", "class_id", "score", "ids", F.posexplode("ids").alias("at", "id"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "class_id", "at")
        ids = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top + 1)
        return written(ids.select("query", "class_id", "score", "id", "at", (F.array_position("ids", F.col("id")) == F.col("at") + 1).alias("first")), "found")

    wanted = classes.join(asked.select(F.col("query").alias("class_id")).distinct(), "class_id", "left_semi")
    plans = measured_plans(classes, wanted, greatest, {d: hash_plan(n, d) for d, n in sizes.items()}, top) if sizes else {}
    members = written(hashed(classes, greatest, plans, False), "members")
    queries = written(hashed(wanted, greatest, plans, True), "probes")
    few = merged(best_in_cells(*cells(members, queries), top))
    drop_written(members, queries)

    # Classes whose queries found fewer rows than there are.
    n_ids = {d: sum(r["n_ids"] for r in stats if r["dim"] == d) for d in sizes}
    exist = classes.sparkSession.createDataFrame([(d, min(top, n - 1)) for d, n in n_ids.items()], "dim int, exist long")
    got = few.groupBy(F.col("query").alias("class_id")).agg((F.count("*") - F.max((F.col("class_id") == F.col("query")).cast("int"))).alias("got"))
    lacking = wanted.select("class_id", "dim").join(F.broadcast(exist), "dim").join(got, "class_id", "left").where(F.coalesce("got", F.lit(0)) < F.col("exist"))
    lacking = written(lacking.select("class_id", "dim"), "lacking")
    if not lacking.isEmpty():
        exact = merged(best_in_cells(*whole_cells(classes, lacking, sizes), top))
        few = few.join(lacking.select(F.col("class_id").alias("query")), "query", "left_anti").unionByName(exact)

    own = (F.col("class_id") == F.col("query")) & (F.col("id") == F.col("query_id")) & F.col("first")
    ranks = Window.partitionBy("row").orderBy(F.desc("score"), "id", "class_id", "at")
    pairs = asked.join(few, "query").where(~own).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top)
    return pairs.select("query_id", "rank", F.col("id").alias(id_col), "score")
