"""Near-duplicate vectors by cosine, found by counting collisions of one-dimensional projections.

1. Equal vectors are one class; a vector that fills a third of the table is one row from here on. Vectors of different dimensions never meet.
2. A class is projected on ``PROJECTIONS`` random lines. Two unit vectors at the threshold's distance d differ by a normal number of deviation d on each
   line, so they collide there, that is, lie in each other's window of half-width ``REACH`` * d, with a known probability, and the number of their
   collisions is binomial. Pairs that collide at least ``least_count`` times are verified: the count that a pair at the threshold reaches with probability
   ``COUNT_RECALL``. Verification is the cosine itself, in double precision.
3. One-dimensional windows alone meet every pair on some line (unrelated vectors are only about three times as far apart as d), so the sorting goes by
   rounds. In a round, ``splits`` further projections, cut in steps of ``STEP`` at random offsets, deal the classes to cells; inside a cell they are sorted by one of the counted
   lines, and each class counts collisions with those in its window. Splits follow the table's size, so that a cell keeps about ``LOAD`` classes met by chance; the
   number of rounds is what a pair at the threshold needs to meet once with probability ``MEET_RECALL``.
4. A cell beyond ``BLOCK`` classes is dealt in blocks by a hash of the class, and every two blocks meet in a task. A pair belongs to the first round in which it
   meets, which both rows tell by themselves, so links are counted where they are found: a cell gives each class its number of links and one edge, not its pairs.
5. Edges give components (``components.py``).

Defined results: vectors that are null, empty, zero or hold nulls or non-finite components, and rows without an id, link with nothing; rows without an id have a null
component and are kept. Rows that share an id are judged each by its own vector. Repeated rows are links of each other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import in_small_batches
from gridlark.llm.components import components
from gridlark.llm.neighbours import lengths, usable
from gridlark.storage import HOT, drop_written, partitions, spread_join, written

COSINE = 0.9
PROJECTIONS, REACH = 32, 2.0
#: Probabilities with which a pair at the threshold passes the count, and shares a cell and window in some round.
COUNT_RECALL, MEET_RECALL = 0.995, 0.98
#: Width of a split's steps (a projection of unit vectors has deviation 1), and classes that should meet in a cell by chance.
STEP, LOAD = 2.0, 2000
#: Classes of a block, and of the rows that are compared with a block at once.
BLOCK, TILE = 2048, 256
#: Cells whose sizes may be broadcast, and cells of a task.
BROADCAST_CELLS, TASK_CELLS = 1_000_000, 64
SEED = 13


def normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def collides(ratio: float) -> float:
    """Probability that a normal number stays within ``ratio`` deviations."""
    return 2 * normal(ratio) - 1


def same_step(ratio: float) -> float:
    """Probability that two projections fall into the same step at a random offset; ratio: the step's width in deviations of their difference."""
    return 1 - 2 * normal(-ratio) - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def distance(cosine: float) -> float:
    return math.sqrt(max(2 - 2 * cosine, 0.0))


def least_count(chance: float) -> int:
    """The greatest count that a binomial number of ``PROJECTIONS`` trials reaches with probability ``COUNT_RECALL``."""
    reached = 0.0
    for k in range(PROJECTIONS, 0, -1):
        reached += math.comb(PROJECTIONS, k) * chance**k * (1 - chance) ** (PROJECTIONS - k)
        if reached >= COUNT_RECALL:
            return k
    return 0


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Splits of a round and rounds, for n classes of one dimension."""
    d = max(distance(cosine), 1e-6)
    splits = max(0, round(math.log(max(n, 1) / LOAD) / -math.log(same_step(STEP / math.sqrt(2))))) if n > LOAD else 0
    meets = same_step(STEP / d) ** splits * (collides(REACH) if splits else 1.0)
    return (splits, math.ceil(math.log(1 - MEET_RECALL) / math.log(1 - meets))) if meets < 1 else (splits, 1)


def on_lines(unit: np.ndarray, kind: int, lines: int) -> np.ndarray:
    """Projections on random lines, added up in order of the coordinates, so that a row's are the same in whatever company it is computed."""
    directions = np.random.default_rng([SEED, unit.shape[1], kind]).standard_normal((unit.shape[1], lines))
    out = np.zeros((len(unit), lines))
    for k in range(unit.shape[1]):
        out += unit[:, k : k + 1] * directions[k]
    return out


def unit_rows(vectors: np.ndarray | list) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / lengths(x)[:, None]


def cells_of(unit: np.ndarray, splits: int, rounds: int) -> np.ndarray:
    """Each row's cell in each round, as a hash of its steps."""
    rng = np.random.default_rng([SEED, unit.shape[1], 1])
    out = np.zeros((len(unit), rounds), np.uint64)
    if splits:
        steps = np.floor((on_lines(unit, 2, splits * rounds) + rng.uniform(0, STEP, splits * rounds)) / STEP).astype(np.int64).view(np.uint64)
        for k in range(splits):
            out = (out ^ steps[:, k::splits]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def placed(classes: DataFrame, plans: dict[int, tuple[int, int]]) -> DataFrame:
    """class, copies, dim, vector, places (its cell in each round)."""
    kind = dict(classes.dtypes)["vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, dims = batch.column(3).to_pylist(), batch.column(2).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                cells = cells_of(unit_rows([vectors[i] for i in at]), *plans[int(dim)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.reshape(-1)))
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=["class", "copies", "dim", "vector", "places"])

    return classes.select("class", "copies", "dim", "vector").mapInArrow(run, f"class long, copies long, dim int, vector {kind}, places array<long>")


KEYS = ["dim", "round", "cell", "low", "high"]


def dealt(members: DataFrame) -> tuple[DataFrame, int]:
    """Members by cell and pair of blocks (KEYS; low <= high), with their own block; and the number of such groups. Cells of one class are left out."""
    keys = ["dim", "round", "cell"]
    flat = members.select("dim", F.posexplode("places").alias("round", "cell"), "class", "copies", "vector", "places")
    sizes = members.select("dim", F.posexplode("places").alias("round", "cell")).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes.select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "cell-sizes")
    n, groups = sizes.agg(F.count("*"), F.coalesce(F.sum(F.expr("blocks * (blocks + 1L) div 2")), F.lit(0))).first()
    rows = flat.join(F.broadcast(sizes) if n <= BROADCAST_CELLS else sizes, keys)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(*keys, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "copies", "vector", "places"), groups


def close_pairs(unit: np.ndarray, lines: np.ndarray, block: np.ndarray, line: int, window: float, least: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (of different blocks, if there are two) that collide on ``line`` and at least ``least`` times in all, and are as near as ``cosine``."""
    order = np.argsort(lines[:, line], kind="stable")
    along = lines[order, line]
    two = block.min() != block.max()
    ahead = np.searchsorted(along, along + window, side="right")  # a class's window reaches both ways; the nearer one of a pair looks ahead
    for start in range(0, len(order), TILE):
        stop = min(start + TILE, len(order))
        end = int(ahead[start:stop].max())
        a, b = order[start:stop], order[start:end]
        counts = np.zeros((len(a), len(b)), np.uint8)
        for k in range(lines.shape[1]):
            counts += np.abs(lines[a, k][:, None] - lines[b, k]) <= window
        fits = counts >= least
        fits &= np.abs(lines[a, line][:, None] - lines[b, line]) <= window
        fits &= np.arange(len(a))[:, None] < np.arange(len(b))
        if two:
            fits &= block[a][:, None] != block[b]
        i, j = np.nonzero(fits)
        i, j = a[i], b[j]
        near = np.concatenate([np.einsum("ij,ij->i", unit[i[x : x + 8192]], unit[j[x : x + 8192]]) for x in range(0, len(i), 8192)] or [np.zeros(0)]) >= cosine
        yield i[near], j[near]


def links_in_cells(rows: DataFrame, groups: int, cosine: float) -> DataFrame:
    """class, links (rows that its rows are linked with here), root (a class that it is linked with directly or by others, for a component's sake)."""
    window = REACH * distance(cosine) if distance(cosine) else 1e-9
    least = least_count(collides(REACH))

    def solved(keys: tuple, blocks: np.ndarray, classes: np.ndarray, copies: np.ndarray, vectors: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        unit, round_ = unit_rows(vectors), keys[1]
        lines = on_lines(unit, 3, PROJECTIONS)
        links, root = np.zeros(len(classes), np.int64), np.arange(len(classes))
        for i, j in close_pairs(unit, lines, blocks, round_ % PROJECTIONS, window, least, cosine):
            for earlier in range(round_):  # a pair belongs to the first round in which it meets
                k = earlier % PROJECTIONS
                met = (places[i, earlier] == places[j, earlier]) & (np.abs(lines[i, k] - lines[j, k]) <= window)
                i, j = i[~met], j[~met]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while (root[i] != root[j]).any():
                low = np.minimum(root[i], root[j])
                np.minimum.at(root, root[i], low)
                np.minimum.at(root, root[j], low)
                while (root[root] != root).any():
                    root = root[root]
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_pydict({"class": classes[at], "links": links[at], "root": classes[root[at]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []

        def flush() -> pa.RecordBatch:
            return solved(held, *(np.concatenate(x) for x in zip(*parts, strict=True)))

        for batch in batches:
            keys = np.stack([batch.column(i).cast(pa.int64()).to_numpy() for i in range(5)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                key, part = tuple(keys[a].tolist()), batch.slice(a, b - a)
                if held is not None and held != key:
                    yield flush()
                    parts = []
                held = key
                vectors, places = (part.column(x).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1) for x in (8, 9))
                parts.append((*(part.column(x).to_numpy() for x in (5, 6, 7)), vectors, places))
        if held is not None:
            yield flush()

    placed_ = rows.select(*KEYS, "block", "class", "copies", "vector", "places").repartition(partitions(rows.sparkSession, groups, TASK_CELLS), *KEYS).sortWithinPartitions(*KEYS)
    return placed_.mapInArrow(run, "class long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: the id under its own name, n_links (other rows linked directly), component_id (least id reachable), kept (it is that row's id)."""
    vector = F.col(f"`{vector_col}`")
    if dict(vectors.dtypes)[vector_col] != "array<float>":
        vector = vector.cast("array<double>")
    rows = in_small_batches(vectors).select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector"))
    takes_part = F.col("id").isNotNull() & usable(F.col("vector"))
    key = F.when(takes_part, F.unhex(F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256)))  # numbers and their texts are one to one
    keyed = written(rows.select("id", key.alias("key"), F.when(takes_part, F.col("vector")).alias("vector")), "vectors")
    grouped = keyed.where("key IS NOT NULL").groupBy("key").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("first_id"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("class"), "*", F.size("vector").alias("dim")), "vector-classes")
    plans = {r["dim"]: plan(r["n"], cosine) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a dimension
    members = written(placed(classes, plans), "places")
    found = written(links_in_cells(*dealt(members), cosine), "vector-links")
    drop_written(members)

    named = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    named = written(named.join(classes.select("class", "first_id"), "class"), "vector-components")
    least = written(named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("k")), "component-names")
    linked = spread_join(named.select("class", "component"), least.drop("k"), ["component"], least.where(F.col("k") > named.count() / HOT))
    degree = found.groupBy("class").agg(F.sum("links").alias("links"))
    of_class = classes.select("class", "key", "copies", "first_id").join(degree, "class", "left").join(linked.select("class", "component_id"), "class", "left")
    of_class = written(of_class.select("key", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")), "vector-classes")
    out = spread_join(keyed.select("id", "key"), of_class.drop("copies"), ["key"], of_class.where(F.col("copies") > keyed.count() / HOT).select("key"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
