"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

1. Every whole text becomes a set of word shingles, a digest of the set and a sketch (``sketch.py``). Equal sets form one
   class with a number of its own; only classes go on, so copies cost one row each.
2. Bands of the sketch are keys. A class in a bucket with others is compared with the bucket's least class (a star, so a
   bucket of n costs n - 1 pairs), on the full sets of the texts' own words; links give components.
3. A bucket whose classes lie in several components still holds pairs that nobody compared. Its members outside the bucket's main
   component are compared with all its members, in blocks of a bounded number of rows and shingles, by exact counts of common
   shingles; what may reach the threshold is verified as before. Buckets with equal members are compared once. Then the
   components are final, and each is named by the least doc_id of its documents.

With ``ROWS`` coordinates a band and ``BANDS`` bands, a pair at the threshold of 0.8 shares no bucket with a probability of
(1 - 0.8 ** 6) ** 46 = 8e-7. That is the only source of a missed link, as long as no two shingles of a text have the same 64-bit hash.

Pairs, buckets and links of a class with very many of them are dealt over all tasks: by ranges (``verified``), in blocks, or by a
broadcast of the one row that they meet (``spread_join``).

Defined results: null or word-less texts have an empty set and are linked with nothing. Rows with a null doc_id are linked
with nothing either, have a null component_id and are kept. Repeated rows give repeated results; rows that share a
doc_id but not a text are judged each by its own text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm import sketch
from gridlark.llm.common import in_small_batches
from gridlark.llm.components import components
from gridlark.storage import HOT, PART, drop_written, observed, partitions, ranged, spread_join, written

ROWS, BANDS = 6, 46
#: Words in a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 5, 80
#: Members, and queries, of a block in step 3, about: so many, or so many shingles.
BLOCK, BLOCK_SHINGLES = 600, 1 << 20
#: Pairs of a task that verifies them, and blocks of a task that compares them.
TASK_PAIRS, TASK_BLOCKS = 20_000, 64
#: Ids that a join may broadcast (8 MB); beyond that it shuffles.
BROADCAST_IDS = 1_000_000
#: Texts that are sketched at once: so many, or so many characters.
GROUP, GROUP_CHARS = 512, 1 << 18

SKETCHED = "doc_id long, text_key long, n_shingles long, hi long, lo long, bands array<long>"


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Spans of a list that are handled at once, so that a few long texts don't add up."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and (i - first >= GROUP or size + len(t or "") > GROUP_CHARS):
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def sketched(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a hash of the text, size and digest of its shingle set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in groups(texts):
                grams, starts = sketch.shingles(texts[a:b], shingle)
                hi, lo = sketch.set_digests(grams, starts)
                keys = sketch.bands(sketch.sketches(grams, starts, ROWS * BANDS), ROWS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(starts)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), lists], names=["doc_id", "text_key", "n_shingles", "hi", "lo", "bands"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, SKETCHED)


def texts_of(docs: DataFrame, classes: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """id, text of each of the n (written) classes: from the row that its doc_id and text_key name. By broadcast if they are few, else by a shuffle."""
    wanted = classes.select("id", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(text).alias("_key"), text.alias("text"))
    found, seen = observed(rows.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, ["_id", "_key"]).select("id", "text"), "texts", rows=F.count("*"))
    if seen["rows"] == n:
        return found
    once = written(found.groupBy("id").agg(F.first("text").alias("text")), "texts")  # some of these rows are repeated
    drop_written(found)
    return once


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, k: int) -> frozenset:
    """The set itself, of tuples of words."""
    words = words_of(text)
    if len(words) <= k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(k)), strict=False))


def verified(pairs: DataFrame, most: int, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b), at ``most`` so many, whose full sets are similar enough; texts has id and text.

    Tasks take ranges of pairs, so a class with very many partners is dealt over several, and its own text travels once a range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: frozenset = frozenset()
        for batch in batches:
            keep = []
            for b, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = shingle_set(text, shingle)
                if b is None:  # comes before the partners of its class
                    head = own
                    keep.append(False)
                else:
                    common = len(head & own)
                    keep.append(common > 0 and 100 * common >= percent * (len(head) + len(own) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    dealt = ranged(pairs, "a", "b", rows_each=TASK_PAIRS, most=most)
    heads = dealt.select(PART, "a").distinct().join(texts.withColumnRenamed("id", "a"), "a").select(PART, "a", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(dealt.join(texts.withColumnRenamed("id", "b"), "b").select(PART, "a", "b", "text"))
    n = partitions(texts.sparkSession, dealt.count(), TASK_PAIRS)
    placed = rows.repartition(n, PART).sortWithinPartitions(PART, "a", F.col("b").asc_nulls_first())
    found = written(placed.select("a", "b", "text").mapInArrow(run, "a long, b long"), "links")
    drop_written(dealt)
    return found


def spread_buckets(members: DataFrame) -> DataFrame:
    """Buckets that span several components: bucket, m (members), main (their component with most members), n_blocks, n_chunks.

    Of buckets with equal members one is enough.
    """
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit("y"))).alias("y"))
    stats = sizes.groupBy("bucket").agg(
        F.sum("k").alias("m"), F.sum("w").alias("w"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count("*").alias("comps"), F.max(F.struct("k", "comp", "w")).alias("main")
    )
    blocks_ = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("w") / BLOCK_SHINGLES))
    chunks = F.ceil(F.greatest((F.col("m") - F.col("main.k")) / BLOCK, (F.col("w") - F.col("main.w")) / BLOCK_SHINGLES))
    row = F.struct("bucket", "m", F.col("main.comp").alias("main"), blocks_.alias("n_blocks"), chunks.alias("n_chunks"))
    return stats.where("comps > 1").groupBy("m", "x", "y").agg(F.min(row).alias("row")).select("row.*")


def blocks(members: DataFrame, total: int, spread: DataFrame) -> DataFrame:
    """Deals buckets that span several components to blocks.

    members: bucket, id, n, comp, ``total`` rows. Returns bucket, chunk, block, id, comp, is_query, is_member: within a block every query is to be
    compared with every member of another component. Queries are the members outside the bucket's main component, in chunks;
    members are in blocks; each chunk meets each block once.
    """
    hot = spread.where(F.col("m") > total / HOT)
    rows = spread_join(members, spread.drop("m"), ["bucket"], hot).withColumn("q", F.col("comp") != F.col("main"))
    block, chunk = F.pmod(F.xxhash64("id"), "n_blocks"), F.pmod(F.xxhash64("id", "bucket"), "n_chunks")

    def place(c, b, q, m):
        return F.struct(c.cast("long").alias("chunk"), b.cast("long").alias("block"), q.alias("is_query"), m.alias("is_member"))

    one = F.array(place(F.lit(0), F.lit(0), F.col("q"), F.lit(True)))
    as_member = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1), lambda c: place(c, block, F.lit(False), F.lit(True)))
    as_query = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1), lambda b: place(chunk, b, F.lit(True), F.lit(False)))
    single = (F.col("n_blocks") == 1) & (F.col("n_chunks") == 1)
    dealt = rows.withColumn("to", F.explode(F.when(single, one).when(F.col("q"), F.concat(as_member, as_query)).otherwise(as_member)))
    return dealt.select("bucket", "to.*", "id", "comp")


def close_in_block(ids, comps, queries, members, sets, sizes, percent: int) -> list[tuple[int, int]]:
    """Pairs of a query and a member of another component whose sets may reach the threshold.

    Sets are known by 32 bits of each hash. Where such bits coincide inside a set it looks smaller than it is (``sizes``), and two sets
    have at most the lesser of their two differences more in common than is seen.
    """
    who = np.flatnonzero(members)
    if not len(who):
        return []
    flat = np.concatenate([sets[i] for i in who])
    owner = np.repeat(np.arange(len(who)), [len(sets[i]) for i in who])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    hidden = sizes - np.array([len(s) for s in sets])
    out = []
    for q in np.flatnonzero(queries):
        low, high = np.searchsorted(flat, sets[q]), np.searchsorted(flat, sets[q], side="right")
        spans = high - low
        hits = np.repeat(low - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
        common = np.bincount(owner[hits], minlength=len(who)) + np.minimum(hidden[q], hidden[who])
        near = (100 * common >= percent * (sizes[q] + sizes[who] - common)) & (comps[who] != comps[q])
        out += [(min(ids[q], ids[who[j]]), max(ids[q], ids[who[j]])) for j in np.flatnonzero(near)]
    return out


def close_pairs(dealt: DataFrame, n_blocks: int, texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, int]:
    """Distinct pairs (a, b) from all blocks that may reach the threshold, and their number."""
    where = ["bucket", "chunk", "block"]

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            for a, b in groups(rows):
                grams, starts = sketch.shingles(rows[a:b], shingle)
                low = (grams >> np.uint64(32)).astype(np.uint32)
                data = [np.unique(low[x:y]).tobytes() for x, y in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(data, pa.binary()), pa.array(np.diff(starts))], names=["id", "grams", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            _, ids, comps, queries, members, data, sizes = zip(*held, strict=True)
            found = close_in_block(ids, np.array(comps), np.array(queries), np.array(members), [np.frombuffer(x, np.uint32) for x in data], np.array(sizes, np.int64), percent)
            found = sorted(set(found))
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(zip(*columns[:3], strict=True), *columns[3:], strict=True):
                if held and held[0][0] != row[0]:
                    yield flush()
                    held.clear()
                held.append(row)
        if held:
            yield flush()

    sets = written(texts.select("id", "text").mapInArrow(to_sets, "id long, grams binary, n long"), "sets")
    n = partitions(dealt.sparkSession, n_blocks, TASK_BLOCKS)
    rows = dealt.join(sets, "id").select(*where, "id", "comp", "is_query", "is_member", "grams", "n")
    sorted_ = rows.repartition(n, *where).sortWithinPartitions(*where)
    found, seen = observed(sorted_.mapInArrow(compare, "a long, b long").distinct(), "close", rows=F.count("*"))
    drop_written(sets)
    return found, seen["rows"]


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least doc_id of its component), kept (it is that document).

    If asked for, also text_key and comp, a number of the component (null for rows that are linked with nothing by definition).
    """
    digest = ["hi", "lo", "n_shingles"]
    rows, of_rows = observed(sketched(in_small_batches(docs), shingle, id_col, text_col), "sketches", n=F.count("*"))
    named = rows.where("doc_id IS NOT NULL").groupBy(*digest).agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    named = named.select(F.monotonically_increasing_id().alias("id"), *digest, "first.*", "copies", "bands")
    classes, of_classes = observed(named, "classes", n=F.count("*"), most=F.max("copies"))
    keyed = classes.where("n_shingles > 0").select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    centres = keyed.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("c"), F.count("*").alias("m")).where("m > 1")
    centres, of_centres = observed(centres.select("bucket", F.col("c.id").alias("centre"), F.col("c.n").alias("centre_n"), "m"), "centres", most=F.max("m"))
    many = of_classes["n"] * BANDS / HOT
    hot = centres.where(F.col("m") > many) if of_centres["most"] > many else None
    shared, of_shared = observed(spread_join(keyed, centres.drop("m"), ["bucket"], hot), "buckets", n=F.count("*"))

    involved = classes.select("id", "doc_id", "text_key").join(shared.select("id").distinct(), "id", "left_semi")
    involved, of_involved = observed(involved, "involved", n=F.count("*"))
    texts = texts_of(docs, involved, of_involved["n"], id_col, text_col)

    likely = shared.where("id > centre").where(100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n"))
    links = verified(likely.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), of_shared["n"], texts, shingle, percent)
    first = components(links)

    members = shared.select("bucket", "id", "n").join(first.withColumnRenamed("node", "id"), "id", "left")
    members = written(members.select("bucket", "id", "n", F.coalesce("component", "id").alias("comp")), "members")
    spread, of_spread = observed(spread_buckets(members), "spread", blocks=F.sum(F.col("n_blocks") * F.col("n_chunks")))
    last = first
    if of_spread["blocks"]:
        close, n_close = close_pairs(blocks(members, of_shared["n"], spread), of_spread["blocks"], texts, shingle, percent)
        if n_close:
            more = verified(close, n_close, texts, shingle, percent)
            if not more.isEmpty():  # the components so far are stars, which are linked on
                last = components(first.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
    drop_written(centres, shared, involved, texts, members, spread)

    numbered = last.withColumnRenamed("node", "id").join(classes.select("id", "doc_id"), "id")
    least = numbered.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k"))
    least, of_least = observed(least, "component-names", total=F.sum("k"), most=F.max("k"))
    hot = least.where(F.col("k") > of_least["total"] / HOT) if of_least["most"] > of_least["total"] / HOT else None
    linked = spread_join(numbered.select("id", "component"), least.drop("k"), ["component"], hot)
    of_class = classes.select(*digest, "id", "doc_id", "copies").join(linked, "id", "left")
    of_class = of_class.select(*digest, "copies", F.coalesce("component", "id").alias("comp"), F.coalesce("component_id", "doc_id").alias("of_class"))
    of_class = written(of_class, "components")
    plain = rows.select("doc_id", "text_key", *digest)
    hot = of_class.where(F.col("copies") > of_rows["n"] / HOT) if of_classes["most"] > of_rows["n"] / HOT else None
    out = spread_join(plain, of_class.drop("copies"), digest, hot, "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("of_class")).alias("component_id"), "text_key", F.when(~alone, F.col("comp")).alias("comp"))
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), *(["text_key", "comp"] if with_key else []))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which each component keeps one: that of its least doc_id.

    Rows that are equal in id and text count as copies too; of several texts of a component under its least doc_id, that with the least
    hash stays. Rows without words or without an id all stay.
    """
    found = near_duplicates(docs, shingle, percent, id_col, text_col, with_key=True)
    judged = written(found.where("comp IS NOT NULL").groupBy("comp", "doc_id", "text_key").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")), "judged")
    several = judged.where("kept").groupBy("comp").agg(F.min("text_key").alias("first_key"), F.count("*").alias("texts")).where("texts > 1").drop("texts")
    kept = judged.where("kept").join(several, "comp", "left").withColumn("kept", F.col("first_key").isNull() | (F.col("first_key") == F.col("text_key"))).drop("first_key")
    marked = kept.unionByName(judged.where("NOT kept")).where("NOT kept OR n > 1")
    marked = written(marked.select(F.col("doc_id").alias("marked_id"), F.col("text_key").alias("marked_key"), "kept"), "marked")
    few, copies = marked.count() <= BROADCAST_IDS, marked.where("kept").count()
    marked = F.broadcast(marked) if few else marked
    on = (F.col(f"`{id_col}`").cast("long") == marked["marked_id"]) & (F.xxhash64(F.col(f"`{text_col}`")) == marked["marked_key"])
    single = docs.join(marked, on, "left_anti")
    if not copies:
        return single
    return single.unionByName(docs.join(marked.where("kept"), on, "left_semi").dropDuplicates([id_col, text_col]))
