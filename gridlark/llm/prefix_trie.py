"""The trie of conversation prefixes, with sums over subtrees by heavy-path decomposition.

1. The first turns of a conversation may be those of another one (``rebuilt``). Each prefix gets a key, the digest of the prefix before it and of its last
   turn, while conversations stream through their sorted partitions; texts go no further than this.
2. Equal keys are one node. Its members are counted by partial aggregates, so a first turn that a third of all conversations share costs a row a task.
3. A node's heavy child is the one with most members (of equal ones that with the least member). So a path from the root has at most log2(members) light
   steps. Every heavy path ends in a childless node; its nodes are those of that node's least member from the last light step on.
4. Sums over subtrees are suffix sums along the paths' arrays. Paths are taken by their number of light steps from the root, most first: a
   path's total is added at the parent of its top, which lies on a path with one light step less. So there are at most log2(members) + 1 rounds.
   Long paths are arrays of ``SEGMENT`` nodes; a segment takes on the totals of those below it.

Defined results: turns are ordered by turn (null first), then role, then text; null roles and texts are empty; repeated rows are turns of their own;
rows without a conversation id are left out; an empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.common import in_small_batches
from gridlark.llm.digests import joined_sha256
from gridlark.storage import HOT, drop_written, spread_join, written

#: Conversations that share a beginning: families of so many ids; and turns that are taken over at most.
FAMILY, MOST_SHARED = 5, 8
#: Nodes of a path in one array, and ids in one piece of a node's list of members.
SEGMENT, PIECE = 4096, 4096
ROOT = b""
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 0), turn_digest and bytes (of the text in UTF-8) of each turn."""
    rows = turns.select(
        F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ).where("conv IS NOT NULL")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select("conv", (F.row_number().over(order) - 1).alias("pos"), F.unhex(F.sha2(said, 256)).alias("turn_digest"), F.octet_length("text").cast("long").alias("bytes"))


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes over from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % (MOST_SHARED + 1)


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The turns of the rebuilt conversations: the first ones of the family's first conversation, then the own ones behind so many. pos has gaps where that one is shorter."""
    first = turns.where(F.col("conv") % FAMILY == 0).where(F.col("pos") < MOST_SHARED)
    family = F.explode(F.transform(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)), lambda k: F.col("conv") + k))
    heads = first.select(family.alias("to"), "conv", "pos", "turn_digest", "bytes").where(F.col("to") - F.col("to") % FAMILY == F.col("conv"))
    heads = heads.where(F.col("pos") < shared_turns(F.col("to"))).select(F.col("to").alias("conv"), "pos", "turn_digest", "bytes")
    return heads.join(convs, "conv", "left_semi").unionByName(turns.where(F.col("pos") >= shared_turns(F.col("conv"))))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth (from 1), key, parent, bytes, last: every prefix of every conversation of (conv, pos, turn_digest, bytes)."""
    names = ["conv", "depth", "key", "parent", "bytes", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the row before, whose ``last`` isn't known yet

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32()), strict=True)], names=names)

        for batch in batches:
            out = []
            for conv, digest, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                same = held is not None and held[0] == conv
                if held is not None:
                    held[5] = int(not same)
                    out.append(held)
                above, depth = (held[2], held[1] + 1) if same else (ROOT, 1)
                held = [conv, depth, hashlib.sha256(above + digest).digest(), above, size, 1]
            if out:
                yield batch_of(out)
        if held is not None:
            yield batch_of([held])

    dealt = in_small_batches(turns).select("conv", "turn_digest", "bytes", "pos").repartition("conv").sortWithinPartitions("conv", "pos")
    return dealt.mapInArrow(run, "conv long, depth int, key binary, parent binary, bytes long, last int")


def nodes_of(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """key, parent, depth, conv (least member), n (members), bytes, n_children, heavy (the heavy child's key); the root has a null parent."""
    inner = paths.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n"), F.first("bytes").alias("bytes"))
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).where("n > 0")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), "conv", "n", F.lit(0).cast("long").alias("bytes"))
    inner = written(inner, "trie-nodes")
    below = inner.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.max_by("key", F.struct("n", -F.col("conv"))).alias("heavy"))
    nodes = written(inner.unionByName(root).join(below, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    drop_written(inner)
    return nodes


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv and light (whether it isn't its parent's heavy child; never for the root)."""
    up = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"), F.col("heavy").alias("chosen"), "n_children")
    both = spread_join(nodes, up.drop("n_children"), ["parent"], up.where(F.col("n_children") > nodes.count() / HOT), "left")
    return both.select(*nodes.columns, "parent_conv", F.coalesce(F.col("key") != F.col("chosen"), F.lit(False)).alias("light"))


def heavy_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """key, path (a conversation), steps (light ones from the root), depth, up (the parent, only at the path's top), n_children, own (the node's own saving)."""
    ends = nodes.where("n_children = 0").select("conv")
    rows = paths.select("conv", "key").join(ends, "conv", "left_semi")
    facts = nodes.select("key", "parent", "depth", "n_children", F.col("light").cast("int").alias("light"), ((F.col("n") - 1) * F.col("bytes")).alias("own"))
    flagged = spread_join(rows, facts, ["key"], nodes.where(F.col("n") > paths.count() / HOT).select("key"))
    root = nodes.where("parent IS NULL").select("key", "n_children")
    whole = Window.partitionBy("conv")
    flagged = flagged.withColumns({"steps": F.sum("light").over(whole), "top": F.coalesce(F.max(F.when(F.col("light") == 1, F.col("depth"))).over(whole), F.lit(0))})
    inner = flagged.where(F.col("depth") >= F.col("top"))
    inner = inner.select("key", F.col("conv").alias("path"), F.col("steps").cast("int").alias("steps"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).alias("up"), "n_children", "own")
    inner = written(inner.sortWithinPartitions("steps"), "heavy-paths")  # a round then skips most row groups
    main = inner.where("steps = 0").select("path").first()
    head = root.select("key", F.lit(main["path"] if main else 0).cast("long").alias("path"), F.lit(0).alias("steps"), F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("up"), "n_children", F.lit(0).cast("long").alias("own"))
    return inner.unionByName(head)


def suffix_sums(rows: DataFrame) -> DataFrame:
    """key, up, n_leaves, saved: sums of the columns a and b over the path's nodes from this one to the path's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            sums = []
            for name, below in (("a", 1), ("b", 2)):
                run_ = np.concatenate(([0], np.cumsum(flat.field(name).to_numpy(zero_copy_only=False))))
                sums.append(run_[1:] + np.repeat(batch.column(below).to_numpy(zero_copy_only=False) - run_[starts], sizes))
            yield pa.RecordBatch.from_arrays([flat.field("key"), flat.field("up"), *(pa.array(s, pa.int64()) for s in sums)], names=["key", "up", "n_leaves", "saved"])

    deepest_first = F.struct((-F.col("depth")).alias("at"), "key", "up", "a", "b")
    arrays = rows.groupBy("path", F.expr(f"depth div {SEGMENT}").alias("segment")).agg(F.sort_array(F.collect_list(deepest_first)).alias("nodes"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    lower = Window.partitionBy("path").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    arrays = arrays.select("nodes", *[F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"below_{c}") for c in "ab"])
    return in_small_batches(arrays).mapInArrow(run, "key binary, up binary, n_leaves long, saved long")


def subtree_sums(placed: DataFrame) -> DataFrame:
    """key, n_leaves, saved: sums over each node's subtree."""
    most = placed.agg(F.max("steps")).first()[0]
    done, attached = [], None
    for steps in range(most or 0, -1, -1):
        rows = placed.where(F.col("steps") == steps).select("key", "path", "depth", "up", (F.col("n_children") == 0).cast("long").alias("a"), F.col("own").alias("b"))
        if attached is not None:
            rows = rows.join(attached, "key", "left").select("key", "path", "depth", "up", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in "ab"])
        sums = written(suffix_sums(rows), "path-sums")
        attached = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("more_a"), F.sum("saved").alias("more_b"))
        done.append(sums.drop("up"))
    out = done[0]
    for sums in done[1:]:
        out = out.unionByName(sums)
    return out


def members_digests(ends: DataFrame) -> DataFrame:
    """key, sha256 of the ids of the conversations that end there, ascending. ends: key, conv. Ids are sorted and shown in pieces of a bounded size first."""
    shown = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("key", F.expr(f"floor(conv / {PIECE})").alias("piece")).agg(shown.alias("ids"))  # a conversation ends once
    return joined_sha256(pieces, "key", ["piece"], "ids", ",")


def trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", families: bool = True) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    families: conversations are rebuilt with the beginnings of their family's first one (``rebuilt``); otherwise they are taken as they are.
    """
    own = written(numbered(turns, id_col, turn_col, role_col, text_col), "turns")
    convs = written(own.select("conv").distinct(), "conversations")
    paths = written(prefixes(rebuilt(own, convs) if families else own), "prefixes")
    drop_written(own)
    found = nodes_of(paths, convs)
    nodes = written(with_parents(found), "trie-nodes")
    drop_written(found)
    sums = subtree_sums(heavy_paths(nodes, paths))
    silent = convs.join(paths.where("last = 1").select("conv"), "conv", "left_anti").select(F.lit(ROOT).alias("key"), "conv")
    ends = members_digests(paths.where("last = 1").select("key", "conv").unionByName(silent))
    return nodes.join(sums, "key").join(ends, "key", "left").select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("n_children").cast("long").alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
