"""Repair of conversations whose turns are blank, doubled, cut short or out of order, by cheapest edits.

1. ``measured``: faults, gaps and illegal neighbours of each turn by windows over its conversation; of a turn only one byte goes on (what may be done with it).
2. ``cheapest``: the edits are a shortest path. A node is (turns read, state of the accepted order of roles); arcs keep, rerole or delete the next turn or
   insert one. Costs are small integers, so Dial's queue of a few buckets, used in turn, finds every node's distance to the end. Then the walk from the start takes,
   among the arcs on shortest paths, the one whose initial comes first; an initial leads to one node only, so the walk is the least audit.
3. ``repaired_turns``: turns stream past their conversation's audit in sorted partitions and come out repaired.

A conversation costs its task about 100 bytes a turn in step 2, whatever its texts' lengths; step 3 holds one batch.

Accepted orders of roles: nothing, or an optional system turn, then one or more pairs of user and assistant. A role is known by its first letter.

Defined results: null roles, texts and turns count as one space (a null turn comes first); rows without a conversation id are left out; turns are
ordered by turn, then role, then text; repeated rows are duplicates. A conversation of which nothing is left is repaired to nothing. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.common import in_small_batches

#: Costs of edits, and what a truncated turn adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
KEPT = 0
#: Buckets that are in use at once: the greatest cost of an arc and one more.
BUCKETS = max(DELETE, INSERT, REROLE + TRUNCATED) + 1
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: States: nothing yet, after a system turn, after a user's, after an assistant's. ``NEXT``: where each takes on a user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
BEFORE = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LETTERS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: A turn's byte: the state its role leads to, and flags.
FAULTY, CUT = 4, 8


def measured(turns: DataFrame) -> DataFrame:
    """turns (conv, pos, turn, role, text) with fault (blank, duplicate, truncated or null), code (the turn's byte), illegal and fresh (a turn number not met before)."""
    order = Window.partitionBy("conv").orderBy("pos")
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = turns.withColumns({"_said": said, "_end": F.right(bare, F.lit(1)), "initial": F.substring("role", 1, 1)})
    rows = rows.withColumn("_seen", F.row_number().over(Window.partitionBy("conv", "_said").orderBy("pos")) > 1)
    before = F.lag("initial").over(order)
    fresh = F.col("turn").isNotNull() & ~F.lag("turn").over(order).eqNullSafe(F.col("turn"))
    fault = F.when(F.col("_end") == "", "blank").when(F.col("_seen"), "duplicate").when(~F.col("_end").isin(*ENDS), "truncated")
    rows = rows.withColumns({"fault": fault, "illegal": before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au"), "fresh": fresh})
    state = F.when(F.col("initial") == "s", SYSTEM).when(F.col("initial") == "u", USER).when(F.col("initial") == "a", ASSISTANT).otherwise(START)
    flags = F.when(F.col("fault").isin("blank", "duplicate"), FAULTY).when(F.col("fault") == "truncated", CUT).otherwise(0)
    return rows.withColumn("code", (state + flags).cast("byte")).drop("_said", "_end", "_seen", "initial")


def distances(codes: bytes) -> list[int]:
    """Each node's least cost to the end; node 4 * i + s is state s after i turns. Every node has one: all turns can be deleted and what lacks inserted."""
    n = len(codes)
    far = 1 << 60
    dist = [far] * (4 * (n + 1))
    buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
    for s in (START, ASSISTANT):
        dist[4 * n + s] = 0
        buckets[0].append(4 * n + s)
    now, waiting = 0, 2

    def reach(node: int, cost: int) -> int:
        if cost >= dist[node]:
            return 0
        dist[node] = cost
        buckets[cost % BUCKETS].append(node)
        return 1

    while waiting:
        bucket = buckets[now % BUCKETS]
        if not bucket:
            now += 1
            continue
        node = bucket.pop()
        waiting -= 1
        if dist[node] != now:
            continue  # found again nearer, and done then
        i, s = divmod(node, 4)
        if s in ROLES:
            for p in BEFORE[s]:
                waiting += reach(4 * i + p, now + INSERT)
        if i:
            code, row = codes[i - 1], 4 * (i - 1)
            waiting += reach(row + s, now + DELETE)
            if not code & FAULTY and s != START:
                extra = TRUNCATED if code & CUT else 0
                for p in BEFORE[s]:
                    if code & 3 == s:
                        waiting += reach(row + p, now + KEPT + extra)
                    elif s in ROLES:
                        waiting += reach(row + p, now + REROLE + extra)
    return dist


def cheapest(codes: bytes) -> tuple[int, str]:
    """The least cost of edits, and the ASCII-least audit of that cost: D, I, K or R for each edit in order."""
    dist, n = distances(codes), len(codes)
    i, s, audit = 0, START, []
    while i < n or dist[4 * i + s]:
        left = dist[4 * i + s]
        code = codes[i] if i < n else FAULTY
        extra = TRUNCATED if code & CUT else 0
        if i < n and dist[4 * (i + 1) + s] + DELETE == left:
            audit.append("D")
            i += 1
        elif dist[4 * i + NEXT[s]] + INSERT == left:
            audit.append("I")
            s = NEXT[s]
        elif not code & FAULTY and s in BEFORE.get(code & 3, ()) and dist[4 * (i + 1) + (code & 3)] + KEPT + extra == left:
            audit.append("K")
            i, s = i + 1, code & 3
        else:
            audit.append("R")
            i, s = i + 1, NEXT[s]
    return dist[START], "".join(audit)


def edits(flags: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of ``measured`` turns."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            lists = batch.column(len(names))
            for k in range(batch.num_rows):
                found.append(cheapest(lists[k].values.to_numpy(zero_copy_only=False).astype("int8").tobytes()))
            costs, audits = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=[*names, "cost", "audit"])

    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("fresh"), F.lit(0)).cast("long").alias("gaps")
    codes = F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda c: c["code"]).alias("codes")
    grouped = flags.groupBy("conv").agg(gaps, *counts, F.count_if("illegal").alias("illegal"), codes)
    return in_small_batches(grouped).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "cost"]) + ", audit string")


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, at (from 0), edit, role, text of the repaired turns. turns: conv, pos, role, text; audits: conv, audit, of every one of their conversations."""
    names = ["conv", "at", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, step, s, at = "", 0, START, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, pos, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if pos < 0:  # the audit comes before its conversation's turns
                    audit, step, s, at = text, 0, START, 0
                else:
                    edit = audit[step]
                    step += 1
                    if edit == "K":
                        s = LETTERS[role[0]]
                        out.append((conv, at, edit, role, text))
                    elif edit == "R":
                        s = NEXT[s]
                        out.append((conv, at, edit, ROLES[s], text))
                    at += edit != "D"
                while step < len(audit) and audit[step] == "I":
                    s, step = NEXT[s], step + 1
                    out.append((conv, at, "I", ROLES[s], ""))
                    at += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=names)

    first = audits.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = in_small_batches(turns).select("conv", F.col("pos").cast("long").alias("pos"), "role", "text").unionByName(first)
    return both.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(run, "conv long, at long, edit string, role string, text string")


def ordered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: Column | None = None) -> DataFrame:
    """conv, pos, turn, role, text of each turn in its conversation's order.

    damage: a kind of damage by number, as an expression of conv and turn, for tests of repairs: 0 drops the row, 1 empties its text, 2 removes its
    sentences' ends, 3 repeats it, 4 makes it the user's.
    """
    rows = turns.select(
        F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"),
    ).where("conv IS NOT NULL")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    if damage is None:
        return rows.select("conv", F.row_number().over(Window.partitionBy("conv").orderBy(*order)).cast("long").alias("pos"), "turn", "role", "text")
    kind = F.col("_kind")
    rows = rows.withColumn("_kind", damage).withColumn("_first", F.row_number().over(Window.partitionBy("conv").orderBy(*order)))
    rows = rows.where(kind != 0).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.when(kind == 3, 1).otherwise(0))))
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", (2 * F.col("_first") + F.col("_copy")).cast("long").alias("pos"), "turn", role.alias("role"), text.alias("text"))
