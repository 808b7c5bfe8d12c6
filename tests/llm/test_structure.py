"""Prefix tries, turn repair and near-duplicate vectors against brute force on small fixtures."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridlark.llm import collisions, digests, prefix_trie, queries, turn_repair

TURNS = "conv_id long, turn long, role string, text string, KEY string, pos string"


def frame(spark, rows, parts=3):
    """Rows (conv, turn, role, text) with further columns whose names the operators use too."""
    return spark.createDataFrame([(*r, "x", None) for r in rows], TURNS).repartition(parts)


def in_order(rows, none):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, none if role is None else role, none if text is None else text, turn))
    return {c: sorted(ts, key=lambda t: t[:4]) for c, ts in convs.items()}


# Tries


def plain_trie(rows, families=True):
    own = {c: [(t[2], t[3]) for t in ts] for c, ts in in_order(rows, "").items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:h] + ts[h:] if families else ts
    members = defaultdict(set)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = {n: sum(len(x) == len(n) + 1 for x in below[n]) for n in members}
    out = []
    for n, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(full[c]) == len(n))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below[n] if x)
        out.append((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), children[n], sum(children[x] == 0 for x in below[n]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=str)


@pytest.mark.parametrize("seed", range(4))
def test_tries_are_those_of_all_prefixes(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 2 + seed)
    monkeypatch.setattr(prefix_trie, "PIECE", 1 + 3 * seed)
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, 0, 1, 2, 3, 4, 5]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é\U0001f600", None])) for _ in range(150)]
    rows += rows[:9]
    assert trie_rows(prefix_trie.trie(frame(spark, rows))) == plain_trie(rows)
    assert trie_rows(prefix_trie.trie(frame(spark, rows), families=False)) == plain_trie(rows, families=False)


def test_deep_tries_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 50)
    deep = [(c, t, "user", "x" if t < 150 + 10 * c else f"{c}") for c in range(5) for t in range(300 if c else 120)]
    assert trie_rows(prefix_trie.trie(frame(spark, deep), families=False)) == plain_trie(deep, families=False)
    assert trie_rows(prefix_trie.trie(frame(spark, []))) == []
    assert trie_rows(prefix_trie.trie(frame(spark, [(None, 0, "user", "x")]))) == []
    for few in ([(3, 0, "user", "x")], [(3, None, None, None)], [(3, 0, "user", "y" * 300_000), (5, 0, "user", "y" * 300_000)]):
        assert trie_rows(prefix_trie.trie(frame(spark, few))) == plain_trie(few)


def test_a_common_beginning_and_a_common_conversation(spark):
    rows = [(c, t, "user", "same" if t == 0 or c < 40 else f"{c}") for c in range(120) for t in range(3)]
    assert trie_rows(prefix_trie.trie(frame(spark, rows), families=False)) == plain_trie(rows, families=False)


def test_joined_digests_stream(spark):
    rows = [(k, i, "é" * (k + i)) for k in range(5) for i in range(2500 if k == 1 else 3)]
    got = {r["k"]: r["sha256"] for r in digests.joined_sha256(spark.createDataFrame(rows, "k long, i long, s string").repartition(3), "k", ["i"], "s", "|").collect()}
    assert got == {k: hashlib.sha256("|".join(s for j, _, s in rows if j == k).encode()).hexdigest() for k in range(5)}


# Repairs


def plain_edits(codes):
    """(cost, audit) by trying every state's least pair after each turn, inserts included."""
    def inserted(best):
        for _ in range(3):
            for s, (cost, audit) in list(best.items()):
                t = turn_repair.NEXT[s]
                best[t] = min(best.get(t, (10**9, "")), (cost + 3, audit + "I"))
        return best

    best = inserted({0: (0, "")})
    for code in codes:
        out = {}

        def put(s, cost, audit, out=out):
            out[s] = min(out.get(s, (10**9, "")), (cost, audit))

        for s, (cost, audit) in best.items():
            put(s, cost + 4, audit + "D")
            if not code & 4:
                extra = 3 if code & 8 else 0
                put(turn_repair.NEXT[s], cost + 3 + extra, audit + "R")
                if code & 3 == 1 and s == 0 or code & 3 in (2, 3) and turn_repair.NEXT[s] == code & 3:
                    put(code & 3, cost + extra, audit + "K")
        best = inserted(out)
    return min(best[s] for s in (0, 3) if s in best)


def test_every_short_conversation_gets_its_least_audit():
    kinds = [0, 1, 2, 3, 4, 8, 9, 10, 11]
    for n in range(5):
        for codes in itertools.product(kinds, repeat=n):
            assert turn_repair.cheapest(bytes(codes)) == plain_edits(codes)
    rng = random.Random(3)
    for _ in range(200):
        codes = [rng.choice(kinds) for _ in range(rng.randrange(5, 60))]
        assert turn_repair.cheapest(bytes(codes)) == plain_edits(codes)


def test_long_conversations_are_repaired_in_linear_time():
    cost, audit = turn_repair.cheapest(bytes([2, 3] * 100_000))
    assert cost == 0 and audit == "K" * 200_000


def plain_repair(rows):
    """Contract columns of damaged conversations, row by row."""
    damaged = defaultdict(list)
    convs = in_order(rows, " ")
    for c, ts in convs.items():
        for *_, role, text, turn in ts:
            kind = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 1:
                text = ""
            if kind == 2:
                text = "".join(x for x in text if x not in ".!?")
            damaged[c] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for c in convs:
        seen, codes, n, illegal = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}, 0
        for i, (_, role, text) in enumerate(damaged[c]):
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + {"truncated": 8, None: 0}.get(fault, 4))
            illegal += i > 0 and damaged[c][i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        turns = [t for t, _, _ in damaged[c] if t is not None]
        cost, audit = plain_edits(codes)
        lines, i, s = [], 0, 0
        for edit in audit:
            if edit in "RI":
                s = turn_repair.NEXT[s]
            if edit == "K":
                s = codes[i] & 3
            if edit != "D":
                lines.append(f"{damaged[c][i][1] if edit == 'K' else turn_repair.ROLES[s]}:{'' if edit == 'I' else damaged[c][i][2]}")
            i += edit != "I"
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_damaged_conversations_are_repaired_as_row_by_row(spark, tmp_path, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", " \t", "", "Well? \n", None, "z" * 200_000 + ".", "é?", "a. "]
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, *range(9)]), rng.choice(["user", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for _ in range(300)]
    rows += rows[:20]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in queries.turn_repair_query(spark, str(tmp_path)).collect()}
    assert got == plain_repair(rows)


def test_repairs_of_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.turn_repair_query(spark, str(tmp_path)).count() == 0


# Vectors


def plain_links(rows, cosine=0.9):
    sound = [(i, r[0], np.array(r[1], np.float64)) for i, r in enumerate(rows) if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = defaultdict(set)
    for dim in {len(v) for _, _, v in sound}:
        at = [(i, v) for i, _, v in sound if len(v) == dim]
        x = np.array([v / np.abs(v).max() for _, v in at])
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= cosine), strict=True):
            if a != b:
                links[at[a][0]].add(at[b][0])
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        name = min((rows[j][0] for j in seen), key=lambda n: (n is None, n))
        out.append((r[0], len(links[i]), name, r[0] is None or r[0] == name))
    return sorted(out, key=str)


def vector_rows(df):
    return sorted([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()], key=str)


def vectors(spark, rows, kind="array<double>"):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], f"vec_id long, embedding {kind}, class int, `a.b` string").repartition(3)


def test_odd_vectors_link_as_they_should(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, [-1.0, 0.0]), (4, [1.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [None, 1.0]), (10, [inf, 0.0]),
        (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1e300, 1e299, 0.0]), (13, [1e-300, 0.0, 0.0]), (1, [1.0, 0.0]), (14, [0.9, 0.435]), (15, [-0.0, 3.0]), (16, [0.0, 3.0]), (17, [5.0]), (18, [-5.0]),
    ]
    assert vector_rows(collisions.near_vectors(vectors(spark, rows))) == plain_links(rows)
    assert vector_rows(collisions.near_vectors(vectors(spark, []))) == []
    assert vector_rows(collisions.near_vectors(vectors(spark, [(5, None)]))) == [(5, 0, 5, True)]


def planted(n, dim, seed, cosines=(0.9, 0.905, 0.93, 0.97, 0.995)):
    """Unit vectors of which each second one has a neighbour at a planted cosine."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, n - 1, 2):
        c = cosines[i // 2 % len(cosines)] + 1e-9
        side = rng.standard_normal(dim)
        side -= side @ x[i] * x[i]
        x[i + 1] = (c * x[i] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)) * rng.uniform(0.5, 2)
    return x


@pytest.mark.parametrize("n, dim, load", [(600, 64, 2000), (3000, 64, 100), (3000, 300, 100), (9000, 64, 300)])
def test_planted_pairs_are_found_whatever_the_splits(spark, monkeypatch, n, dim, load):
    monkeypatch.setattr(collisions, "LOAD", load)
    x = planted(n, dim, n)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in collisions.near_vectors(vectors(spark, rows)).collect()}
    found = {g: [got[i] for i in range(0, n - 1, 2) if i // 2 % 5 == g] for g in range(5)}
    assert min(np.mean(np.array(found[g]) >= 1) for g in (0, 1)) >= 0.93  # at the threshold itself
    assert min(np.mean(np.array(found[g]) >= 1) for g in (3, 4)) >= 0.995
    assert max(map(max, found.values())) <= 1 and np.mean([k >= 1 for f in found.values() for k in f]) >= 0.96


@pytest.mark.parametrize("load, block", [(2000, 2048), (50, 2048), (2000, 40), (50, 7)])
def test_dense_groups_are_counted_once_in_any_blocks(spark, monkeypatch, load, block):
    monkeypatch.setattr(collisions, "LOAD", load)
    monkeypatch.setattr(collisions, "BLOCK", block)
    monkeypatch.setattr(collisions, "TILE", 16)
    rng = np.random.default_rng(5)
    centre, other = rng.standard_normal(32), rng.standard_normal(32)
    rows = [(i, (centre + 0.05 * rng.standard_normal(32)).tolist()) for i in range(150)] + [(200 + i, other.tolist()) for i in range(90)]
    rows += [(400 + i, rng.standard_normal(32).tolist()) for i in range(200)]
    assert vector_rows(collisions.near_vectors(vectors(spark, rows))) == plain_links(rows)


def test_counts_and_rounds_follow_the_threshold():
    assert collisions.least_count(1.0) == collisions.PROJECTIONS and collisions.least_count(collisions.collides(collisions.REACH)) == 27
    assert collisions.plan(0, 0.9) == collisions.plan(2000, 0.9) == (0, 1)
    splits, rounds = zip(*(collisions.plan(n, 0.9) for n in (10**4, 10**5, 10**6, 10**7)), strict=True)
    assert sorted(splits) == list(splits) and sorted(rounds) == list(rounds) and rounds[-1] < 100


def test_candidates_grow_slower_than_pairs(spark):
    """Classes met in a cell by chance, per class and all rounds: far fewer than all, and their share falls."""
    share = []
    for n in (4000, 16000, 64000):
        unit = collisions.unit_rows(np.random.default_rng(1).standard_normal((n, 64)))
        splits, rounds = collisions.plan(n, 0.9)
        cells = collisions.cells_of(unit, splits, rounds)
        met = sum((np.unique(cells[:, r], return_counts=True)[1].astype(float) ** 2).sum() for r in range(rounds)) / n
        share.append(met / n)
    assert share[2] < share[1] and share[2] < 0.5


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_turn_repair", "op13_near_vectors"])
def test_query_agrees_with_sql(spark, name):
    import __spark_entry__ as entry
    import oracle_compare

    ours, theirs, more, less, n = oracle_compare.differences(spark, entry.queries()[name], entry.oracle_sql()[name], f"{oracle_compare.DATA}/sf0.001")
    assert ours == theirs and not more and not less and n


def test_plans_have_no_cross_join(spark):
    rows = vectors(spark, [(i, [1.0, float(i)]) for i in range(20)])
    text = collisions.near_vectors(rows)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
