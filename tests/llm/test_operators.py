"""Pieces, neighbours, language, near duplicates, personal data, media, chat, URL rules and the pipeline against plain versions."""

import functools
import hashlib
import io
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm import chat_format, components, language, media, near_dup, neighbours, pieces, pii, queries, url_filter

SF = "/root/testdata/sf0.001"
EXTRA = "key_a string, rank int, hi long"


# SentencePiece


def model():
    return queries.vocabulary_path(queries.PIECE_BPE)


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model())


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_ids_and_texts_are_the_librarys(spark):
    rng = random.Random(4)
    texts = ["", None, "a  b", " x", "\n\tq", "é ́x 漢😀\x00z", "▁a ▁", "<s></s><unk><0x41>", "tion" * 3000, " " * 50, "\r\n" * 40]
    texts += ["".join(rng.choice("aB  1\n\t.'sé́漢😀tionhe▁>") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts + texts[:3])], "doc_id long, text string, ids_crc32 string")
    got = pieces.with_text(pieces.with_ids(rows, model()), model()).collect()
    sp = library()
    assert len(got) == len(texts) + 3
    clash = rows.select("doc_id", "text", F.lit("x").alias("ids"), F.lit("y").alias("decoded"))
    both = pieces.with_text(pieces.with_ids(clash, model()), model(), ids_col="ids_")
    assert both.columns == ["doc_id", "text", "ids", "decoded", "ids_", "decoded_"] and {(r.ids, r.decoded) for r in both.collect()} == {("x", "y")}
    for r in got:
        wanted = sp.encode(r.text or "")
        assert ids(r.ids) == wanted and r.decoded == sp.decode(wanted)
    assert pieces.with_ids(rows.limit(0), model()).count() == 0


def best_score(v, text):
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(max(0, end - v.longest), end):
            k = v.ids.get(text[start:end])
            if k is not None:
                options.append((best[start][0] + v.scores[k], best[start][1] + [k]))
        if not options:
            options = [(best[end - 1][0] + v.unknown_score, best[end - 1][1] + [-1])]
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][0]


@pytest.mark.parametrize("seed", range(5))
def test_unigram_search_finds_the_best_score_and_commits_early(seed):
    rng = random.Random(seed)
    entries = [("<unk>", 0.0, "unknown")] + [(p, -rng.random() * 9, "normal") for p in {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)}]
    v = pieces.Pieces(entries, pieces.UNIGRAM)
    text = "".join(rng.choice("abcd") for _ in range(400))
    found = list(v.search(text))
    assert "".join(text[a:b] for a, b, _ in found) == text
    assert sum(v.scores[k] if k >= 0 else v.unknown_score for _, _, k in found) == pytest.approx(best_score(v, text))
    taken = 0
    watched = Watched(text)
    for start, end, _ in v.search(watched):
        taken += 1
        if taken == 5:
            break
    assert watched.furthest < 200


class Watched(str):
    furthest = 0

    def __getitem__(self, at):
        self.furthest = max(self.furthest, at.stop if isinstance(at, slice) else at)
        return str.__getitem__(self, at)


# Neighbours


def exact(rows, top=20):
    """By query row: (id, score) of its nearest other rows; rows (id, vector), of which some take no part."""
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (q, v) in enumerate(sound):
        if q % 20 == 0:
            scored = [(functools.reduce(lambda t, x: t + x[0] * x[1], zip(v, w), 0.0), i) for k, (i, w) in enumerate(sound) if k != n and len(w) == len(v)]
            out.append((q, [(i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:top]]))
    return sorted((q, k + 1, i, s) for q, found in out for k, (i, s) in enumerate(found))


def found_in(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, F.col("id") % 20 == 0).collect())


def test_small_tables_with_odd_rows_are_answered_in_full(spark):
    rng = random.Random(2)
    grid = [-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 4.0, 64.0]
    rows = [(i, [rng.choice(grid) for _ in range(4)]) for i in range(15)] + [(100 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(6)]
    rows += [(200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 0.0, 0.0]), (280, [float("nan")] * 4), (300, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (340, [7.0] * 9)]
    shared = [(0, [9.0] * 4), (120, [1.0, 1.0, 0.0, 0.0]), (120, [1.0, 1.0, 0.0, 0.0]), (120, [3.0, -1.0, 0.0, 0.0])]
    for table in (rows, rows + shared + rows[:2]):
        df = spark.createDataFrame([(*r, "x", 1, 2) for r in table], "vec_id long, embedding array<float>, " + EXTRA)
        got, wanted = found_in(df), exact(table)
        counts = [sum(r[0] == q for r in got) for q in {r[0] for r in wanted}]
        assert counts == [sum(r[0] == q for r in wanted) for q in {r[0] for r in wanted}]
        assert sum(a == b for a, b in zip(got, wanted)) >= 0.9 * len(wanted)
    assert found_in(df.limit(0)) == []


def test_with_all_buckets_probed_results_are_exact(spark, monkeypatch):
    """Ties, rows that share an id, repeated rows, a vector that many rows have."""
    monkeypatch.setattr(neighbours, "TARGET", 1.0)
    monkeypatch.setattr(neighbours, "measured_plans", lambda classes, queries, greatest, plans, top: {d: (h, 1.0) for d, h in plans.items()})
    rng = random.Random(3)
    grid = [-2.0, -1.0, 0.0, 0.5, 1.0, 4.0]
    rows = [(i % 70, [rng.choice(grid) for _ in range(3)]) for i in range(120)] + [(20 * i, [1.0, 1.0, 0.0]) for i in range(60)] + [(40, [1.0, 1.0, 0.0])] * 30
    assert found_in(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == exact(rows)


@pytest.mark.parametrize("n", [500, 2000, 10000])
def test_recall_on_embeddings_of_several_sizes(spark, n):
    """The table at sf0.1 (2,000 rows), a part of it, and it with mixtures of its rows."""
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect() if r.embedding], np.float64)
    rng = np.random.default_rng(n)
    if n > len(x):
        mixed = rng.normal(size=(n - len(x), 3))[:, :, None] * x[rng.integers(0, len(x), (n - len(x), 3))]
        mixed = mixed.sum(axis=1)
        x = np.concatenate([x, mixed / np.linalg.norm(mixed, axis=1, keepdims=True)])
    x = x[:n]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, F.col("id") % 20 == 0).collect()}
    hits = 0
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += sum((q, int(i)) in got for i in np.argsort(-scores)[:20])
    assert hits >= 0.9 * 20 * len(range(0, len(x), 20))


def test_cells_of_a_hot_bucket_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "CHUNK", 2)
    rng = random.Random(3)
    rows = [(i, [1.0, rng.random() / 100, rng.random() / 100]) for i in range(150)]
    assert found_in(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == exact(rows)


def test_every_query_gets_all_rows_there_are(spark):
    """Few candidates, an antipode and a query on its own side of the others."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=64)
    around = v / np.linalg.norm(v) + 0.02 * rng.normal(size=(40, 64))
    tables = [[(0, v.tolist()), (1, (-v).tolist())], [(20, v.tolist())]]
    tables.append([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(25, 64)))])
    tables.append([(0, (-v).tolist()), *((i + 1, x.tolist()) for i, x in enumerate(around)), (80, [1.0, 2.0]), (81, [2.0, -1.0])])
    for rows in tables:
        got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
        counts = {q: sum(r.query_id == q for r in got) for q, _ in rows if q % 20 == 0}
        assert counts == {q: min(20, sum(len(y) == len(x) for _, y in rows) - 1) for q, x in rows if q % 20 == 0}


def test_recall_holds_with_unequal_lengths(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20000, 64))
    x *= (np.exp(0.25 * rng.normal(size=len(x))) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    asked = range(0, len(x), 100)
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, F.col("id") % 100 == 0).collect()}
    hits = 0
    for q in asked:
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += sum((q, int(i)) in got for i in np.argsort(-scores)[:20])
    assert hits >= 0.9 * 20 * len(asked)


def test_probes_are_the_nearest_axes():
    x = np.random.default_rng(1).normal(size=(5, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(np.linalg.norm(neighbours.rotated(x, 0, 0), axis=1), 1)
    for hashes in (1, 2):
        found = neighbours.probes(x, 3, hashes, 1.0)
        assert (found[:, 0] == neighbours.codes(x, 3, hashes)).all()
        assert all(sorted(f) == list(range(16**hashes)) for f in found.tolist())


@pytest.mark.parametrize("hashes, share", [(1, 0.3), (2, 0.004), (2, 0.2), (3, 0.01)])
def test_probes_of_several_hashes_are_those_of_all_tuples(hashes, share):
    x = np.random.default_rng(hashes).normal(size=(4, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sums, wanted = np.zeros((4, 1)), math.ceil(share * 32**hashes)
    for h in range(hashes):
        y = neighbours.rotated(x, 5, h)
        sums = (sums[:, :, None] + np.concatenate([y, -y], axis=1)[:, None, :]).reshape(4, -1)
    found = neighbours.probes(x, 5, hashes, share)
    assert found.shape == (4, wanted) and all(len(set(f)) == wanted for f in found.tolist())
    assert np.allclose(np.take_along_axis(sums, found, 1), -np.sort(-sums, axis=1)[:, :wanted])


def test_probes_in_a_high_dimension_are_made_in_bounded_memory():
    """768 numbers, two hashes: 4.2 million buckets a table, of which all sums for 256 queries would take 8.6 GB."""
    dim, share = neighbours.padded_dim(768), 0.01
    each = neighbours.at_once(dim, 2, share, 1)
    x = np.random.default_rng(4).normal(size=(each, dim))
    tracemalloc.start()
    found = neighbours.probes(x, 0, 2, share)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.shape == (each, math.ceil(share * (2 * dim) ** 2)) and peak < 256e6
    assert (found[:, 0] == neighbours.codes(x, 0, 2)).all()
    assert neighbours.at_once(dim, 2, 1.0, 3) == 1 and neighbours.at_once(128, 1, 0.05, 1) == neighbours.GROUP


def test_recall_with_two_hashes_in_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LOAD", 2)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24))
    assert neighbours.hash_plan(len(x), 24) == 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, F.col("id") % 20 == 0).collect()}
    hits = 0
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += sum((q, int(i)) in got for i in np.argsort(-scores)[:20])
    assert hits >= 0.9 * 20 * len(range(0, len(x), 20))


# Language


def test_documents_get_their_language(spark):
    got = queries.language_query(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(lang)
    assert sum(r.language == lang[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(r.kept for r in got)


def test_held_out_declarations_are_found_by_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    half = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    true = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in language.identified(half).collect() if r.doc_id % 2]
    assert sum(r.text_language == true[r.doc_id] for r in got) >= 0.95 * len(got)


def test_hosts_and_suffixes_decide_where_texts_cannot(spark):
    en, de = "the and of that with this was for ", "und der die nicht ein mit auf das "
    rows = [(i, en * 5, "en", "a.example.com") for i in range(30)] + [(50 + i, de * 5, "de", "b.example.org") for i in range(30)] + [(90, "q", None, "a.example.com"), (91, "q", None, "b.example.org"), (92, "q", None, "c.new.de"), (93, "q", "de", None)]
    got = {r.id: r for r in language.identified(spark.createDataFrame(rows, "id long, text string, lang string, source string"), "id").collect()}
    assert [got[i].language for i in (90, 91, 93)] == ["en", "de", "de"]
    assert got[5].kept and got[60].kept


def test_rejected_rows_and_odd_tables(spark):
    rows = [(i, "the and of that with " * 9, "en", "s", "x") for i in range(20)] + [(30, None, "en", "s", "x"), (31, "", "en", "s", "x"), (32, "123 ... !!", None, None, None), (None, "the and of", "EN-us", "", "x"), (3, "the and of that with " * 9, "en", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key_a string")
    kept = language.kept_rows(df)
    assert kept.columns == df.columns
    assert sorted(kept.collect(), key=str) == sorted([r for r in df.collect() if r.doc_id not in (30, 31, 32)], key=str)
    assert language.identified(df.limit(0)).count() == 0 and language.kept_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("labelled", [["en"], ["de", "en"], ["de", "en", "es"], ["de", "en", "es", "fr"]])
def test_unlike_texts_are_rejected_whatever_is_labelled(spark, labelled):
    words = {"en": "the and of that with this was for ", "de": "und der die nicht ein mit auf das ", "es": "los que por para una con del está ", "fr": "les que pour dans une avec est pas "}
    rng = random.Random(6)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(60))
    rows = [(10 * i + k, words[l] * 5, l) for i, l in enumerate(labelled) for k in range(5)] + [(90, "русский текст о погоде и реках " * 9, None), (91, "日本語の文章です" * 20, None), (92, noise, None), (93, words["en"] * 3, None)]
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identified(df).collect()}
    assert [got[i].kept for i in (90, 91, 92)] == [False] * 3
    assert got[93].kept and got[93].language == "en" and all(got[10 * i + k].kept for i in range(len(labelled)) for k in range(5))


ITALIAN = ["il tempo della sera non era quello che tutti gli altri avevano detto ", "questa casa sul lago con gli alberi della nostra infanzia ", "perché nessuno sapeva dove andare quando la pioggia cadeva ", "degli anni passati nel paese dei nonni resta soltanto una lettera "]


def test_languages_come_from_the_labels(spark):
    en = "the and of that with this was for a house by the lake where nobody knew what had been said "
    rows = [(i, ITALIAN[i % 4] * 3, "it", "s") for i in range(20)] + [(100 + i, en * 3, "en-GB", "s") for i in range(20)] + [(200, ITALIAN[1] * 2, None, "s"), (201, ITALIAN[2] * 5, "en", "s"), (202, ITALIAN[0] * 3, "und", "s"), (203, en, "  ", None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, key_a string, language string")
    got = {r.doc_id: r for r in language.identified(df).collect()}
    assert all(got[i].language == "it" and got[i].kept for i in range(20)) and all(got[100 + i].language == "en" for i in range(20))
    assert [got[i].language for i in (200, 201, 202, 203)] == ["it", "it", "it", "en"]
    kept = {r.doc_id: r for r in language.kept_rows(df).collect()}
    assert {i: r.lang for i, r in kept.items()} == {**{i: "it" for i in range(20)}, **{100 + i: "en-GB" for i in range(20)}, 200: "it", 201: "it", 202: "it", 203: "en"}
    assert all((r.key_a, r.language) == ("x", "y") for r in kept.values())


def test_languages_without_support_are_judged_by_text_or_taken_at_their_word(spark):
    en = "the and of that with this was for "
    rows = [(i, en * 5, "en", "s") for i in range(5)] + [(9, en * 5, "zz", "s"), (10, "хорошая погода и река " * 9, "ru", "s"), (11, "...", "it", "s"), (12, "хорошая погода и река " * 9, None, "s")]
    got = {r.doc_id: r for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[9].language, got[9].kept) == ("en", True)  # a noise tag isn't fitted on its own row
    assert (got[10].language, got[10].kept, got[10].confidence) == ("ru", True, None) and not got[11].kept and not got[12].kept


def test_many_languages_are_all_told_apart(spark, monkeypatch):
    monkeypatch.setattr(language, "FULL", 16)
    rng = random.Random(8)
    tags = [a + b for a in "abcdefgh" for b in "klmno"]
    words = {t: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(25)] for t in tags}
    rows = [(100 * k + i, " ".join(rng.choice(words[t]) for _ in range(40)), t if i < 10 else None, None) for k, t in enumerate(tags) for i in range(12)]
    got = {r.doc_id: r for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(tags) == 40 and language.buckets_for(40) == language.BUCKETS // 4
    assert all(got[i].language == tags[i // 100] and got[i].kept for i, *_ in rows)


def test_kept_rows_are_ruled_row_by_row_whatever_is_null(spark):
    en, de = "the and of that with this was for ", "und der die nicht ein mit auf das "
    values = [None, "en", "h", "s", "", en * 5]
    rows = [(i, en * 5, "en", "s") for i in range(6)] + [(10 + i, de * 5, "de", "h") for i in range(6)]
    rows += [(100 + i, t, l, h) for i, (t, l, h) in enumerate((t, l, h) for t in values for l in values for h in values)]
    rows += [(400, None, "en", "h"), (401, "en", None, "h"), (402, "en", "h", None)] + rows[-5:]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    ruled = {(r.doc_id, r.kept, r.language) for r in language.identified(df).collect()}
    kept = language.kept_rows(df).collect()
    assert len({i for i, *_ in ruled}) == len(ruled)
    keeps = {i: l for i, k, l in ruled if k}
    assert sorted(r.doc_id for r in kept) == sorted(i for i, *_ in rows if i in keeps)
    before = {i: (t, l, h) for i, t, l, h in rows}
    assert all((r.text, r.source) == before[r.doc_id][::2] and r.lang in (keeps[r.doc_id], before[r.doc_id][1]) for r in kept)


def test_only_letters_of_any_script_count():
    assert language.lettered("“Été” — naïve…") == " été    naïve "
    assert language.lettered("नमस्ते ２०") == "नमस्ते   " and language.lettered("ABC 12") == "abc 12"


def fused(rows):
    """The fusion in plain Python: rows (text, declared tag, host) -> (language, confidence, text language, kept)."""
    def stated(tag):
        m = re.match("^([a-z]{2,3})(?:[-_].*)?$", (tag or "").strip(" ").lower())
        return m[1] if m and m[1] not in language.NO_LANGUAGE else None

    said = [stated(tag) for _, tag, _ in rows]
    names = sorted({t for t in said if t and said.count(t) >= language.SUPPORT}) or sorted(set(filter(None, said)))
    tags = [t if t in names else None for t in said]
    grams = [np.concatenate([*language.trigrams(t), np.zeros(0, np.uint32)]).astype(int) for t, _, _ in rows]
    seen = np.zeros((len(names), language.BUCKETS))
    for tag, found in zip(tags, grams):
        if tag:
            np.add.at(seen[names.index(tag)], found, 1)
    counts = seen + language.ADDED
    model = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    like = np.log((1 - language.UNSEEN) * language.BUCKETS * seen / seen.sum(axis=1, keepdims=True) + language.UNSEEN).astype(np.float32)
    score = np.array([[float(np.sum(m[g], dtype=np.float64)) for m in model] for g in grams])
    likeness = [max(float(np.sum(m[g], dtype=np.float64)) for m in like) for g in grams]

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    p = np.array([softmax(language.TEMPER * s) if len(g) else np.zeros(len(names)) for s, g in zip(score, grams)])
    overall = p.sum(axis=0) + 1
    base = overall / overall.sum()
    hosts = [h or None for _, _, h in rows]
    suffix = lambda h: h.rsplit(".", 1)[1] if h and "." in h else None
    of_host = {h: p[[k for k, x in enumerate(hosts) if x == h]].sum(axis=0) for h in set(hosts) if h}

    def of_suffix(s):
        if s is None:
            return base
        n = sum((of_host[h] for h in of_host if suffix(h) == s), np.zeros(len(names)))
        n = n + np.array([language.SMOOTH if language.SUFFIX_LANGUAGE.get(s) == l else 0.0 for l in names])
        return (n + language.SMOOTH * base) / (n.sum() + language.SMOOTH)

    met = {d: p[[k for k, t in enumerate(tags) if t == d]].sum(axis=0) for d in names}
    joint = np.array([met[d] + language.DECLARED_WEIGHT * np.array([language.HONEST if d == l else (1 - language.HONEST) / (len(names) - 1) for l in names]) for d in names])
    out = []
    for k, (tag, h) in enumerate(zip(tags, hosts)):
        prior = base
        if h:
            others = np.maximum(of_host[h] - p[k], 0)
            prior = (others + language.SMOOTH * of_suffix(suffix(h))) / (others.sum() + language.SMOOTH)
        final = language.TEMPER * score[k] + np.log(prior) + (np.log(joint[names.index(tag)] / joint.sum(axis=0)) if tag else 0)
        sure = softmax(final).max()
        text = names[int(score[k].argmax())] if len(grams[k]) else None
        if said[k] and not tag and not (len(grams[k]) and likeness[k] > 0 and sure >= language.LEAST):
            out.append((said[k], None, None, bool(len(grams[k]))))
            continue
        out.append((names[int(final.argmax())], sure, text, bool(len(grams[k])) and likeness[k] > 0 and sure >= language.LEAST))
    return out


@pytest.mark.parametrize("name", ["op5_language_id", "language_of_pages"])
def test_fusion_agrees_with_a_plain_version(spark, name):
    from gridlark.llm import registry

    if name == "op5_language_id":
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    else:
        rows = [tuple(r) for r in language.of_pages(spark.read.parquet(f"{SF}/pages.parquet")).select("page_id", "text", "declared", "host").collect()]
    got = {r[0]: r for r in registry.QUERIES[name](spark, SF).collect()}
    wanted = fused([r[1:] for r in rows])
    assert len(got) == len(rows)
    for (i, *_), (l, sure, text, kept) in zip(rows, wanted):
        r = got[i]
        assert (r.language, r.text_language, r.kept) == (l, text, kept), i
        assert r.confidence == (sure if sure is None else pytest.approx(sure, rel=1e-6))


def test_a_hot_host_and_a_hot_suffix_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("h"), F.col("doc_id") % 4, F.lit(".example.org"))))
    before = sorted(map(str, language.identified(docs).collect()))
    monkeypatch.setattr(language, "HOT", 0.5)  # no key is hot any more
    assert sorted(map(str, language.identified(docs).collect())) == before


def test_pages_read_markup(spark):
    rows = [(1, "https://X.example.de/a", '<html lang="de-AT"><head><script>var the = 1</script></head><p>Nicht &amp; aulich</p>'), (2, None, None)]
    got = language.of_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert (got[0].declared, got[0].host, got[0].text.split()) == ("de-AT", "x.example.de", ["Nicht", "&", "aulich"])
    assert (got[1].text, got[1].declared, got[1].host) == ("", None, "")
    assert language.of_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "page, words",
    [
        ("a < b and c > d", "a < b and c > d"), ("it&#39;s &eacute;t&eacute; &unknown;", "it's été &unknown;"), ("x<!-- a > b -->y", "x y"), ("x<STYLE>p {}</style >y<br/>z", "x y z"),
        ("x<script>a</scripts>b</script>y", "x y"), ("x<script>a", "x"), ("x<!-- y", "x"), ("x<p y", "x"), ("x<", "x<"), ("<scripting>x", "x"), ("</p>x<!doctype html>y<?xml?>z", "x y z"), ("", ""),
    ],
)
def test_markup_goes_and_text_stays(page, words):
    assert language.visible(page).split() == words.split()


@pytest.mark.parametrize("unit", ["<script ", "<script>", "<", "<!--", "<!-- ", "&", "&#", "&a", "<html ", "<html lang ", " lang =", "<a", "</script", "<script></script", "<style><script>", "lang=", "< "])
def test_pages_are_read_in_linear_time(unit):
    import time

    page = "<html" + unit * (1_000_000 // len(unit))
    for p in (page, page[5:], page + ">", "<script>" + page):
        began = time.process_time()
        language.visible(p), language.declared_by(p)
        assert time.process_time() - began < 2


def test_only_the_first_html_tag_declares():
    assert language.declared_by("<p><HTML class=x\n lang = 'fr-CA'><html lang=de>") == "fr-CA"
    assert language.declared_by("<html><html lang=de>") is None and language.declared_by("<p lang=de>") is None


# Near duplicates


def brute_components(rows, k, percent):
    sets = [(i, near_dup.shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def near_rows(n=150):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    rows = []
    for c in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for v in range(n // 12):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((c * 40 + v, " ".join(text).upper() if v == 3 else " \t".join(text)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "Ünï x"), (906, "ünï x")]


@pytest.mark.parametrize("k, percent", [(2, 80), (5, 80)])
def test_components_are_those_of_all_pairs(spark, k, percent):
    rows = near_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: r for r in near_dup.near_duplicates(df, k, percent).collect()}
    wanted = brute_components(rows, k, percent)
    assert {i: r.component_id for i, r in got.items()} == wanted
    assert all(r.kept == (i == r.component_id) and r.n_shingles == len(near_dup.shingle_set(dict(rows)[i], k)) for i, r in got.items())


@pytest.mark.parametrize("block", [1, 7, 30])
def test_blocks_of_any_size_lose_nothing(spark, monkeypatch, block):
    """Also without the links of the stars, so that every pair has to come from the blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = near_rows(96)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute_components(rows, 5, 80)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()} == wanted
    if block == 7:
        monkeypatch.setattr(near_dup, "components", lambda links: components.components(links.limit(0) if len(made) == 0 and not made.append(1) else links))
        made = []
        assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()} == wanted
        monkeypatch.undo()
        monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 50)
        assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()} == wanted


def test_a_block_without_members_has_no_pairs():
    none = near_dup.close_in_block([4], np.array([4]), np.array([True]), np.array([False]), [np.array([1], np.uint32)], np.array([1]), 80)
    assert none == []


def test_coinciding_hash_bits_hide_no_link():
    """Sets of 10, of which 9 are common, but the bits of two common ones coincide and so are seen once."""
    sets = [np.arange(1, 10, dtype=np.uint32), np.arange(2, 11, dtype=np.uint32)]
    found = near_dup.close_in_block([1, 2], np.array([1, 2]), np.array([True, True]), np.array([True, True]), sets, np.array([10, 10]), 80)
    assert set(found) == {(1, 2)}


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    near = [(5, "a b c d e f g h i j k"), (5, "zz yy xx ww vv uu tt ss"), (3, "a b c d e f g h i j k l"), (3, "A b c d e f g h i j k l"), (3, "a b c d e f g h i j k l"), (7, "zz yy xx ww vv uu tt ss")]
    df = spark.createDataFrame(near, "doc_id long, text string")
    got = near_dup.near_duplicates(df, 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(3, 11, 3, True)] * 3 + [(5, 7, 5, True), (5, 10, 3, False), (7, 7, 5, False)]
    kept = near_dup.deduplicated(df, 2).collect()
    assert sorted(r.doc_id for r in kept) == [3, 5] and [r.text for r in kept if r.doc_id == 5] == [near[1][1]]


def brute_rows(rows, k, percent):
    """Component and kept of each row, where rows may share an id: components are those of rows."""
    alone = [(n, t) for n, (i, t) in enumerate(rows) if i is not None]
    least = {}
    comps = brute_components(alone, k, percent)
    for n, c in comps.items():
        least[c] = min(least.get(c, rows[n][0]), rows[n][0])
    return sorted((rows[n][0], least[c]) if near_dup.shingle_set(rows[n][1], k) else (rows[n][0], rows[n][0]) for n, c in comps.items())


def test_shared_ids_repeated_rows_and_long_texts(spark):
    rng = random.Random(11)
    rows = [(rng.randint(0, 25), t) for _, t in near_rows(72)]
    long = " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randint(0, 9999)) for _ in range(60_000))
    rows += rows[:20] + [(30, long), (31, long + " tail"), (32, long[: len(long) // 2])]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == brute_rows(rows, 5, 80)
    kept = near_dup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sized = [r for r in kept if near_dup.shingle_set(r.text, 5)]
    sets = [near_dup.shingle_set(r.text, 5) for r in sized]
    assert all(100 * len(a & b) < 80 * len(a | b) for n, a in enumerate(sets) for b in sets[:n])


def test_components_of_a_star_a_chain_and_odd_links(spark):
    links = [(0, i) for i in range(1, 900)] + [(i, i + 1) for i in range(2000, 2040)] + [(5000, 5000), (None, 1), (2040, 2039), (7000, 7001), (7001, 7000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(900)} | {i: 2000 for i in range(2000, 2041)} | {7000: 7000, 7001: 7000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    text = "a b c d e f g h i j"
    rows = [(5, text, 1), (3, text, 2), (3, text, 3), (None, text, 4), (7, "other words are here today again", 5), (8, None, 6), (8, None, 6), (9, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = near_dup.deduplicated(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, text), (None, text), (7, rows[4][1]), (8, None), (8, None), (9, "")], key=str)
    assert near_dup.deduplicated(df.limit(0)).count() == 0


# Personal data


def base_by_pattern(text):
    """The contract's patterns, literally."""
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    )
    return [(k, *m.span()) for k, p, good in kinds for m in re.finditer(p, text) if good(m[0])]


def test_base_spans_are_the_patterns(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "@", ".", "-", "1", "25", "+", " ", "4111 1111 1111 1111", "10.0.0.1", "(", "é", "b.c"]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == base_by_pattern(t), t
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate([*texts[:200], None, "", "a@b.c " * 20000])], "doc_id long, text string, spans string, PII_ string")
    assert pii.with_findings(rows.limit(0)).count() == 0 and pii.with_redaction(rows.limit(0)).count() == 0
    clash = pii.with_findings(rows.withColumnRenamed("spans", "pii"))
    assert clash.columns == ["doc_id", "text", "pii", "PII_", "pii__"] and clash.where("pii = 'x' AND pii__.spans IS NOT NULL").count() == 203
    for r in pii.with_findings(rows).collect():
        base = base_by_pattern(r.text or "")
        assert r.pii.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.pii.spans.split(",")) | {""}


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("write to jane [at] example [dot] org now", "email", "jane [at] example [dot] org"),
        ("mail bob at mail dot example dot com today", "email", "bob at mail dot example dot com"),
        ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("call plus four nine one seven zero one two three four five now", "phone", "plus four nine one seven zero one two three four five"),
        ("host ten 10 dot 0 dot 0 dot 1.", "ip", "10 dot 0 dot 0 dot 1"),
        ("ｊ@ｅｘ.ｏｒｇ", "email", "ｊ@ｅｘ.ｏｒｇ"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    base, spans = pii.find(text)
    assert (kind, text.index(source), text.index(source) + len(source)) in spans
    assert set(base) <= set(spans)
    assert source not in pii.redacted(text, spans)


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("ping one nine two dot one six eight dot one dot one now", "ip", "one nine two dot one six eight dot one dot one"),
        ("room 12 192 dot one six eight dot 0 dot seven.", "ip", "192 dot one six eight dot 0 dot seven"),
        ("pay 4111 1111 1111 one one one one today", "card", "4111 1111 1111 one one one one"),
        ("call plus one 415 five five five two six seven one or", "phone", "plus one 415 five five five two six seven one"),
        ("call +1 (415) 555 two six seven one or", "phone", "+1 (415) 555 two six seven one"),
        ("p\u0430y 4111 1111 1111 \u043ene one one one", "card", "4111 1111 1111 \u043ene one one one"),
    ],
)
def test_partly_spelled_numbers_are_found_whole(text, kind, source):
    start = text.index(source)
    base, spans = pii.find(text)
    assert base == [] and spans == [(kind, start, start + len(source))]


WORDS_OF_DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
LOOKALIKES = {v: k for k, v in pii.HOMOGLYPHS.items() if v.isalpha()}


def planted(rng):
    """A disguised identifier: kind, text."""
    kind = rng.choice(pii.KINDS)
    spoken = lambda digits: " ".join(WORDS_OF_DIGITS[int(d)] for d in digits)
    if kind == "email":
        local, host, top = ("".join(rng.choice("abcdefghkmnopruvw") for _ in range(rng.randint(4, 9))) for _ in range(3))
        way = rng.randrange(4)
        if way == 0:
            plain = f"{local}@{host}.{top}"
            text = "".join(LOOKALIKES.get(c, c) if rng.random() < 0.4 else c for c in plain)
            return kind, text if text != plain else text.replace("@", "\uff20")
        if way == 1:
            return kind, local + rng.choice([" [at] ", "(at)", " {@} ", "<AT>"]) + host + rng.choice([" [dot] ", "(dot)", ".", " dot "]) + top
        if way == 2:
            return kind, f"{local} at {host} dot {top}"
        return kind, "".join(chr(ord(c) + 0xFEE0) for c in f"{local}@{host}.{top}")
    if kind == "ip":
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return kind, " dot ".join(parts) if rng.random() < 0.5 else " dot ".join(spoken(p) for p in parts)
    if kind == "phone":
        digits = "".join(rng.choice("123456789") for _ in range(rng.randint(8, 13)))
        return kind, "plus " + spoken(digits) if rng.random() < 0.5 else f"+{digits[:3]} {digits[3:6]} {spoken(digits[6:])}"
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    digits += next(d for d in "0123456789" if pii.luhn(digits + d))
    groups = [digits[i : i + 4] for i in range(0, 16, 4)]
    at = rng.randrange(4)
    return kind, " ".join(spoken(g) if i >= at else g for i, g in enumerate(groups))


def test_every_planted_disguise_is_found_where_it_stands():
    rng = random.Random(12)
    prose = ["river", "green", "Table", "wrote", "Abend", "é", "lune", "it."]
    for _ in range(1500):
        kind, hidden = planted(rng)
        before, after = (" ".join(rng.choice(prose) for _ in range(rng.randint(1, 6))) for _ in range(2))
        text = f"{before} {hidden} {after}"
        start = len(before) + 1
        base, spans = pii.find(text)
        assert (kind, start, start + len(hidden)) in spans, (text, spans)
        assert set(base) <= set(spans)


def test_no_run_of_spoken_digits_is_passed_over(monkeypatch):
    rng = random.Random(13)
    parts = ["one", "TWO", "ſix", "fıve", "FİVE", "oh", "dot", "DOT", "plus", "Plus", " ", " ", "  ", "\t", "-", ",", ".", "(", ")", "+", "4", "12", "4111", "é", "x", "\n", "at"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["".join(rng.choice(parts[:16]) + " " for _ in range(20)) for _ in range(1000)]
    found = [pii.find(t) for t in texts]
    gated = sum(not pii.says_digits(t) for t in texts)
    monkeypatch.setattr(pii, "says_digits", lambda text: True)
    assert [pii.find(t) for t in texts] == found and gated > 100 and any(len(b) < len(a) for b, a in found)


@pytest.mark.parametrize("unit", [" ", ".", "1", "@", "a@", "1 ", "[ ", "[\t\t", "one ", "plus ", "+1((", "1.", " at ", "a at b ", "a dot ", "at dot ", " (at) ", "\u0430", "1-", "one, ", "+", "one dot ", "@b dot ", "7 dot ", "a", "a-", "(", "one  \t", "x at a."])
def test_time_grows_with_the_text(unit):
    import time

    def took(n):
        text = (unit * (n // len(unit) + 1))[:n]
        best = []
        for _ in range(2):
            began = time.process_time()
            pii.find("x" + text + "x")
            best.append(time.process_time() - began)
        return min(best)

    assert took(400_000) <= 8 * took(100_000) + 0.2


def test_numbers_in_prose_are_no_findings():
    for text in ("One. Two. Three. Four.", "2 plus 12345678 makes 5 plus one", "one two three 4 5", "Version one dot two dot three", "chapter 7, one of 12 in 1999, two in 2001", "4111 1111 1111 one one one two", "nine dot nine nine nine dot one dot one"):
        assert pii.find(text) == ([], []), text


def test_prose_stays_as_it_is():
    for text in ("We met at noon. The dot on the map was one of two.", "one two three four", "Look at example.com or dot it", "", None):
        assert pii.find(text) == ([], [])
        assert pii.redacted(text, []) == text


# Media


def test_media_columns_keep_the_payload(spark):
    texts = ["", None, "a" * 64, "é" * 1000, "x" * 100_000, "same", "same"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, tile string")
    got = {r.doc_id: r for r in media.digests(media.store_text(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        d = got[i].digest
        assert (got[i].media.n_bytes, d.payload_bytes, d.payload_sha256, d.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (d.media_bytes, d.media_sha256) == (len(got[i].media.bytes), hashlib.sha256(got[i].media.bytes).hexdigest())
    assert got[5].digest == got[6].digest


def test_digests_of_nulls_and_foreign_bytes(spark):
    good = media.encode_pgm(np.arange(64, dtype=np.uint8).reshape(1, 64))
    rows = spark.createDataFrame([(1, None, "x"), (2, bytearray(b"abc"), "x"), (3, bytearray(good), "x"), (4, bytearray(good[:40]), "x"), (5, bytearray(b""), "x")], "id long, media binary, digest string")
    out = media.digests(rows, "media")
    assert out.columns == ["id", "media", "digest", "digest_"]
    got = {r.id: r.digest_ for r in out.collect()}
    assert got[1] == (None,) * 8
    assert all(got[i].error and got[i].payload_bytes is None and got[i].media_sha256 == hashlib.sha256(x).hexdigest() for i, x in ((2, b"abc"), (4, good[:40]), (5, b"")))
    assert got[3].error is None and np.load(io.BytesIO(got[3].tile)).shape == (8, 9)
    assert media.digests(rows.limit(0), "media").count() == 0


def test_added_media_columns_replace_nothing(spark):
    df = spark.createDataFrame([("a", "x", "y")], "text string, media string, decoded string")
    stored = media.store_text(df)
    assert stored.columns == ["text", "media", "decoded", "media_"]
    both = media.with_media(stored.withColumn("b", F.col("media_.bytes")), "b").first()
    assert (both.media, both.decoded, both.decoded_.width) == ("x", "y", 64)


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (8, 9), (40, 64), (5000, 7)])
def test_area_resize_is_the_mean_over_cells(shape):
    x = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    big = np.repeat(np.repeat(x.astype(float), 8, 0), 9, 1)
    wanted = big.reshape(8, shape[0], 9, shape[1]).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(x), wanted)
    assert np.load(io.BytesIO(media.npy(media.tile_of(x)))).shape == (8, 9)
    for encode in (media.encode_pgm, media.encode_bmp):
        assert (media.decode(encode(x)) == x).all()


def test_broken_media_say_why(spark):
    good = media.encode_bmp(np.zeros((4, 4), np.uint8))
    rows = [(1, None), (2, b""), (3, b"P5\n9 9\n255\nabc"), (4, good[:60]), (5, good), (6, b"P1\n2 1\n1 0\n"), (7, b"P3 1 1 255 1 2 x")]
    got = {r.id: r.decoded for r in media.with_media(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert got[1].error is None and got[1].tile is None
    assert all(got[i].error for i in (2, 3, 4, 7))
    assert (got[5].height, got[5].width, got[6].width) == (4, 4, 2)


# Chat


def test_every_reply_is_an_example_and_comes_back(spark):
    rows = [(1, 0, "user", "a\\b<|im_end|>"), (1, 1, "assistant", "<|im_start|>x\n\\p"), (1, 2, "us\ner", None), (1, 3, "assistant", ""), (2, 0, "user", "only"), (None, 0, "assistant", "n"), (3, 0, None, "é"), (3, 0, None, "é")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, example string")
    examples = chat_format.expand(df)
    assert examples.count() == 2 + 1 + 1 + 1
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    for c in (1, 2, None, 3):
        wanted = [(r or "", t or "") for i, _, r, t in rows if i == c]
        assert [(t.role, t.text) for t in got[c].turns] == wanted
        assert got[c].loss == "".join(t for r, t in wanted if r == "assistant")
    assert chat_format.expand(df.limit(0)).count() == 0


def test_long_conversations_and_texts(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k} <|im_end|>") for k in range(120)] + [(2, 0, "user", "\\<|" * 200_000), (2, 1, "assistant", "é<|" * 200_000)]
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2):
        assert [(t.role, t.text) for t in got[c].turns] == [(r, t) for i, _, r, t in rows if i == c]
        assert got[c].loss == "".join(t for i, _, r, t in rows if i == c and r == "assistant")


# URLs


def test_url_rules_and_terms(spark):
    urls = {"https://A.Example.com/en/7": ("a.example.com", "/en/7", "example.com/en/7", "allow"), "http://x.com/en/1?porn": ("x.com", "/en/1", "com/en/", "block"), "http://q.net/de/porn": ("q.net", "/de/porn", "net/de/", "allow"), "http://h.io/porn#x": ("h.io", "/porn", None, "block"), "http://h.io/pornx-poker": ("h.io", "/pornx-poker", None, "allow"), "http://h.io/bets-poker": ("h.io", "/bets-poker", None, "block"), "http://h.io/poker-poker": ("h.io", "/poker-poker", None, "allow"), "http://h.io/free-win": ("h.io", "/free-win", None, "allow"), "http://h.io/free-win-bonus-cheap": ("h.io", "/free-win-bonus-cheap", None, "block"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://h.io/" + "a-poker/" * 50_000: ("h.io", "/" + "a-poker/" * 50_000, None, "allow"), "": ("", "", None, "allow")}
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df.unionByName(df)).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())
    assert url_filter.judge(df.limit(0)).count() == 0


def test_vocabularies_are_data(spark, tmp_path):
    (tmp_path / "terms.tsv").write_text("Strict-One\tstrict\nlight\t0.5\nheavy\t3\nmiddle\t1.5\nLIGHT\t0.75\nplain\n\n")
    v = url_filter.read_vocabulary(spark, str(tmp_path / "terms.tsv"))
    assert (v.strict, v.soft) == (("strict-one",), (("heavy", 3.0), ("light", 0.75), ("middle", 1.5), ("plain", 1.0)))
    rows = ["http://a.b/x/strict-one", "http://a.b/heavy", "http://a.b/light.middle", "http://a.b/light.plain", "http://a.b/heavy+light", "http://a.b/xheavy+light"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = sorted((r.page_id, r.verdict, r.n_strict, r.n_soft, r.soft_weight) for r in url_filter.judge(df, vocabulary=v).collect())
    assert got == [(0, "block", 1, 0, 0.0), (1, "allow", 0, 1, 3.0), (2, "block", 0, 2, 2.25), (3, "allow", 0, 2, 1.75), (4, "block", 0, 2, 3.75), (5, "allow", 0, 1, 0.75)]
    monkey = url_filter.MOST_TERMS
    try:
        url_filter.MOST_TERMS = 2
        with pytest.raises(ValueError):
            url_filter.read_vocabulary(spark, str(tmp_path / "terms.tsv"))
    finally:
        url_filter.MOST_TERMS = monkey


def test_a_large_vocabulary_counts_as_a_plain_search_does():
    rng = random.Random(9)
    terms = {"".join(rng.choice("abc-") for _ in range(rng.randint(1, 5))) for _ in range(400)}
    v = url_filter.Vocabulary.of({t: rng.choice([None, 0.5, 1.0, 2.0]) for t in terms})
    count = v.counter()
    for _ in range(300):
        text = "".join(rng.choice("abc-/é1") for _ in range(rng.randint(0, 40)))
        spots = [(t, m.start()) for t in terms for m in re.finditer(f"(?={re.escape(t)})", text)]
        clear = [(t, a) for t, a in spots if not re.match("[a-z0-9]", text[a - 1 : a] if a else "") and not re.match("[a-z0-9]", text[a + len(t) :])]
        soft = {t for t, _ in clear} & set(dict(v.soft))
        strict, distinct, weight = count(text)
        assert (strict, distinct) == (sum(t in v.strict for t, _ in clear), len(soft)) and weight == pytest.approx(sum(dict(v.soft)[t] for t in soft))


# Pipeline and queries


def test_pipeline_stages_agree_with_plain_versions(spark):
    import corpus_pipeline as c

    rows = [(i, t, "en", "s0", len(t or "")) for i, t in near_rows(60)] + [(950, "mail me a@b.org please " * 3, "en", "s1", 66), (951, "12345", "en", "s1", 5), (950, "mail me a@b.org please " * 3, "en", "s1", 66)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, piece int")
    kept = c.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    survivors = {r.doc_id for r in kept.collect()}
    assert {i for i, t, *_ in rows if t and re.search("[a-z]{4}", t.lower())} <= survivors and not survivors & {900, 901, 902, 951}
    unique = c.near_dedup(spark, kept, "")
    wanted = brute_components([(r[0], r[1]) for r in rows if r[0] in survivors], 5, 80)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, k in wanted.items() if i == k)
    masked = {r.doc_id: r for r in c.mask_pii(spark, unique, "").collect()}
    assert masked[950].text == "mail me <EMAIL> please " * 3 and masked[950].n_chars == len(masked[950].text) and masked[950].piece == 0
    packed = c.pack(spark, c.mask_pii(spark, unique, ""), "").collect()
    assert {r.doc_id for r in packed} == set(masked)
    for stage in (c.language_id, c.near_dedup, c.mask_pii, c.pack):
        assert stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("name", ["op3_chat_format", "op9_near_dup", "op10_url_filter"])
def test_query_agrees_with_sql(spark, name):
    import duckdb

    from gridlark.llm import registry

    got = registry.QUERIES[name](spark, SF)
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = c.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, found.fetchall()))
