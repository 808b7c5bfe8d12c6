"""Language identification by Bayesian fusion of four kinds of evidence.

* *Text*: a naive Bayes model over hashed byte trigrams inside words, fitted on a bounded sample of rows that declare their
  language (``SAMPLE`` rows a language, picked by a hash of their id). Neighbouring trigrams aren't independent, so the
  log-likelihood is tempered by ``TEMPER``. The languages are all those that at least ``SUPPORT`` rows declare (in a table without such, all declared ones); with very many of
  them trigrams fall into fewer buckets (``buckets_for``), so the model's memory is bounded and the number of languages isn't.
* *Declared language* (a markup attribute or a column): how often each declaration meets each language, from a grouped
  aggregation over all rows, smoothed with ``DECLARED_WEIGHT`` rows of honest declarations.
* *Address suffix* and *host*: the mean language mix of all other rows of the host, smoothed towards that of its suffix, smoothed towards
  that of the whole table, each with ``SMOOTH`` rows' weight; country suffixes start from ``SUFFIX_LANGUAGE``. The row itself
  is left out of its host's counts, so it isn't its own evidence.

All counts cover all rows. They come from partial sums, so a host with a third of all rows costs one row a task, and its counts reach
its rows by a broadcast (``spread_join``).

Languages without labelled text take no part. A row is rejected if it has no letters, if its text is less like any fitted language than
like a uniform mix of trigrams, or if the best language's posterior probability is below ``LEAST``. For the second test a language is
its trigrams' frequencies with a fixed part ``UNSEEN`` of the uniform mix, so an unseen trigram weighs the same for samples of any size.
A row that declares a language with less support is judged like one without a declaration; if it is then not identified, it is taken at its word if it has
letters, since nothing here could judge it.

A declaration is a tag whose primary part has two or three letters, such as ``en`` or ``EN-us``, but for those that mean none
(``NO_LANGUAGE``). Letters are ASCII letters, and letters and combining marks of all other scripts.

Defined results: null text is empty and rejected; a null or malformed declaration, or a null or empty host, is no evidence; a
suffix is what follows the host's last dot (none without a dot). Without a single labelled row the language is ``und`` and every row is
rejected. Repeated rows give repeated results. An empty table gives none. ``identified`` returns the id column and its own columns only;
``kept_rows`` returns the rows of its input with all their columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import ascii_lower, in_small_batches, unused
from gridlark.llm.near_dup import BROADCAST_IDS
from gridlark.storage import HOT, spread_join, written

#: Rows that must declare a language for it to be fitted, and what a table without labels has.
SUPPORT, UNDETERMINED = 5, "und"
#: Codes of declarations that name no language.
NO_LANGUAGE = ("und", "mul", "mis", "zxx")
#: Buckets of trigrams, rows of each language that the text model is fitted on, and what is added to each bucket's count.
BUCKETS, SAMPLE, ADDED = 1 << 15, 4000, 0.5
#: Languages up to which there are so many buckets; beyond, half as many for each doubling, and ``LEAST_BUCKETS`` at least. A model has 8 bytes a bucket and language.
FULL, LEAST_BUCKETS = 256, 1 << 10
TEMPER, LEAST, UNSEEN = 0.1, 0.5, 0.1
SMOOTH, DECLARED_WEIGHT, HONEST = 20.0, 20.0, 0.9
#: Bytes of text handled at once.
SLICE = 1 << 20
#: Languages that country suffixes stand for.
SUFFIX_LANGUAGE = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en",
    "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "jp": "ja", "cn": "zh", "kr": "ko",
    "tr": "tr", "gr": "el", "cz": "cs", "hu": "hu", "ro": "ro", "ua": "uk", "ir": "fa", "vn": "vi", "th": "th", "il": "he", "bg": "bg", "sk": "sk",
}


def _is_letter() -> np.ndarray:
    out = np.zeros(256, bool)
    out[97:123] = out[128:] = True
    return out


LETTER = _is_letter()


#: Characters beyond ASCII that aren't letters, but for combining marks.
OTHER = re.compile(r"[^\x00-\x7f\w]|\d(?<=[^\x00-\x7f])")


def lettered(text: str) -> str:
    """The text in lower case, with a space for each character beyond ASCII that belongs to no word."""
    if not text.isascii():
        text = OTHER.sub(lambda m: m[0] if unicodedata.category(m[0])[0] == "M" else " ", text)
    return text.lower()


def buckets_for(languages: int) -> int:
    buckets = BUCKETS
    while languages > FULL and buckets > LEAST_BUCKETS:
        languages, buckets = (languages + 1) // 2, buckets // 2
    return buckets


def trigrams(text: str | None, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams around each letter, in slices; what isn't a letter counts as a space."""
    raw = np.frombuffer(b"  " + lettered(text or "").encode("utf-8", "surrogatepass") + b"  ", np.uint8)
    for start in range(1, len(raw) - 1, SLICE):
        part = raw[start - 1 : start + SLICE + 1]
        letter = LETTER[part]
        x = np.where(letter, part, 32).astype(np.uint32)
        at = np.flatnonzero(letter[1:-1])
        yield ((x[at] * np.uint32(0x9E3779B1) + x[at + 1] * np.uint32(0x85EBCA77) + x[at + 2] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)) & np.uint32(buckets - 1)


def stated_of(tag: Column) -> Column:
    """The language of a declaration such as ``en`` or ``EN-us``; null if it names none."""
    primary = F.regexp_extract(ascii_lower(F.trim(tag)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when((primary != "") & ~primary.isin(*NO_LANGUAGE), primary)


def suffix_of(host: Column) -> Column:
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


def languages_of(stated: DataFrame) -> dict[str, int]:
    """The languages that rows state, in order of name, with their numbers of rows. There are at most 26^2 + 26^3 codes."""
    counts = {r["stated"]: r["n"] for r in stated.where("stated IS NOT NULL").groupBy("stated").agg(F.count("*").alias("n")).collect()}
    fitted = {l: n for l, n in counts.items() if n >= SUPPORT} or counts
    return dict(sorted(fitted.items())) or {UNDETERMINED: 0}


def text_model(labelled: DataFrame, sizes: dict[str, int]) -> np.ndarray:
    """Log-probabilities by bucket and language, then by how much more likely than uniform each bucket is there, in logarithms.

    Languages without text have -inf. labelled has id, declared and text; sizes has its rows by language. The result's size depends on
    the parameters and the number of languages alone.
    """
    names = list(sizes)
    number, buckets = {l: k for k, l in enumerate(names)}, buckets_for(len(names))
    share = labelled.sparkSession.createDataFrame([(l, 1_000_000 * SAMPLE / max(n, 1)) for l, n in sizes.items()], "declared string, share double")
    sample = labelled.join(F.broadcast(share), "declared").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for declared, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = total.setdefault(number[declared], np.zeros(buckets, np.int64))
                for found in trigrams(text, buckets):
                    mine += np.bincount(found, minlength=buckets)
        for k, mine in total.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k, np.int32)), "bucket": pa.array(at, pa.int32()), "n": mine[at]})

    grouped = sample.select("declared", "text").mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most a row a bucket and language
    seen = np.zeros((buckets, len(names)))
    seen[grouped["bucket"].to_numpy(), grouped["k"].to_numpy()] = grouped["n"].to_numpy()
    counts, fitted = seen + ADDED, seen.sum(axis=0) > 0
    model = np.log(counts / counts.sum(axis=0))
    if fitted.any():
        model[:, ~fitted] = -np.inf
    like = np.log((1 - UNSEEN) * buckets * seen / np.maximum(seen.sum(axis=0), 1) + UNSEEN)
    like[:, ~fitted] = -np.inf
    return np.concatenate([model, like], axis=1)


def text_scores(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """rows (whose last column is text) with n_grams, s, the languages' log-likelihoods, likeness, the greatest over uniform, and p, their shares by the text alone, in the text's place."""
    shared = rows.sparkSession.sparkContext.broadcast(model.astype(np.float32))  # 8 bytes a bucket and language
    others, n = rows.columns[:-1], model.shape[1] // 2

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * n), pa.array(values.reshape(-1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sums, sizes = np.zeros((len(texts), 2 * n)), np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                for found in trigrams(text, len(weights)):
                    sizes[i] += len(found)
                    sums[i] += weights[found].sum(axis=0, dtype=np.float64)
            s = np.ascontiguousarray(sums[:, :n])
            p = np.exp(TEMPER * (s - s.max(axis=1, initial=-np.inf, keepdims=True))) if len(s) else s
            p = np.where(sizes[:, None] > 0, p / p.sum(axis=1, keepdims=True), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes), lists(s), pa.array(sums[:, n:].max(axis=1, initial=-np.inf)), lists(p)], names=[*others, "n_grams", "s", "likeness", "p"])

    kinds = [f"{c} {t}" for c, t in rows.dtypes[:-1]]
    return rows.mapInArrow(score, ", ".join([*kinds, "n_grams long, s array<double>, likeness double, p array<double>"]))


def keys_of(text: Column, declared: Column, host: Column) -> list[Column]:
    """Two hashes of all that a decision depends on; nulls count, which a hash would pass over."""
    parts = [p for c in (text, declared, host) for p in (c.isNull(), c)]
    return [F.xxhash64(*parts).alias("key_a"), F.xxhash64(F.lit("b"), *reversed(parts)).alias("key_b")]


def summed(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def smoothed(counts: Column, above: Column) -> Column:
    """Shares from counts, with ``SMOOTH`` rows of the shares above."""
    total = summed(counts)
    return F.zip_with(counts, above, lambda n, a: (n + SMOOTH * a) / (total + SMOOTH))


def identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", with_keys: bool = False) -> DataFrame:
    """id, language (the likeliest), confidence (its posterior probability), text_language (by the text alone), kept.

    A row that is taken at its word has a null confidence and text_language.
    """
    none = F.lit(None).cast("string")
    tag = F.col(f"`{declared_col}`").cast("string") if declared_col else none
    host = F.col(f"`{host_col}`").cast("string") if host_col else none
    text = F.col(f"`{text_col}`")
    sizes = languages_of(df.select(stated_of(tag).alias("stated")))
    names, spark = list(sizes), df.sparkSession
    every = F.sequence(F.lit(0), F.lit(len(names) - 1))
    rows = in_small_batches(df).select(F.col(f"`{id_col}`").alias("id"), *keys_of(text, tag, host), stated_of(tag).alias("stated"), F.when(host != "", host).alias("host"), text.alias("text"))

    model = text_model(rows.select("id", F.col("stated").alias("declared"), "text").where("declared IS NOT NULL"), sizes)
    scored = written(text_scores(rows, model), "language-scores")

    def sums(keys: list[str], source: DataFrame, shares: str) -> DataFrame:
        return source.groupBy(*keys).agg(F.array(*[F.sum(F.get(shares, F.lit(k))) for k in range(len(names))]).alias("n"), F.count("*").alias("n_rows"))

    # One row a host, then one a suffix, then one.
    hosts = written(sums(["host"], scored, "p"), "language-hosts").withColumn("suffix", suffix_of(F.col("host")))
    overall = np.array([x or 0.0 for x in sums([], hosts, "n").first()["n"]]) + 1
    base = F.lit((overall / overall.sum()).tolist())

    country = [(suffix, names.index(l)) for suffix, l in SUFFIX_LANGUAGE.items() if l in sizes]
    country = spark.createDataFrame(country, "suffix string, home int")
    suffixes = sums(["suffix"], hosts.where("suffix IS NOT NULL"), "n").join(F.broadcast(country), "suffix", "left")
    start = F.transform("n", lambda n, k: n + F.when(k == F.col("home"), SMOOTH).otherwise(0.0))
    suffixes = written(suffixes.select("suffix", "n_rows", smoothed(start, base).alias("u")), "language-suffixes")
    named = hosts.where("host IS NOT NULL").withColumnRenamed("n_rows", "n_host")
    of_host = spread_join(named, suffixes.drop("n_rows"), ["suffix"], suffixes.where(F.col("n_rows") > hosts.count() / HOT), "left")
    of_host = of_host.select("host", "n_host", "n", F.coalesce("u", base).alias("u"))

    # One row a known declaration: what it says of each language.
    listed = spark.createDataFrame([(l, k) for l, k in zip(names, range(len(names)), strict=True)], "stated string, own int")
    met = F.broadcast(listed).join(sums(["stated"], scored.where("stated IS NOT NULL"), "p").select("stated", "n"), "stated", "left")
    honest = F.transform(every, lambda k: F.when(k == F.col("own"), HONEST).otherwise((1 - HONEST) / max(len(names) - 1, 1)))
    joint = F.zip_with(F.coalesce("n", F.transform(every, lambda k: F.lit(0.0))), honest, lambda n, h: n + DECLARED_WEIGHT * h)
    says = written(met.select("stated", joint.alias("joint")), "language-declarations")
    columns = [F.sum(F.get("joint", F.lit(k))) for k in range(len(names))]
    whole = F.lit(says.agg(F.array(*columns).alias("w")).first()["w"])
    says = says.select("stated", F.zip_with("joint", whole, lambda j, w: F.log(j / w)).alias("said"))

    joined = spread_join(scored, of_host.drop("n_host"), ["host"], of_host.where(F.col("n_host") > scored.count() / HOT), "left").join(F.broadcast(says), "stated", "left")
    others = F.zip_with("n", "p", lambda n, p: F.greatest(n - p, F.lit(0.0)))
    nothing = F.transform(every, lambda k: F.lit(0.0))
    joined = joined.withColumns({"prior": F.when(F.col("n").isNull(), base).otherwise(smoothed(others, F.col("u"))), "said": F.coalesce("said", nothing)})
    final = joined.withColumn("f", F.zip_with(F.zip_with("s", "prior", lambda s, p: TEMPER * s + F.log(p)), "said", lambda a, b: a + b))
    final = final.withColumn("top", F.array_max("f"))
    final = final.withColumn("total", F.aggregate("f", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))

    def likeliest(values: str) -> Column:
        """The first language with the greatest value."""
        return F.get(F.lit(names), F.array_position(values, F.array_max(values)).cast("int") - 1)

    sure = (F.col("likeness") > 0) & (1 / F.col("total") >= LEAST) & (F.col("n_grams") > 0)
    at_its_word = F.col("stated").isNotNull() & ~F.col("stated").isin(names) & ~sure
    return final.select(
        F.col("id").alias(id_col), F.when(at_its_word, F.col("stated")).otherwise(likeliest("f")).alias("language"), F.when(~at_its_word, 1 / F.col("total")).alias("confidence"),
        F.when(~at_its_word & (F.col("n_grams") > 0), likeliest("s")).alias("text_language"),
        ((F.col("n_grams") > 0) & (at_its_word | sure)).alias("kept"), *(["key_a", "key_b", "stated"] if with_keys else []),
    )


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows that aren't rejected, with all their columns; the declaration becomes the identified language where it says another or none.

    Rejected and relabelled rows are known by hashes of all that a decision depends on: broadcast if few (24 bytes each), else by a shuffle.
    """
    found = identified(df, id_col, text_col, declared_col, host_col, with_keys=True)
    changed = found.where(~F.col("kept") | ~F.col("language").eqNullSafe(F.col("stated")))
    changed = changed.groupBy("key_a", "key_b").agg(F.bool_and("kept").alias("kept"), F.min("language").alias("language"))  # rows with equal keys have equal rulings
    names = {c: unused(df, c) for c in changed.columns}
    changed = written(changed.withColumnsRenamed(names), "language-rulings")
    few = changed.count() <= BROADCAST_IDS
    tag, host = F.col(f"`{declared_col}`").cast("string"), F.col(f"`{host_col}`").cast("string")
    a, b = keys_of(F.col(f"`{text_col}`"), tag, host)
    ruled = df.join(F.broadcast(changed) if few else changed, (a == F.col(names["key_a"])) & (b == F.col(names["key_b"])), "left")
    stays = F.coalesce(F.col(names["kept"]), F.lit(True))
    return ruled.where(stays).select(*[F.coalesce(names["language"], tag).cast(t).alias(c) if c == declared_col else F.col(f"`{c}`") for c, t in df.dtypes])


#: What opens and closes elements whose content isn't text, and a page's declaration. None of these patterns can run back over what it has read.
RAW_OPEN = re.compile(r"<(script|style)\b", re.I)
RAW_CLOSE = {"script": re.compile(r"</script\b", re.I), "style": re.compile(r"</style\b", re.I)}
HTML_TAG = re.compile(r"<html\b", re.I)
LANG = re.compile(r"""\slang\s*=\s*["']?([A-Za-z_-]+)""", re.I)


def visible(page: str) -> str:
    """The text of a page: tags, comments, scripts and styles become spaces, character references their characters. One pass.

    ``<`` opens a tag only before a letter, ``/``, ``!`` or ``?``, so ``a < b`` stays. What isn't closed runs to the page's end.
    """
    out, i = [], 0
    while (j := page.find("<", i)) >= 0:
        after = page[j + 1 : j + 2]
        if not (after.isascii() and after.isalpha() or after in ("/", "!", "?")) or not after:
            out.append(page[i : j + 1])
            i = j + 1
            continue
        out += [page[i:j], " "]
        raw = RAW_OPEN.match(page, j)
        if page.startswith("<!--", j):
            end = page.find("-->", j + 4)
            i = end + 3 if end >= 0 else len(page)
            continue
        if raw:
            close = RAW_CLOSE[raw[1].lower()].search(page, raw.end())
            j = close.start() if close else len(page)
        end = page.find(">", j)
        i = end + 1 if end >= 0 else len(page)
    out.append(page[i:])
    return unescape("".join(out))


def declared_by(page: str) -> str | None:
    """The language that a page's first ``html`` tag declares."""
    tag = HTML_TAG.search(page)
    if not tag:
        return None
    end = page.find(">", tag.end())
    found = LANG.search(page, tag.end(), end if end >= 0 else len(page))
    return found[1] if found else None


def of_pages(pages: DataFrame) -> DataFrame:
    """Web pages as rows for ``identified``: page_id, text without markup, the declared language, the host. Null pages are empty."""
    from gridlark.llm.url_filter import host_of

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = [x or "" for x in batch.column(2).to_pylist()]
            columns = [batch.column(0), pa.array([visible(x) for x in html], pa.string()), pa.array([declared_by(x) for x in html], pa.string()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "text", "declared", "host"])

    rows = in_small_batches(pages).select("page_id", host_of(F.col("url")).alias("host"), "html")
    return rows.mapInArrow(read, f"page_id {dict(pages.dtypes)['page_id']}, text string, declared string, host string")
