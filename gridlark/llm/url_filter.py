"""URL filter: explicit host/path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A URL is rejected by the vocabulary on one strict term, or on at least ``SOFT_DISTINCT`` different soft terms whose weights add up to
``SOFT_NEEDED`` or more. A term counts only where no ASCII letter or digit stands directly before or after it. Explicit rules (allow
or block for a host, its subdomains and a path prefix) override the vocabulary; of several rules that fit, the longest wins.

A vocabulary is data: ``read_vocabulary`` loads a list of up to ``MOST_TERMS`` terms with weights, which is broadcast and made an automaton
once a worker; the built-in list is a short general one of words for gambling, pornography, fraud, piracy and spam.

Defined results: a null URL, or one without ``://``, has an empty host and an empty path, no rule fits it, and the
vocabulary still reads what text there is (a null URL is allowed). Repeated rows give repeated results; an empty table gives none. Other
columns of the input, whatever their names, are dropped by ``judge``; it returns the id column and the columns listed there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import ascii_lower, in_small_batches

#: (verdict, host and path prefix). Fixed values of the query's contract.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Terms of which one is enough.
STRICT = (
    "bestiality", "buy-followers", "camgirls", "carding", "casino", "casinos", "cialis", "creampie", "cumshot", "cvv-shop", "dumps-shop", "escort", "escorts", "fake-passport", "fullz",
    "gangbang", "hardcore-sex", "hentai", "jackpot", "keygen", "levitra", "link-farm", "malware", "milf", "phishing", "porn", "porno", "pornhub", "ransomware", "sex-cam", "sexcam",
    "slot-machine", "spyware", "sportsbook", "torrent-pirate", "viagra", "warez", "webcam-sex", "xanax-online", "xxx",
)
#: Terms of which several different ones are needed, with their weights: ordinary words weigh half.
SOFT = {
    "adult": 1.0, "bets": 1.0, "betting": 1.0, "crack": 1.0, "cracked": 1.0, "dating": 1.0, "erotic": 1.0, "fetish": 1.0, "forex-signals": 1.0, "gambling": 1.0, "get-rich": 1.0, "hack": 1.0,
    "hookup": 1.0, "lottery": 1.0, "naked": 1.0, "nude": 1.0, "nudes": 1.0, "nulled": 1.0, "payday": 1.0, "pharmacy": 1.0, "pills": 1.0, "poker": 1.0, "replica": 1.0, "roulette": 1.0,
    "serial-key": 1.0, "sex": 1.0, "sexy": 1.0, "slots": 1.0, "spam": 1.0, "torrent": 1.0, "torrents": 1.0, "weight-loss": 1.0,
    "bet": 0.5, "bonus": 0.5, "cheap": 0.5, "click": 0.5, "deal": 0.5, "discount": 0.5, "download": 0.5, "free": 0.5, "girls": 0.5, "hot": 0.5, "loan": 0.5, "promo": 0.5, "win": 0.5, "winner": 0.5,
}
SOFT_DISTINCT, SOFT_NEEDED = 2, 2.0
#: Terms that a loaded vocabulary may have; it is broadcast (about 100 bytes each).
MOST_TERMS = 1_000_000
DEFAULT_WEIGHT = 1.0


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """Terms in lower case: strict ones, and soft ones with weights."""

    strict: tuple[str, ...]
    soft: tuple[tuple[str, float], ...]

    @classmethod
    def of(cls, weights: dict[str, float | None]) -> Vocabulary:
        """From weights by term; strict terms have None."""
        return cls(tuple(sorted(t for t, w in weights.items() if w is None)), tuple(sorted((t, w) for t, w in weights.items() if w is not None)))

    def counter(self) -> Callable[[str], tuple[int, int, float]]:
        """A function of a lower-cased text: number of strict hits, number of distinct soft terms, sum of their weights."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in self.strict:
            automaton.add_word(term, (len(term), None))
        for term, weight in self.soft:
            automaton.add_word(term, (len(term), (term, weight)))
        if not len(automaton):
            return lambda text: (0, 0, 0.0)
        automaton.make_automaton()

        def inside(char: str) -> bool:
            return char.isascii() and char.isalnum()

        def count(text: str) -> tuple[int, int, float]:
            strict, soft = 0, {}
            for last, (size, kind) in automaton.iter(text):
                first = last - size + 1
                if first and inside(text[first - 1]) or last + 1 < len(text) and inside(text[last + 1]):
                    continue
                if kind is None:
                    strict += 1
                else:
                    soft[kind[0]] = kind[1]
            return strict, len(soft), sum(soft.values())

        return count


BUILT_IN = Vocabulary.of({**SOFT, **dict.fromkeys(STRICT)})


def read_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    """From lines of a term, a tab and its weight (``strict``, a number, or nothing for ``DEFAULT_WEIGHT``); of repeated terms the weightiest counts."""
    lines = spark.read.option("sep", "\t").option("quote", "").schema("term string, weight string").csv(path)
    term = ascii_lower(F.trim("term"))
    says = F.lower(F.trim("weight"))
    rows = lines.where(F.col("term").isNotNull() & (term != "")).select(term.alias("term"), (says == "strict").alias("strict"), F.coalesce(F.when(says != "strict", says).cast("double"), F.lit(DEFAULT_WEIGHT)).alias("weight"))
    terms = rows.groupBy("term").agg(F.coalesce(F.bool_or("strict"), F.lit(False)).alias("strict"), F.max("weight").alias("weight"))
    found = terms.limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"{path} has more than {MOST_TERMS} terms")
    return Vocabulary.of({r["term"]: None if r["strict"] else r["weight"] for r in found})


@lru_cache(maxsize=4)
def _counter(vocabulary: Vocabulary) -> Callable[[str], tuple[int, int, float]]:
    """The worker's automaton of a broadcast vocabulary."""
    return vocabulary.counter()


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + rest))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, vocabulary: Vocabulary = BUILT_IN) -> DataFrame:
    """id, host, path, rule, verdict (allow or block), n_strict, n_soft (distinct), soft_weight."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("n_strict int, n_soft int, soft_weight double")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = _counter(shared.value)
        for texts in batches:
            yield pd.DataFrame([count(t) for t in texts], columns=["n_strict", "n_soft", "soft_weight"]).astype({"n_strict": "int32", "n_soft": "int32", "soft_weight": "float64"})

    url = F.col(f"`{url_col}`")
    found = in_small_batches(df).select(F.col(f"`{id_col}`").alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"), hits(ascii_lower(F.coalesce(url, F.lit("")))).alias("hits"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_terms = F.when((F.col("hits.n_strict") > 0) | (F.col("hits.n_soft") >= SOFT_DISTINCT) & (F.col("hits.soft_weight") >= SOFT_NEEDED), "block").otherwise("allow")
    return found.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_terms).alias("verdict"), "hits.*")


def oracle(rules=RULES, vocabulary: Vocabulary = BUILT_IN) -> str:
    """The same in DuckDB's SQL."""

    def hit(term: str) -> str:
        return f"regexp_matches(u, '(^|[^a-z0-9]){re.escape(term)}([^a-z0-9]|$)')"

    def fits(text: str) -> str:
        at, _, rest = text.partition("/")
        return f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}')"

    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    lower = "translate({}, '" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH cut AS (
  SELECT page_id, {lower.format("coalesce(url, '')")} AS u,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, u, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in ranked)} END AS rule,
         CASE {" ".join(f"WHEN {fits(t)} THEN '{v}'" for v, t in ranked)} END AS says,
         {" OR ".join(map(hit, vocabulary.strict))} AS is_strict,
         list_filter([{", ".join(f"CASE WHEN {hit(t)} THEN {w!r}::DOUBLE END" for t, w in vocabulary.soft)}], lambda w: w IS NOT NULL) AS soft
  FROM parts)
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN is_strict OR len(soft) >= {SOFT_DISTINCT} AND list_sum(soft) >= {SOFT_NEEDED} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""
