"""The corpus pipeline: language identification, near-duplicate removal, personal data, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that its predecessor kept. ``run`` writes each stage's result
as Parquet into the shared folder and reads it again, so a lost executor costs at most a stage.

* ``language_id`` drops documents without an identifiable language; all others keep all their columns, and ``lang`` says what was identified.
* ``near_dedup`` keeps one document, that of the least doc_id, of each group of near copies (five words, similarity 0.8).
* ``pii`` replaces personal data in the text by its kind in angle brackets and corrects n_chars where the text changed.
* ``packing`` returns the pieces of all documents with their token ids and their places in sequences of 2048 tokens.

Null texts, repeated rows, empty tables and extra columns: as the operators' modules define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm import language, near_dup, packing, pii, vocab
from gridlark.llm.common import spread_table, unused
from gridlark.llm.queries import BYTE_BPE, vocabulary_path
from gridlark.storage import drop_written, new_path, scratch, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = unused(docs, "masked")
    masked, text = pii.with_redaction(docs, to=name), F.col(f"`{name}`")
    size = F.when(F.col("text") != text, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return masked.select(*[text.alias("text") if c == "text" else size.alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path(BYTE_BPE), vocab.SPACED, end_id=0)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", mask_pii), ("packing", pack)]

#: Sketches, transducers and the tokenizer can't be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spread_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):  # a stage's own tables go once its result is written
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
