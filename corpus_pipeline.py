"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
run() writes each result as Parquet in the shared folder and reads it for the next.
All stages but the last return the columns of `documents`, other columns are left out; the last
returns packed pieces. Null and empty texts are rejected by language ID, as they have no letter;
a stage that is called by itself keeps them unless its docstring says more. Every stage gives an
empty table for an empty one, and takes texts of any length whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import base, decontaminate, jaccard_join, language_id, line_dedup, packing

#: Least mean probability of the predicted language.
LEAST_SCORE = 0.5
_ROW = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with a new text and its length, in the columns of documents."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*_ROW)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose language the net is unsure of. Columns stay as they are.

    Each row is judged by its own text, so rows that repeat stay or go together; of languages that tie the first by name counts."""
    base.ship(spark)
    net = language_id.fit(docs.where(~language_id.held_out()))
    scored = language_id.predict(docs.select(*_ROW), net)
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*_ROW)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that an earlier line repeats; a document that loses all its words goes.

    Earlier means a smaller id (null first), or further up in the same text; texts of one id are told apart by fingerprints.
    Rows that repeat id and text stand at one place: they lose the same lines, and none because of each other. Null and
    empty texts stay."""
    kept = line_dedup.line_dedup(docs.select(*_ROW)).where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return _with_text(kept, F.col("text"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word shingle sets at 0.8 or more one row stays: the one of the least id, a null id before all others; of rows that repeat its id and text, one.

    Rows without words are no near duplicates of anything and all stay."""
    base.ship(spark)
    return jaccard_join.one_of_each(docs, k=5, t=80).select(*_ROW)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out spans of ten or more words that benchmark items have; documents with more than half of their words in such spans go, and so do null texts.

    Each row is judged by its own text. An item of fewer than ten words counts as a whole; items without words hit nothing."""
    found = decontaminate.decontaminate(docs, base.read(spark, sf_dir, "benchmark"), carry=_ROW)
    return _with_text(found.where(F.col("clean").isNotNull()), F.col("clean"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096 ids, with their ids. Rows that repeat are packed each; a null or empty text is its end id alone."""
    base.ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_near_duplicates),
    ("decontaminate", remove_benchmark_passages),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; each is tested against a plain version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, base.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            base.drop_tables(before)
    return STAGES[-1][1](spark, docs, sf_dir)
