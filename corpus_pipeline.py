"""Corpus pipeline: language, near copies, benchmark passages, mix, token ids.

Each stage works on all that the one before it kept; its rows are written as Parquet in the shared
folder and read again, so a lost executor never costs more than the stage at work; they go when the
next stage's are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodspark.llm import common, decontam, langid, mixing, neardup, tokens


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found (operator 7)."""
    return langid.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 4)."""
    return neardup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages (operator 6)."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, repeated as its epochs say (operator 10)."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix, read back from the token folder (operator 9)."""
    return tokens.tokenized(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("jaccard_join", deduplicate),
    ("decontaminate", clean),
    ("mix_sources", mix),
    ("token_files", tokenize),
]

#: SQL cannot express these stages; the test runs the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`: `doc_id, start, n_tokens, ids_crc32` of what they keep.

    A stage's rows, and the scratch tables that it made, go once the next one's are written; the last
    stage's rows and the token folder stay. Null and empty texts and those without letters go with the
    first stage; repeated rows are copies for the second, so one of them stays; null ids, null sources
    and extra columns, of whatever names, pass through; without documents there are no rows.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = common.scratch(spark, f"pipeline-{name}")
        with common.swept(spark, "tokens"):
            docs = common.saved(stage(spark, docs, sf_dir), name, path)
        if before:
            common.discard(spark, before)
        before = path
    return docs
