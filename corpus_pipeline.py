"""From raw documents to token ids: rules, near copies, benchmark leaks, personal data, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.llm import bpe, decontam, jaccard, pseudonyms, quality
from logvane.llm.common import table
from logvane.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counted rules and the log-likelihood ratio."""
    return quality.keep(docs, quality.trusted(table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the smallest doc_id."""
    return jaccard.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data and n_chars of the new text."""
    changed = pseudonyms.pseudonymise(docs)
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    whole = changed.select(
        *[F.col(f"row.`{c}`") for c in kept], "text", F.length("text").cast("long").alias("n_chars")
    )
    return whole.select(*[F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, lang, source, n_tokens and `ids` (little-endian, 32 bits each)."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select(
        "row.doc_id",
        "row.lang",
        "row.source",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: The stages use hashes, models and encodings that SQL does not have; tests hold them against
#: brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
