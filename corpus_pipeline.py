"""From raw documents to packed training sequences: five stages, each one of the library's corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from haulgrid.llm.common import packed, store, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; trained on the labelled rows of `labels` that are among `docs`."""
    p = toxicity.Ftrl()
    score = toxicity.scorer(spark, toxicity.train(docs, table(spark, sf_dir, "labels"), p), p)
    return packed(docs).filter(score("text") < p.threshold).select("doc.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without blanks, the longest one."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 (five-word shingles) connect, the one with the smallest doc_id."""
    return near_dedup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    marked = decontaminate.mark_contaminated(packed(docs), table(spark, sf_dir, "benchmark"))
    return marked.filter(F.size("hits.words") == 0).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Tokens are not SQL's: the pipeline is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spark.read.parquet(store(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
