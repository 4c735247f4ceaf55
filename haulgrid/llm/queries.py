"""The registered queries of the operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.functions.lineage import scratch_path
from haulgrid.llm import (
    collocations,
    decontaminate,
    divergence,
    exact_dedup,
    languages,
    licenses,
    near_dedup,
    packing,
    pii,
    repeated_spans,
    secret_scan,
    toxicity,
    warc,
)
from haulgrid.llm.common import row_keyed, table

#: A key for the query; a deployment gives its own.
PII_KEY = "a key only this query uses"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = row_keyed(documents(spark, sf_dir).select("doc_id", "text"))
    return exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text")
    found = secret_scan.scan_into(versions, scratch_path(spark, "blob-ledger"))
    spans = secret_scan.span_text(F.col("spans"))
    return found.select(
        F.col("path").alias("doc_id"), *[secret_scan.count_of(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, docs = toxicity.Ftrl(), documents(spark, sf_dir)
    score = toxicity.scorer(spark, toxicity.train(docs, table(spark, sf_dir, "labels"), p), p)
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = row_keyed(documents(spark, sf_dir).select("doc_id", "text"))
    found = near_dedup.near_classes(docs.select("_row", "text"), near_dedup.Signature(words=2))
    found = near_dedup.with_ids(found, docs)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("_row") == F.col("component")).alias("kept"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = row_keyed(documents(spark, sf_dir).select("doc_id", "text"))
    done = pii.pseudonymise(docs, PII_KEY)
    counts = [secret_scan.count_of(F.col("entities"), k).alias(f"n_{k}") for k in pii.KINDS]
    return done.select("doc_id", *counts, F.transform("entities", lambda e: e["surrogate"]).alias("surrogates"), "text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_sentences", "sentence_ids", "licenses")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.mark_contaminated(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "hits.n_words", F.size("hits.words").cast("long").alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (F.size("hits.words") > 0).alias("contaminated"),
    )


def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = row_keyed(documents(spark, sf_dir).select("doc_id", "text"))
    cut = repeated_spans.remove_repeats(docs, with_kept=False)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir).select("text", "lang", "source"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    told = languages.identify(docs.select("doc_id", "text"), languages.train(docs))
    return told.select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir).select("text", "lang"))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_secret_scan, op3_toxicity, op4_packing, op5_minhash_near_dedup, op6_pii_surrogates, op7_license_scan, op8_warc, op9_decontamination, op10_repeated_spans, op11_source_divergence, op12_language_id, op13_collocations,
)}
