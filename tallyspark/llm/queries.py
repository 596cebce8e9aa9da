"""The registered queries of the corpus operators, with production parameters.

Each takes whole tables through its operator and keeps ids and digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tallyspark.llm import (
    audit, compression, decontam, divergence, fim, html_text, licenses, pieces, pii, simhash, substrings, tokens, toxicity,
)
from tallyspark.llm.common import in_sample, small_batches, table
from tallyspark.llm.oracles import ORACLES


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_class"
    )


def op3_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sample_encodings(table(spark, sf_dir, "documents"))


def op4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", divergence.rules()("text").alias("found")).select("doc_id", "found.*")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", licenses.scans()("text").alias("found")).select("doc_id", "found.*")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = html_text.extractor(html_text.learn())("html")
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pii.finder(pii.learn())("text").alias("found")).select("doc_id", "found.*")


def op8_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = compression.scorer(compression.learn(docs, table(spark, sf_dir, "labels")))
    return docs.select(
        "doc_id",
        (~in_sample(compression.LABEL_BUCKETS, compression.LABEL_HELD_OUT)).alias("held_out"),
        score("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = toxicity.scorer(toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return docs.select(
        "doc_id",
        (~in_sample(toxicity.LABEL_BUCKETS, toxicity.LABEL_HELD_OUT)).alias("held_out"),
        score("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokens.Tokenizer.load(public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_decontaminate": op1_decontaminate,
        "op2_simhash": op2_simhash,
        "op3_sample_pieces": op3_sample_pieces,
        "op4_divergence": op4_divergence,
        "op5_licenses": op5_licenses,
        "op6_html": op6_html,
        "op7_pii": op7_pii,
        "op8_compression": op8_compression,
        "op9_toxicity": op9_toxicity,
        "op10_substrings": op10_substrings,
        "op11_audit": op11_audit,
        "op12_tokens": op12_tokens,
        "op13_fim": op13_fim,
    }

    def batched(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return query(spark, sf_dir)

        return run

    return {name: batched(query) for name, query in found.items()}


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
