"""The queries of the training-data operators; each reads its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.llm import decontamination, licence_scan, line_dedup, oracles, piece_codec, quality, secret_scan, simhash_trie, suffix_collection, vector_graph, warc_revisit
from quiremill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """A public tokenizer's file; ``QUIREMILL_TOKENIZERS`` names another folder."""
    folder = os.environ.get("QUIREMILL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_collection.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.encode_and_decode(docs, model)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def _held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~_held_out())
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select(
        "doc_id",
        _held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.report(docs, table(spark, sf_dir, "benchmark"))
    digest = lambda items: F.sha2(F.array_join(items, ",").cast("binary"), 256)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        digest("items").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
        digest("near").alias("near_sha256"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = [
        F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
        for kind in ("assign", "access", "hex")
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.joined("base").cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined("spans").alias("spans"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_trie.components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc_revisit.resolve(warc_revisit.captures_of_pages(pages))
    shown = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("record_id", "key", "response_id", "verdict", shown.alias("headers"), "digest", "length")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licence_scan.scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id",
        "n_links",
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_quality": op3_quality,
        "op4_decontamination": op4_decontamination,
        "op5_line_dedup": op5_line_dedup,
        "op6_secrets": op6_secrets,
        "op7_simhash": op7_simhash,
        "op8_warc_revisits": op8_warc_revisits,
        "op9_license_scan": op9_license_scan,
        "op10_embeddings": op10_embeddings,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": oracles.OP1_SQL,
        "op4_decontamination": oracles.OP4_SQL,
        "op6_secrets": oracles.OP6_SQL,
        "op8_warc_revisits": oracles.OP8_SQL,
        "op10_embeddings": oracles.OP10_SQL,
    }
