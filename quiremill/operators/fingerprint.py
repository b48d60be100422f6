"""Fingerprints of chunks, changes between versions, and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiremill.functions import text as X

FORMAT = "quiremill-bundle/1"


def fingerprinted(chunks: DataFrame, content: str = "content", types: str = "types") -> DataFrame:
    """Append content_hash and structure_hash."""
    return chunks.withColumn("content_hash", X.content_hash(F.col(content))).withColumn("structure_hash", X.plain_hash(F.col(types)))


def changed(old: DataFrame, new: DataFrame, key: str = "doc_id", index: str = "chunk_idx") -> DataFrame:
    """(key, index) of chunks that one side lacks or that differ in a hash; one full outer join."""
    names = ["content_hash", "structure_hash"]
    a = old.select(key, index, *[F.col(n).alias(f"a_{n}") for n in names], F.lit(True).alias("_a"))
    b = new.select(key, index, *[F.col(n).alias(f"b_{n}") for n in names], F.lit(True).alias("_b"))
    both = a.join(b, [key, index], "full_outer")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for n in names:
        same = same & F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}"))
    return both.where(~same).select(key, index)


def duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(content_hash, digest, n, first) of contents that come more than once, apart from case and spaces.

    Contents are equal by the SHA-256 of their normal form; the 32-bit hash beside it is no proof of that.
    """
    normal = docs.select(key, X.normalised(F.col(text)).alias("_normal"))
    marked = normal.select(key, F.sha2(F.col("_normal").cast("binary"), 256).alias("digest"), X.plain_hash(F.col("_normal")).alias("content_hash"))
    return marked.groupBy("content_hash", "digest").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def packed(results: DataFrame, *fields: str) -> DataFrame:
    """Append a bundle of some columns: format, payload (base64 of JSON) and its fingerprint."""
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    payload = F.regexp_replace(F.base64(F.encode(body, "UTF-8")), r"[\r\n]", "")
    return results.withColumn(
        "bundle", F.struct(F.lit(FORMAT).alias("format"), F.octet_length(body).alias("size"), X.bundle_hash(body).alias("fingerprint"), payload.alias("payload"))
    )


def bundle_totals(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("chunk_count"), F.sum("token_count").alias("token_count"))


def unpacked(bundles: DataFrame, schema: T.StructType | str, bundle: str = "bundle", strict: bool = False) -> DataFrame:
    """Replace bundles by their columns and an ``error``; with ``strict`` a bad one fails the job."""
    b = F.col(bundle)
    raw = F.try_to_binary(b["payload"], F.lit("base64"))
    text: Column = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    made = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    error = (
        F.when(~b["format"].eqNullSafe(FORMAT), "unknown format")
        .when(raw.isNull(), "bad base64")
        .when(text.isNull(), "bad UTF-8")
        .when(F.try_parse_json(text).isNull(), "bad JSON")
    )
    out = bundles.withColumn("error", error)
    if strict:
        out = out.withColumn("error", F.when(F.col("error").isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(F.col("error")).cast("string")))
    return out.withColumn("_made", F.when(F.col("error").isNull(), made)).drop(bundle).select("*", "_made.*").drop("_made")
