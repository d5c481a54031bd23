"""Checksums, index against metadata, storage efficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_bigfiles(payloads: DataFrame, threshold: int) -> DataFrame:
    """is_bigfile (strictly above the threshold), its content hash, and the bytes that stay in the shard."""
    big = F.col("size_bytes") > threshold
    return payloads.withColumns({"is_bigfile": big, "bigfile_hash": F.when(big, F.sha2("payload", 256)), "inline_bytes": F.when(big, 0).otherwise(F.col("size_bytes"))})


def bigfile_uploads(split: DataFrame) -> DataFrame:
    """One row for each distinct content."""
    return split.where("is_bigfile").groupBy("bigfile_hash").agg(F.count("*").alias("references"), F.min("size_bytes").alias("bigfile_size"))


def checksum_audit(payloads: DataFrame, recorded: DataFrame) -> DataFrame:
    """verified, corrupted or missing_checksum for each entry of the recorded checksums. An entry without uid or time, without a
    payload, or with another algorithm than SHA-256 (checksum_algo, if recorded has it) is corrupted."""
    now = payloads.select("uid", "created_at", F.sha2("payload", 256).alias("actual"))
    unsure = F.col("uid").isNull() | F.col("created_at").isNull()
    if "checksum_algo" in recorded.columns:
        unsure |= F.col("checksum").isNotNull() & (F.coalesce("checksum_algo", F.lit("sha256")) != "sha256")
    status = F.when(unsure, "corrupted").when(F.col("checksum").isNull(), "missing_checksum").when(F.col("actual").isNull() | (F.col("actual") != F.col("checksum")), "corrupted").otherwise("verified")
    return recorded.join(now, ["uid", "created_at"], "left").withColumn("status", status)


def first_entries(entries: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first n entries of a shard in index order: what a quick audit looks at."""
    return entries.orderBy(order).limit(n)


def first_errors(rows: DataFrame, n: int = 10, order: str = "ord") -> DataFrame:
    """The first n rows whose status is not ok."""
    return rows.where("status <> 'ok'").orderBy(order).limit(n)


def random_shards(shards: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """n shards by the order of a seeded hash of their names: the same ones whenever the seed is the same."""
    return shards.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "shard_file").cast("binary")), "shard_file").limit(n)


def compression(entries: DataFrame) -> DataFrame:
    """Full over stored bytes, and the calls of an object store that shards save: one for each entry but one for each shard."""
    return entries.agg(
        F.round(F.try_divide(F.sum("size").cast("double"), F.sum("length")), 6).alias("compression_ratio"),
        (F.count("*") - F.count_distinct("shard_file")).alias("calls_saved"),
        F.round(100.0 * (1 - F.try_divide(F.count_distinct("shard_file"), F.count("*"))), 6).alias("calls_saved_pct"),
    )


def differences(index: DataFrame, meta: DataFrame) -> DataFrame:
    """uids of one side alone."""
    a, c = index.select("uid").distinct(), meta.select("uid").distinct()
    return a.join(c, "uid", "left_anti").withColumn("side", F.lit("missing_in_meta")).union(c.join(a, "uid", "left_anti").withColumn("side", F.lit("missing_in_shard")))


def efficiency(manifest: DataFrame, block: int = 4096) -> DataFrame:
    padded = F.ceil(F.col("total_size") / block) * block
    return manifest.agg(F.sum("file_count").cast("long").alias("files"), F.count("*").alias("shards"), F.sum("total_size").cast("long").alias("bytes"), F.round(F.sum("file_count") / F.count("*"), 6).alias("object_reduction"), F.round(100.0 * F.sum("total_size") / F.sum(padded), 6).alias("efficiency_pct"), F.round(F.avg("total_size"), 6).alias("mean_shard"))
