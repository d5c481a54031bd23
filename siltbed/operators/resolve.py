"""Batch lookups: requests against index, tombstones and extended retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["date_dir", "shard_hex", "uid"]


def lookup(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Each request with its first shard by name (only the day of created_at matters), null if none."""
    hits = index.groupBy(*KEY).agg(F.min("shard_file").alias("shard_file"))
    return requests.join(hits, KEY, "left")


def exists(requests: DataFrame, index: DataFrame) -> DataFrame:
    return requests.join(index.select(*KEY).distinct(), KEY, "left_semi")


def resolve(requests: DataFrame, index: DataFrame, tombstones: DataFrame, ext: DataFrame) -> DataFrame:
    """status and http_code: a tombstone of the exact time in the shard found gives 410, a copy in extended
    retention beats the shard, and serves alone where no shard has the uid; nothing at all is 404."""
    found = lookup(requests, index)
    dead = tombstones.select("uid", "created_at", F.lit(True).alias("dead")).distinct()
    kept = ext.select("uid", "created_at", F.lit(True).alias("kept")).distinct()
    all_ = found.join(dead, ["uid", "created_at"], "left").join(kept, ["uid", "created_at"], "left")
    in_shard = F.col("shard_file").isNotNull()
    status = F.when(in_shard & F.col("dead"), "deleted").when(F.col("kept"), "ext_retention").when(in_shard, "shard").otherwise("not_found")
    return all_.withColumn("status", status).withColumn("http_code", F.when(F.col("status") == "deleted", 410).when(F.col("status") == "not_found", 404).otherwise(200))


def entry_with_fallback(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Metadata entry of (uid, created_at): the exact key, else the bare uid, else the uid's only dated key."""
    e = entries.select("uid", F.col("created_at").alias("entry_at"), "checksum")
    n = F.count(F.when(F.col("entry_at").isNotNull(), 1)).over(Window.partitionBy("req_id"))
    rank = F.when(F.col("entry_at") == F.col("created_at"), 0).when(F.col("entry_at").isNull() & F.col("checksum").isNotNull(), 1).when(n == 1, 2)
    ranked = requests.join(e, "uid", "left").withColumn("rank", rank)
    first = Window.partitionBy("req_id").orderBy(F.col("rank").asc_nulls_last(), "entry_at")
    out = ranked.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return out.withColumn("checksum", F.when(F.col("rank").isNotNull(), F.col("checksum")))


def delete_target(requests: DataFrame, entries: DataFrame, index: DataFrame) -> DataFrame:
    """requests (req_id, date_dir, shard_hex, uid, created_at) with the first shard by name whose sidecar has the entry (entries: shard_file, date_dir,
    shard_hex, uid, created_at; a null time is the bare uid) or else whose index has the uid; null if none."""
    e = entries.select(*KEY, "shard_file", F.col("created_at").alias("entry_at"))
    found = requests.join(e, KEY, "left")
    n = F.count("entry_at").over(Window.partitionBy("req_id", "shard_file"))
    named = found.withColumn("_n", n).where((F.col("entry_at") == F.col("created_at")) | (F.col("shard_file").isNotNull() & F.col("entry_at").isNull()) | (F.col("_n") == 1)).select("req_id", "shard_file")
    held = requests.join(index.select(*KEY, "shard_file"), KEY).select("req_id", "shard_file")
    first = named.union(held).groupBy("req_id").agg(F.min("shard_file").alias("target"))
    return requests.join(first, "req_id", "left")


def zone_of(routed: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones as one row for each index (a fixed number, 2^n_bits), so that the range lookup is an equi-join."""
    each = zones.select("zone", F.explode(F.sequence("start", "end")).alias("shard_index"))
    first = each.groupBy("shard_index").agg(F.min("zone").alias("zone"))
    return routed.join(F.broadcast(first), "shard_index", "left")


def zone_overlaps(zones: DataFrame, n_bits: int) -> DataFrame:
    each = zones.select("zone", F.explode(F.sequence("start", "end")).alias("shard_index"))
    bad = each.groupBy("shard_index").agg(F.count("*").alias("zones"))
    return bad.where((F.col("zones") > 1) | (F.col("shard_index") >= 1 << n_bits) | (F.col("shard_index") < 0))
