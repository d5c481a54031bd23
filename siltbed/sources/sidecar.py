"""Metadata sidecars: one JSON document a shard, with its entries by `uid:time` and its tombstones.

In Spark they are two tables, `entries` and `tombstones`; the JSON is for exchange. A rebuild reads
payloads again for their checksums and never invents or drops tombstones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import routing as r
from siltbed.functions import scalars

#: Fields of an entry and of a tombstone.
ENTRY = {
    "uid": "string", "offset": "bigint", "length": "bigint", "codec": "string", "compressed_size": "bigint", "uncompressed_size": "bigint", "is_bigfile": "boolean",
    "bigfile_hash": "string", "bigfile_size": "bigint", "meta": "map<string,string>", "checksum": "string", "checksum_algo": "string",
}
TOMBSTONE = {"deleted_at": "string", "deleted_by": "string", "reason": "string", "ticket_id": "string"}
_struct = lambda fields: f"struct<{', '.join(f'{name}: {kind}' for name, kind in fields.items())}>"
#: Fields of a sidecar; all but the last are required.
FIELDS = {
    "version": "int", "shard_file": "string", "shard_size": "bigint", "created_at": "string", "last_updated": "string",
    "index": f"map<string, {_struct(ENTRY)}>", "tombstones": f"map<string, {_struct(TOMBSTONE)}>", "stats": "map<string, double>",
}
REQUIRED = [c for c in FIELDS if c != "stats"]


def entries_of(payloads: DataFrame) -> DataFrame:
    """Rebuilt entries (shard_file, key, uid, created_at, checksum, ...) from read_payloads(): the key is `uid:time`, or the uid where the notes name no time."""
    at = scalars.try_parse_iso(F.get_json_object("meta", "$.created_at"))
    key = F.when(at.isNull(), F.col("uid")).otherwise(r.metadata_key(F.col("uid"), at))
    return payloads.withColumns({"created_at": at, "key": key, "checksum": F.sha2("payload", 256), "checksum_algo": F.lit("sha256")})


def to_json(entries: DataFrame, tombstones: DataFrame, now) -> DataFrame:
    """(shard_file, json): a sidecar for each shard of entries (shard_file, shard_size, key, uid, checksum and, if they have them, the fields of an entry).

    A shard's entries are as many as its index holds, which the plan bounds."""
    column = lambda c, kind: (F.col(c).cast(kind) if c in entries.columns and c != "meta" else F.lit(None).cast(kind)).alias(c)
    by_key = lambda x, y: F.when(x.key < y.key, -1).when(x.key > y.key, 1).otherwise(0)
    rows = entries.select("shard_file", "shard_size", "key", F.struct(*[column(*x) for x in ENTRY.items()]).alias("entry"))
    index = rows.groupBy("shard_file").agg(F.max("shard_size").alias("shard_size"), F.count("*").alias("entries"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "entry")), by_key)).alias("index"))
    dead = tombstones.groupBy("shard_file").agg(F.count("*").alias("deleted"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct("deleted_at", "deleted_by", "reason", "ticket_id").alias("t"))))).alias("tombstones"))
    both = index.join(dead, "shard_file", "left")
    deleted = F.coalesce("deleted", F.lit(0))
    stats = F.create_map(F.lit("entries"), F.col("entries").cast("double"), F.lit("deleted_files"), deleted.cast("double"), F.lit("deletion_ratio"), F.coalesce(F.try_divide(deleted, F.col("entries")), F.lit(0.0)))
    no_dead = F.from_json(F.lit("{}"), f"map<string, {_struct(TOMBSTONE)}>")
    document = F.struct(F.lit(1).alias("version"), "shard_file", "shard_size", r.iso_utc(now).alias("created_at"), r.iso_utc(now).alias("last_updated"), "index", F.coalesce("tombstones", no_dead).alias("tombstones"), stats.alias("stats"))
    return both.select("shard_file", F.to_json(document).alias("json"))


def parse(sidecars: DataFrame, column: str = "json") -> DataFrame:
    """Sidecars as typed columns; a document that is malformed, lacks a field or has a negative size is an error."""
    doc = F.from_json(column, _struct(FIELDS), {"mode": "FAILFAST"})
    missing = F.concat_ws(", ", *[F.when(F.get_json_object(column, f"$.{c}").isNull(), c) for c in REQUIRED])
    read = sidecars.select(F.when(missing != "", F.raise_error(F.concat(F.lit("the sidecar lacks "), missing)).cast(_struct(FIELDS))).otherwise(doc).alias("doc")).select("doc.*")
    size = F.when(F.col("shard_size") < 0, F.raise_error(F.lit("shard_size must not be negative")).cast("bigint")).otherwise(F.col("shard_size"))
    return read.withColumns({"shard_size": size, "created_at": scalars.parse_iso(F.col("created_at")), "last_updated": scalars.parse_iso(F.col("last_updated"))})


def explode_entries(parsed: DataFrame) -> DataFrame:
    """(shard_file, key, uid, created_at, ...) of every entry."""
    rows = parsed.select("shard_file", F.explode("index").alias("key", "entry"))
    at = F.coalesce(scalars.try_parse_iso(F.try_element_at("entry.meta", F.lit("created_at"))), scalars.try_parse_iso(scalars.time_of_key(F.col("key"))))
    return rows.select("shard_file", "key", at.alias("created_at"), "entry.*")


def explode_tombstones(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("shard_file", F.explode("tombstones").alias("key", "t"))
    return rows.select("shard_file", "key", scalars.uid_of_key(F.col("key")).alias("uid"), scalars.try_parse_iso(scalars.time_of_key(F.col("key"))).alias("created_at"), "t.*")


def missing(shards: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Shards (shard_file) without a sidecar (meta_file)."""
    return shards.withColumn("meta_file", r.meta_file(F.col("shard_file"))).join(sidecars.select("meta_file").distinct(), "meta_file", "left_anti")


def write(sidecars: DataFrame, folder: str) -> DataFrame:
    """Writes folder/<shard>.meta for each row of to_json(): (shard_file, path)."""
    import pyarrow as pa

    from siltbed.sources import files

    def each(batches):
        system, at = files.system_of(folder)
        system.create_dir(at, recursive=True)
        for batch in batches:
            names, paths = batch.column(0).to_pylist(), []
            for name, text in zip(names, batch.column(1).to_pylist(), strict=True):
                paths.append(f"{folder}/{name.removesuffix('.des')}.meta")
                with system.open_output_stream(f"{at}/{name.removesuffix('.des')}.meta") as o:
                    o.write(text.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["shard_file", "path"])

    return sidecars.select("shard_file", "json").mapInArrow(each, "shard_file string, path string")


def read(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.meta").load(folder)
    return parse(found.select(F.decode("content", "utf-8").alias("json")))
