"""Shard files as DataFrames: listing, index and payload reads by ranges, packing into folders or object stores.

Only names, sizes and index entries are rows in Spark until a payload is asked for; a
worker holds one payload, and the index of one shard, at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.functions import routing as r
from siltbed.functions import scalars
from siltbed.operators import planner
from siltbed.sources import files
from siltbed.sources import shard_format as f

ENTRY = "path string, shard_file string, uid string, is_bigfile boolean, bigfile_hash string, codec string, offset long, length long, size long, meta string, number int"
_ENTRY = pa.schema([("path", pa.string()), ("shard_file", pa.string()), ("uid", pa.string()), ("is_bigfile", pa.bool_()), ("bigfile_hash", pa.string()), ("codec", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("size", pa.int64()), ("meta", pa.string()), ("number", pa.int32())])
#: Bytes of payloads in an Arrow batch that a worker sends on.
HELD = 4 << 20


def list_shards(spark: SparkSession, folder: str, date_dir: str | None = None, shard_hex: str | None = None) -> DataFrame:
    """(path, shard_file, date_dir, shard_hex, length, modified) of the shards below a folder, or of one key; no content is read."""
    names = f"{date_dir or '*'}_{shard_hex or '*'}_*.des"
    found = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("shard_file"), F.split(name, "_")[0].alias("date_dir"), F.split(name, "_")[1].alias("shard_hex"), "length", F.col("modificationTime").alias("modified"))


def list_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.meta").load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("meta_file"), "length")


def read_entries(shards: DataFrame) -> DataFrame:
    """The index entries of listed shards, three range reads each; `number` is the place in the index."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with files.Ranges(path, size) as ranges:
                    found = f.fetch_index(ranges, size)
                rows = [{"path": path, "shard_file": name, "uid": u, "number": i, **e, "meta": json.dumps(e["meta"])} for i, (u, e) in enumerate(found.items())]
                yield pa.RecordBatch.from_pylist(rows, _ENTRY)

    return shards.select("path", "shard_file", "length").mapInArrow(each, ENTRY)


def read_payloads(entries: DataFrame, big: str | None = None) -> DataFrame:
    """entries with their payload: one range read each, those of a shard one after the other; big files come from the folder `big`, by default the one beside the shard."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: files.Ranges | None = None
        at = None
        for batch in batches:
            rows, held = [], 0
            for e in batch.to_pylist():
                if e["path"] != at:
                    if opened:
                        opened.file.close()
                    opened, at = files.Ranges(e["path"]), e["path"]
                store = big or f"{e['path'].rpartition('/')[0]}/{f.BIG}"
                e["payload"] = f.fetch(opened, e, lambda digest, store=store: files.read(f"{store}/{digest}"))
                rows.append(e)
                held += len(e["payload"])
                if held > HELD:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)
        if opened:
            opened.file.close()

    own = entries.select(*_ENTRY.names)
    schema = pa.schema([*_ENTRY, ("payload", pa.binary())])
    return own.sortWithinPartitions("path", "offset").mapInArrow(each, f"{ENTRY}, payload binary")


def read_sources(rows: DataFrame, column: str = "source_path") -> DataFrame:
    """rows with the bytes of the file that `column` names, local or in an object store; a missing name is an error."""
    own = rows.withColumn(column, F.coalesce(F.col(column), F.raise_error(F.lit(f"{column} is missing")).cast("string")))
    kind = pa.field("payload", pa.binary())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(batch.schema.get_field_index(column)).to_pylist()
            for i, name in enumerate(names):
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([files.read(name)], pa.binary())], schema=pa.schema([*one.schema, kind]))

    schema = T.StructType([*own.schema.fields, T.StructField("payload", T.BinaryType())])
    return own.mapInArrow(each, schema)


WRITTEN = "shard_file string, path string, file_count long, total_size long, bytes long, bigfiles array<string>"
_WRITTEN = pa.schema([("shard_file", pa.string()), ("path", pa.string()), ("file_count", pa.int64()), ("total_size", pa.int64()), ("bytes", pa.int64()), ("bigfiles", pa.list_(pa.string()))])


def write_shards(planned: DataFrame, folder: str, threshold: int | None = 10 << 20, profile: str = "balanced") -> DataFrame:
    """One row a shard, from rows (shard_file, uid, payload, size_bytes, ord, and created_at if known): writes folder/shard_file, and big payloads once each below folder/_bigFiles.

    Rows of a shard reach one task sorted, and each payload is written as it comes. Files are written under a name of
    the attempt and then moved, so a task that is done again overwrites what it left."""
    codec, level = f.PROFILES[profile]
    has_time = "created_at" in planned.columns
    created = r.iso_utc(F.col("created_at")) if has_time else F.lit(None).cast("string")
    own = planned.select("shard_file", "uid", "payload", "ord", F.col("size_bytes").cast("long").alias("size"), created.alias("created"), r.should_compress(F.col("uid"), codec).alias("compress"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = files.system_of(folder)
        system.create_dir(f"{at}/{f.BIG}", recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        shard, out, w, count, total = None, None, None, 0, 0

        def spill(digest: str, data: bytes) -> None:
            target = f"{at}/{f.BIG}/{digest}"
            if system.get_file_info(target).is_file:
                return
            with system.open_output_stream(f"{target}-{attempt}") as o:
                o.write(data)
            system.move(f"{target}-{attempt}", target)

        def close() -> pa.RecordBatch:
            size = w.finish()
            out.close()
            system.move(f"{at}/_{shard}-{attempt}", f"{at}/{shard}")
            return pa.RecordBatch.from_pylist([{"shard_file": shard, "path": f"{folder}/{shard}", "file_count": count, "total_size": total, "bytes": size, "bigfiles": sorted(w.big)}], _WRITTEN)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}
                if row["shard_file"] != shard:
                    if w:
                        yield close()
                    shard, count, total = row["shard_file"], 0, 0
                    out = system.open_output_stream(f"{at}/_{shard}-{attempt}")
                    w = f.Writer(out, threshold, spill, codec, level)
                w.add(row["uid"], row["payload"] or b"", {"created_at": row["created"]} if row["created"] else None, row["compress"])
                count, total = count + 1, total + (row["size"] or 0)
        if w:
            yield close()

    return own.repartition("shard_file").sortWithinPartitions("shard_file", "ord").mapInArrow(write, WRITTEN)


def pack(listed: DataFrame, folder: str, most: int = 1_000_000_000, n_bits: int = 8, threshold: int | None = 10 << 20, profile: str = "balanced") -> DataFrame:
    """Routes, plans, reads the sources and writes the shards of (uid, created_at, size_bytes, source_path, ord): one row a shard. No rows, no shards."""
    plan = planner.plan(planner.route(listed, n_bits), most, keep=["source_path"])
    plan = plan.withColumn("shard_file", r.shard_file(F.col("date_dir"), F.col("shard_hex"), F.col("shard_seq")))
    return write_shards(read_sources(plan), folder, threshold, profile)


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Files with their order as ord, from a JSON array, or from JSON lines, which several tasks can read; uids and sizes may be numbers or text."""
    rows = spark.read.schema("uid string, created_at string, size_bytes string, source_path string").option("multiLine", not lines).json(path)
    return rows.select("uid", scalars.parse_iso(F.col("created_at")).alias("created_at"), F.col("size_bytes").cast("long").alias("size_bytes"), "source_path", F.monotonically_increasing_id().alias("ord"))


def lookup(spark: SparkSession, folder: str, uid: str, created_at: str, n_bits: int = 8) -> DataFrame:
    """The payload of one key: lists the key's shards alone, reads their indexes, takes the first by name."""
    key = planner.route(spark.createDataFrame([(uid, created_at)], "uid string, at string").select("uid", scalars.parse_iso(F.col("at")).alias("created_at")), n_bits).first()
    entries = read_entries(list_shards(spark, folder, key["date_dir"], key["shard_hex"])).where(F.col("uid") == uid)
    return read_payloads(entries.orderBy("shard_file").limit(1))


def remove_sources(packed: DataFrame, column: str = "source_path") -> DataFrame:
    """Deletes the sources of packed rows: (source_path, error), errors do not stop the others."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for name in batch.column(0).to_pylist():
                try:
                    files.delete(name)
                    errors.append(None)
                except Exception as e:
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], ["source_path", "error"])

    return packed.select(F.col(column).alias("source_path")).mapInArrow(each, "source_path string, error string")


def write_payloads(routed: DataFrame, path: str) -> None:
    """The native store: Parquet by day, sorted by shard and uid, so that lookups prune files and row groups."""
    routed.repartition("date_dir", "shard_index").sortWithinPartitions("date_dir", "shard_index", "uid").write.partitionBy("date_dir").mode("overwrite").parquet(path)


def prune(df: DataFrame, uid: Column, created_at: Column, n_bits: int = 8) -> DataFrame:
    """df cut to the one partition that a key can be in."""
    return df.where((F.col("date_dir") == r.date_dir(created_at)) & (F.col("shard_index") == r.shard_index(uid, n_bits)) & (F.col("uid") == uid))
