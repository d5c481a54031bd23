"""Routing and greedy next-fit shard plans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.functions import routing as r


def route(files: DataFrame, n_bits: int = 8) -> DataFrame:
    index = r.shard_index(F.col("uid"), n_bits)
    return files.withColumns({"date_dir": r.date_dir(F.col("created_at")), "shard_index": index}).withColumn("shard_hex", r.shard_hex(F.col("shard_index"), n_bits)).withColumn("object_key", r.object_key(F.col("date_dir"), F.col("shard_hex")))


def check_sizes(files: DataFrame) -> DataFrame:
    """Sizes as whole numbers, an unknown one as 0; raises where one is negative or no number."""
    size = F.coalesce(F.col("size_bytes").cast("bigint"), F.lit(0).cast("bigint"))
    return files.withColumn("size_bytes", F.when(size < 0, F.raise_error(F.lit("size_bytes must not be negative")).cast("bigint")).otherwise(size))


def estimate(routed: DataFrame, most: int) -> DataFrame:
    return routed.groupBy("date_dir", "shard_hex").agg(F.expr(f"(sum(size_bytes) + {most - 1}) div {most}").alias("estimated_shards"))


def plan(routed: DataFrame, most: int, keep: list[str] | None = None) -> DataFrame:
    """Adds shard_seq, the 0-based shard of each file in its key: files in order of ord go into the open shard,
    which closes when it has files and the next one would not fit. Next fit is sequential within a key: keys are dealt
    to partitions, sorted there by Spark (which spills), and stream through one fold that holds a single total.
    A key is a day and one of 2^n_bits hashes, so more bits bound what one task streams. Columns of `keep` stay."""
    if most <= 0:
        raise ValueError("the shard size must be positive")
    own = check_sizes(routed).select("date_dir", "shard_hex", "uid", "created_at", "size_bytes", "ord", *(keep or []))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, total = None, 0, None
        for batch in batches:
            out = []
            for day, hex_, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if (day, hex_) != key:
                    key, seq, total = (day, hex_), 0, None
                if total is not None and total + size > most:
                    seq, total = seq + 1, 0
                total = (total or 0) + size
                out.append(seq)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "shard_seq"])

    dealt = own.repartition("date_dir", "shard_hex").sortWithinPartitions("date_dir", "shard_hex", "ord")
    return dealt.mapInArrow(fold, T.StructType([*own.schema.fields, T.StructField("shard_seq", T.LongType())]))


def manifest(planned: DataFrame) -> DataFrame:
    out = planned.groupBy("date_dir", "shard_hex", "shard_seq").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_size"))
    return out.withColumn("shard_file", r.shard_file(F.col("date_dir"), F.col("shard_hex"), F.col("shard_seq")))


def offsets(planned: DataFrame, header: int = 8) -> DataFrame:
    """Byte offset of each entry in its shard; entries out of line (is_bigfile) take no bytes."""
    w = Window.partitionBy("date_dir", "shard_hex", "shard_seq").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return planned.withColumn("offset", F.lit(header) + F.coalesce(F.sum("size_bytes").over(w), F.lit(0)))
