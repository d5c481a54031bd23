"""Archiving cycles as batch jobs: by watermark, by flag, and in a loop."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.operators import archive
from siltbed.sources import shards
from siltbed.sources.state import State


def check_locations(files: DataFrame, listing: DataFrame | None, with_objects: bool) -> DataFrame:
    """files with `error` (null if fine): a location in an object store needs a reader of objects, any other must be a file of the listing (path, is_file)."""
    s3 = F.startswith("file_location", F.lit("s3://"))
    if listing is None:
        return files.withColumn("error", F.when(s3 & F.lit(not with_objects), F.concat(F.lit("no reader of objects for "), "file_location")))
    known = listing.select(F.col("path").alias("file_location"), "is_file")
    text = lambda why: F.concat(F.lit(why), "file_location")
    error = F.when(s3, F.when(F.lit(not with_objects), text("no reader of objects for "))).when(F.col("is_file").isNull(), text("no file at ")).when(~F.col("is_file"), text("not a file: "))
    return files.join(known, "file_location", "left").withColumn("error", error).drop("is_file")


def by_watermark(files: DataFrame, state: State, now: Column, folder: str, most: int = 1_000_000_000, n_bits: int = 8) -> DataFrame | None:
    """Packs (uid, created_at, size_bytes, source_path, ord) of the next window into folder/until=<end>, then advances the state: the shards' rows, or None where the window is empty.

    Shards lie in the window's own folder, written over when it is done again, and the state moves last: a cycle that breaks off is repeated whole."""
    window = state.window(now).first()
    start, end = window["window_start"], window["window_end"]
    if start >= end:
        return None
    rows = archive.in_window(files, F.lit(start), F.lit(end))
    target = f"{folder.rstrip('/')}/until={end:%Y%m%dT%H%M%S}"
    spark = files.sparkSession
    shards.pack(rows, target, most, n_bits).write.mode("overwrite").parquet(f"{target}/_manifest")
    made = spark.read.schema(shards.WRITTEN).parquet(f"{target}/_manifest")
    if made.limit(1).count():
        state.advance(state.window(now))
    return made


def by_flag(files: DataFrame, cutoff: Column, listing: DataFrame, folder: str, limit: int | None = None, most: int = 1_000_000_000, n_bits: int = 8, cleanup: bool = False) -> tuple[DataFrame, DataFrame]:
    """(counters, files with their flags) of one cycle: fetch, validate, pack, mark, clean up. `files` has file_location; only packed rows are marked and their sources removed."""
    spark = files.sparkSession
    checked = archive.validate(archive.fetch(files, cutoff, limit), listing)
    path = f"{folder.rstrip('/')}/_validated"
    checked.write.mode("overwrite").parquet(path)
    checked = spark.read.schema(checked.schema).parquet(path)
    good = checked.where("status = 'ok'").withColumn("source_path", F.col("file_location"))
    made = shards.pack(good, folder, most, n_bits)
    made.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/_manifest")
    packed = spark.read.schema(shards.WRITTEN).parquet(f"{folder.rstrip('/')}/_manifest").agg(F.count("*").alias("shards_created"))
    if cleanup:
        shards.remove_sources(good).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/_removed")
    return archive.cycle(checked).join(packed), archive.mark(files, good)


def repeated(cycle: Callable[[], object], seconds: float, stop: threading.Event, failed: Callable[[Exception], None] = lambda e: None) -> int:
    """Runs cycles with pauses until `stop` is set, which ends a pause at once; an error ends one cycle alone. The number of cycles."""
    n = 0
    while not stop.is_set():
        try:
            cycle()
        except Exception as e:
            failed(e)
        n += 1
        stop.wait(seconds)
    return n
