"""Selecting what to archive: eligibility, windows, watermark state, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions import routing, scalars


def eligible(files: DataFrame, cutoff: Column) -> DataFrame:
    """Older than the cutoff and not archived; an unknown flag is not eligible."""
    if "archived" not in files.columns:
        raise ValueError("the archived column is missing")
    return files.where((F.col("created_at") < cutoff) & (F.col("archived") == F.lit(False)))


def fetch(files: DataFrame, cutoff: Column, limit: int | None = None) -> DataFrame:
    out = eligible(files, cutoff).orderBy("created_at", "uid")
    return out if limit is None else out.limit(limit)


def statistics(files: DataFrame, with_size: bool = True) -> DataFrame:
    size = F.col("size_bytes") if with_size and "size_bytes" in files.columns else F.lit(0)
    return files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_size_bytes"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def coerce(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of a source as the engine wants them: uid as text, created_at as a UTC wall clock, size as a whole number. With `strict`
    created_at must be a time already; else ISO text is parsed."""
    kinds = dict(rows.dtypes)
    timed = kinds["created_at"] in ("timestamp", "timestamp_ntz")
    if strict and not timed:
        raise TypeError("created_at must be a time")
    at = scalars.utc(F.col("created_at")) if timed else scalars.parse_iso(F.col("created_at").cast("string"))
    out = rows.withColumns({"uid": routing.normalize_uid(F.col("uid")), "created_at": at})
    return out.withColumn("size_bytes", F.col("size_bytes").cast("bigint")) if "size_bytes" in kinds else out


def in_window(files: DataFrame, start: Column, end: Column) -> DataFrame:
    """(start, end]"""
    return files.where((F.col("created_at") > start) & (F.col("created_at") <= end))


def after_key(files: DataFrame, ts: Column, uid: Column) -> DataFrame:
    return files.where((F.col("created_at") > ts) | ((F.col("created_at") == ts) & (F.col("uid") > uid)))


def worker(files: DataFrame, number: int, of: int) -> DataFrame:
    return files.where(F.pmod(F.crc32(F.encode("uid", "utf-8")), F.lit(of)) == number)


def target_cutoff(now: Column, lag_days: Column) -> Column:
    """Midnight of the day lag_days before now."""
    return F.date_trunc("day", now - F.make_dt_interval(lag_days)).cast("timestamp_ntz")


def compute_window(state: DataFrame, now: Column) -> DataFrame:
    """The next window of the watermark state; empty (end = start) if the watermark is ahead."""
    end = F.greatest(F.col("archived_until"), target_cutoff(now, F.col("lag_days")))
    return state.select("id", F.col("archived_until").alias("window_start"), end.alias("window_end"), "lag_days")


def advance(state: DataFrame, window: DataFrame) -> DataFrame:
    """The state after its window (by id), which never goes back."""
    return state.join(window.select("id", "window_end"), "id", "left").select("id", F.greatest("archived_until", "window_end").alias("archived_until"), "lag_days")


def lag(state: DataFrame, now: Column) -> DataFrame:
    target = target_cutoff(now, F.col("lag_days"))
    seconds = F.unix_seconds(target.cast("timestamp")) - F.unix_seconds(F.col("archived_until").cast("timestamp"))
    return state.select(seconds.alias("lag_seconds"), (seconds / 86400.0).alias("lag_days_value"))


def mark(files: DataFrame, uids: DataFrame) -> DataFrame:
    """files with archived set for all rows of the given uids."""
    hit = uids.select("uid").distinct().withColumn("_hit", F.lit(True))
    return files.join(hit, "uid", "left").withColumn("archived", F.coalesce("_hit", "archived")).drop("_hit")


def keep_latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def validate(files: DataFrame, listing: DataFrame) -> DataFrame:
    """files with status ok, missing or size_mismatch against a listing (path, length); a missing size is filled in."""
    joined = files.join(listing.select(F.col("path").alias("file_location"), "length"), "file_location", "left")
    status = F.when(F.col("length").isNull(), "missing").when(F.col("size_bytes").isNotNull() & (F.col("size_bytes") != F.col("length")), "size_mismatch").otherwise("ok")
    return joined.withColumn("status", status).withColumn("size_bytes", F.coalesce("size_bytes", "length"))


def retry_backlog(errors: DataFrame, most: int = 3) -> DataFrame:
    """Errors that have been tried fewer than `most` times."""
    return errors.where(F.col("retry_count") < most)


def cycle(validated: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    return validated.agg(F.count("*").alias("files_processed"), F.count_if(ok).alias("files_migrated"), F.count_if(~ok).alias("files_failed"), F.coalesce(F.sum(F.when(ok, F.col("size_bytes"))), F.lit(0)).cast("long").alias("total_size_bytes"))
