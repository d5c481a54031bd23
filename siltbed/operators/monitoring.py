"""Metric samples (name, ts, event_id, value): rates, ratios, quantiles, stalls, holds.

A metric's whole history is never one window: samples are ordered within (name, day), and what crosses an edge
is told from one row for each day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions import scalars

def _by_day(samples: DataFrame) -> DataFrame:
    return samples.withColumn("day", F.to_date(scalars.utc(F.col("ts"))))


def _steps(samples: DataFrame, value: str, step, total: str) -> DataFrame:
    """(name, total, first_ts, last_ts): the sum of step(before, value) over successive samples of a name."""
    inner = Window.partitionBy("name", "day").orderBy("ts", "event_id")
    rows = _by_day(samples).withColumn("_before", F.lag(F.struct(F.col(value).alias("v"))).over(inner))
    rows = rows.withColumn("_step", F.when(F.col("_before").isNotNull(), step(F.col("_before.v"), F.col(value))))
    place = F.struct("ts", "event_id")
    days = rows.groupBy("name", "day").agg(
        F.sum("_step").alias("inside"), F.min_by(F.struct(F.col(value).alias("v")), place).alias("first"), F.max_by(F.struct(F.col(value).alias("v")), place).alias("last"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    edge = F.lag("last").over(Window.partitionBy("name").orderBy("day"))
    days = days.withColumn("edge", edge).withColumn("across", F.when(F.col("edge").isNotNull(), step(F.col("edge.v"), F.col("first.v"))))
    return days.groupBy("name").agg((F.coalesce(F.sum("inside"), F.lit(0)) + F.coalesce(F.sum("across"), F.lit(0))).alias(total), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def _seconds(later: Column, earlier: Column) -> Column:
    return F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))


def increase(samples: DataFrame, value: str = "counter") -> DataFrame:
    """Reset-aware increase of a counter and its rate over the observed seconds, for each name."""
    out = _steps(samples, value, lambda before, now: F.when(now < before, now).otherwise(now - before), "increase")
    seconds = _seconds(F.col("last_ts"), F.col("first_ts"))
    return out.select("name", F.col("increase").cast("long").alias("increase"), F.round(F.try_divide(F.col("increase"), seconds), 6).alias("rate"))


def changes(samples: DataFrame, value: str = "value") -> DataFrame:
    out = _steps(samples, value, lambda before, now: F.when(now != before, 1).otherwise(0), "changes")
    return out.select("name", F.col("changes").cast("long").alias("changes"))


def histogram(samples: DataFrame, bounds: list[float]) -> DataFrame:
    """Cumulative buckets, the last without bound."""
    counts = [F.count_if(F.col("value") <= x) for x in bounds] + [F.count("value")]
    wide = samples.groupBy("name").agg(*[c.alias(f"b{i}") for i, c in enumerate(counts)])
    rows = F.array(*[F.struct(F.lit(float(x) if i < len(bounds) else float("inf")).alias("le"), F.col(f"b{i}").alias("n")) for i, x in enumerate([*bounds, None])])
    return wide.select("name", F.inline(rows))


def histogram_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """Linear interpolation in the first bucket that reaches the rank; the last bound where it is the unbounded one."""
    w = Window.partitionBy("name").orderBy("le")
    rows = buckets.withColumns({"low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "before": F.coalesce(F.lag("n").over(w), F.lit(0)), "total": F.max("n").over(Window.partitionBy("name"))})
    hit = rows.where((F.col("n") >= F.col("total") * q) & (F.col("before") < F.col("total") * q))
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("total") * q - F.col("before")) / (F.col("n") - F.col("before")))
    return hit.groupBy("name").agg(F.round(F.min(value), 6).alias("quantile"))


def held_above(samples: DataFrame, threshold: float, seconds: int) -> DataFrame:
    """Stretches in which a gauge stays above the threshold for at least the given time (gaps and islands; an island is
    named by the number of samples below it so far)."""
    flagged = _by_day(samples).withColumn("below", F.when(F.col("value") > threshold, 0).otherwise(1))
    days = flagged.groupBy("name", "day").agg(F.sum("below").alias("n"))
    earlier = Window.partitionBy("name").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    base = days.select("name", "day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = F.sum("below").over(Window.partitionBy("name", "day").orderBy("ts", "event_id"))
    rows = flagged.withColumn("inside", within).where("below = 0").join(base, ["name", "day"])
    out = rows.groupBy("name", (F.col("base") + F.col("inside")).alias("island")).agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.count("*").alias("samples"))
    return out.where(_seconds(F.col("until"), F.col("since")) >= seconds).drop("island")


def cycle_figures(cycles: DataFrame) -> DataFrame:
    """Success in percent, files and MiB a second, and the 95th percentile of seconds, over cycles (status, files, bytes, seconds)."""
    good = F.count_if(F.col("status") == "success")
    return cycles.agg(
        F.round(F.try_divide(100.0 * good, F.count("*")), 6).alias("success_pct"), F.round(F.try_divide(F.sum("files").cast("double"), F.sum("seconds")), 6).alias("files_per_second"),
        F.round(F.try_divide(F.sum("bytes").cast("double") / 1048576, F.sum("seconds")), 6).alias("mib_per_second"), F.round(F.percentile("seconds", 0.95), 6).alias("p95_seconds"),
    )
