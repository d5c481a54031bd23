"""Incremental archiving: micro-batches of files become shards; late rows and repeats are told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.functions import routing as r
from siltbed.operators import planner
from siltbed.sources import shards


def pack_stream(files: DataFrame, target: str, checkpoint: str, n_bits: int = 8, most: int = 1_000_000_000, delay: str = "7 days", payloads: bool = False, late: str | None = None):
    """Runs what is available: drops repeats of (uid, created_at) within the watermark, plans each micro-batch and writes it under
    the batch's own folder, so a replayed batch overwrites itself. Names carry the batch's number, so they never meet those of
    another batch. With `payloads`, files have a payload column and shards are written; else the plan alone.
    With `late`, rows older than the batch's newest time less the delay are also listed there."""
    at = files.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    fresh = at.dropDuplicatesWithinWatermark(["uid", "created_at"])

    def one(batch: DataFrame, number: int) -> None:
        keep = ["payload"] if payloads else []
        plan = planner.plan(planner.route(batch, n_bits), most, keep=keep)
        plan = plan.withColumn("shard_file", F.concat(F.regexp_replace(r.shard_file(F.col("date_dir"), F.col("shard_hex"), F.col("shard_seq")), r"\.des$", ""), F.lit(f"_b{number:08d}.des")))
        if payloads:
            shards.write_shards(plan, f"{target}/batch={number}").write.mode("overwrite").parquet(f"{target}/manifest/batch={number}")
        else:
            plan.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if late:
            newest = batch.agg(F.max("created_at").alias("newest"))
            old = batch.select("uid", "created_at").join(F.broadcast(newest)).where(F.col("created_at") < F.col("newest") - F.expr(f"interval {delay}"))
            old.write.mode("overwrite").parquet(f"{late}/batch={number}")

    return fresh.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
