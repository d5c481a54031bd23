"""Tombstones, retention upserts and histories, repacking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions import scalars
from siltbed.operators.access import fold

#: Why a file may be deleted, and the states of a business file.
REASONS = ["GDPR", "retention_expired", "user_request"]
STATES = ["active", "expired", "extended", "deleted"]


def check_reason(reason: Column) -> Column:
    return F.when(reason.isin(REASONS), reason).otherwise(F.raise_error(F.concat(F.lit("unknown reason: "), F.coalesce(reason, F.lit("null")))).cast("string"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write by `order` wins; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def deletions(requests: DataFrame, index: DataFrame, old: DataFrame) -> DataFrame:
    """requests (uid, created_at, deleted_by, reason) with http_code: 400 for a blank name or unknown reason, 404 for a key no shard has, 410 for one that is deleted, else 200."""
    known = index.select("uid", "created_at", F.lit(True).alias("known")).distinct()
    dead = old.select("uid", "created_at", F.lit(True).alias("dead")).distinct()
    bad = ~scalars.not_blank(F.col("deleted_by")) | ~F.coalesce(F.col("reason").isin(REASONS), F.lit(False))
    code = F.when(bad, 400).when(F.col("known").isNull(), 404).when(F.col("dead"), 410).otherwise(200)
    return requests.join(known, ["uid", "created_at"], "left").join(dead, ["uid", "created_at"], "left").withColumn("http_code", code).drop("known", "dead")


def tombstone_stats(index: DataFrame, tombstones: DataFrame) -> DataFrame:
    dead = tombstones.select("uid", "created_at", F.lit(1).alias("dead")).distinct()
    out = index.join(dead, ["uid", "created_at"], "left").groupBy("shard_file").agg(F.count("*").alias("entries"), F.count("dead").alias("deleted_files"))
    return out.withColumn("deletion_ratio", F.when(F.col("entries") > 0, F.col("deleted_files") / F.col("entries")).otherwise(0.0))


def retention_upsert(ext: DataFrame, requests: DataFrame, now, index: DataFrame | None = None) -> DataFrame:
    """One row a request: moved if new, updated if there, rejected if the due date has passed, and, with an index (uid, created_at), missing
    where neither it nor extended retention has the file. The due date is replaced."""
    have = ext.select("uid", "created_at", F.lit(True).alias("have")).distinct()
    rows = requests.join(have, ["uid", "created_at"], "left")
    action = F.when(F.col("due_date") <= now, "rejected").when(F.col("have"), "updated")
    if index is not None:
        rows = rows.join(index.select("uid", "created_at", F.lit(True).alias("known")).distinct(), ["uid", "created_at"], "left")
        action = action.when(F.col("known").isNull(), "missing")
    return rows.withColumn("action", action.otherwise("moved")).drop("have", "known")


def spaced_updates(updates: DataFrame, seconds: int = 5) -> DataFrame:
    """(key, ts, event_id, accepted): an update of a file under `seconds` after its last accepted one is refused; a refused one does not count."""

    def step(last: list, t: int) -> bool:
        if last and t - last[0] < seconds * 1_000_000:
            return False
        last[:] = [t]
        return True

    return fold(updates.select("key", F.col("ts").cast("timestamp").alias("ts"), "event_id"), "key", list, step, "accepted")


def extend(files: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, history) after the updates (uid, due_date, reason, updated_by, updated_at): the last one sets the file's fields, each leaves a history row with the due date before it.

    Files have due_date and status; active and expired ones become extended."""
    w = Window.partitionBy("uid").orderBy("updated_at", "due_date")
    own = updates.join(files.select("uid", F.col("due_date").alias("first_due")), "uid")
    history = own.withColumn("previous_due_date", F.coalesce(F.lag("due_date").over(w), F.when(F.row_number().over(w) == 1, F.col("first_due"))))
    last = updates.groupBy("uid").agg(F.max_by(F.struct("due_date", "reason", "updated_by", "updated_at"), F.struct("updated_at", "due_date")).alias("last"))
    status = F.when(F.col("last").isNotNull() & F.col("status").isin("active", "expired"), "extended").otherwise(F.col("status"))
    out = files.join(last, "uid", "left").withColumns({
        "due_date": F.coalesce("last.due_date", "due_date"), "status": status, "in_extended_retention": F.col("last").isNotNull() | (F.col("status") == "extended"),
        "retention_reason": F.col("last.reason"), "retention_updated_by": F.col("last.updated_by"), "retention_updated_at": F.col("last.updated_at"),
    })
    return out.drop("last"), history.select("uid", "previous_due_date", F.col("due_date").alias("new_due_date"), "reason", "updated_by", "updated_at")


def repack(index: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Entries that live on, with new offsets in their shard."""
    live = index.join(tombstones.select("uid", "created_at").distinct(), ["uid", "created_at"], "left_anti")
    w = Window.partitionBy("shard_file").orderBy("offset", "uid").rowsBetween(Window.unboundedPreceding, -1)
    return live.withColumn("new_offset", F.lit(8) + F.coalesce(F.sum("length").over(w), F.lit(0)))
