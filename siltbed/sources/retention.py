"""Extended retention: copies of payloads beside the shards, by day, uid and time, and the table that knows their due dates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.functions import routing as r
from siltbed.operators import lifecycle
from siltbed.sources import files


def copy(payloads: DataFrame, folder: str) -> DataFrame:
    """(uid, created_at, path): writes each payload of (uid, created_at, payload) once below folder; what is there stays."""
    rows = payloads.select("uid", "created_at", r.ext_key(F.col("uid"), F.col("created_at")).alias("key"), "payload")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = files.system_of(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            keys = batch.column(2).to_pylist()
            for i, key in enumerate(keys):
                target = f"{at}/{key}"
                if system.get_file_info(target).is_file:
                    continue
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{target}-{attempt}") as o:
                    o.write(batch.column(3)[i].as_py() or b"")
                system.move(f"{target}-{attempt}", target)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f"{folder}/{k}" for k in keys], pa.string())], ["uid", "created_at", "path"])

    return rows.mapInArrow(each, rows.select("uid", "created_at").schema.add("path", "string"))


def extend(known: DataFrame, requests: DataFrame, payloads: DataFrame, folder: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(actions, known) after requests (uid, created_at, due_date): first calls copy the payload, later ones only replace the due date, past dates and
    files without a payload are refused. known has uid, created_at, due_date."""
    actions = lifecycle.retention_upsert(known, requests, now, payloads)
    moved = actions.where("action = 'moved'").select("uid", "created_at").distinct()
    copied = copy(payloads.join(moved, ["uid", "created_at"], "left_semi"), folder).select("uid", "created_at")
    new = actions.where("action = 'updated'").select("uid", "created_at", "due_date").unionByName(actions.where("action = 'moved'").join(copied, ["uid", "created_at"], "left_semi").select("uid", "created_at", "due_date"))
    return actions, lifecycle.upsert(known.select("uid", "created_at", "due_date"), new, ["uid", "created_at"], "due_date")


def read(rows: DataFrame) -> DataFrame:
    """rows (path, ...) of copies with their payload."""
    from siltbed.sources import shards

    return shards.read_sources(rows, "path")
