"""The business tables and the engine's own, as Parquet tables of a catalogue."""

from __future__ import annotations

from pyspark.sql import SparkSession

from siltbed.operators.lifecycle import STATES

#: Table -> columns.
TABLES = {
    "files": "id bigint, uid string, filename string, size_bytes bigint, created_at timestamp_ntz, uploaded_at timestamp_ntz, status string, standard_retention_days int, extended_retention_due_date timestamp_ntz, retention_reason string, retention_updated_at timestamp_ntz, retention_updated_by string, in_extended_retention boolean, case_number string",
    "retention_history": "id bigint, file_id bigint, previous_due_date timestamp_ntz, new_due_date timestamp_ntz, reason string, updated_by string, updated_at timestamp_ntz",
    "cases": "case_number string, case_name string, department string, created_at timestamp_ntz",
    "case_files": "case_number string, file_id bigint, added_at timestamp_ntz",
    "archive_state": "id int, archived_until timestamp_ntz, lag_days int",
    "migration_errors": "uid string, error string, retry_count int, failed_at timestamp_ntz",
}


def create(spark: SparkSession, database: str) -> None:
    """Makes the database and its tables, where they are missing; there are no indexes, pruning is by statistics."""
    spark.sql(f"create database if not exists {database}")
    for name, columns in TABLES.items():
        spark.sql(f"create table if not exists {database}.{name} ({columns}) using parquet")


def alter(spark: SparkSession, database: str, table: str, columns: str) -> None:
    """Adds columns that the table does not have yet."""
    have = {c.lower() for c in spark.table(f"{database}.{table}").columns}
    new = [c for c in (x.strip() for x in columns.split(",")) if c.split(" ")[0].lower() not in have]
    if new:
        spark.sql(f"alter table {database}.{table} add columns ({', '.join(new)})")


def append(spark: SparkSession, database: str, rows, table: str = "files") -> None:
    """Appends rows by name; a status that is none of STATES is an error."""
    from pyspark.sql import functions as F

    if "status" in rows.columns:
        rows = rows.withColumn("status", F.when(F.col("status").isin(STATES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null")))).cast("string")))
    missing = [c for c in spark.table(f"{database}.{table}").schema if c.name not in rows.columns]
    rows.select("*", *[F.lit(None).cast(c.dataType).alias(c.name) for c in missing]).select(*spark.table(f"{database}.{table}").columns).write.insertInto(f"{database}.{table}")
