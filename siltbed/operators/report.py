"""One-row results as lines of text, for terminals and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def size(n: float) -> str:
    """Bytes with a binary unit."""
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if abs(n) < 1024 or unit == "TiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return ""


def statistics(row_of: DataFrame) -> str:
    """archive.statistics() as text."""
    row = row_of.first()
    return "\n".join([f"files: {row['total_files']}", f"size: {size(row['total_size_bytes'])}", f"oldest: {row['oldest'] or '-'}", f"newest: {row['newest'] or '-'}"])


def packed(shards: DataFrame) -> str:
    """The shards of a pack run, summed, as text."""
    from pyspark.sql import functions as F

    row = shards.agg(F.count("*").alias("n"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"), F.coalesce(F.sum("total_size"), F.lit(0)).alias("bytes")).first()
    return f"{row['n']} shards, {row['files']} files, {size(row['bytes'])}"
