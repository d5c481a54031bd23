"""The watermark's state: one row, stored as small Parquet folders of which the last finished one counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import archive

STATE = "id int, archived_until timestamp_ntz, lag_days int"


class State:
    """Versions lie in folder/v=<n>; a version without Spark's _SUCCESS mark is not read, so a driver lost while writing changes nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _system(self):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), context._jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        system, path = self._system()
        if not system.exists(path(self.folder)):
            return 0
        names = [s.getPath().getName() for s in system.listStatus(path(self.folder))]
        return max((int(n[2:]) for n in names if n.startswith("v=") and system.exists(path(f"{self.folder}/{n}/_SUCCESS"))), default=0)

    def ensure(self, archived_until: Column, lag_days: int) -> None:
        """Seeds the state once; later calls change nothing."""
        if not self.version():
            self._write(self.spark.range(1).select(F.lit(1).alias("id"), archived_until.cast("timestamp_ntz").alias("archived_until"), F.lit(lag_days).alias("lag_days")))

    def get(self) -> DataFrame:
        if not (n := self.version()):
            raise RuntimeError("the watermark has no state yet: call ensure() first")
        return self.spark.read.schema(STATE).parquet(f"{self.folder}/v={n}")

    def _write(self, state: DataFrame) -> None:
        n = self.version() + 1
        state.select(F.col("id").cast("int"), F.col("archived_until").cast("timestamp_ntz"), F.col("lag_days").cast("int")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/v={n}")

    def window(self, now: Column) -> DataFrame:
        """The next window, without a change of the state."""
        return archive.compute_window(self.get(), now)

    def advance(self, window: DataFrame) -> DataFrame:
        """The state after the window; it never goes back, and a window that does not move it is not written."""
        after = archive.advance(self.get(), window)
        row, before = after.first(), self.get().first()
        if row["archived_until"] > before["archived_until"]:
            self._write(self.spark.createDataFrame([row], after.schema))
        return self.get()

    def adjust(self, to: Column | None = None, days: int | None = None) -> DataFrame:
        """Sets the watermark by hand, to a time or by days, back as well: what lies behind it is archived again, what it passes is skipped."""
        if (to is None) == (days is None):
            raise ValueError("give a time or a number of days")
        until = to.cast("timestamp_ntz") if to is not None else F.col("archived_until") + F.make_dt_interval(F.lit(days))
        row = self.get().withColumn("archived_until", until).first()
        self._write(self.spark.createDataFrame([row], STATE))
        return self.get()

    def mark_day(self, now: Column, archived_until: Column, lag_days: int) -> DataFrame:
        """The daily call: seeds the state if need be, then moves it to the day's window end."""
        self.ensure(archived_until, lag_days)
        return self.advance(self.window(now))
