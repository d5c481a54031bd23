"""A metrics registry on Spark accumulators, its samples as a table, and their text exposition."""

from __future__ import annotations

from bisect import bisect_left

from pyspark import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of durations in seconds, and default bounds.
LONG = [1, 5, 10, 30, 60, 120, 300]
USUAL = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1, 2.5, 5, 7.5, 10]


class _Sums(AccumulatorParam):
    """Sums of each set of labels."""

    def zero(self, value):
        return {}

    def addInPlace(self, a, b):  # noqa: N802
        for k, v in b.items():
            a[k] = [x + y for x, y in zip(a[k], v, strict=True)] if k in a else list(v)
        return a


class Metric:
    """A counter, gauge or histogram that tasks add to. Spark adds what a task did once for a finished task of an action,
    but again where a stage is computed again, so counts are exact only in actions."""

    def __init__(self, spark: SparkSession, name: str, kind: str, labels: tuple[str, ...] = (), bounds: list[float] | None = None, text: str = ""):
        self.name, self.kind, self.labels, self.text = name, kind, labels, text
        self.bounds = list(bounds or USUAL) if kind == "histogram" else []
        self.sums = spark.sparkContext.accumulator({}, _Sums())

    def _add(self, labels: dict, values: list[float]) -> None:
        if set(labels) != set(self.labels):
            raise ValueError(f"{self.name} has the labels {self.labels}")
        self.sums.add({tuple(str(labels[x]) for x in self.labels): values})

    def add(self, amount: float = 1, **labels) -> None:
        if self.kind == "counter" and amount < 0:
            raise ValueError("a counter does not go down")
        self._add(labels, [amount])

    def observe(self, value: float, **labels) -> None:
        hit = [0.0] * (len(self.bounds) + 2)
        hit[bisect_left(self.bounds, value)], hit[-1] = 1.0, value
        self._add(labels, hit)

    def samples(self) -> list[tuple[str, dict, float]]:
        out = []
        for key, sums in sorted(self.sums.value.items()):
            labels = dict(zip(self.labels, key, strict=True))
            if self.kind != "histogram":
                out.append((self.name, labels, float(sums[0])))
                continue
            total = 0.0
            for bound, n in zip([*self.bounds, "+Inf"], sums, strict=False):
                total += n
                out.append((f"{self.name}_bucket", labels | {"le": str(bound)}, total))
            out += [(f"{self.name}_sum", labels, sums[-1]), (f"{self.name}_count", labels, total)]
        return out


class Registry:
    def __init__(self, spark: SparkSession):
        self.spark, self.metrics = spark, {}

    def _new(self, name: str, *args, **kw) -> Metric:
        if name not in self.metrics:
            self.metrics[name] = Metric(self.spark, name, *args, **kw)
        return self.metrics[name]

    def counter(self, name: str, *labels: str, text: str = "") -> Metric:
        return self._new(name, "counter", labels, text=text)

    def gauge(self, name: str, *labels: str, text: str = "") -> Metric:
        return self._new(name, "gauge", labels, text=text)

    def histogram(self, name: str, *labels: str, bounds: list[float] | None = None, text: str = "") -> Metric:
        return self._new(name, "histogram", labels, bounds, text=text)

    def frame(self) -> DataFrame:
        """(name, labels, value) of all samples."""
        return self.spark.createDataFrame([s for m in self.metrics.values() for s in m.samples()], "name string, labels map<string, string>, value double")

    def exposition(self) -> str:
        """The samples as text, by metric."""
        lines = []
        quoted = lambda v: '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
        for m in self.metrics.values():
            lines += [f"# HELP {m.name} {m.text}", f"# TYPE {m.name} {m.kind}"]
            lines += [n + ("{" + ",".join(f"{k}={quoted(v)}" for k, v in labels.items()) + "}" if labels else "") + f" {value}" for n, labels, value in m.samples()]
        return "\n".join(lines) + "\n"


def from_results(rows: DataFrame, name: str, *labels: str) -> DataFrame:
    """(name, labels, value): a counter told from a table of results, exact whatever was computed again."""
    pairs = [x for c in labels for x in (F.lit(c), F.col(c).cast("string"))]
    return rows.groupBy(*labels).agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("name"), F.create_map(*pairs).alias("labels"), "value")
