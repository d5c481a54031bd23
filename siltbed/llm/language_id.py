"""10. Language ID with a byte convolutional network.

Filters of several widths run over fixed-length windows of bytes, the greatest
response of each filter is pooled, and a softmax layer tells the languages. The
net is trained in numpy on a bounded sample of labelled rows; prediction covers
every window of every whole text, in batches, and averages over a text's windows.

The sample is drawn for each label by a hash of id and text, so it is the same however
the rows are dealt, and a rare label is learned as well as a common one.

Defined cases: null texts and texts without a letter: `und` with score 0. Null
labels are not learned from. With no labelled rows at all every text is `und`. Rows
that repeat id and text count once in the sample; results are one row for each row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm import base as b

#: Bytes of a window, filter widths, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
LETTER = re.compile(r"[^\W\d_]")


def windows(raw: bytes) -> np.ndarray:
    """The text as rows of WINDOW bytes; the last is padded with zeros."""
    return np.frombuffer(raw + bytes(-len(raw) % WINDOW), np.uint8).reshape(-1, WINDOW)


class ByteNet:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {f"t{w}": rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.p["b"] = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.p["w"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.p["c"] = np.zeros(len(labels), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01) -> None:
        """Adam on the cross entropy; the gradient of a pooled filter goes to the place of its greatest response."""
        rng = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                xs, n = x[rows], len(rows)
                pooled, spots = [], []
                for w in WIDTHS:
                    out = sum(self.p[f"t{w}"][j][xs[:, j : WINDOW - w + 1 + j]] for j in range(w))
                    spot = out.argmax(1)
                    spots.append(spot)
                    pooled.append(np.take_along_axis(out, spot[:, None, :], 1)[:, 0])
                raw = np.concatenate(pooled, 1) + self.p["b"]
                act = np.maximum(raw, 0)
                d = self._softmax(act @ self.p["w"] + self.p["c"])
                d[np.arange(n), y[rows]] -= 1
                d /= n
                g = {"w": act.T @ d, "c": d.sum(0)}
                back = (d @ self.p["w"].T) * (raw > 0)
                g["b"] = back.sum(0)
                for i, w in enumerate(WIDTHS):
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    grad = np.zeros_like(self.p[f"t{w}"])
                    for j in range(w):
                        np.add.at(grad[j], (xs[np.arange(n)[:, None], spots[i] + j], np.arange(FILTERS)[None, :]), part)
                    g[f"t{w}"] = grad
                step += 1
                now = rate * (1 - epoch / epochs) + 1e-4
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v2[k] += 0.01 * (g[k] ** 2 - v2[k])
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6) + 1e-5 * self.p[k]

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def tables(self) -> list[np.ndarray]:
        """Responses to pairs of bytes, so that a filter of four bytes costs two lookups."""
        t2, t3, t4 = (self.p[f"t{w}"] for w in WIDTHS)
        pair = lambda a, c: (a[:, None, :] + c[None, :, :]).reshape(65536, FILTERS)
        return [pair(t2[0], t2[1]), pair(t3[0], t3[1]), np.ascontiguousarray(t3[2]), pair(t4[0], t4[1]), pair(t4[2], t4[3])]

    def predict(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Probabilities of the labels for each window."""
        a2, a3, c3, a4, c4 = tables
        out = np.empty((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), 48):  # what fits a cache
            xs = x[at : at + 48]
            pair = (xs[:, :-1].astype(np.uint16) << 8) | xs[:, 1:]
            r3 = a3[pair[:, :-1]]
            r3 += c3[xs[:, 2:]]
            r4 = a4[pair[:, :-2]]
            r4 += c4[pair[:, 2:]]
            act = np.maximum(np.concatenate([a2[pair].max(1), r3.max(1), r4.max(1)], 1) + self.p["b"], 0)
            out[at : at + 48] = self._softmax(act @ self.p["w"] + self.p["c"])
        return out


def sample(labelled: DataFrame, text_col: str, label_col: str, id_col: str, most: int, least: int, per_text: int) -> DataFrame:
    """(label, place, parts): of each label the rows of least hash, most / labels of them but at least `least`, as far as it has them, cut to `per_text` windows each."""
    text, label = F.col(f"`{text_col}`").cast("string"), F.col(f"`{label_col}`").cast("string")
    place = F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(5)).bitwiseAND(F.lit((1 << 40) - 1))
    rows = labelled.select(label.alias("label"), place.alias("place"), text.alias("text")).where("text is not null and label is not null")
    sizes = b.written(rows.groupBy("label").agg(F.count("*").alias("n")), "labels")
    want = max(least, most // max(1, sizes.count()))
    # twice the number and a margin by hash bring enough rows, whose least ones are then taken
    near = rows.join(sizes, "label").where(F.col("place").cast("double") * F.col("n") < float((2 * want + 40) << 40)).select("label", "place", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in b.pieces(batches, "text"):
            parts = []
            for t in texts:
                w = windows(t) if LETTER.search(t.decode()) else windows(b"")
                parts.append([w[i].tobytes() for i in sorted(set(np.linspace(0, len(w) - 1, per_text).astype(int).tolist()))] if len(w) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.binary()))], ["label", "place", "parts"])

    first = Window.partitionBy("label").orderBy("place")
    short = near.mapInArrow(cut, "label string, place long, parts array<binary>").where(F.size("parts") > 0).dropDuplicates(["label", "place"])
    return short.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= want).drop("rank")


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", most: int = 2000, least: int = 20, per_text: int = 3, epochs: int = 8) -> ByteNet | None:
    """A net from a bounded sample (see sample) of the labelled rows; the driver gets windows, not texts."""
    rows = sorted((r["label"], r["place"], r["parts"]) for r in sample(labelled, text_col, label_col, id_col, most, least, per_text).collect())
    if not rows:
        return None
    labels = sorted({label for label, _, _ in rows})
    number = {x: i for i, x in enumerate(labels)}
    x = np.frombuffer(b"".join(w for _, _, parts in rows for w in parts), np.uint8).reshape(-1, WINDOW)
    net = ByteNet(labels)
    net.train(x, np.array([number[label] for label, _, parts in rows for _ in parts]), epochs)
    return net


def predict(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Probabilities of the labels for each window."""
        a2, a3, c3, a4, c4 = tables
        out = np.empty((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), 48):  # what fits a cache
            xs = x[at : at + 48]
            pair = (xs[:, :-1].astype(np.uint16) << 8) | xs[:, 1:]
            r3 = a3[pair[:, :-1]]
            r3 += c3[xs[:, 2:]]
            r4 = a4[pair[:, :-2]]
            r4 += c4[pair[:, 2:]]
            act = np.maximum(np.concatenate([a2[pair].max(1), r3.max(1), r4.max(1)], 1) + self.p["b"], 0)
            out[at : at + 48] = self._softmax(act @ self.p["w"] + self.p["c"])
        return out


def sample_rows(labelled: DataFrame, text_col: str, label_col: str, id_col: str, most: int, least: int) -> DataFrame:
    """(text, label): of each label the rows of least hash, most / labels of them but at least `least`, as far as it has them."""
    text, label = F.col(f"`{text_col}`").cast("string"), F.col(f"`{label_col}`").cast("string")
    rows = labelled.select(text.alias("text"), label.alias("label"), F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(5)).alias("place")).where("text is not null and label is not null")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(least), F.floor(F.lit(most) / F.count("*").over(Window.partitionBy(F.lit(0)))))  # one row a label
    sizes = sizes.select("label", "n", share.alias("want"))
    # twice the share and a margin by hash bring enough rows, whose least ones are then taken
    part = (2 * F.col("want") + 40) / F.col("n")
    near = rows.join(F.broadcast(sizes), "label").where(F.pmod("place", F.lit(1 << 40)) < part * (1 << 40)).dropDuplicates(["label", "place"])
    first = Window.partitionBy("label").orderBy(F.pmod("place", F.lit(1 << 40)), "place")
    return near.withColumn("rank", F.row_number().over(first)).where("rank <= want").select("text", "label")


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", most: int = 2000, least: int = 20, per_text: int = 3, epochs: int = 8) -> ByteNet | None:
    """A net from a bounded sample (sample_rows) of the labelled rows, and at most `per_text` windows of each."""
    sample = sample_rows(labelled, text_col, label_col, id_col, most, least).toPandas()
    if not len(sample):
        return None
    text_col, label_col = "text", "label"
    labels = sorted(sample[label_col].unique())
    number = {x: i for i, x in enumerate(labels)}
    xs, ys = [], []
    for text, label in sorted(zip(sample[text_col], sample[label_col], strict=True)):
        if LETTER.search(text):
            w = windows(text.encode())
            w = w[np.unique(np.linspace(0, len(w) - 1, per_text).astype(int))]
            xs.append(w), ys.extend([number[label]] * len(w))
    if not xs:
        return None
    net = ByteNet(labels)
    net.train(np.concatenate(xs), np.array(ys), epochs)
    return net


def predict(docs: DataFrame, net: ByteNet | None, text_col: str = "text", by: int = 2048) -> DataFrame:
    """docs with lang_pred and score; columns of those names are replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    rest = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        tables = net.tables() if net else None
        for batch, texts in b.pieces(batches, text_col):
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if LETTER.search(t.decode())] if net else []
            held, size = [], 0
            for i in rows:
                held.append(i)
                size += -(-len(texts[i]) // WINDOW)
                if size >= by or i == rows[-1]:
                    parts = [windows(texts[j]) for j in held]
                    p = net.predict(np.concatenate(parts), tables)
                    edges = np.cumsum([0, *map(len, parts)])
                    mean = np.add.reduceat(p, edges[:-1]) / np.diff(edges)[:, None]
                    for j, q in zip(held, mean, strict=True):
                        best = int(q.argmax())
                        pred[j], score[j] = net.labels[best], min(1.0, float(q[best]))
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rest.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.read(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
