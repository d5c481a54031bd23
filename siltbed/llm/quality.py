"""7. Quality rules and n-gram perplexity.

Spark counts the 4-grams of characters of every whole text for each language and makes
an interpolated modified Kneser-Ney model of them: continuation counts, discounts and
probabilities are aggregations and joins. A model is stored as sorted arrays of 64-bit
gram hashes (four 16-bit character hashes, so that contexts and suffixes are bits of
it) with the bits of each gram. It is dealt by gram over files that Spark brings to each
executor, and workers map these, so memory grows neither with the model nor on the driver.

Every document is scored with the model of its language, and the language's own lower
and upper perplexity bands - its median and spread over all documents - reject what is
too odd or too monotonous.

A model has every 4-gram of its corpus, however rare. The texts that are scored are those
that were counted, so each of their grams is in it: lower orders go into its bits by
interpolation and are not needed beside them.

Defined cases: null or empty text: no words, fails. Null languages form a language
of their own. Rows that repeat are counted and judged each. Empty tables give empty results.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.llm import base as b

#: Width of the perplexity histogram's bins, in bits a symbol; bytes of a model file.
BIN, FILE_BYTES = 0.005, 4 << 20
ORDER = 4
_SYMBOLS = bytes(c for c in range(256) if c not in b"#*$%&|<>")


def gram_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each character the hash of the 4-gram that ends there (three blanks before each text), and the characters of each text.

    Case is folded, white space is a blank and digits are one character; characters beyond 16 bits share 6,400 private ones."""
    lowered = [t.decode().lower() for t in texts]
    c = np.frombuffer("   ".join(["", *lowered]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    c[c <= 32] = 32
    c[(c >= 48) & (c <= 57)] = 48
    far = c > 0xFFFF
    c[far] = 0xE000 + b.mix(c[far]) % b.U(6400)
    h = (c[:-3] << b.U(48)) | (c[1:-2] << b.U(32)) | (c[2:-1] << b.U(16)) | c[3:] if len(c) > 3 else c[:0]
    sizes = np.array([len(t) for t in lowered], np.int64)
    return h[np.arange(int(sizes.sum())) + np.repeat(3 * np.arange(len(texts)), sizes)], sizes  # gram i ends at character i + 3


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): the 4-grams of all whole texts of (lang, _text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in b.pieces(batches, "_text"):
            langs = np.array(batch.column(0).to_pylist(), object)
            for name in dict.fromkeys(langs.tolist()):
                found, n = np.unique(gram_hashes([texts[r] for r in np.flatnonzero(langs == name)])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return docs.select("lang", "_text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> Column:
    """The gram without its first character."""
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


def _totals(counts: DataFrame, order: int) -> DataFrame:
    """(lang, d1, d2, d3): what modified Kneser-Ney takes from counts of one, two, and three or more, from
    the numbers of counts. One row a language, written, so that joins with it are no shuffles by language while it is small."""
    n = counts.groupBy("lang").agg(*[F.greatest(F.lit(1.0), F.count_if(F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    cut = lambda i: F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.1)), F.lit(i - 0.05))
    return b.written(n.select("lang", *[cut(i).alias(f"d{i}") for i in (1, 2, 3)]), f"totals-{order}")


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, gram, bits), written: of every counted gram, however rare, -log2 of the probability of its last character after the others; from (lang, gram, n)."""
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
        levels[order] = b.written(levels[order + 1].groupBy("lang", _suffix(order + 1).alias("gram")).agg(F.count("*").alias("n")), f"grams-{order}")
    lower = b.written(levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("below")), "unseen")
    for order in range(1, ORDER + 1):
        context = F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long")
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = levels[order].join(_totals(levels[order], order), "lang").select("lang", "gram", context.alias("context"), "n", taken.alias("taken"))
        after = b.written(c.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("left")), f"contexts-{order}")
        # what is shuffled is narrow, and numbers, which sort faster, come first in keys
        rows = c.join(after, ["context", "lang"]).select("lang", "gram", ((F.col("n") - F.col("taken")) / F.col("total")).alias("own"), "left")
        rows = rows.join(lower, "lang") if order == 1 else rows.withColumn("suffix", _suffix(order)).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["suffix", "lang"])
        p = F.col("own") + F.col("left") * F.col("below")  # above 0, as less is taken than counted
        found = b.written(rows.select("lang", "gram", p.alias("p") if order < ORDER else (-F.log2(p)).cast("float").alias("bits")), f"order-{order}")
        b.drop_tables(lower, after, *[levels[order]] * (order < ORDER))
        lower = found
    return lower


def packed(langs: pa.ChunkedArray, grams: np.ndarray, bits: np.ndarray) -> bytes:
    """A model file: the size of what tells the number of grams of each language, that, all grams sorted by language and gram, and their bits."""
    langs = langs.combine_chunks().dictionary_encode()
    code = langs.indices.to_numpy()
    order = np.lexsort((grams, code))
    head = json.dumps([*zip(langs.dictionary.to_pylist(), np.bincount(code).tolist(), strict=True)]).encode()
    head += b" " * (-len(head) % 8)  # numbers stand at multiples of their size
    return np.uint64(len(head)).tobytes() + head + grams[order].tobytes() + bits[order].astype(np.float32).tobytes()


def mapped(path: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and bits of each language of a model file. What is looked up is read; it belongs to the system's cache, not to the worker."""
    data = np.memmap(path, np.uint8, "r")
    begin = 8 + int(data[:8].view(np.uint64)[0])
    sizes = json.loads(data[8:begin].tobytes())
    n = sum(size for _, size in sizes)
    grams, bits = data[begin : begin + 8 * n].view(np.uint64), data[begin + 8 * n : begin + 12 * n].view(np.float32)
    found, at = {}, 0
    for lang, size in sizes:
        found[lang] = grams[at : at + size], bits[at : at + size]
        at += size
    return found


def file_of(grams: np.ndarray, files: int) -> np.ndarray:
    return (b.mix(grams) % b.U(files)).astype(np.min_scalar_type(files))


class Model:
    """The mapped files of a model."""

    def __init__(self, paths: list[str]):
        self.files = [mapped(p) if p else {} for p in paths]

    def bits(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each gram's last character after the others."""
        own, back = np.unique(grams, return_inverse=True)
        out = np.empty(len(own), np.float32)
        file = file_of(own, len(self.files))
        order = np.argsort(file, kind="stable")
        spots = np.split(order, np.cumsum(np.bincount(file, minlength=len(self.files)))[:-1])
        for i in np.flatnonzero([len(x) for x in spots]):
            keys, bits = self.files[i].get(lang, (own[:0], out[:0]))
            at = np.searchsorted(keys, own[spots[i]])
            if not len(keys) or at.max() == len(keys) or (keys[at] != own[spots[i]]).any():
                raise ValueError(f"a gram of {lang!r} was not counted: the documents differ from one reading to the next")
            out[spots[i]] = bits[at]
        return out[back]


def model_files(model: DataFrame) -> list[str]:
    """Names of files that Spark brings to every executor; a gram is in file_of(gram, their number)."""
    spark = model.sparkSession
    n = max(1, -(-model.count() * 12 // FILE_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file = file_of(batch.column(1).to_numpy().view(np.uint64), n)
            yield pa.RecordBatch.from_arrays([pa.array(file.astype(np.int32)), *batch.columns], ["file", "lang", "gram", "bits"])

    def pack(table: pa.Table) -> pa.Table:
        data = packed(table.column("lang"), table.column("gram").to_numpy().view(np.uint64), table.column("bits").to_numpy())
        return pa.table({"file": table.column("file").slice(0, 1), "data": pa.array([data], pa.binary())})

    path = b.shared_dir(spark, "models")
    dealt = model.select("lang", "gram", "bits").mapInArrow(deal, "file int, lang string, gram long, bits float")
    data = dealt.groupBy("file").applyInArrow(pack, "file int, data binary")
    data.select("file", F.col("data").cast("string")).write.partitionBy("file").option("compression", "none").text(path)  # bytes as they are
    names = []
    for i in range(n):
        folder, system = b.hadoop(spark, f"{path}/file={i}")
        name = f"{path.rpartition('/')[2]}-{i}.model"
        found = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().endswith(".txt")] if system.exists(folder) else []
        for old in found:  # one: rows of a file are one partition's
            new, _ = b.hadoop(spark, f"{path}/{name}")
            system.rename(old, new)
            spark.sparkContext.addFile(new.toString())
        names.append(name if found else "")
    return names


def _repeat_words(flat: bytes, starts, ends, counts, width: int = 3) -> np.ndarray:
    """Of each text, the words in windows of `width` words that the text has twice or more."""
    h = b.word_hashes(np.frombuffer(flat, np.uint8), starts, ends)
    g = b.grams(h, width)
    doc = np.repeat(np.arange(len(counts)), counts)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(g):
        inside = doc[: len(g)] == doc[width - 1 :]
        own = b.mix(g + doc[: len(g)].astype(np.uint64) * b.U(0x9E3779B97F4A7C15))
        spot = np.flatnonzero(inside)
        order = spot[np.argsort(own[spot], kind="stable")]
        o, d = own[order], doc[order]
        same = np.concatenate([(o[1:] == o[:-1]) & (d[1:] == d[:-1]), [False]]) if len(order) else np.zeros(0, bool)
        same[1:] |= same[:-1].copy()
        hit = order[same]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + width, -1)
    return np.bincount(doc[np.cumsum(covered)[:-1] > 0], minlength=len(counts))


_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def bands(scored: DataFrame, below: float, above: float) -> DataFrame:
    """(lang, low, high) from the histogram of bits of (lang, bits): the median, less `below` and plus `above` median absolute deviations."""

    def middle(rows: DataFrame, value: str, name: str) -> DataFrame:
        so_far = F.sum("n").over(Window.partitionBy("lang").orderBy(value))
        half = F.sum("n").over(Window.partitionBy("lang")) / 2
        return rows.groupBy("lang", value).agg(F.sum("n").alias("n")).select("lang", value, (so_far >= half).alias("there")).where("there").groupBy("lang").agg(F.min(value).alias(name))

    bins = b.written(scored.groupBy("lang", F.floor(F.col("bits") / BIN).alias("bin")).agg(F.count("*").alias("n")), "bins")
    mid = middle(bins, "bin", "mid")
    spread = middle(bins.join(mid, "lang").select("lang", F.abs(F.col("bin") - F.col("mid")).alias("off"), "n"), "off", "mad")
    at, mad = (F.col("mid") + 0.5) * BIN, F.greatest(F.col("mad"), F.lit(2)) * BIN
    return mid.join(spread, "lang").select("lang", (at - below * mad).alias("low"), (at + above * mad).alias("high"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, max_repeat: float = 0.5, below: float = 8.0, above: float = 8.0) -> DataFrame:
    """id, the base counts, base_failed, kept, bits (all characters, for each letter), low, high (bands of the language); for every row."""
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    counts = b.written(count_grams(text), "grams-4")
    model = kneser_ney(counts)
    files = model_files(model)
    b.drop_tables(counts, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model([name and SparkFiles.get(name) for name in files])
        for batch, texts in b.pieces(batches, "_text"):
            langs = batch.column(1).to_pylist()
            flat, starts, ends, n = b.joined_words(texts, b.SPACED)
            chars = [len(t.decode()) for t in texts]
            white = [sum(map(t.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))) for t in texts]
            symbols = [len(t.translate(None, _SYMBOLS)) for t in texts]
            dup = []
            for t in texts:
                lines = [x for x in t.split(b"\n") if not x.isspace() and x]
                dup.append(len(lines) - len(set(lines)))
            repeat = _repeat_words(flat, starts, ends, n)
            bits = np.full(len(texts), math.nan)
            for lang in dict.fromkeys(langs):
                rows = np.flatnonzero([x == lang and len(t) > 0 for x, t in zip(langs, texts, strict=True)])
                if not len(rows):
                    continue
                grams, sizes = gram_hashes([texts[r] for r in rows])
                first = np.cumsum(sizes) - sizes
                last = grams & b.U(0xFFFF)
                letters = np.add.reduceat(((last >= 97) & (last <= 122)) | (last >= 128), first, dtype=np.int64)
                bits[rows] = np.add.reduceat(model.bits(lang, grams), first, dtype=np.float64) / np.maximum(letters, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(np.array(chars) - np.array(white), pa.int64()), pa.array(symbols, pa.int64()), pa.array(dup, pa.int64()), pa.array(repeat, pa.int64()), pa.array(bits, pa.float64())],
                ["_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bits"],
            )

    scored = b.written(text.mapInArrow(score, f"_id long, lang string, {_BASE}, bits double"), "scored")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    found = b.written(bands(scored.where(~failed & ~F.isnan("bits")), below, above), "bands")
    out = scored.join(found, "lang", "left").withColumn("base_failed", failed)
    inside = F.coalesce((F.col("bits") >= F.col("low")) & (F.col("bits") <= F.col("high")), F.lit(False))
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "bits", "low", "high")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(b.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
