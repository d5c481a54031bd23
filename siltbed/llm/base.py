"""What the corpus operators share: row keys, written tables, word splitting and hashing in numpy.

Nulls and repeats, for every operator of this subpackage: a null text has no
words and no bytes; a null id is kept as null in results and sorts before all
others; rows that repeat an id are told apart by a 64-bit fingerprint of their text.
Columns that an operator does not use pass through or are ignored, whatever
their names.

Intermediate tables are Parquet in one folder for each application, below
spark.checkpoint.dir; Hadoop deletes it when the driver's JVM ends.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")  # words between ASCII white space
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # runs of 0-9, a-z and bytes above ASCII
NULL_ID = -(2**63)

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240131))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_STEP = [U(int(x) | 1) for x in _rng.integers(2**60, 2**63, 40)]
_MULT = U(0x9E3779B97F4A7C15)


#: Bytes of an Arrow batch sent to a Python worker: rows alone bound no memory where texts are long.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless their path has it already; bounds Arrow batches in bytes, unless the application's settings do."""
    if not spark.sparkContext.getConf().contains(key := "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set(key, str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    if str(root) in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) or getattr(spark.sparkContext, "_siltbed_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "siltbed.zip"  # read by the driver's own file server alone
    with zipfile.ZipFile(target, "w") as z:
        for p in (root / "siltbed").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._siltbed_shipped = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hadoop(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop has them."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def run_folder(spark: SparkSession) -> str:
    """The application's own folder below spark.checkpoint.dir, which driver and executors share; it goes with the application."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/siltbed"  # one machine alone, as in tests
    folder = f"{base.rstrip('/')}/{context.applicationId}"
    if getattr(context, "_siltbed_folder", None) != folder:
        path, system = hadoop(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        context._siltbed_folder = folder
    return folder


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new name in the application's folder."""
    return f"{run_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"


#: Spark removes the shuffle files of an execution at its end: a written table is not computed again.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives its executors. Its size is known, so joins with it are broadcast only below Spark's threshold."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    table = spark.read.schema(df.schema).parquet(path)
    table._siltbed_path = path
    return table


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables made by written(), once nothing is to be computed from them any more."""
    for table in tables:
        path, system = hadoop(table.sparkSession, table._siltbed_path)
        system.delete(path, True)


#: Rows of a key beyond which it is hot.
HOT = 2000


def join_sized(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their group, where groups (unique keys) tell their number of rows as `size`. The few hot
    groups are joined apart, so that no key of a shuffled join has more than HOT rows as long as their list is small."""
    hot = written(groups.where(F.col("size") > HOT), "hot")
    usual = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col("size") <= HOT), keys)
    return usual.unionByName(rows.join(hot, keys))


def row_key(id_col: str, text_col: str) -> list:
    """_id (null as the least long) and _fp (fingerprint of the text)."""
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_fp")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _fp, _text): the row key and the text."""
    return docs.select(*row_key(id_col, text_col), F.col(f"`{text_col}`").alias("_text"))


def unkeyed(column: str = "_id"):
    return F.when(F.col(column) != NULL_ID, F.col(column))


def lower_ascii(text: bytes) -> bytes:
    return text.lower()  # bytes.lower() changes A-Z alone


def give_back() -> None:
    """Returns free memory of a Python worker, which lives on for later stages, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut so that their texts hold about `most` bytes; one longer text stands alone. Only one piece's texts are Python objects at a time."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        begin, held = 0, 0
        for i, size in enumerate([*sizes, 0]):
            if i == len(sizes) or held and held + size > most or i - begin >= rows:
                if i > begin:
                    yield batch.slice(begin, i - begin), [x or b"" for x in texts.slice(begin, i - begin).to_pylist()]
                begin, held = i, 0
            held += size
    give_back()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * _MULT
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 4096), _STEP[0])]))
    return _powers


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[start:end]; ends > starts, ascending, not overlapping."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    base = np.concatenate([[0], np.cumsum(lens)[:-1]])
    off = np.arange(int(lens.sum())) - np.repeat(base, lens)
    values = BYTE_VALUES[buf[off + np.repeat(starts, lens)]] * powers(int(lens.max()))[off]
    return mix(np.add.reduceat(values, base) + lens.astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive entries, at each start but the last k - 1."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, part, width, level = None, 0, h, 1, 1
    while True:
        if k & width:
            piece = part[done : done + len(h) - k + 1]
            out = piece if out is None else out * _STEP[level + 20 if level < 19 else 39] + piece
            done += width
        width *= 2
        if width > k:
            return mix(out + U(k))
        part = part[: -(width // 2)] * _STEP[level] + part[width // 2 :]
        level += 1


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of w consecutive entries, at each start but the last w - 1."""
    if len(h) < w:
        return h[:0]
    width = 1
    while width * 2 <= w:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = w - width
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def joined_words(texts: list[bytes], pattern: re.Pattern, lower: bool = False) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, each followed by one space; starts and ends in bytes; number of words of each text."""
    if lower:
        texts = [t.lower() for t in texts]
    words = [t.split() for t in texts] if pattern is SPACED else [pattern.findall(t) for t in texts]  # bytes split at the same white space
    counts = np.array([len(w) for w in words], np.int64)
    flat = b" ".join([b" ".join(w) for w in words if w]) + b" "
    buf = np.frombuffer(flat, np.uint8)
    ends = np.flatnonzero(buf == 32) if counts.sum() else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return flat, starts.astype(np.int64), ends.astype(np.int64), counts


def runs(spots: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged [start, end) of the intervals [s, s + width); spots ascending."""
    if not len(spots):
        return spots, spots
    cut = np.flatnonzero(spots[1:] > spots[:-1] + width) + 1
    return spots[np.concatenate([[0], cut])], spots[np.concatenate([cut - 1, [len(spots) - 1]])] + width


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
