"""3. Benchmark decontamination with a generalised suffix automaton of normalised test items.

Documents stream through it without a shuffle. After each word the state tells the
longest match that ends there. A match of n words, or of a whole shorter item, hits
its words. Spans of hits are removed; a document whose share of hit words exceeds
`max_coverage` goes as a whole.

Memory is bounded for a benchmark of any size. Executors cut long items into parts
that overlap by n - 1 words, deal parts into groups of about GROUP_WORDS words and
build an automaton of each; the driver only hands their files' names on. Spark
brings the files to each executor's disk, and a Python worker holds HELD automata at
a time, so a larger benchmark costs more passes over a batch's words.

Defined cases: null or empty texts and items have no words; items that repeat
count each by its id; a null item_id is written as an empty string; an empty
benchmark hits nothing. Documents that repeat are each judged alike. Carried columns
with the name of a result are replaced by it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm import base as b

#: Words of one automaton (about 400 bytes each at two states a word), words of a part of an item, automata in a worker.
GROUP_WORDS, PART_WORDS, HELD = 150_000, 5_000, 2
TEXT = "_siltbed_text"
RESULT = ["n_words", "n_hit", "items", "clean"]


class Automaton:
    """Suffix automaton of several word sequences; words are numbered from 1."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.n = n
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        tokens = [(i, [self.words.setdefault(w, len(self.words) + 1) for w in words]) for i, words in items if words]
        for _, seq in tokens:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        #: state -> items of its n-word string; state -> (length, item) of whole short items
        self.of_window: list[set[str] | None] = [None] * len(self.next)
        self.short: list[list[tuple[int, str]] | None] = [None] * len(self.next)
        for item, seq in tokens:
            state, long = 0, 0
            for w in seq:
                state, long = self.step(state, long, w)
                if long >= n:
                    at = self.at_length(state, n)
                    if self.of_window[at] is None:
                        self.of_window[at] = set()
                    self.of_window[at].add(item)
            if len(seq) < n:
                if self.short[state] is None:
                    self.short[state] = []
                self.short[state].append((len(seq), item))
        #: state -> nearest of itself and its suffixes that is a whole short item
        self.short_at = [-1] * len(self.next)
        self.window_at = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short_at[s] = s if self.short[s] else self.short_at[self.link[s]]
            self.window_at[s] = self.at_length(s, n) if self.length[s] >= n else -1

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # another item has been here
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
        link[q] = twin
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = twin
            p = link[p]
        return twin

    def step(self, state: int, long: int, w: int) -> tuple[int, int]:
        while state and w not in self.next[state]:
            state = self.link[state]
            long = self.length[state]
        if w in self.next[state]:
            return self.next[state][w], long + 1
        return 0, 0

    def at_length(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [from, to) of matches, and the items they belong to."""
        n, nxt, link, length, window_at, short_at = self.n, self.next, self.link, self.length, self.window_at, self.short_at
        spans, items = [], set()
        state = long = 0
        for i, w in enumerate(map(self.words.get, words)):
            if w is None:
                state = long = 0
                continue
            here = nxt[state].get(w)
            if here is None:
                while state and here is None:
                    state = link[state]
                    here = nxt[state].get(w)
                long = length[state]
                if here is None:
                    continue
            state, long = here, long + 1
            if long >= n:
                spans.append((i + 1 - n, i + 1))
                items |= self.of_window[window_at[state]]
            s = short_at[state]
            while s > 0:
                for size, item in self.short[s]:
                    if size <= long:
                        spans.append((i + 1 - size, i + 1))
                        items.add(item)
                s = short_at[link[s]]
        return b.merged(spans), items


def automata(bench: DataFrame, item_col: str, text_col: str, n: int) -> list[str]:
    """Names of files that Spark brings to every executor, with an automaton each."""
    spark = bench.sparkSession
    rows = bench.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in b.pieces(batches, "text"):
            out = []
            for item, raw in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = b.ALNUM.findall(raw.lower())
                step = max(1, PART_WORDS - n + 1)
                for at in range(0, max(len(words) - n + 1, 1) if words else 0, step):
                    part = words[at : at + step + n - 1]
                    out.append((item, b" ".join(part).decode(), len(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["item", "words", "n"])

    parts = b.written(rows.mapInArrow(cut, "item string, words string, n long"), "items")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return []
    group = F.pmod(F.xxhash64("item", "words"), F.lit(-(-total // GROUP_WORDS)))

    def build(table: pa.Table) -> pa.Table:
        items = sorted(zip(table.column("item").to_pylist(), table.column("words").to_pylist(), strict=True))
        whole = Automaton([(item, words.encode().split(b" ")) for item, words in items], n)
        return pa.table({"blob": pa.array([zstandard.ZstdCompressor(level=1).compress(pickle.dumps(whole))], pa.binary())})

    path = b.shared_dir(spark, "automata")
    parts.select(group.alias("group"), "item", "words").groupBy("group").applyInArrow(build, "blob binary").write.option("maxRecordsPerFile", 1).parquet(path)
    folder, system = b.hadoop(spark, path)
    found = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().endswith(".parquet")]
    names = []
    for i, old in enumerate(sorted(found, key=lambda p: p.getName())):
        new, _ = b.hadoop(spark, f"{path}/{path.rpartition('/')[2]}-{i}.automaton")  # a name of its own: Spark keeps one file a name
        system.rename(old, new)
        spark.sparkContext.addFile(new.toString())
        names.append(new.getName())
    return names


_held: dict[str, Automaton | None] = {}


def held(name: str) -> Automaton | None:
    """The automaton of a file, from the worker's memory of the last few; None if the file has none, as Spark may write one without rows."""
    if name not in _held:
        while len(_held) >= HELD:
            del _held[next(iter(_held))]
        blobs = pq.read_table(SparkFiles.get(name)).column("blob").to_pylist()
        _held[name] = pickle.loads(zstandard.ZstdDecompressor().decompress(blobs[0])) if blobs else None
    return _held[name]


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, max_coverage: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """id (or the columns of `carry`), n_words, n_hit, items (sorted ids as strings), clean (text without the hit spans; null if the document goes)."""
    files = automata(bench, item_col, item_text_col, n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in b.pieces(batches, TEXT):
            found = [([], set()) for _ in texts]
            sizes = [0] * len(texts)
            for name in files or [""]:
                automaton = held(name) if name else None
                for i, raw in enumerate(texts):
                    words = b.ALNUM.findall(raw.lower())
                    sizes[i] = len(words)
                    if automaton:
                        spans, items = automaton.scan(words)
                        found[i][0].extend(spans)
                        found[i][1].update(items)
            rows = []
            for raw, null, size, (spans, items) in zip(texts, batch.columns[-1].is_null().to_pylist(), sizes, found, strict=True):
                spans = b.merged(spans) if len(files) > 1 else spans
                hit = sum(y - x for x, y in spans)
                clean = None if null else raw.decode()
                if hit > max_coverage * size:
                    clean = None
                elif spans:
                    places = [m.span() for m in b.ALNUM.finditer(raw.lower())]
                    last, parts = 0, []
                    for x, y in spans:
                        parts.append(raw[last : places[x][0]])
                        last = places[y - 1][1]
                    clean = b"".join([*parts, raw[last:]]).decode()
                rows.append((size, hit, sorted(items), clean))
            n_words, n_hit, items, clean = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(clean, pa.string())], [*names, *RESULT])

    own = [F.col(f"`{c}`") for c in carry if c not in RESULT] if carry else [F.col(f"`{id_col}`").cast("long").alias(id_col)]
    out = docs.select(*own, F.col(f"`{text_col}`").cast("string").alias(TEXT))
    names = out.columns[:-1]
    more = T.StructType.fromDDL("n_words long, n_hit long, items array<string>, clean string")
    return out.mapInArrow(scan, T.StructType([*out.schema.fields[:-1], *more.fields]))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(b.read(spark, sf_dir, "documents"), b.read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
