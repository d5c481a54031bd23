"""8. Packing: best-fit decreasing with a segment tree indexed by remaining capacity.

A document is its token ids and an end id. Overlong documents are first cut into
full windows, which fill a sequence each; the rest is a tail. Tails of one length
can stand for each other, so the plan is made from the histogram of tail lengths
(at most `size` numbers, however many documents): longest first, each length takes
the tightest open sequences that a segment tree over remaining capacities finds,
many at once. The tails then find their places by their rank among equals: each
map task has numbered its own, and running sums over tasks give the base.

Defined cases: a null or empty text is the end id alone. Ids that repeat keep
all their rows. No tokens are lost, cut twice or reordered within a document.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.llm import base as b

#: Entries of the worker's memory of tokenised units; it starts anew beyond.
MEMORY = 600_000


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Letters whose lower case and composition are plain; ASCII marks (no apostrophe: it starts units of its own).
_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}"
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class WordTokens:
    """Token ids of texts. This tokenizer drops white space and none of its patterns crosses it,
    so the ids of a text are those of its words in turn, and each distinct word of a batch is looked at once.

    Most words are letters with ASCII marks behind them. The tokenizer ignores case and takes a run of letters, or
    of marks, as one unit, so `And`, `and,` and `and` need one encoding; units are encoded many at once, as one text,
    and told apart by the tokens that end a unit. Other words are encoded whole. The memory is the process's own:
    later tasks of the same worker find it filled.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _whole(self, words: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in encode(words, add_special_tokens=False)]

    def _learn_units(self, units: list[str]) -> None:
        """Each is one run of letters or of marks, so it ends with an end token of its own."""
        for at in range(0, len(units), 50):
            part = units[at : at + 50]
            raw, begin = self._whole([" ".join(part)])[0], 0
            bounds = 4 * (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1)
            if len(bounds) != len(part):
                self.known.update(zip(part, self._whole(part), strict=True))
                continue
            for unit, end in zip(part, bounds.tolist(), strict=True):
                self.known[unit], begin = raw[begin:end], end

    def _ids(self, units: pa.Array) -> list[bytes]:
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        words = units.to_pylist()
        new = [i for i, w in enumerate(words) if w not in known]
        fresh = units.take(pa.array(new, pa.int64()))
        single = pc.match_substring_regex(fresh, f"^([{_LETTERS}]+|[{re.escape(_MARKS)}]+)$")
        self._learn_units(fresh.filter(single).to_pylist())
        other = fresh.filter(pc.invert(single)).to_pylist()
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            known.update(zip(part, self._whole(part), strict=True))
        return [known[w] for w in words]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, 32 bits each."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        bounds = np.asarray(split.offsets)
        coded = split.values.dictionary_encode()
        words = coded.dictionary
        run = pc.utf8_rtrim(words, _MARKS)
        plain = pc.match_substring_regex(run, f"^[{_LETTERS}]+$")
        marks = pc.replace_substring_regex(words.filter(plain), f"^[{_LETTERS}]+", "")
        units = pa.concat_arrays([pc.if_else(plain, pc.utf8_lower(run), words), marks, pa.array([""], pa.large_string())]).dictionary_encode()
        blobs = self._ids(units.dictionary)
        # every word is a unit and the marks behind it, which may be none
        unit = np.asarray(units.indices)
        behind = np.full(len(words), unit[-1])
        behind[np.asarray(plain)] = unit[len(words) : -1]
        pair = np.stack([unit[: len(words)], behind], axis=1)[np.asarray(coded.indices)].ravel()
        size = np.array([len(x) // 4 for x in blobs], np.int64)
        per = size[pair]
        done = np.concatenate([[0], np.cumsum(per)])
        ids = np.frombuffer(b"".join(blobs), "<u4")[np.arange(done[-1]) + np.repeat((np.cumsum(size) - size)[pair] - done[:-1], per)]
        cut = done[2 * bounds].tolist()
        return [ids[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]


class PlainTokens:
    """Token ids of texts, each encoded whole: for a tokenizer of any kind."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]


#: Fixed value: the units that WordTokens knows, as a tokenizer's file writes them; none has white space.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(path: str) -> bool:
    """Whether a tokenizer's ids are those of its words in turn and its case is folded, as WordTokens takes for granted."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    steps = [(x.get("type"), x.get("content"), x.get("pattern")) for x in (t["normalizer"] or {}).get("normalizers", [])]
    split = ((t["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    model = t["model"]
    return (
        steps == [("NFC", None, None), ("Replace", " ", {"Regex": r"\s+"}), ("Lowercase", None, None)]
        and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": UNITS}, "Removed", True)
        and (model["type"], model.get("end_of_word_suffix"), model.get("dropout"), model.get("continuing_subword_prefix")) == ("BPE", "</w>", None, None)
        and all(not re.search(r"\s", x["content"]) for x in t["added_tokens"])
    )


@lru_cache(2)
def word_tokens(path: str) -> WordTokens | PlainTokens:
    return WordTokens(path) if by_words(path) else PlainTokens(path)


class CapacityTree:
    """How many open sequences have each remaining capacity; finds the least capacity of at least x."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.sums[i] += n
            i //= 2

    def tightest(self, least: int) -> int:
        i = self.leaves + least
        if self.sums[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.sums[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return -1


def best_fit_plan(lengths: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset) from the numbers of tails of each length."""
    tree, open_at, plan, made = CapacityTree(size), {}, [], 0
    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        freed: list[tuple[int, int, int]] = []
        while left:
            cap = tree.tightest(length)
            if cap < 0:
                # a new sequence takes as many of this length as fit
                per = size // length
                n = -(-left // per)
                for k in range(per):
                    take = min(n, left)
                    plan.append((length, rank, take, made, k * length))
                    rank, left = rank + take, left - take
                    if take < n or not left:
                        if n - take:
                            freed.append((size - k * length, made + take, n - take))
                        freed.append((size - (k + 1) * length, made, take))
                        break
                else:
                    freed.append((size - per * length, made, n))
                made += n
            else:
                first, n = open_at[cap].pop()
                take = min(n, left)
                if take < n:
                    open_at[cap].append((first + take, n - take))
                tree.add(cap, -take)
                plan.append((length, rank, take, first, size - cap))
                rank, left = rank + take, left - take
                freed.append((cap - length, first, take))
                if cap - length >= length:  # the same length may go on top
                    for c, f, t in freed:
                        if t and c:
                            open_at.setdefault(c, []).append((f, t))
                            tree.add(c, t)
                    freed = []
        for c, f, t in freed:
            if t and c:
                open_at.setdefault(c, []).append((f, t))
                tree.add(c, t)
    return plan


_PIECE = "_id long, start long, length int, ids binary, ids_crc32 long, doc_tokens long, task int, rank long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, size: int = 4096) -> DataFrame:
    """id, start, length, ids (binary, little-endian 32 bits), ids_crc32, doc_tokens, sequence_id, offset for every piece.

    Only what is asked for travels: without `ids` rows are narrow. `tokenizer` is any file of the tokenizers library."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks, task = word_tokens(path), {}, TaskContext.get().partitionId()
        for batch, texts in b.pieces(batches, "_text", 8 << 20):
            rows = []
            for i, ids in zip(batch.column(0).to_pylist(), tokens(texts), strict=True):
                ids += end
                total = len(ids) // 4
                for at in range(0, total, size):
                    n = min(size, total - at)
                    ranks[n] = ranks.get(n, -1) + 1
                    piece = ids[4 * at : 4 * (at + n)]
                    rows.append((i, at, n, piece, zlib.crc32(piece), total, task, ranks[n]))
            cols = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "task", "rank"])

    found = b.written(b.keyed(docs, id_col, text_col).select("_id", "_text").mapInArrow(cut, _PIECE), "pieces")
    counts = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    base = b.written(counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base")), "bases")
    total = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    plan = best_fit_plan(total, size)
    spark = docs.sparkSession
    places = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "length int, first_rank long, n long, first_sequence long, offset long")
    ranked = found.join(base, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.join(F.broadcast(places), "length").where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n")))
    return placed.select(
        b.unkeyed().alias(id_col), "start", F.col("length").cast("long").alias("length"), "ids", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(b.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
