"""Super-k-mer partitioning: the exchange below substring dedup (words) and suffix-array dedup (bytes).

A window is k consecutive units of one document. Consecutive windows that share
a minimiser (the least hash of the m-unit grams inside) travel together as one
packed string to the block of that minimiser, so equal windows always meet in
one block, and a unit travels about (k - m) / ((k - m) / 2) + 1 times instead of k.

Skew. A map task first folds equal packed strings, so a group of copies arrives
once for each map batch. Minimisers that stay frequent after that (a passage in
many different surroundings, or in very many batches) are marked in a bitmap of fixed
size, and their windows do not go to blocks: they are counted by 128-bit hashes with
Spark's aggregation, which folds each task's part first, so no task gathers the
copies of a hot window. A bit that two minimisers share only sends more windows that way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm import base as b

#: Bits of the map of hot minimisers, and packed bytes of a block.
HOT_BITS, BLOCK_BYTES = 26, 7 << 20
#: One batch in so many reports minimisers that are alone in it, with that weight.
SAMPLED = 64
#: Strings of a hot minimiser at least.
LEAST_HOT = 8
#: Texts worked on at once.
PART_BYTES = 4 << 20


@dataclass(frozen=True)
class Cut:
    """k units a window, m units a gram; words or bytes."""

    k: int
    m: int
    words: bool
    earliest: bool  # fold to the earliest place (else to any, which counts as repeated)

    def units(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat text, byte bounds of its units, units of each text, unit hashes."""
        if self.words:
            flat, starts, ends, counts = b.joined_words(texts, b.SPACED)
            return flat, starts, ends, counts, b.word_hashes(np.frombuffer(flat, np.uint8), starts, ends)
        flat = b"".join(texts)
        starts = np.arange(len(flat))
        return flat, starts, starts + 1, np.array([len(t) for t in texts], np.int64), b.BYTE_VALUES[np.frombuffer(flat, np.uint8)]

    def parts(self, batches: Iterator[pa.RecordBatch]):
        """(ids, fps, first units, texts) of about PART bytes; a longer text comes in parts that overlap by k - 1 units."""
        most = PART_BYTES if self.words else PART_BYTES * 3 // 4
        for batch, texts in b.pieces(batches, "_text", most):
            ids, fps = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("_id", "_fp"))
            if len(texts) > 1 or len(texts[0]) <= 2 * most:
                yield ids, fps, np.zeros(len(texts), np.int64), texts
                continue
            units = b.SPACED.findall(texts[0]) if self.words else texts[0]
            step = most // 8 if self.words else most
            for at in range(0, max(1, len(units) - self.k + 1), step):
                part = units[at : at + step + self.k - 1]
                yield ids, fps, np.array([at]), [b" ".join(part) if self.words else part]

    def super_kmers(self, counts: np.ndarray, hashes: np.ndarray):
        """(document, first unit in the flat text, windows, minimiser) of each run, in order."""
        least = b.sliding_min(b.grams(hashes, self.m), self.k - self.m + 1)
        first = np.concatenate([[0], np.cumsum(counts)])
        doc = np.repeat(np.arange(len(counts)), np.maximum(counts - self.k + 1, 0))
        per = np.maximum(counts - self.k + 1, 0)
        if not len(doc):
            return doc, doc, doc, least[:0]
        spot = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + first[doc]
        value = least[spot]
        new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]))
        return doc[new], spot[new], np.diff(np.concatenate([new, [len(doc)]])), value[new]


def _tag(id_: int, more: int) -> np.uint64:
    """A hash of an id, of any value, and a number."""
    return b.mix(b.mix(np.array([id_], np.int64).view(np.uint64)) + b.U(more))[0]


def _packed(flat: bytes, cut: Cut, starts, ends, spot, wins) -> list[bytes]:
    return [flat[x:y] for x, y in zip(starts[spot].tolist(), ends[spot + wins + cut.k - 2].tolist(), strict=True)]


def hot_minimisers(keyed: DataFrame, cut: Cut) -> tuple[np.ndarray | None, int]:
    """The bitmap of frequent minimisers (None if there are none), and the number of blocks; from all documents.

    Each map batch reports minimisers that at least two different packed strings share, and a hash picks
    batches for those that are alone. This tells only which way windows go, not what is found.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, offset, texts in cut.parts(batches):
            flat, starts, ends, counts, hashes = cut.units(texts)
            doc, spot, wins, value = cut.super_kmers(counts, hashes)
            whole = b.mix(value + hashes[spot] * b.U(3) + hashes[spot + wins + cut.k - 2] * b.U(5) + wins.astype(np.uint64))
            _, keep = np.unique(whole, return_index=True)
            found, n = np.unique(value[keep], return_counts=True)
            batch = _tag(ids[0], int(offset[0]) + len(flat))
            picked = b.mix(found ^ batch) % b.U(SAMPLED) == 0
            often = (n > 1) | picked
            n = np.where(n > 1, n, SAMPLED)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([found[often].view(np.int64), [0]])), pa.array(np.concatenate([n[often], [len(flat)]])), pa.array(np.concatenate([np.zeros(int(often.sum()), bool), [True]]))],
                ["value", "n", "is_size"],
            )

    sums = b.written(keyed.mapInArrow(count, "value long, n long, is_size boolean").groupBy("is_size", "value").agg(F.sum("n").alias("n")), "minimisers")
    total = sums.where("is_size").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(64, -(-3 * total // BLOCK_BYTES))
    windows = total / (6 if cut.words else 1)
    usual = max(LEAST_HOT, 2 * windows / (cut.k - cut.m) / blocks / 2)  # half a block
    slot = F.col("value").bitwiseAND(F.lit((1 << HOT_BITS) - 1))
    words = sums.where(~F.col("is_size") & (F.col("n") > usual)).select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most 2^(HOT_BITS - 6) rows
    b.drop_tables(sums)
    if not len(found):
        return None, int(blocks)
    bitmap = np.zeros(1 << HOT_BITS - 6, np.uint64)
    bitmap[found.word] = found.bits.to_numpy(np.int64).view(np.uint64)
    return bitmap, int(blocks)


def _is_hot(value: np.ndarray, bitmap: np.ndarray | None) -> np.ndarray:
    if bitmap is None:
        return np.zeros(len(value), bool)
    slot = value & b.U((1 << HOT_BITS) - 1)
    return (bitmap[(slot >> b.U(6)).astype(np.int64)] >> (slot & b.U(63))) & b.U(1) == 1


def _pack(ids, fps, at, wins, tag, strings: list[bytes]) -> bytes:
    lens = np.array([len(s) for s in strings], np.int32)
    head = np.array([len(strings)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(
        b"".join([head, *(np.ascontiguousarray(x, t).tobytes() for x, t in ((ids, np.int64), (fps, np.int64), (at, np.int64), (wins, np.int32), (tag, np.int32), (lens, np.int32))), *strings])
    )


def unpack(blobs: list[bytes]):
    """ids, fps, first units, windows, tags, lengths and the joined strings of a block."""
    cols, texts = [[] for _ in range(6)], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for col, kind in zip(cols, (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32), strict=True):
            col.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        texts.append(raw[at:])
    return [np.concatenate(c) for c in cols], b"".join(texts)


_COVER = "_id long, _fp long, _from long, _to long"
#: The tag's top bit says that the string is repeated, the rest are bits of its minimiser.
REPEATED = -(2**31)


def covers(keyed: DataFrame, cut: Cut, solve: Callable) -> DataFrame:
    """(_id, _fp, _from, _to): ranges of units that repeated windows cover, as `solve` judges the blocks.

    solve(columns, text) gets what unpack() returns and yields (row numbers, from, to) in units of the document.
    """
    hot, blocks = hot_minimisers(keyed, cut)
    spark = keyed.sparkSession
    shipped = spark.sparkContext.broadcast(hot)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shipped.value
        for ids, fps, offset, texts in cut.parts(batches):
            flat, starts, ends, counts, hashes = cut.units(texts)
            doc, spot, wins, value = cut.super_kmers(counts, hashes)
            first = np.concatenate([[0], np.cumsum(counts)])
            usual = ~_is_hot(value, hot)
            doc, spot, wins, value = doc[usual], spot[usual], wins[usual], value[usual]
            strings = _packed(flat, cut, starts, ends, spot, wins)
            at = spot - first[doc] + offset[doc]
            order = np.lexsort((at, fps[doc], ids[doc])) if cut.earliest else np.arange(len(doc))
            seen: dict[bytes, int] = {}
            kept, again, repeated = [], [], set()
            for i in order.tolist():
                j = seen.setdefault(strings[i], i)
                if j == i:
                    kept.append(i)
                elif cut.earliest and (ids[doc[i]], fps[doc[i]], at[i]) == (ids[doc[j]], fps[doc[j]], at[j]):
                    continue  # the same place, from a repeated row
                else:
                    again.append(i)
                    repeated.add(j)
            if not cut.earliest:
                again += repeated
            kept, again = np.array(kept, np.int64), np.array(again, np.int64)
            tag = (value & b.U(0 if cut.earliest else 0x7FFFFFFF)).astype(np.int64)
            if not cut.earliest and repeated:
                tag[list(repeated)] |= REPEATED
            block = (b.mix(value[kept]) % b.U(blocks)).astype(np.int64)
            by = np.argsort(block, kind="stable")
            kept, block = kept[by], block[by]
            edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else np.zeros(1, np.int64)
            out_block, out_blob = [], []
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = kept[x:y]
                out_block.append(int(block[x]))
                out_blob.append(_pack(ids[doc[own]], fps[doc[own]], at[own], wins[own], tag[own], [strings[i] for i in own.tolist()]))
            if len(again):  # already known to be repeated: bounds without a string
                out_block.append(int(_tag(ids[doc[again[0]]], len(flat)) % b.U(blocks)))
                out_blob.append(_pack(ids[doc[again]], fps[doc[again]], at[again], wins[again], np.zeros(len(again)), [b""] * len(again)))
            yield pa.RecordBatch.from_arrays([pa.array(out_block, pa.int64()), pa.array(out_blob, pa.binary())], ["block", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        cols, text = unpack(table.column("blob").to_pylist())
        ids, fps, at, wins, tag, lens = cols
        known = lens == 0
        rows, lo, hi = [np.flatnonzero(known)], [at[known]], [at[known] + wins[known] + cut.k - 1]
        own = np.flatnonzero(~known)
        for r, x, y in solve(own, ids, fps, at, wins, tag, lens, text):
            rows.append(r), lo.append(x), hi.append(y)
        rows, lo, hi = np.concatenate(rows), np.concatenate(lo), np.concatenate(hi)
        order = np.lexsort((lo, fps[rows], ids[rows]))
        rows, lo, hi = rows[order], lo[order], hi[order]
        if len(rows):  # merge what overlaps within a document
            i, f = ids[rows], fps[rows]
            new = np.concatenate([[True], (i[1:] != i[:-1]) | (f[1:] != f[:-1])])
            span = int(hi.max()) + 1
            group = np.cumsum(new) - 1
            top = np.maximum.accumulate(hi + group * span)
            new |= np.concatenate([[True], (lo + group * span)[1:] > top[:-1]])
            heads = np.flatnonzero(new)
            last = np.concatenate([heads[1:] - 1, [len(rows) - 1]])
            rows, lo, hi = rows[heads], lo[heads], (top - group * span)[last]
        return pa.table({"_id": ids[rows], "_fp": fps[rows], "_from": lo.astype(np.int64), "_to": hi.astype(np.int64)})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 4))
    met = keyed.mapInArrow(send, "block long, blob binary").repartition(parts, "block").groupBy("block").applyInArrow(meet, _COVER)
    found = met if hot is None else met.unionByName(_hot_covers(keyed, cut, shipped))
    return b.written(found, "covers")  # frees what the blocks took on disk before texts are sent


def _hot_covers(keyed: DataFrame, cut: Cut, shipped) -> DataFrame:
    """The covers of windows with a hot minimiser, told from 128-bit hashes of all of them."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, fps, offset, texts in cut.parts(batches):
            _, _, _, counts, hashes = cut.units(texts)
            doc, spot, wins, value = cut.super_kmers(counts, hashes)
            hot = _is_hot(value, shipped.value)
            n = wins[hot]
            if not len(n):
                continue
            first = np.concatenate([[0], np.cumsum(counts)])
            one = np.repeat(spot[hot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            doc = np.repeat(doc[hot], n)
            at = one - first[doc] + offset[doc]
            h1, h2 = b.grams(hashes, cut.k)[one], b.grams(b.mix(hashes ^ b.U(0xA5A5A5A5A5A5A5A5)), cut.k)[one]
            order = np.lexsort((at, fps[doc], ids[doc], h2, h1))
            h1, h2, i, f, at = h1[order], h2[order], ids[doc][order], fps[doc][order], at[order]
            new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            many = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))[np.cumsum(new) - 1] > 1
            here = (i == i[lead]) & (f == f[lead]) & (at == at[lead])
            known = ~here if cut.earliest else many  # what the batch alone tells to be repeated
            sent = new | known
            sent_known = known[sent] & ~new[sent] if cut.earliest else known[sent]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[sent].view(np.int64)) for x in (h1, h2)), pa.array(i[sent]), pa.array(f[sent]), pa.array(at[sent]), pa.array(sent_known), pa.array(new[sent]), pa.array(many[sent])],
                ["h1", "h2", "_id", "_fp", "_from", "known", "head", "many"],
            )

    rows = b.written(keyed.mapInArrow(windows, "h1 long, h2 long, _id long, _fp long, _from long, known boolean, head boolean, many boolean"), "hot-windows")
    heads = rows.where("head")
    place = F.struct("_id", "_fp", "_from")
    groups = heads.groupBy("h1", "h2").agg(F.count("*").alias("size"), F.min(place).alias("first")).where("size > 1")
    again = b.join_sized(heads.where("not known").select("h1", "h2", "_id", "_fp", "_from"), groups, ["h1", "h2"])
    again = again.where(place != F.col("first")) if cut.earliest else again
    found = rows.where("known").select("_id", "_fp", "_from").unionByName(again.select("_id", "_fp", "_from"))
    return found.withColumn("_to", F.col("_from") + cut.k)


def with_covers(docs: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """(_id, _text, _spans): every row of docs with the ranges found for it, null if none."""
    spans = found.groupBy("_id", "_fp").agg(F.collect_list(F.struct("_from", "_to")).alias("_spans"))
    return b.keyed(docs, id_col, text_col).join(spans, ["_id", "_fp"], "left").select("_id", "_text", "_spans")
