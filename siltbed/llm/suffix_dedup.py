"""2. Suffix-array dedup over bytes with two-stage suffix sorting.

A byte goes if a string of `length` bytes covers it that also starts anywhere
else in the corpus, the same document included. Super-k-mers bring equal strings
into one block (spans.py). There, strings that are equal as a whole are folded;
of the rest, those that share a minimiser with another are laid end to end and a
suffix array is made in two stages: suffixes smaller than their successors are
sorted directly, all others are induced by a scan over the buckets of first
bytes. Adjacent common prefixes of at least `length` bytes are the repeats.

Defined cases: null text: no bytes; texts under `length` bytes: unchanged. Rows
that repeat id and text count as two documents, so all their strings are repeated.
What is kept may end inside a character; the result is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import base as b
from siltbed.llm.spans import REPEATED, Cut, covers, with_covers


def word_keys(s: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one big-endian number; zeros beyond the end."""
    k = np.concatenate([s, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        k = (k[:-width] << b.U(8 * width)) | k[width:]
    return k[: len(s)]


def _direct(s: np.ndarray, flat: bytes, spots: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """spots in the order of their suffixes' first `depth` bytes."""
    later = np.minimum(spots + 8, len(s))
    second = np.concatenate([keys, [b.U(0)]])[later]
    first = keys[spots]
    order = np.lexsort((second, first))
    first, second, spots = first[order], second[order], spots[order]
    same = np.concatenate([[False], (first[1:] == first[:-1]) & (second[1:] == second[:-1])])
    heads = np.flatnonzero(~same)
    sizes = np.diff(np.concatenate([heads, [len(spots)]]))
    for x, n in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        spots[x : x + n] = sorted(spots[x : x + n].tolist(), key=lambda i: flat[i : i + depth])
    return spots


def two_stage(flat: bytes, depth: int) -> np.ndarray:
    """The suffixes of flat, ordered by their first `depth` bytes at least."""
    s = np.frombuffer(flat, np.uint8)
    n = len(s)
    if n < 2:
        return np.arange(n)
    up, differs = s[:-1] < s[1:], s[:-1] != s[1:]
    place = np.where(differs, np.arange(n - 1), n - 1)
    end_of_run = np.minimum.accumulate(place[::-1])[::-1]
    smaller = np.concatenate([np.where(end_of_run == n - 1, False, up[np.minimum(end_of_run, n - 2)]), [False]])
    direct = _direct(s, flat, np.flatnonzero(smaller), word_keys(s), depth)
    edges = np.searchsorted(s[direct], np.arange(257))
    waiting: dict[int, list[np.ndarray]] = {int(s[n - 1]): [np.array([n - 1])]}
    out = []
    for c in np.unique(s).tolist():
        large = [np.concatenate(waiting.pop(c))] if c in waiting else []
        front = large[0] if large else np.zeros(0, np.int64)
        while len(front):  # runs of one byte
            before = front[front > 0] - 1
            front = before[s[before] == c]
            large.append(front)
        scan = np.concatenate([*large, direct[edges[c] : edges[c + 1]]])
        out.append(scan)
        before = scan[scan > 0] - 1
        before = before[s[before] > c]
        order = np.argsort(s[before], kind="stable")
        before = before[order]
        heads = np.searchsorted(s[before], np.unique(s[before]))
        for part in np.split(before, heads[1:]) if len(before) else []:
            waiting.setdefault(int(s[part[0]]), []).append(part)
    return np.concatenate(out)


def repeated_starts(flat: bytes, valid: np.ndarray, length: int) -> np.ndarray:
    """Where, among valid starts, a string of `length` bytes begins that begins at another valid start too; ascending."""
    order = two_stage(flat, length)
    order = order[valid[order]]
    if len(order) < 2:
        return order[:0]
    keys = word_keys(np.frombuffer(flat, np.uint8))
    pair = np.arange(len(order) - 1)
    for at in [*range(0, length - 8, 8), length - 8]:  # adjacent common prefixes, eight bytes at a time
        pair = pair[keys[order[pair] + at] == keys[order[pair + 1] + at]]
    return np.unique(np.concatenate([order[pair], order[pair + 1]]))


def _repeats(k: int, m: int):
    def solve(own, ids, fps, at, wins, tag, lens, text: bytes):
        begin = np.cumsum(lens[own]) - lens[own]
        strings = [text[x:y] for x, y in zip(begin.tolist(), (begin + lens[own]).tolist(), strict=True)]
        seen: dict[bytes, int] = {}
        lead = np.array([seen.setdefault(s, j) for j, s in enumerate(strings)], np.int64)
        whole = tag[own] < 0
        twice = np.bincount(lead, minlength=len(own)) > 1 if len(own) else whole
        whole = whole | twice[lead]
        rows = np.flatnonzero(whole)
        yield own[rows], at[own[rows]], at[own[rows]] + lens[own[rows]]
        heads = np.flatnonzero(lead == np.arange(len(own)))
        kind = tag[own[heads]] & 0x7FFFFFFF
        _, back, count = np.unique(kind, return_inverse=True, return_counts=True)
        met = count[back] > 1
        for j in np.flatnonzero(~met).tolist():  # alone, yet it may repeat itself: then what all its windows share comes twice
            string, n = strings[heads[j]], int(wins[own[heads[j]]])
            met[j] = n > k - m or n > 1 and string.find(string[n - 1 : k], n) >= 0
        heads, kind = heads[met], kind[met]
        heads = heads[np.argsort(kind, kind="stable")]
        if not len(heads):
            return
        kind, size = tag[own[heads]] & 0x7FFFFFFF, lens[own[heads]].astype(np.int64)
        group_end = np.concatenate([np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(heads)]])
        filled, x = 0, 0
        for y in group_end.tolist():  # whole minimiser groups, about SORT_BYTES at a time
            filled = int(size[x:y].sum())
            if filled < SORT_BYTES and y < len(heads):
                continue
            part = heads[x:y]
            flat = b"".join([strings[j] for j in part.tolist()])
            n, w = size[x:y], wins[own[part]].astype(np.int64)
            first = np.cumsum(n) - n
            valid = np.zeros(len(flat), bool)
            valid[np.repeat(first, w) + np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)] = True
            hit = repeated_starts(flat, valid, k)
            row = np.searchsorted(first, hit, "right") - 1
            part_own = own[part[row]]
            keep = ~whole[part[row]]
            spot = at[part_own] + hit - first[row]
            yield part_own[keep], spot[keep], spot[keep] + k
            x = y

    return solve


#: Bytes of strings that are sorted at once (more only where one minimiser has more).
SORT_BYTES = 1 << 20


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, m: int = 24) -> DataFrame:
    """id, n_bytes, n_removed, spans (removed [from, to) in bytes), kept (binary) for every row of docs."""
    found = covers(b.keyed(docs, id_col, text_col), Cut(length, m, words=False, earliest=False), _repeats(length, m))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, cuts, kept = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode() if text else b""
                ranges = b.merged([(s["_from"], s["_to"]) for s in spans or ()])
                last, parts = 0, []
                for lo, hi in ranges:
                    parts.append(raw[last:lo])
                    last = hi
                parts.append(raw[last:])
                kept.append(b"".join(parts))
                n.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                cuts.append([{"from": lo, "to": hi} for lo, hi in ranges])
            span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, span), pa.array(kept, pa.binary())], ["_id", "n_bytes", "n_removed", "spans", "kept"])

    out = with_covers(docs, id_col, text_col, found).mapInArrow(keep, "_id long, n_bytes long, n_removed long, spans array<struct<from: long, to: long>>, kept binary")
    return out.select(b.unkeyed().alias(id_col), "n_bytes", "n_removed", "spans", "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(b.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
