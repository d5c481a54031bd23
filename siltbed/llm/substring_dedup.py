"""1. Substring dedup over words by super-k-mer partitioning.

A word goes if a window of k words covers it whose word sequence also starts
earlier (smaller id, or the same document further left) anywhere in the input;
windows are judged on the input. In a block, all windows are sorted by hash and
place; equal hashes are confirmed on the words themselves.

Defined cases: null or empty text: no words, nothing removed, empty result.
Texts under k words: unchanged but for white space. Rows that repeat both id and
text stand at the same place, so neither is earlier. Rows that share an id but
not the text are ordered by text fingerprint. Null ids sort first.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import base as b
from siltbed.llm.spans import Cut, covers, with_covers


def _repeats(k: int):
    def solve(own, ids, fps, at, wins, tag, lens, text: bytes):
        """Windows that are not the first of their kind in this block."""
        if not len(own):
            return
        # strings are followed by nothing: part them by a space, so that words end
        begin = np.cumsum(lens[own]) - lens[own]
        flat = b" ".join([text[x:y] for x, y in zip(begin.tolist(), (begin + lens[own]).tolist(), strict=True)]) + b" "
        buf = np.frombuffer(flat, np.uint8)
        ends = np.flatnonzero(buf == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        count = wins[own].astype(np.int64) + k - 1
        first = np.cumsum(count) - count
        n = wins[own].astype(np.int64)
        row = np.repeat(np.arange(len(own)), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        spot = first[row] + inner
        h = b.grams(b.word_hashes(buf, starts, ends), k)[spot]
        i, f, a = ids[own][row], fps[own][row], at[own][row] + inner
        order = np.argsort(h, kind="stable")
        hs = h[order]
        twin = np.concatenate([hs[1:] == hs[:-1], [False]])
        twin[1:] |= twin[:-1].copy()
        order = order[twin]  # only hashes that occur again
        order = order[np.lexsort((a[order], f[order], i[order], h[order]))]
        if not len(order):
            return
        hs = h[order]
        head = np.concatenate([[True], hs[1:] != hs[:-1]])
        lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        x, y = starts[spot[order]].tolist(), ends[spot[order] + k - 1].tolist()
        p, q = starts[spot[lead]].tolist(), ends[spot[lead] + k - 1].tolist()
        bad = [j for j in range(len(x)) if flat[x[j] : y[j]] != flat[p[j] : q[j]]]
        for value in {int(hs[j]) for j in bad}:  # different windows of one hash: sort these by their words
            first_of: dict[bytes, int] = {}
            for j in np.flatnonzero(hs == b.U(value)).tolist():
                lead[j] = first_of.setdefault(flat[x[j] : y[j]], int(order[j]))
        later = (i[order] != i[lead]) | (f[order] != f[lead]) | (a[order] != a[lead])
        found = order[later]
        yield own[row[found]], a[found], a[found] + k

    return solve


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 4) -> DataFrame:
    """id, n_words, n_removed, kept (the kept words, one space between) for every row of docs."""
    found = covers(b.keyed(docs, id_col, text_col), Cut(k, m, words=True, earliest=True), _repeats(k))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = b.SPACED.findall(text.encode()) if text else []
                n.append(len(words))
                last, parts = 0, []
                for lo, hi in b.merged([(s["_from"], s["_to"]) for s in spans or ()]):
                    parts += words[last:lo]
                    last = hi
                parts += words[last:]
                gone.append(len(words) - len(parts))
                kept.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["_id", "n_words", "n_removed", "kept"])

    out = with_covers(docs, id_col, text_col, found).mapInArrow(keep, "_id long, n_words long, n_removed long, kept string")
    return out.select(b.unkeyed().alias(id_col), "n_words", "n_removed", "kept")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(b.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))
