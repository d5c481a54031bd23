"""5. N-gram Jaccard join with a token-group matrix.

Documents of equal shingle sets form one class. A class looks for others through
its prefix: in any one order of all shingles, two sets of Jaccard similarity t or
more share one of their first n - ceil(t n) + 1 shingles. The order puts rare ones
first, judged by the frequency of their words and by whether several sets of a map
batch share them; both are tables of SLOTS bytes, filled from all documents, so the
broadcast does not grow and the order, whatever it is, is the same everywhere.
Classes of one prefix shingle are the similar documents that form a bucket.

A class also has a row of cells: how many of its shingles fall into each of some n / 4
cells of the hash space. The sum of the lesser counts bounds the overlap of two classes
from above, and the greater counts of several rows are the row of their union.

1. Buckets with the same members fold into one, and fall into classes of size that can link. Each proposes its
   members to LEADERS of them only (stars, linear in the bucket); pairs that pass the bound on cells are verified.
2. Buckets whose members are all connected by then are done. In the others members are dealt into chunks of about
   CHUNK shingles, those of a large component into chunks of their own. Each chunk has the row of its union, and two
   chunks meet only if they hold different components and the bound on their unions allows a link. So a cluster of
   near copies that its leaders hold together costs no pairs of chunks, however large.
3. Where chunks meet, members are laid out in groups of GROUP similar ones, each with the row of its union: a
   token-group matrix. A member is held against a group's members only if the bound on its overlap with the union
   allows a link, and only against other components. Members without a possible partner leave; no text has moved.
4. The rest falls into families, buckets that share members, so that each text is needed once. Families are dealt
   into chunks in the same way, now with the unions of the shingles themselves, which counts overlaps exactly.
5. Links make components; a document's class carries its component back to it.

No task holds more than two chunks, and there is one way for buckets of every size.

Shingles are 52-bit hashes and classes 64-bit hashes of sets: among 10^10 different sets some three pairs would be
taken for equal. Defined cases: no words or null text: an empty set
linked with nothing, component its own id; fewer words than k: the whole sequence
is the one shingle. Repeated ids take the least component among their rows' texts. Rows that repeat are of one class.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.llm import base as b
from siltbed.llm.components import components

#: Entries of each frequency table; sets of a group; shingles of a chunk; leaders of a bucket.
SLOTS, GROUP, CHUNK, LEADERS = 1 << 21, 16, 1 << 20, 3
#: Texts worked on at once.
ROWS = 4096


def occurrences(texts: list[bytes], k: int):
    """Of each shingle of at most ROWS texts: its text, 52 bits of hash, its first word among all (-1 for a short text's whole sequence); and the hashes of all words."""
    flat, starts, ends, n = b.joined_words(texts, b.SPACED, lower=True)
    h = b.word_hashes(np.frombuffer(flat, np.uint8), starts, ends)
    first = np.cumsum(n) - n
    size = np.maximum(n - k + 1, 0)
    spot = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
    doc, value, word = [np.repeat(np.arange(len(n), dtype=np.uint64), size)], [b.grams(h, k)[spot] >> b.U(12)], [spot]
    for m in range(1, k):  # fewer words: the whole sequence
        rows = np.flatnonzero(n == m)
        if len(rows):
            doc.append(rows.astype(np.uint64)), word.append(np.full(len(rows), -1))
            value.append(b.mix(b.grams(h, m)[first[rows]] + b.U(m)) >> b.U(12))
    return np.concatenate(doc), np.concatenate(value), np.concatenate(word), h


def shingle_sets(doc: np.ndarray, value: np.ndarray, texts: int):
    """Distinct hashes (ascending in each text), and how many each text has."""
    keys = np.unique((doc << b.U(52)) | value)
    return keys & b.U(2**52 - 1), np.bincount((keys >> b.U(52)).astype(np.int64), minlength=texts)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & b.U(SLOTS - 1)).astype(np.int64)


def linked(both, m, n, t: int):
    return 100 * both >= t * (m + n - both)


def _frequencies(keyed: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of twice the log2 of the frequency of words, and of shingles that sets of one map batch share."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in b.pieces(batches, "_text", 8 << 20, ROWS):
            texts = list(dict.fromkeys(texts))
            doc, value, _, words = occurrences(texts, k)
            shingles, _ = shingle_sets(doc, value, len(texts))
            for kind, values in ((0, words), (1, shingles)):
                found, n = np.unique(values, return_counts=True)
                often = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(often.sum()), kind, np.int32)), pa.array(found[often].view(np.int64)), pa.array(n[often])], ["kind", "token", "n"])

    counts = keyed.mapInArrow(count, "kind int, token long, n long").groupBy("kind", "token").agg(F.sum("n").alias("n"))
    unsigned = F.pmod(F.col("token"), F.lit(SLOTS))  # the low bits, as h % SLOTS of the unsigned number
    slots = counts.where((F.col("kind") == 0) | (F.col("n") >= 8)).groupBy("kind", unsigned.cast("int").alias("slot")).agg(F.max("n").alias("n")).toPandas()
    tables = np.zeros((2, SLOTS), np.uint8)
    tables[slots.kind, slots.slot] = np.minimum(255, 2 * np.log2(slots.n.to_numpy() + 1)).astype(np.uint8)
    return tables[0], tables[1]


def _pack(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(text)


def _unpack(blobs: list[bytes], k: int, most: int = 4 << 20) -> list[np.ndarray]:
    d = zstandard.ZstdDecompressor()
    out: list[np.ndarray] = []
    texts, held = [], 0
    for i, blob in enumerate(blobs):
        texts.append(d.decompress(blob))
        held += len(texts[-1])
        if held >= most or len(texts) == ROWS or i == len(blobs) - 1:
            doc, value, _, _ = occurrences(texts, k)
            value, size = shingle_sets(doc, value, len(texts))
            out += np.split(value, np.cumsum(size)[:-1])
            texts, held = [], 0
    return out


def _verify(k: int, t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                left, right = (_unpack(part.column(i).to_pylist(), k) for i in (2, 3))
                ok = []
                for a, c in zip(left, right, strict=True):
                    both = len(np.intersect1d(a, c, assume_unique=True))
                    ok.append(bool(linked(both, len(a), len(c), t)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok)], ["x", "y", "ok"])

    return run


def cell_rows(doc: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> pa.Array:
    """Of each text, the counts of its distinct shingles in 2^i cells (4 to 8 a cell); null if a count passes a byte."""
    cells = np.where(size > 0, 1 << np.maximum(np.log2(np.maximum(size, 1)).astype(np.int64) - 2, 3), 0)
    begin = np.cumsum(cells) - cells
    at = begin[doc] + ((hashes >> b.U(20)).astype(np.int64) & (cells[doc] - 1))
    counts = np.bincount(at, minlength=int(cells.sum()))
    over = np.zeros(len(size), bool)
    over[np.searchsorted(begin, np.flatnonzero(counts > 255), "right") - 1] = True
    ends = np.concatenate([[0], np.cumsum(cells)])
    raw = np.minimum(counts, 255).astype(np.uint8).tobytes()
    return pa.array([None if o else raw[x:y] for x, y, o in zip(ends[:-1].tolist(), ends[1:].tolist(), over.tolist(), strict=True)], pa.binary())


def _matrix(rows: list[bytes | None]) -> np.ndarray:
    """Rows of cells folded to the fewest cells among them; a missing row bounds nothing."""
    width = min((len(r) for r in rows if r), default=8)
    out = np.full((len(rows), width), 1 << 14, np.int32)
    for i, r in enumerate(rows):
        if r:
            out[i] = np.frombuffer(r, np.uint8).reshape(-1, width).sum(axis=0)
    return out


def _may_link(x: bytes | None, y: bytes | None, m: int, n: int, t: int) -> bool:
    both = _matrix([x, y])
    return (100 + t) * int(np.minimum(both[0], both[1]).sum()) >= t * (m + n)


def _similar(cells: np.ndarray) -> np.ndarray:
    """A number for each row that is close for similar rows."""
    return cells @ np.sin(np.arange(1, cells.shape[1] + 1) * 12.9898)


def qualifying(rows: list[bytes | None], n: np.ndarray, comp: np.ndarray, role: np.ndarray, t: int) -> np.ndarray:
    """Which members may link with one of another component, by the bounds on unions of groups and then on single rows.

    Queries are the members of role 0 and 2, groups are made of those of role 1 and 2."""
    cells, marked = _matrix(rows), np.zeros(len(rows), bool)
    own = np.flatnonzero(role != 0)
    own = own[np.lexsort((_similar(cells[own]), comp[own]))]
    if not len(own):
        return marked
    starts = np.arange(0, len(own), GROUP)
    unions = np.maximum.reduceat(cells[own], starts, axis=0)
    least = np.minimum.reduceat(n[own], starts)
    for q in np.flatnonzero(role != 1).tolist():
        if marked[q] and marked[own].all():
            continue
        bound = np.minimum(unions, cells[q]).sum(axis=1)
        spots = (starts[(100 + t) * bound >= t * (n[q] + least)][:, None] + np.arange(GROUP)).ravel()
        near = own[spots[spots < len(own)]]
        near = near[comp[near] != comp[q]]
        if len(near):
            near = near[(100 + t) * np.minimum(cells[near], cells[q]).sum(axis=1) >= t * (n[q] + n[near])]
            marked[near] = True
            marked[q] |= len(near) > 0
    return marked


def union_row(rows: list[bytes | None]) -> bytes | None:
    """The cells of the rows' union at most, as 16-bit numbers; null if a row is missing."""
    return None if any(r is None for r in rows) else np.minimum(_matrix(rows).max(axis=0), 65535).astype(np.uint16).tobytes()


def meeting_chunks(rows: list[bytes | None], least: np.ndarray, pure: list[int | None], t: int) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks meet (i <= j): not two of one component, and a link must fit into the overlap of their unions."""
    width = min((len(r) // 2 for r in rows if r), default=1)
    cells = np.full((len(rows), width), 1 << 24, np.int64)
    for i, r in enumerate(rows):
        if r:
            cells[i] = np.frombuffer(r, np.uint16).astype(np.int64).reshape(-1, width).sum(axis=0)
    whole = np.array([x is not None for x in pure])
    name = np.array([x or 0 for x in pure], np.int64)
    first, second = [], []
    for i in range(len(rows)):
        bound = np.minimum(cells[i:], cells[i]).sum(axis=1)
        may = ((100 + t) * bound >= t * (least[i:] + least[i])) & ~(whole[i] & whole[i:] & (name[i:] == name[i]))
        spots = np.flatnonzero(may) + i
        first.append(np.full(len(spots), i)), second.append(spots)
    return np.concatenate(first), np.concatenate(second)


def matrix_links(sets_a, ids_a, comp_a, sets_b, ids_b, comp_b, t: int) -> list[tuple[int, int]]:
    """Links between queries a and members b of other components, found through a token-group matrix of b."""
    if not len(sets_b):
        return []
    size = np.array([len(s) for s in sets_b])
    order = np.lexsort((np.array([s[0] for s in sets_b]), comp_b))  # similar sets often share their least hash
    sets_b, ids_b, comp_b, size = [sets_b[i] for i in order], ids_b[order], comp_b[order], size[order]
    tokens, back = np.unique(np.concatenate(sets_b), return_inverse=True)
    member = np.repeat(np.arange(len(sets_b)), size)
    by = np.argsort(back, kind="stable")
    posting, begin = member[by], np.searchsorted(back[by], np.arange(len(tokens) + 1))
    group = np.arange(len(sets_b)) // GROUP
    cell = np.unique(back * (int(group[-1]) + 1) + group[member])  # (token, group) with the token in the group's union
    cell_token, cell_group = np.divmod(cell, int(group[-1]) + 1)
    cell_begin = np.searchsorted(cell_token, np.arange(len(tokens) + 1))
    least = np.minimum.reduceat(size, np.arange(0, len(size), GROUP))
    groups = [np.arange(g, min(g + GROUP, len(size))) for g in range(0, len(size), GROUP)]
    found, root = [], {}

    def top(c):
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    for q, qid, qc in zip(sets_a, ids_a.tolist(), comp_a.tolist(), strict=True):
        at = np.minimum(np.searchsorted(tokens, q), len(tokens) - 1)
        at = at[tokens[at] == q]
        if not len(at):
            continue
        bound = np.bincount(np.concatenate([cell_group[cell_begin[i] : cell_begin[i + 1]] for i in at.tolist()]), minlength=len(groups))
        # a link needs both >= t / (100 + t) (m + n), where n is at least the group's smallest set
        may = (100 + t) * bound >= t * (len(q) + least)
        mine = top(qc)
        rows = [r for g in np.flatnonzero(may).tolist() for r in groups[g].tolist() if top(int(comp_b[r])) != mine]
        if not rows:
            continue
        both = np.bincount(np.concatenate([posting[begin[i] : begin[i + 1]] for i in at.tolist()]), minlength=len(size))
        rows = np.array(rows)
        for r in rows[linked(both[rows], len(q), size[rows], t)].tolist():
            if top(int(comp_b[r])) != top(qc):
                found.append((qid, int(ids_b[r])))
                root[top(int(comp_b[r]))] = top(qc)
    return found


def _dealt(placed: DataFrame, cells: DataFrame, t: int) -> DataFrame:
    """(token, lo, hi, kind, n, comp, role) from the members (token, kind, n, comp) of buckets: their chunks, wherever two meet (roles 0 and 1) or one
    is held against itself (role 2). Buckets of one component are left out."""
    placed = b.written(placed, "placed")
    held = placed.groupBy("token", "comp").agg(F.sum("n").alias("own"), F.count("*").alias("rows"))
    per = held.groupBy("token").agg(F.count("*").alias("comps"), F.sum("rows").alias("size"), F.sum(F.when(F.col("own") <= CHUNK // 2, F.col("own"))).alias("small")).where("comps > 1")
    per = b.written(per.select("token", "size", F.ceil(F.coalesce("small", F.lit(1)) / CHUNK).cast("int").alias("parts")), "open")
    large = b.written(held.where(F.col("own") > CHUNK // 2).select("token", "comp", F.ceil(F.col("own") / CHUNK).cast("int").alias("own_parts")), "large")
    part = F.when(F.col("own_parts").isNull(), F.pmod(F.xxhash64("comp"), "parts")).otherwise(F.xxhash64("comp", F.pmod(F.xxhash64("kind"), "own_parts")))
    pure = F.when(F.col("own_parts").isNotNull(), F.col("comp"))
    members = b.join_sized(placed, per, ["token"]).join(large, ["token", "comp"], "left")
    members = b.written(members.select("token", "kind", "n", "comp", part.alias("chunk"), pure.alias("pure")), "members")
    chunks = members.groupBy("token", "chunk").agg(F.first("pure").alias("pure"), F.min("n").alias("least"))
    several = b.written(chunks.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "several")

    def unite(table: pa.Table) -> pa.Table:
        row = union_row(table.column("cells").to_pylist())
        return pa.table({"token": table.column("token")[:1], "chunk": table.column("chunk")[:1], "row": pa.array([row], pa.binary()), "least": pa.array([min(table.column("n").to_pylist())], pa.int32()), "pure": table.column("pure")[:1]})

    def meet(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_numpy()
        x, y = meeting_chunks(table.column("row").to_pylist(), table.column("least").to_numpy().astype(np.int64), table.column("pure").to_pylist(), t)
        return pa.table({"token": pa.array(np.full(len(x), table.column("token")[0].as_py()), pa.int64()), "lo": chunk[x], "hi": chunk[y]})

    # a bucket of one chunk has that one meeting
    unions = members.join(several, "token").join(cells, "kind").select("token", "chunk", "pure", "n", "cells").groupBy("token", "chunk").applyInArrow(unite, "token long, chunk long, row binary, least int, pure long")
    meetings = b.written(unions.groupBy("token").applyInArrow(meet, "token long, lo long, hi long"), "meetings")
    side = lambda c, role: F.struct(F.col(c).alias("chunk"), F.lit(role).alias("role"))
    sides = F.when(F.col("lo") == F.col("hi"), F.array(side("lo", 2))).otherwise(F.array(side("lo", 0), side("hi", 1)))
    met = members.join(meetings.select("token", "lo", "hi", F.inline(sides)), ["token", "chunk"]).select("token", "lo", "hi", "kind", "n", "comp", "role")
    alone = members.join(several, "token", "left_anti").select("token", F.col("chunk").alias("lo"), F.col("chunk").alias("hi"), "kind", "n", "comp", F.lit(2).alias("role"))
    return alone.union(met)


def labelled_rows(docs: DataFrame, id_col: str, text_col: str, k: int, t: int) -> tuple[DataFrame, DataFrame]:
    """(_id, _fp, n) for every row of docs, and (_id, _fp, comp) for every row with words; a component is named by a class."""
    keyed = b.keyed(docs, id_col, text_col)
    tables = docs.sparkSession.sparkContext.broadcast(_frequencies(keyed, k))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot = tables.value
        for batch, texts in b.pieces(batches, "_text", rows=ROWS):
            doc, hashes, spot, h = occurrences(texts, k)
            # a shingle's place in the order: shared by many, common words, hash
            sums = np.concatenate([[0], np.cumsum(words[_slot(h)], dtype=np.int64)])
            common = np.where(spot >= 0, sums[np.maximum(spot, 0) + np.where(spot >= 0, k, 0)] - sums[np.maximum(spot, 0)], 0)
            late = hot[_slot(hashes)].astype(np.uint64)
            rank = (late << b.U(44)) | (np.minimum(common, 255).astype(np.uint64) << b.U(36)) | (hashes >> b.U(16))
            place = (doc << b.U(52)) | rank
            order = np.argsort(place)
            place = place[order]
            if ((place[1:] == place[:-1]) & (hashes[order][1:] != hashes[order][:-1])).any():  # equal shingles must stand together
                order = np.lexsort((hashes, rank, doc))
            doc, hashes = doc[order].astype(np.int64), hashes[order]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
            doc, hashes = doc[new], hashes[new]
            size = np.bincount(doc, minlength=len(texts))
            first = np.cumsum(size) - size
            total = np.zeros(len(size), np.uint64)
            if len(hashes):
                total[size > 0] = np.add.reduceat(b.mix(hashes ^ b.U(0x5DEECE66D)), first[size > 0])
            kind = b.mix(total + size.astype(np.uint64))
            inner = np.arange(len(doc)) - first[doc]
            need = np.where(size > 0, size - -(-t * size // 100) + 1, 0)
            prefix = hashes[inner < need[doc]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(need)]).astype(np.int32)), pa.array(prefix.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(kind.view(np.int64)), lists, cell_rows(doc, hashes, size)], ["_id", "_fp", "n", "kind", "prefix", "cells"])

    sketches = b.written(keyed.mapInArrow(sketch, "_id long, _fp long, n int, kind long, prefix array<long>, cells binary"), "sketches")
    light = sketches.where("n > 0").select("_id", "_fp", "n", "kind")
    # a bucket for each prefix shingle with two classes or more; buckets of the same members fold into one. Rows of a class
    # are in the same buckets, so sums over rows tell members apart however often rows repeat; halves do not overflow
    tokens = sketches.select("kind", F.explode("prefix").alias("token"))
    halves = lambda c: [F.sum(F.shiftright(c, 32)).alias("high"), F.sum(c.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")]
    buckets = tokens.groupBy("token").agg(F.min("kind").alias("least"), F.max("kind").alias("most"), *halves(F.col("kind")), F.count("*").alias("size")).where("least <> most")
    buckets = b.written(buckets.groupBy("least", "most", "high", "low", "size").agg(F.min("token").alias("token")).select("token", "size"), "buckets")
    # sizes of linked sets differ by t percent at most: a bucket falls into classes of that width, each with the next one
    found = b.join_sized(tokens, buckets, ["token"]).select("token", "kind").distinct().join(light.groupBy("kind").agg(F.min("n").alias("n")), "kind")
    width = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / t)) + 1e-9).cast("int")
    sized = b.written(found.select("kind", "n", F.explode(F.array(width, width - 1)).alias("width"), "token"), "sized")
    leader = lambda i: F.min_by(F.struct("kind", "n"), F.xxhash64("kind", F.lit(i)))
    by_size = sized.groupBy("token", "width").agg(F.min("kind").alias("least"), F.max("kind").alias("most"), *halves(F.xxhash64("kind")), F.count("*").alias("size"), F.array(*[leader(i) for i in range(LEADERS)]).alias("leaders")).where("least <> most")
    by_size = by_size.groupBy("least", "most", "high", "low", "size").agg(F.min_by(F.struct("token", "width", "leaders"), F.struct("token", "width")).alias("b"))
    by_size = b.written(by_size.select("b.token", "b.width", "b.leaders", "size"), "classes-of-size")
    met = b.join_sized(sized, by_size, ["token", "width"]).select(F.xxhash64("token", "width").alias("token"), "kind", "n", "leaders", "size")
    met = b.written(met, "met")
    cells = b.written(sketches.select("kind", "cells").join(met.select("kind").distinct(), "kind").dropDuplicates(["kind"]), "cells")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in b.pieces(batches, "_text"):
            packed = [_pack(b" ".join(b.SPACED.findall(x.lower()))) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["kind", "packed"])

    first = light.groupBy("kind").agg(F.min(F.struct("_id", "_fp")).alias("place"))

    def class_texts(kinds: DataFrame) -> DataFrame:
        wanted = first.join(kinds, "kind").select("kind", "place._id", "place._fp")  # a share of all rows, so no broadcast at any size
        return b.written(keyed.join(wanted, ["_id", "_fp"]).select("kind", "_text").mapInArrow(shrink, "kind long, packed binary").dropDuplicates(["kind"]), "class-texts")

    # stars
    lead = met.select("kind", "n", F.explode("leaders").alias("l")).select(F.col("l.kind").alias("x"), F.col("kind").alias("y"), F.col("l.n").alias("m"), "n").where("x <> y")
    pairs = lead.where(100 * F.least("n", "m") >= t * F.greatest("n", "m")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.when(F.col("x") < F.col("y"), F.col("m")).otherwise(F.col("n")).alias("m"), F.when(F.col("x") < F.col("y"), F.col("n")).otherwise(F.col("m")).alias("n")).distinct()
    pairs = pairs.join(cells.withColumnsRenamed({"kind": "x", "cells": "cx"}), "x").join(cells.withColumnsRenamed({"kind": "y", "cells": "cy"}), "y").select("x", "y", "cx", "cy", "m", "n")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_may_link(*row, t) for row in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    pairs = b.written(pairs.mapInArrow(bounded, "x long, y long"), "pairs")
    texts = class_texts(pairs.select(F.explode(F.array("x", "y")).alias("kind")).distinct())
    with_x = pairs.join(texts.select(F.col("kind").alias("x"), F.col("packed").alias("px")), "x")
    with_both = with_x.join(texts.select(F.col("kind").alias("y"), F.col("packed").alias("py")), "y").select("x", "y", "px", "py")
    stars = b.written(with_both.mapInArrow(_verify(k, t), "x long, y long, ok boolean").where("ok").select("x", "y"), "stars")

    # what the stars have not settled: first by cells in each bucket, then by texts in families of buckets that share members, so that a text is needed once
    comps = components(stars)
    placed = met.select("token", "kind", "n").join(comps.withColumnRenamed("node", "kind"), "kind", "left").select("token", "kind", "n", F.coalesce("comp", "kind").alias("comp"))

    def qualify(table: pa.Table) -> pa.Table:
        n, comp, role = (table.column(c).to_numpy() for c in ("n", "comp", "role"))
        keep = qualifying(table.column("cells").to_pylist(), n.astype(np.int64), comp, role, t)
        return table.select(["token", "lo", "hi", "kind", "n", "comp"]).filter(pa.array(keep))

    work = _dealt(placed, cells, t).join(cells, "kind")
    qualified = b.written(work.groupBy("token", "lo", "hi").applyInArrow(qualify, "token long, lo long, hi long, kind long, n int, comp long"), "qualified")
    least_kind = qualified.groupBy("token", "lo", "hi").agg(F.min("kind").alias("x"))
    family = components(qualified.join(least_kind, ["token", "lo", "hi"]).select("x", F.col("kind").alias("y"))).select(F.col("node").alias("kind"), F.col("comp").alias("token"))
    relatives = qualified.select("kind", "n", "comp").distinct().join(family, "kind").select("token", "kind", "n", "comp")
    texts = texts.union(class_texts(qualified.select("kind").distinct().join(texts.select("kind"), "kind", "left_anti")))
    work = _dealt(relatives, cells, t).join(texts, "kind").select("token", "lo", "hi", "kind", "comp", "role", "packed")

    def open_groups(table: pa.Table) -> pa.Table:
        ids, comp, role = (table.column(c).to_numpy() for c in ("kind", "comp", "role"))
        sets = _unpack(table.column("packed").to_pylist(), k)
        a, c = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        found = matrix_links([sets[i] for i in a], ids[a], comp[a], [sets[i] for i in c], ids[c], comp[c], t)
        return pa.table({"x": pa.array([x for x, _ in found], pa.int64()), "y": pa.array([y for _, y in found], pa.int64())})

    more = work.groupBy("token", "lo", "hi").applyInArrow(open_groups, "x long, y long")
    links = b.written(stars.union(more), "links")
    comps = components(links)
    labelled = light.join(comps, light.kind == comps.node, "left").select("_id", "_fp", F.coalesce("comp", "kind").alias("comp"))
    return sketches.select("_id", "_fp", "n"), labelled


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, t: int = 80) -> DataFrame:
    """id, n_shingles, component_id for every row of docs; documents link at a similarity of t percent or more."""
    rows, labelled = labelled_rows(docs, id_col, text_col, k, t)
    labelled = b.written(labelled, "labelled")
    least = b.written(labelled.groupBy("comp").agg(F.min("_id").alias("component"), F.count("*").alias("size")), "least-ids")
    per_row = b.join_sized(labelled, least, ["comp"]).groupBy("_id", "_fp").agg(F.min("component").alias("component"))
    out = rows.join(per_row, ["_id", "_fp"], "left")
    component = F.coalesce("component", "_id")
    return out.select(b.unkeyed().alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(component != b.NULL_ID, component).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, t: int = 80) -> DataFrame:
    """One row of docs for each component, the one of least id (null before all others), fingerprint and other columns; and all rows without words."""
    rows, labelled = labelled_rows(docs, id_col, text_col, k, t)
    copies = labelled.groupBy("comp", "_id", "_fp").agg(F.count("*").alias("copies"))
    first = copies.groupBy("comp").agg(F.min(F.struct("_id", "_fp", "copies")).alias("first")).select("first.*")
    without = rows.where("n = 0").select("_id", "_fp").distinct().withColumn("copies", F.lit(1).cast("long"))
    first = b.written(first.union(without), "first-rows")
    held = docs.select(F.struct("*").alias("row"), *b.row_key(id_col, text_col))
    alone = held.join(first.where("copies = 1"), ["_id", "_fp"]).select("row.*")
    # rows that repeat id and text: one of them, so only their texts move
    number = F.row_number().over(Window.partitionBy("_id", "_fp").orderBy(*[F.col(f"row.`{c}`") for c in docs.columns]))
    repeated = held.join(first.where("copies > 1"), ["_id", "_fp"]).withColumn("number", number).where("number = 1").select("row.*")
    return alone.union(repeated)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(b.read(spark, sf_dir, "documents"), k=4, t=85)
