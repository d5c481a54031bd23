"""Each corpus operator against a plain version, on nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from siltbed.llm import base, decontaminate, jaccard_join, language_id, license_scan, line_dedup, packing, quality, spans, substring_dedup, suffix_dedup, warc

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, _spans int"
rng = np.random.default_rng(3)
WORDS = [f"w{i}é" if i % 9 == 0 else f"word{i}" for i in range(300)]


def prose(n):
    return "".join(WORDS[i] + ("\n" if j % 12 == 11 else " ") for j, i in enumerate(rng.integers(0, 300, n)))


PASSAGE = prose(60)
LONG = prose(9000)
TEXTS = [None, "", "   \n\t", "one", "12 34 !!", PASSAGE, PASSAGE, prose(80) + PASSAGE + prose(30), PASSAGE + prose(40), LONG, prose(3) * 200, "Released under the MIT License. " + prose(60), "x" * 900]
TEXTS += [PASSAGE.replace("word", "Word", 1), PASSAGE + "tail"]
ROWS = [(i, t, "en" if i % 2 else None, "s", 0, "clash", 1) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("least", [8, 10**9])
def test_hot_windows(spark, monkeypatch, least):
    """A passage in many surroundings, copies, repeated rows, nulls: both operators against plain versions, by blocks and by hashes."""
    monkeypatch.setattr(spans, "LEAST_HOT", least)
    own = np.random.default_rng(21)
    text = lambda n: " ".join(own.choice(WORDS, n))
    passage = text(45)
    texts = [f"{text(30)} {passage} {text(12)}" for _ in range(60)] + [passage] * 30 + [None, "", text(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, passage), (5, passage)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    order = sorted(set(rows), key=lambda r: (-1 if r[0] is None else r[0]))
    first = {}
    for i, t in order:
        w = (t or "").split()
        for j in range(len(w) - 19):
            first.setdefault(tuple(w[j : j + 20]), []).append((i, t, j))
    hot, _ = spans.hot_minimisers(base.keyed(table, "doc_id", "text"), spans.Cut(20, 4, words=True, earliest=True))
    assert (hot is not None) == (least == 8)
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.substring_dedup(table).collect()}
    for i, t in order:
        if [x for x, _ in order].count(i) > 1:
            continue  # which of two texts of an id is earlier is a matter of fingerprints
        w, gone = (t or "").split(), set()
        for j in range(len(w) - 19):
            if first[tuple(w[j : j + 20])][0] != (i, t, j):
                gone |= set(range(j, j + 20))
        assert got[i, len(w)] == len(gone), i
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(r[j : j + 200] for r in raw for j in range(len(r) - 199))
    found = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.suffix_dedup(table).collect()}
    for (i, _), r in zip(rows, raw, strict=True):
        gone = bytearray(len(r))
        for j in range(len(r) - 199):
            if count[r[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        assert found[i, len(r)] == sum(gone), i


def test_substring(docs, empty):
    seen, want = {}, {}
    for i, t in enumerate(TEXTS):
        w = SPACED.findall((t or "").encode())
        gone = bytearray(len(w))
        for j in range(len(w) - 19):
            if seen.setdefault(tuple(w[j : j + 20]), (i, j)) != (i, j):
                gone[j : j + 20] = b"\1" * 20
        want[i] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
    got = by_id(substring_dedup.substring_dedup(docs))
    assert {i: r["kept"] for i, r in got.items()} == want
    assert substring_dedup.substring_dedup(empty).count() == 0
    again = substring_dedup.substring_dedup(docs.where("doc_id = 9").union(docs.where("doc_id = 9"))).collect()
    assert [r["n_removed"] for r in again] == [0, 0]


def test_suffix(docs, empty):
    raw = [(t or "").encode() for t in TEXTS]
    count = Counter(r[j : j + 200] for r in raw for j in range(len(r) - 199))
    got = by_id(suffix_dedup.suffix_dedup(docs))
    for i, r in enumerate(raw):
        gone = bytearray(len(r))
        for j in range(len(r) - 199):
            if count[r[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        assert bytes(got[i]["kept"]) == bytes(x for x, g in zip(r, gone, strict=True) if not g), i
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_two_stage():
    for text in (b"", b"a", b"banana", b"aaaaaaaa", b"mississippi" * 3, bytes(rng.integers(97, 100, 400, dtype=np.uint8))):
        assert suffix_dedup.two_stage(text, 500).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([(7, PASSAGE), (8, "one"), (9, None), (10, ""), (7, PASSAGE)], "item_id long, text string")
    got = by_id(decontaminate.decontaminate(docs, items))
    wins = {tuple(w[j : j + 10]) for w in [ALNUM.findall(PASSAGE.encode().lower())] for j in range(len(w) - 9)} | {(b"one",)}
    for i, t in enumerate(TEXTS):
        w = ALNUM.findall((t or "").encode().lower())
        hit = bytearray(len(w))
        for n in (1, 10):
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wins:
                    hit[j : j + n] = b"\1" * n
        assert got[i]["n_hit"] == sum(hit), i
    assert got[5]["clean"] is None and "7" in got[5]["items"] and got[9]["clean"] == LONG
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).where("n_hit > 0").count() == 0


def plain_hits(texts, items):
    """doc -> (n_words, n_hit, item ids) of texts and (id, text) items."""
    windows = {}
    for name, t in items:
        w = ALNUM.findall((t or "").encode().lower())
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add("" if name is None else str(name))
    lengths, out = {len(w) for w in windows}, []
    for t in texts:
        w = ALNUM.findall((t or "").encode().lower())
        hit, found = bytearray(len(w)), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit[j : j + n] = b"\1" * n
                    found |= windows[tuple(w[j : j + n])]
        out.append((len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("words", [40, 150_000])
def test_decontaminate_whatever_the_groups(spark, monkeypatch, words):
    """Items longer than a part, items that share passages, repeats, nulls; many small automata or one; repeated and clashing rows."""
    monkeypatch.setattr(decontaminate, "GROUP_WORDS", words)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 30)
    own = np.random.default_rng(8)
    text = lambda n: " ".join(own.choice(WORDS, n))
    long = text(200)
    items = [(1, long), (2, long[50:400]), (3, "three short words"), (4, None), (5, ""), (None, text(25)), (7, text(10)), (7, text(12)), (8, text(9))]
    docs = [None, "", "!", text(40), f"{text(20)} {long[100:600]} {text(20)}", f"three short words, {text(30)} Three-short WORDS", *[f"{text(60)} {t} {text(60)}" for _, t in items if t], long + " " + long]
    docs += docs[4:6]
    bench = spark.createDataFrame(items, "item_id int, text string")
    table = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(docs)], "doc_id long, text string, clean string, _siltbed_id long")
    got = by_id(decontaminate.decontaminate(table, bench, carry=["doc_id", "text", "clean", "_siltbed_id"]))
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) for i in range(len(docs))] == plain_hits(docs, items)
    assert got[3]["clean"] == docs[3] and got[len(docs) - 3]["clean"] is None


def near(a, c):
    if abs(len(a) - len(c)) > 1:
        return False
    if len(a) == len(c):
        return sum(x != y for x, y in zip(a, c, strict=True)) <= 1
    s, l = sorted((a, c), key=len)
    return any(l[:i] + l[i + 1 :] == s for i in range(len(l)))


def test_lines(spark, docs, empty):
    lines = [(i, p, tuple(x.lower().split(" "))) for i, t in enumerate(TEXTS) if t for p, x in enumerate(t.split("\n"))]
    lines = [(i, p, tuple(w for w in x if w)) for i, p, x in lines]
    lines = [x for x in lines if len(x[2]) >= 5]
    gone = Counter(x[0] for k, x in enumerate(lines) if any(near(x[2], y[2]) for y in lines[:k]))
    got = by_id(line_dedup.line_dedup(docs))
    assert {i: r["n_removed"] for i, r in got.items()} == {i: gone.get(i, 0) for i in range(len(TEXTS))}
    assert got[0]["text"] is None and got[1]["text"] == ""
    assert line_dedup.line_dedup(empty).count() == 0


def test_short_lines(spark):
    texts = ["Yes\nno\n\none two three four\nyes", "YES \n  one two  three four\none two three\n\n\u4e2d\u6587\n\u4e2d\u6587", "no"]
    got = by_id(line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i]["text"] for i in range(3)] == ["Yes\nno\n\none two three four", "one two three\n\n\u4e2d\u6587", ""]
    assert [got[i]["n_removed"] for i in range(3)] == [1, 3, 1]


def test_jaccard(docs, empty):
    sets = []
    for t in TEXTS:
        w = SPACED.findall((t or "").encode().lower())
        sets.append({tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    comp = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    got = by_id(jaccard_join.jaccard_join(docs, k=4, t=85))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), comp[i]) for i, s in enumerate(sets)}
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_matrix():
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)]
    ids = np.arange(60)
    found = jaccard_join.matrix_links(sets, ids, ids, sets, ids, ids, 60)
    top = list(range(60))
    for a, c in found:
        top = [top[a] if x == top[c] else x for x in top]
    want = list(range(60))
    for a in range(60):
        for c in range(a):
            both = len(np.intersect1d(sets[a], sets[c]))
            if 100 * both >= 60 * (len(sets[a]) + len(sets[c]) - both):
                want = [want[a] if x == want[c] else x for x in want]
    same = lambda v: [[x == y for y in v] for x in v]
    assert same(top) == same(want)


def test_matrix_of_two_chunks():
    """Members of both chunks have shingles of their own; chunk b shares a pool of edits, queries have other edits; no two link."""
    own = np.random.default_rng(17)
    core, pool, other = (own.choice(2**52, n, replace=False).astype(np.uint64) for n in (300, 400, 400))
    members = [np.unique(np.concatenate([core, own.choice(pool, 60, replace=False)])) for _ in range(200)]
    queries = [np.unique(np.concatenate([core, own.choice(other, 60, replace=False)])) for _ in range(30)]
    a, c = np.arange(30), np.arange(1000, 1200)
    assert not any(jaccard_join.linked(len(np.intersect1d(x, y)), len(x), len(y), 85) for x in queries for y in members)
    assert jaccard_join.matrix_links(queries, a, a, members, c, c, 85) == []
    found = jaccard_join.matrix_links([members[0][:-1], *queries], np.arange(31), np.arange(31), members, c, c, 85)
    assert found == [(0, 1000)]


def test_licenses(docs, empty):
    got = by_id(license_scan.license_scan(docs))
    assert got[11]["labels"] == "mit" and got[11]["n_base"] == 1 and got[11]["first_word"] == 3
    assert got[0]["n_words"] == 0 and got[0]["labels"] == "" and got[9]["score"] == 0
    assert license_scan.license_scan(empty).count() == 0


def test_quality(docs, empty):
    got = by_id(quality.quality(docs))
    assert got[0]["base_failed"] and got[0]["n_words"] == 0 and not got[0]["kept"]
    assert got[10]["base_failed"] and got[10]["n_repeat_words"] == 600
    assert got[9]["n_words"] == 9000 and not got[9]["base_failed"]
    assert quality.quality(empty).count() == 0


def test_quality_bands_on_labels(spark):
    found = quality.quality(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("not base_failed")
    judged = found.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    bad, good = ([r["kept"] for r in judged.where(f"quality = {q}").collect()] for q in (0, 1))
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.985 * len(good)


def plain_characters(text):
    folded = ["0" if c in "0123456789" else " " if ord(c) <= 32 else c for c in text.lower()]
    return folded


def plain_kneser_ney(texts):
    """gram (text) -> probability of its last character, for any gram of four characters: interpolated modified Kneser-Ney over dicts."""
    counts = {4: Counter()}
    for t in texts:
        c = [" "] * 3 + plain_characters(t)
        counts[4].update("".join(c[i : i + 4]) for i in range(len(c) - 3))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, after = {}, {}
    for k, c in counts.items():
        n = [0] + [max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2])
        cut[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i - 0.05) for i in (1, 2, 3)]
        after[k] = {}
        for g, v in c.items():
            total, left = after[k].get(g[:-1], (0, 0))
            after[k][g[:-1]] = total + v, left + cut[k][min(v, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        total, left = after[k].get(g[:-1], (0, 0))
        lower = p(g[1:])
        if not total:
            return lower
        v = counts[k].get(g, 0)
        return (v - cut[k][min(v, 3)]) / total + left / total * lower if v else left / total * lower

    return p


def plain_quality(rows):
    """doc_id -> (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bits) of (doc_id, text, lang)."""
    of = {}
    for _, t, lang in rows:
        of.setdefault(lang or "", []).append(t or "")
    models = {lang: plain_kneser_ney(texts) for lang, texts in of.items()}
    out = {}
    for i, t, lang in rows:
        t = t or ""
        words = [w.decode() for w in SPACED.findall(t.encode())]
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACED.search(line.encode()):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2))
        hit = {j + x for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for x in range(3)}
        c = [" "] * 3 + plain_characters(t)
        letters = sum("a" <= x <= "z" or ord(x) >= 128 for x in c[3:])
        bits = sum(-np.log2(models[lang or ""]("".join(c[j : j + 4]))) for j in range(len(c) - 3)) / max(1, letters)
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        out[i] = (len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in t), dup, len(hit), failed), bits
    return out


def test_quality_against_plain_version(spark):
    """Several languages, one of Cyrillic letters, nulls, repeated rows, clashing columns; bands from the plain version's bits."""
    own = np.random.default_rng(5)
    cyrillic = ["".join(own.choice(list("абвгдежзийклмнопрстуфхцчшщьыэюя"), 6)) for _ in range(40)]
    rows = [(i, " ".join(own.choice(cyrillic if i % 3 == 0 else WORDS, 70)) + (" ## 12\n12 ##" if i % 5 == 0 else ""), ["ru", "en", None][i % 3]) for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "x", "de"), (103, "".join(own.choice(list("абвгдежзийклмнопрст "), 500)), "ru"), (104, "𝔘𝔫 " * 60, "en")]
    docs = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, lang string, bits double, kept boolean")
    want = plain_quality(rows)
    found = quality.quality(docs).collect()
    assert len(found) == len(rows)
    by_lang = {}
    for r in found:
        base, bits = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base, r
        if rows[[x[0] for x in rows].index(r["doc_id"])][1]:
            assert abs(r["bits"] - bits) < 1e-3, r
            if not base[-1]:
                by_lang.setdefault(dict((x[0], x[2]) for x in rows)[r["doc_id"]], []).append((r["doc_id"], bits, r["kept"]))
    for members in by_lang.values():
        bins = sorted(int(np.floor(x / quality.BIN)) for _, x, _ in members)
        mid = bins[-(-len(bins) // 2) - 1]
        mad = max(2, sorted(abs(x - mid) for x in bins)[-(-len(bins) // 2) - 1])
        for i, x, kept in members:
            z = (x / quality.BIN - mid - 0.5) / mad
            assert kept == (-8 <= z <= 8) or abs(abs(z) - 8) < 0.6, i
    assert not next(r for r in found if r["doc_id"] == 103)["kept"]
    twice = quality.quality(docs.union(docs)).groupBy("doc_id").count().collect()
    assert {r["count"] for r in twice} == {2}


def test_quality_of_many_languages(spark, monkeypatch):
    monkeypatch.setattr(quality, "FILE_BYTES", 40_000)
    rows = [(i, " ".join(f"{chr(97 + i % 100 // 4)}{w}" for w in rng.choice(WORDS, 60)), f"lang{i % 100}") for i in range(300)]
    found = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == 300 and all(r["bits"] > 0 and r["low"] < r["high"] for r in found)


def test_quality_counts_rare_grams(spark, monkeypatch):
    """Grams found once among more than 2^20 characters are in the model, whose files are several, as they are in the plain version."""
    monkeypatch.setattr(quality, "FILE_BYTES", 20_000)
    own = np.random.default_rng(11)
    odd = " ".join("".join(own.choice(list("abcdefghijklmnopqrstuvwxyzжщы中文"), 7)) for _ in range(80))
    rows = [(i, PASSAGE + prose(9000), "en") for i in range(24)] + [(100, odd, "en"), (101, odd[:300], "fr")]
    assert sum(len(r[1]) for r in rows if r[2] == "en") > 2**20
    found = {r["doc_id"]: r["bits"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i in (0, 100, 101):
        text, lang = next((t, x) for d, t, x in rows if d == i)
        p = plain_kneser_ney([t for _, t, x in rows if x == lang])
        c = [" "] * 3 + plain_characters(text)
        bits = sum(-np.log2(p("".join(c[j : j + 4]))) for j in range(len(text)))
        assert abs(found[i] - bits / sum("a" <= x <= "z" or ord(x) >= 128 for x in c)) < 1e-3, i


def test_model_has_every_gram(spark):
    """The number of grams of the model is that of the counted ones, at counts far above 2^20 and of one alike."""
    counts = spark.createDataFrame([("en", (97 << 48) + (98 << 32) + (i % 30 << 16) + i, 1 if i else 5_000_000) for i in range(300)], "lang string, gram long, n long")
    model = quality.kneser_ney(counts)
    assert model.where("bits > 0").select("gram").distinct().count() == 300


def test_model_is_a_distribution():
    texts = ["the cat sat on the mat", "a cat on a mat", "tom"]
    p = plain_kneser_ney(texts)
    symbols = sorted({c for t in texts for c in t} | {" "})
    for context in ("the", " ca", "xyz"):
        assert abs(sum(p(context + c) for c in symbols) - len(symbols) / (len(symbols) + 1)) < 0.2


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(docs).collect()
    for i, t in enumerate(TEXTS):
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(bytes(p["ids"]) for p in own) == ids
    for s in {p["sequence_id"] for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p["sequence_id"] == s), key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    assert packing.pack(empty).count() == 0


def test_best_fit():
    sizes = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 101, 3000), return_counts=True), strict=True)}
    plan = packing.best_fit_plan(sizes, 100)
    used = {}
    for length, _, n, first, offset in plan:
        for s in range(first, first + n):
            used.setdefault(s, []).append((offset, length))
    assert sum(n for _, _, n, _, _ in plan) == sum(sizes.values())
    for parts in used.values():
        assert all(x + n == y for (x, n), (y, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and sum(n for _, n in parts) <= 100
    assert len(used) <= 1.03 * sum(k * n for k, n in sizes.items()) / 100 + 1


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/ b", "x" * 5000), (1, None, "x" * 5000), (2, "u", None), (4, "u", ""), (5, "v", "né"), (None, "w", "né"), (5, "v", "né")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = warc.write_warc(pages, f"file://{tmp_path}/w", chunk=1000)
    chunks = warc.read_warc(spark, paths, chunk=700).collect()
    for i, _, html in rows:
        raw = (html or "").encode()
        own = sorted((c for c in chunks if c["record_id"] == (base.NULL_ID if i is None else i)), key=lambda c: c["chunk_no"])
        assert own[-1]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode() and own[-1]["payload_bytes"] == len(raw)
        if own[0]["record_type"] == "response":
            assert b"".join(bytes(c["data"]) for c in own) == raw
    refers = {c["record_id"]: c["refers_to"] for c in chunks}
    assert refers[3] == 1 and refers[4] == 2 and refers[5] == base.NULL_ID and refers[1] is None
    assert warc.write_warc(pages.limit(0), f"file://{tmp_path}/e") == []


def test_net_against_plain_convolution():
    """Every window, filter width and filter by loops; then one training step moves the loss down."""
    own = np.random.default_rng(2)
    net = language_id.ByteNet(["a", "b", "c"])
    x = own.integers(0, 256, (5, language_id.WINDOW), dtype=np.uint8)
    want = []
    for row in x:
        act = []
        for w in language_id.WIDTHS:
            t = net.p[f"t{w}"]
            act += [max(sum(float(t[j, row[i + j], f]) for j in range(w)) for i in range(language_id.WINDOW - w + 1)) for f in range(language_id.FILTERS)]
        z = np.maximum(np.array(act) + net.p["b"], 0) @ net.p["w"] + net.p["c"]
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert np.allclose(net.predict(x, net.tables()), want, atol=1e-5)
    y = np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(net.predict(x, net.tables())[np.arange(5), y]).sum()
    before = loss()
    net.train(x, y, 3)
    assert loss() < before


def test_rare_language_is_learned(spark):
    """One row in a thousand has a label of its own; repeated rows, nulls and clashing columns; the same sample however rows are dealt."""
    own = np.random.default_rng(9)
    vocabulary = {"en": ["the", "and", "thing", "with"], "xx": ["zqo", "qyz", "oozy", "yqq"]}
    rows = [(i, " ".join(own.choice(vocabulary["xx" if i % 100 == 0 else "en"], 50)), "xx" if i % 100 == 0 else "en", "r", 7.0) for i in range(2000)]
    rows += [(None, None, "en", "r", 1.0), (None, "the", None, "r", 1.0)] + rows[:50]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    args = ("text", "lang", "doc_id", 100, 20, 3)
    one, two = (sorted((r["label"], r["place"]) for r in language_id.sample(d, *args).collect()) for d in (docs, docs.repartition(7)))
    assert one == two and Counter(x for x, _ in one)["en"] == 50 and Counter(x for x, _ in one)["xx"] >= 20
    out = language_id.predict(docs, language_id.fit(docs, most=100)).collect()
    assert len(out) == len(rows)
    judged = [r for r in out if r["lang"] and r["text"]]
    assert sum(r["lang"] == r["lang_pred"] for r in judged) >= 0.99 * len(judged)


def test_language(spark, docs, empty):
    rows = [(i, " ".join(rng.choice(["the", "and", "thing", "with"] if i % 2 else ["der", "und", "schön", "nicht"], 60)), "en" if i % 2 else "de") for i in range(300)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(labelled.where(~language_id.held_out()))
    out = language_id.predict(labelled, net).where(language_id.held_out()).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    got = by_id(language_id.predict(docs, net))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 4)) and 0 <= got[9]["score"] <= 1
    assert language_id.fit(empty) is None and {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}


def test_qualifying():
    sets = [np.unique(rng.integers(0, 2**52, 200).astype(np.uint64)) for _ in range(6)]
    sets += [np.concatenate([s[: int(len(s) * f)], np.unique(rng.integers(0, 2**52, 12).astype(np.uint64))]) for s in sets for f in (1, 0.95, 0.5)]
    sets = [np.unique(s) for s in sets]
    n = np.array([len(s) for s in sets])
    rows = jaccard_join.cell_rows(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), n).to_pylist()
    rows[3] = None  # a missing row bounds nothing
    kept = jaccard_join.qualifying(rows, n, np.arange(len(sets)), np.full(len(sets), 2), 80)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if i != j and jaccard_join.linked(len(np.intersect1d(x, y)), len(x), len(y), 80):
                assert kept[i] and kept[j] and jaccard_join._may_link(rows[i], rows[j], n[i], n[j], 80)


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_jaccard_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    base_words = prose(90).split()
    texts = []
    for i in range(24):  # a chain of near copies: each changes two more words
        words = list(base_words)
        for j in range(i):
            words[(7 * j) % 90] = f"new{j}"
        texts.append(" ".join(words))
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in (t.split() for t in texts)]
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    got = by_id(jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=4, t=85))
    assert [got[i]["component_id"] for i in range(len(texts))] == comp


def test_jaccard_of_a_table_twice(spark):
    """Families whose links need buckets of equal ends and size apart; each member: words put before, part of the family's words, words put behind."""
    families = [
        [(2, 0, 31, 0), (0, 1, 31, 0), (0, 0, 31, 1), (0, 0, 31, 1), (0, 0, 29, 0), (0, 0, 31, 1)],
        [(1, 0, 25, 0), (1, 0, 25, 0), (0, 1, 25, 1), (1, 0, 25, 1), (0, 0, 25, 0), (0, 0, 24, 0)],
        [(0, 0, 24, 1), (2, 0, 24, 0), (0, 0, 24, 1), (0, 0, 24, 0), (0, 0, 24, 1), (0, 2, 24, 0)],
        [(1, 0, 18, 1), (1, 0, 17, 0), (0, 0, 18, 1), (0, 0, 18, 0), (0, 0, 18, 0), (0, 0, 18, 0)],
    ] * 10
    words = lambda f, m, before, x, y, after: [f"b{f}x{m}x{i}" for i in range(before)] + [f"f{f}w{j}" for j in range(x, y)] + [f"a{f}x{m}x{i}" for i in range(after)]
    rows = [(6 * f + m, " ".join(words(f, m, *parts))) for f, family in enumerate(families) for m, parts in enumerate(family)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(once, k=4, t=85).collect()}
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_join(once.union(once), k=4, t=85).collect()}
    assert set(want.values()) == set(range(0, len(rows), 6)) and got == set(want.items())


def test_word_tokens():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    one = packing._tokenizer(path)
    parts = [*"abzAZ éÉßÿÀ×÷µªºİıſKΣσς́ '\n\t\r\x0b\x0c  .,!?<|>09²½#%-_`~^\x1c\x85中ａ", "<|endoftext|>", "'s", "'ll", "ﬁ", "ẞ"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in rng.integers(0, 40, 2000)]
    for t, ids in zip(texts, packing.WordTokens(path)([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == one.encode(t, add_special_tokens=False).ids


def test_pipeline_keeps_one_row_of_each_component(spark):
    import corpus_pipeline

    near, other, third = " ".join(WORDS[:80]), " ".join(WORDS[100:180]), " ".join(WORDS[200:280])
    texts = [(3, near), (3, near), (3, near + " tail"), (5, near), (5, other), (4, other), (None, third), (None, third), (None, third + " tail"), (9, third), (11, PASSAGE)]
    rows = [(i, t, "en", f"s{j}", len(t)) for j, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=lambda r: r[0] or 0)[2:] == [(4, other), (11, PASSAGE)] and len(kept) == 4
    assert sorted(str(i) for i, _ in kept) == ["11", "3", "4", "None"]
    assert dict(kept)[3].startswith(near) and dict(kept)[None].startswith(third)
