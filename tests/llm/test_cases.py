"""Licence scans, WARC and packing against plain versions; clashing columns and repeated rows for every operator."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from siltbed.llm import catalog, decontaminate, jaccard_join, language_id, license_scan, line_dedup, packing, quality, substring_dedup, suffix_dedup, warc

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
own = np.random.default_rng(41)
WORDS = [f"w{i}" for i in range(200)] + ["the", "license", "mit", "public"]


def text(n):
    return " ".join(own.choice(WORDS, n))


def plain_scan(raw, k=3, near=3, least=0.9):
    """(n_words, n_base, first, last, base labels, labels, score) of one text, by loops."""
    words = [w.decode() for w in ALNUM.findall((raw or "").encode().lower())]
    at = {}
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        hit = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        if hit:
            at[label] = hit
    spans = []
    for label, template in license_scan.TEMPLATES:
        t = [w.decode() for w in ALNUM.findall(template.encode().lower())]
        on = {}
        for i in range(len(words) - k + 1):
            for j in range(len(t) - k + 1):
                if words[i : i + k] == t[j : j + k]:
                    on.setdefault(i - j, []).append(i)
        island = []
        for d in [*sorted(on), None]:
            if island and (d is None or d - island[-1] > near):
                lo, hi = min(min(on[x]) for x in island), max(max(on[x]) for x in island)
                part = words[max(0, lo - len(t)) : hi + k + len(t)]
                best = 0
                for x in range(0, max(1, len(part)), 2 * len(t)):
                    window = part[x : x + 4 * len(t)]
                    table = np.zeros((len(window) + 1, len(t) + 1), int)
                    for u, w in enumerate(window):
                        for v, y in enumerate(t):
                            table[u + 1, v + 1] = table[u, v] + 1 if w == y else max(table[u, v + 1], table[u + 1, v])
                    best = max(best, table[-1, -1])
                if best / len(t) >= least:
                    spans.append((label, best / len(t)))
                island = []
            island.append(d)
    starts = [x for hit in at.values() for x in hit]
    labels = sorted({*at, *(s for s, _ in spans)})
    score = 1.0 if at else max((s for _, s in spans), default=0.0)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(at)), ",".join(labels), score


def test_licenses_against_plain_version(spark):
    notices = [t for _, t in license_scan.TEMPLATES]
    texts = [None, "", "mit", "MIT License", text(50), *[f"{text(20)} {t} {text(20)}" for t in notices]]
    for t in notices:  # a word changed, left out, put in; the notice twice; broken over lines
        w = t.split()
        i = int(own.integers(1, len(w) - 1))
        texts += [" ".join([*w[:i], "changed", *w[i + 1 :]]), " ".join([*w[:i], *w[i + 1 :]]), " ".join([*w[:i], "added", *w[i:]]), f"{t} {text(3)} {t.upper()}", t.replace(" ", "\n")]
    texts += ["apache license, APACHE-LICENSE. mit license; general public license " + text(10), text(3000) + notices[4] + text(3000)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows + rows[5:9] + [(None, notices[0], "x", 2)], "doc_id long, text string, spans string, n_base int")
    found = license_scan.license_scan(table).collect()
    assert len(found) == len(rows) + 5
    for r in found:
        want = plain_scan(notices[0] if r["doc_id"] is None else texts[r["doc_id"]])
        got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"])
        assert got[:-1] == want[:-1] and abs(got[-1] - want[-1]) < 1e-9, (r["doc_id"], got, want)


def plain_best_fit(lengths, size):
    """Numbers of sequences of best-fit decreasing, by a plain list of remaining capacities."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(size - n)
    return len(room)


def test_plan_is_as_tight_as_best_fit():
    for seed in range(5):
        lengths = np.random.default_rng(seed).integers(1, 101, 400).tolist()
        plan = packing.best_fit_plan(dict(Counter(lengths)), 100)
        assert len({s for _, _, n, first, _ in plan for s in range(first, first + n)}) <= plain_best_fit(lengths, 100) + 1


def test_other_tokenizers(spark):
    """A tokenizer of another kind encodes whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.by_words(path) and packing.by_words(public_tokenizers.path("word_bpe_49k.json"))
    texts = [None, "", "Two  words", "é\n\t中文 " * 5]
    whole = Tokenizer.from_file(path)
    got = {p["doc_id"]: np.frombuffer(p["ids"], "<u4").tolist() for p in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer=path, end_id=50256).collect()}
    assert got == {i: [*whole.encode(t or "", add_special_tokens=False).ids, 50256] for i, t in enumerate(texts)}


def test_warc_of_clashing_rows(spark, tmp_path):
    """Extra columns with the names used inside; a third of all pages equal; ties, repeats, nulls, a payload of many chunks; `least` spares small ones."""
    pages = [(i, "u", "same page " * 3 if i % 3 == 0 else f"page {i} " * (i % 50), "x", 1, b"y") for i in range(60)] + [(7, "u", "ü" * 5000, "x", 1, b"y"), (None, None, None, "x", 1, b"y"), (3, "u", "same page " * 3, "x", 1, b"y"), (90, "u", "", "x", 1, b"y")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, sha string, row int, data binary").repartition(5)
    for least in (0, 100):
        paths = warc.write_warc(table, f"file://{tmp_path}/w{least}", least=least, chunk=512)
        chunks = warc.read_warc(spark, paths, chunk=700).collect()
        first = {}
        for i, _, html, *_ in pages:
            raw = (html or "").encode()
            key = -(2**63) if i is None else i
            first[raw] = min(first.get(raw, key), key)
        got = Counter((c["record_id"], c["payload_bytes"], c["payload_digest"], c["record_type"], c["refers_to"]) for c in chunks if c["is_last"])
        want = Counter()
        for i, _, html, *_ in pages:
            raw, key = (html or "").encode(), -(2**63) if i is None else i
            again = len(raw) >= least and first[raw] != key
            want[key, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[raw] if again else None] += 1
        assert got == want


CLASH = "doc_id long, text string, lang string, _id string, _fp string, _text string, gone string, n_words string, n_removed string, clean string, kept string, spans string, score string, length int, token string, kind int, comp int"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en", *["x"] * 10, 1, "x", 1, 1) for i, t in enumerate([None, "", text(60), text(60), "a b\nc d"])]
    rows += [rows[2], (None, text(30), None, *["x"] * 10, 1, "x", 1, 1), (9, rows[3][1], "en", *["x"] * 10, 1, "x", 1, 1)]
    return spark.createDataFrame(rows, CLASH)


OPERATORS = {
    "substring": substring_dedup.substring_dedup, "suffix": suffix_dedup.suffix_dedup, "lines": line_dedup.line_dedup, "jaccard": jaccard_join.jaccard_join, "licenses": license_scan.license_scan, "quality": quality.quality,
    "language": lambda d: language_id.predict(d, language_id.fit(d)), "decontaminate": lambda d: decontaminate.decontaminate(d, d.select(d.doc_id.alias("item_id"), "text").where("doc_id = 3"), carry=d.columns),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns_and_repeated_rows(clashing, name):
    """One row for each row; rows that repeat have the same result; names are not doubled; an empty table gives none."""
    out = OPERATORS[name](clashing)
    assert len(set(out.columns)) == len(out.columns)
    got = out.collect()
    assert len(got) == 8
    twice = [r for r in got if r["doc_id"] == 2]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert OPERATORS[name](clashing.limit(0)).count() == 0


def test_packing_of_clashing_rows(clashing):
    assert sum(p["start"] == 0 for p in packing.pack(clashing).collect()) == 8


def test_catalog():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.queries()) == list(range(1, 11))
