"""Each stage of the pipeline against a plain version: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from siltbed.llm import language_id  # noqa: E402

own = np.random.default_rng(31)
WORDS = [f"{a}{b}" for a in ("the", "and", "wort", "schon", "casa", "peu") for b in ("r", "s", "tion", "ung", "ado", "ment", "é", "ß")]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, _id string, gone int, score double, clean string"


def prose(n, per=11):
    return "".join(w + ("\n" if i % per == per - 1 else " ") for i, w in enumerate(own.choice(WORDS, n)))


NOTICE = "This very line of eight words stands everywhere\n"
A, B, C = prose(90), prose(80), prose(70)
QUESTION = " ".join(own.choice(WORDS, 14))
TEXTS = [
    (1, A), (2, A), (3, A + "tail"), (4, NOTICE + B), (5, C + NOTICE), (6, NOTICE), (7, prose(60) + QUESTION + " " + prose(60)), (8, QUESTION), (9, None), (10, ""), (11, " \n\t"), (12, "12 !!"),
    (13, prose(6000)), (14, "yes\nyes\n" + prose(40)), (None, prose(50)), (None, prose(55)), (16, B), (16, C), (1, A), (17, NOTICE.replace("eight", "nine") + prose(30)),
]
ROWS = [(i, t, "en", f"s{j}", len(t or ""), "x", 1, 0.5, "c") for j, (i, t) in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with the tables that stages read."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([("q1", QUESTION), ("q2", None), ("q3", "yes yes no")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(ROWS, COLUMNS).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return path


def rows(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = df.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"] is not None)
    return sorted((r["source"], r["text"]) for r in out)


def test_language_stage(spark, docs, folder):
    net = language_id.fit(docs.where(~language_id.held_out()))
    want = []
    for r in ROWS:
        if r[1] and re.search(r"[^\W\d_]", r[1]):
            w = language_id.windows(r[1].encode())
            if net.predict(w, net.tables()).mean(0).max() >= corpus_pipeline.LEAST_SCORE:
                want.append((r[3], r[1]))
    assert rows(corpus_pipeline.keep_known_languages(spark, docs, folder)) == sorted(want)
    assert corpus_pipeline.keep_known_languages(spark, docs.limit(0), folder).count() == 0


def one_edit(a, c):
    if len(a) == len(c):
        return sum(x != y for x, y in zip(a, c, strict=True)) <= 1
    s, l = sorted((a, c), key=len)
    return len(l) - len(s) == 1 and any(l[:i] + l[i + 1 :] == s for i in range(len(l)))


def test_line_stage(spark, docs, folder):
    """Rows of one id and different texts are left out here: which comes first is a matter of fingerprints."""
    some = [r for r in ROWS if r[0] is not None and r[0] != 16]
    lines = [(r[0], p, tuple(x.lower().split())) for r in {x[:2]: x for x in some}.values() for p, x in enumerate((r[1] or "").split("\n"))]
    lines = sorted(x for x in lines if x[2])
    gone = {(i, p) for k, (i, p, w) in enumerate(lines) if any(w == v or len(w) >= 5 and len(v) >= 5 and one_edit(w, v) for _, _, v in lines[:k])}
    want = []
    for r in some:
        if r[1] is None:
            want.append((r[3], None))
            continue
        parts = r[1].split("\n")
        kept = "\n".join(x for p, x in enumerate(parts) if (r[0], p) not in gone)
        if kept.strip() or len(kept) == len(r[1]):
            want.append((r[3], kept))
    got = rows(corpus_pipeline.drop_repeated_lines(spark, docs.where("doc_id <> 16"), folder))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert corpus_pipeline.drop_repeated_lines(spark, docs.limit(0), folder).count() == 0


def test_near_duplicate_stage(spark, docs, folder):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(r[1]) for r in ROWS]
    comp = list(range(len(ROWS)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, folder).collect()
    by_source = {r["source"]: i for i, r in enumerate(docs.collect())}
    kept = [comp[by_source[r["source"]]] for r in got]
    with_words = [comp[i] for i, s in enumerate(sets) if s]
    assert sorted(c for c in kept if sets[c]) == sorted(set(with_words))  # one of each component
    for r in got:  # of least id, a null one first
        members = [ROWS[i][0] for i in range(len(ROWS)) if comp[i] == comp[by_source[r["source"]]]]
        assert r["doc_id"] == (None if None in members else min(members))
    assert corpus_pipeline.keep_one_of_near_duplicates(spark, docs.limit(0), folder).count() == 0


def test_benchmark_stage(spark, docs, folder):
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    q = [x.encode().lower() for x in QUESTION.split()]
    q = [w for x in q for w in pattern.findall(x)]
    windows = [q[i : i + 10] for i in range(len(q) - 9)] + [[b"yes", b"yes", b"no"]]
    want = []
    for r in ROWS:
        if r[1] is None:
            continue
        raw = r[1].encode()
        places = [m.span() for m in pattern.finditer(raw.lower())]
        words = [raw.lower()[x:y] for x, y in places]
        hit = [False] * len(words)
        for w in windows:
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit[j : j + len(w)] = [True] * len(w)
        if sum(hit) > 0.5 * len(words):
            continue
        out, last = [], 0
        for j, h in enumerate(hit):
            if h and (j == 0 or not hit[j - 1]):
                out.append(raw[last : places[j][0]])
            if h:
                last = places[j][1]
        want.append((r[3], b"".join([*out, raw[last:]]).decode()))
    got = rows(corpus_pipeline.remove_benchmark_passages(spark, docs, folder))
    assert got == sorted(want) and len(got) < len(ROWS) - 1
    assert corpus_pipeline.remove_benchmark_passages(spark, docs.limit(0), folder).count() == 0


def test_packing_stage(spark, docs, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.pack_sequences(spark, docs, folder).collect()
    want = sorted((str(r[0]), np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in ROWS)
    whole_pieces = [(str(p["doc_id"]), bytes(p["ids"])) for p in pieces if p["length"] == p["doc_tokens"]]
    cut = sorted((p for p in pieces if p["length"] < p["doc_tokens"]), key=lambda p: p["start"])
    joined = [(str(cut[0]["doc_id"]), b"".join(bytes(p["ids"]) for p in cut))] if cut else []
    assert sorted(whole_pieces + joined) == want and {p["doc_id"] for p in cut} == {13}
    ends = {}
    for p in sorted(pieces, key=lambda p: p["offset"]):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values()) <= 4096 and len(ends) <= sum(ends.values()) // 4096 + 2
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), folder).count() == 0


def test_run(spark, folder):
    """The whole pipeline is its stages one after the other; nothing is left of repeats, null texts and the question."""
    out = corpus_pipeline.run(spark, folder).collect()
    ids = [r["doc_id"] for r in out]
    assert 2 not in ids and 9 not in ids and 8 not in ids and 13 in ids
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "packing"]
