"""4. Line dedup by a deletion-neighbourhood join, with DataFrame operations alone.

Lines are compared as lower-cased words. A line goes if an earlier line (smaller
id, or the same document further up) is within one word edit of it: one word put
in, left out or changed. Lines under `min_words` words, where one edit is much of the
line, go only if an earlier line has the same words.

1. Equal lines of any length fold to their first place (partial aggregation takes hot lines).
2. Two lines of `min_words` words or more within one edit share their first or last half, so lines whose halves
   occur in no other line are done.
3. The rest emit their deletion neighbourhood: for each word the line without it, as
   a 64-bit key. Keys are XORs of word-and-place hashes, so a line of n words costs n
   steps. Equal variants with the same gap are one change apart; a variant that
   equals a whole line is one insertion apart. Each key keeps only its earliest line
   of either role, so a hot key costs one row a task, not pairs.
4. Each proposed pair is verified on the words themselves.

Defined cases: null text stays null with no lines; empty lines stay; a text whose
lines all go becomes empty. Rows that repeat id and text stand at the same place and
do not remove each other. Lines are judged on the input, not on what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.llm import base as b


def _plain(text: Column) -> Column:
    """Lower case, with blanks for all white space but line ends."""
    text = F.lower(text)
    for c in "\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _halves() -> tuple[Column, Column]:
    """A hash of the line, and hashes of its first and last words, half of them.

    A line of n words and one of n + 1 must meet, so an even n takes both n / 2 and n / 2 - 1.
    """
    n = F.col("n")
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    front = lambda h: F.xxhash64(F.lit(1), h, F.slice("words", F.lit(1), h))
    back = lambda h: F.xxhash64(F.lit(2), h, F.slice("words", n - h + 1, h))
    halves = F.when(low == high, F.array(front(low), back(low))).otherwise(F.array(front(low), back(low), front(high), back(high)))
    return F.xxhash64("words"), halves


_PLACE = ("_id", "_fp", "pos")
#: Lines that are held against one copy of their earliest neighbour.
PER_SALT = 500


def _within_one(x: Column, y: Column) -> Column:
    """Whether word lists differ by at most one insertion, deletion or change."""
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    same = F.array_position(F.zip_with(short, F.slice(long, F.lit(1), F.size(short)), lambda a, c: a == c), False)
    at = F.when(same == 0, F.size(short) + 1).otherwise(same).cast("int")  # first difference, from 1
    rest = lambda a, i: F.slice(a, i, F.size(a) + 1)
    gap = F.size(long) - F.size(short)
    return F.when(gap == 0, rest(short, at + 1) == rest(long, at + 1)).when(gap == 1, rest(short, at) == rest(long, at + 1)).otherwise(False)


def removed_lines(keyed: DataFrame, min_words: int) -> DataFrame:
    """(_id, _fp, pos) of the lines that go."""
    lines = keyed.select("_id", "_fp", F.posexplode(F.transform(F.split(_plain(F.col("_text")), "\n"), _words)).alias("pos", "words"))
    lines = lines.withColumn("n", F.size("words")).where(F.col("n") > 0)
    whole, halves = _halves()
    judged = F.when(F.col("n") >= min_words, F.col("halves"))  # null: equality alone
    middle = [F.element_at("words", F.floor((F.col("n") + 1) / 2).cast("int")), F.element_at("words", F.floor(F.col("n") / 2).cast("int") + 1)]
    hashes = lines.select(*_PLACE, whole.alias("h1"), "n", halves.alias("halves"), F.xxhash64("n", *middle).alias("middle"))
    second = F.xxhash64(F.element_at("halves", 1), F.element_at("halves", 2), "middle")  # with h1, 128 bits of the line
    hashed = b.written(hashes.select(*_PLACE, "h1", second.alias("h2"), judged.alias("halves")), "line-hashes")
    first = hashed.groupBy("h1", "h2").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("n"))
    # few lines have very many copies, which are told apart from the others
    repeated = first.where("n > 1").withColumnRenamed("n", "size")
    equal = b.join_sized(hashed.select(*_PLACE, "h1", "h2"), repeated, ["h1", "h2"]).where(F.struct(*_PLACE) != F.col("first")).select(*_PLACE)

    by_half = hashed.select("h1", F.posexplode("halves").alias("side", "half"))
    shared = by_half.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("z")).where("a <> z").select("half")
    sides = by_half.join(shared, "half", "left_semi").groupBy("h1").agg(F.max(F.col("side") % 2 == 0).alias("front"), F.max(F.col("side") % 2 == 1).alias("back"))
    near = first.join(sides, "h1").select("h1", "h2", "front", "back", F.col("first").alias("place"))
    wanted = near.groupBy(F.col("place._id").alias("_id"), F.col("place._fp").alias("_fp")).agg(F.collect_list(F.struct(F.col("place.pos").alias("pos"), "h1", "h2", "front", "back")).alias("wanted"))
    wanted = b.written(wanted, "wanted-lines")  # before texts are shuffled
    text = F.split(_plain(F.col("_text")), "\n")
    pick = lambda line, i: F.struct(line.alias("line"), F.filter("wanted", lambda x: x.pos == i).alias("s"))
    rows = keyed.join(wanted, ["_id", "_fp"]).select("_id", "_fp", F.inline(F.transform(text, pick))).where(F.size("s") > 0).select("_id", "_fp", "line", F.inline("s"))
    left = b.written(rows.select(F.struct(*_PLACE).alias("place"), "h1", "h2", "front", "back", _words(F.col("line")).alias("words")), "near-lines")

    # the deletion neighbourhood: XOR of (word, place) before the gap and of (word, place - 1) behind it
    each = left.repartition("h1", "h2").select("h1", "h2", "front", "back", F.size("words").alias("n"), F.posexplode("words").alias("i", "w"))
    each = each.withColumns({"here": F.xxhash64("w", "i"), "moved": F.xxhash64(F.col("w"), F.col("i") - 1)})
    line = Window.partitionBy("h1", "h2")
    so_far = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    gone = each.select(
        "h1", "front", "back", "n", "i",
        F.bit_xor("here").over(line).alias("whole"),
        F.bit_xor("here").over(so_far).bitwiseXOR(F.col("here")).bitwiseXOR(F.bit_xor("moved").over(line)).bitwiseXOR(F.bit_xor("moved").over(so_far)).alias("variant"),
    )
    half = F.floor((F.col("n") - 1) / 2)  # a shared half has no edit, so the gap is in the other
    open_gap = (F.col("front") & (F.col("i") >= half)) | (F.col("back") & (F.col("i") < F.col("n") - half))
    keys = F.array(
        F.struct(F.when(open_gap, F.xxhash64(F.lit("change"), "variant", "i", "n")).alias("key"), F.lit(0).alias("role")),
        F.struct(F.when(open_gap, F.xxhash64(F.lit("insert"), "variant", F.col("n") - 1)).alias("key"), F.lit(1).alias("role")),
        F.struct(F.when(F.col("i") == 0, F.xxhash64(F.lit("insert"), "whole", "n")).alias("key"), F.lit(2).alias("role")),
    )
    variants = gone.select("h1", F.inline(keys)).where("key is not null")
    met = variants.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("z")).where("a <> z").select("key")
    met = b.written(variants.join(met, "key").join(left.select("h1", "place"), "h1").select("key", "role", "place"), "variants")
    earliest = lambda *roles: F.min(F.when(F.col("role").isin(*roles), F.col("place")))
    best = met.groupBy("key").agg(earliest(0, 1).alias("short"), earliest(0, 2).alias("long"))
    other = F.when(F.col("role") == 1, F.col("long")).otherwise(F.col("short"))
    pairs = b.written(met.join(best, "key").select("place", other.alias("other")).where("other < place").distinct(), "line-pairs")
    # many lines may have one earliest neighbour, whose words are laid out once for each PER_SALT of them
    parts = F.ceil(F.count("*") / PER_SALT).cast("int").alias("parts")
    crowded = b.written(pairs.groupBy("other").agg(parts).where("parts > 1"), "crowded")
    part = F.pmod(F.xxhash64("place"), F.col("parts")).cast("int")
    salted = pairs.join(crowded, "other", "left").select("place", "other", F.coalesce(part, F.lit(0)).alias("part"))
    theirs = left.select(F.col("place").alias("other"), F.col("words").alias("theirs")).join(crowded, "other", "left")
    laid_out = theirs.select("other", "theirs", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    mine = left.select("place", F.col("words").alias("mine"))
    close = salted.join(mine, "place").join(laid_out, ["other", "part"]).where(_within_one(F.col("mine"), F.col("theirs")))
    gone = b.written(equal.union(close.select("place.*")).distinct(), "gone-lines")
    b.drop_tables(hashed, wanted, left, met, pairs, crowded)
    return gone


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """docs with the text that is left, and n_lines and n_removed; columns of those two names are replaced."""
    gone = removed_lines(b.keyed(docs, id_col, text_col), min_words).groupBy("_id", "_fp").agg(F.collect_list("pos").alias("gone"))
    own = docs.drop("n_lines", "n_removed")
    joined = own.select(F.struct("*").alias("row"), *b.row_key(id_col, text_col)).join(gone, ["_id", "_fp"], "left")
    text = F.col(f"row.`{text_col}`")
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    columns = [F.when(F.col("gone").isNull(), text).otherwise(kept).alias(text_col) if c == text_col else F.col(f"row.`{c}`") for c in own.columns]
    return joined.select(*columns, F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(b.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("kept_sha256"))
