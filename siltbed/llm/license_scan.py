"""6. Licence scans by diagonal voting.

The rolling hashes of every text's word k-grams are joined by Spark to the places
they have in the templates. Each match votes for its diagonal (place in the text
less place in the template); votes are summed for each document, template and
diagonal, neighbouring diagonals merge into spans, and a span is verified on the
text: enough of the template's words must stand there in their order.

The templates are a fixed list, so the broadcast side is bounded by it.

Defined cases: null or empty text: no words, no labels, score 0. Rows that repeat
id and text share their result; rows with the same id but another text do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.llm import base as b

# The base phrases, and notices that public licences prescribe.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def _words(text: str) -> list[bytes]:
    return b.ALNUM.findall(text.encode().lower())


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    flat = b" ".join(words) + b" "
    ends = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32) if words else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1]) if words else ends
    return b.grams(b.word_hashes(np.frombuffer(flat, np.uint8), starts, ends), k)


def in_order(text: list[bytes], template: list[bytes]) -> int:
    """How many of the template's words stand in the text in their order (longest common subsequence)."""
    row = [0] * (len(template) + 1)
    for w in text:
        before = 0
        for j, t in enumerate(template, 1):
            before, row[j] = row[j], before + 1 if w == t else max(row[j], row[j - 1])
    return row[-1]


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> dict[str, list[int]]:
    """label -> where its phrase's words stand consecutively."""
    found = {}
    joined = b" ".join(words)
    for p, label in phrases:
        if b" ".join(p) not in joined:
            continue
        hit = [i for i in range(len(words) - len(p) + 1) if words[i] == p[0] and words[i : i + len(p)] == p]
        if hit:
            found[label] = hit
    return found


_BASE = "_id long, _fp long, n_words long, n_base long, first_word long, last_word long, base string"
_LABEL = "_id long, _fp long, spans array<struct<label: string, from: long, to: long, share: double>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, near: int = 3, least: float = 0.9, templates=None) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, from, to, share) for every row.

    Only texts with votes are read again for verification, and only narrow rows meet at the end."""
    spark = docs.sparkSession
    templates = templates or TEMPLATES
    words = [_words(t) for _, t in templates]
    phrases = [(p.encode().split(), label) for p, label in PHRASES]
    places = [(int(h), t, j) for t, w in enumerate(words) for j, h in enumerate(_hashes(w, k).view(np.int64))]
    where = spark.createDataFrame(places, "hash long, template int, at int")
    keyed = b.keyed(docs, id_col, text_col)

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in b.pieces(batches, "_text"):
            flat, starts, ends, n = b.joined_words(texts, b.ALNUM, lower=True)
            h = b.grams(b.word_hashes(np.frombuffer(flat, np.uint8), starts, ends), k).view(np.int64)
            size = np.maximum(n - k + 1, 0)
            spot = np.arange(int(size.sum())) + np.repeat((np.cumsum(n) - n) - (np.cumsum(size) - size), size)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(h[spot]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["_id", "_fp", "hashes"])

    grams = keyed.mapInArrow(roll, "_id long, _fp long, hashes array<long>").select("_id", "_fp", F.posexplode("hashes").alias("pos", "hash"))
    votes = grams.join(F.broadcast(where), "hash").groupBy("_id", "_fp", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count_distinct("at").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    line = Window.partitionBy("_id", "_fp", "template").orderBy("diagonal")
    spans = (
        votes.withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > near, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("new").over(line))
        .groupBy("_id", "_fp", "template", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .groupBy("_id", "_fp").agg(F.sort_array(F.collect_list(F.struct("template", "lo", "hi"))).alias("found"))
    )
    spans = b.written(spans, "voted")

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in b.pieces(batches, "_text"):
            rows = []
            for raw in texts:
                own = b.ALNUM.findall(raw.lower())
                at = phrase_places(own, phrases)
                starts = [x for hit in at.values() for x in hit]
                rows.append((len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(at))))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.string(),), strict=True))], ["_id", "_fp", "n_words", "n_base", "first_word", "last_word", "base"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("label", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("share", pa.float64())]))
        for batch, texts in b.pieces(batches, "_text"):
            out = []
            for raw, found in zip(texts, batch.column(3).to_pylist(), strict=True):
                own, spans = b.ALNUM.findall(raw.lower()), []
                for s in found:
                    label, template = templates[s["template"]][0], words[s["template"]]
                    lo, hi = max(0, s["lo"] - len(template)), s["hi"] + k + len(template)
                    # a long span holds the notice more than once; every vote lies inside
                    part = own[lo:hi]
                    share = max((in_order(part[x : x + 4 * len(template)], template) for x in range(0, max(1, len(part)), 2 * len(template))), default=0) / len(template)
                    if share >= least:
                        spans.append({"label": label, "from": s["lo"], "to": s["hi"] + k, "share": share})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, span)], ["_id", "_fp", "spans"])

    # rows that repeat id and text have one result, and votes are counted once for all of them
    verified = keyed.join(spans, ["_id", "_fp"]).select("_id", "_fp", "_text", "found").mapInArrow(verify, _LABEL).where(F.size("spans") > 0).dropDuplicates(["_id", "_fp"])
    rows = keyed.mapInArrow(base, _BASE).join(b.written(verified, "verified"), ["_id", "_fp"], "left")
    both = F.array_remove(F.concat(F.split("base", ","), F.coalesce(F.transform("spans", lambda s: s.label), F.array().cast("array<string>"))), "")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s.share)), F.lit(0.0)))
    return rows.select(
        b.unkeyed().alias(id_col), "n_words", "n_base", "first_word", "last_word", F.col("base").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(both)), ",").alias("labels"), score.alias("score"), F.coalesce("spans", F.array().cast("array<struct<label: string, from: long, to: long, share: double>>")).alias("spans"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(b.read(spark, sf_dir, "documents")).drop("spans")
