"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are lines, and stretches of ``BLOCK`` words that start every half of it, so that a notice wrapped over lines lies
in one wherever it stands (a stretch holds any template of up to half its words whole). A template matches a block that
holds at least ``THRESHOLD`` of the template's distinct words. The join finds all such blocks: template words are ordered by how many documents hold them, rarest first, over the whole
table; a block that reaches the threshold must hold one of a template's first n - ceil(tn) + 1 words (prefix filter),
at least ceil(tn) template words (length filter), and enough words after the shared one on both sides (positional
filter). Candidates are then verified. Only the words that occur in templates are kept of a block, as no other can
count. The template index is broadcast: it has at most ``len(TEMPLATES) * words`` rows, whatever the input.

The base phrases are found beside it, word by word over the whole text, across lines.

Edge cases: a null or empty text has no words and no labels, first_word and last_word null and score 0. Repeated rows
and null ids give a row each; extra columns are not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.llm.common import ascii_lower, table, whole, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"apache license": "apache", "general public license": "gpl", "mit license": "mit"}
THRESHOLD = 0.8
#: (label, template), words in lower case.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)


#: Words of a stretch; a new one starts every half of it, which holds any template whole.
BLOCK = 2 * max(len(text.split()) for _, text in TEMPLATES)


def _sets() -> list[tuple[int, str, list[str]]]:
    return [(i, label, sorted(set(text.split()))) for i, (label, text) in enumerate(TEMPLATES)]


def _least(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of the phrase in an array of words, from 0."""

    def here(w, i):
        hit = w == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            hit = hit & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(hit, i.cast("bigint")).otherwise(F.lit(-1).cast("bigint"))

    return F.filter(F.transform(words, here), lambda i: i >= 0)


def _read(docs: DataFrame, text: str, threshold: float) -> DataFrame:
    """One row per document: base results, the template words it holds (seen), and its blocks that may match."""
    vocabulary = sorted({w for _, _, words in _sets() for w in words})
    smallest = min(_least(len(words), threshold) for _, _, words in _sets())
    words = F.col("__words")
    at = docs.select("doc_id", ascii_lower(whole(F.col(text))).alias("__t"))
    at = at.withColumn("__lines", F.transform(F.split("__t", "\n"), lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))))
    at = at.withColumn("__kept", F.transform("__lines", lambda x: F.array_intersect(F.lit(vocabulary), x)))
    at = at.withColumn("__words", F.when(F.contains("__t", F.lit("license")), F.flatten("__lines")).otherwise(F.array().cast("array<string>")))
    at = at.withColumn("places", F.array(*[F.struct(F.lit(label).alias("label"), _places(words, phrase.split()).alias("at")) for phrase, label in PHRASES.items()]))
    at = at.withColumn("seen", F.array_distinct(F.flatten("__kept")))
    may = F.lit(False)  # the whole text holds enough of some template
    for _, _, template in _sets():
        may = may | (F.size(F.array_intersect("seen", F.lit(template))) >= _least(len(template), threshold))
    half, flat = BLOCK // 2, F.col("__flat")
    at = at.withColumn("__flat", F.when(may, F.flatten("__lines")).otherwise(F.array().cast("array<string>")))
    stretch = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(flat) - BLOCK) / half).cast("int"))), lambda i: F.array_intersect(F.lit(vocabulary), F.slice(flat, i * half + 1, BLOCK)))
    at = at.withColumn("__wide", F.when(may, stretch).otherwise(F.array().cast("array<array<string>>")))
    starts = F.flatten(F.transform("places", lambda p: p["at"]))
    return at.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.aggregate("__lines", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x)).alias("n_words"),
        F.size(starts).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.transform(F.filter("places", lambda p: F.size(p["at"]) > 0), lambda p: p["label"]).alias("base"),
        "seen",
        F.filter(F.concat(F.when(may, F.col("__kept")).otherwise(F.array().cast("array<array<string>>")), "__wide"), lambda x: F.size(x) >= smallest).alias("blocks"),
    )


def matches(read: DataFrame, threshold: float) -> DataFrame:
    """(row, block, label, containment) of every block that reaches the threshold for a template."""
    spark = read.sparkSession
    counts = {r["w"]: r["n"] for r in read.select(F.explode("seen").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the templates' words
    order = {w: k for k, w in enumerate(sorted({w for _, _, words in _sets() for w in words}, key=lambda w: (counts.get(w, 0), w)))}
    index = []
    for i, label, words in _sets():
        ranks, least = sorted(order[w] for w in words), _least(len(words), threshold)
        index += [(i, label, rank, place, len(ranks), least, ranks) for place, rank in enumerate(ranks[: len(ranks) - least + 1])]
    prefixes = F.broadcast(spark.createDataFrame(index, "template int, label string, rank int, place int, n int, least int, ranks array<int>"))
    rank_of = F.create_map(*[F.lit(x) for w, k in order.items() for x in (w, k)])
    first = sorted({x[2] for x in index})
    blocks = read.where(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "words"))
    blocks = blocks.select("row", "block", F.sort_array(F.transform("words", lambda w: F.element_at(rank_of, w))).alias("have"))
    blocks = blocks.where(F.arrays_overlap("have", F.lit(first)))
    shared = blocks.select("row", "block", "have", F.posexplode("have").alias("at", "rank")).join(prefixes, "rank")
    after = 1 + F.least(F.col("n") - F.col("place") - 1, F.size("have") - F.col("at") - 1)  # shared words from here on; any before would be met at their own place
    able = shared.where((F.size("have") >= F.col("least")) & (after + F.least("place", "at") >= F.col("least")))
    same = F.size(F.array_intersect("have", "ranks"))
    return able.where(same >= F.col("least")).select("row", "block", "label", (same / F.col("n")).alias("containment"))


def scan(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: base results, labels of phrases and templates, and the best containment.

    ``score`` is 1 where a base phrase stands, else the best containment of a matching template, else 0. ``n_blocks``
    counts the lines and stretches that match a template.
    """
    read = written(_read(docs, text, threshold))
    best = matches(read, threshold).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"), F.count_distinct("block").alias("blocks"))
    return read.drop("blocks", "seen").join(best, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("blocks", F.lit(0)).alias("n_blocks"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_PHRASE_ROWS = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in PHRASES.items())
_TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', {words!r}, {_least(len(words), THRESHOLD)})" for i, label, words in _sets())
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
p(label, words) AS (VALUES {_PHRASE_ROWS}),
i AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS k FROM w WHERE contains(t, 'license')),
b AS (SELECT rid, label, k - 1 AS pos FROM i, p WHERE ws[k : k + len(words) - 1] = words),
bb AS (SELECT rid, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY rid),
l AS (SELECT rid, unnest(list_transform(string_split(t, chr(10)), lambda x: {{'ws': regexp_extract_all(x, '{WORD}')}})) AS x FROM d
  UNION ALL SELECT rid, {{'ws': ws[k * {BLOCK // 2} + 1 : k * {BLOCK // 2} + {BLOCK}]}} FROM (SELECT rid, ws, unnest(range(0, greatest(0, ceil((len(ws) - {BLOCK}) / {BLOCK / 2})::BIGINT) + 1)) AS k FROM w)),
ln AS (SELECT rid, row_number() OVER () AS line, x.ws AS ws FROM l),
tp(template, label, words, least) AS (VALUES {_TEMPLATE_ROWS}),
m AS (SELECT rid, line, label, len(list_intersect(words, ws))::DOUBLE / len(words) AS c FROM ln, tp WHERE len(list_intersect(words, ws)) >= least),
mm AS (SELECT rid, max(c) AS c, count(DISTINCT line) AS n FROM m GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM b UNION ALL SELECT rid, label FROM m) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(bb.n, 0)::BIGINT AS n_base, bb.lo::BIGINT AS first_word, bb.hi::BIGINT AS last_word,
  coalesce(bb.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
  CASE WHEN bb.n > 0 THEN 1.0::DOUBLE ELSE coalesce(mm.c, 0.0::DOUBLE) END AS score, coalesce(mm.n, 0)::BIGINT AS n_blocks
FROM w LEFT JOIN bb ON w.rid = bb.rid LEFT JOIN mm ON w.rid = mm.rid LEFT JOIN al ON w.rid = al.rid
"""
