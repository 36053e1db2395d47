r"""License scan: base phrases by place, license templates by an exact set-similarity join.

Blocks are windows of words, across line breaks, as sets: a template of up to ``step`` words is looked for in
windows of 2 * step words that begin at every step-th word, so that a run of step words lies within one,
however it is wrapped, and words scattered over a long text don't add up. Steps are multiples of ``STEP``.
A template is found in a block that holds at least ``THRESHOLD`` of the template's distinct words (containment),
whatever else stands there. Words are ordered by how often they stand in all texts, rarest first; with o words
needed of m:

* prefix: the first m - o + 1 words of the template must meet the first b - o + 1 of the block; windows
  without a word of any prefix are not even made;
* length: the block has at least o words of any template;
* position: from a meeting at places i and j, 1 + min(b - i, m - j) words can still be common.

What passes is verified. The templates are fixed values, so that their words, the frequencies of
those words and the prefix index are of constant size (they alone are gathered and broadcast).
Words of no template can't be common to both sides and are left out of blocks. Everything is
SQL functions; texts are read twice (frequencies, then windows and phrases) and never shuffled, only numbers and
found windows are.

Defined results: null and empty texts have no words, places or labels and score 0; repeated rows
get equal results; an empty table gives an empty result.
``score`` is the greatest containment found; 1.0 with a base phrase. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, cut, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD, STEP = 0.9, 8  # of short templates nearly all words: "the MIT license" differs from others by one
# Phrases whose places count, and notices of common licenses.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def needed(m: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * m - 1e-9))


def _lower(text: Column) -> Column:
    """As far as ASCII words are concerned, A-Z lower-cased: two other letters that lower() would
    turn into ASCII take the slower way."""
    return F.when(text.contains("K") | text.contains("İ"), ascii_lower(text)).otherwise(F.lower(text))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_lower(text), NOT_WORD), "")


def step_of(template: str) -> int:
    return -(-len(template.split()) // STEP) * STEP


def word_order(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> list[str]:
    """The templates' words, rarest first over all of docs."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    counts = docs.select(F.explode(_words(F.col(text_col))).alias("word")).filter(F.col("word").isin(vocabulary)).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counts.collect()}  # a row for each template word at most
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def _prefixes(order: list[str], templates, threshold: float) -> list[tuple[str, int, int, int, int, str, str, int]]:
    """(word, template, place, words, words needed, label, all words, step) for each word of each template's prefix."""
    rank = {w: n for n, w in enumerate(order)}
    sets = [(label, sorted(set(t.split()), key=rank.get), step_of(t)) for label, t in templates]
    return [(w, k, j, len(s), needed(len(s), threshold), label, " ".join(s), step) for k, (label, s, step) in enumerate(sets) for j, w in enumerate(s[: len(s) - needed(len(s), threshold) + 1], 1)]


def find_templates(blocks: DataFrame, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """blocks (step, words and others) joined with the templates of their step that they hold: adds label and containment."""
    rows = _prefixes(order, templates, threshold)
    index = blocks.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t(__word, __template, __j, __m, __o, label, __set, step)")
    own = [c for c in blocks.columns if c not in ("words", "step")]
    held = blocks.withColumn("__held", F.array_intersect(F.array(*map(F.lit, order)), "words")).withColumn("__b", F.size("__held")).filter(F.col("__b") >= min(r[4] for r in rows))
    met = (
        held.select(*own, "step", "__held", "__b", F.posexplode("__held").alias("__i", "__word"))
        .withColumn("__i", F.col("__i") + 1)
        .join(F.broadcast(index), ["__word", "step"])  # a row for each word of a prefix
        .filter("__b >= __o AND __i <= __b - __o + 1 AND 1 + least(__b - __i, __m - __j) >= __o")
    )
    common = F.size(F.array_intersect("__held", F.split("__set", " ")))
    return met.withColumn("__common", common).filter("__common >= __o").withColumn("containment", F.col("__common") / F.col("__m")).select(*own, "label", "containment")


def _windows(words: Column, hits: Column, rows: list) -> Column:
    """The windows (step, first, words) that hold a word of a prefix of their step."""
    found = []
    for step in sorted({r[7] for r in rows}):
        own = sorted({r[0] for r in rows if r[7] == step})
        numbers = F.array_distinct(F.flatten(F.transform(F.filter(hits, lambda h: h.w.isin(own)), lambda h: F.array((h.i / step).cast("int"), (h.i / step).cast("int") - 1))))  # noqa: B023
        found.append(F.transform(F.filter(numbers, lambda k: k >= 0), lambda k: F.struct(F.lit(step).alias("step"), (k * step).alias("first"), F.slice(words, k * step + 1, 2 * step).alias("words"))))  # noqa: B023
    return F.concat(*found)


def _phrases(words: Column, hits: Column) -> Column:
    """The places (start, label) of the base phrases."""
    found = []
    for phrase, label in PHRASES:
        *before, last = phrase.split()
        n = len(before)
        fits = lambda h: reduce(lambda a, b: a & b, (F.coalesce(F.get(words, h.i - n + k) == w, F.lit(False)) for k, w in enumerate(before)), h.w == last)  # noqa: B023, E731
        found.append(F.transform(F.filter(hits, fits), lambda h: F.struct((h.i - n).alias("start"), F.lit(label).alias("label"))))  # noqa: B023
    return F.concat(*found)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, places: a row for
    each row of docs; places are (first word, label, containment) of the windows found."""
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    order = word_order(docs, templates, "__text")
    rows = _prefixes(order, templates, threshold)
    wanted = sorted({r[0] for r in rows} | {p.split()[-1] for p, _ in PHRASES})
    hits = F.array_compact(F.transform("__words", lambda w, i: F.when(w.isin(wanted), F.struct(i.alias("i"), w.alias("w")))))
    read = (
        docs.select("__id", F.xxhash64("__text").alias("__key"), _words(F.coalesce("__text", F.lit(""))).alias("__words"))
        .withColumn("__hits", hits)
        .select("__id", "__key", F.size("__words").alias("__n"), _phrases(F.col("__words"), F.col("__hits")).alias("__base"), _windows(F.col("__words"), F.col("__hits"), rows).alias("__windows"))
    )
    read = cut(read)  # numbers, and the few windows that hold a rare word of a template
    found = (
        find_templates(read.select("__id", "__key", F.inline("__windows")), order, templates, threshold)
        .groupBy("__id", "__key")
        .agg(F.collect_set("label").alias("__labels"), F.max("containment").alias("__score"), F.array_sort(F.collect_set(F.struct(F.col("first"), "label", "containment"))).alias("places"))
    )
    right = found.withColumnsRenamed({"__id": "__id2", "__key": "__key2"})
    joined = read.drop("__windows").join(right, read["__id"].eqNullSafe(right["__id2"]) & read["__key"].eqNullSafe(right["__key2"]), "left")
    none = F.array().cast("array<string>")
    base = F.array_sort(F.array_distinct("__base.label"))
    labels = F.array_sort(F.array_union(base, F.coalesce("__labels", none)))
    return joined.select(
        F.col("__id").alias(id_col),
        F.col("__n").cast("long").alias("n_words"),
        F.size("__base").cast("long").alias("n_base"),
        F.array_min("__base.start").cast("long").alias("first_word"),
        F.array_max("__base.start").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("__base") > 0, F.lit(1.0)).otherwise(F.coalesce("__score", F.lit(0.0))).alias("score"),
        "places",
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("places")


ORACLE = rf"""
WITH low AS (
  SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
worded AS (SELECT doc_id, r, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
placed AS (
  SELECT *, list_filter(range(1, len(w) + 1), lambda i: (w[i] = 'mit' AND w[i+1] = 'license') OR (w[i] = 'apache' AND w[i+1] = 'license')
    OR (w[i] = 'general' AND w[i+1] = 'public' AND w[i+2] = 'license')) AS pos FROM worded),
templates(k, label, s, step) AS (VALUES {", ".join(f"({k}, '{label}', list_distinct(string_split('{t}', ' ')), {step_of(t)})" for k, (label, t) in enumerate(TEMPLATES))}),
steps AS (SELECT DISTINCT step FROM templates),
windows AS (
  SELECT r, step, w[k * step + 1 : k * step + 2 * step] AS b FROM (SELECT r, w, step, unnest(range(0, (len(w) + step - 1) // step)) AS k FROM worded, steps)),
held AS (
  SELECT r, label, len(list_intersect(b, s))::DOUBLE / len(s) AS containment FROM windows JOIN templates USING (step)
  WHERE len(list_intersect(b, s)) >= ceil(len(s) * {THRESHOLD} - 1e-9)),
found AS (SELECT r, list(DISTINCT label) AS ls, max(containment) AS best FROM held GROUP BY r),
based AS (
  SELECT *, list_distinct(list_transform(pos, lambda i: CASE w[i] WHEN 'mit' THEN 'mit' WHEN 'apache' THEN 'apache' ELSE 'gpl' END)) AS bl FROM placed)
SELECT doc_id, len(w)::BIGINT AS n_words, len(pos)::BIGINT AS n_base, (list_min(pos) - 1)::BIGINT AS first_word, (list_max(pos) - 1)::BIGINT AS last_word,
  array_to_string(list_sort(bl), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(ls, [])))), ',') AS labels,
  CASE WHEN len(pos) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM based LEFT JOIN found USING (r)
"""
