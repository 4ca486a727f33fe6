"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, over line ends too: for a template of n words, as
many as n / THRESHOLD. A block contains a template when at least THRESHOLD of the
template's distinct words are in it. The words are ordered by how many texts of the whole
corpus hold them, rarest first, with ties by the word. Filters, none of which loses a match:

* prefix: of a template of t distinct words of which `need` must be in the block, one of
  the t - need + 1 rarest is; only templates of which the text has such a word are looked at;
* positional: only blocks around the places of these words are, and each is bounded
  by what stands within a block's length on both sides: fewer than `need` shared words
  there, and no block over this place can match;
* length: a text that holds fewer than `need` of the template's words cannot match.

What passes is verified by intersecting the sets of every block over the place. Templates are a bounded
list, so they travel with the expressions as one literal: the work of a text grows with
its words and the places of prefix words. Rows are not shuffled but for the corpus's
counts of the templates' words.

Base phrases are found by their words' places in the whole text, over line ends too.

Edge cases: a null text is empty, has no words and no labels; a template of one
word needs it; one without words is left out; labels are distinct, sorted and comma-joined ('' for none); score is
the greatest containment met, 1 where a base phrase stands, else 0; `matches` has, for
each template met, its greatest containment and the first block of it; columns
named like an output are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table

THRESHOLD = 0.8

#: The phrases whose places are the base, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices by which public licenses are commonly announced, as folded words.
TEMPLATES = {
    "agpl-3.0": "licensed under the gnu affero general public license version 3",
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc0-1.0": "to the extent possible under law the author has waived all copyright and related rights",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")


def folded(text_col: str) -> Column:
    """The text with A-Z lower-cased. lower() also folds other letters, which changes no
    word's borders and no ASCII word but where a letter's lower case is ASCII: those texts
    are translated instead."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text_col: str) -> Column:
    return F.array_remove(F.split(folded(text_col), SEPARATOR + "+"), "")


def strings(items) -> Column:
    return F.array(*(F.lit(x) for x in items)) if items else F.lit(None).cast("array<string>")


def corpus_order(docs: DataFrame, text_col: str, tokens: set[str]) -> dict[str, int]:
    """How many texts of the whole corpus hold each of the tokens."""
    if not tokens:
        return {}
    held = docs.select(F.explode(F.array_intersect(words(text_col), strings(sorted(tokens)))).alias("w"))
    counts = dict.fromkeys(tokens, 0)
    counts.update((r["w"], r["count"]) for r in held.groupBy("w").count().collect())
    return counts


def prepared(templates: dict[str, str], counts: dict[str, int], threshold: float) -> list[dict]:
    """Each template's distinct words in the global order, how many it needs, its prefix, and its blocks' length."""
    out = []
    for label, text in sorted(templates.items()):
        order = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
        if order:
            need = max(1, math.ceil(threshold * len(order) - 1e-9))
            out.append({"label": label, "words": order, "need": need, "prefix": order[: len(order) - need + 1], "span": math.ceil(len(text.split()) / threshold - 1e-9)})
    return out


def _met(ready: list[dict], ws: Column, held: Column) -> Column:
    """The (label, start, containment) of the templates met in a text of words ws, of which `held` are
    the prefix and phrase words."""
    literal = F.array(*(F.struct(F.lit(t["label"]).alias("label"), strings(t["words"]).alias("words"), F.lit(t["need"]).alias("need"), strings(t["prefix"]).alias("prefix"), F.lit(t["span"]).alias("span")) for t in ready))
    shared = lambda t, start, n: F.size(F.array_intersect(t["words"], F.slice(ws, start + 1, n)))

    def around(t: Column, q: Column) -> Column:
        """The best block over place q: (shared words, less its start)."""
        first, last = F.greatest(F.lit(0), q - t["span"] + 1), F.least(q, F.size(ws) - 1)
        blocks = F.transform(F.sequence(first, last), lambda i: F.struct(shared(t, i, t["span"]).alias("n"), (-i).alias("at")))
        return F.when(shared(t, first, q + t["span"] - first) >= t["need"], F.array_max(blocks))

    def best(t: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.array_contains(t["prefix"], F.get(ws, i)))
        top = F.array_max(F.transform(places, lambda q: around(t, q)))
        return F.struct(t["label"].alias("label"), (-top["at"]).alias("start"), F.when(top["n"] >= t["need"], top["n"] / F.size(t["words"])).alias("containment"))

    looked = F.filter(literal, lambda t: F.arrays_overlap(t["prefix"], held) & (F.size(F.array_intersect(t["words"], ws)) >= t["need"]))
    return F.filter(F.transform(looked, best), lambda m: m["containment"].isNotNull())


def _places(phrases: dict[str, str], ws: Column, held: Column) -> Column:
    """The (place, label) of every phrase in the words ws."""

    def places(p: list[str], label: str) -> Column:
        fits = lambda i: reduce(Column.__and__, (F.get(ws, i + j) == w for j, w in enumerate(p)))
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(ws) - 1), fits), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    split = [(phrase.split(), label) for phrase, label in phrases.items()]
    out = [F.when(F.size(F.array_except(strings(p), held)) == 0, places(p, label)) for p, label in split if p]
    none = F.expr("cast(array() as array<struct<at:int,label:string>>)")
    return F.concat(none, *(F.coalesce(x, none) for x in out))


def scan_licenses(
    docs: DataFrame, text_col: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD
) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and
    `matches`: of every template met its label, and the start and containment of its best block."""
    counts = corpus_order(docs, text_col, {w for t in templates.values() for w in t.split()})
    ready = prepared(templates, counts, threshold)
    kept = [c for c in docs.columns if c not in OUT]
    wanted = sorted({w for t in ready for w in t["prefix"]} | {w for p in phrases for w in p.split()})
    none = F.expr("cast(array() as array<struct<label:string,start:int,containment:double>>)")
    ws, held = F.col("__ws"), F.col("__held")
    split = docs.withColumn("__ws", words(text_col)).withColumn("__held", F.array_intersect("__ws", strings(wanted)) if wanted else F.expr("cast(array() as array<string>)"))
    some = F.size(held) > 0
    found = split.withColumns(
        {
            "__n": F.size(ws).cast("long"),
            "__base": F.when(some, _places(phrases, ws, held)).otherwise(F.expr("cast(array() as array<struct<at:int,label:string>>)")),
            "__m": F.when(some, _met(ready, ws, held)).otherwise(none) if ready else none,
        }
    )
    at, own, met = (F.transform("__base", lambda x: x["at"]), F.transform("__base", lambda x: x["label"]), F.transform("__m", lambda x: x["label"]))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        *kept,
        F.col("__n").alias("n_words"),
        F.size("__base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, met)).alias("labels"),
        F.when(F.size("__base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("__m", lambda x: x["containment"])), F.lit(0.0))).alias("score"),
        F.col("__m").alias("matches"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle() -> str:
    """DuckDB SQL for the query: every block that begins with a template's word, without filters."""
    rows = ", ".join(f"('{k}', {[*dict.fromkeys(v.split())]}, {math.ceil(len(v.split()) / THRESHOLD - 1e-9)})" for k, v in TEMPLATES.items())
    base = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE ws[i:i + {len(p.split()) - 1}] = {p.split()}"
        for p, label in PHRASES.items()
    )
    return rf"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
d AS (SELECT doc_id, low, regexp_extract_all(low, '{WORD}') AS ws FROM t),
b AS ({base}),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l FROM b GROUP BY doc_id),
tpl(label, tw, span) AS (VALUES {rows}),
tw AS (SELECT label, span, len(tw) AS n, unnest(tw) AS w FROM tpl),
place AS (SELECT doc_id, label, span, n, i, p.w FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM d) p JOIN tw ON p.w = tw.w),
m AS (
  SELECT x.doc_id, x.label, x.n, count(DISTINCT y.w) AS shared
  FROM place x JOIN place y ON x.doc_id = y.doc_id AND x.label = y.label AND y.i >= x.i AND y.i < x.i + x.span
  GROUP BY x.doc_id, x.label, x.n, x.i HAVING count(DISTINCT y.w) >= ceil({THRESHOLD} * x.n - 1e-9)
),
best AS (SELECT doc_id, max(shared / n::DOUBLE) AS c FROM m GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT doc_id, label FROM b) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
  coalesce(bl.s, '') AS base_labels, coalesce(al.s, '') AS labels, CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id)
"""
