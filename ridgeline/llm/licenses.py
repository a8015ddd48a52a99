"""License scan: exact set-similarity join of text blocks with notice templates (DataFrame functions only)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import LOWER, UPPER, cut, fold, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and their labels, of any length.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("licensed under the mozilla public license version 2 0", "mpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("licensed under the creative commons attribution license", "cc-by"),
    ("licensed under a creative commons attribution sharealike license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial license", "cc-by-nc"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("no part of this publication may be reproduced without prior written permission", "reserved"),
    ("this work has been dedicated to the public domain", "public-domain"),
]
THRESHOLD, CELL = 0.8, 16


def stride(template: str) -> int:
    """Blocks in which a template is looked for start at each multiple of this and are twice as long: one of them holds any stretch of the template's length."""
    out = CELL
    while out < len(template.split()):
        out *= 2
    return out


def words(text: Column) -> Column:
    """Words of the text with A-Z folded; null has none."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def places(w: Column, phrase: str) -> Column:
    """Starts of the places, overlapping ones too, where the phrase's words stand consecutively."""
    tokens = phrase.split()
    at = lambda i: all_of([F.get(w, i + k) == t for k, t in enumerate(tokens)])
    held = all_of([F.array_contains(w, t) for t in tokens])
    return F.when(held, F.filter(F.sequence(F.lit(0), F.size(w) - 1), at)).otherwise(F.array().cast("array<int>"))


def all_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def inverted(spark: SparkSession, index: list[tuple[int, list[str], int, str]]) -> DataFrame:
    """The inverted index: a row for each prefix token of each template, with its place among the template's tokens, which are in global order."""
    array = lambda x: "array(" + ", ".join(f"'{t}'" for t in x) + ")"  # noqa: E731  words hold no quote and no backslash
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [f"('{t}', {s}, {i}, {need}, {array(tokens)}, {array(tokens[: len(tokens) - need + 1])}, {quoted(label)})" for s, tokens, need, label in index for i, t in enumerate(tokens[: len(tokens) - need + 1])]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v(token, stride, place, need, tokens, prefix, label)")


def block_of(m: int):
    """The distinct tokens of the 2 * m cells from cell k on."""
    return lambda k: F.array_distinct(F.flatten(F.slice("cells", k + 1, F.lit(2 * m))))


def found_templates(cells: DataFrame, index: list[tuple[int, list[str], int, str]], order: list[str]) -> DataFrame:
    """r, more (labels) and best (share) of the rows (r, cells) in which a template meets a block.

    index: stride, tokens in global order, need and label of each template."""
    posted = inverted(cells.sparkSession, index)
    parts = []
    for s in sorted({x[0] for x in index}):
        own = [x for x in index if x[0] == s]
        prefixes = strings(sorted({t for _, tokens, need, _ in own for t in tokens[: len(tokens) - need + 1]}))
        least, m = min(x[2] for x in own), s // CELL
        rows = cells.filter(F.arrays_overlap(F.flatten("cells"), prefixes))
        starts = F.sequence(F.lit(0), F.size("cells") - 1, F.lit(m))
        blocks = rows.select("r", F.explode(F.transform(starts, block_of(m))).alias("b"))
        # length: a block of fewer tokens than the least need meets none; what has no prefix token has no posting
        blocks = blocks.filter((F.size("b") >= least) & F.arrays_overlap("b", prefixes)).withColumn("b", F.array_intersect(strings(order), "b"))  # in global order
        parts.append(blocks.select("r", "b", F.lit(s).alias("stride"), F.explode(F.array_intersect("b", prefixes)).alias("token")))
    probes = parts[0]
    for x in parts[1:]:
        probes = probes.unionByName(x)
    met = probes.join(posted, ["stride", "token"])
    room = F.least(F.size("tokens") - F.col("place"), F.size("b") - F.array_position("b", F.col("token")) + 1)  # tokens that both can still share
    first = F.get(F.array_intersect("prefix", "b"), F.lit(0)) == F.col("token")  # a pair meets at its first shared prefix token only
    both = F.size(F.array_intersect("tokens", "b"))
    met = met.filter((F.size("b") >= F.col("need")) & first & (room >= F.col("need"))).filter(both >= F.col("need"))
    return met.groupBy("r").agg(F.collect_set("label").alias("more"), F.max(both / F.size("tokens")).alias("best"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A block is a run of 2s words that starts at a multiple of s, or what is left at the end; s is 16, or the next power of two that is not
    below the template's length, so that some block holds any stretch as long as the template. A template meets a block if the block holds
    at least threshold of the template's distinct words. Tokens are ordered by their frequency in the whole corpus, rarest first; a
    block can meet a template of size m and need n = ceil(threshold * m) only if it holds one of the template's first m - n + 1 tokens
    (prefix), has n of the templates' tokens at all (length), and leaves enough tokens after the first that both share (position). The templates' prefix
    tokens are an inverted index, with which the blocks' tokens are joined; Spark broadcasts it while it is small. What passes is
    counted in full, so that the filters lose nothing. Templates may be of any number and length.

    Texts are read once: a row of a table holds for each cell of 16 words those that templates use. Frequencies and blocks come
    from that table. Documents don't travel, whatever their length or source; only findings are grouped, by document.

    score: 1 if a phrase occurs, else the largest share of a template that meets the threshold, else 0. Null and empty texts have no words,
    empty label strings and score 0; rows that repeat are judged alike.
    """
    phrases = phrases or PHRASES
    plain = [(" ".join(re.findall(WORD, t.translate(str.maketrans(UPPER, LOWER)))), label) for t, label in (TEMPLATES if templates is None else templates)]
    templates = [(t, label) for t, label in plain if t]
    universe = sorted({t for text, _ in templates for t in text.split()})
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    rows = rows.withColumns({f"p{i}": places(F.col("w"), p) for i, p in enumerate(phrases)})
    every = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w"), F.lit(CELL))).otherwise(F.array().cast("array<int>"))
    cells = F.transform(starts, lambda i: F.array_distinct(F.filter(F.slice(F.col("w"), i, F.lit(CELL)), lambda t: t.isin(universe)))) if universe else F.array().cast("array<array<string>>")
    rows = rows.select("id", F.size("w").cast("long").alias("n_words"), every.alias("every"), base.alias("base"), cells.alias("cells"))
    rows = cut(rows.select("id", "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"), "base", "cells").withColumn("r", F.monotonically_increasing_id()))

    if templates:
        # a row for each word of the templates reaches the driver, which holds these words already
        held = rows.select(F.explode(F.array_distinct(F.flatten("cells"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        n = {x["token"]: x["n"] for x in held.collect()}
        order = sorted(universe, key=lambda t: (n.get(t, 0), t))
        rank = {t: i for i, t in enumerate(order)}
        index = []
        for text, label in templates:
            tokens = sorted(set(text.split()), key=rank.__getitem__)
            index.append((stride(text), tokens, math.ceil(threshold * len(tokens) - 1e-9), label))
        out = rows.drop("cells").join(found_templates(rows.select("r", "cells"), index, order), "r", "left")
    else:
        out = rows.withColumns({"more": F.lit(None).cast("array<string>"), "best": F.lit(None).cast("double")})
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        text(F.col("base")).alias("base_labels"),
        text(F.concat("base", more)).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    lists = ", ".join(f"({stride(x)}, [{', '.join(repr(t) for t in sorted(set(x.split())))}], '{label}')" for x, label in TEMPLATES)
    spots = [f"list_filter(range(0, len(w)), lambda i: {' AND '.join(f'''w[i + {k + 1}] = '{t}' ''' for k, t in enumerate(p.split()))})" for p in PHRASES]
    held = ", ".join(f"CASE WHEN len({s}) > 0 THEN '{label}' END" for s, label in zip(spots, PHRASES.values(), strict=True))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS (SELECT r, doc_id, w, list_concat({', '.join(spots[:2])}, {spots[2]}) AS every, list_filter([{held}], lambda x: x IS NOT NULL) AS base FROM d),
t AS (SELECT * FROM (VALUES {lists}) AS v(s, tokens, label)),
k AS (SELECT r, w, s, unnest(range(0, len(w), s)) AS i FROM d, (SELECT DISTINCT s FROM t)),
b AS (SELECT r, s, list_distinct(w[i + 1 : i + 2 * s]) AS b FROM k),
m AS (SELECT r, label, len(list_intersect(tokens, b)) / len(tokens)::DOUBLE AS share FROM b JOIN t ON b.s = t.s WHERE len(list_intersect(tokens, b)) >= ceil({THRESHOLD} * len(tokens) - 1e-9)),
g AS (SELECT r, list(label) AS more, max(share) AS best FROM m GROUP BY r)
SELECT p.doc_id, len(w)::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
       CASE WHEN len(every) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM p LEFT JOIN g USING (r)
"""


SQL = _sql()
