"""License scans by diagonal voting, in DataFrame operations only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelforge.llm.base import col, query, table

# The phrases that name a license, with their labels.
BASE = (
    ("gpl", "GNU General Public License"),
    ("apache", "Apache License"),
    ("cc-by", "CC BY"),
    ("mit", "MIT License"),
)
# Names of versions and relatives, and the sentences by which licenses are granted.
NOTICES = (
    ("agpl", "GNU Affero General Public License"),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-nd", "CC BY-ND"),
    ("cc-by-sa", "CC BY-SA"),
    ("cc0", "CC0 1.0 Universal"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mpl-2.0", "Mozilla Public License, v. 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
            " the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
            " Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
            " hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
            " documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST, SEED = 5, 2
SLACK, SHARE = 3, 0.8
MOST_GRAMS = 1 << 16


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null has none.

    Other letters may be folded, too: no word of a template has any, so that
    only the sign for degrees Kelvin, which folds to k, has to be kept apart.
    """
    kept = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u2126"))
    return F.array_remove(F.split(F.lower(kept), BETWEEN), "")


def gram_length(n: int) -> int:
    """A template of fewer than ten words is one gram, which stands whole or not at all: a version is one word."""
    return LONGEST if n >= 2 * LONGEST else n


def gram_table(spark: SparkSession, templates: Sequence[tuple[str, str, bool]]) -> tuple[DataFrame, int]:
    """Every k-gram of every template with its position, and their number."""
    listed, many = [], 0
    for i, (label, text, base) in enumerate(templates):
        own = words_of(text)
        if len(own) < SEED:
            raise ValueError(f"a template needs {SEED} words: {text!r}")
        k = gram_length(len(own))
        many += len(own) - k + 1
        listed.append(F.struct(
            F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(k).alias("k"),
            F.lit(len(own)).alias("length"), F.array(*[F.lit(w) for w in own]).alias("tw"),
        ))
    one = spark.range(1).select(F.inline(F.array(*listed)))
    grams = one.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("k"))).alias("tpos"))
    gram = F.array_join(F.slice("tw", F.col("tpos") + 1, F.col("k")), " ")
    return grams.select("template", "label", "base", "k", "length", "tpos", gram.alias("gram"), _seed("tw", F.col("tpos")).alias("key")), many


def _seed(array: str, at: Column) -> Column:
    return F.xxhash64(*[F.get(array, at + i) for i in range(SEED)])


def votes(docs: DataFrame, id_: str, text: str, templates: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """One row per place where a k-gram of a template stands in a text, and one with ``at`` = -1 per text.

    Every position of every text is hashed by its first words and joined to
    the grams of the templates; the join compares the rest of the words. The
    grams are broadcast as long as their number, known when the query is
    built, stays below ``MOST_GRAMS``; with more, the planner decides.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(id_).alias("id"), words(col(text)).alias("w"))
    # The outer form: for the other the planner tests the size of the array first, and splits every text twice.
    places = rows.select("row", "id", F.size("w").cast("long").alias("n_words"), "w", F.explode_outer(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))
    places = places.withColumn("key", F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(_seed("w", F.col("at"))))
    grams, many = gram_table(spark, templates)
    none = {"template": F.lit(-1), "label": F.lit(""), "base": F.lit(False), "k": F.lit(0), "length": F.lit(0), "tpos": F.lit(0),
            "gram": F.lit(""), "key": F.lit(0).cast("long")}
    grams = grams.unionByName(spark.range(1).select(*[c.alias(n) for n, c in none.items()]))
    grams = F.broadcast(grams) if many <= MOST_GRAMS else grams
    gram = F.array_join(F.slice("w", F.col("at") + 1, F.col("k")), " ")
    same = F.when(F.col("template") < 0, F.col("at") < 0).otherwise((F.col("at") >= 0) & (gram == F.col("gram")))
    found = places.join(grams, (places["key"] == grams["key"]) & same)
    return found.select("row", "id", "n_words", "template", "label", "base", "k", "length", "at", "tpos")


def spans(found: DataFrame, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """Votes joined to spans: ``(row, id, n_words, template, label, base, first, last, share)``.

    Votes on one diagonal (position in the text less position in the
    template) belong together; diagonals at most ``slack`` apart, which differ
    by words put in or left out, are merged. A span counts if its share, the
    words of the template that its votes cover, divided by the words of the
    template or of the span, whichever are more, reaches ``share``.
    """
    key = ["row", "id", "n_words", "template", "label", "base", "k", "length"]
    diagonal = (F.col("at") - F.col("tpos")).alias("diagonal")
    lines = found.groupBy(*key, diagonal).agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("tpos").alias("tset")
    )
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > F.lit(slack), F.lit(True))
    # A template of one gram is whole at every vote; its places are never merged.
    lines = lines.withColumn("new", F.when(far | (F.col("k") == F.col("length")), 1).otherwise(0))
    lines = lines.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = lines.groupBy(*key, "part").agg(
        F.min("first").alias("first"), (F.max("last") + F.col("k") - 1).alias("last"), F.flatten(F.collect_list("tset")).alias("tset")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("tset", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    extent = F.greatest(F.col("length"), F.col("last") - F.col("first") + 1)
    merged = merged.withColumn("share", F.when(F.col("template") < 0, 0.0).otherwise(covered / extent))
    return merged.where((F.col("template") < 0) | (F.col("share") >= F.lit(share))).drop("tset", "part", "k", "length")


def scanned(docs: DataFrame, id_: str = "doc_id", text: str = "text", base: Sequence[tuple[str, str]] = BASE,
            notices: Sequence[tuple[str, str]] = NOTICES, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``base`` phrases count where their words stand consecutively: n_base
    places, the smallest and largest start (null without any), their labels.
    ``labels`` adds those of ``notices``, which may be changed by a few
    words. ``score`` is the largest share of a span, 1 for a base phrase.
    ``spans`` lists (label, first, last, share), words from 0, ends included.

    A null or empty text has no words and no places; null ids are kept;
    repeated rows and ids are separate rows; an empty table gives none. Other
    columns of ``docs`` are not looked at, whatever their names.
    """
    templates = [(label, phrase, True) for label, phrase in base] + [(label, phrase, False) for label, phrase in notices]
    found = spans(votes(docs, id_, text, templates), slack, share)
    real = F.col("template") >= 0
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return found.groupBy("row", "id", "n_words").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        listed(F.col("base")).alias("base_labels"), listed(real).alias("labels"), F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(real, F.struct("first", "last", "label", "share")))).alias("spans"),
    ).drop("row")


def _sql() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    listed = [*[(a, b, True) for a, b in BASE], *[(a, b, False) for a, b in NOTICES]]
    values = ",\n".join(f"({i}, '{label}', {base}, {quoted(words_of(text))})" for i, (label, text, base) in enumerate(listed))
    return rf"""
WITH t0(template, label, base, tw) AS (VALUES {values}),
t AS (SELECT template, label, base, tw, len(tw) AS length, CASE WHEN len(tw) >= {2 * LONGEST} THEN {LONGEST} ELSE len(tw) END AS k FROM t0),
g AS (
  SELECT template, label, base, length, k, p AS tpos, array_to_string(tw[p + 1:p + k], ' ') AS gram
  FROM (SELECT *, unnest(range(0, length - k + 1)) AS p FROM t)),
d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT row, w, unnest(range(0, len(w))) AS a FROM d),
h AS (SELECT row, a, q.k, array_to_string(w[a + 1:a + q.k], ' ') AS gram FROM p, (SELECT DISTINCT k FROM t) q WHERE a + q.k <= len(w)),
v AS (SELECT row, template, label, base, length, h.k, a, tpos, a - tpos AS dia FROM h JOIN g ON h.k = g.k AND h.gram = g.gram),
ld AS (
  SELECT row, template, label, base, length, k, dia, min(a) AS f, max(a) AS l, list(DISTINCT tpos) AS ts
  FROM v GROUP BY row, template, label, base, length, k, dia),
mk AS (
  SELECT *, CASE WHEN k = length OR coalesce(dia - lag(dia) OVER (PARTITION BY row, template ORDER BY dia) > {SLACK}, true) THEN 1 ELSE 0 END AS new FROM ld),
pt AS (SELECT *, sum(new) OVER (PARTITION BY row, template ORDER BY dia ROWS UNBOUNDED PRECEDING) AS part FROM mk),
sp AS (
  SELECT row, label, base, length, min(f) AS f, max(l) + k - 1 AS l,
    len(list_distinct(flatten(list_transform(flatten(list(ts)), lambda x: range(x, x + k))))) AS covered
  FROM pt GROUP BY row, template, label, base, length, k, part),
ok AS (SELECT *, covered / CAST(greatest(length, l - f + 1) AS DOUBLE) AS share FROM sp WHERE covered / CAST(greatest(length, l - f + 1) AS DOUBLE) >= {SHARE}),
r AS (
  SELECT row, count(*) FILTER (base) AS n_base, min(f) FILTER (base) AS first_word, max(f) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(share) AS score FROM ok GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN r ON d.row = r.row"""


@query("op13_licenses", sql=_sql())
def op13_licenses(spark, folder):
    """All documents against all templates."""
    got = scanned(table(spark, folder, "documents"))
    return got.withColumnRenamed("id", "doc_id").drop("spans")
