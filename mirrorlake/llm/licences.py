"""Operator 8: license scans by diagonal voting.

All rolling hashes of GRAM words of every text are joined with those of the license templates. Hits are
summed by offset diagonal (text position minus template position), neighbouring diagonals (insertions and
deletions up to GAP words) are merged, and the merged span is verified by the share of the template's
grams that it holds. The templates are a fixed short list, so their side of the join is broadcast;
its size does not grow with the data. Only rows with hits are shuffled. Built-in functions only.

Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. Plain phrases are found besides.

Defined cases: a null or empty text has no words, no labels and score 0; null ids and repeated rows are
kept, each with its own result (equal rows have equal results); very long texts are scanned whole;
an empty table gives an empty result; other columns are ignored.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

GRAM = 4
GAP = 3
#: Share of a template's grams that a span must hold.
LEAST = 0.6

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Label and wording of well-known license notices.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License Version 2 0"),
    ("apache", "Licensed under the Apache License Version 2 0 the License you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY NC 4 0"),
    ("cc-by", "Licensed under CC BY 4 0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4 0 International License"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0"),
)

_WORDS = "array_remove(split(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+'), '')"


def words_sql(text: str) -> str:
    return _WORDS.format(t=text)


def grams(templates=TEMPLATES) -> list[tuple[str, int, int, int, str]]:
    """(label, template, grams of the template, position, gram) of every template."""
    out = []
    for k, (label, wording) in enumerate(templates):
        words = wording.lower().split()
        n = len(words) - GRAM + 1
        out += [(label, k, n, i, " ".join(words[i : i + GRAM])) for i in range(n)]
    return out


def _gram_hash(w: str) -> str:
    return f"xxhash64({', '.join(f'{w}[i{f' + {j}' if j else ''}]' for j in range(GRAM))})"


def votes(rows: DataFrame, keys: list[str], words="words", templates=TEMPLATES) -> DataFrame:
    """For each row of keys and each template with a verified span: keys, label, share, first, last."""
    spark = rows.sparkSession
    wording = spark.createDataFrame(grams(templates), "label string, template int, size int, place int, gram string")
    wording = wording.withColumn("gram", F.expr(f"xxhash64({', '.join(f"split(gram, ' ')[{j}]" for j in range(GRAM))})"))
    hashes = F.expr(f"if(size({words}) < {GRAM}, cast(array() as array<bigint>), transform(sequence(0, size({words}) - {GRAM}), i -> {_gram_hash(words)}))")
    hits = rows.select(*keys, F.posexplode(hashes).alias("at", "gram")).join(F.broadcast(wording), "gram")
    lines = (
        hits.withColumn("diagonal", F.col("at") - F.col("place"))
        .groupBy(*keys, "label", "template", "size", "diagonal")
        .agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    )
    by = Window.partitionBy(*keys, "template").orderBy("diagonal")
    lines = lines.withColumn("step", F.col("diagonal") - F.lag("diagonal").over(by)).withColumn(
        "span", F.sum(F.when(F.col("step") <= GAP, 0).otherwise(1)).over(by)
    )
    spans = lines.groupBy(*keys, "label", "template", "size", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    return spans.withColumn("share", F.col("held") / F.col("size")).where(F.col("share") >= LEAST)


def scan(docs: DataFrame, text="text", doc_id="doc_id", templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the verified spans."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.expr(f"xxhash64(`{text}`)").alias("h"), F.expr(words_sql(f"`{text}`")).alias("words")
    )
    test = " or ".join(
        "(" + " and ".join(f"words[i + {j}] <=> '{x}'" for j, x in enumerate(p.split())) + ")" for p, _ in PHRASES
    ).replace("[i + 0]", "[i]")
    # get() is null beyond the end, and sequence(0, -1) would count down, hence the guard
    test = test.replace("words[", "get(words, ").replace("] <=>", ") <=>")
    heads = ", ".join(f"'{p.split()[0]}'" for p, _ in PHRASES)
    places = f"if(arrays_overlap(words, array({heads})), filter(sequence(0, size(words)), i -> {test}), cast(array() as array<int>))"
    label = "case " + " ".join(f"when get(words, i) = '{p.split()[0]}' then '{label}'" for p, label in PHRASES) + " end"
    base = rows.select(
        "doc_id", "h", F.expr("cast(size(words) as bigint)").alias("n_words"), F.expr(places).alias("places"), "words"
    ).select("doc_id", "h", "n_words", "places", F.expr(f"array_distinct(transform(places, i -> {label}))").alias("base"))
    found = (
        votes(rows, ["doc_id", "h"], templates=templates)
        .groupBy("doc_id", "h")
        .agg(
            F.collect_set("label").alias("more"),
            F.max("share").alias("score"),
            F.sort_array(F.collect_list(F.struct("first", F.expr(f"last + {GRAM}").alias("end"), "label", "share"))).alias("spans"),
        )
        .alias("f")
    )
    out = base.alias("b").join(found, (F.col("b.h") == F.col("f.h")) & F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    return out.select(
        "b.doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.when(F.size("places") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).cast("double").alias("score"),
        "spans",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    phrase = " OR ".join(
        "(" + " AND ".join(f"words[i{f' + {j}' if j else ''}] = '{x}'" for j, x in enumerate(p.split())) + ")" for p, _ in PHRASES
    )
    label = "CASE " + " ".join(f"WHEN words[i] = '{p.split()[0]}' THEN '{label}'" for p, label in PHRASES) + " END"
    values = ", ".join(f"('{a}', {b}, {c}, {d}, '{e}')" for a, b, c, d, e in grams())
    return rf"""
WITH t(label, template, size, place, gram) AS (VALUES {values}),
w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT k, words, unnest(range(1, len(words) + 1)) AS i FROM w),
p AS (SELECT k, count(*)::BIGINT AS n_base, min(i - 1)::BIGINT AS first_word, max(i - 1)::BIGINT AS last_word,
             list(DISTINCT {label}) AS base FROM i WHERE {phrase} GROUP BY k),
g AS (SELECT k, i - 1 AS pos, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] AS gram FROM i WHERE i + {GRAM} - 1 <= len(words)),
h AS (SELECT k, label, template, size, pos - place AS diagonal, place FROM g JOIN t USING (gram)),
d AS (SELECT k, label, template, size, diagonal, list(DISTINCT place) AS places FROM h GROUP BY ALL),
s AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY k, template ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM d),
m AS (SELECT *, sum(fresh) OVER (PARTITION BY k, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM s),
v AS (SELECT k, label, len(list_distinct(flatten(list(places)))) / size::DOUBLE AS share FROM m GROUP BY k, label, template, size, span),
f AS (SELECT k, list(DISTINCT label) AS more, max(share) AS score FROM v WHERE share >= {LEAST} GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
       coalesce(score, CASE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)::DOUBLE AS score
FROM w LEFT JOIN p USING (k) LEFT JOIN f USING (k)"""


ORACLE = _sql()
