"""Operator 12 [native]: licence scans by an exact set-similarity join of text blocks with templates.

Words are what stands between other ASCII characters than letters and digits, after lower-casing A-Z. A text is found in two ways:

* A phrase, where its words stand one after another.
* A template, where a block of the text holds at least ``NUM`` of ``DEN`` of its distinct words. The blocks of a template of n words are 2n words
  long, one at every nth word, so each stretch of n words lies whole in a block; the last ones are shorter.

The join is exact and follows the filters of set-similarity joins. The words of all templates have one global order, by the number of documents that hold
them, the rarest first (ties by name); it is counted over all documents. With an overlap of o words required of a template of t words:

* Prefix: only the first t - o + 1 words of a template are indexed, and a block must hold one of them among the first b - o + 1 of its own b
  words of the templates' vocabulary. Other words of a block never count towards an overlap.
* Length: b >= o.
* Position: a hit at place i of the template and j of the block allows 1 + min(t - 1 - i, b - 1 - j) shared words, which must reach o.

What passes is verified by the overlap. All templates are a parameter, so the index is a constant of the plan; texts are read and split
where they lie and nothing but the counts of the vocabulary is shuffled. Rows that hold none of the indexed words are left at the first test.

Null and empty texts have no words: no labels, score 0, nulls for places. Texts of any length are read whole. Rows that share an id, or repeat, are
judged one by one, each in its own row. No rows give no rows. ``scan`` adds one struct column, so no column of the input clashes with its inner names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NUM, DEN = 80, 100
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# wordings that licences prescribe, without punctuation
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("creative-commons", "this work is licensed under a creative commons attribution international license"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def order(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> list[str]:
    """The words of the templates, by the number of documents that hold them, the rarest first; one row a word reaches the driver."""
    own = vocabulary(templates)
    held = docs.select(F.explode(F.array_intersect(words(F.col(text)), strings(own))).alias("w")).groupBy("w").count()
    count = dict(held.collect())
    return sorted(own, key=lambda w: (count.get(w, 0), w))


def places(w: Column, phrase: list[str]) -> Column:
    """Where the words of a phrase stand one after another."""
    last = F.size(w) - len(phrase)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    test = lambda i: [F.get(w, i + k) == x for k, x in enumerate(phrase)]

    def all_of(i: Column) -> Column:
        out = test(i)[0]
        for c in test(i)[1:]:
            out &= c
        return out

    return F.filter(at, all_of)


def blocks_of(at: Column, n: int) -> Column:
    """Numbers of the blocks of 2n words that hold the word at a place."""
    k = F.floor(at / n).cast("int")
    return F.filter(F.array(k - 1, k), lambda x: x >= 0)


def scan(df: DataFrame, ranks: list[str], text: str = "text", name: str = "licenses", templates=TEMPLATES, phrases: dict[str, str] = PHRASES, num: int = NUM, den: int = DEN) -> DataFrame:
    """Adds ``name``: n_words, found (label, place of a phrase) and matches (label, block, size, containment) of the templates."""
    rank = {w: i for i, w in enumerate(ranks)}
    index: dict[str, list[tuple[int, int]]] = {}  # word -> (template, place in its order)
    sets, needed = [], []
    for k, (_, t) in enumerate(templates):
        own = sorted({rank[w] for w in t.split()})
        sets.append(own)
        needed.append(-(-num * len(own) // den))
        for i, r in enumerate(own[: len(own) - needed[k] + 1]):
            index.setdefault(ranks[r], []).append((k, i))
    w, inner = F.col("__w"), df.withColumn("__w", words(F.col(text)))
    nothing = F.array().cast("array<struct<label:string,place:int>>")

    def standing(phrase: list[str], label: str) -> Column:
        at = F.transform(places(w, phrase), lambda i: F.struct(F.lit(label).alias("label"), i.alias("place")))
        return F.when(F.array_contains(w, max(phrase, key=len)), at).otherwise(nothing)

    found = [standing(p.split(), label) for p, label in phrases.items()]
    none = F.array().cast("array<struct<label:string,block:int,size:int,containment:double>>")
    hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("at"))), lambda h: h["w"].isin(*index))
    vocab = F.create_map(*[c for x, r in rank.items() for c in (F.lit(x), F.lit(r))])

    def matches(k: int) -> Column:
        label, own, o, n = templates[k][0], sets[k], needed[k], len(templates[k][1].split())
        first = [ranks[r] for r in own[: len(own) - o + 1]]

        ours = F.array(*map(F.lit, own))
        at = F.transform(F.filter("__h", lambda h: h["w"].isin(*first)), lambda h: blocks_of(h["at"], n))
        held = lambda b: F.filter(F.slice(w, b * n + 1, 2 * n), lambda x: x.isin(*rank))
        short = F.transform(F.array_distinct(F.flatten(at)), lambda b: F.struct(b.alias("block"), F.array_sort(F.transform(F.array_distinct(held(b)), lambda x: vocab[x])).alias("b")))
        short = F.filter(short, lambda s: F.size(s["b"]) >= o)
        both = F.transform(short, lambda s: F.struct(s["block"].alias("block"), s["b"].alias("b"), F.array_intersect(ours, s["b"]).alias("t")))
        # the first word that a block and the template share, at place i of the template and j of the block
        i, j = (lambda s: F.array_position(ours, F.get(s["t"], F.lit(0))) - 1), (lambda s: F.array_position(s["b"], F.get(s["t"], F.lit(0))) - 1)
        near = F.filter(both, lambda s: 1 + F.least(len(own) - 1 - i(s), F.size(s["b"]) - 1 - j(s)) >= o)
        full = F.filter(near, lambda s: F.size(s["t"]) >= o)
        return F.transform(full, lambda s: F.struct(F.lit(label).alias("label"), s["block"].alias("block"), F.lit(2 * n).alias("size"), (F.size(s["t"]) / F.lit(float(len(own)))).alias("containment")))

    # rows without an indexed word are done; what is next is a plan of its own, so that no expression is repeated within a lambda
    inner = inner.withColumn("__h", F.when(F.arrays_overlap(w, strings(list(index))), hits))
    tried = F.when(F.size("__h") > 0, F.concat(*[matches(k) for k in range(len(templates))])).otherwise(none)
    out = F.struct(F.size(w).cast("long").alias("n_words"), F.concat(*found).alias("found"), tried.alias("matches"))
    return inner.select(*[F.col(f"`{c}`") for c in df.columns], out.alias(name))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = scan(docs, order(docs)).select("doc_id", "licenses.*")
    base, own = F.array_sort(F.array_distinct(F.col("found.label").cast("array<string>"))), F.col("matches.label").cast("array<string>")
    place = F.col("found.place").cast("array<long>")
    return s.select(
        "doc_id", "n_words", F.size("found").cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("found") > 0, 1.0).otherwise(F.round(F.coalesce(F.array_max("matches.containment"), F.lit(0.0)), 6)).alias("score"),
    )


def _sql() -> str:
    values = ", ".join(f"({k}, '{label}', string_split('{t}', ' '))" for k, (label, t) in enumerate(TEMPLATES))
    phrases = " UNION ALL ".join(
        f"SELECT n, '{label}' AS label, i FROM (SELECT n, w, unnest(range(len(w))) AS i FROM docs) WHERE w[i + 1 : i + {len(p.split())}] = string_split('{p}', ' ')" for p, label in PHRASES.items()
    )
    return f"""WITH docs AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
        base AS ({phrases}),
        templates AS (SELECT k, label, len(t) AS size, list_distinct(t) AS t FROM (VALUES {values}) AS v(k, label, t)),
        blocks AS (SELECT n, label, len(t) AS need, len(list_intersect(list_distinct(w[b * size + 1 : b * size + 2 * size]), t)) AS shared
            FROM (SELECT n, w, label, size, t, unnest(range((len(w) + size - 1) // size)) AS b FROM docs, templates)),
        own AS (SELECT n, label, shared / need AS containment FROM blocks WHERE {DEN} * shared >= {NUM} * need),
        b AS (SELECT n, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY n),
        l AS (SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT n, label FROM base UNION ALL SELECT n, label FROM own) GROUP BY n),
        s AS (SELECT n, round(max(containment), 6) AS score FROM own GROUP BY n)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
            CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS score
        FROM docs LEFT JOIN b USING (n) LEFT JOIN l USING (n) LEFT JOIN s USING (n)"""


SQL = _sql()
