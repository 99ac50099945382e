"""License scan: phrases by place, and an exact set-similarity join of text blocks with license templates.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lowered. A block is
``block_words(templates)`` consecutive words, a new one every half block, so any
passage as long as the longest template lies whole in one of them, however its
lines are broken. A block meets a template if it has at least ``PERCENT`` of 100
of the template's distinct words; the join finds every such pair:

1. Only words of templates can match, so a block is its set of those words; the
   length filter drops blocks with fewer than the smallest overlap asked for.
2. Words are ordered by their frequency over all blocks left, rare ones first.
3. Prefix filter: a pair with overlap o shares a word among the first
   ``|set| - o + 1`` of either set. Only those words are joined.
4. Positional filter: what stands behind the shared word on either side must
   suffice for the overlap. Survivors are counted in full.

Templates are a parameter and small; their words are broadcast, ``MAX_WORDS`` at
most, and the join keeps the blocks where they are, so a word that a third of
all blocks have is no hot key.

Null and empty texts have no words, no labels and score 0. Texts of any length
are read whole. The score is 1 with a phrase, else the largest part of a
template that a found block has, else 0. Repeated rows and null ids keep rows of
their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import materialise, table

PERCENT, MAX_WORDS = 80, 10_000
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices as their licenses word them, with labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "to deal in the software without restriction": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation": "gpl",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights": "cc0",
}
#: A-Z lowered, what is no word character is a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_WORDS).split()


def needed(size: int, percent: int) -> int:
    """Words that a block must share with a template of ``size`` distinct words."""
    return -(-size * percent // 100)


def block_words(templates: dict[str, str]) -> int:
    return 2 * max([64, *(len(t.split()) for t in templates)])


def _extract(phrases: dict[str, str], templates: dict[str, str], percent: int):
    """Per row: its words counted, places of phrases, and of each block that may meet a template the template words it has."""
    sets = [frozenset(t.encode().split()) for t in templates]
    known, least, width = frozenset().union(*sets), min([needed(len(s), percent) for s in sets], default=1 << 30), block_words(templates)
    spelt = [(p.encode().split(), label) for p, label in phrases.items()]
    marks = known | {p[0] for p, _ in spelt}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in batch.column(1):
                words = words_of(text.as_py())
                seen = [(i, w) for i, w in enumerate(words) if w in marks]
                places = [(i, label) for i, w in seen for p, label in spelt if w == p[0] and words[i : i + len(p)] == p]
                starts = [i for i, _ in places]
                halves: list[set[bytes]] = [set() for _ in range(-(-len(words) * 2 // width) + 1)]
                for i, w in seen:
                    if w in known:
                        halves[2 * i // width].add(w)
                blocks = [a | b for a, b in zip(halves[:-1], halves[1:], strict=True)]
                row = len(words), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places})
                for column, value in zip(out, (*row, [sorted(x.decode() for x in b) for b in blocks if len(b) >= least]), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "phrases", "blocks"],
            )

    return extract


def similar_blocks(blocks: DataFrame, templates: dict[str, str], percent: int = PERCENT) -> DataFrame:
    """(row, label, part): all pairs of a block (row, set) and a template of which it has at least ``percent`` of 100."""
    spark = blocks.sparkSession
    sets = [(label, sorted(set(t.split())), needed(len(set(t.split())), percent)) for t, label in templates.items()]
    if sum(len(s) for _, s, _ in sets) > MAX_WORDS:
        raise ValueError(f"templates have over {MAX_WORDS} words")
    counted = {r["word"]: r["n"] for r in blocks.select(F.explode("set").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # template words only
    order = sorted({w for _, s, _ in sets for w in s}, key=lambda w: (counted.get(w, 0), w))
    rank, least = {w: i for i, w in enumerate(order)}, min([o for _, _, o in sets], default=1)
    postings = [
        (rank[w], at, len(s), o, [rank[x] for x in s], label)
        for label, s, o in sets for at, w in enumerate(sorted(s, key=rank.__getitem__)) if at <= len(s) - o
    ]
    index = spark.createDataFrame(postings, "word int, at int, size int, need int, words array<int>, label string")
    ranks = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)]) if rank else F.create_map().cast("map<string,int>")
    ordered = blocks.select("row", F.array_sort(F.transform("set", lambda w: ranks[w])).alias("own"))
    prefix = ordered.select("row", "own", F.posexplode(F.slice("own", 1, F.size("own") - least + 1)).alias("pos", "word"))
    met = prefix.join(F.broadcast(index), "word")
    met = met.where((F.size("own") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("at"), F.size("own") - F.col("pos")) - 1 >= F.col("need")))
    # a pair that shares several words of its prefixes is counted at the first of them
    first = F.element_at(F.array_intersect("own", "words"), 1) == F.col("word")
    shared = F.size(F.array_intersect("own", "words"))
    return met.where(first & (shared >= F.col("need"))).select("row", "label", (shared / F.col("size")).alias("part"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, phrases array<string>, blocks array<array<string>>"
    read = docs.select("doc_id", "text").mapInArrow(_extract(phrases, templates, percent), schema)
    rows = materialise(read.withColumn("row", F.monotonically_increasing_id()))
    blocks = rows.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("set"))
    found = similar_blocks(blocks, templates, percent).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("part").alias("part"))
    named = rows.drop("blocks").join(found, "row", "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return named.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("phrases")).alias("base_labels"),
        joined(F.concat("phrases", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"),
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values(texts: dict[str, str]) -> str:
    return ", ".join(f"('{t}', '{label}')" for t, label in texts.items())


ORACLE_SQL = rf"""
WITH p(phrase, label) AS (VALUES {_values(PHRASES)}),
t AS (SELECT list_distinct(string_split(text, ' ')) AS ts, label FROM (VALUES {_values(TEMPLATES)}) v(text, label)),
w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
hits AS (SELECT r, i - 1 AS i, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w), p WHERE w[i] = split_part(phrase, ' ', 1) AND array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
base AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS ls FROM hits GROUP BY r),
b AS (SELECT r, list_distinct(w[i + 1:i + {block_words(TEMPLATES)}]) AS bs FROM (SELECT r, w, unnest(range(0, len(w), {block_words(TEMPLATES) // 2})) AS i FROM w)),
m AS (SELECT r, label, len(list_intersect(bs, ts)) / len(ts) AS part, len(list_intersect(bs, ts)) AS o, len(ts) AS k FROM b, t),
f AS (SELECT r, list(DISTINCT label) AS ls, max(part) AS part FROM m WHERE 100 * o >= {PERCENT} * k GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo AS first_word, hi AS last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []::VARCHAR[]), coalesce(f.ls, []::VARCHAR[])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(f.part, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN f USING (r)
"""
