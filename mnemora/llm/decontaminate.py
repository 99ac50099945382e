"""Benchmark decontamination by winnowing (DataFrame functions only).

Of every ``WINDOW - K + 1`` consecutive ``K``-gram hashes the minimum is kept
(the rightmost of equal minima), for test items and for documents alike; a
position that several windows choose is kept once, so about two positions in
``WINDOW - K + 2`` stay. Equal windows of ``WINDOW`` words keep the same hash at
the same place, so every shared window shares a fingerprint. Fingerprints of
documents and items are joined on the hash alone; each hit is then extended
word by word to the left and to the right, and counts if it reaches ``WINDOW``
words. Extended hits that overlap unite. Items of fewer words than ``WINDOW``
are one window of their own length and are met by the hash of that many words,
in the same pass.

A fingerprint is 34 bits of hash beside the 30 bits of its position, so a
minimum carries its place; words decide, hashes only propose.

The items' fingerprints are counted; up to ``BROADCAST_ROWS`` they are
broadcast (with ``2 * WINDOW - K`` words of context each) and documents stream
past them without a shuffle. Beyond, both sides are joined by shuffle on the
fingerprint, documents that have one fetch their words again.

Words: A-Z lowered, maximal runs of a-z, 0-9 and everything beyond ASCII. Null
and empty texts have no words and no hits; items without words never occur; an
item without an id marks words but is not named. Repeated items count once,
repeated documents each get their row, null ids too. Empty tables: no rows, or
no hits. Extra columns are ignored, also those named like this module's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import lower_ascii, table

WINDOW, K = 13, 8
#: The words to the left and to the right of a fingerprint's start that a window through it may have.
LEFT, RIGHT = WINDOW - K, WINDOW
POSITION = (1 << 30) - 1
BROADCAST_ROWS = 200_000


def _any_of(*codes: int) -> str:
    """A run of these characters; a class of single ones is a bit set to Java's matcher, one of ranges isn't."""
    return "[" + "".join(f"\\x{c:02X}" for c in codes) + "]+"


_BREAK = _any_of(*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
_BREAK_ANY_CASE = _any_of(*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BREAK), "")


def _count(text: Column) -> Column:
    pieces = F.split(F.coalesce(text, F.lit("")), _BREAK_ANY_CASE)
    return F.size(F.array_remove(pieces, "")).cast("long")


def _run(name: str, x: Column, i: Column, n: int) -> list[Column]:
    """``x``, the i-th of a list, and the n - 1 values after it."""
    return [x, *[F.get(name, i + j) for j in range(1, n)]]


def _grams(n: int, salt: int) -> Column:
    """34 bits of the hash of each n words over its position; later positions are smaller, so the rightmost of equal hashes is the minimum."""
    made = F.transform("wh", lambda x, i: F.xxhash64(*_run("wh", x, i, n), F.lit(salt)).bitwiseAND(F.lit(~POSITION)).bitwiseOR(F.lit(POSITION) - i))
    return F.slice(made, 1, F.greatest(F.size("wh") - (n - 1), F.lit(0)))


def fingerprints(rows: DataFrame, short: list[int]) -> DataFrame:
    """``rows`` (column ``w``) with ``fps``: the kept positions of windows of WINDOW words, and every position for the lengths ``short``."""
    keys, span = rows.columns, WINDOW - K + 1
    rows = rows.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))).withColumn("grams", _grams(K, 0))
    least = F.slice(F.transform("grams", lambda x, i: F.least(*_run("grams", x, i, span))), 1, F.greatest(F.size("grams") - (span - 1), F.lit(0)))
    return rows.select(*keys, F.concat(F.array_distinct(least), *[_grams(n, n) for n in short]).alias("fps"))


def _hash(fp: Column) -> Column:
    return F.shiftright(fp, 30)


def _place(fp: Column) -> Column:
    return (F.lit(POSITION) - fp.bitwiseAND(F.lit(POSITION))).cast("int")


def _context(w: Column, at: Column) -> tuple[Column, Column]:
    """The words before ``at``, nearest first, and those from ``at`` on."""
    begin = F.greatest(at - LEFT, F.lit(0))
    return F.reverse(F.slice(w, begin + 1, at - begin)), F.slice(w, at + 1, RIGHT)


def _same(value, other: Column, most: int) -> Column:
    """How many words ``value(0)``, ``value(1)``, ... have in common with the list ``other``, ``most`` at most; no lambda, so joins generate code."""
    found = F.when(F.lit(False), 0)
    for j in range(most):
        found = found.when(F.coalesce(value(j) != F.get(other, F.lit(j)), F.lit(True)), j)
    return found.otherwise(most)


def find_hits(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, th, s, n, item_id): stretches of ``n`` words from word ``s`` on that a document (doc_id, text hash th) shares with an item."""
    test = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    lengths = test.select(F.least(F.size("w"), F.lit(WINDOW))).distinct().collect()  # WINDOW numbers at most
    short = sorted(r[0] for r in lengths if r[0] < WINDOW)
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    # outer: an inner explode would have its filter pushed through all the steps, which then are computed anew
    place = lambda rows: rows.withColumn("fp", F.explode_outer("fps")).select(*rows.drop("fps").columns, _hash(F.col("fp")).alias("h"), _place(F.col("fp")).alias("at"))
    d = place(fingerprints(own, short))

    t = place(fingerprints(test.where(F.size("w") >= WINDOW), [])).withColumn("t_n", F.lit(WINDOW))
    for n in short:
        t = t.unionByName(place(fingerprints(test.where(F.size("w") == n), [n])).where("at = 0").withColumn("t_n", F.lit(n)))
    before, after = _context(F.col("w"), F.col("at"))
    t = t.select("item_id", "t_n", "h", before.alias("t_before"), after.alias("t_after")).distinct()

    if t.limit(broadcast_rows + 1).count() <= broadcast_rows:
        hit = d.join(F.broadcast(t), "h")
    else:
        near = d.select("doc_id", "th", "h", "at").join(t, "h").drop("h")
        w = own.distinct().select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"), "w")
        hit = near.join(w, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))
    before = _same(lambda j: F.get("w", F.col("at") - (j + 1)), F.col("t_before"), LEFT)
    after = _same(lambda j: F.get("w", F.col("at") + j), F.col("t_after"), RIGHT)
    left = F.when(F.col("t_n") == WINDOW, before).otherwise(0)
    spans = hit.select("doc_id", "th", "at", "item_id", "t_n", left.alias("l"), after.alias("r"))
    spans = spans.where(F.col("l") + F.col("r") >= F.col("t_n"))
    return spans.select("doc_id", "th", (F.col("at") - F.col("l")).alias("s"), (F.col("l") + F.col("r")).alias("n"), "item_id")


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (s, n) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
    step = lambda a, x: F.struct(
        (a["total"] + F.greatest(x["s"] + x["n"] - F.greatest(x["s"].cast("long"), a["end"]), F.lit(0).cast("long"))).alias("total"),
        F.greatest(a["end"], (x["s"] + x["n"]).cast("long")).alias("end"),
    )
    return F.aggregate(spans, zero, step, lambda a: a["total"])


def contamination(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, th, n_words, n_hit, items (sorted ids), contaminated."""
    hits = find_hits(docs, items, broadcast_rows).groupBy("doc_id", "th").agg(
        F.collect_set(F.struct("s", "n")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items")
    ).select(F.col("doc_id").alias("h_id"), F.col("th").alias("h_th"), _covered(F.array_sort("spans")).alias("n_hit"), "items")
    counted = docs.select("doc_id", F.xxhash64("text").alias("th"), _count(F.col("text")).alias("n_words"))
    joined = counted.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "doc_id", "th", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all their columns."""
    bad = contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("bad id"), F.col("th").alias("bad hash")).distinct()
    same = F.col("bad id").eqNullSafe(docs["doc_id"]) & (F.col("bad hash") == F.xxhash64(docs["text"]))
    return docs.join(bad, same, "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, w, least(len(w), 13) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM i)),
dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1:s + n], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
