"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source expects ``target / source size`` copies. Laid end to
end in the order of size, then of a hash of the id, the expected copies are
prefix-summed, one random offset per source is added, and a document is emitted
once per integer boundary its stretch crosses. Neighbours have like sizes, so
the words taken stay within about one document's size of the target.

As the expected copies are equal within a source, a prefix sum is a rank, which
``common.numbered`` makes without a task that holds a source, a size or an id.

Size: number of words between white space; null text: 0. A null source is a
source of its own and comes last. Targets: weights ``WEIGHTS`` by rank of the
source, repeating, share ``SHARE`` of all words; no target exceeds ``CAP`` times
its source, the excess is shared again by weight. Sources without words take
nothing. A null doc_id counts as the empty text. Rows that agree in doc_id,
source and size are interchangeable: which of them are taken may differ. Empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.llm.common import materialise, numbered, table

WEIGHTS, SHARE, CAP, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, "mix-1"
ROW = "mix row"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and joins as a value."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def _hash(seed: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(value.cast("string"), F.lit(""))), 256)


def _targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float, seed: str) -> DataFrame:
    """One row per source: sk, source_size, target, rate (expected copies), offset."""
    rank = Window.orderBy("sk")  # one row per source
    w = F.get(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(rank) - 1) % len(weights))
    rows = sources.select("sk", "source_size", w.alias("w"), (cap * F.col("source_size")).alias("top"))
    full = Window.orderBy(F.col("top") / F.col("w"), "sk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.withColumn("all", share * F.sum("source_size").over(whole)).withColumn(
        "level",  # the common target per weight if every source before this one is full
        (F.col("all") - F.coalesce(F.sum("top").over(full), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(full), F.lit(0.0))),
    )
    # the first source, by top / w, that its level doesn't fill
    fits = F.when(F.col("level") * F.col("w") <= F.col("top"), F.struct((F.col("top") / F.col("w")).alias("order"), "sk", "level"))
    rows = rows.withColumn("level", F.min(fits).over(whole)["level"])
    target = F.least("top", F.coalesce(F.col("level") * F.col("w"), "top"))
    offset = F.conv(F.substring(_hash(seed, F.col("sk")), 1, 12), 16, 10).cast("double") / float(16**12)
    rows = rows.withColumn("target", target)
    return rows.select(
        "sk", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), offset.alias("offset"),
    )


def plan_copies(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, sk, size, source_size, target, copies, and the columns ``carried``, which order rows that agree otherwise."""
    rows = materialise(docs.select(
        "doc_id", *carried, source_key(F.col("source")).alias("sk"), size_of(F.col("text")).alias("size"), _hash(seed, F.col("doc_id")).alias("h")
    ))
    targets = _targets(rows.groupBy("sk").agg(F.sum("size").alias("source_size")), weights, share, cap, seed)
    ranked = numbered(rows, "sk", ["size", "h", "doc_id", *carried]).join(targets, "sk")
    upto = lambda rank: F.floor(F.col("rate") * rank + F.col("offset"))
    return ranked.select("doc_id", *carried, "sk", "size", "source_size", "target", (upto(F.col("idx") + 1) - upto(F.col("idx"))).alias("copies"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all their columns and ``copy`` (1, 2, ...).

    Each row has its own copies, rows that agree in doc_id, source and size too. Rows are told apart by a number that is written
    with them, so that reading them again can't number them anew.
    """
    rows = materialise(docs.withColumn(ROW, F.monotonically_increasing_id()))
    plan = plan_copies(rows, carried=(ROW,), **parameters).where(F.col("copies") > 0).select(ROW, F.col("copies").cast("int").alias("copy count"))
    return rows.join(plan, ROW).select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("copy count"))).alias("copy"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = plan_copies(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, sha256('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s0 AS (SELECT sk, sum(size)::BIGINT AS source_size FROM d GROUP BY sk),
s1 AS (SELECT *, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY sk) - 1) % 3)]::DOUBLE AS w, 2.0::DOUBLE * source_size AS top FROM s0),
s2 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM s1 WINDOW f AS (ORDER BY top / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (SELECT level FROM s2 WHERE level * w <= top ORDER BY top / w, sk LIMIT 1) AS lv FROM s2),
s4 AS (SELECT sk, source_size, least(top, coalesce(lv * w, top)) AS target,
    ('0x' || substr(sha256('mix-1:' || sk), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u FROM s3),
r AS (SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY sk ORDER BY size, h, doc_id) AS k FROM d JOIN s4 USING (sk))
SELECT doc_id, size, source_size, round(target, 4) AS target,
  ((floor(rate * k + u) - floor(rate * (k - 1) + u)) * size)::BIGINT AS taken FROM r
"""
