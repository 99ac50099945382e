"""Exact deduplication by content-defined chunk recipes.

Each text is cut where its own content says so: after a sentence end or a line
end, at least ``MIN_CHUNK`` and at most ``MAX_CHUNK`` characters from the last
cut. A chunk's identifier is its SHA-256. The chunk dictionary holds each
distinct (identifier, chunk) once, combined before the shuffle; an identifier
is verified if the dictionary has one chunk for it. Documents are then
compared by their ordered identifier lists (recipes), so that after the
dictionary no text moves, whatever its length or number of copies.

Should an identifier ever stand for two chunks, the recipes that use it carry
the chunk itself beside it (``refine``): the comparison stays exact.

Null text counts as empty; empty texts equal one another (their recipe is the
empty list). The largest ``doc_id`` of a group stays; rows that repeat a
``doc_id`` and its text are members of one group and have the same verdict,
``keep_one`` gives one of them; a null ``doc_id`` is smaller than any other and
stays only if no other is there. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import hot_keys, join_split, materialise, table

MIN_CHUNK, MAX_CHUNK = 512, 8192


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    cut = rf"(?s).{{{least},{most}}}?(?:(?<=[.!?] )|(?<=\n)|\z)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def chunk_id(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def colliding_ids(docs: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk, from the dictionary of all chunks: (id, chunk, n)."""
    each = docs.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(chunk_id(F.col("chunk")).alias("id"), "chunk")
    dictionary = each.distinct()
    return dictionary.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, recipe (ordered chunk identifiers), text_sha256."""
    return docs.select(
        "doc_id", F.transform(chunks(F.col("text")), chunk_id).alias("recipe"), F.sha2("text", 256).alias("text_sha256")
    )


def refine(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Recipes in which each colliding identifier is followed by its chunk."""
    parts = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode_outer(chunks(F.col("text"))).alias("pos", "chunk"))
    parts = parts.withColumn("id", chunk_id(F.col("chunk"))).join(bad.withColumn("hit", F.lit(True)), "id", "left")
    parts = parts.withColumn("id", F.when(F.col("hit"), F.concat("id", F.col("chunk").cast("binary"))).otherwise(F.col("id")))
    made = parts.groupBy("doc_id", "text_sha256").agg(
        F.transform(F.array_sort(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "id")))), lambda x: x["id"]).alias("recipe"),
        F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("rows"),
    )
    return made.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select("doc_id", "recipe", "text_sha256")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bad = materialise(colliding_ids(docs))
    made = recipes(docs) if bad.isEmpty() else refine(docs, bad)
    made = materialise(made.withColumn("key", F.sha2(F.array_join(F.transform("recipe", F.hex), ","), 256)))
    groups = made.groupBy("key", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = hot_keys(groups, ["key"], made.count())
    return join_split(made, groups, ["key", "recipe"], hot, "doc_id", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("keep_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns: one row of each text.

    Of rows that repeat the doc_id and the text that stay, any one is given.
    """
    found = exact_duplicates(docs)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("dropped id"), F.col("text_sha256").alias("dropped text")).distinct()
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    left = docs.join(gone, F.col("dropped id").eqNullSafe(docs["doc_id"]) & (F.col("dropped text") == sha), "left_anti")
    again = found.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = materialise(again.select(F.col("doc_id").alias("repeated id"), F.col("text_sha256").alias("repeated text")))
    if again.isEmpty():
        return left
    same = F.col("repeated id").eqNullSafe(left["doc_id"]) & (F.col("repeated text") == F.sha2(F.coalesce(left["text"], F.lit("")), 256))
    one = left.join(again, same, "left_semi").withColumn("one text", F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", "one text"]).drop("one text")
    return left.join(again, same, "left_anti").unionByName(one)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
