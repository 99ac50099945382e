"""Training rows for the classifiers.

``labelled_sample`` deals all rows over samples of ``MAX_TRAIN`` rows a label and
more, ``bounded_sample`` takes ``MAX_TRAIN`` rows of each label at most. Either
goes by a hash of ``doc_id``, so it doesn't depend on the partitioning and
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import crc_fold

MAX_TRAIN = 4000


def labelled_rows(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of all rows outside the held-out fold: one row a doc_id (the smaller label of two)."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    )


def labelled_sample(rows: DataFrame, per_class: int = MAX_TRAIN) -> DataFrame:
    """``rows`` (doc_id, y, ...) with ``part``: every row is in some part, every part has rows of both labels, some ``per_class`` to twice that of each if there are as many.

    The rarer label has fewer parts than the other, so its parts are in several.
    """
    n = {r["y"]: max(1, r["n"] // per_class) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a label
    own = F.when(F.col("y") == 1, n.get(1, 1)).otherwise(n.get(0, 1))
    first = F.pmod(F.xxhash64("doc_id"), own).cast("int")
    return rows.withColumn("part", F.explode(F.sequence(first, F.lit(max(n.values(), default=1) - 1), own)))


def bounded_sample(labels: DataFrame, label: str, per_class: int = MAX_TRAIN) -> DataFrame:
    """Up to ``per_class`` of ``labelled_rows`` of each label."""
    rows = labelled_rows(labels, label).withColumn("h", F.xxhash64("doc_id"))
    parts = [rows.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "y")


def with_text(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(y, text) of the sampled documents; the sample's size is bounded by its parameter, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")
