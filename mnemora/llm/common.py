"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.sources.scratch import root

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def crc_fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


#: Spark then deletes a finished write's shuffle files at once instead of when the driver's JVM next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives the planner real sizes.
    The files go at ``release`` or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/mnemora-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    made = spark.read.parquet(path)
    made.scratch_path = path
    return made


def release(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more; other tables have none."""
    path = getattr(df, "scratch_path", None)
    if path is not None:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have gone first
        pass


def checked_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast ``df`` only if its counted ``rows`` are within ``limit``; otherwise the planner joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


HOT, LEAST_PART = 1000, 256
_PARTS, _SALT = "hot parts", "hot salt"


def hot_keys(counts: DataFrame, on: list[str], total: int) -> DataFrame:
    """Of ``counts`` (``on`` and ``n``, the rows of each key, ``total`` in all) the keys to split, and into how many parts.

    A key is hot with more than ``total / HOT`` rows, so there are fewer than ``HOT`` of them and they can be broadcast.
    """
    share = max(total // HOT, LEAST_PART)
    return counts.where(F.col("n") > share).groupBy(*on).agg(F.max(F.ceil(F.col("n") / share)).cast("int").alias(_PARTS))


def join_split(rows: DataFrame, other: DataFrame, on: list[str], hot: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other``, which has one row a key: hot keys are dealt over parts by a hash of ``spread``.

    ``other`` is repeated once a part. Rows without a key are spread, too.
    """
    keys = hot.drop(_PARTS).columns
    parted = rows.join(F.broadcast(hot), keys, "left")
    parts = F.when(F.col(on[0]).isNull(), HOT).otherwise(F.coalesce(_PARTS, F.lit(1)))
    parted = parted.withColumn(_SALT, F.pmod(F.xxhash64(spread), parts).cast("int")).drop(_PARTS)
    copies = other.join(F.broadcast(hot), keys, "left")
    copies = copies.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(_PARTS, F.lit(1)) - 1))).drop(_PARTS)
    return parted.join(copies, [*on, _SALT], how).drop(_SALT)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their number from 0 within ``group`` by ``order``, and ``n``, the rows of the group.

    Rows are range-partitioned by all of these, and row numbers within a partition are added to the rows of the
    partitions before: no task holds a group, and rows that agree in all columns are spread, too. Write ``rows`` first
    if they are dear to make: they are sampled before they are dealt.
    """
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "tie").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged)  # the borders of the ranges are drawn anew whenever they are computed
    parts = ranged.groupBy(group, "part").agg(F.count(F.lit(1)).alias("here"))
    whole = Window.partitionBy(group)  # a row for each partition of a group
    before = F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col(group).alias("of"), F.col("part").alias("at"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n"))
    own = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order, "tie"))
    made = ranged.withColumn("own", own).join(parts, F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    return made.select(*rows.columns, (F.col("before") + F.col("own") - 1).alias("idx"), "n")
