"""Readers: Parquet tables, Markdown trees, JSON logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.functions import text as tx

TASK_SCHEMA = "id string, task string, agent string, status string, claimed_at string, completed_at string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown(spark: SparkSession, path: str, glob: str = "*.md", recursive: bool = True) -> DataFrame:
    """One row a file: path, stem, text, modified."""
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).text(path, wholetext=True)
    raw = raw.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified"))
    return raw.select("path", F.regexp_replace("name", r"\.md$", "").alias("stem"), "text", "modified")


def pages(raw: DataFrame, skip_parts: tuple[str, ...] = ("projects", "gaps", "raw-sources")) -> DataFrame:
    """Structured pages; superseded and archived ones and skipped folders are left out."""
    fm = tx.frontmatter(F.col("text"))
    parts = F.split("path", "/")
    rows = raw.where(~F.arrays_overlap(parts, F.array(*[F.lit(p) for p in skip_parts]))).select(
        "path", "stem", "text", "modified", tx.title(F.col("text"), F.col("stem")).alias("title"), tx.summary(F.col("text")).alias("summary"),
        *[tx.field(fm, k).alias(k) for k in ("type", "status", "project", "timestamp", "valid_to", "superseded_by", "source_authority")],
        tx.wikilinks(F.col("text")).alias("links"), tx.content_words(tx.body(F.col("text"))).alias("n_words"),
    )
    return rows.where(~F.coalesce("status", F.lit("")).isin("superseded", "archived"))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank and corrupt ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_files(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object a file; corrupt files are skipped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def session_blocks(raw: DataFrame) -> DataFrame:
    """Blocks of day logs: (path, block, at, event, session, body), cut at ``## [HH:MM:SS] event | session``."""
    parts = F.posexplode(F.filter(F.split("text", r"(?m)^## \["), lambda _, i: i > 0)).alias("block", "body")
    head = F.substring_index("body", "\n", 1)
    return raw.select("path", parts).select(
        "path", "block", F.regexp_extract(head, r"^(\d\d:\d\d:\d\d)\]", 1).alias("at"), F.trim(F.regexp_extract(head, r"\]\s*([^|]*)", 1)).alias("event"),
        F.trim(F.regexp_extract(head, r"\|\s*(.*)$", 1)).alias("session"), F.expr("substring(body, instr(body, '\n') + 1)").alias("body"),
    )
