"""Writers: snapshots that readers see whole or not at all, appended events and day logs, Markdown files, state.

Everything is written by tasks; what a lost task wrote is written again by its
successor under the same name.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators import lint, search
from mnemora.sources.vault import _hadoop, exists


class Snapshots:
    """Versions of a table under one path. A version is written apart, then a pointer file is renamed over the old one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> str | None:
        if not exists(self.spark, f"{self.path}/CURRENT"):
            return None
        return self.spark.read.text(f"{self.path}/CURRENT").first()["value"]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.current()}")

    def write(self, df: DataFrame) -> str:
        """A new version; ``df`` may read the present one."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        fs, pointer = _hadoop(self.spark, f"{self.path}/CURRENT")
        _, draft = _hadoop(self.spark, f"{self.path}/NEXT-{version}")
        out = fs.create(draft, True)
        out.write(bytearray(version.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        mode = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = mode
        files.rename(draft, pointer, options)
        return version

    def update(self, change: Callable[[DataFrame], DataFrame]) -> str:
        """Read, change, write; the pointer moves only after the whole new version is there."""
        return self.write(change(self.read()))


def write_markdown(pages: DataFrame, root: str) -> DataFrame:
    """Each page (rel, text) as a file under ``root``, by its task: written beside, then moved. Gives (rel, n_chars); paths that leave the root are an error."""
    base = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        store, home = pafs.FileSystem.from_uri(base if "://" in base else f"file://{os.path.abspath(base.removeprefix('file:'))}")
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, text in zip(names, texts, strict=True):
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"page outside the vault: {name}")
                target = f"{home}/{name}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                draft = f"{target}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(draft) as out:
                    out.write((text or "").encode())
                store.move(draft, target)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or "") for t in texts], pa.int64())], ["rel", "n_chars"])

    written = pages.select("rel", "text").mapInArrow(run, "rel string, n_chars long")
    spark = pages.sparkSession
    path = f"{base}/.written-{uuid.uuid4().hex}"
    written.write.parquet(path)  # the write runs the tasks once; rows tell what is there
    return spark.read.parquet(path)


def remove(spark: SparkSession, root: str, rels: list[str]) -> None:
    for rel in rels:
        fs, p = _hadoop(spark, f"{root.rstrip('/')}/{rel}")
        fs.delete(p, False)


def move_pages(moves: DataFrame, root: str) -> DataFrame:
    """Pages (rel, to, text) written to their new place, then taken from the old one; a page goes only after its copy is there."""
    done = write_markdown(moves.select(F.col("to").alias("rel"), "text"), root)
    gone = moves.join(done.select(F.col("rel").alias("to")), "to", "left_semi").select("rel", "to")
    rows = gone.collect()  # names of one pass
    remove(moves.sparkSession, root, [r["rel"] for r in rows])
    return moves.sparkSession.createDataFrame(rows, gone.schema)


def append_events(rows: DataFrame, path: str) -> None:
    """JSON lines, new files beside the old ones; a completion is a row of its own, never a change."""
    rows.write.mode("append").json(path)


def append_days(blocks: DataFrame, path: str) -> None:
    """Blocks (day, at, event, session, text) of day logs, a folder a day."""
    blocks.select("day", "at", "event", "session", "text").write.mode("append").partitionBy("day").parquet(path)


def day_logs(spark: SparkSession, path: str, under: str = "knowledge/daily") -> DataFrame:
    """(rel, text) of the appended blocks as Markdown: a head line, then the blocks by time, each ended by a line end."""
    rows = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    head = F.when(F.col("event").isNull(), F.lit("\n")).otherwise(F.concat(F.lit("\n## ["), "at", F.lit("] "), "event", F.lit(" | "), "session", F.lit("\n")))
    block = F.concat(head, F.regexp_replace("text", r"\n\z", ""), F.lit("\n"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", block.alias("block")))), lambda x: x["block"])
    return rows.groupBy("day").agg(texts.alias("texts")).select(
        F.concat(F.lit(f"{under}/"), "day", F.lit(".md")).alias("rel"), F.concat(F.lit("# Daily Session Memory — "), "day", F.lit("\n"), F.array_join("texts", "")).alias("text")
    )


def flush_block(sessions: DataFrame, now: str) -> DataFrame:
    """(day, at, event, session, text) of classified sessions (session_id, event, trigger, transcript, tier, body) that aren't ok, secrets removed."""
    from mnemora.functions.text import redact

    body = F.coalesce(F.nullif("body", F.lit("")), F.lit("(tier flagged but no structured body — manual review needed)"))
    text = F.concat(F.lit("- Trigger: `"), "trigger", F.lit("`\n- Transcript: `"), "transcript", F.lit("`\n- Tier: `"), "tier", F.lit("`\n\n"), body)
    t = F.lit(now).cast("timestamp")
    return sessions.where("tier <> 'ok'").select(F.date_format(t, "yyyy-MM-dd").alias("day"), F.date_format(t, "HH:mm:ss").alias("at"), "event", F.col("session_id").alias("session"), redact(text).alias("text"))


def write_index(pages: DataFrame, path: str, stemmed: bool = True) -> search.Index:
    return search.build(pages, path, stemmed)


def write_vectors(pages: DataFrame, path: str, embed) -> DataFrame:
    search.vectors(pages, embed).write.mode("overwrite").parquet(path)
    return pages.sparkSession.read.parquet(path)


def one_text(rows: DataFrame, order: str = "place", column: str = "text") -> DataFrame:
    """(text): a few ordered rows as one text."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column])
    return rows.agg(F.concat(F.rtrim(F.array_join(texts, "\n")), F.lit("\n")).alias("text"))


def write_report(findings: DataFrame, root: str, today: str, under: str = "reports") -> DataFrame:
    """The lint report of a day as a file; the findings themselves beside it as a table."""
    findings.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{under}/findings/day={today}")
    return write_markdown(one_text(lint.report(findings, today)).select(F.lit(f"{under}/lint-{today}.md").alias("rel"), "text"), root)


def newest_findings(spark: SparkSession, root: str, under: str = "reports") -> DataFrame:
    """The findings of the newest report; none without one."""
    path = f"{root.rstrip('/')}/{under}/findings"
    if not exists(spark, path):
        return spark.createDataFrame([], "category string, scope string, path string, target string, detail string")
    rows = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    return rows.where(F.col("day") == rows.agg(F.max("day")).first()[0]).drop("day")


def write_catalogue(pages: DataFrame, root: str) -> DataFrame:
    from mnemora.operators.pages import catalogue

    return write_markdown(one_text(catalogue(pages)).select(F.lit("knowledge/index.md").alias("rel"), "text"), root)


def newest(old: DataFrame, new: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """A bounded state map: the newest row of each key, of ``most`` keys at most, the newest ones."""
    from mnemora.operators.activity import latest

    rows = old.unionByName(new, allowMissingColumns=True)
    return latest(rows, [key], [at], [c for c in rows.columns if c not in (key, at)]).select(*rows.columns).orderBy(F.desc(at), key).limit(most)
