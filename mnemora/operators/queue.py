"""A task queue as an append-only log: what happened to a task is a row, its state is a fold of its rows.

Rows: id, kind (enqueued, leased, released, failed, ok), at, and of the first
one type and payload. Counts and maxima combine before the shuffle, so a task
with very many attempts costs no more than another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "id string, kind string, at timestamp, type string, payload map<string,string>, owner string"
LEASE_SECONDS, ATTEMPTS, BACKOFF_SECONDS, DRAINED = 600, 5, 60, 10


def state(log: DataFrame) -> DataFrame:
    """One row a task that isn't done: id, type, payload, enqueued_at, attempts, last_attempt_at, leased_at (null: free)."""
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("at")))
    freed = F.max(F.when(F.col("kind").isin("released", "failed", "ok"), F.col("at")))
    head = F.min_by(F.struct("type", "payload"), F.when(F.col("kind") == "enqueued", F.col("at")))
    rows = log.groupBy("id").agg(
        head.alias("head"), F.min(F.when(F.col("kind") == "enqueued", F.col("at"))).alias("enqueued_at"), F.count_if(F.col("kind") == "failed").alias("attempts"),
        at("failed").alias("last_attempt_at"), at("leased").alias("leased"), freed.alias("freed"), F.count_if(F.col("kind") == "ok").alias("done"),
    )
    held = F.when(F.col("freed").isNull() | (F.col("leased") > F.col("freed")), F.col("leased"))
    return rows.where("done = 0").select("id", "head.type", "head.payload", "enqueued_at", "attempts", "last_attempt_at", held.alias("leased_at"))


def pending(tasks: DataFrame, now: str, max_age_days: int | None = None) -> DataFrame:
    """Free tasks, those older than ``max_age_days`` left out; a task without a time of its own stays."""
    free = tasks.where("leased_at is null")
    if max_age_days is None:
        return free
    cut = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(max_age_days))
    return free.where(F.col("enqueued_at").isNull() | (F.col("enqueued_at") >= cut))


def verdict(now: str, attempts: int = ATTEMPTS, backoff: int = BACKOFF_SECONDS) -> Column:
    """take, or skip for a task that failed too often or was tried a moment ago."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("last_attempt_at").cast("timestamp").cast("double")
    return F.when((F.col("attempts") >= attempts) | (F.col("last_attempt_at").isNotNull() & (age < backoff)), "skip").otherwise("take")


def turn(tasks: DataFrame, now: str, most: int = DRAINED) -> DataFrame:
    """The oldest ``most`` free tasks with their verdict; skipped ones use up their places."""
    return pending(tasks, now).orderBy("id").limit(most).withColumn("verdict", verdict(now))


def stale_leases(tasks: DataFrame, now: str, seconds: int = LEASE_SECONDS) -> DataFrame:
    """Tasks whose drainer has held them too long: rows that release them."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("leased_at").cast("timestamp").cast("double")
    return event(tasks.where(F.col("leased_at").isNotNull() & (age > seconds)), "released", now)


def event(tasks: DataFrame, kind: str, now: str, owner: str | None = None) -> DataFrame:
    none = F.lit(None)
    return tasks.select(
        "id", F.lit(kind).alias("kind"), F.lit(now).cast("timestamp").alias("at"), none.cast("string").alias("type"),
        none.cast("map<string,string>").alias("payload"), F.lit(owner).cast("string").alias("owner"),
    )


def enqueue(tasks: DataFrame, now: str) -> DataFrame:
    """Rows that add tasks (type, payload); ids begin with the time, so they sort by age."""
    stamp = F.date_format(F.lit(now).cast("timestamp"), "yyyyMMdd-HHmmss")
    return tasks.select(
        F.concat(stamp, F.lit("-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)).alias("id"), F.lit("enqueued").alias("kind"),
        F.lit(now).cast("timestamp").alias("at"), "type", "payload", F.lit(None).cast("string").alias("owner"),
    )


class Queue:
    """The log under a shared path. Appends are files of their own; a task that two drainers leased goes to the smaller owner."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        from mnemora.sources.vault import exists

        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path)

    def tasks(self) -> DataFrame:
        return state(self.log())

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def add(self, tasks: DataFrame, now: str) -> None:
        self.append(enqueue(tasks, now))

    def drain(self, processor: Callable[[dict], bool], now: str, most: int = DRAINED) -> dict[str, int]:
        """Stale leases are freed, then the oldest tasks are leased and processed in Python workers. ok, failed and skipped are counted."""
        owner = uuid.uuid4().hex
        self.append(stale_leases(self.tasks(), now))
        seen = turn(self.tasks(), now, most)
        counts = {r["verdict"]: r["count"] for r in seen.groupBy("verdict").count().collect()}
        self.append(event(seen.where("verdict = 'take'"), "leased", now, owner))
        log = self.log()
        first = log.where((F.col("kind") == "leased") & (F.col("at") == F.lit(now).cast("timestamp"))).groupBy("id").agg(F.min("owner").alias("first"))
        mine = log.where(F.col("owner") == owner).select("id").join(first.where(F.col("first") == owner), "id", "left_semi")
        # the results are written before anything else reads them: a processor runs once a task, or again if its task is lost
        self.append(process(self.tasks().join(mine, "id", "left_semi"), processor, now, owner))
        got = {r["kind"]: r["count"] for r in self.log().where((F.col("owner") == owner) & F.col("kind").isin("ok", "failed")).groupBy("kind").count().collect()}
        taken = got.get("ok", 0) + got.get("failed", 0)
        return {"ok": got.get("ok", 0), "failed": got.get("failed", 0), "skipped": counts.get("skip", 0) + counts.get("take", 0) - taken}

    def status(self) -> DataFrame:
        """pending_total, by_type and permanently_failed of what is free or held."""
        by_type = self.tasks().groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("attempts") >= ATTEMPTS).alias("dead"))
        entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n"))))
        return by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pending_total"), entries.alias("by_type"), F.coalesce(F.sum("dead"), F.lit(0)).alias("permanently_failed"))


def process(tasks: DataFrame, processor: Callable[[dict], bool], now: str, owner: str) -> DataFrame:
    """Rows ok or failed: what ``processor`` says of each task; one that raises has failed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kinds = []
            for task in frame.to_dict("records"):
                try:
                    kinds.append("ok" if processor({**task, "payload": dict(task["payload"] or {})}) else "failed")
                except Exception:  # noqa: BLE001 - the task is tried again later
                    kinds.append("failed")
            yield pd.DataFrame({"id": frame["id"], "kind": kinds})

    done = tasks.select("id", "type", "payload", "attempts").mapInPandas(run, "id string, kind string")
    none = F.lit(None)
    return done.select("id", "kind", F.lit(now).cast("timestamp").alias("at"), none.cast("string").alias("type"), none.cast("map<string,string>").alias("payload"), F.lit(owner).alias("owner"))


def late_blocks(tasks: DataFrame, now: str) -> DataFrame:
    """(day, at, event, session, text) of deferred captures: filed under the day they are of, headed with the time they arrive."""
    t = F.lit(now).cast("timestamp")
    p = F.col("payload")
    what = F.concat(F.lit("deferred-"), F.coalesce(p["event"], F.lit("session-end")))
    return tasks.where("type = 'flush'").select(
        F.coalesce(p["day"], F.date_format(t, "yyyy-MM-dd")).alias("day"), F.date_format(t, "HH:mm:ss").alias("at"), what.alias("event"),
        F.coalesce(p["session_id"], F.lit("unknown")).alias("session"), F.coalesce(p["body"], F.lit("")).alias("text"),
    )
