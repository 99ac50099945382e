"""Capture streams: stateful cooldown, session and sliding windows, day buckets, claims joined with completions, latest state.

Event time is the events' own ``ts``; batch twins are in ``operators.activity``.
A stream that is run to its end is closed by a marker far in the future, so
that the watermark passes every event and nothing stays open.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemora.sources.scratch import root

END = "2200-01-01 00:00:00"
#: Over which the cooldown's keys are dealt.
BUCKETS = 1024


def _arrow(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def event_stream(spark: SparkSession, sf_dir: str, closed: bool = True) -> DataFrame:
    """The events table as a file stream, ts as a timestamp; ``closed`` by a marker without an id."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    rows = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    if not closed:
        return rows
    path = f"{root(spark)}/mnemora-end-{uuid.uuid4().hex}"
    end = spark.range(1).select(*[(F.lit(END).cast("timestamp") if c == "ts" else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns])
    end.write.parquet(path)
    return rows.unionByName(spark.readStream.schema(end.schema).parquet(path))


def cooldown_stream(events: DataFrame, seconds: float, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(user_id, event_type, event_id, at): kept events, per key no other kept one under ``seconds`` before.

    Keys are dealt over ``buckets`` by a hash, and a bucket's state is one Arrow
    table. Events wait in it until the watermark has passed them, so that they
    are judged in the order of their time however late they come (within
    ``late``); a key leaves it when nothing waits and the last kept event's
    ``seconds`` are over.
    """
    key = ["user", "known", "event_type"]  # pandas knows no null numbers: ``known`` says whether there is a user
    columns = [*key, "at", "event", "past"]

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        rows = pd.concat([*before, *[f.loc[~f["mark"], columns] for f in frames]])  # the marker only moves the watermark
        if not len(rows):
            return
        now = state.getCurrentWatermarkMs() / 1000
        rows["code"] = rows.groupby(key, dropna=False, sort=False).ngroup().to_numpy()
        rows = rows.sort_values(["code", "past", "at", "event"], ascending=[True, False, True, True], ignore_index=True)
        kept, lasts, of, last = [], {}, None, None
        due = np.flatnonzero(rows["past"] | (rows["at"] <= now))
        for place, code, at, past in zip(due.tolist(), *(rows[c].to_numpy()[due].tolist() for c in ("code", "at", "past")), strict=True):
            if code != of:
                of, last = code, None
            if past or last is None or at - last >= seconds:
                last, lasts[code] = at, place
                if not past:
                    kept.append(place)
        ends = rows.iloc[list(lasts.values())].assign(past=True)
        left = pd.concat([ends[ends["at"] + seconds > now], rows[~rows["past"] & (rows["at"] > now)]])[columns]
        if len(left):
            state.update((_arrow(left),))
            next_ = (left["at"] + np.where(left["past"], seconds, 0)).min()
            state.setTimeoutTimestamp(int(max(next_, now) * 1000) + 1)
        elif state.exists:
            state.remove()
        if kept:
            out = rows.iloc[kept]
            yield pd.DataFrame({"user_id": out["user"].astype("Int64").where(out["known"]), "event_type": out["event_type"], "event_id": out["event"], "at": out["at"]})

    there = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    rows = events.withWatermark("ts", late).select(
        F.pmod(F.xxhash64("user_id", "event_type"), F.lit(buckets)).alias("bucket"), there("user_id").alias("user"), F.col("user_id").isNotNull().alias("known"), "event_type",
        F.col("ts").cast("double").alias("at"), there("event_id").alias("event"), F.lit(False).alias("past"), F.col("event_id").isNull().alias("mark"), "ts",
    )
    return rows.groupBy("bucket").applyInPandasWithState(
        step, "user_id long, event_type string, event_id long, at double", "waiting binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")
    )


def day_buckets(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("day"), "event_type", "n"
    )


def sliding_counts(events: DataFrame, length: str = "6 hours", slide: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(started, ended, event_type, n) of overlapping windows; an event counts in each window that holds it."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "event_type", "n")


def claimed(claims: DataFrame, done: DataFrame, key: str, claim: str, finish: str, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(key, ``claim``, ``finish``): claims with each completion of the same key up to ``within`` after them, and claims without one, once it is too late for any.

    Both streams (key, id, ts) are watermarked, so that the join forgets what can meet nothing any more: a claim after
    ``within`` and ``late``, a completion after ``late``. Rows without a key meet nothing.
    """
    left = claims.select(key, claim, F.col("ts").alias("claimed_at")).withWatermark("claimed_at", late)
    right = done.select(F.col(key).alias("done_key"), finish, F.col("ts").alias("done_at")).withWatermark("done_at", late)
    span = F.expr(f"{key} = done_key AND done_at >= claimed_at AND done_at <= claimed_at + interval {within}")
    return left.join(right, span, "leftOuter").select(key, claim, finish)


def latest_state(events: DataFrame) -> DataFrame:
    rows = events.where("user_id is not null")
    return rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("r")).select("user_id", "r.ts", "r.event_id", "r.event_type")


def run_once(stream: DataFrame, mode: str = "append", told: dict[str, int] | None = None) -> DataFrame:
    """Run all available input through ``stream`` into files of the shared folder, one set a micro-batch, and read them.

    A batch that runs again replaces its own files. In update mode a key has a
    row for each batch that changed it. ``told`` gets ``late``, the rows that
    came after the watermark and were dropped, and ``state``, the rows that are
    left in state.
    """
    spark = stream.sparkSession
    path = f"{root(spark)}/mnemora-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if told is not None:
        states = [p["stateOperators"] for p in query.recentProgress]
        told["late"] = sum(o["numRowsDroppedByWatermark"] for s in states for o in s)
        told["state"] = sum(o["numRowsTotal"] for o in states[-1]) if states else 0
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)


def upsert_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each micro-batch to ``write`` (the seam for sinks and callbacks)."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
