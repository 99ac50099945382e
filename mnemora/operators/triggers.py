"""What sessions set off: the gate before a compile, ends and idle moments of sessions, and the maintenance passes."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.operators.activity import cooldown

AFTER_HOUR, APART_SECONDS, REMEMBERED = 18, 900, 20
IDLE_MESSAGES, IDLE_CHARS, IDLE_LEAST = 12, 8000, 50


def compile_gate(flushes: DataFrame, ledger: DataFrame, hour: int = AFTER_HOUR, apart: float = APART_SECONDS) -> DataFrame:
    """Flushes (id, at, tier, name, hash) that start a compile: of the major tier, late in the day, of a day log that isn't compiled as it is, ``apart`` seconds from the last start."""
    fresh = flushes.where((F.col("tier") == "major") & (F.hour("at") >= hour)).join(ledger.select("name", "hash").distinct(), ["name", "hash"], "left_anti")
    kept = cooldown(fresh.select("id", "at", F.lit(0).alias("gate")), ["gate"], F.col("at"), ["id"], apart).select("id")
    return flushes.join(kept, "id", "left_semi")


def trigger_history(triggers: DataFrame, most: int = REMEMBERED) -> DataFrame:
    """The newest ``most`` starts."""
    return triggers.orderBy(F.desc("at"), F.desc("id")).limit(most)


def session_ends(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heartbeats, blocks, flushes) of ended sessions (slug, session_id, reason, transcript, at).

    Every end is a heartbeat. Without a transcript nothing else happens; with
    one the day log gets a tag and the session is flushed, as pre-compact if its
    reason says so.
    """
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")
    beats = events.select("slug", stamp.alias("at"), "reason", "session_id")
    told = events.where(F.coalesce("transcript", F.lit("")) != "")
    event = F.when(F.lower(F.coalesce("reason", F.lit(""))).contains("compact"), "pre-compact").otherwise("session-end")
    blocks = told.select(
        F.date_format("at", "yyyy-MM-dd").alias("day"), F.date_format("at", "HH:mm:ss").alias("at"), event.alias("event"), F.col("session_id").alias("session"),
        F.concat(F.lit("- Project slug: `"), "slug", F.lit("`")).alias("text"),
    )
    return beats, blocks, told.select("session_id", "slug", event.alias("event"), "transcript", F.col("reason").alias("trigger"))


def idle_texts(messages: DataFrame) -> DataFrame:
    """(session_id, text): the last messages of each idle session (session_id, seq, text), their end alone.

    A maximum number of rows a session is kept before they meet in one.
    """
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    last = messages.withColumn("nth", nth).where(F.col("nth") <= IDLE_MESSAGES).withColumn("text", F.right(F.coalesce("text", F.lit("")), F.lit(IDLE_CHARS)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return last.groupBy("session_id").agg(F.right(F.array_join(texts, "\n\n"), F.lit(IDLE_CHARS)).alias("text"))


def idle_outcome(told: DataFrame) -> DataFrame:
    """(session_id, outcome, body) of idle sessions (session_id, text, reply): idle-short under 50 characters; major and minor by the reply's first line, all else flush-ok."""
    first = F.upper(F.trim(F.substring_index(F.coalesce("reply", F.lit("")), "\n", 1)))
    tier = F.when(first == "FLUSH_MAJOR", "major").when(first == "FLUSH_MINOR", "minor").otherwise("flush-ok")
    rest = F.when(F.instr("reply", "\n") > 0, F.trim(F.expr("substring(reply, instr(reply, '\n') + 1)"))).otherwise("")
    outcome = F.when(F.length("text") < IDLE_LEAST, "idle-short").otherwise(tier)
    return told.select("session_id", outcome.alias("outcome"), F.when(outcome.isin("major", "minor"), rest).otherwise("").alias("body"))


def due(now: str, last: str | None, hour: int, weekday: int | None = None) -> bool:
    """Whether a daily pass, or a weekly one with a ``weekday`` (Monday is 0), is due at ``now`` after the one at ``last``."""
    at = datetime.datetime.fromisoformat(now)
    start = at.replace(hour=hour, minute=0, second=0, microsecond=0)
    if weekday is not None:
        start -= datetime.timedelta(days=(at.weekday() - weekday) % 7)
    if start > at:
        start -= datetime.timedelta(days=1 if weekday is None else 7)
    return last is None or datetime.datetime.fromisoformat(last) < start


def maintain(steps: list[tuple[str, Callable[[], object], tuple[str, ...]]], now: str) -> list[tuple[str, str]]:
    """Runs named steps in order: (name, ok, failed or skipped). A step is skipped where one that it needs isn't ok; the pass goes on."""
    done: list[tuple[str, str]] = []
    for name, step, needs in steps:
        if any(state != "ok" and other in needs for other, state in done):
            done.append((name, "skipped"))
            continue
        try:
            step()
            done.append((name, "ok"))
        except Exception:  # noqa: BLE001 - the pass goes on without the step
            done.append((name, "failed"))
    return done


def outdated(reports: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Report files (rel, modified) older than ``days``."""
    return reports.where(F.col("modified") < F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))).select("rel")


def bounded_map(old: DataFrame, new: DataFrame, now: float, window: float, times: int = 4) -> DataFrame:
    """A cooldown's map (key, at in seconds) after new entries: the newest of each key, those older than ``times`` windows pruned."""
    both = old.unionByName(new).groupBy("key").agg(F.max("at").alias("at"))
    return both.where(F.col("at") >= now - times * window)
