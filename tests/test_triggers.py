"""Triggers, session ends, maintenance, and secrets without a known family."""

import math
import random

from mnemora.functions import text as tx
from mnemora.operators import triggers as tg

F = tg.F


def test_compile_gate(spark):
    rows = [(1, "2024-05-01 17:59:00", "major", "a", "h1"), (2, "2024-05-01 18:00:00", "major", "a", "h1"), (3, "2024-05-01 18:10:00", "major", "a", "h2"), (4, "2024-05-01 18:15:00", "major", "a", "h3"),
            (5, "2024-05-01 19:00:00", "minor", "a", "h4"), (6, "2024-05-01 20:00:00", "major", "b", "done"), (7, "2024-05-01 20:00:01", "major", "c", "done")]
    df = spark.createDataFrame(rows, "id int, at string, tier string, name string, hash string").withColumn("at", F.col("at").cast("timestamp"))
    ledger = spark.createDataFrame([("b", "done")], "name string, hash string")
    kept = tg.compile_gate(df, ledger)
    assert sorted(r.id for r in kept.collect()) == [2, 4, 7]
    assert [r.id for r in tg.trigger_history(kept, 2).collect()] == [7, 4]


def test_session_ends(spark):
    rows = [("red", "s1", "compact now", "t.jsonl"), ("red", "s2", "other", ""), ("red", "s3", None, "u.jsonl")]
    df = spark.createDataFrame(rows, "slug string, session_id string, reason string, transcript string").withColumn("at", F.lit("2024-05-01 10:00:00").cast("timestamp"))
    beats, blocks, flushes = tg.session_ends(df)
    assert beats.count() == 3 and beats.first().at == "2024-05-01T10:00:00"
    assert sorted((r.session_id, r.event) for r in flushes.collect()) == [("s1", "pre-compact"), ("s3", "session-end")]
    assert {r.text for r in blocks.collect()} == {"- Project slug: `red`"}


def test_idle(spark):
    rows = [("a", i, f"message number {i}") for i in range(20)] + [("b", 0, "short"), ("c", 0, "x" * 9000), ("d", 0, "y" * 60), ("e", 0, None)]
    texts = tg.idle_texts(spark.createDataFrame(rows, "session_id string, seq int, text string"))
    got = {r.session_id: r.text for r in texts.collect()}
    assert got["a"] == "\n\n".join(f"message number {i}" for i in range(8, 20)) and len(got["c"]) == 8000 and got["e"] == ""
    replies = {"a": "FLUSH_MAJOR\n- kept", "b": "FLUSH_MAJOR\nx", "c": "flush_minor", "d": "who knows\nx", "e": None}
    told = texts.join(spark.createDataFrame(list(replies.items()), "session_id string, reply string"), "session_id")
    assert {r.session_id: (r.outcome, r.body) for r in tg.idle_outcome(told).collect()} == {
        "a": ("major", "- kept"), "b": ("idle-short", ""), "c": ("minor", ""), "d": ("flush-ok", ""), "e": ("idle-short", "")
    }


def test_passes(spark):
    assert tg.due("2024-05-02T03:00:00", None, 3) and tg.due("2024-05-02T03:00:00", "2024-05-01T03:00:01", 3) and not tg.due("2024-05-02T02:00:00", "2024-05-01T03:00:01", 3)
    assert tg.due("2024-05-06T04:00:00", "2024-04-29T04:00:00", 4, 0) and not tg.due("2024-05-08T04:00:00", "2024-05-06T04:00:00", 4, 0)
    ran = []
    steps = [("drain", lambda: ran.append(1), ()), ("compile", lambda: 1 / 0, ()), ("lint", lambda: ran.append(2), ("compile",)), ("prune", lambda: ran.append(3), ("drain",))]
    assert tg.maintain(steps, "x") == [("drain", "ok"), ("compile", "failed"), ("lint", "skipped"), ("prune", "ok")] and ran == [1, 3]
    reports = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-05-01")], "rel string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    assert [r.rel for r in tg.outdated(reports, "2024-05-02").collect()] == ["a"]
    state = spark.createDataFrame([("k", 1.0), ("old", 0.0), ("n", 300.0)], "key string, at double")
    got = tg.bounded_map(state, spark.createDataFrame([("k", 400.0)], "key string, at double"), 400.0, 60.0)
    assert {r.key: r.at for r in got.collect()} == {"k": 400.0, "n": 300.0}


def test_secrets(spark):
    rnd = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rnd.choice(alphabet[: rnd.choice([12, 30, 62])]) for _ in range(rnd.randrange(20, 50))) for _ in range(60)]

    def bits(t):
        return -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))

    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = {r.t: r.e for r in df.select("t", tx.entropy(F.col("t")).alias("e")).collect()}
    assert all(abs(got[t] - bits(t)) < 1e-8 for t in tokens)
    secret = "aB3dE5gH7jK9mN1pQ2rS"
    digest = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    texts = [f"see {secret}, and {secret}x!", f"commit {digest}", "plain prose with supercalifragilisticexpialidocious words", "https://me:pw1@host/x", "sk_live_abcdefghijklmnop1"]
    red = [r.r for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.redact(F.col("t")).alias("r")).orderBy("i").collect()]
    assert red == ["see [REDACTED:entropy], and [REDACTED:entropy]!", texts[1], texts[2], "[REDACTED:url]host/x", "[REDACTED:payment]"]
