"""Sliding windows and joined streams in several batches, against plain counts; late rows counted, state forgotten."""

from datetime import datetime, timedelta

from mnemora.streaming import capture

T0 = datetime(2024, 1, 1)


def stream(spark, folder, batches, schema):
    """One file a batch, read one a trigger."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(folder))


def at(hours):
    return T0 + timedelta(hours=hours)


def test_sliding_windows_and_late_rows(spark, tmp_path):
    rows = [[(at(h), "a") for h in (0.5, 1, 3.5, 7)], [(at(30), "b")], [(at(1), "a"), (at(29.5), "b")], [(at(200), "z")]]
    told = {}
    got = capture.run_once(capture.sliding_counts(stream(spark, tmp_path / "in", rows, "ts timestamp, event_type string")), told=told)
    found = {(r.started, r.event_type): r.n for r in got.collect()}
    kept = [(t, e) for t, e in (*rows[0], *rows[1], rows[2][1])]
    want = {}
    for t, e in kept:  # six hours, a new window every two
        first = T0 + timedelta(hours=2 * ((t - T0).total_seconds() // 7200))
        for k in range(3):
            want[first - timedelta(hours=2 * k), e] = want.get((first - timedelta(hours=2 * k), e), 0) + 1
    assert {k: v for k, v in found.items() if k[1] != "z"} == want
    assert told["late"] == 3  # the late row's windows


def test_cooldown_keys_share_a_state(spark, tmp_path):
    """Few rows of state however many keys; keys of one bucket are judged apart, null keys and large ids too; what is over is forgotten."""
    big = 2**53
    rows = [[(u, k, big + 10 * u + i, at(i)) for u in range(40) for i, k in enumerate("aab")] + [(None, "a", 5, at(0)), (None, None, 6, at(0)), (None, "a", 7, at(1))], [(-1, "z", 8, at(50))], [(-1, "z", 9, at(99))]]
    made = capture.cooldown_stream(stream(spark, tmp_path / "in", rows, "user_id long, event_type string, event_id long, ts timestamp"), 2 * 3600, buckets=4)
    told = {}
    got = {(r.user_id, r.event_type, r.event_id) for r in capture.run_once(made, told=told).collect() if r.event_type != "z"}
    assert got == {(u, k, big + 10 * u + i) for u in range(40) for i, k in ((0, "a"), (2, "b"))} | {(None, "a", 5), (None, None, 6)}
    assert told["state"] == 1  # the last mark waits


def test_claims_and_completions(spark, tmp_path):
    schema = "user_id long, claim long, ts timestamp"
    claims = [[(1, 10, at(0)), (2, 11, at(1)), (3, 12, at(1.5)), (None, 13, at(1))], [(1, 14, at(5)), (9, 99, at(300))], [(9, 95, at(301))], [(1, 15, at(2)), (9, 98, at(300))]]
    done = [[(1, 20, at(0.5)), (1, 21, at(0.75)), (2, 22, at(2.01)), (3, 23, at(2.5)), (3, 24, at(1.4))], [(9, 97, at(300))], [(9, 94, at(301))], [(2, 25, at(1.2)), (9, 96, at(300))]]
    told = {}
    made = capture.claimed(stream(spark, tmp_path / "c", claims, schema), stream(spark, tmp_path / "d", done, schema).withColumnRenamed("claim", "finish"), "user_id", "claim", "finish", "1 hour", "1 hour")
    got = {(r.claim, r.finish) for r in capture.run_once(made, told=told).collect() if r.claim < 90}
    assert got == {(10, 20), (10, 21), (11, None), (12, 23), (13, None), (14, None)}
    assert told["late"] >= 2 and told["state"] <= 8  # what is long over is forgotten: the far marks stay
