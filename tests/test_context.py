"""Session blocks, timelines, queues and cooldowns on small tables."""

import json
import random

import pytest

from mnemora.functions import replies
from mnemora.operators import activity as ac
from mnemora.operators import context as cx
from mnemora.operators import queue as qu
from mnemora.sources import vault
from mnemora.streaming import capture

NOW = "2024-06-01 12:00:00"
PAGE = "rel string, stem string, title string, summary string, text string, type string, status string, project string, timestamp string, source_authority string, has_fm boolean, modified timestamp"


def page(spark, *rows):
    full = [dict(rel=f"k/{i}.md", stem=str(i), title=f"T{i}", summary="", text="", type="concept", status=None, project=None, timestamp=None, source_authority=None, has_fm=True, modified=None) | r for i, r in enumerate(rows)]
    fields = [f.split()[0] for f in PAGE.split(", ")]
    df = spark.createDataFrame([tuple(str(r[f]) if f == "modified" and r[f] else r[f] for f in fields) for r in full], PAGE.replace("modified timestamp", "modified string"))
    return df.withColumn("modified", cx.F.col("modified").cast("timestamp"))


def text(df):
    return df.first()["block"]


def test_index_trim(spark):
    index = "# Title\n\nintro\n## Entry points\n- e\n\n## One\n- " + "x" * 200 + "\n## Empty\ntext\n## Two\n- b\n## Three\n- c\n## Four\n- d\n## Editorial note\n- z\n## Five\n- y\n"
    got = text(cx.index_trim(spark.createDataFrame([(index,)], "text string")))
    assert got == "# Title\n\n## Entry points\n- e\n\n## One\n- " + "x" * 137 + "…\n\n## Two\n- b\n\n## Three\n- c\n"


def test_day_excerpt(spark):
    day = "# D\n## [09:00:00] session-end | u1\nkept line\n- Trigger: x\n## [10:00:00] session-end | 123-uuid\n- Transcript: t\n<summary>one</summary>\n" + "\n".join(f"l{i}" for i in range(8)) + "\n## [11:00:00] note | s\n- Trigger: y\n"
    rows = [("a.md", day), ("b.md", "# only a head\n"), ("c.md", "## [09:00:00] x | y\n- Trigger: z\n")]
    got = {r.name: r.block for r in cx.day_excerpt(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert got["a.md"] == cx.BANNER + "\n## [10:00:00] session-end\none\nl0\nl1\nl2\nl3\n… (+4 more lines)"
    assert got["b.md"] == "(latest daily `b.md` has no session blocks)" and "1 session blocks, all empty" in got["c.md"]


def test_awareness(spark):
    counts = dict(pages=3, days=2, skills=1, gaps=0, projects=1)
    full = text(cx.self_awareness(spark, counts, 20, {"verified": 0}, {"ok": 8, "major": 2}))
    assert "3 knowledge pages, 2 daily logs" in full and "20d backlog — significant" in full and "0 evidence citations" in full and "8/10 sessions" in full
    assert "never run" in text(cx.self_awareness(spark, counts, None)) and "fresh" in cx.backlog(0) and "healthy" in cx.backlog(3) and "consider" in cx.backlog(14)
    bands = spark.createDataFrame([(None,), (0,), (3,), (14,), (15,)], "d int").select(cx.backlog_band(cx.F.col("d")).alias("b")).collect()
    assert [r.b for r in bands] == ["never", "today", "healthy", "backlog", "significant"]


def test_advisory(spark):
    state = "# S\n## Where we left off\nHere.\n\n## Open threads\n- first thread\n-\n- " + "y" * 200 + "\nnot\n## Other\n- z\n"
    states = spark.createDataFrame([("red", state)], "slug string, text string")
    rows = [dict(title="Retry policy rules", type="decision", project="Red", timestamp="2024-05-02T01:00:00", summary="old"), dict(title="Queue decision", type="Decision", timestamp="2024-05-03", summary="new"),
            dict(title="Retry policy queue", project="blue"), dict(title="Dead", type="decision", status="superseded", timestamp="2024-06-01"), dict(title="Blue one", type="decision", project="blue", timestamp="2024-05-09")]
    pages = page(spark, *rows, *[dict(modified="2023-01-01") for _ in range(6)])
    findings = spark.createDataFrame([("broken_wikilinks", "notes", "a", "b", None)], "category string, scope string, path string, target string, detail string")
    got = text(cx.advisory(pages, states, findings, NOW, "red"))
    assert got == (
        "**Open threads (2):**\n- first thread\n- " + "y" * 120 + "\n\n**Last decision** (2024-05-03):\n- Queue decision: new\n\n**Lint alerts (1):**\n- [notes] a -> [[b]]\n\n"
        "**Cross-project insights:**\n- 'Retry policy queue' (blue) — shares: policy, retry\n\n**Vault health:** 6 pages older than 90 days — consider archiving."
    )
    assert text(cx.advisory(pages.limit(0), states, findings.limit(0), NOW)) == ""
    assert text(cx.advisory(pages, states, findings, NOW, "red", 60)).endswith("...")


def test_guardrails(spark):
    pages = page(spark, dict(type="pattern", summary="Always test first"), dict(type="pattern", summary="ALWAYS test first", rel="k/0a.md"), dict(type="qa", summary="plain"), dict(type="concept", summary="never so"),
                 dict(type="decision", summary="You must ask", project="blue"), dict(type="pattern", summary="never push", status="archived"))
    feedback = spark.createDataFrame([("f1", "correction", "Do it so", "red", "promoted"), ("f2", "correction", "Not yet", "red", "candidate"), ("f3", "preference", "Else", "blue", "promoted")], "id string, type string, text string, project string, status string")
    got = text(cx.guardrails(pages, feedback, "RED"))
    assert got == "## Guard rails (learned rules — do NOT repeat these mistakes)\n\n**CORRECTION** (1):\n- Do it so\n\n**PATTERN** (1):\n- Always test first"
    assert "You must ask" in text(cx.guardrails(pages, feedback)) and text(cx.guardrails(pages.limit(0), feedback.limit(0))) == ""


def test_project_context_and_state(spark):
    pages = page(spark, dict(project="Red", type="pattern", summary="p", source_authority="codex-ai"), dict(project="red", type="concept", title="No summary"), dict(project="red", status="archived"), dict(project="blue"))
    states = spark.createDataFrame([("red", "## Where we left off\nHere we are.\n## X\n")], "slug string, text string")
    days = spark.createDataFrame([("2024-05-31", "nothing\nworked on RED today\n", NOW), ("2024-05-01", "red", "2024-05-01")], "stem string, text string, modified string").withColumn("modified", cx.F.col("modified").cast("timestamp"))
    beats = spark.createDataFrame([("red", "2024-05-31T10:00:00", "idle", "s", "/p"), ("blue", "2024-05-31T11:00:00", "x", "s", "/q")], vault.HEARTBEAT_SCHEMA)
    feedback = spark.createDataFrame([("f", "pattern", "codex did", "x")], "id string, type string, text string, project string")
    got = text(cx.project_context(pages, states, days, beats, "red", NOW, feedback=feedback, agent="Codex"))
    assert got == (
        "## Project context: red\n\n### Where you left off\nHere we are.\n\n### Known knowledge (2 pages)\n**patterns:**\n- p\n\n**concepts:**\n- No summary\n\n"
        "### Recent activity (last 7 days)\n- 2024-05-31: worked on RED today\n\n### Last seen\n- idle at 2024-05-31T10:00:00"
    )
    assert cx.latest_slug(beats) == "blue" and cx.latest_slug(beats.limit(0)) is None
    assert text(cx.project_context(pages, states, days, beats, "red", NOW, limit=60)).endswith("… (truncated)\n")
    block, new = cx.project_state(states, "red")
    assert text(block).startswith("# Per-project state — `red`\n\n(Auto-injected from `knowledge/projects/red/state.md`.)") and new.count() == 0
    block, new = cx.project_state(states, "nova", folder="/w/nova", names=["pyproject.toml"], template="# <Project Name> at <absolute path>")
    assert "freshly created" in text(block) and new.first().rel == "knowledge/projects/nova/state.md" and new.first().text == "# nova at /w/nova"
    assert text(cx.project_state(states, "tmp", names=["a.txt"], template="t")[0]) == "" and len(text(cx.project_state(states, "red", limit=90)[0])) <= 90 + 40


def test_session_context(spark):
    blocks = {k: cx.one(spark, v) for k, v in dict(guardrails="RULES", awareness="## Self\n", advisory="DO", index="# I\n", log="").items()}
    day = spark.createDataFrame([("2024-05-31.md", "EXCERPT")], "name string, block string")
    got = text(cx.session_context(blocks, day))
    order = [got.index(x) for x in ("# Project memory context", "RULES", "## Self", "## Advisory", "DO", "# I", "## Latest daily log: 2024-05-31.md", "EXCERPT", "(no log entries)")]
    assert order == sorted(order)
    empty = text(cx.session_context({}, day.limit(0)))
    assert "(no daily logs yet)" in empty and "missing or empty" in empty
    long = text(cx.session_context({"index": cx.one(spark, "x" * 5000)}, day))
    assert long.endswith("… (truncated)\n") and len(long) <= 2200
    out = json.loads(cx.emit(cx.one(spark, 'a "b"')).first()["value"])
    assert out == {"hookSpecificOutput": {"hookEventName": "SessionStart", "additionalContext": 'a "b"'}}


def test_timeline(spark):
    day = (
        "# D\n## [10:00:00] session-end | codex s1\nslug: red\n**Decisions made**\n- we chose\n- Trigger: x\n- not a bullet of it\nLessons / patterns\n- learned\n## Gotchas\n- none\n"
        "- `[10:05:00] tool | 12345678abc | red | Edit` src/a.py\n- `[10:06:00] tool | s | blue | Edit` b.py\n## [11:00:00] note | s\nnothing\n"
    )
    days = spark.createDataFrame([("2024-05-30", day, "2024-05-30"), ("2023-01-01", day, "2023-01-01")], "stem string, text string, day string").withColumn("day", cx.F.to_date("day"))
    pages = page(spark, dict(project="red", timestamp="2024-05-31T09:00:00", summary="told", title="T"), dict(project=None, timestamp="2024-05-31"), dict(project="red", timestamp="bad"))
    beats = spark.createDataFrame([("red", "2024-05-31T10:00:00", "claude idle", "s", "/p")], vault.HEARTBEAT_SCHEMA)
    rows = cx.timeline(days, pages, beats, NOW, "red").collect()
    assert [(r.date, r.time, r.agent, r.type, r.text or r.target) for r in rows] == [
        ("2024-05-31", "10:00:00", "Claude", "heartbeat", "active in red"), ("2024-05-31", "09:00:00", "compile", "knowledge:concept", "told"),
        ("2024-05-30", "10:05:00", "Codex", "tool", "src/a.py"), ("2024-05-30", "10:00:00", "Codex", "decision", "we chose"), ("2024-05-30", "10:00:00", "Codex", "lesson", "learned"),
    ]
    told = {r.date: r.text for r in cx.timeline_text(cx.timeline(days, pages, beats, NOW, "red")).collect()}
    assert told["2024-05-31"].startswith("### 2024-05-31\n\n- `10:00:00` **Claude** [ACTIVE] active in red\n- `09:00:00` **compile** [CONCEPT] told")
    assert cx.timeline(days, pages, beats, NOW).count() == 7


def test_recorded_tools(spark):
    uses = [("Edit", {"file_path": "a.py"}), ("Bash", {"command": "git status --short\nmore"}), ("Bash", {"command": "ls"}), ("Read", {"file_path": "b"}), ("Write", {"filePath": "c", "file_path": "d"})]
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(uses)], "i int, tool string, v map<string,string>")
    rows = df.select("i", cx.target_of(cx.F.col("tool"), cx.F.col("v")).alias("target"), "tool").withColumn("ok", cx.recorded(cx.F.col("tool"), cx.F.col("target"))).orderBy("i").collect()
    assert [(r.target, r.ok) for r in rows] == [("a.py", True), ("git status --short", True), ("ls", False), ("", False), ("c", True)]
    made = df.select(cx.F.lit(NOW).cast("timestamp").alias("at"), cx.F.lit("123456789").alias("session_id"), cx.F.lit("red").alias("slug"), "tool", cx.target_of(cx.F.col("tool"), cx.F.col("v")).alias("target"))
    lines = [r.text for r in cx.breadcrumb(made).collect()]
    assert lines[0] == "- `[12:00:00] tool | 12345678 | red | Edit` a.py" and len(lines) == 3
    crumb = spark.createDataFrame([(lines[0],)], "t string").select(cx.F.explode(replies.breadcrumbs(cx.F.col("t"))).alias("c")).select("c.*").first()
    assert (crumb.session, crumb.slug, crumb.tool, crumb.target) == ("12345678", "red", "edit", "a.py")
    cwd = spark.createDataFrame([("/v/a",), ("/v",), ("/vault2",), ("/home/me",), ("/home/me/p",)], "c string").select(cx.outside(cx.F.col("c"), "/v", "/home/me").alias("o"))
    assert [r.o for r in cwd.collect()] == [False, False, True, False, True]


def test_loop_report(spark):
    log = "\n".join(f"- `[10:0{i}:00] tool | s | red | Edit` a.py" for i in range(3))
    logs = spark.createDataFrame([("2024-05-30", log)], "day string, text string")
    feedback = spark.createDataFrame([("prefer tabs always", "red")] * 3 + [("spaces", "red")], "text string, project string")
    got = {(r.kind, r.name): r.n for r in cx.loop_report(logs, feedback, "2024-05-01").collect()}
    assert got == {("file", "a.py"): 3, ("topic", "prefer"): 3, ("topic", "always"): 3}


def test_queue(spark, tmp_path):
    queue = qu.Queue(spark, str(tmp_path / "queue"))
    assert queue.tasks().count() == 0
    tasks = [("query", {"n": str(i)}) for i in range(3)] + [("flush", {"n": "9", "day": "2024-05-01", "event": "stop", "session_id": "s", "body": "late"})]
    queue.add(spark.createDataFrame(tasks, "type string, payload map<string,string>"), "2024-06-01 10:00:00")
    late = qu.late_blocks(queue.tasks(), NOW).first()
    assert (late.day, late.at, late.event, late.text) == ("2024-05-01", "12:00:00", "deferred-stop", "late")

    def processor(task):
        if task["payload"]["n"] == "1":
            raise ValueError("no")
        return task["payload"]["n"] != "2"

    assert queue.drain(processor, "2024-06-01 10:01:00") == {"ok": 2, "failed": 2, "skipped": 0}
    assert queue.drain(processor, "2024-06-01 10:01:30") == {"ok": 0, "failed": 0, "skipped": 2}  # tried a moment ago
    for minute in range(3, 11, 2):
        assert queue.drain(processor, f"2024-06-01 10:{minute:02}:00")["failed"] == 2
    assert queue.drain(processor, "2024-06-01 11:00:00") == {"ok": 0, "failed": 0, "skipped": 2}  # five attempts
    status = queue.status().first()
    assert (status.pending_total, status.by_type, status.permanently_failed) == (2, {"query": 2}, 2)


def test_stale_leases_and_age(spark, tmp_path):
    queue = qu.Queue(spark, str(tmp_path / "queue"))
    rows = [("a", "enqueued", "2024-05-01 00:00:00"), ("b", "enqueued", "2024-06-01 09:00:00"), ("b", "leased", "2024-06-01 10:00:00"), ("c", "enqueued", "2024-06-01 09:00:00"), ("c", "leased", "2024-06-01 11:55:00"), ("d", "failed", "2024-06-01 11:59:30")]
    log = spark.createDataFrame([(*r, "query" if r[1] == "enqueued" else None, None, None) for r in rows], "id string, kind string, at string, type string, payload map<string,string>, owner string")
    queue.append(log.withColumn("at", qu.F.col("at").cast("timestamp")))
    tasks = queue.tasks()
    assert [r.id for r in qu.stale_leases(tasks, NOW).collect()] == ["b"]
    assert sorted(r.id for r in qu.pending(tasks, NOW).collect()) == ["a", "d"] and sorted(r.id for r in qu.pending(tasks, NOW, 7).collect()) == ["d"]
    assert {r.id: r.verdict for r in qu.turn(tasks, NOW).collect()} == {"a": "take", "d": "skip"}
    assert [r.id for r in qu.turn(tasks, NOW, 1).collect()] == ["a"]
    assert queue.drain(lambda t: True, NOW)["ok"] == 2  # a, and b whose lease ran out


def _kept(rows, seconds):
    last, out = {}, set()
    for key, at, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if key not in last or at - last[key] >= seconds:
            last[key] = at
            out.add(i)
    return out


@pytest.mark.parametrize("seconds", [1, 30, 3600])
def test_cooldown_is_the_greedy_choice(spark, seconds):
    rnd = random.Random(seconds)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), float(rnd.choice([rnd.randrange(200_000), rnd.randrange(2000), 100_000])), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, at double, id int").withColumn("ts", ac.F.col("at").cast("timestamp"))
    got = {r.id for r in ac.cooldown(df, ["k"], ac.F.col("ts"), ["id"], seconds).collect()}
    assert got == _kept(rows, seconds)


def test_cooldown_of_a_key_without_a_gap(spark):
    """A chain of hundreds of steps, no Python worker, rows without a time stay; SQL's recursion isn't needed."""
    rnd = random.Random(3)
    rows = [("hot", 100.0 * i / 7 + rnd.random() * 20 - 50_000, i) for i in range(7000)]
    df = spark.createDataFrame([*rows, ("hot", None, 7000), (None, None, 7001)], "k string, at double, id int").withColumn("ts", ac.F.col("at").cast("timestamp"))
    got = ac.cooldown(df, ["k"], ac.F.col("ts"), ["id"], 300)
    assert sorted(r.id for r in got.collect()) == sorted(_kept(rows, 300) | {7000, 7001})
    assert len(_kept(rows, 300)) > 250
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Pandas" not in plan
    empty = df.limit(0)
    assert ac.cooldown(empty, ["k"], ac.F.col("ts"), ["id"], 300).count() == 0
    assert ac.cooldown(df, ["k"], ac.F.col("ts"), ["id"], 0).count() == 7002


def test_overlap_pairs_with_a_hot_pair(spark, monkeypatch):
    monkeypatch.setattr(ac, "SIDE", 4)
    items = spark.createDataFrame([(i, ["x", "y"] + (["z"] if i % 3 == 0 else [])) for i in range(30)] + [(99, ["x"])], "id int, ws array<string>")
    got = {(r.a, r.b): r.shared for r in ac.overlap_pairs(items, "id", ac.F.col("ws")).collect()}
    assert got == {(a, b): 2 + (a % 3 == 0 and b % 3 == 0) for b in range(30) for a in range(b)}


def test_late_events_in_the_cooldown_stream(spark, tmp_path):
    """An event that comes in a later file, before the watermark, is judged by its own time."""
    files, rnd = [], random.Random(2)
    rows = [(i, float(1_700_000_000 + 60 * i + rnd.randrange(900)), 1, "click") for i in range(600)]
    for part in range(3):
        own = [r for r in rows if r[0] // 200 == part]
        df = spark.createDataFrame(own, "event_id long, at double, user_id long, event_type string").withColumn("ts", capture.F.col("at").cast("timestamp")).drop("at")
        df.coalesce(1).write.parquet(f"{tmp_path}/events{part}.parquet")
        files.append(df)
    for part in range(3):  # one file a micro-batch, in order
        (name,) = (tmp_path / f"events{part}.parquet").glob("*.parquet")
        name.rename(tmp_path / f"events-{part}.parquet")
    schema = spark.read.parquet(f"{tmp_path}/events-0.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events-*.parquet").parquet(str(tmp_path))
    end = spark.createDataFrame([(None, None, None)], "event_id long, user_id long, event_type string").withColumn("ts", capture.F.lit(capture.END).cast("timestamp")).select(*schema.names)
    end.coalesce(1).write.parquet(f"{tmp_path}/end")
    got = {r.event_id for r in capture.run_once(capture.cooldown_stream(stream, 300, "1 hour")).collect()}
    want = _kept([(1, at, i) for i, at, *_ in rows], 300)
    late = max(at for _, at, *_ in rows) - 3600  # without a marker, what the watermark hasn't passed stays in the state
    assert got == {i for i in want if rows[i][1] <= late}
    assert len(got) > 30


def test_prompt_cooldown(spark):
    rows = [("red", "hello there", 0.0, 1), ("red", "hello there", 20.0, 2), ("red", "other text", 21.0, 3), ("red", "hello there", 31.0, 4), ("blue", "hello there", 5.0, 5), ("red", "hi", 99.0, 6)]
    df = spark.createDataFrame(rows, "slug string, text string, at double, id int").where("length(trim(text)) >= 5")
    df = df.withColumn("ts", ac.F.col("at").cast("timestamp")).withColumn("hash", ac.F.substring(ac.F.sha2("text", 256), 1, 12))
    assert sorted(r.id for r in ac.cooldown(df, ["slug", "hash"], ac.F.col("ts"), ["id"], 30).collect()) == [1, 3, 4, 5]


def test_overlap_pairs_are_made_after_the_last_shuffle(spark, monkeypatch):
    """Many items of equal words, in chunks: pairs of items are made where chunks meet and shuffled no more."""
    monkeypatch.setattr(ac, "CHUNK", 4)
    rows = [(i, ["x", "y"] if i % 2 else ["x", "y", "z"], None if i == 5 else f"k{i % 3}") for i in range(40)] + [(99, ["x"], "k0"), (98, ["q", "r"], "k0")]
    items = spark.createDataFrame(rows, "id int, ws array<string>, kind string")
    found = ac.overlap_pairs(items, "id", ac.F.col("ws"), "kind")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode")]
    want = [(a, b, len(set(x) & set(y))) for a, x, k in rows for b, y, m in rows if a < b and len(set(x) & set(y)) > 1 and k and m and k != m]
    assert sorted((r.a, r.b, r.shared) for r in found.collect()) == sorted(want)
    every = ac.overlap_pairs(items, "id", ac.F.col("ws")).collect()
    assert len(every) == len({(r.a, r.b) for r in every}) == 40 * 39 // 2


def test_pairs_of_one_class_are_the_work_of_many_tasks(spark):
    """A class that all items share is dealt over turns: its pairs are made by many tasks, not by one, and are all there."""
    items = spark.createDataFrame([(i, ["red", "hat"], i % 12) for i in range(60)], "id int, ws array<string>, kind int")
    found = ac.overlap_pairs(items, "id", ac.F.col("ws"), "kind")
    assert found.select(ac.F.spark_partition_id().alias("p")).distinct().count() > 4
    got = sorted((r.a, r.b, r.shared) for r in found.collect())
    assert got == [(a, b, 2) for a in range(60) for b in range(a + 1, 60) if a % 12 != b % 12]
