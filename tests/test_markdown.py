"""Pages, session blocks and text functions on hand-written fixtures."""

from pyspark.sql import functions as F

from mnemora.functions import replies, text as tx
from mnemora.operators import activity, graph, retrieval as rt
from mnemora.sources import tables

PAGE = "---\ntype: concept\nproject: \"Alpha\"\nstatus: active\n---\n# Heading One\nOne-sentence summary: short words here.\n\nBody with [[other]] and [[x|alias]] and [[no#pe]].\n"


def test_pages(spark, tmp_path):
    (tmp_path / "a.md").write_text(PAGE)
    (tmp_path / "b.md").write_text("no heading")
    (tmp_path / "c.md").write_text(PAGE.replace("active", "archived"))
    rows = {r.stem: r for r in tables.pages(tables.markdown(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"].title, rows["a"].summary, rows["a"].project, rows["a"].type) == ("Heading One", "short words here.", "Alpha", "concept")
    assert rows["a"].links == ["other", "x"]
    assert (rows["b"].title, rows["b"].summary) == ("b", "")


def test_session_blocks(spark, tmp_path):
    (tmp_path / "2024-01-01.md").write_text("# Daily\n## [09:00:00] start | s1\n- one\n## [10:00:00] end | s2\n- two\n")
    rows = tables.session_blocks(tables.markdown(spark, str(tmp_path))).orderBy("block").collect()
    assert [(r.at, r.event, r.session, r.body.strip()) for r in rows] == [("09:00:00", "start", "s1", "- one"), ("10:00:00", "end", "s2", "- two")]


def test_redaction_keeps_prose_and_digests(spark):
    hexes = "a" * 64
    rows = [("plain prose stays",), (f"digest {hexes}",), ('token = "' + "0f" * 20 + '"',), ("Bearer abcdefghijklmnopqrstu",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.redact(F.col("t"))).collect()]
    assert got[:2] == ["plain prose stays", f"digest {hexes}"]
    assert "0f0f" not in got[2] and "abcdefgh" not in got[3]


def _column(spark, values, *made):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i")
    return [tuple(r) for r in rows.select(*made).collect()]


def test_feedback(spark):
    rows = ["No, that is wrong and you must always check", "ok", "short", None, "I prefer tabs here", "Sounds good", "the snow is knotty today", "énot fair on anyone", "Keep in mind the clock"]
    assert _column(spark, rows, *tx.feedback_family(F.col("t"))) == [
        ("correction", 0.9), (None, None), (None, None), (None, None), ("preference", 0.7), (None, None), (None, None), (None, None), ("instruction", 0.7)
    ]


def test_noise_and_wrong_code_pages(spark):
    rows = ["", "  ", "- Trigger: other", "</Summary>", "text - Trigger: x", "(no summary here)", "plain"]
    assert [r[0] for r in _column(spark, rows, tx.is_noise(F.col("t")))] == [True, True, True, True, False, True, False]
    assert [r[0] for r in _column(spark, ["", "plain", "ÐÑ broken", "Ð" + "a" * 40], tx.is_mojibake(F.col("t")))] == [False, False, True, False]


def test_types_authority_and_validity(spark):
    assert _column(spark, ["fact", "rule", "other", None], tx.known_type(F.col("t"))) == [("concept",), ("rule",), (None,), (None,)]
    assert _column(spark, ["User", "web", "else", None], tx.authority_weight(F.col("t"))) == [(1.35,), (0.9,), (1.0,), (1.0,)]
    ends = [None, "", "~", "'none'", "2024-01-02", "2024-01-01T10:00", "2023-12-31"]
    assert [r[0] for r in _column(spark, ends, tx.open_at(F.col("t"), F.lit("2024-01-01")))] == [True] * 6 + [False]


def test_reply_tiers(spark):
    rows = ["FLUSH_MAJOR\n\n- body", "`flush_minor`.\nx", "FLUSH_OK.", "``FLUSH_OK``", "done\nFLUSH_OK\nmore", "(summary failed: x)", '{"operations": []}', " free text ", "", None, "no_durable_content."]
    got = [tuple(r[0]) for r in _column(spark, rows, replies.tier(F.col("t")))]
    assert got == [("major", "- body"), ("minor", "x"), ("ok", ""), ("ok", ""), ("ok", ""), ("ok", ""), ("ok", ""), ("minor", "free text"), ("ok", ""), ("ok", ""), ("ok", "")]


def test_audit_lines(spark):
    line = "COMPILE_AUDIT: verified 7 evidence citations; 12 dedup checks performed; 2 stubs skipped; 1 contradictions handled; 0 pages rejected"
    got = [tuple(r[0]) for r in _column(spark, [line, "COMPILE_AUDIT: verified 9 evidence\n" + line, "x\n COMPILE_AUDIT: 3 dedup checks", "none", None], replies.audit(F.col("t")))]
    assert got == [(7, 12, 2, 1, 0), (7, 12, 2, 1, 0), (None, 3, None, None, None), (None,) * 5, (None,) * 5]


def test_json_blocks_and_breadcrumbs(spark):
    assert _column(spark, ['```json\n{"a": {"b": 1}}\n```', "none", None], replies.json_block(F.col("t"))) == [('{"a": {"b": 1}}',), (None,), (None,)]
    log = "# Day\n- `[09:00:00] tool | abcdefghij | slug | Edit` src/a.py\n- `[09:01:00] prompt | s | slug` hello\n- `[09:02:00] tool | s2 | slug | Bash`\n"
    assert [tuple(r) for r in _column(spark, [log], replies.breadcrumbs(F.col("t")))[0][0]] == [("09:00:00", "abcdefgh", "slug", "edit", "src/a.py"), ("09:02:00", "s2", "slug", "bash", "(unknown)")]


def test_missing_backlinks_need_no_join(spark, capsys):
    """Repeated edges, loops, nulls; both ways of a pair meet in one group."""
    rows = [(1, 2), (2, 1), (3, 1), (3, 1), (4, 4), (None, 1), (1, None), (2, 9)]
    found = graph.missing_backlinks(spark.createDataFrame(rows, "src long, dst long"))
    assert sorted(tuple(r) for r in found.collect()) == [(2, 9), (3, 1)]
    capsys.readouterr()
    found.explain()
    assert "Join" not in capsys.readouterr().out


def test_backlinks_and_boost(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "c")], "src string, dst string")
    assert [tuple(r) for r in graph.missing_backlinks(e).select("src", "dst").collect()] == [("a", "c")]
    boost = {r.dst: r.boost for r in graph.neighbour_boost(e, spark.createDataFrame([("a",)], "src string")).collect()}
    assert boost == {"b": 0.15, "c": 0.125}


def test_overlap_needs_two_words(spark):
    rows = [(1, "fix the red fox"), (2, "red fox runs"), (3, "red hat"), (4, "Runs red Fox home"), (5, ""), (6, None)]
    got = activity.overlap_pairs(spark.createDataFrame(rows, "id int, t string"), "id", tx.title_words(F.col("t")))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 2), (1, 4, 2), (2, 4, 3)]


def test_fusion_prefers_the_heavier_list(spark):
    one = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid int, item string, rank int")
    two = spark.createDataFrame([(1, "y", 1), (1, "x", 2)], "qid int, item string, rank int")
    got = rt.rrf([(one, 2.0, 60, None), (two, 1.0, 60, None)], "item").orderBy(F.desc("fused")).collect()
    assert [r.item for r in got] == ["x", "y"]


def test_corrupt_json_lines_are_skipped(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": "1", "task": "a"}\n\nnot json\n{"id": "2", "task": "b"}\n')
    assert sorted(r.id for r in tables.json_lines(spark, str(tmp_path), tables.TASK_SCHEMA).collect() if r.id) == ["1", "2"]


def test_file_edit_loops(spark):
    line = "- `[09:0{}:00] tool | session12345 | {} | {}` {}\n"
    old, new = line.format(0, "p", "edit", "a.py"), line.format(1, "p", "Write", "a.py") + line.format(2, "P", "multiedit", "a.py") + line.format(3, "q", "edit", "a.py") + line.format(4, "p", "bash", "a.py") + line.format(5, "p", "edit", "b.py")
    logs = spark.createDataFrame([("2024-01-01", old), ("2024-02-01", "# Day\n" + new), ("2024-02-02", None)], "day string, text string")
    got = activity.file_edit_loops(logs, "2024-01-15").collect()
    assert [(r.target, r.edit_count, r.edits[0].at, r.edits[0].session) for r in got] == [("a.py", 3, "09:01:00", "session1")]
    assert activity.file_edit_loops(logs, "2024-01-15", project="p").collect() == []
    assert activity.file_edit_loops(logs, "2024-01-01", project="p").count() == 1
