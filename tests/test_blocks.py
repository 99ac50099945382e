"""Blocks of all projects at once, against the blocks of one project and plain Python."""

import random

import pytest
from test_context import NOW, page, text

from mnemora.operators import blocks, context as cx
from mnemora.sources import vault

WORDS = ["retry", "policy", "queue", "index", "cache", "merge"]
SLUGS = ["red", "blue", "green", "none"]


def tables(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(70):
        title = " ".join(rnd.sample(WORDS, 3)).capitalize()
        rows.append(dict(
            rel=f"k/{rnd.randrange(900):03d}-{i}.md", title=title, project=rnd.choice(["Red", "red", "red", "red", "blue", "green", None]), type=rnd.choice(["pattern", "decision", "Decision", None]),
            timestamp=rnd.choice([None, f"2024-05-{rnd.randrange(1, 29):02d}"]), summary=f"s{i}", status=rnd.choice([None, None, "superseded"]), modified=rnd.choice(["2023-01-01", "2024-05-30"]),
        ))
    state = "## Where we left off\nHere we are.\n\n## Open threads\n- first\n- second\n## X\n"
    states = spark.createDataFrame([("red", state), ("blue", "no sections")], "slug string, text string")
    log = "\n".join(f"line {i} of {rnd.choice(['RED', 'blue', 'bluered', 'nothing'])}" for i in range(40))
    days = spark.createDataFrame([("2024-05-31", log, NOW), ("2024-05-30", "about green\n\n red ", NOW), ("2024-05-01", "red", "2024-05-01")], "stem string, text string, modified string")
    days = days.withColumn("modified", cx.F.col("modified").cast("timestamp"))
    beats = spark.createDataFrame([("red", "2024-05-31T10:00:00", "idle", "s", "/p"), ("red", "2024-05-30T10:00:00", "old", "s", "/p"), ("blue", None, None, "s", "/q")], vault.HEARTBEAT_SCHEMA)
    findings = spark.createDataFrame([("broken_wikilinks", "notes", f"a{i}", "b", None) for i in range(5)], "category string, scope string, path string, target string, detail string")
    projects = spark.createDataFrame([(s,) for s in [*SLUGS, "red", None]], "slug string")
    return projects, page(spark, *rows), states, days, beats, findings


@pytest.mark.parametrize("limit", [2000, 130])
def test_project_blocks(spark, limit):
    projects, pages, states, days, beats, _ = tables(spark)
    got = {r.slug: r.block for r in blocks.project_blocks(projects, pages, states, blocks.day_lines(days, NOW), beats, limit).collect()}
    assert got == {s: text(cx.project_context(pages, states, days, beats, s, NOW, limit=limit)) for s in SLUGS}


@pytest.mark.parametrize("limit", [800, 90])
def test_advisory_blocks(spark, limit):
    projects, pages, states, _, _, findings = tables(spark)
    got = {r.slug: r.block for r in blocks.advisory_blocks(projects, pages, states, findings, NOW, limit).collect()}
    assert got == {s: text(cx.advisory(pages, states, findings, NOW, s, limit)) for s in SLUGS}
    assert blocks.advisory_blocks(projects.limit(0), pages, states, findings, NOW).count() == 0


def test_budget_is_exact(spark):
    rnd = random.Random(8)
    rows = [(k, i, rnd.choice(["", " ", "a" * rnd.randrange(1, 12), "b c "])) for k in range(60) for i in range(rnd.randrange(1, 9))]
    df = spark.createDataFrame(rows, "k int, i int, text string")
    got = {r.k: r.block for r in blocks.budgeted(df, "k", ["i"], 20, 5, "..").collect()}
    for k in range(60):
        whole = "\n".join(t for kk, _, t in rows if kk == k).rstrip()
        assert got[k] == (whole if len(whole) <= 20 else whole[:15].rstrip() + "..")
