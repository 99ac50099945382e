"""Vault readers, lint checks, pages and writers on a small vault."""

import datetime
import json

import pytest

from mnemora.operators import activity, lint
from mnemora.operators import pages as pg
from mnemora.sources import sinks, tables, vault

NOW = "2024-06-01T12:00:00"
WORDS = " ".join(f"word{i}" for i in range(60))
FILES = {
    "knowledge/notes/alpha.md": f"---\ntype: concept\nproject: Red\ntimestamp: 2024-05-01T10:00:00\nsource_authority: user\n---\n\n# Alpha page\n\nOne-sentence summary: Always test alpha.\n\n{WORDS}\n[[beta]] [[knowledge/notes/gamma]] [[nowhere]] [[a <b>]] [[...]]\n",
    "knowledge/notes/beta.md": "---\ntype: memo\nstatus: active\nvalid_to: 2024-01-01\n---\n# Beta\n\nFirst line here. [[alpha]]\n",
    "knowledge/notes/gamma.md": "# Gamma page\nNo front matter.\n",
    "knowledge/notes/sub/delta one.md": "---\nauthor: me\n---\n# Delta\n[[alpha|A]]\n",
    "knowledge/notes/gone.md": "---\ntype: concept\nstatus: superseded\nsuperseded_by: [[missing]]\n---\n# Gone\n",
    "knowledge/notes/hole.md": "---\ntype: gap\nvalid_to: forever\n---\n# Hole\n",
    "knowledge/notes/used hole.md": "---\ntype: gap\n---\n# Used hole\n[[hole]]\n",
    "knowledge/notes/index.md": "# Index\n[[used hole]] [[...]]\n",
    "knowledge/notes/projects/x.md": "# In projects\n",
    "knowledge/index.md": "# Memory\n\n## Entry points\n- [[a]]\n\n## Concepts\n- [[knowledge/notes/alpha]] — Always test alpha.\n- [[beta]]\n\n## Empty\n\n## Editorial note\n- x\n",
    "knowledge/daily/2024-05-30.md": "# Day\n## [10:00:00] session-end | s1\n- Trigger: x\nquoted words here\n## [11:00:00] note | s2\nother text\n",
    "knowledge/daily/2024-05-31.md": "# Day\n",
    "knowledge/daily/notes.md": "# Not a day\n",
    "knowledge/feedback/aa.json": json.dumps({"id": "abcdef012345", "type": "correction", "confidence": 0.7, "text": 'Never "quote"\nso', "session_id": "s", "project": "Red", "trigger": "t", "captured_at": NOW, "status": "candidate"}),
    "knowledge/feedback/bb.json": "{broken",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("vault")
    for name, text in FILES.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(base)


@pytest.fixture(scope="module")
def notes(spark, root):
    return vault.structured(vault.files(spark, root, "knowledge/notes")).cache()


def paths(findings, *more):
    return sorted(tuple(r[c] for c in ("path", *more)) if more else r["path"] for r in findings.collect())


def test_files_and_rules(spark, root, notes):
    assert {r.rel for r in notes.collect()} == {n for n in FILES if n.startswith("knowledge/notes/")}
    names = lambda rule: {r.name for r in vault.RULES[rule](notes).collect()}
    assert names("search") == {"alpha.md", "beta.md", "gamma.md", "delta one.md", "hole.md", "used hole.md"}
    assert "gone.md" in names("lint") and "index.md" not in names("lint") and "gone.md" not in names("graph")
    assert vault.files(spark, root, "absent").count() == 0
    row = notes.where("stem = 'alpha'").first()
    assert (row.title, row.summary, row.type, row.project, row.has_fm) == ("Alpha page", "Always test alpha.", "concept", "Red", True)


def test_days_and_ledger(spark, root):
    days = vault.dailies(spark, root)
    assert vault.latest(days).first().name == "notes.md" and vault.latest(days.limit(0)).count() == 0
    dated = days.where("day is not null")
    assert {str(r.day) for r in dated.collect()} == {"2024-05-30", "2024-05-31"}
    ledger = spark.createDataFrame([("2024-05-30.md", "stale"), ("2024-05-31.md", dated.where("stem = '2024-05-31'").first().hash)], "name string, hash string")
    assert [r.name for r in vault.select_dailies(dated, ledger).collect()] == ["2024-05-30.md"]
    assert vault.select_dailies(days, ledger, name="notes.md").count() == 1 and vault.select_dailies(days, ledger, everything=True).count() == 3
    assert paths(lint.orphan_days(days, ledger)) == ["knowledge/daily/notes.md"]
    assert paths(lint.stale_compiled(days, ledger)) == ["knowledge/daily/2024-05-30.md"]
    done = spark.createDataFrame([("2024-05-30.md", "new", True), ("2024-05-31.md", "new", False), ("x.md", "n", True)], "name string, hash string, ok boolean")
    after = {r.name: r.hash for r in pg.advance(ledger, done).collect()}
    assert after["2024-05-30.md"] == "new" and after["x.md"] == "n" and after["2024-05-31.md"] != "new"
    assert [r.to for r in pg.day_archive(dated, ledger, "2024-07-15", force=True).collect()] == ["knowledge/daily/archive/2024-05/2024-05-31.md"]
    assert pg.day_archive(dated, ledger, "2024-07-15").count() == 0  # under 30 files


def test_lint(notes, spark, root):
    assert paths(lint.broken_links(notes, notes), "target") == [("knowledge/notes/alpha.md", "nowhere"), ("knowledge/notes/gone.md", "missing")]
    tracked = spark.createDataFrame([("knowledge/notes/alpha.md",), ("knowledge/notes/beta.md",)], "rel string")
    got = paths(lint.broken_links(notes, notes, tracked), "target", "detail")
    assert ("knowledge/notes/alpha.md", "knowledge/notes/gamma", "untracked/gitignored target") in got and len(got) == 2
    index = vault.files(spark, root, "knowledge", recursive=False).where("name = 'index.md'").select("text")
    assert paths(lint.orphan_pages(notes, index)) == sorted(n for n in FILES if n.startswith("knowledge/notes/") and n.rsplit("/", 1)[1] not in ("index.md", "alpha.md", "beta.md", "x.md"))  # the index has an x
    assert ("knowledge/notes/alpha.md", "knowledge/notes/gamma.md") in paths(lint.missing_backlinks(notes), "target")
    assert ("knowledge/notes/alpha.md", "knowledge/notes/beta.md") not in paths(lint.missing_backlinks(notes), "target")
    assert "knowledge/notes/beta.md" in paths(lint.sparse(notes)) and "knowledge/notes/alpha.md" not in paths(lint.sparse(notes, 20))
    assert paths(lint.missing_frontmatter(notes)) == ["knowledge/notes/gamma.md", "knowledge/notes/projects/x.md"]
    assert paths(lint.missing_type(notes)) == ["knowledge/notes/sub/delta one.md"]
    assert paths(lint.invalid_type(notes), "detail") == [("knowledge/notes/beta.md", "memo")]
    assert paths(lint.missing_sources(notes)) == ["knowledge/notes/alpha.md"]
    assert paths(lint.supersede_chain(notes, notes), "target") == [("knowledge/notes/gone.md", "missing")]
    assert paths(lint.orphan_gaps(notes)) == ["knowledge/notes/hole.md"]  # linked by another gap alone
    assert paths(lint.temporal_validity(notes, "2024-06-01"), "detail") == [("knowledge/notes/beta.md", "2024-01-01")]


def test_lint_run_reads_each_text_once(notes, spark):
    """All checks over one reading of the pages find what each finds by itself."""
    seen, rows = spark.sparkContext.accumulator(0), notes.collect()

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    pages = spark.createDataFrame(rows, notes.schema).mapInArrow(counted, notes.schema)
    index, day = spark.createDataFrame([("x",)], "text string"), spark.createDataFrame([], "rel string, name string, hash string")
    found = lint.run(pages, index, day, day, "2024-06-01").collect()
    assert seen.value == len(rows) > 5
    some = notes.where("name <> 'index.md'")
    own = [lint.broken_links(notes, notes), lint.orphan_pages(some, index), lint.missing_backlinks(some), lint.sparse(some), lint.missing_frontmatter(some), lint.missing_type(some), lint.invalid_type(some)]
    own += [lint.missing_sources(some), lint.supersede_chain(some, notes), lint.orphan_gaps(some), lint.temporal_validity(some, "2024-06-01")]
    assert set(found) == {r for each in own for r in each.collect()} and len(found) == len(set(found))


def test_lint_run_and_report(notes, spark, root):
    index = spark.createDataFrame([("[[knowledge/notes/alpha]]",)], "text string")
    days, ledger = vault.dailies(spark, root), spark.createDataFrame([], "name string, hash string")
    asked = []
    found = lint.run(notes, index, days, ledger, "2024-06-01", ask=lambda p: asked.append(p) or "- a vs b: differ\nnoise", others={"skills": notes.where("stem = 'gamma'")}).cache()
    n = {r.category: r.n for r in lint.counts(found).collect()}
    assert set(n) == set(lint.CATEGORIES) and n["contradictions"] == 1 and n["orphan_daily_logs"] == 3 and n["missing_frontmatter"] == 3
    assert len(asked[0]) <= lint.PROMPT_CHARS and "### FILE: knowledge/notes/alpha.md" in asked[0]
    assert lint.fails(found) and not lint.fails(found.where("category = 'orphan_daily_logs'"))
    assert [r.line for r in lint.alerts(found).collect()] == ["[notes] knowledge/notes/alpha.md -> [[nowhere]]", "[notes] knowledge/notes/gone.md -> [[missing]]"]
    sinks.write_report(found, root, "2024-06-01")
    text = open(f"{root}/reports/lint-2024-06-01.md", encoding="utf-8").read()
    assert text.startswith("# Vault lint — 2024-06-01") and "## Broken Wikilinks (2)\n- [notes] knowledge/notes/alpha.md -> [[nowhere]]" in text and "## Stale Compiled (0)\n- (none)" in text
    assert sinks.newest_findings(spark, root).count() == found.count()


def test_prompt_budget(spark):
    rows = spark.createDataFrame([("a", "x" * 50), ("b", "y" * 50), ("c", "z")], "rel string, text string")
    assert lint.prompt_budget(rows, 70).first().prompt == "\n\n### FILE: a\n" + "x" * 50  # b overflows, and nothing after it comes
    assert lint.prompt_budget(rows.limit(0)).first().prompt == ""


def test_migrate(spark, root):
    raw = vault.files(spark, root, "knowledge/notes").unionByName(spark.createDataFrame([("README.md", "README.md", "README", "x", None), ("other/z.md", "z.md", "z", "z", None)], vault.FILE_SCHEMA))
    made = {r.rel: r for r in pg.migrate(raw, NOW).collect()}
    assert made["knowledge/notes/index.md"].status == "skip_reserved" and made["README.md"].status == "skip_root_contract"
    assert made["knowledge/notes/alpha.md"].status == "skip_already_okf" and made["other/z.md"].status == "skip_no_type_rule"
    assert made["knowledge/notes/gamma.md"].text == f'---\ntype: concept\ntitle: "Gamma page"\ntimestamp: {NOW}\n---\n# Gamma page\nNo front matter.\n'
    assert made["knowledge/notes/sub/delta one.md"].text.startswith(f'---\ntype: concept\nauthor: me\ntitle: "Delta"\ntimestamp: {NOW}\n---\n# Delta')
    kinds = {p: spark.range(1).select(pg.infer_type(pg.F.lit(p)).alias("t")).first().t for p in ("knowledge/projects/a/state.md", "knowledge/projects/a/b.md", "skills/s.md", "knowledge/notes/qa/x.md", "y.md")}
    assert kinds == {"knowledge/projects/a/state.md": "project-state", "knowledge/projects/a/b.md": "concept", "skills/s.md": "skill", "knowledge/notes/qa/x.md": "qa", "y.md": None}


def test_supersede_and_archive(spark):
    rows = spark.createDataFrame([("knowledge/notes/a.md", "---\ntype: qa\nstatus: active\n---\nbody"), ("knowledge/notes/s/b.md", "plain"), ("knowledge/notes/t/b.md", "plain")], "rel string, text string")
    pairs = spark.createDataFrame([("new", "knowledge/notes/a.md"), ("new", "knowledge/notes/s/b.md")], "slug string, rel string")
    made = {r.rel: r.text for r in pg.supersede(pg.supersede(rows, pairs), pairs).collect()}
    assert made["knowledge/notes/a.md"] == "---\nstatus: superseded\nsuperseded_by: [[new]]\ntype: qa\nstatus: active\n---\nbody"
    assert made["knowledge/notes/s/b.md"] == "---\nstatus: superseded\nsuperseded_by: [[new]]\n---\n\nplain" and made["knowledge/notes/t/b.md"] == "plain"
    taken = spark.createDataFrame([("knowledge/notes/archive/2024/a.md",), ("knowledge/notes/archive/2024/a-1.md",)], "rel string")
    moved = {r.rel: (r.to, r.text) for r in pg.archive(rows, taken, NOW).collect()}
    assert moved["knowledge/notes/a.md"] == ("knowledge/notes/archive/2024/a-2.md", "---\ntype: qa\nstatus: archived\n---\nbody")
    assert moved["knowledge/notes/s/b.md"] == ("knowledge/notes/archive/2024/s/b.md", "---\nstatus: archived\n---\n\nplain")


def test_plan(spark, root, notes):
    cite = lambda quote, day="2024-05-30", at="10:00:00": {"daily_date": day, "timestamp": at, "quoted_text": quote, "claim": "it is so"}
    ops = [
        {"action": "create", "category": "Concepts", "slug": "New Page!", "title": 'A "new" page', "summary": "s", "body_markdown": "b", "evidence": [cite("quoted   words")], "related": ["[[alpha]]"]},
        {"action": "update", "category": "", "slug": "beta", "body_markdown": "more", "evidence": [cite("other text", at="11:00:00")]},
        {"action": "create", "category": "patterns", "slug": "beta", "body_markdown": "again", "evidence": [cite("quoted")]},
        {"action": "create", "category": "../etc", "slug": "evil", "evidence": [cite("quoted")]},
        {"action": "create", "category": "qa", "slug": "none", "evidence": []},
        {"action": "create", "category": "qa", "slug": "false", "evidence": [cite("other text")]},  # in another block
        {"action": "update", "category": "qa", "slug": "absent", "evidence": [cite("quoted")]},
        {"action": "create", "category": "qa", "slug": "//"},
    ]
    plans = spark.createDataFrame([("p", "```json\n" + json.dumps({"operations": ops}) + "\n```")], "plan string, reply string")
    gated = pg.gate(pg.operations(plans), vault.dailies(spark, root))
    assert {r.slug: r.dropped for r in gated.collect() if r.dropped} == {"evil": "invalid category", "none": "no evidence provided", "false": "1 citation(s) failed verification"}
    made = {r.rel: r for r in pg.apply_plan(notes.select("rel", "text"), gated, NOW).collect()}
    new = made["knowledge/notes/new-page.md"]
    assert new.touched and new.text == (
        f'---\ntype: concept\ntitle: "A \\"new\\" page"\ndescription: "s"\ntimestamp: {NOW}\nconfidence: medium\nsource_authority: ai-derived\n---\n\n# A "new" page\n\n'
        "One-sentence summary: s\n\n## Lesson\nb\n\n## Evidence\n- `knowledge/daily/2024-05-30.md [10:00:00]` — it is so\n\n## Related\n- [[alpha]]\n"
    )
    beta = made["knowledge/notes/beta.md"].text
    assert beta.startswith(FILES["knowledge/notes/beta.md"].rstrip() + "\n\n## Update (2024-06-01)\nmore\n\n## Evidence\n") and "\n\n## Update (2024-06-01)\nagain\n\n## Evidence\n" in beta
    assert "knowledge/notes/absent.md" not in made and made["knowledge/notes/gamma.md"].text == FILES["knowledge/notes/gamma.md"]


def test_contradictions(spark):
    ops = spark.createDataFrame([("n1", "Retry policy queue", "x is replaced by y"), ("n2", "Retry policy queue", "plain"), ("old", "Retry policy", "no longer so")], "slug string, title string, body_markdown string")
    old = spark.createDataFrame([("k/old.md", "old", "# Old retry Policy\n"), ("k/done.md", "done", "superseded_by: [[x]]\n# Retry policy"), ("k/one.md", "one", "# Retry it"), ("k/archive/z.md", "z", "# Retry policy")], "rel string, stem string, text string")
    assert [(r.slug, r.rel) for r in pg.contradicted(ops, old).collect()] == [("n1", "k/old.md")]


def test_catalogue_and_log(spark, notes, root):
    rows = vault.RULES["catalogue"](notes)
    made = {r.section: r.text for r in pg.catalogue(rows).collect()}
    assert made["Concepts"] == "## Concepts\n- [[knowledge/notes/alpha]] — Always test alpha.\n"
    assert "- [[knowledge/notes/beta]] — First line here. [[alpha]]" in made["Other"] and "gone" not in made["Concepts"]
    sinks.write_catalogue(rows, root)
    assert open(f"{root}/knowledge/index.md", encoding="utf-8").read().rstrip().endswith("not a page of its own.")
    log = spark.createDataFrame([("# Log\n- a\n\n## Editorial note\nx\n",), ("# Log\n- a",)], "t string")
    got = [r.t for r in log.select(pg.log_with(pg.F.col("t"), pg.F.lit("- b")).alias("t")).collect()]
    assert got == ["# Log\n- a\n- b\n\n## Editorial note\nx\n", "# Log\n- a\n- b\n"]
    tail = vault.changelog_tail(spark.createDataFrame([("# L\n- a\n- b\nx\n- " + "c" * 300 + "\n- Ð Ñ Ð\n- d",)], "text string")).first().block.split("\n")
    assert tail[0] == "- b" and len(tail[1]) == 200 and tail[2] == "- d"


def test_feedback(spark, root):
    rows = vault.feedback(spark, root)
    assert [r.id for r in rows.collect()] == ["abcdef012345"]
    pages, marked = pg.promote(rows)
    page = pages.first()
    assert page.rel == "knowledge/notes/feedback-abcdef01.md" and 'title: "User feedback: Never \\"quote\\" so..."' in page.text and "type: pattern\nfeedback_type: correction" in page.text
    assert marked.first().status == "promoted" and pg.promote(rows, "../x")[0].count() == 0 and "type: decision" in pg.promote(rows, "decisions")[0].first().text
    texts = spark.createDataFrame([("No, that's wrong: never use it with token = abcdefghijklmnopqrstu", "s", "p", "t"), ("ok", "s", "p", "t")], "text string, session_id string, project string, trigger string")
    (found,) = pg.candidates(texts, NOW).collect()
    assert found.type == "correction" and found.confidence == 0.9 and "REDACTED" in found.text and len(found.id) == 12


def test_writers(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.createDataFrame([("a/b.md", "one"), ("c.md", "ü")], "rel string, text string")
    assert {r.rel: r.n_chars for r in sinks.write_markdown(rows, base).collect()} == {"a/b.md": 3, "c.md": 1}
    sinks.write_markdown(rows, base)
    assert (tmp_path / "a/b.md").read_text() == "one" and not list(tmp_path.glob("**/*.tmp"))
    with pytest.raises(Exception, match="outside the vault"):
        sinks.write_markdown(spark.createDataFrame([("../x", "y")], "rel string, text string"), base)
    moves = spark.createDataFrame([("a/b.md", "z/b.md", "moved")], "rel string, to string, text string")
    assert sinks.move_pages(moves, base).count() == 1 and not (tmp_path / "a/b.md").exists() and (tmp_path / "z/b.md").read_text() == "moved"
    shots = sinks.Snapshots(spark, f"{base}/table")
    assert shots.current() is None
    first = shots.write(rows)
    second = shots.update(lambda df: df.where("rel = 'c.md'"))
    assert first != second and shots.current() == second and shots.read().count() == 1
    sinks.append_events(rows, f"{base}/log")
    sinks.append_events(rows, f"{base}/log")
    (tmp_path / "log" / "bad.json").write_text("\n{oops\n")
    assert tables.json_lines(spark, f"{base}/log", "rel string, text string").where("rel is not null").count() == 4


def test_day_logs(spark, tmp_path):
    path = str(tmp_path / "days")
    blocks = [("2024-05-01", "10:00:00", None, "s", "- `[10:00:00] tool`"), ("2024-05-01", "09:00:00", "session-end", "s", "text\n"), ("2024-05-02", "08:00:00", "deferred-x", "q", "late")]
    schema = "day string, at string, event string, session string, text string"
    sinks.append_days(spark.createDataFrame(blocks[:2], schema), path)
    sinks.append_days(spark.createDataFrame(blocks[2:], schema), path)
    made = {r.rel: r.text for r in sinks.day_logs(spark, path).collect()}
    assert made["knowledge/daily/2024-05-01.md"] == "# Daily Session Memory — 2024-05-01\n\n## [09:00:00] session-end | s\ntext\n\n- `[10:00:00] tool`\n"
    assert made["knowledge/daily/2024-05-02.md"].endswith("## [08:00:00] deferred-x | q\nlate\n")
    told = spark.createDataFrame([("s1", "session-end", "other", "t.jsonl", "major", "password = abcdefghijklmnop1"), ("s2", "e", "x", "t", "ok", "b")], "session_id string, event string, trigger string, transcript string, tier string, body string")
    (block,) = sinks.flush_block(told, NOW).collect()
    assert (block.day, block.at, block.session) == ("2024-06-01", "12:00:00", "s1") and "- Tier: `major`" in block.text and "REDACTED" in block.text


def test_small_pages(spark):
    one = lambda df: df.first()
    page = one(pg.guardrails_page(spark.createDataFrame([("rules",)], "block string"), NOW))
    assert page.rel == "knowledge/guardrails.md" and page.text.startswith('---\ntype: guardrails\ntitle: "Learned Guard Rails"')
    assert pg.guardrails_page(spark.createDataFrame([("",)], "block string"), NOW).count() == 0
    assert [r.rel for r in pg.context_page(spark.createDataFrame([("ok-1", "b"), ("../x", "b")], "slug string, block string"), NOW).collect()] == ["knowledge/projects/ok-1/context.md"]
    answer = one(pg.answer_page(spark.createDataFrame([('What is "it"?', "That.")], "question string, reply string"), NOW))
    assert answer.rel.startswith("knowledge/notes/what-is-it-") and 'title: "What is \\"it\\""' in answer.text and '# What is "it"?\n' in answer.text
    assert one(pg.answer_page(spark.createDataFrame([("???", "x")], "question string, reply string"), NOW)).rel.startswith("knowledge/notes/question-")
    facts = vault.project_facts(["1 feat: add x", "2 chore: bump version 2"], "# T\n\nAbout\nit.\n\nmore", ["package.json", "Makefile"], ["react"], ["docs/b.md", "docs/a.md"])
    assert facts == {"description": ["About", "it."], "stack": ["- Node.js / JavaScript (`package.json`)", "- Make (`Makefile`)", "- React"], "commits": ["- `1 feat: add x`"], "docs": ["- `docs/a.md`", "- `docs/b.md`"]}
    boot = one(pg.bootstrap_page(spark.createDataFrame([("p", facts["description"], facts["stack"], [], facts["docs"])], "slug string, description array<string>, stack array<string>, commits array<string>, docs array<string>"), NOW))
    assert boot.rel == "knowledge/projects/p/bootstrap.md" and "## Tech stack\n- Node.js" in boot.text and "git history (" not in boot.text


def test_export_and_slugs(spark):
    names = spark.createDataFrame([("cache/x",), ("knowledge/raw/cache-effects.md",), ("a/.claude/settings.local.json",), ("logs",)], "name string")
    assert {r.pattern: r.example for r in pg.forbidden(names).collect()} == {"cache/": "cache/x", "logs/": "logs", ".claude/settings.local.json": "a/.claude/settings.local.json"}
    folders = spark.createDataFrame([("/home/me/My App/backend", "git@host:Own/Repo.git"), ("/w/free", None), ("/w/mine", None), ("/w/all", "https://h/o/r")], "path string, remote string")
    owned = spark.createDataFrame([("backend", "/other"), ("backend-my-app", None), ("mine", "/w/mine/"), ("all", "/x"), ("all-w", "/x"), ("o-r", "/x")], "slug string, root string")
    got = {r.path: r.slug for r in pg.slugs(folders, owned).collect()}
    assert got["/home/me/My App/backend"] == "own-repo" and got["/w/free"] == "free" and got["/w/mine"] == "mine"
    assert got["/w/all"].startswith("all-") and len(got["/w/all"]) == 10
    text = spark.range(1).select(pg.new_state("# <Project Name>\n<absolute path> <remote url>", pg.F.lit("s"), pg.F.lit("/p")).alias("t")).first().t
    assert text == "# s\n/p (unknown — set manually if applicable)"
    assert vault.is_project(["x.csproj"]) and vault.is_project([".git"]) and not vault.is_project(["a.txt"]) and not vault.is_project([".git"], "/home/me/", "/home/me")


def test_state_and_sources(spark, tmp_path, root):
    path = tmp_path / "beats.jsonl"
    assert vault.state_map(spark, str(path), vault.HEARTBEAT_SCHEMA).count() == 0
    path.write_text('{"slug": "a", "at": "2024-05-01T00:00:00"}\n{broken\n\n')
    beats = vault.state_map(spark, str(path), vault.HEARTBEAT_SCHEMA)
    assert [r.slug for r in beats.collect()] == ["a"] and spark.read.text(f"{path}.corrupt").first().value == "{broken"
    new = spark.createDataFrame([("a", "2024-05-02T00:00:00", "r", "s", "p"), ("b", "2024-04-01T00:00:00", "r", "s", "p")], vault.HEARTBEAT_SCHEMA)
    assert [(r.slug, r.at[:10]) for r in sinks.newest(beats, new, "slug", "at", 1).collect()] == [("a", "2024-05-02")]
    (tmp_path / "t.jsonl").write_text("0123456789")
    (tmp_path / "t.exe").write_text("x")
    tails = vault.transcript_tail(spark, [f"{tmp_path}/t.jsonl", f"{tmp_path}/t.exe", f"{tmp_path}/../t.jsonl"], [str(tmp_path)], 4)
    assert [r.tail for r in tails.collect()] == ["6789"] and vault.transcript_tail(spark, [f"{tmp_path}/t.jsonl"], ["/elsewhere"]).count() == 0
    lines = spark.createDataFrame([('{"tool_name": "Edit"}',), ("[1]",), ("oops",), ("",)], "value string")
    assert [r.tool_name for r in vault.hook_events(lines, "tool_name string").collect()] == ["Edit", None, None, None]
    pages = vault.files(spark, root, "knowledge/notes")
    later = (datetime.datetime.now() + datetime.timedelta(days=1)).isoformat()
    assert vault.is_fresh(pages, pages, later) and not vault.is_fresh(pages, pages.limit(2), later)
    assert not vault.is_fresh(pages, pages, None) and not vault.is_fresh(pages, pages, "2000-01-01")
    assert vault.queue_files(spark, str(tmp_path / "absent")).count() == 0


def test_contradictions_of_a_pair_that_all_titles_share(spark, monkeypatch):
    monkeypatch.setattr(pg, "SIDE", 7)
    ops = spark.createDataFrame([(f"n{i}", "Retry budget rules", "This replaces the old one, no longer valid") for i in range(3)] + [("m", "Cache warmup", "no longer valid")], "slug string, title string, body_markdown string")
    old = spark.createDataFrame([(f"k/p{i}.md", f"p{i}", f"# Retry budget number{i}\n") for i in range(60)] + [("k/z.md", "z", "# Cache\n")], "rel string, stem string, text string")
    got = [(r.slug, r.rel) for r in pg.contradicted(ops, old).collect()]
    assert sorted(got) == sorted((f"n{k}", f"k/p{i}.md") for k in range(3) for i in range(60))


def test_contradictions_of_slugs_and_pages_with_several_titles(spark, monkeypatch):
    """Pairs are shuffled only for slugs and pages that come with several titles; these are given once."""
    monkeypatch.setattr(activity, "CHUNK", 3)
    ops = [("n1", "Retry budget rules"), ("n1", "Retry budget"), ("p2", "Budget retry")]
    ops = spark.createDataFrame([(*x, "no longer valid") for x in ops], "slug string, title string, body_markdown string")
    old = [(f"k/p{i}.md", f"p{i}", "# Retry budget\n") for i in range(20)] + [("k/p1.md", "p1", "# Rules: retry budget\n"), ("k/p3.md", "other", "# Retry budget\n")]
    found = pg.contradicted(ops, spark.createDataFrame(old, "rel string, stem string, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode(vs")]
    assert sorted((r.slug, r.rel) for r in found.collect()) == sorted((s, f"k/p{i}.md") for s in ("n1", "p2") for i in range(20) if (s, i) != ("p2", 2))
