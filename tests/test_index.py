"""The stored index: blocks read by their bounds, terms sent to the scan, updates against a full rebuild."""

import random

import pytest

from mnemora.operators import index as ix
from mnemora.operators import search as se

SCHEMA = "rel string, stem string, title string, summary string, body string, project string, timestamp string, valid_to string, source_authority string"
WORDS = [f"w{i}" for i in range(150)] + ["state-machine", "café"]


def pages(rnd, ids):
    pick = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    return [(f"n/{i}.md", str(i), pick(2), pick(3), pick(rnd.choice([3, 10, 40, 200])), None, None, None, None) for i in ids]


def hits(index, queries, top=None):
    return {(r.qid, r.rel): round(r.bm25, 6) for r in se.bm25(index, queries, top).collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 8)
    monkeypatch.setattr(se, "FIRST_BLOCKS", 2)


def test_first_blocks_hold_the_first_hits(spark, tmp_path, small_blocks):
    rnd = random.Random(1)
    index = se.build(spark.createDataFrame(pages(rnd, range(250)), SCHEMA), str(tmp_path / "index"), stemmed=False)
    asked = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 2))) for _ in range(20)] + ["absent", "w1 absent", "café", "w1 w1"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    every, some = hits(index, queries), hits(index, queries, 3)
    assert len(some) < 0.9 * len(every), (len(some), len(every))
    for q in range(len(asked)):
        mine = sorted((v for (i, _), v in every.items() if i == q), reverse=True)
        least = mine[:3][-1] if mine else 0
        assert {k: v for k, v in every.items() if k[0] == q and v >= least} == {k: v for k, v in some.items() if k[0] == q and v >= least}, asked[q]


def test_the_scan_gets_the_terms(spark, tmp_path, capsys):
    index = se.build(spark.createDataFrame(pages(random.Random(2), range(40)), SCHEMA), str(tmp_path / "index"), stemmed=False)
    queries = spark.createDataFrame([(i, f"{w} w1") for i, w in enumerate(WORDS)], "qid int, query string")
    capsys.readouterr()
    se.bm25(index, queries, 5).explain()
    plan = capsys.readouterr().out
    assert "PushedFilters: [In(term" in plan or "In(term, [" in plan
    assert "places" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("merge_at", [2, 99])
def test_updates_equal_a_rebuild(spark, tmp_path, small_blocks, monkeypatch, merge_at):
    monkeypatch.setattr(ix, "MERGE_AT", merge_at)
    rnd, path = random.Random(3), str(tmp_path / "index")
    now = {p[0]: p for p in pages(rnd, range(60))}
    ix.build(spark.createDataFrame(list(now.values()), SCHEMA), path, stemmed=False)
    for ids, gone in ((range(50, 70), ["n/1.md", "n/2.md"]), (range(2, 6), ["n/60.md", "never.md"]), ([], ["n/7.md"])):
        changed = pages(rnd, ids)
        now.update({p[0]: p for p in changed})
        for g in gone:
            now.pop(g, None)
        removed = spark.createDataFrame([(g,) for g in gone], "rel string")
        index = ix.update(spark, path, spark.createDataFrame(changed, SCHEMA), removed)
    whole = se.build(spark.createDataFrame(list(now.values()), SCHEMA), str(tmp_path / "whole"), stemmed=False)
    queries = spark.createDataFrame([(0, "w1"), (1, "w2 w3"), (2, "state-machine"), (3, "w4 café state-machine")], "qid int, query string")
    assert hits(index, queries) == hits(whole, queries) and hits(index, queries)
    assert hits(index, queries, 500) == hits(whole, queries)
    assert sorted(index.manifest().collect()) == sorted(whole.manifest().collect()) and index.status().first() == whole.status().first()
    assert index.exact is (merge_at == 2)
    merged = ix.compact(spark, path)
    assert merged.exact and hits(merged, queries, 5) and hits(merged, queries) == hits(whole, queries)
    assert ix.clean(spark, path) > 0 and hits(ix.load(spark, path), queries) == hits(whole, queries)


def test_an_unfinished_update_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "index")
    ix.build(spark.createDataFrame(pages(random.Random(4), range(5)), SCHEMA), path)
    ix._write(spark.createDataFrame(pages(random.Random(5), range(5, 9)), SCHEMA), path, True)
    assert ix.load(spark, path).manifest().count() == 5


def test_the_index_is_shuffled_once(spark, tmp_path):
    """A page's terms are grouped within its row: the plan of the postings has no shuffle of rows, whatever the number of words."""
    from pyspark.sql import functions as F

    from mnemora.operators import retrieval

    none = F.lit(None).cast("string")
    rows = [(f"k/p{i}.md", "Réd hats", None if i == 2 else "", " ".join(["red", "HATS", "́", "x"] * (i + 1))) for i in range(5)]
    pages = spark.createDataFrame(rows, "rel string, title string, summary string, body string").select("*", F.lit("s").alias("stem"), *[none.alias(c) for c in ("project", "timestamp", "valid_to", "source_authority")])
    made = ix.build(pages)
    plan = made.postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(rel" not in plan and "Exchange hashpartitioning(word" not in plan and "Exchange hashpartitioning(term" not in plan
    got = {(r.term, r.rel): (r.tf, r.length, [tuple(p) for p in r.places]) for r in made.postings.collect()}
    assert got["red", "k/p1.md"] == (3, 10, [(0, 0), (2, 0), (2, 4)]) and got["hat", "k/p0.md"] == (2, 6, [(0, 1), (2, 1)]) and len(got) == 15
    docs = spark.createDataFrame([(1, "a b a"), (1, "a c a"), (2, None), (None, "a"), (3, "")], "doc_id long, text string")
    plan = retrieval.sorted_postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    want = [(1, "a", 4, 3), (1, "b", 1, 3), (1, "c", 1, 3), (None, "a", 1, 1)]
    assert sorted(((r.doc_id, r.term, r.tf, r.dl) for r in retrieval.sorted_postings(docs).collect()), key=repr) == sorted(want, key=repr)


def test_many_queries_are_ranked_where_the_pages_are(spark, tmp_path, monkeypatch):
    """A batch of many queries reads the pages once: no posting and no pair of a query and a page is shuffled, an index without postings serves it, phrases too."""
    rnd, path = random.Random(6), tmp_path / "index"
    rows = pages(rnd, range(90)) + [(None, "0", "w1", None, "w2", None, None, None, None)] + [(f"n/same{i}.md", "s", "w3 w4", "", "w5 w6", None, None, None, None) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [" ".join(rnd.choice(WORDS[:40]) for _ in range(rnd.randint(1, 3))) for _ in range(25)] + ["w3 w4", "w3 w3 w5", "absent w1", "w1 w1", "state-machine w2", "café"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    every = hits(se.build(df, stemmed=False), queries)
    index = ix.build(df, str(path), stemmed=False, by_term=False)
    assert not list(path.glob("*/postings"))
    for name, value in (("FEW", 0), ("PAIRS", 16), ("AT_ONCE", 20)):
        monkeypatch.setattr(se, name, value)
    plain = spark.createDataFrame([(i, q) for i, q in enumerate(asked) if "-" not in q], "qid int, query string")
    plan = se.bm25(index, plain, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    with_ties, first = hits(index, queries, 3), {}
    for r in se.bm25(index, queries, 3, ties=False).collect():
        first.setdefault(r.qid, []).append((-round(r.bm25, 6), r.rel))
    for q in range(len(asked)):
        mine = sorted((-v, rel) for (i, rel), v in every.items() if i == q)
        assert sorted(first.get(q, []))[:3] == mine[:3], asked[q]
        least = -mine[:3][-1][0] if mine else 0
        assert {k: v for k, v in every.items() if k[0] == q and v >= least} == {k: v for k, v in with_ties.items() if k[0] == q and v >= least}, asked[q]
