"""Ranked search against SQLite's full-text index, plain Python and known orders."""

import random
import sqlite3

import pytest

from mnemora.functions.porter import porter
from mnemora.operators import retrieval, seams
from mnemora.operators import search as se

SCHEMA = "rel string, stem string, title string, summary string, body string, project string, timestamp string, valid_to string, source_authority string, modified timestamp"
_rnd = random.Random(11)
_WORDS = "running runner hooks hook errors error retry retries relational café cafés queue's state-machine Policies policy the not and flying hopping national".split()


def page(i, title, summary="", body="", project=None, timestamp=None, valid_to=None, authority=None, stem=None, folder="knowledge/notes"):
    stem = stem or f"p{i}"
    return (f"{folder}/{stem}.md", stem, title, summary, body, project, timestamp, valid_to, authority, None)


@pytest.fixture(scope="module")
def corpus(spark):
    pick = lambda n: " ".join(_rnd.choice(_WORDS) for _ in range(n))
    rows = [page(i, pick(3), pick(5), pick(_rnd.randint(5, 40))) for i in range(60)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_porter_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam",
        "triplicate": "triplic", "hopefulness": "hope", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "ab": "ab", "naïve": "naïve",
    }
    assert {w: porter(w) for w in known} == known


def test_bm25_equals_sqlite(spark, corpus, tmp_path):
    rows, df = corpus
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE p USING fts5(rel UNINDEXED, title, summary, body, tokenize = 'porter unicode61')")
    con.executemany("INSERT INTO p VALUES (?, ?, ?, ?)", [(r[0], r[2], r[3], r[4]) for r in sorted(rows)])
    asked = ["hook errors", "running", "state-machine policy", "cafe retry", "queue's", "not and", "nothing here", "error error", "NATIONAL flying"]
    want = {}
    for i, q in enumerate(asked):
        match = " ".join('"' + w.replace('"', '""') + '"' for w in q.split())
        want |= {(i, rel): round(-score, 6) for rel, score in con.execute("SELECT rel, bm25(p) FROM p WHERE p MATCH ?", (match,))}
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    stored = se.build(df, str(tmp_path / "index"))
    for index in (stored, se.build(df)):
        got = {(r.qid, r.rel): round(r.bm25, 6) for r in se.bm25(index, queries).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert len(want) > 30 and stored.status().first().n_pages == 60 and stored.manifest().count() == 60


def test_boosts(spark):
    rows = [
        page(1, "Hook errors", body="hook errors in long text about many other things"), page(2, "All the hook errors here", body="hook errors"),
        page(3, "Hook", body="hook errors"), page(4, "Other", body="hook errors", stem="all-hook-errors"), page(5, "Other", body="hook errors", folder="elsewhere"),
        page(6, "Other", body="hook errors", project="Red"), page(7, "Other", body="hook errors", authority="inferred"), page(8, "Other", body="hook errors"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    index, queries = se.build(df, stemmed=False), spark.createDataFrame([(0, "Hook errors")], "qid int, query string")
    plain = {r.rel: r.bm25 for r in se.bm25(index, queries).collect()}
    got = {r.rel: r.score for r in se.boosted(index, se.bm25(index, queries), queries, 10, project="red").collect()}
    n = "knowledge/notes/"
    factor = {n + "p1.md": 6.5, n + "p2.md": 3.9, n + "p3.md": 2.6, n + "all-hook-errors.md": 5.2, "elsewhere/p5.md": 1.0, n + "p6.md": 2.6, n + "p7.md": 1.04, n + "p8.md": 1.3}
    assert got == {k: round(plain[k] * f, 2) for k, f in factor.items()}


def test_temporal_filters(spark):
    rows = [page(1, "x", body="word", timestamp="2024-01-05T10:00:00"), page(2, "x", body="word", timestamp="2024-03-01"), page(3, "x", body="word"), page(4, "x", body="word", timestamp="2024-01-01", valid_to="2024-01-10"), page(5, "x", body="word", timestamp="2024-01-01", valid_to="None")]
    index, queries = se.build(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame([(0, "word")], "qid int, query string")
    names = lambda **o: sorted(r.path[-5:-3] for r in se.search(index, queries, **o).collect())
    assert names(since="2024-01-05") == ["p1", "p2", "p3"] and names(as_of="2024-02-01") == ["p1", "p3", "p5"] and names(as_of="2024-01-10", since="2024-01-01") == ["p1", "p3", "p4", "p5"]


def test_filter_after_the_cut(spark):
    rows = [page(i, "x", body="word " * (9 - i), timestamp="2023-01-01" if i < 3 else "2024-01-01") for i in range(6)]
    index, queries = se.build(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame([(0, "word")], "qid int, query string")
    assert se.search(index, queries, 1, since="2024-01-01").count() <= 1
    assert se.search(index, queries, 1).count() == 1


def test_name_comes_first(spark):
    rows = [page(i, "Deploy the app", body="deploy the app " * 3) for i in range(3)] + [page(9, "Unlike", body="deploy the app", stem="deploy-the-app"), page(8, "Unlike", body="deploy the app", stem="Deploy-the-app", folder="old")]
    index, queries = se.build(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame([(0, "deploy the app"), (1, "deploy app")], "qid int, query string")
    edges = spark.createDataFrame([("knowledge/notes/p0.md", "knowledge/notes/p2.md")], "src string, dst string")
    got = {(r.qid, r["rank"]): r for r in se.search(index, queries, 4, edges=edges).collect()}
    assert got[0, 1].path == "knowledge/notes/deploy-the-app.md" and all(got[0, k].fused_score is None for k in range(1, 5))
    assert got[1, 1].fused_score is not None


def _lists(spark, *lists):
    return [spark.createDataFrame([(0, rel, i + 1, b) for i, (rel, b) in enumerate(rows)], "qid int, rel string, rank int, boost double") for rows in lists]


def test_fusion_weights(spark):
    lexical, near, linked = _lists(spark, [("a", 0.0), ("b", 0.0)], [("b", 0.0), ("a", 0.0)], [("z", 0.15)])
    rows = se.fuse([(lexical, 2.0, 60, None), (near, 1.0, 60, None), (linked, 0.5, 120, se.F.col("boost"))]).orderBy("rank").collect()
    assert [r.rel for r in rows] == ["a", "b", "z"]
    assert abs(rows[0].fused - (2 / 61 + 1 / 62)) < 1e-9 and abs(rows[2].fused - 0.5 * 0.15 / 121) < 1e-9
    one, two = _lists(spark, [("a", 0.0)], [("b", 0.0)])
    assert [r.rel for r in se.fuse([(one, 1.0, 60, None), (two, 1.0, 60, None)]).orderBy("rank").collect()] == ["a", "b"]


def test_links_and_dense(spark):
    rows = [page(1, "One", "first", "alpha"), page(2, "Two", "second", "beta", project="red"), page(3, "Three", "third", "gamma")]
    df = spark.createDataFrame(rows, SCHEMA)
    index, queries = se.build(df), spark.createDataFrame([(0, "alpha"), (1, "delta")], "qid int, query string")
    rel = lambda i: f"knowledge/notes/p{i}.md"
    edges = spark.createDataFrame([(rel(1), rel(2)), (rel(1), rel(3)), (rel(3), rel(1))], "src string, dst string")
    got = {(r.qid, r["rank"]): r for r in se.search(index, queries, edges=edges).collect()}
    assert [got[0, k].path for k in (1, 2, 3)] == [rel(1), rel(2), rel(3)] and got[0, 2].title == "p2" and got[0, 2].score == 0.0
    assert abs(got[0, 2].fused_score - round(0.5 * 0.15 / 121, 4)) < 1e-9 and (1, 1) not in got
    cosines = spark.createDataFrame([(1, rel(3), 0.91234), (1, rel(2), 0.8), (0, rel(2), 0.9)], "qid int, rel string, cosine double")
    both = {(r.qid, r["rank"]): r for r in se.search(index, queries, cosines=cosines, edges=edges, project="Red").collect()}
    assert both[1, 1].path == rel(2) and both[1, 1].score == 1.2 and both[1, 2].score == 0.9123  # a dense project hit weighs more
    assert both[0, 1].path == rel(1)
    out, into = se.neighbours(edges)
    assert {r.rel: r.out for r in out.collect()} == {rel(1): [rel(2), rel(3)], rel(3): [rel(1)]} and {r.rel: r["into"] for r in into.collect()}[rel(1)] == [rel(3)]
    twice = {r.rel: r.boost for r in se.link_boosts(edges, [spark.createDataFrame([(0, rel(1), 1)], "qid int, rel string, rank int")] * 2).collect()}
    assert twice == {rel(2): 0.3, rel(3): 0.25}


def test_lexical_alone_is_not_fused(spark, corpus):
    index, queries = se.build(corpus[1]), spark.createDataFrame([(0, "hook")], "qid int, query string")
    rows = se.search(index, queries, 5).orderBy("rank").collect()
    assert len(rows) == 5 and all(r.fused_score is None for r in rows) and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    none = spark.createDataFrame([], "src string, dst string")
    assert all(r.fused_score is None for r in se.search(index, queries, 5, edges=none).collect())  # nothing to fuse with


def test_embedding_seam(spark):
    rows = [page(1, "Retry policy", "how to retry", "back off"), page(2, "Bread", "baking", "flour")]
    df = spark.createDataFrame(rows, SCHEMA)
    embed = seams.embed(seams.HashedEmbedder)
    made = se.vectors(df, embed).cache()
    assert seams.load_embedder("no_such_module") is None and made.count() == 2 and len(made.first().embedding) == 384
    assert se.vectors_valid(df, made) and not se.vectors_valid(df, made.limit(1))
    asked = spark.createDataFrame([(0, "retry")], "qid int, query string").select("qid", embed(se.F.col("query")).alias("q"))
    cosines = made.crossJoin(asked).select("qid", "rel", retrieval.cosine(se.F.col("embedding"), se.F.col("q")).alias("cosine"))
    best = se.search(se.build(df), spark.createDataFrame([(0, "unknownword")], "qid int, query string"), cosines=cosines).orderBy("rank").first()
    assert best.path == "knowledge/notes/p1.md"
    found = seams.recall_tool(se.build(df), "flour")
    assert [r["path"] for r in found] == ["knowledge/notes/p2.md"] and seams.recall_tool(se.build(df), "  ") == []


def test_title_queries(spark):
    rows = [page(1, "A Title", "the quick brown fox jumps over"), page(2, "B", "one two")]
    got = {(r.rel[-5:-3], r.query_type): r["query"] for r in se.title_queries(spark.createDataFrame(rows, SCHEMA), ("over",)).collect()}
    assert got == {("p1", "exact_title"): "a title", ("p2", "exact_title"): "b", ("p1", "keywords"): "quick brown jumps"}


def test_models(spark):
    down, loud = seams.Backend("down", lambda: False, lambda *a: "x"), seams.Backend("loud", lambda: True, lambda *a: 1 / 0)
    empty, good = seams.Backend("empty", lambda: True, lambda *a: "  "), seams.fake(" yes ")
    assert seams.Model((down, loud, empty, good))("hi") == "yes" and seams.Model((good,))("  ") == "" and seams.Model((down, loud, empty))("hi") is None
    assert seams.Model((down, good), only="down")("hi") is None and seams.Model((good,), only="nobody")("hi") == "yes"
    sessions = spark.createDataFrame([(1, "text password = abcdefghijklmnop1")], "id int, text string")
    told = seams.classify(sessions, "text", lambda: seams.Model((seams.Backend("b", lambda: True, lambda p, s, m: "FLUSH_MAJOR\n- " + p[-20:]),))).first()
    assert told.tier == "major" and "abcdefghijklmnop1" not in told.body
    silent = seams.classify(sessions, "text", lambda: seams.Model(())).first()
    assert (silent.tier, silent.body) == ("ok", "")
    asked = spark.createDataFrame([("q?",)], "question string")
    assert seams.answer(asked, "- [[a]]", lambda: seams.Model((seams.fake("A"),))).first().reply == "A"
    assert seams.answer(asked, "", lambda: seams.Model(())).first().reply == "(no LLM response)"
    assert seams.advise("block", seams.Model((seams.fake("Do it."),))) == "**Insight:** Do it.\n\nblock" and seams.advise("block", seams.Model(())) == "block"
    assert len(seams.advise("b" * 900, seams.Model((seams.fake("Do it."),)))) <= 800


def test_title_boosts_compare_no_title_with_all_queries(spark):
    """Titles meet queries on rare words instead of in a cross join, with the rows of the cross join."""
    from pyspark.sql import functions as F

    from mnemora.operators import retrieval as rt

    titles = ["red fox", "fox red", "red fox", "red", "the red fox runs", "", None, "a  b", "a b", "b", "red red fox", "blue", " red"]
    docs = spark.createDataFrame(list(enumerate(titles)), "doc_id long, t string")
    asked = docs.where("doc_id % 2 = 0 AND t <> ''").select(F.col("doc_id").alias("qid"), F.col("t").alias("q"))
    found = rt.title_boosts(docs, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    words = lambda c: F.array_distinct(F.split(c, " "))
    every = docs.crossJoin(asked).select("qid", "doc_id", rt.boost_ladder(F.col("t"), F.col("q"), words("t"), words("q")).alias("boost")).where("boost > 1")
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(tuple(r) for r in every.collect()) and len(got) > 20


def test_the_dense_list_ranks_no_pairs_by_shuffle(spark):
    """search_triple's vectors are compared by products of matrices, of which a query's first pages are left, with the rows of all pairs."""
    from helpers import SF

    from mnemora.plans import vault
    from mnemora.sources.tables import table

    F, rt = se.F, retrieval
    found = vault._cosines(spark, SF, 30)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    v = table(spark, SF, "embeddings").join(table(spark, SF, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id")
    asked = table(spark, SF, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    every = v.crossJoin(asked).where("vec_id <> qid").select("qid", vault._rel("vec_id").alias("rel"), rt.cosine(F.col("embedding"), F.col("q")).alias("cosine"))
    want = rt.ranked(every, 30, score="cosine", item="rel").select("qid", "rel", "cosine")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 30
