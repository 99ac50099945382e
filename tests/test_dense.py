"""The dense index in cells against the exact search."""

import numpy as np
import pytest
from helpers import SF

from mnemora.operators import dense, retrieval as rt
from mnemora.plans import search as plans
from mnemora.sources.scratch import keep


def table(spark, n=900, dim=8):
    """Vectors about a dozen centres, one of which has half of them, equal ones among them."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, dim)) * 2
    own = np.where(rng.random(n) < 0.5, 0, rng.integers(0, 12, n))
    x = centres[own] + rng.normal(size=(n, dim))
    x[10] = x[20] = x[30]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return keep(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))


def asked(df, by=30):
    return df.where(f"vec_id % {by} = 0").select(dense.F.col("vec_id").alias("qid"), dense.F.col("embedding").alias("q"))


def found(df):
    return {(r.qid, r.vec_id): r["rank"] for r in df.collect()}


@pytest.mark.parametrize("part", [4096, 40])
def test_all_cells_are_exact_and_few_cells_have_the_recall(spark, monkeypatch, part):
    monkeypatch.setattr(dense, "PART", part)
    df = table(spark)
    c = dense.fit(df, 16)
    index = keep(dense.build(df, c))
    assert index.count() == 900 and c.shape == (16, 8)
    exact = found(rt.dense_topk(df, asked(df), 5))
    assert found(dense.search(index, asked(df), c, 5, 16)) == exact
    if part == 4096:
        n = dense.probes_for(index, asked(df), c, 5, 0.95)
        got = found(dense.search(index, asked(df), c, 5, n))
        assert n < 16 and len(got.keys() & exact.keys()) >= 0.95 * len(exact)


def test_rows_without_a_direction_repeated_ids_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0, 0.0, 0.0]), (7, [float("nan"), 1.0]), (None, [1.0, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    c = dense.fit(df.where("vec_id < 3"), 2)
    index = keep(dense.build(df, c))
    got = [(r.qid, r.vec_id) for r in dense.search(index, df.select(dense.F.col("vec_id").alias("qid"), dense.F.col("embedding").alias("q")).where("qid IN (1, 3, 4)"), c, 5, 2).orderBy("rank").collect()]
    assert got[:1] == [(1, 2)] and len([g for g in got if g[1] == 2]) == 1 and {q for q, _ in got} == {1}
    empty = df.limit(0)
    none = dense.fit(empty, 4)
    assert len(none) == 0 and dense.search(dense.build(empty, none), asked(df), none, 5, 1).count() == 0


def test_the_query_has_the_recall(spark):
    exact, got = found(plans.vector_topk(spark, SF)), found(plans.dense_index_topk(spark, SF))
    assert len(got.keys() & exact.keys()) >= 0.95 * len(exact)


@pytest.mark.parametrize("side", [7, 1000])
def test_exact_search_in_blocks_is_that_of_all_pairs(spark, monkeypatch, side):
    """Equal vectors, ties of rounded scores, and vectors that have no cosine; no pair leaves its block uncounted."""
    monkeypatch.setattr(rt, "SIDE", side)
    rng, nan = np.random.default_rng(3), float("nan")
    odd = [(100, None), (101, [0.0, 0.0]), (102, [1.0, None]), (103, [1.0, 2.0, 3.0]), (104, [nan, 1.0]), (105, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, [float(v) for v in rng.choice([-1.0, 0.0, 0.5, 1.0], 2)]) for i in range(30)] + odd, "vec_id long, embedding array<float>")
    queries = asked(df, 1)
    pairs = df.crossJoin(queries).where("vec_id <> qid").select("qid", "vec_id", rt.cosine(rt.F.col("embedding"), rt.F.col("q")).alias("score"))
    plain = lambda rows: sorted([repr(tuple(r)) for r in rows.select("qid", "vec_id", "score", "rank").collect()])
    for k in (3, 10, 60):
        assert plain(rt.dense_topk(df, queries, k)) == plain(rt.ranked(pairs, k, item="vec_id"))


def test_exact_search_makes_no_cross_join(spark, capsys):
    df = table(spark)
    for found_ in (rt.dense_topk(df, asked(df), 5), plans.rrf_fusion(spark, SF)):
        capsys.readouterr()
        found_.explain()
        plan = capsys.readouterr().out
        assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
