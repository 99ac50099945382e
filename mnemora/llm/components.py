"""Connected components by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.common import materialise, release


def _order(node: str, degree: str, number: int) -> Column:
    """Nodes of more links come first, equal ones by a hash that each round draws anew."""
    return F.struct((-F.col(degree)).alias("d"), F.xxhash64(F.col(node), F.lit(number)).alias("h"), F.col(node).alias("node"))


def _follow(rows: DataFrame, to: DataFrame) -> DataFrame:
    """``rows`` (node, up) with ``next``: where ``to`` (node, up) leads from up."""
    step = to.select(F.col("node").alias("up"), F.col("up").alias("next"))
    return rows.join(step, "up", "left").select("node", "up", F.coalesce("next", "up").alias("next"))


def _hooks(edges: DataFrame, number: int) -> DataFrame:
    """(node, up): each node's root in the forest in which every node hooks to its neighbour that comes first, or stays a root."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = materialise(both.groupBy("a").agg(F.count(F.lit(1)).alias("degree")))
    known = both.join(degree.select(F.col("a").alias("b"), F.col("degree").alias("deg_b")), "b")
    first = known.groupBy("a").agg(F.min(_order("b", "deg_b", number)).alias("best")).join(degree, "a")
    up = F.when(F.col("best") < _order("a", "degree", number), F.col("best.node")).otherwise(F.col("a"))
    made = materialise(first.select(F.col("a").alias("node"), up.alias("up")))
    release(degree)
    while True:  # pointer jumping: paths halve
        before, made = made, materialise(_follow(made.select("node", F.col(made.columns[-1]).alias("up")), made.select("node", F.col(made.columns[-1]).alias("up"))))
        release(before)
        if made.where("up <> next").isEmpty():
            return made


def contract(edges: DataFrame) -> list[DataFrame]:
    """The forests (node, up) of all rounds, each over the roots of the one before."""
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        hook = _hooks(edges, len(maps))
        maps.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = hook.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(left, "a").join(right, "b").where("ua <> ub")
        before, edges = edges, materialise(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
        release(before)
    release(edges)
    return maps


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (columns a, b); comp is the smallest node reachable.

    In each round every node hooks to its neighbour of most links (equal ones in
    random order), pointer jumping makes the trees flat, and the edges contract
    onto the roots. A root has at least as many links as its neighbours, so at
    most half of the nodes are roots: the rounds are logarithmic, and so are the
    jumps of a round. Rows are two or three numbers; a hub's are pre-aggregated,
    and where they are joined, adaptive execution broadcasts a small side and
    splits a skewed partition of a large one. No group is collected.
    """
    maps = contract(edges)
    if not maps:
        return edges.sparkSession.createDataFrame([], edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).schema)
    made = maps[-1].select("node", "up")
    for step in reversed(maps[:-1]):  # from the smallest forest to the whole one
        made = _follow(step.select("node", "up"), made).select("node", F.col("next").alias("up"))
    roots = made.groupBy("up").agg(F.min("node").alias("comp"))
    named = materialise(made.join(roots, "up").select("node", "comp"))
    for step in maps:
        release(step)
    return named
