"""Agents' activity: task folds, conflicts, loops, cooldowns, latest state, sessions, staleness, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import replies
from mnemora.operators.retrieval import _small
from mnemora.sources.scratch import keep

#: Classes of one pair of words that meet in one cell of the grid; members of a class in one row.
SIDE, CHUNK = 512, 2048
#: Turns over which a chunk's pairs are dealt at most; keys a task, where there are fewer chunks.
TURNS = 16


def fold_tasks(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks with state done or open: a claim log folded with a completion log."""
    keys = done.select(key).distinct().withColumn("is_done", F.lit(True))
    return tasks.join(keys, key, "left").withColumn("state", F.when(F.col("is_done"), "done").otherwise("open")).drop("is_done")


def word_pairs(words: Column) -> Column:
    """All pairs of a sorted array of words."""
    return F.flatten(F.transform(words, lambda x, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda y: F.struct(x.alias("v"), y.alias("w")))))


def word_classes(rows: DataFrame, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (ws, m, and maybe a column ``kind``) of equal ``ws``, two words at least, as one class: (c, ws, n, parts).

    And their members (c, kind, part, members), by kind and ``CHUNK`` a row on average.
    """
    rows = rows.where(F.size("ws") > 1).select("ws", (F.col(kind) if kind else F.lit(0)).alias("kind"), "m")
    sized = rows.groupBy("ws", "kind").agg(F.count(F.lit(1)).alias("n"))
    sized = sized.groupBy("ws").agg(F.sum("n").alias("n"), F.ceil(F.max("n") / CHUNK).cast("int").alias("parts"))
    classes = keep(sized.withColumn("c", F.monotonically_increasing_id()), "classes")
    large = _small(classes.where("parts > 1").select("ws", "parts"))  # one class in CHUNK rows at most
    part = F.pmod(F.xxhash64("m"), F.coalesce("parts", F.lit(1))).cast("int")
    chunks = rows.join(large, "ws", "left").groupBy("ws", "kind", part.alias("part")).agg(F.collect_list("m").alias("members"))
    return classes, keep(chunks.join(classes.select("ws", "c"), "ws").select("c", "kind", "part", "members"), "members")


def chunk_pairs(near: DataFrame, xs: DataFrame, ys: DataFrame, most: int = 1) -> DataFrame:
    """Pairs of classes (x, y, parts of y, ...) as pairs of chunks of their members ``us`` and ``vs``, with their kinds xk, yk and parts i, j.

    The number of tasks is fixed, as few bytes of chunks make many rows. If few
    chunks of y are there, each is dealt over up to ``most`` turns, one of which each
    chunk of x takes, so that a few classes are the work of all tasks. What is made of the
    chunks where they meet is shuffled no more.
    """
    spark = near.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = near.join(xs.select(F.col("c").alias("x"), F.col("kind").alias("xk"), F.col("part").alias("i"), F.col("members").alias("us")), "x")
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    turns = 1 if most < 2 else max(1, min(most, most * tasks // max(1, ys.select("c", "part").distinct().count())))
    left = left.withColumn("turn", F.pmod(F.xxhash64("x", "xk", "i"), F.lit(turns)).cast("int"))
    right = ys.select(F.col("c").alias("y"), F.col("kind").alias("yk"), F.col("part").alias("j"), F.col("members").alias("vs"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    on = ["y", "j", "turn"]
    return left.repartition(tasks, *on).join(right.repartition(tasks, *on), on).drop("turn")


def overlap_pairs(items: DataFrame, key: str, words: Column, apart: str | None = None) -> DataFrame:
    """(a, b, shared) for a < b that share two words at least and, if it is given, differ in column ``apart``.

    Items of equal words are one class. Classes are joined on pairs of their
    words, n shared words make n(n-1)/2 equal word pairs, and only then become
    pairs of items, which no shuffle carries.
    """
    own = items.select(F.col(key).alias("m"), *([F.col(apart).alias("apart")] if apart else []), F.array_sort(words).alias("ws"))
    classes, members = word_classes(own, apart and "apart")
    w = classes.select(F.col("c").alias("id"), "n", "parts", F.explode(word_pairs(F.col("ws"))).alias("two"))
    # a pair of words that very many classes have is dealt over a grid: each class is one row of the grid and one column
    n = w.groupBy("two").agg(F.count(F.lit(1)).alias("k")).where("k > 1").withColumn("side", F.ceil(F.col("k") / SIDE).cast("int")).drop("k")
    w = w.join(n, "two").withColumn("own", F.pmod(F.xxhash64("id"), F.col("side")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    x = w.withColumn("col", every).withColumnRenamed("own", "row").alias("x")
    y = w.withColumn("row", every).withColumnRenamed("own", "col").alias("y")
    same = (F.col("x.two") == F.col("y.two")) & (F.col("x.row") == F.col("y.row")) & (F.col("x.col") == F.col("y.col"))
    # the smaller class of two is the one that is moved
    pairs = x.join(y, same & (F.struct("x.n", "x.id") < F.struct("y.n", "y.id")))
    shared = F.round((1 + F.sqrt(1 + 8 * F.count(F.lit(1)))) / 2).cast("long").alias("shared")
    near = pairs.groupBy(F.col("x.id").alias("x"), F.col("y.id").alias("y"), F.col("y.parts").alias("parts")).agg(shared)
    own = classes.where("n > 1").select(F.col("c").alias("x"), F.col("c").alias("y"), "parts", F.size("ws").cast("long").alias("shared"))
    met = chunk_pairs(near.unionByName(own), members, members, TURNS).where("x <> y OR (xk, i) <= (yk, j)")
    if apart:
        met = met.where("xk <> yk")
    met = met.select((F.expr("x = y AND i = j AND xk <=> yk")).alias("once"), "shared", F.explode("us").alias("u"), "vs")
    met = met.select("once", "shared", "u", F.explode("vs").alias("v")).where("u <> v AND (u < v OR NOT once)")
    return met.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "shared")


def loops(events: DataFrame, keys: list[Column], threshold: int) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)


def _follow(heads: DataFrame, steps: DataFrame) -> list[DataFrame]:
    """The events (k, at, e) that chains of ``steps`` (k, at, nxt) reach from ``heads``, a table a round.

    Round i adds what lies 2^i steps on from all that is reached, then doubles
    the steps: as many rounds as the logarithm of the longest chain, none
    where no event but heads is kept. An event that is neither reached nor the
    end of such a step never will be, and its step goes: chains run together,
    so the steps of a round are ever fewer.
    """
    reached, out = heads.select("k", "at"), []
    while not steps.isEmpty():
        new = keep(reached.join(steps, ["at", "k"]).select("k", "nxt.at", "nxt.e"), "cooldown")
        if new.isEmpty():
            break
        out.append(new)
        reached = reached.unionByName(new.select("k", "at"))
        live = reached.unionByName(steps.select("k", "nxt.at")).distinct()
        far = steps.join(live, ["at", "k"], "left_semi").select("k", F.col("at").alias("start"), F.col("nxt.at").alias("at"))
        steps = keep(far.join(steps, ["at", "k"]).select("k", F.col("start").alias("at"), "nxt"), "cooldown")
    return out


def cooldown(events: DataFrame, keys: list[str], ts: Column, order: list[str], seconds: float) -> DataFrame:
    """Events kept: no kept event of the same key lies under ``seconds`` before.

    An event after a gap of ``seconds`` is a head and kept whatever came
    before. Any other is kept if a chain from a head leads to it, each step
    going to the first event ``seconds`` or more later. Time is cut into
    buckets of ``seconds``, so a step ends in the next bucket or with the first
    event of the one after; windows hold a key's bucket, never a key. Of events
    of one time the least by ``order`` counts; events without a time have no
    cooldown and stay; null keys are a key; ``seconds`` of zero or less keep
    all rows.
    """
    width = round(seconds * 1_000_000)
    rows = events.select(F.struct(*keys).alias("k"), F.unix_micros(ts.cast("timestamp")).alias("at"), F.struct(*order).alias("e"))
    plain = lambda df: df.select(*[F.col("k")[c].alias(c) for c in keys], *[F.col("e")[c].alias(c) for c in order])
    if width <= 0:
        return plain(rows)
    once = rows.where("at IS NOT NULL").groupBy("k", "at").agg(F.min("e").alias("e"))
    # in joins and windows the number comes before the struct of keys: sorting compares it first
    bucket = F.expr(f"(at - pmod(at, {width}L)) div {width}L")
    # an event stands in its own bucket and asks in the next one for the first event from at + width on
    stands = F.struct(bucket.alias("b"), F.col("at").alias("t"), F.lit(True).alias("own"))
    asks = F.struct((bucket + 1).alias("b"), (F.col("at") + width).alias("t"), F.lit(False).alias("own"))
    cells = once.select("*", F.explode(F.array(stands, asks)).alias("x")).select("k", "at", "e", "x.*")
    cell, own = Window.partitionBy("b", "k"), F.col("own")
    inside = F.max(F.when(own, F.col("at"))).over(cell.orderBy("t", "own").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("inside", inside).withColumn("before", F.coalesce("inside", F.max(F.when(~own, F.col("at"))).over(cell)))
    cells = cells.withColumn("head", F.coalesce(F.col("at") - F.col("before") >= width, F.lit(True)))
    onward = cell.orderBy(F.desc("t"), F.desc("own")).rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.last(F.when(own, F.struct("at", "head", "e")), ignorenulls=True).over(onward)
    cells = keep(cells.select("k", "b", "at", "e", "own", F.col("inside").isNull().alias("first"), "head", nxt.alias("nxt")), "cooldown")
    heads = cells.where("own AND head").select("k", "at", "e")
    then = cells.where("own AND first AND NOT head").select("k", (F.col("b") - 1).alias("b"), F.struct("at", "head", "e").alias("then"))
    near = cells.where("NOT own AND NOT nxt.head").select("k", "at", "nxt")
    far = cells.where("NOT own AND nxt IS NULL").select("k", "b", "at").join(then, ["b", "k"]).select("k", "at", F.col("then").alias("nxt"))
    kept = heads.select("k", "e")
    for more in _follow(heads, keep(near.unionByName(far), "cooldown")):
        kept = kept.unionByName(more.select("k", "e"))
    return plain(kept.unionByName(rows.where("at IS NULL").select("k", "e")))


def latest(events: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The newest row of each key; a maximum of structs, so it combines before the shuffle."""
    row = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in values if c not in order])).alias("r")
    return events.groupBy(*keys).agg(row).select(*keys, *[F.col("r")[c].alias(c) for c in dict.fromkeys([*order, *values])])


def sessions(events: DataFrame, key: str, ts: str, gap: float, order: str) -> DataFrame:
    at = F.col(ts).cast("timestamp").cast("double")
    w = Window.partitionBy(key).orderBy(at, order)
    rows = events.withColumn("_new", F.coalesce((at - F.lag(at).over(w) > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("started"), F.max(ts).alias("ended"))


def stale(rows: DataFrame, kind: Column, at: Column, days: dict[str, int | None], now: str, default: int = 180) -> DataFrame:
    """Rows older than their kind's days; kinds with None never age."""
    limit = F.lit(default)
    for name, n in days.items():
        limit = F.when(kind == name, F.lit(n).cast("int")).otherwise(limit)
    return rows.withColumn("limit_days", limit).where(F.datediff(F.lit(now).cast("date"), at.cast("date")) > F.col("limit_days"))


def file_edit_loops(logs: DataFrame, first_day: str, threshold: int = 3, project: str | None = None) -> DataFrame:
    """(target, edit_count, edits) of files that day logs (day, text) since ``first_day`` show edited ``threshold`` times or more.

    Counts combine before the shuffle; ``edits`` lists day, time and session of
    each edit, so a target's list is as long as its edits.
    """
    crumbs = logs.where(F.col("day") >= first_day).select("day", F.explode(replies.breadcrumbs(F.col("text"))).alias("c")).select("day", "c.*")
    edits = crumbs.where(F.col("tool").rlike(r"^(edit|write|multi_?edit|notebook_?edit)$"))
    if project is not None:
        edits = edits.where(F.lower("slug") == project.lower())
    found = edits.groupBy("target").agg(F.count(F.lit(1)).alias("edit_count"), F.array_sort(F.collect_list(F.struct("day", "at", "session"))).alias("edits"))
    return found.where(F.col("edit_count") >= threshold)
