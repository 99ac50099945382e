"""Blocks of text for all projects in one plan: a row (slug, block) a project, no longer than its limit.

A block is a table of lines (slug, part, place, sub, pos, text) until the end:
each part keeps its first few lines by ranks, which Spark cuts before the
shuffle, so a project with a third of all pages sends a handful of rows. Lines
are then added up by prefix sums of their lengths and those beyond the limit
never reach the block. Projects match pages and lines whatever the case, states
and heartbeats by the exact name. Null names of projects are none, repeated
ones are one, missing titles and summaries are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import fixed
from mnemora.functions import text as tx
from mnemora.operators import activity as ac
from mnemora.operators import context as cx
from mnemora.operators import quotes
from mnemora.operators.lint import alerts

PLACE = ["part", "place", "sub", "pos"]


def _low(name: str) -> Column:
    return F.lower(F.trim(name))


def budgeted(lines: DataFrame, key: str, order: list[str], limit: int, back: int = 20, mark: str = "\n… (truncated)\n") -> DataFrame:
    """(key, block): each key's lines (column text) in order, joined; a block over ``limit`` characters ends in ``mark`` within the line where it is full.

    Blank lines at the end don't count. Only lines that begin within the limit
    are gathered, so a block's list is bounded by the limit, not by the lines.
    """
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(upto), F.lit(0))
    rows = lines.withColumn("_start", start)
    rows = rows.withColumn("_end", F.when(F.trim("text") != "", F.col("_start") + F.length(F.regexp_replace("text", r"\s+\z", ""))))
    few = F.array_sort(F.collect_list(F.when(F.col("_start") <= limit + 1, F.struct(*order, "text"))))
    text = F.array_join(F.transform(few, lambda x: x["text"]), "\n")
    bare = lambda c: F.regexp_replace(c, r"\s+\z", "")
    made = rows.groupBy(key).agg(text.alias("_all"), (F.coalesce(F.max("_end"), F.lit(0)) > limit).alias("_over"))
    return made.select(key, F.when(F.col("_over"), F.concat(bare(F.substring("_all", 1, limit - back)), F.lit(mark))).otherwise(bare("_all")).alias("block"))


def _lines(df: DataFrame, part: int, pos: Column, text: Column, place: Column | None = None, sub: Column | None = None) -> DataFrame:
    return df.select("slug", F.lit(part).alias("part"), (F.lit(0) if place is None else place).cast("int").alias("place"), (F.lit("") if sub is None else sub).alias("sub"), pos.cast("int").alias("pos"), F.coalesce(text, F.lit("")).alias("text"))


def _listed(df: DataFrame, part: int, head: Column, items: str) -> DataFrame:
    """Head, a dash and each of ``items``, a blank line; nothing where there are no items."""
    dashed = F.transform(items, lambda x: F.concat(F.lit("- "), F.coalesce(x, F.lit(""))))
    every = F.concat(F.array(head), dashed, F.array(F.lit("")))
    return _lines(df.where(F.size(items) > 0).select("slug", F.posexplode(every).alias("pos", "text")), part, F.col("pos"), F.col("text"))


def _whole(projects: DataFrame, lines: list[DataFrame], limit: int, mark: str | None = None) -> DataFrame:
    every = reduce(DataFrame.unionByName, lines)
    made = budgeted(every, "slug", PLACE, limit) if mark is None else budgeted(every, "slug", PLACE, limit, mark=mark)
    return projects.select("slug").join(made, "slug", "left").select("slug", F.coalesce("block", F.lit("")).alias("block"))


def _names(projects: DataFrame) -> DataFrame:
    return projects.select("slug").where("slug IS NOT NULL").distinct().withColumn("low", _low("slug"))


def _first(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, ranked in ``nth``."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)


def day_lines(days: DataFrame, now: str, window: int = 7) -> DataFrame:
    """(stem, at, line) of day logs changed within ``window`` days; blank lines are out."""
    since = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(window))
    return days.where(F.col("modified") >= since).select("stem", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.trim("line") != "")


def project_blocks(projects: DataFrame, pages: DataFrame, states: DataFrame, lines: DataFrame, heartbeats: DataFrame, limit: int = cx.PROJECT_CHARS) -> DataFrame:
    """(slug, block) of all ``projects`` (slug): where each was left, its pages by type, ``lines`` (stem, at, line) that name it, its last heartbeat."""
    names = _names(projects)
    parts = [_lines(names, 0, F.lit(0), F.concat(F.lit("## Project context: "), "slug", F.lit("\n")))]
    left = cx.handoff(states).groupBy("slug").agg(F.max("handoff").alias("handoff")).join(names, "slug").where("handoff <> ''")
    parts.append(_lines(left, 1, F.lit(0), F.concat(F.lit("### Where you left off\n"), F.substring("handoff", 1, 500), F.lit("\n"))))

    own = pages.where(~F.coalesce("status", F.lit("")).isin(*fixed.INACTIVE)).select(_low("project").alias("low"), "type", "rel", F.coalesce(F.nullif(F.substring("summary", 1, 80), F.lit("")), "title").alias("line"))
    counts = own.groupBy("low").agg(F.count(F.lit(1)).alias("n")).join(names, "low")
    parts.append(_lines(counts, 2, F.lit(0), F.concat(F.lit("### Known knowledge ("), F.col("n").cast("string"), F.lit(" pages)")), F.lit(-1)))
    typed = own.where("low IS NOT NULL").select("low", F.coalesce("type", F.lit("unknown")).alias("type"), F.when(F.col("type").isNull(), 1).otherwise(0).alias("place"), "rel", "line")
    few = _first(typed, ["low", "type"], [F.col("rel"), F.col("line")], 5).groupBy("low", "type").agg(F.max("place").alias("place"), F.array_sort(F.collect_list(F.struct("nth", "line"))).alias("few")).join(names, "low")
    told = F.concat(F.array(F.concat(F.lit("**"), "type", F.lit("s:**"))), F.transform("few", lambda x: F.concat(F.lit("- "), F.coalesce(x["line"], F.lit("")))), F.array(F.lit("")))
    parts.append(_lines(few.select("slug", "place", "type", F.posexplode(told).alias("pos", "text")), 2, F.col("pos"), F.col("text"), F.col("place"), F.col("type")))

    told = lines.select(F.struct("stem", "at", F.concat("stem", F.lit(": "), F.substring(F.trim("line"), 1, 120)).alias("told")).alias("doc_id"), F.lower("line").alias("text"))
    named = quotes.holding(told, names.select(F.col("low").alias("qid"), F.col("low").alias("quote"))).select(F.col("qid").alias("low"), "doc_id.*")
    recent = _first(named, ["low"], [F.desc("stem"), F.col("at"), F.col("told")], 5).groupBy("low").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "told"))), lambda x: x["told"]).alias("told")).join(names, "low")
    parts.append(_listed(recent, 3, F.lit("### Recent activity (last 7 days)"), "told"))

    beat = ac.latest(heartbeats, ["slug"], ["at"], ["reason"]).join(names, "slug")
    seen = F.concat(F.lit("### Last seen\n- "), F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown")), F.lit(" at "), F.coalesce(F.nullif("at", F.lit("")), F.lit("?")))
    parts.append(_lines(beat, 4, F.lit(0), seen))
    return _whole(names, parts, limit)


def _shared(pages: DataFrame, names: DataFrame, most: int, n: int) -> DataFrame:
    """(slug, told): titles among the first ``most`` pages of other projects that share two words with a title of this one's.

    For any project those are among the first 2 x ``most`` of a list where each
    project has ``most`` pages at most, so one list of that length serves all.
    """
    stop = ("the", "a", "an", "for", "of", "to", "in", "and", "with")  # as in context.insights
    rows = pages.where("project IS NOT NULL").select(_low("project").alias("low"), "project", "rel", "title", tx.title_words(F.lower("title"), stop).alias("ws"))
    listed = _first(rows, ["low"], [F.col("rel"), F.col("title")], most).orderBy("rel", "title").limit(2 * most)
    before = F.collect_list("low").over(Window.orderBy("rel", "title").rowsBetween(Window.unboundedPreceding, -1))  # 2 x most rows
    listed = listed.withColumn("before", before).select("before", F.col("low").alias("other"), "project", "rel", "title", F.col("ws").alias("theirs"))
    other = (F.col("other") != F.col("low")) & (F.size(F.filter("before", lambda x: x != F.col("low"))) < most)
    both = F.array_sort(F.array_intersect("ws", "theirs"))
    near = rows.select("low", "ws").join(F.broadcast(listed), other & (F.size(F.array_intersect("ws", "theirs")) >= 2))
    near = near.groupBy("low", "rel", "title", "project").agg(F.min(F.array_join(both, ", ")).alias("words"))
    text = F.concat(F.lit("'"), F.coalesce("title", F.lit("")), F.lit("' ("), "project", F.lit(") — shares: "), "words")
    best = _first(near.withColumn("text", text), ["low"], [F.col("rel"), F.col("text")], n)
    return best.groupBy("low").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]).alias("told")).join(names, "low").select("slug", "told")


def advisory_blocks(projects: DataFrame, pages: DataFrame, states: DataFrame, findings: DataFrame, now: str, limit: int = cx.ADVISORY_CHARS) -> DataFrame:
    """(slug, block) of all ``projects``: open threads, last decision, lint alerts, other projects' pages, whether many pages are old.

    What is the same for all projects (alerts, the count of old pages, the last
    decision of no project) is one row, which is broadcast.
    """
    names = _names(projects)
    counted = lambda name, items: F.concat(F.lit(f"**{name} ("), F.size(items).cast("string"), F.lit("):**"))
    threads = cx.open_threads(states).groupBy("slug").agg(F.max("threads").alias("threads")).join(names, "slug")
    parts = [_listed(threads, 0, counted("Open threads", "threads"), "threads")]

    made = pages.where((F.lower("type") == "decision") & (F.coalesce("status", F.lit("active")) != "superseded") & F.col("timestamp").isNotNull())
    made = made.select(_low("project").alias("low"), F.substring("timestamp", 1, 10).alias("day"), "rel", F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce(F.substring("summary", 1, 100), F.lit(""))).alias("told"))
    newest = [F.desc("day"), F.col("rel"), F.col("told")]
    best = _first(made, ["low"], newest, 1).drop("nth")
    whole = F.broadcast(best.where("low IS NULL").drop("low"))  # one row
    mine = names.join(best, "low").select("slug", "day", "rel", "told").unionByName(names.select("slug").join(whole, F.lit(True)).select("slug", "day", "rel", "told"))
    last = _first(mine, ["slug"], newest, 1).withColumn("told", F.array("told"))
    parts.append(_listed(last, 1, F.concat(F.lit("**Last decision** ("), "day", F.lit("):")), "told"))

    since = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(90))
    old = pages.where((F.coalesce("status", F.lit("")) != "superseded") & (F.col("modified") < since)).agg(F.count(F.lit(1)).alias("n"))
    told = alerts(findings).agg(F.array_sort(F.collect_list("line")).alias("told"))  # three lines
    common = names.select("slug").join(F.broadcast(told), F.lit(True)).join(F.broadcast(old), F.lit(True))  # one row each
    parts.append(_listed(common, 2, counted("Lint alerts", "told"), "told"))
    parts.append(_listed(_shared(pages, names, 20, 3), 3, F.lit("**Cross-project insights:**"), "told"))
    parts.append(_lines(common.where("n > 5"), 4, F.lit(0), F.concat(F.lit("**Vault health:** "), F.col("n").cast("string"), F.lit(" pages older than 90 days — consider archiving."))))
    return _whole(names, parts, limit, mark="...")
