"""Column functions that parse replies and breadcrumb lines of agents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.functions import fixed
from mnemora.functions.text import strip

#: The counts of an audit line and where they stand in it.
AUDIT_COUNTS = {
    "verified": r"(?i)verified\s+(\d+)\s+evidence", "dedup": r"(?i)(\d+)\s+dedup checks", "stubs": r"(?i)(\d+)\s+stubs skipped",
    "contradictions": r"(?i)(\d+)\s+contradictions handled", "rejected": r"(?i)(\d+)\s+pages rejected",
}


def tier(reply: Column) -> Column:
    """struct(tier, body): by the token on the first line, which quotes and full stops may surround; without one, replies that keep nothing or aren't one are ok, all others minor."""
    whole = strip(F.coalesce(reply, F.lit("")))
    first = strip(F.substring_index(whole, "\n", 1))
    bare = lambda text, marks: F.regexp_replace(text, rf"^[{marks}]+|[{marks}]+$", "")
    unquoted = F.regexp_replace(F.regexp_replace(F.upper(first), r"\.+$", ""), r"^(`*)(.*?)\1$", "$2")
    told = F.create_map(*[F.lit(x) for kv in fixed.REPLY_TIERS.items() for x in kv])[unquoted]
    lines = F.transform(F.split(F.upper(whole), "\n"), strip)
    nothing = (whole == "") | F.arrays_overlap(lines, F.array(*[F.lit(x) for x in fixed.NOTHING_LASTS[:2]]))
    nothing = nothing | bare(F.upper(whole), r" .\n\t*`").isin(*fixed.NOTHING_LASTS)
    for start in fixed.NO_REPLY:
        nothing = nothing | whole.startswith(start)
    rest = bare(F.substring(whole, F.length(first) + 1, F.length(whole)), r" \n\t*`")
    return F.struct(
        F.coalesce(told, F.when(nothing, "ok").otherwise("minor")).alias("tier"),
        F.when(told.isNotNull(), rest).when(nothing, "").otherwise(whole).alias("body"),
    )


def audit(reply: Column) -> Column:
    """struct of the five counts of the last audit line; counts that are absent are null."""
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), strip), lambda x: x.startswith("COMPILE_AUDIT:"))
    line = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    return F.struct(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")).cast("int").alias(k) for k, p in AUDIT_COUNTS.items()])


def json_block(reply: Column) -> Column:
    """From the first brace to the last; null if there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


def breadcrumbs(log: Column) -> Column:
    """array of struct(at, session, slug, tool, target) of a day log's tool lines: four parts between bars, the last a tool and what it was used on."""
    parts = F.transform(F.split(log, "\n"), lambda x: F.split(x, r"\s+\|\s+", 4))
    crumbs = F.filter(parts, lambda p: (F.size(p) == 4) & F.lower(p[0]).rlike(r"\[\d{2}:\d{2}:\d{2}\]\s+tool$"))
    name = lambda p: F.substring_index(F.substring_index(strip(p[3]), " ", 1), "`", 1)
    used = lambda p: strip(F.regexp_replace(F.substring(strip(p[3]), F.length(name(p)) + 1, F.length(p[3])), "^`", ""))
    return F.transform(
        crumbs,
        lambda p: F.struct(
            F.substring(F.substring_index(p[0], "]", 1), -8, 8).alias("at"), F.substring(strip(p[1]), 1, 8).alias("session"), strip(p[2]).alias("slug"),
            F.lower(name(p)).alias("tool"), F.coalesce(F.nullif(used(p), F.lit("")), F.lit("(unknown)")).alias("target"),
        ),
    )
