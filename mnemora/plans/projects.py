"""Queries of the blocks that sessions of all projects begin with.

Parts stand in for pages: the brand is the project, the size gives day, status
and age, the kind of metal the type; a part is named in the day log of its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators import blocks
from mnemora.sources.tables import table

NOW = "2024-06-01 00:00:00"


def _day(month: str):
    return F.concat(F.lit(f"2024-{month}-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "decision").when(F.col("p_size") % 3 == 1, "pattern")
    return table(s, d, "part").select(
        F.concat(F.lit("k/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("rel"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), kind.alias("type"), F.col("p_brand").alias("project"),
        F.when(F.col("p_size") % 7 == 0, "superseded").alias("status"), _day("04").alias("timestamp"), F.when(F.col("p_size") > 25, "2023-01-01").otherwise("2024-05-30").cast("timestamp").alias("modified"),
    )


def _states(s: SparkSession, d: str) -> DataFrame:
    first, last = F.min("p_name"), F.max("p_name")
    text = F.concat(F.lit("## Where we left off\n"), last, F.lit("\n\n## Open threads\n- "), first, F.lit("\n- "), last, F.lit("\n"))
    return table(s, d, "part").groupBy(F.col("p_brand").alias("slug")).agg(text.alias("text"))


def project_blocks(s, d):
    part = table(s, d, "part")
    lines = part.select(_day("05").alias("stem"), F.col("p_partkey").alias("at"), F.concat(F.lit("moved "), "p_name", F.lit(" of "), "p_brand").alias("line"))
    beats = part.select(F.col("p_brand").alias("slug"), _day("05").alias("at"), F.col("p_type").alias("reason"))
    return blocks.project_blocks(part.select(F.col("p_brand").alias("slug")), _pages(s, d), _states(s, d), lines, beats)


def advisory_blocks(s, d):
    part = table(s, d, "part")
    known = part.select(F.col("p_partkey").alias("target"))
    links = part.select(F.concat(F.lit("k/"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_partkey") * 3).alias("target")).join(known, "target", "left_anti")
    findings = links.select(F.lit("broken_wikilinks").alias("category"), F.lit("notes").alias("scope"), "path", F.col("target").cast("string").alias("target"), F.lit(None).cast("string").alias("detail"))
    return blocks.advisory_blocks(part.select(F.col("p_brand").alias("slug")), _pages(s, d), _states(s, d), findings, NOW)


_P = """p AS (SELECT 'k/' || p_partkey || '.md' AS rel, p_partkey AS id, p_name AS title, p_type AS summary, p_brand AS slug, CASE p_size % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'pattern' END AS type,
  p_size % 7 = 0 AS dead, '2024-04-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS day, '2024-05-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS stem, p_size > 25 AS old FROM part),
s AS (SELECT slug, min(title) AS lo, max(title) AS hi FROM p GROUP BY 1)"""
_CUT = "CASE WHEN length(x) > {0} THEN rtrim(substr(x, 1, {0} - 20), ' ' || chr(10)) || {1} ELSE x END AS block"
QUERIES = {"project_blocks": project_blocks, "advisory_blocks": advisory_blocks}
ORACLE_SQL = {
    "project_blocks": f"""WITH {_P}, n AS (SELECT slug, count(*) AS n FROM p WHERE NOT dead GROUP BY 1),
t AS (SELECT slug, coalesce(type, 'unknown') AS kind, rel, substr(summary, 1, 80) AS told, row_number() OVER (PARTITION BY slug, type ORDER BY rel) AS k FROM p WHERE NOT dead),
tt AS (SELECT slug, kind, '**' || kind || 's:**' || chr(10) || string_agg('- ' || told, chr(10) ORDER BY k) || chr(10) || chr(10) AS x FROM t WHERE k <= 5 GROUP BY 1, 2),
ty AS (SELECT slug, string_agg(x, '' ORDER BY kind = 'unknown', kind) AS x FROM tt GROUP BY 1),
l AS (SELECT s.slug, p.stem || ': ' || substr('moved ' || title || ' of ' || p.slug, 1, 120) AS told, row_number() OVER (PARTITION BY s.slug ORDER BY p.stem DESC, id) AS k FROM s JOIN p ON contains(lower('moved ' || title || ' of ' || p.slug), lower(s.slug))),
ll AS (SELECT slug, string_agg('- ' || told, chr(10) ORDER BY k) AS x FROM l WHERE k <= 5 GROUP BY 1),
h AS (SELECT slug, stem AS seen, summary AS reason FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY stem DESC, summary DESC) AS k FROM p) WHERE k = 1),
b AS (SELECT slug, '## Project context: ' || slug || chr(10) || chr(10) || '### Where you left off' || chr(10) || hi || chr(10) || chr(10) || coalesce('### Known knowledge (' || n || ' pages)' || chr(10) || ty.x, '')
  || '### Recent activity (last 7 days)' || chr(10) || ll.x || chr(10) || chr(10) || '### Last seen' || chr(10) || '- ' || reason || ' at ' || seen AS x
  FROM s LEFT JOIN n USING (slug) LEFT JOIN ty USING (slug) JOIN ll USING (slug) JOIN h USING (slug))
SELECT slug, {_CUT.format(2000, "chr(10) || '… (truncated)' || chr(10)")} FROM b""",
    "advisory_blocks": f"""WITH {_P},
d AS (SELECT slug, day, title || ': ' || substr(summary, 1, 100) AS told FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY day DESC, rel) AS k FROM p WHERE type = 'decision' AND NOT dead) WHERE k = 1),
f AS (SELECT substr('[notes] k/' || id || ' -> [[' || id * 3 || ']]', 1, 120) AS line FROM p WHERE id * 3 NOT IN (SELECT id FROM p) ORDER BY 1 LIMIT 3),
ff AS (SELECT count(*) AS n, string_agg('- ' || line, chr(10) ORDER BY line) AS x FROM f),
w AS (SELECT *, list_filter(list_distinct(string_split(lower(title), ' ')), lambda x: x NOT IN ('', 'the', 'a', 'an', 'for', 'of', 'to', 'in', 'and', 'with')) AS ws FROM p),
o AS (SELECT s.slug, w.slug AS project, rel, title, ws, row_number() OVER (PARTITION BY s.slug ORDER BY rel) AS k FROM s JOIN w ON w.slug <> s.slug),
i AS (SELECT o.slug, o.rel, '''' || o.title || ''' (' || project || ') — shares: ' || min(array_to_string(list_sort(list_intersect(w.ws, o.ws)), ', ')) AS told FROM o JOIN w ON w.slug = o.slug AND len(list_intersect(w.ws, o.ws)) >= 2 WHERE k <= 20 GROUP BY o.slug, o.rel, o.title, project),
ii AS (SELECT slug, string_agg('- ' || told, chr(10) ORDER BY k) AS x FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY rel) AS k FROM i) WHERE k <= 3 GROUP BY 1),
v AS (SELECT count(*) AS n FROM p WHERE NOT dead AND old),
b AS (SELECT slug, rtrim('**Open threads (2):**' || chr(10) || '- ' || lo || chr(10) || '- ' || hi || chr(10) || chr(10) || coalesce('**Last decision** (' || day || '):' || chr(10) || '- ' || told || chr(10) || chr(10), '')
  || coalesce('**Lint alerts (' || ff.n || '):**' || chr(10) || ff.x || chr(10) || chr(10), '') || coalesce('**Cross-project insights:**' || chr(10) || ii.x || chr(10) || chr(10), '')
  || CASE WHEN v.n > 5 THEN '**Vault health:** ' || v.n || ' pages older than 90 days — consider archiving.' ELSE '' END, ' ' || chr(10)) AS x FROM s LEFT JOIN d USING (slug) LEFT JOIN ii USING (slug), ff, v)
SELECT slug, {_CUT.format(800, "'...'")} FROM b""",
}
