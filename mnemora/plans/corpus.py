"""Queries of text functions, lint checks, duplicates of summaries, catalogues and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.functions import fixed, text as tx
from mnemora.operators import activity as ac, graph, pages as pg
from mnemora.plans.search import _EDGES, _TITLE, link_edges
from mnemora.sources.tables import table

LANGS = ("en", "fr", "de")
WS = r"[ \t\n\x0B\f\r]+"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _first_line(c: str = "text"):
    return F.trim(F.substring_index(c, "\n", 1))


def word_count(s, d):
    return _docs(s, d).select("doc_id", tx.content_words(F.col("text")).alias("n_words"))


def lint_sparse(s, d):
    return word_count(s, d).where("n_words < 200")


def lint_broken_links(s, d):
    known = table(s, d, "pages").select(F.regexp_extract("url", r"^https?://[^/]+(/.*)?$", 1).alias("path"))
    return graph.unresolved(link_edges(s, d), known).select("src", "dst")


def lint_backlinks(s, d):
    """Derived edges: part to supplier key, both as node numbers."""
    e = table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.missing_backlinks(e)


def lint_orphans(s, d):
    """Documents that the ledger, the labels, doesn't name."""
    return _docs(s, d).select("doc_id", "source").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


def lint_type_domain(s, d):
    return _docs(s, d).where(~F.col("lang").isin(*LANGS)).select("doc_id", "lang")


def lint_temporal(s, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus", day.alias("valid_to")).where((F.col("valid_to") < "1996-01-01") & (F.col("o_orderstatus") == "O")).select("o_orderkey", "valid_to")


def _ledger(s, d):
    """What was compiled: the labelled documents, those of quality 0 as they were before, when they were empty."""
    rows = _docs(s, d).join(table(s, d, "labels"), "doc_id")
    return rows.select("doc_id", F.sha2(F.when(F.col("quality") == 0, "").otherwise(F.col("text")), 256).alias("h"))


def lint_drift(s, d):
    """Documents whose hash differs from the ledger's."""
    now, then = _docs(s, d).select("doc_id", F.sha2("text", 256).alias("h")), _ledger(s, d).withColumnRenamed("h", "then")
    return now.join(then, "doc_id").where("h <> then").select("doc_id", "h")


def lint_summary(s, d):
    parts = [("sparse_pages", lint_sparse), ("broken_links", lint_broken_links), ("missing_backlinks", lint_backlinks), ("orphans", lint_orphans), ("type_domain", lint_type_domain), ("temporal", lint_temporal), ("drift", lint_drift)]
    made = None
    for name, f in parts:
        one = f(s, d).select(F.lit(name).alias("category"))
        made = one if made is None else made.unionByName(one)
    return made.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("fails_gate", F.col("category") != "drift")


def feedback_classify(s, d):
    family, confidence = tx.feedback_family(F.col("text"))
    return table(s, d, "conversations").select("conv_id", "turn", family.alias("family"), confidence.alias("confidence")).where("family is not null")


def redact_secrets(s, d):
    red = tx.redact(F.col("text"))
    rows = _docs(s, d).where("text IS NOT NULL").select("doc_id", "text", red.alias("red"))
    return rows.select("doc_id", F.sha2("red", 256).alias("redacted_sha256"), (F.col("red") != F.col("text")).alias("changed"))


def slugify(s, d):
    return _docs(s, d).select("doc_id", tx.slug(_first_line()).alias("slug"))


FOLDERS = {"en": "decisions", "fr": "facts", "de": "comparisons"}


def infer_type(s, d):
    """The type that a document's path means, the folder by its language."""
    folder = F.lit("misc")
    for lang, name in FOLDERS.items():
        folder = F.when(F.col("lang") == lang, name).otherwise(folder)
    rel = F.concat(F.lit("knowledge/notes/"), folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return _docs(s, d).select("doc_id", pg.infer_type(rel).alias("kind"))


def noise_lines(s, d):
    lines = _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    noise, broken = F.count_if(tx.is_noise(F.col("line"))), F.count_if(tx.is_mojibake(F.col("line")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), noise.alias("n_noise"), broken.alias("n_mojibake"))


def clip_text(s, d):
    return _docs(s, d).select("doc_id", F.sha2(tx.clip(tx.collapse_ws(F.col("text")), 140), 256).alias("clip_sha256"))


def budget_prefix(s, d):
    """Documents of each source, by id, while their characters fit the budget.

    Sums run over blocks of ids first, a row a block, then within the blocks in
    which a budget may end: no task holds a source.
    """
    rows = _docs(s, d).select("doc_id", "source", "n_chars").withColumn("part", F.floor(F.col("doc_id") / 4096))
    blocks = rows.groupBy("source", "part").agg(F.sum("n_chars").alias("n"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("before", F.sum("n").over(upto(Window.partitionBy("source").orderBy("part"))) - F.col("n")).where("before <= 120000")
    inside = rows.join(blocks.drop("n"), ["source", "part"]).withColumn("own", F.sum("n_chars").over(upto(Window.partitionBy("source", "part").orderBy("doc_id"))))
    return inside.select("doc_id", "source", (F.col("before") + F.col("own")).alias("running")).where("running <= 120000")


def guardrails_topn(s, d):
    """Rules: imperative first lines of documents, then feedback; one per 60-character key, fifteen at most."""
    pages = _docs(s, d).select(F.lit(0).alias("part"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), _first_line().alias("rule")).where(F.col("rule").rlike(tx.IMPERATIVE))
    told = table(s, d, "conversations").where(tx.feedback_family(F.col("text"))[0].isNotNull())
    rows = pages.unionByName(told.select(F.lit(1).alias("part"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("turn"), F.col("text").alias("rule")))
    rows = rows.withColumn("rule", F.substring("rule", 1, 150))
    first = rows.groupBy(F.substring(F.lower("rule"), 1, 60).alias("key")).agg(F.min(F.struct("part", "id", "turn", "rule")).alias("r"))
    return first.select("r.*").orderBy("part", "id", "turn").limit(15)


def catalog_sections(s, d):
    rows = _docs(s, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_pages"), F.min(F.lower(_first_line())).alias("first_hook"))
    return rows


def agent_strengths(s, d):
    n = _docs(s, d).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "lang")
    return n.withColumn("place", F.row_number().over(w)).where("place <= 5")


def snapshot_dedup(s, d):
    key = F.lower(tx.collapse_ws(F.substring("text", 1, 200)))
    return _docs(s, d).groupBy(F.sha2(key, 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).select("doc_id", "n")


def hash_ledger_changed(s, d):
    """Documents that the ledger lacks or has under another hash."""
    now = _docs(s, d).select("doc_id", F.sha2("text", 256).alias("h"))
    return now.join(_ledger(s, d), ["doc_id", "h"], "left_anti")


def cross_source_overlap(s, d):
    """Pairs of part names with two shared words at least, of different brands."""
    p = table(s, d, "part")
    return ac.overlap_pairs(p, "p_partkey", tx.title_words(F.col("p_name")), "p_brand")


def contradictions(s, d):
    """New pages, parts of type ECONOMY that say so, against all parts' titles: two words in common."""
    p = table(s, d, "part")
    new = p.where("p_type = 'ECONOMY'").select(F.col("p_partkey").cast("string").alias("slug"), F.col("p_name").alias("title"), F.concat(F.lit("Replaced by "), "p_brand").alias("body_markdown"))
    old = p.select(F.concat(F.lit("knowledge/notes/"), F.col("p_partkey").cast("string")).alias("rel"), F.col("p_partkey").cast("string").alias("stem"), F.concat(F.lit("# "), "p_name").alias("text"))
    return pg.contradicted(new, old)


def tail_text(s, d):
    return _docs(s, d).select("doc_id", F.sha2(F.expr("right(text, 500)"), 256).alias("tail_sha256"), F.length(F.expr("right(text, 500)")).cast("long").alias("n"))


def carry_section(s, d):
    """Lines after a heading-like line (ends with a full stop, under 30 characters) carry its number."""
    lines = _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.length("line") < 30, F.col("pos"))
    return lines.withColumn("head", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit(-1))).groupBy("doc_id", "head").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_CW = r"len(regexp_extract_all(lower(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '---') AND NOT starts_with(trim(x), '#')), chr(10))), '[\p{L}\p{N}_]+'))::BIGINT"
_SPARSE = f"SELECT doc_id, {_CW} AS n_words FROM documents WHERE {_CW} < 200"
_BROKEN = f"WITH {_EDGES} SELECT src, dst FROM e WHERE dst NOT IN (SELECT regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) FROM pages)"
_BACK = "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT src, dst FROM e WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src)"
_ORPH = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
_DOMAIN = "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'fr', 'de')"
_TEMP = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS valid_to FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') < '1996-01-01' AND o_orderstatus = 'O'"
_DRIFT = "SELECT doc_id, sha256(text) AS h FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND text <> ''"
_WSQ = r"trim(regexp_replace({0}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_STRIP = r"regexp_replace({0}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(map(_quote, words)) + ")"


_HITS = ", ".join(f"regexp_matches(text, {_quote(tx.whole_words(p))})" for _, p in fixed.FEEDBACK_FAMILIES)
_NAMES = " ".join(f"WHEN h[{i + 1}] THEN '{n}'" for i, (n, _) in enumerate(fixed.FEEDBACK_FAMILIES))
_FEEDBACK = f"""SELECT conv_id, turn, text, CASE {_NAMES} END AS family, CASE WHEN n >= 2 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence
FROM (SELECT *, len(list_filter(h, lambda x: x)) AS n FROM (SELECT conv_id, turn, text, [{_HITS}] AS h FROM conversations
WHERE length({_STRIP.format('text')}) >= 10 AND NOT regexp_matches({_STRIP.format('text')}, {_quote(tx.ACKNOWLEDGEMENT)}))) WHERE n > 0"""
_NOISE = " OR ".join([f"{_STRIP.format('line')} = ''", *[f"regexp_matches(line, {_quote(p)})" for p in fixed.NOISE_LINES]])
_MARKS = "(" + " + ".join(f"(length(line) - length(replace(line, '{m}', ''))) / {len(m)}.0" for m in fixed.MOJIBAKE) + ")::DOUBLE"


def _redact_sql() -> str:
    """The redacted text as ``t``, of each document."""
    out = "coalesce(text, '')"
    for name, pattern in tx.SECRET_PATTERNS:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '[REDACTED:{name}]', 'g')"
    k = "(length(t) - length(replace(t, c, '')))::DOUBLE / length(t)"
    bits = f"round(-list_sum(list_sort(list_transform(list_distinct(string_split(t, '')), lambda c: {k} * log2({k})))), 9)"
    odd = f"list_filter(list_distinct(regexp_extract_all(t0, '{tx.TOKEN}')), lambda t: regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[a-z]') AND {bits} >= {tx.ENTROPY})"
    order = f"list_transform(list_sort(list_transform({odd}, lambda t: {{'n': -length(t), 't': t}})), lambda x: x.t)"
    return f"SELECT doc_id, text, list_reduce(list_prepend(t0, {order}), lambda acc, x: replace(acc, x, '[REDACTED:entropy]')) AS t FROM (SELECT doc_id, text, {out} AS t0 FROM documents WHERE text IS NOT NULL)"


ORACLE_SQL = {
    "word_count": f"SELECT doc_id, {_CW} AS n_words FROM documents",
    "lint_sparse": _SPARSE, "lint_broken_links": _BROKEN, "lint_backlinks": _BACK, "lint_orphans": _ORPH, "lint_type_domain": _DOMAIN, "lint_temporal": _TEMP, "lint_drift": _DRIFT,
    "lint_summary": "SELECT category, count(*) AS n, category <> 'drift' AS fails_gate FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS category FROM ({q})" for c, q in (("sparse_pages", _SPARSE), ("broken_links", _BROKEN), ("missing_backlinks", _BACK), ("orphans", _ORPH), ("type_domain", _DOMAIN), ("temporal", _TEMP), ("drift", _DRIFT))) + ") GROUP BY category",
    "feedback_classify": f"SELECT conv_id, turn, family, confidence FROM ({_FEEDBACK})",
    "redact_secrets": f"SELECT doc_id, sha256(t) AS redacted_sha256, t <> text AS changed FROM ({_redact_sql()})",
    "slugify": rf"""WITH a AS (SELECT doc_id, {_TITLE} AS t FROM documents), b AS (SELECT doc_id, t, regexp_replace(substr(regexp_replace(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}_]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 1, 53), '[-_]+$', '') AS s FROM a)
SELECT doc_id, CASE WHEN s = '' THEN substr(sha256(t), 1, 6) ELSE s || '-' || substr(sha256(t), 1, 6) END AS slug FROM b""",
    "infer_type": "SELECT doc_id, CASE lang WHEN 'en' THEN 'decision' WHEN 'de' THEN 'synthesis' ELSE 'concept' END AS kind FROM documents",
    "noise_lines": f"""SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({_NOISE}) AS n_noise, count(*) FILTER ({_MARKS} > 0 AND {_MARKS} >= {fixed.MOJIBAKE_SHARE}::DOUBLE * length(line)) AS n_mojibake
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""",
    "clip_text": f"SELECT doc_id, sha256(CASE WHEN length({_WSQ.format('text')}) > 140 THEN rtrim(substr({_WSQ.format('text')}, 1, 139)) || '…' ELSE {_WSQ.format('text')} END) AS clip_sha256 FROM documents",
    "budget_prefix": "SELECT * FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) WHERE running <= 120000",
    "guardrails_topn": f"""WITH r AS (SELECT 0 AS part, doc_id AS id, 0::BIGINT AS turn, {_TITLE} AS rule FROM documents WHERE regexp_matches({_TITLE}, {_quote(tx.IMPERATIVE)})
UNION ALL SELECT 1, conv_id, turn, text FROM ({_FEEDBACK})), k AS (SELECT part, id, turn, substr(rule, 1, 150) AS rule FROM r)
SELECT part, id, turn, rule FROM (SELECT *, row_number() OVER (PARTITION BY substr(lower(rule), 1, 60) ORDER BY part, id, turn) AS n FROM k) WHERE n = 1 ORDER BY part, id, turn LIMIT 15""",
    "catalog_sections": f"SELECT lang, source, count(*) AS n_pages, min(lower({_TITLE})) AS first_hook FROM documents GROUP BY 1, 2",
    "agent_strengths": "SELECT * FROM (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS place FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE place <= 5",
    "snapshot_dedup": f"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY lower({_WSQ.format('substr(text, 1, 200)')})",
    "hash_ledger_changed": "SELECT doc_id, sha256(text) AS h FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR (quality = 0 AND text <> '')",
    "cross_source_overlap": """WITH w AS (SELECT p_partkey AS id, p_brand AS br, unnest(list_filter(list_distinct(string_split(lower(p_name), ' ')), lambda x: x <> '' AND x NOT IN """ + _in(fixed.TITLE_STOP) + """)) AS w FROM part)
SELECT x.id AS a, y.id AS b, count(*) AS shared FROM w x JOIN w y ON x.w = y.w AND x.id < y.id WHERE x.br <> y.br GROUP BY 1, 2 HAVING count(*) >= 2""",
    "contradictions": """WITH w AS (SELECT p_partkey AS id, p_type, unnest(list_filter(list_distinct(string_split(lower(p_name), ' ')), lambda x: x <> '' AND x NOT IN """ + _in(fixed.TITLE_STOP) + """)) AS w FROM part)
SELECT x.id::VARCHAR AS slug, 'knowledge/notes/' || y.id AS rel FROM w x JOIN w y ON x.w = y.w AND x.id <> y.id WHERE x.p_type = 'ECONOMY' GROUP BY x.id, y.id HAVING count(*) >= 2""",
    "tail_text": "SELECT doc_id, sha256(right(text, 500)) AS tail_sha256, length(right(text, 500))::BIGINT AS n FROM documents",
    "carry_section": """WITH l AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
h AS (SELECT doc_id, last_value(CASE WHEN length(line) < 30 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS head FROM l) SELECT doc_id, coalesce(head, -1)::INT AS head, count(*) AS n FROM h GROUP BY 1, 2""",
}
