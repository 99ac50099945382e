"""Queries of lint, ranked search, migration and filters over a vault made of documents and labels.

Each document is a page: its labels are front matter, its first line the title,
its links are the pages of three times its id and of the next id, and, where it
is superseded, of twice its id.
"""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import fixed
from mnemora.operators import context as cx
from mnemora.operators import graph, lint
from mnemora.operators import pages as pg
from mnemora.operators import retrieval as rt
from mnemora.operators import search as se
from mnemora.operators import triggers as tg
from mnemora.plans.corpus import _CW, _in
from mnemora.plans.search import _TITLE, _VEC
from mnemora.sources import vault
from mnemora.sources.vault import exists
from mnemora.sources.scratch import remove, root, stamp
from mnemora.sources.tables import table

KINDS = {"en": "concept", "fr": "gap", "de": "pattern"}
TODAY, ENDED = "2024-06-01", "2023-12-31"


def _rel(c: str = "doc_id"):
    return F.concat(F.lit("knowledge/notes/"), F.col(c).cast("string"), F.lit(".md"))


def raw(s: SparkSession, d: str) -> DataFrame:
    """The pages as files: rel, name, stem, text, modified."""
    marks = table(s, d, "labels").select("doc_id", "quality", "toxic")  # few and narrow: while they fit a task, no text is shuffled to them
    rows = table(s, d, "documents").join(rt._small(marks), "doc_id", "left")
    kind = F.lit("memo")
    for lang, name in KINDS.items():
        kind = F.when(F.col("lang") == lang, name).otherwise(kind)
    n = lambda k, plus=0: (F.col("doc_id") * k + plus).cast("string")
    part = lambda when, *text: F.when(when, F.concat(*text)).otherwise("")
    front = F.concat(
        F.lit("---\n"), part(F.col("toxic") == 0, F.lit("type: "), kind, F.lit("\n")),
        part(F.col("quality") == 0, F.lit("status: superseded\nsuperseded_by: [["), n(2), F.lit("]]\n")),
        part(F.col("lang") == "en", F.lit(f"valid_to: {ENDED}\n")), F.lit("project: "), "source", F.lit("\n---\n"),
    )
    text = F.concat(F.when(F.col("quality").isNull(), "").otherwise(front), F.coalesce("text", F.lit("")), F.lit("\nSee [["), n(3), F.lit("]] and [["), n(1, 1), F.lit("]].\n"))
    return rows.select(
        _rel().alias("rel"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.col("doc_id").cast("string").alias("stem"), text.alias("text"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modified"),
    )


def _pages(s: SparkSession, d: str) -> DataFrame:
    return vault.structured(raw(s, d))


def _told(findings: DataFrame, target: bool = False) -> DataFrame:
    return findings.select("path", *(["target"] if target else [])).distinct()


def lint_broken_wikilinks(s, d):
    p = _pages(s, d)
    return _told(lint.broken_links(p, p.select("rel", "stem")), True)


def lint_untracked_links(s, d):
    """Links of tracked pages, the labelled ones, to nothing or to pages that aren't tracked."""
    p = _pages(s, d)
    tracked = table(s, d, "labels").select(_rel().alias("rel"))
    return lint.broken_links(p, p.select("rel", "stem"), tracked).select("path", "target", F.coalesce("detail", F.lit("")).alias("detail")).distinct()


def lint_page_backlinks(s, d):
    return _told(lint.missing_backlinks(_pages(s, d)), True)


def lint_frontmatter(s, d):
    return _told(lint.missing_frontmatter(_pages(s, d)))


def lint_required_type(s, d):
    return _told(lint.missing_type(_pages(s, d)))


def lint_type_value(s, d):
    return _told(lint.invalid_type(_pages(s, d)))


def lint_sources(s, d):
    return _told(lint.missing_sources(_pages(s, d)))


def lint_supersede(s, d):
    p = _pages(s, d)
    return _told(lint.supersede_chain(p, p.select("rel", "stem")), True)


def lint_gaps(s, d):
    return _told(lint.orphan_gaps(_pages(s, d)))


def lint_validity(s, d):
    return _told(lint.temporal_validity(_pages(s, d), TODAY))


def lint_orphan_pages(s, d):
    """Site pages that the first page's source doesn't name by the last part of their path or the whole."""
    site = table(s, d, "pages")
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    rows = site.select(F.concat(path, F.lit(".md")).alias("rel"), F.concat(F.substring_index(path, "/", -1), F.lit(".md")).alias("name"), F.substring_index(path, "/", -1).alias("stem"))
    index = site.orderBy("page_id").limit(1).select(F.col("html").alias("text"))
    return _told(lint.orphan_pages(rows, index))


def lint_counts(s, d):
    """All checks over the vault, by category; days and ledger are documents and labels."""
    p = _pages(s, d)
    days = table(s, d, "documents").select(_rel().alias("rel"), F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("hash"))
    ledger = table(s, d, "labels").select(F.col("doc_id").cast("string").alias("name"), F.sha2(F.lit(""), 256).alias("hash"))
    index = s.createDataFrame([("- [[knowledge/notes/1]]\n- [[knowledge/notes/7]]",)], "text string")
    return lint.counts(lint.run(p, index, days, ledger, TODAY)).where("category not in ('orphan_pages', 'contradictions')").select("category", "n")


def migrate_status(s, d):
    return pg.status_counts(pg.migrate(raw(s, d), "2024-06-01T00:00:00"))


def supersede_marked(s, d):
    """Pages that the ledger supersedes, marked in their text."""
    pairs = table(s, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("slug"), _rel().alias("rel"))
    made = pg.supersede(raw(s, d), pairs)
    return made.select("rel", F.sha2("text", 256).alias("text_sha256"))


def archive_days(s, d):
    """Logs of a user's day that are older than 30 days and as they were when compiled at eight in the evening; what came later shows in the hash."""
    day = F.date_format("ts", "yyyy-MM-dd")
    e = table(s, d, "events")
    marks = F.concat_ws("-", F.count(F.lit(1)), F.min("event_id"), F.max("event_id"), F.sum("event_id"))
    digest = lambda rows: rows.groupBy(day.alias("date"), "user_id").agg(F.sha2(marks, 256).alias("hash")).withColumn("name", F.concat("date", F.lit("-"), F.col("user_id").cast("string"), F.lit(".md")))
    days = digest(e).select("name", "hash", F.to_date("date").alias("day"), F.concat(F.lit("knowledge/daily/"), "name").alias("rel"))
    return pg.day_archive(days, digest(e.where("hour(ts) < 20")).select("name", "hash"), "2024-02-25", max_age=30, least=2)


def old_page_count(s, d):
    """Orders that aren't done and weren't touched for 90 days before a day."""
    rows = table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "superseded").alias("status"), F.col("o_orderdate").cast("timestamp").alias("modified"))
    return s.createDataFrame([(cx.old_pages(rows, "1998-06-01 00:00:00"),)], "n long")


def project_rows(s, d):
    """Documents of a project in the strict and in the tolerant sense; source 3 stands for none."""
    rows = table(s, d, "documents").select("doc_id", F.when(F.col("source") != "src3", F.upper("source")).alias("project"))
    return rows.select("doc_id", cx.for_project("src1", absent=False).alias("strict"), cx.for_project("src1").alias("tolerant")).where("tolerant")


def editorial_names(s, d):
    """Nations whose name isn't in the tree rule's list."""
    rule = vault.TreeRule(names=("NATION_3", "NATION_7"))
    return rule(table(s, d, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("name"), F.col("n_name").alias("rel"), F.lit("").alias("status"))).select("n_nationkey")


def prompts(s, d):
    """Prompts of five characters and more, and what is worth keeping of them: their first 140."""
    rows = table(s, d, "conversations").where("role = 'user'").where(F.length(F.trim("text")) >= 5)
    return rows.select("conv_id", "turn", F.sha2(F.substring(F.trim("text"), 1, 140), 256).alias("preview_sha256"))


def safe_slugs(s, d):
    """Categories and slugs of a plan made safe: languages as categories, first lines as slugs."""
    rows = table(s, d, "documents")
    asked = F.when(F.col("lang") == "en", "Concepts").when(F.col("lang") == "fr", "../x").when(F.col("lang") == "de", "")
    return rows.select("doc_id", pg.safe_category(asked.otherwise("qa")).alias("category"), pg.safe_slug(F.trim(F.substring_index("text", "\n", 1))).alias("slug"))


def yaml_titles(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(pg.yaml(F.col("text")), 256).alias("yaml_sha256"))


def latest_day(s, d):
    """The day whose name is greatest, with its number of events."""
    days = table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return vault.latest(days)


def first_lists(s, d):
    """Two ordered lists of nations, suppliers' then customers', each nation where it comes first."""
    place = lambda t, key, nation, i: table(s, d, t).groupBy(F.col(nation).alias("nation")).agg(F.min(key).alias("place"))
    return pg.first_wins([place("supplier", "s_suppkey", "s_nationkey", 0), place("customer", "c_custkey", "c_nationkey", 1)], "nation").select("nation", "list", "place")


def search_pages(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents")
    none = F.lit(None).cast("string")
    return rows.select(
        _rel().alias("rel"), F.col("doc_id").cast("string").alias("stem"), F.trim(F.substring_index("text", "\n", 1)).alias("title"), F.lit("").alias("summary"),
        F.coalesce("text", F.lit("")).alias("body"), F.col("source").alias("project"), none.alias("timestamp"), none.alias("valid_to"), none.alias("source_authority"),
    )


def _index(s: SparkSession, d: str, stemmed: bool) -> se.Index:
    """The stored index of the documents, by page as all queries here are batches; the first query of a session builds it."""
    path = f"{root(s)}/mnemora-index-{'stem' if stemmed else 'word'}-{stamp(s, f'{d}/documents.parquet')}-{s.sparkContext.applicationId}"
    if not exists(s, f"{path}/versions/{1:08d}/_SUCCESS"):
        se.build(search_pages(s, d), path, stemmed, by_term=False)
        atexit.register(remove, s, path)
    return se.load(s, path)


def _asked(s: SparkSession, d: str) -> DataFrame:
    """The first eight words of the titles of documents whose id is divisible by 50, a stated query set."""
    words = F.slice(se.terms(F.trim(F.substring_index("text", "\n", 1))), 1, 8)
    return table(s, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), words.alias("w")).where(F.size("w") > 0).select("qid", F.array_join("w", " ").alias("query"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id")
    out = docs.select("doc_id", F.explode(F.array(F.col("doc_id") * 3, F.col("doc_id") + 1)).alias("to"))
    return out.join(docs.select(F.col("doc_id").alias("to")), "to").select(_rel().alias("src"), _rel("to").alias("dst")).distinct()


def search_lexical(s, d):
    return se.search(_index(s, d, False), _asked(s, d)).select("qid", "rank", "path", "score")


def search_fused(s, d):
    """Lexical hits and the pages they link, fused."""
    return se.search(_index(s, d, False), _asked(s, d), edges=_edges(s, d)).select("qid", "rank", "path", "score", "fused_score")


def search_project(s, d):
    """The same with a project, whose pages weigh more before and after fusion."""
    return se.search(_index(s, d, False), _asked(s, d), edges=_edges(s, d), project="SRC1").select("qid", "rank", "path", "score", "fused_score")


def _cosines(s: SparkSession, d: str, first: int) -> DataFrame:
    """The ``first`` pages by the vectors of their ids for each query's, every pair compared by products of matrices; a query's own page isn't among them."""
    there = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"))
    v = table(s, d, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(_rel("vec_id").alias("qid"), F.col("embedding").alias("q"))
    rows = v.join(there, "vec_id", "left_semi").select(_rel("vec_id").alias("vec_id"), "embedding")
    number = F.regexp_extract("qid", r"(\d+)\.md$", 1).cast("long")
    return rt.dense_topk(rows, asked, first).select(number.alias("qid"), F.col("vec_id").alias("rel"), F.col("score").alias("cosine"))


def search_triple(s, d):
    """Lexical, dense and link lists fused."""
    limit = 10
    return se.search(_index(s, d, False), _asked(s, d), limit, edges=_edges(s, d), cosines=_cosines(s, d, 3 * limit)).select("qid", "rank", "path", "score", "fused_score")


def stale_pages(s, d):
    """Pages that are due for the archive: parts as types, orders' days as their last change."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("debugging", "gap", "pattern", "workflow", "concept")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    rows = table(s, d, "orders").select(
        F.col("o_orderkey").alias("rel"), kinds.alias("type"), F.when(F.col("o_orderstatus") == "F", "archived").alias("status"), F.lit(True).alias("has_fm"),
        F.col("o_orderdate").cast("timestamp").alias("modified"),
    )
    return pg.stale(rows, "1998-06-01 00:00:00").select("rel", "type")


def search_stemmed(s, d):
    """Stemmed search: no SQL has the stems; tests hold it against SQLite's full-text index."""
    return se.search(_index(s, d, True), _asked(s, d), edges=_edges(s, d)).select("qid", "rank", "path", "score", "fused_score")


def page_neighbours(s, d):
    """Whom each page links and who links it, counted."""
    out, into = se.neighbours(_edges(s, d))
    return out.join(into, "rel", "full").select("rel", F.array_join("out", " ").alias("out"), F.array_join("into", " ").alias("into"))


def most_connected(s, d):
    """The five pages of most links out: the number is the feature."""
    return graph.most_connected(_edges(s, d).unionByName(_edges(s, d).where("src < dst").select("dst", "src").toDF("src", "dst")).distinct())


def compile_gate(s, d):
    """Purchases late in the day that start a compile: not of days that the ledger, the what users of three o'clock left, has as they are."""
    rows = table(s, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "purchase", "major").otherwise("minor").alias("tier"),
        F.date_format("ts", "yyyy-MM-dd").alias("name"), F.col("user_id").cast("string").alias("hash"),
    )
    ledger = rows.where("hour(at) = 3").select("name", "hash")
    return tg.compile_gate(rows, ledger).select("id", "name")


_NAMES = ("raw", "search_pages")  # not queries
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k not in _NAMES}

_V = f"""b AS (SELECT d.doc_id, d.text AS body, lang, source, quality, toxic, l.doc_id IS NOT NULL AS has_fm, CASE WHEN quality = 0 THEN 'superseded' END AS status,
  CASE WHEN toxic = 0 THEN CASE lang WHEN 'en' THEN 'concept' WHEN 'fr' THEN 'gap' WHEN 'de' THEN 'pattern' ELSE 'memo' END END AS type, 'knowledge/notes/' || d.doc_id || '.md' AS rel
  FROM documents d LEFT JOIN labels l USING (doc_id)),
v AS (SELECT *, CASE WHEN has_fm THEN '---' || chr(10) || CASE WHEN type IS NULL THEN '' ELSE 'type: ' || type || chr(10) END
  || CASE WHEN quality = 0 THEN 'status: superseded' || chr(10) || 'superseded_by: [[' || doc_id * 2 || ']]' || chr(10) ELSE '' END
  || CASE WHEN lang = 'en' THEN 'valid_to: {ENDED}' || chr(10) ELSE '' END || 'project: ' || source || chr(10) || '---' || chr(10) ELSE '' END
  || coalesce(body, '') || chr(10) || 'See [[' || doc_id * 3 || ']] and [[' || doc_id + 1 || ']].' || chr(10) AS text FROM b),
k AS (SELECT DISTINCT doc_id, rel, has_fm, type, unnest(CASE WHEN quality = 0 THEN [doc_id * 3, doc_id + 1, doc_id * 2] ELSE [doc_id * 3, doc_id + 1] END) AS dst FROM v)"""
_CLAIMS = _in(fixed.CLAIM_TYPES)
_LINT = {
    "broken_wikilinks": "SELECT rel AS path, dst::VARCHAR AS target FROM k WHERE dst NOT IN (SELECT doc_id FROM documents)",
    "missing_backlinks": "SELECT rel AS path, 'knowledge/notes/' || dst || '.md' AS target FROM k WHERE dst <> doc_id AND dst IN (SELECT doc_id FROM documents) AND NOT EXISTS (SELECT 1 FROM k j WHERE j.doc_id = k.dst AND j.dst = k.doc_id)",
    "missing_frontmatter": "SELECT rel AS path FROM v WHERE NOT has_fm",
    "missing_required_type": "SELECT rel AS path FROM v WHERE has_fm AND type IS NULL",
    "invalid_type_value": "SELECT rel AS path FROM v WHERE type = 'memo'",
    "missing_sources_section": rf"SELECT rel AS path FROM v WHERE type IN {_CLAIMS} AND {_CW} >= 50 AND NOT regexp_matches(text, '(?m)^##[ \t]*(?:Source|Evidence|Provenance)')",
    "invalid_supersede_chain": "SELECT rel AS path, (doc_id * 2)::VARCHAR AS target FROM v WHERE quality = 0 AND doc_id * 2 NOT IN (SELECT doc_id FROM documents)",
    "orphan_gaps": "SELECT rel AS path FROM v WHERE type = 'gap' AND doc_id NOT IN (SELECT dst FROM k WHERE type IS NULL OR type <> 'gap')",
    "temporal_validity": "SELECT rel AS path FROM v WHERE has_fm AND lang = 'en' AND status IS NULL",
    "sparse_pages": f"SELECT rel AS path FROM v WHERE {_CW} < 200",
    "orphan_daily_logs": "SELECT rel AS path FROM v WHERE NOT has_fm",
    "stale_compiled": "SELECT rel AS path FROM v WHERE has_fm AND body <> ''",
}
_TOK = r"list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: strip_accents(x))"


def _search_sql(project: str | None = None, fused: bool = True, dense: bool = False) -> str:
    bonus = f"CASE WHEN source = '{project}' THEN 2.0 ELSE 1.0 END" if project else "1.0"
    vectors = "SELECT qid, doc_id, rel, 0 AS rank, 0.0 AS score FROM r WHERE false"
    if dense:
        named = _VEC.replace("q AS (", "vq AS (", 1).replace("FROM embeddings, q ", "FROM embeddings, vq ")
        vectors = f"""WITH {named}, vn AS (SELECT qid, vec_id AS doc_id, 'knowledge/notes/' || vec_id || '.md' AS rel, score FROM vs WHERE vec_id IN (SELECT doc_id FROM documents) AND qid IN (SELECT qid FROM q))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rel) AS rank FROM vn) WHERE rank <= 30"""
    sql = f"""WITH n AS (SELECT doc_id, 'knowledge/notes/' || doc_id || '.md' AS rel, source, {_TITLE} AS title, {_TOK.format('text')} || {_TOK.format(_TITLE)} AS w FROM documents),
t AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM n) GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM n),
df AS (SELECT t, count(*) AS df FROM t GROUP BY t),
a AS (SELECT doc_id AS qid, list_slice(regexp_extract_all(lower({_TITLE}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+'), 1, 8) AS w FROM documents WHERE doc_id % 50 = 0),
q AS (SELECT qid, unnest(list_transform(w, lambda x: strip_accents(x))) AS t FROM a),
need AS (SELECT qid, count(*) AS need FROM q GROUP BY qid),
sc AS (SELECT qid, doc_id, count(*) AS got, round(sum(greatest(ln((st.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(n.w) / mean))), 9) AS bm25
  FROM q JOIN t USING (t) JOIN df USING (t) JOIN n USING (doc_id), st GROUP BY 1, 2),
h AS (SELECT sc.*, rel, title, source, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, rel) AS place FROM sc JOIN need USING (qid) JOIN n USING (doc_id) WHERE got = need),
x AS (SELECT h.*, array_to_string(a.w, ' ') AS q, list_distinct(a.w) AS qw, list_distinct(list_filter(regexp_split_to_array(lower(trim(title)), '\\s+'), lambda x: x <> '')) AS tw FROM h JOIN a USING (qid) WHERE place <= 30),
l AS (SELECT qid, doc_id, rel, source, round(bm25 * {bonus} * CASE WHEN lower(trim(title)) = q THEN 5.0 WHEN list_has_all(tw, qw) THEN 3.0 WHEN len(tw) > 0 AND list_has_all(qw, tw) THEN 2.0 ELSE 1.0 END
  * CASE WHEN doc_id::VARCHAR = q THEN 10.0 WHEN list_has_all([doc_id::VARCHAR], qw) THEN 4.0 ELSE 1.0 END * 1.3::DOUBLE, 2) AS score, place FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, place) AS rank FROM l)"""
    if not fused:
        return sql + " SELECT qid, rank, rel AS path, score FROM r WHERE rank <= 10"
    last = "SELECT qid, rank, path, score, fused_score FROM o WHERE rank <= 10"
    if project:
        last = f""", p AS (SELECT o.*, CASE WHEN told = '{project}' THEN round(fused_score * 1.5, 4) ELSE fused_score END AS f FROM o)
SELECT qid, rank, path, score, f AS fused_score FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY f DESC, rank) AS rank FROM p) WHERE rank <= 10"""
    return sql + f""", e AS (SELECT DISTINCT doc_id, dst FROM (SELECT doc_id, unnest([doc_id * 3, doc_id + 1]) AS dst FROM documents) WHERE dst IN (SELECT doc_id FROM documents)),
ep AS (SELECT doc_id, 'knowledge/notes/' || dst || '.md' AS rel, row_number() OVER (PARTITION BY doc_id ORDER BY 'knowledge/notes/' || dst || '.md') - 1 AS place FROM e),
vv AS ({vectors}),
sd AS (SELECT qid, doc_id, rank FROM r UNION ALL SELECT qid, doc_id, rank FROM vv),
g AS (SELECT qid, ep.rel, round(sum(0.15::DOUBLE / (1 + ep.place * 0.2::DOUBLE)), 12) AS raw FROM sd JOIN ep USING (doc_id) WHERE rank <= 10 GROUP BY 1, 2),
gr AS (SELECT qid, rel, round(raw, 4) AS boost, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, rel) AS rank FROM g),
pt AS (SELECT qid, rel, 2.0::DOUBLE / (60 + rank) AS part, 0 AS list, rank FROM r UNION ALL SELECT qid, rel, 1.0::DOUBLE / (60 + rank), 1, rank FROM vv UNION ALL SELECT qid, rel, 0.5::DOUBLE * boost / (120 + rank), 2, rank FROM gr),
gate AS (SELECT qid FROM gr UNION SELECT qid FROM vv),
f AS (SELECT qid, rel, round(sum(part), 12) AS fused, min(list * 1000000 + rank) AS first FROM pt WHERE qid IN (SELECT qid FROM gate) GROUP BY 1, 2),
o AS (SELECT f.qid, row_number() OVER (PARTITION BY f.qid ORDER BY fused DESC, first) AS rank, f.rel AS path, coalesce(r.score, vv.score, 0.0)::DOUBLE AS score, round(fused, 4) AS fused_score, coalesce(r.source, '') AS told
  FROM f LEFT JOIN r ON r.qid = f.qid AND r.rel = f.rel LEFT JOIN vv ON vv.qid = f.qid AND vv.rel = f.rel
  UNION ALL SELECT qid, rank, rel, score, NULL, '' FROM r WHERE qid NOT IN (SELECT qid FROM gate))
{last}"""


_OWN = "FROM documents LEFT JOIN labels USING (doc_id)"
ORACLE_SQL = {
    "lint_broken_wikilinks": f"WITH {_V} {_LINT['broken_wikilinks']}", "lint_page_backlinks": f"WITH {_V} {_LINT['missing_backlinks']}",
    "lint_frontmatter": f"WITH {_V} {_LINT['missing_frontmatter']}", "lint_required_type": f"WITH {_V} {_LINT['missing_required_type']}", "lint_type_value": f"WITH {_V} {_LINT['invalid_type_value']}",
    "lint_sources": f"WITH {_V} {_LINT['missing_sources_section']}", "lint_supersede": f"WITH {_V} {_LINT['invalid_supersede_chain']}", "lint_gaps": f"WITH {_V} {_LINT['orphan_gaps']}",
    "lint_validity": f"WITH {_V} {_LINT['temporal_validity']}",
    "lint_untracked_links": f"""WITH {_V} SELECT rel AS path, dst::VARCHAR AS target, CASE WHEN dst IN (SELECT doc_id FROM documents) THEN 'untracked/gitignored target' ELSE '' END AS detail
FROM k WHERE has_fm AND dst NOT IN (SELECT doc_id FROM labels)""",
    "lint_orphan_pages": r"""WITH p AS (SELECT regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages), i AS (SELECT html FROM pages ORDER BY page_id LIMIT 1)
SELECT DISTINCT path || '.md' AS path FROM (SELECT path, list_last(string_split(path, '/')) AS stem, html FROM p, i) WHERE NOT contains(html, stem) AND NOT contains(html, path)""",
    "lint_counts": f"WITH {_V} " + " UNION ALL ".join(f"SELECT '{c}' AS category, (SELECT count(*) FROM (SELECT DISTINCT * FROM ({q}))) AS n" for c, q in _LINT.items()),
    "migrate_status": f"WITH {_V} SELECT CASE WHEN has_fm AND type IS NOT NULL THEN 'skip_already_okf' ELSE 'migrate' END AS status, count(*) AS n FROM v GROUP BY 1",
    "supersede_marked": f"""WITH {_V} SELECT rel, sha256(CASE WHEN quality = 1 THEN '---' || chr(10) || 'status: superseded' || chr(10) || 'superseded_by: [[' || doc_id || ']]' || chr(10) || substr(text, 5) ELSE text END) AS text_sha256 FROM v""",
    "archive_days": """WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, max(hour(ts)) AS latest FROM events GROUP BY ALL)
SELECT 'knowledge/daily/' || day || '-' || user_id || '.md' AS rel, 'knowledge/daily/archive/' || substr(day, 1, 7) || '/' || day || '-' || user_id || '.md' AS to FROM g WHERE day < '2024-01-26' AND latest < 20""",
    "old_page_count": "SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate::TIMESTAMP < TIMESTAMP '1998-06-01' - INTERVAL 90 DAY",
    "project_rows": "SELECT doc_id, source = 'src1' AND source <> 'src3' AS strict, true AS tolerant FROM documents WHERE source IN ('src1', 'src3')",
    "editorial_names": "SELECT n_nationkey FROM nation WHERE n_name NOT IN ('NATION_3', 'NATION_7')",
    "prompts": "SELECT conv_id, turn, sha256(substr(trim(text), 1, 140)) AS preview_sha256 FROM conversations WHERE role = 'user' AND length(trim(text)) >= 5",
    "safe_slugs": f"""SELECT doc_id, CASE lang WHEN 'en' THEN 'concepts' WHEN 'fr' THEN NULL WHEN 'de' THEN 'patterns' ELSE 'qa' END AS category,
nullif(regexp_replace(regexp_replace(lower(coalesce({_TITLE}, '')), '[^a-z0-9-]', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug FROM documents""",
    "yaml_titles": r"""SELECT doc_id, sha256(translate(replace(replace(coalesce(text, ''), '\', '\\'), '"', '\"'), chr(10) || chr(13), '  ')) AS yaml_sha256 FROM documents""",
    "latest_day": "SELECT strftime(ts, '%Y-%m-%d') AS name, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 1",
    "first_lists": """WITH l AS (SELECT s_nationkey AS nation, 0 AS list, min(s_suppkey) AS place FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, 1, min(c_custkey) FROM customer GROUP BY 1)
SELECT nation, list, place FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY list, place) AS k FROM l) WHERE k = 1""",
    "search_lexical": _search_sql(fused=False), "search_fused": _search_sql(), "search_project": _search_sql("src1"), "search_triple": _search_sql(dense=True),
    "stale_pages": """SELECT o_orderkey AS rel, type FROM (SELECT *, ['debugging', 'gap', 'pattern', 'workflow', 'concept'][substr(o_orderpriority, 1, 1)::INT] AS type FROM orders)
WHERE o_orderstatus <> 'F' AND type <> 'concept' AND o_orderdate::TIMESTAMP < TIMESTAMP '1998-06-01' - to_days(CASE type WHEN 'debugging' THEN 60 WHEN 'gap' THEN 90 WHEN 'pattern' THEN 180 ELSE 365 END)""",
    "most_connected": """WITH e AS (SELECT DISTINCT 'knowledge/notes/' || doc_id || '.md' AS src, 'knowledge/notes/' || dst || '.md' AS dst FROM (SELECT doc_id, unnest([doc_id * 3, doc_id + 1]) AS dst FROM documents) WHERE dst IN (SELECT doc_id FROM documents)),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e WHERE src < dst) SELECT src, count(*) AS out_degree FROM b GROUP BY src ORDER BY out_degree DESC, src LIMIT 5""",
    "compile_gate": """WITH RECURSIVE x AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS name, user_id, event_type FROM events),
e AS MATERIALIZED (SELECT event_id AS id, name, epoch(ts) AS tm, row_number() OVER (ORDER BY ts, event_id) AS k FROM x WHERE event_type = 'purchase' AND hour(ts) >= 18 AND NOT EXISTS (SELECT 1 FROM x l WHERE hour(l.ts) = 3 AND l.name = x.name AND l.user_id = x.user_id)),
r AS (SELECT id, name, k, tm AS last, true AS kept FROM e WHERE k = 1 UNION ALL SELECT e.id, e.name, e.k, CASE WHEN e.tm - r.last >= 900 THEN e.tm ELSE r.last END, e.tm - r.last >= 900 FROM r JOIN e ON e.k = r.k + 1)
SELECT id, name FROM r WHERE kept""",
    "page_neighbours": """WITH e AS (SELECT DISTINCT 'knowledge/notes/' || doc_id || '.md' AS src, 'knowledge/notes/' || dst || '.md' AS dst FROM (SELECT doc_id, unnest([doc_id * 3, doc_id + 1]) AS dst FROM documents) WHERE dst IN (SELECT doc_id FROM documents)),
o AS (SELECT src AS rel, string_agg(dst, ' ' ORDER BY dst) AS out FROM e GROUP BY 1), i AS (SELECT dst AS rel, string_agg(src, ' ' ORDER BY src) AS into FROM e GROUP BY 1)
SELECT coalesce(o.rel, i.rel) AS rel, o.out, i.into FROM o FULL JOIN i ON o.rel = i.rel""",
}
