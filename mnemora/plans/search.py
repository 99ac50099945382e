"""Queries of retrieval, graph, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.operators import dense, graph, quotes, retrieval as rt
from mnemora.sources.scratch import keep, shared
from mnemora.sources.tables import table

TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def _queries(spark: SparkSession, sf: str, m: int) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), rt.first_terms(F.col("text"), m).alias("terms")).where(F.size("terms") > 0)


def index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The stored postings of the documents and their totals; the first query of a session builds them."""
    source, docs = f"{sf}/documents.parquet", table(spark, sf, "documents")
    made = shared(spark, source, "postings", lambda: rt.sorted_postings(docs))
    return made, shared(spark, source, "totals", lambda: rt.corpus_stats(docs))


def known_item(spark: SparkSession, sf: str, m: int = 4, k: int = 10) -> DataFrame:
    return rt.ranked(rt.bm25(*index(spark, sf), _queries(spark, sf, m)), k).select("qid", "doc_id", "score", "rank")


def _bm25_sql(m: int, gate: bool = True) -> str:
    d, b = TOK.format("text"), TOK.format("text")
    return f"""
bt AS (SELECT item_id AS qid, t, min(i) AS i FROM (SELECT item_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM (SELECT item_id, {b} AS w FROM benchmark)) WHERE length(t) >= 4 GROUP BY 1, 2),
q AS (SELECT qid, t FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY i) AS k FROM bt) WHERE k <= {m}),
need AS (SELECT qid, count(*) AS need FROM q GROUP BY qid),
dt AS (SELECT doc_id, {d} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM dt),
tf AS (SELECT doc_id, t, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM dt) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
sc AS (SELECT qid, doc_id, count(*) AS n_terms, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN tf USING (t) JOIN df USING (t), st GROUP BY 1, 2),
hit AS (SELECT sc.* FROM sc JOIN need USING (qid) WHERE {'n_terms = need' if gate else 'true'}),
rk AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM hit)"""


def bm25_and_semantics(spark: SparkSession, sf: str) -> DataFrame:
    both = rt.bm25(*index(spark, sf), _queries(spark, sf, 2), require_all=False)
    return both.groupBy("qid").agg(F.count(F.lit(1)).alias("n_any"), F.count_if(F.col("n_terms") == 2).alias("n_all"))


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", F.trim(F.substring_index("text", "\n", 1)).alias("title"))


def title_boost(spark: SparkSession, sf: str) -> DataFrame:
    """The title ladder for the titles of documents whose id is divisible by 50, a stated query set, against all titles."""
    docs = _titled(spark, sf).select("doc_id", F.lower("title").alias("t"))
    return rt.title_boosts(docs, docs.where("doc_id % 50 = 0 AND t <> ''").select(F.col("doc_id").alias("qid"), F.col("t").alias("q")))


def authority_rank(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, 1.35).otherwise(0.8).alias("w"))
    hits = rt.bm25(*index(spark, sf), _queries(spark, sf, 2)).join(labels, "doc_id", "left")
    hits = hits.withColumn("score", F.round(F.col("score") * F.coalesce("w", F.lit(1.0)), 4))
    return rt.ranked(hits, 5).select("qid", "doc_id", "score", "rank")


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def dense_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """vector_topk from an index in cells, as many read as nine answers of ten and more need."""
    vectors = table(spark, sf, "embeddings")
    centroids = dense.fit(vectors, dense.cells_for(vectors.count()))
    index = keep(dense.build(vectors, centroids), "dense")
    asked = _vector_queries(spark, sf)
    return dense.search(index, asked, centroids, 10, dense.probes_for(index, asked, centroids, 10, 0.95))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rt.dense_topk(table(spark, sf, "embeddings"), _vector_queries(spark, sf), 10)


_VEC = """
q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
vs AS (SELECT qid, vec_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda x: x[1] * x[2])) /
  ((sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) + 1e-10) * (sqrt(list_sum(list_transform(q, lambda x: x * x))) + 1e-10)), 4) AS score
  FROM embeddings, q WHERE vec_id <> qid),
vk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM vs)"""


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Dense ranks fused with a label list and a boost list."""
    v = table(spark, sf, "embeddings")
    qs = _vector_queries(spark, sf)
    dense = rt.dense_topk(v, qs, 30)
    label = v.select(F.col("vec_id").alias("qid"), F.col("label").alias("q_label"))
    # of a label only the first ids count: one more than wanted, as a query leaves out its own
    place = F.dense_rank().over(Window.partitionBy("label").orderBy("vec_id"))
    first = v.where("label IS NOT NULL AND vec_id IS NOT NULL").select("label", "vec_id", place.alias("place")).where("place <= 31")
    same = first.join(qs.join(label, "qid").select("qid", "q_label"), F.col("label") == F.col("q_label")).where("vec_id <> qid")
    near = rt.ranked(same.select("qid", "vec_id", (-F.col("vec_id")).alias("score")), 30, item="vec_id")
    boost = near.withColumn("boost", F.round(0.15 / (1 + 0.2 * (F.col("rank") - 1)), 4))
    fused = rt.rrf([(near, 2.0, rt.RRF_K, None), (dense, 1.0, rt.RRF_K, None), (boost, 0.5, 2 * rt.RRF_K, F.col("boost"))], "vec_id")
    return rt.ranked(fused, 10, score="fused", item="vec_id")


def link_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.href_edges(table(spark, sf, "pages"))


_EDGES = """e AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) AS src, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS dst FROM pages)"""


def in_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return link_edges(spark, sf).groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))


def graph_boost(spark: SparkSession, sf: str) -> DataFrame:
    edges = link_edges(spark, sf)
    seeds = table(spark, sf, "pages").where("page_id % 50 = 0").select(F.regexp_extract("url", r"^https?://[^/]+(/.*)?$", 1).alias("src"))
    return graph.neighbour_boost(edges, seeds)


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, doc_id) where the document holds the whole passage: evidence found by its hash, then verified."""
    return evidence(spark, sf).select("qid", "doc_id")


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted passages found in documents, white space collapsed, whatever their length."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote"))
    return quotes.holding(table(spark, sf, "documents"), asked)


def evidence_short(spark: SparkSession, sf: str) -> DataFrame:
    """The same with pieces of passages, from parts of a word to several words with cut ends."""
    piece = F.substring("text", F.lit(4) + F.col("item_id") % 5, F.lit(5) + F.col("item_id") % 36)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), piece.alias("quote"))
    return quotes.holding(table(spark, sf, "documents"), asked)


def _evidence_sql(quote: str) -> str:
    return rf"""ev AS (SELECT item_id AS qid, doc_id FROM
  (SELECT item_id, trim(regexp_replace({quote}, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS q FROM benchmark) b JOIN
  (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents) d ON contains(t, q) WHERE q <> '')"""


_EVIDENCE = _evidence_sql("text")


def evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    n = evidence(spark, sf).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return items.join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n_verified"), (F.coalesce("n", F.lit(0)) > 0).alias("passes"))


def eval_recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return rt.recall_mrr(rt.first_gold_rank(known_item(spark, sf), _gold(spark, sf)))


def eval_by_query_type(spark: SparkSession, sf: str) -> DataFrame:
    """Per type of query (long and short passages): how many, how often the gold document is found, its mean rank when found."""
    kind = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.length("text") >= 200, "long").otherwise("short").alias("query_type"))
    ranks = rt.first_gold_rank(known_item(spark, sf), _gold(spark, sf)).join(kind, "qid")
    return ranks.groupBy("query_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 4).alias("found_rate"), F.round(F.avg("rank"), 4).alias("mean_rank")
    )


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.round(F.percentile("value", 0.5), 4).alias("p50"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)"), 4).alias("p95"), F.round(F.avg("value"), 4).alias("mean")
    )


def postings_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The index: document frequency and occurrences per term."""
    return index(spark, sf)[0].groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


def known_item_queries(spark: SparkSession, sf: str) -> DataFrame:
    docs = _titled(spark, sf).where(F.length("title") > 0)
    exact = docs.select("doc_id", F.lower("title").alias("query"), F.lit("exact_title").alias("query_type"))
    words = F.slice(F.filter(F.split(F.lower("title"), r"[^a-z]+"), lambda w: F.length(w) >= 4), 1, 4)
    keys = docs.select("doc_id", words.alias("w")).where(F.size("w") >= 2).select("doc_id", F.array_join("w", " ").alias("query"), F.lit("keywords").alias("query_type"))
    return exact.unionByName(keys)


QUERIES = {
    "bm25_known_item": known_item, "bm25_and_semantics": bm25_and_semantics, "title_boost": title_boost, "authority_weighted_rank": authority_rank,
    "vector_topk": vector_topk, "dense_index_topk": dense_index_topk, "rrf_fusion_triple": rrf_fusion, "link_edges": link_edges,
    "link_degree": lambda s, d: graph.degrees(link_edges(s, d)), "graph_stats": lambda s, d: graph.graph_stats(link_edges(s, d)),
    "in_neighbors": in_neighbors, "graph_boost": graph_boost, "evidence_verify": evidence, "evidence_short": evidence_short, "evidence_gate": evidence_gate,
    "eval_recall_mrr": eval_recall_mrr, "eval_by_query_type": eval_by_query_type, "latency_percentiles": latency_percentiles, "postings_stats": postings_stats, "known_item_queries": known_item_queries,
}

_TITLE = "trim(CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END)"
ORACLE_SQL = {
    "bm25_known_item": f"WITH {_bm25_sql(4)} SELECT * FROM rk WHERE rank <= 10",
    "bm25_and_semantics": f"WITH {_bm25_sql(2, gate=False)} SELECT qid, count(*) AS n_any, count(*) FILTER (n_terms = 2) AS n_all FROM hit GROUP BY qid",
    "title_boost": f"""WITH d AS (SELECT doc_id, lower({_TITLE}) AS t FROM documents), q AS (SELECT doc_id AS qid, t AS q FROM d WHERE doc_id % 50 = 0 AND t <> ''),
w AS (SELECT qid, doc_id, t, q, list_distinct(string_split(t, ' ')) AS a, list_distinct(string_split(q, ' ')) AS b FROM d, q)
SELECT * FROM (SELECT qid, doc_id, CASE WHEN t = q THEN 5.0 WHEN list_has_all(a, b) THEN 3.0 WHEN list_has_all(b, a) THEN 2.0 ELSE 1.0 END::DOUBLE AS boost FROM w) WHERE boost > 1""",
    "authority_weighted_rank": f"""WITH {_bm25_sql(2)}, aw AS (SELECT qid, hit.doc_id, round(score * coalesce(CASE WHEN quality = 1 THEN 1.35 WHEN quality IS NOT NULL THEN 0.8 END, 1.0)::DOUBLE, 4) AS score
FROM hit LEFT JOIN labels USING (doc_id)) SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM aw) WHERE rank <= 5""",
    "vector_topk": f"WITH {_VEC} SELECT qid, vec_id, score, rank FROM vk WHERE rank <= 10",
    "rrf_fusion_triple": f"""WITH {_VEC}, dn AS (SELECT qid, vec_id, rank FROM vk WHERE rank <= 30),
nr AS (SELECT * FROM (SELECT a.vec_id AS qid, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 30),
p AS (SELECT qid, vec_id, 2.0::DOUBLE / (60 + rank) AS p FROM nr UNION ALL SELECT qid, vec_id, 1.0::DOUBLE / (60 + rank) FROM dn
  UNION ALL SELECT qid, vec_id, 0.5::DOUBLE * round(0.15::DOUBLE / (1 + 0.2::DOUBLE * (rank - 1)), 4) / (120 + rank) FROM nr),
f AS (SELECT qid, vec_id, round(sum(p), 6) AS fused FROM p GROUP BY 1, 2)
SELECT * FROM (SELECT qid, vec_id, fused, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, vec_id) AS rank FROM f) WHERE rank <= 10""",
    "link_edges": f"WITH {_EDGES} SELECT src, dst FROM e",
    "link_degree": f"WITH {_EDGES} SELECT src, count(*) AS out_degree FROM e GROUP BY src",
    "graph_stats": f"WITH {_EDGES}, g AS (SELECT src, count(*) AS n FROM e GROUP BY src) SELECT count(*) AS n_sources, sum(n)::BIGINT AS n_edges, round(avg(n), 4) AS mean_degree FROM g",
    "in_neighbors": f"WITH {_EDGES} SELECT dst, count(*) AS in_degree FROM e GROUP BY dst",
    "graph_boost": f"""WITH {_EDGES}, p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos FROM e
WHERE src IN (SELECT regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) FROM pages WHERE page_id % 50 = 0)) SELECT dst, round(sum(0.15::DOUBLE / (1 + 0.2::DOUBLE * pos)), 4) AS boost FROM p GROUP BY dst""",
    "evidence_verify": f"WITH {_EVIDENCE} SELECT qid, doc_id FROM ev",
    "evidence_short": f"WITH {_evidence_sql('substr(text, 4 + (item_id % 5)::INT, 5 + (item_id % 36)::INT)')} SELECT DISTINCT qid, doc_id FROM ev",
    "evidence_gate": f"WITH {_EVIDENCE} SELECT item_id AS qid, count(doc_id) AS n_verified, count(doc_id) > 0 AS passes FROM benchmark LEFT JOIN ev ON qid = item_id GROUP BY item_id",
    "eval_recall_mrr": f"""WITH {_bm25_sql(4)}, {_EVIDENCE}, r AS (SELECT ev.qid, min(rank) AS rank FROM ev LEFT JOIN rk ON rk.qid = ev.qid AND rk.doc_id = ev.doc_id AND rank <= 10 GROUP BY ev.qid)
SELECT count(*) AS n_queries, {', '.join(f'round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS recall_at_{k}' for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0::DOUBLE / rank, 0.0)), 4) AS mrr FROM r""",
    "eval_by_query_type": f"""WITH {_bm25_sql(4)}, {_EVIDENCE}, r AS (SELECT ev.qid, min(rank) AS rank FROM ev LEFT JOIN rk ON rk.qid = ev.qid AND rk.doc_id = ev.doc_id AND rank <= 10 GROUP BY ev.qid)
SELECT CASE WHEN length(text) >= 200 THEN 'long' ELSE 'short' END AS query_type, count(*) AS n, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE), 4) AS found_rate, round(avg(rank), 4) AS mean_rank
FROM r JOIN benchmark ON item_id = qid GROUP BY 1""",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_disc(value, 0.95), 4) AS p95, round(avg(value), 4) AS mean FROM events GROUP BY event_type",
    "postings_stats": f"""SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY term""",
    "known_item_queries": f"""WITH d AS (SELECT doc_id, lower({_TITLE}) AS t FROM documents), w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[^a-z]+'), lambda x: length(x) >= 4)[1:4] AS w FROM d WHERE t <> '')
SELECT doc_id, t AS query, 'exact_title' AS query_type FROM d WHERE t <> '' UNION ALL SELECT doc_id, array_to_string(w, ' '), 'keywords' FROM w WHERE len(w) >= 2""",
}
