"""Ranked retrieval: BM25, dense, link signals, fusion, evaluation. Batched over all queries in one job."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.arrays import flat, slices
from mnemora.functions.text import tokens
from mnemora.sources.scratch import keep

K1, B, IDF_FLOOR, RRF_K = 1.2, 0.75, 1e-6, 60
#: Query terms are broadcast up to this many rows; beyond, the planner joins by shuffle.
BROADCAST_ROWS = 500_000
#: Distinct query terms that are sent to the scan as a list.
LISTED = 2000
#: Vectors of a side of a block of pairs, and queries that are compared at once.
SIDE, AT_ONCE = 16_384, 256
DIGITS = 4  # of a cosine


def _small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def first_terms(text: Column, m: int, least: int = 4) -> Column:
    """The first ``m`` distinct tokens of at least ``least`` characters."""
    return F.slice(F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= least)), 1, m)


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl) of each row of ``docs``, counted within the row."""
    rows = docs.select("doc_id", tokens(F.col("text")).alias("ts")).where("ts IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, [1]):
                row, _, words = flat(few.column(1))
                if not len(row):
                    continue
                coded = words.dictionary_encode()
                width, sizes = len(coded.dictionary), np.bincount(row, minlength=few.num_rows)
                pair, tf = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
                page = pair // width
                yield pa.RecordBatch.from_arrays(
                    [few.column(0).take(pa.array(page)), coded.dictionary.take(pa.array(pair % width)), pa.array(tf.astype(np.int64)), pa.array(sizes[page].astype(np.int64))],
                    ["doc_id", "term", "tf", "dl"],
                )

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, tf long, dl long")


def _once(counted: DataFrame) -> DataFrame:
    """Rows of a repeated doc_id and length add up."""
    return counted.groupBy("doc_id", "term", "dl").agg(F.sum("tf").alias("tf"))


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, dl, tf), counted before the shuffle."""
    return _once(_counted(docs))


def sorted_postings(docs: DataFrame) -> DataFrame:
    """``postings`` as they are stored: by term, so that a search reads the row groups of its terms alone. The one shuffle is that of the order."""
    return _once(_counted(docs).repartitionByRange("term", "doc_id")).sortWithinPartitions("term", "doc_id")


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def bm25(index: DataFrame, stats: DataFrame, queries: DataFrame, require_all: bool = True) -> DataFrame:
    """(qid, doc_id, n_terms, score) for ``queries`` (qid, terms) over stored ``postings`` and one row of ``corpus_stats``.

    Up to ``LISTED`` distinct terms are sent to the scan as a list, so that it
    skips the rest of the index; more are joined.
    """
    wanted = queries.select("qid", F.size("terms").alias("need"), F.explode("terms").alias("term"))
    terms = [r[0] for r in wanted.select("term").distinct().limit(LISTED + 1).collect()]
    post = index.where(F.col("term").isin(terms)) if len(terms) <= LISTED else index.join(_small(wanted.select("term").distinct()), "term", "left_semi")
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, df_, tf, dl = F.col("n_docs"), F.col("df"), F.col("tf"), F.col("dl")
    idf = F.greatest(F.log((n - df_ + 0.5) / (df_ + 0.5)), F.lit(IDF_FLOOR))
    weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    asked = wanted.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    scored = post.join(F.broadcast(asked) if small else asked, "term")
    scored = scored.groupBy("qid", "doc_id", "need").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum(weight), 6).alias("score"))
    return (scored.where("n_terms = need") if require_all else scored).select("qid", "doc_id", "n_terms", "score")


def ranked(hits: DataFrame, k: int, score: str = "score", key: str = "qid", item: str = "doc_id") -> DataFrame:
    """The first ``k`` of each query, ties by the item."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.col(item))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + 1e-10
    return F.round(dot / (norm(a) * norm(b)), DIGITS)


def _matrix(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``vectors`` have ``dim`` numbers, and those, as doubles."""
    there = np.array([v is not None and len(v) == dim for v in vectors], bool)
    found = [np.asarray(v, np.float64) for v, t in zip(vectors, there, strict=True) if t]
    return np.flatnonzero(there), np.stack(found) if found else np.zeros((0, dim))


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of rows, added from the first number to the last as ``cosine`` does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out = out + a[:, i] * b[:, i]
    return out


def _rounded(s: np.ndarray, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines ``s`` of the rows of ``x`` and ``q`` as ``cosine`` rounds them: those too near to a half are computed anew as it does."""
    scaled = s * 10**DIGITS
    out = np.rint(scaled) / 10**DIGITS + 0.0
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    if len(near):
        a, b = x[near], q[near]
        exact = _in_order(a, b) / ((np.sqrt(_in_order(a, a)) + 1e-10) * (np.sqrt(_in_order(b, b)) + 1e-10))
        out[near] = [float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP)) for v in exact]
    return out


def _nearest(left: pd.DataFrame, right: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The first ``k`` rows of ``left`` (vec_id, embedding) for each of ``right`` (qid, q); pairs that have no cosine come last with a null."""
    left = left.sort_values("vec_id", kind="stable")
    ids, dims = left["vec_id"].to_numpy(), [0 if q is None else len(q) for q in right["q"]]
    for dim in sorted(set(dims)):
        few = right[np.array(dims) == dim]
        asks, q = _matrix(few["q"], dim) if dim else (np.zeros(0, int), np.zeros((0, 0)))
        rows, x = _matrix(left["embedding"], dim) if len(asks) else (np.zeros(0, int), np.zeros((0, dim)))
        names, qids = ids[rows], few["qid"].to_numpy()
        unit = lambda m: m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + 1e-10)
        ux, uq = unit(x), unit(q)
        for at in range(0, len(asks) if len(rows) else 0, AT_ONCE):
            own = qids[asks[at : at + AT_ONCE]]
            s = uq[at : at + AT_ONCE] @ ux.T
            s[np.isnan(s)] = np.inf  # Spark's order: no number is the greatest
            s[own[:, None] == names[None, :]] = -np.inf
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
            ask, row = np.nonzero(s >= np.maximum(least, -2.0)[:, None] - 1.1 * 10.0**-DIGITS)
            score = s[ask, row]
            told = np.isfinite(score)
            score[told] = _rounded(score[told], x[row[told]], q[at + ask[told]])
            order = np.lexsort((row, -score, ask))
            ask, row, score = ask[order], row[order], score[order]
            first = np.arange(len(ask)) - np.searchsorted(ask, ask) < k
            score = np.where(np.isinf(score), np.nan, score)[first]
            yield pd.DataFrame({"qid": own[ask[first]], "vec_id": names[row[first]], "score": score, "known": True})
        none = np.setdiff1d(np.arange(len(left)), rows)
        bare = np.setdiff1d(np.arange(len(few)), asks)
        for at, places in ((asks, none if len(rows) <= k else none[:0]), (bare, np.arange(len(left)))):
            for qid in qids[at] if len(places) else ():
                others = ids[places][ids[places] != qid][:k]
                yield pd.DataFrame({"qid": np.repeat(qid, len(others)), "vec_id": others, "score": np.nan, "known": False})


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, score, rank): query vectors (qid, q) against all rows (vec_id, embedding), every pair of them.

    Rows and queries are dealt over a grid of blocks of some ``SIDE`` by ``SIDE``
    pairs, each a product of matrices, of which the first ``k`` a query are left.
    Scores are those of ``cosine``.
    """
    blocks = lambda df: max(1, -(-df.count() // SIDE))
    n, m = blocks(vectors), blocks(queries)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    whole = lambda v: F.when(~F.exists(v, lambda x: x.isNull()), F.col(v)).alias(v)  # noqa: E731  pandas knows no null numbers
    rows = vectors.where("vec_id IS NOT NULL").select("vec_id", whole("embedding"), part("vec_id", n).alias("row"), every(m).alias("turn"))
    asked = queries.where("qid IS NOT NULL").select("qid", whole("q"), part("qid", m).alias("turn"), every(n).alias("row"))
    types = {f.name: f.dataType.simpleString() for f in [*rows.schema.fields, *asked.schema.fields]}
    schema = f"qid {types['qid']}, vec_id {types['vec_id']}, score double, known boolean"

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(_nearest(left, right, k)) if len(left) and len(right) else []
        return pd.concat(found) if found else pd.DataFrame({"qid": [], "vec_id": [], "score": [], "known": []})

    met = rows.groupBy("row", "turn").cogroup(asked.groupBy("row", "turn")).applyInPandas(best, schema)
    score = F.when(F.col("known"), F.coalesce("score", F.lit(float("nan")))).alias("score")
    return ranked(met.select("qid", "vec_id", score), k, item="vec_id")


def boost_ladder(title: Column, query: Column, in_words: Column, q_words: Column) -> Column:
    """x5 for an equal title, x3 if it holds all query words, x2 if the query holds all of its."""
    return (
        F.when(title == query, 5.0).when(F.size(F.array_except(q_words, in_words)) == 0, 3.0)
        .when((F.size(in_words) > 0) & (F.size(F.array_except(in_words, q_words)) == 0), 2.0).otherwise(1.0)
    )


def title_boosts(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id, boost) of all titles (doc_id, t) that ``boost_ladder`` raises for a query (qid, q).

    One set of words holds the other only if it has the other's rarest word, so
    distinct titles and queries meet on that word, either way round, and are
    compared in full. Ids are joined last.
    """
    words = lambda c: F.array_distinct(F.split(c, " "))
    name = lambda c: F.unhex(F.md5(c))
    titles = docs.where("t IS NOT NULL").select("t").distinct().select(name("t").alias("th"), "t", words("t").alias("words"))
    asked = queries.where("q IS NOT NULL").select("q").distinct().select(name("q").alias("qh"), "q", words("q").alias("q_words"))
    titles, asked = keep(titles, "titles"), keep(asked, "asked")
    df = titles.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def each(rows: DataFrame, key: str, of: str) -> tuple[DataFrame, DataFrame]:
        all_ = rows.select(key, F.explode(of).alias("word"))
        rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))
        return all_, all_.join(df, "word", "left").groupBy(key).agg(rarest.alias("r")).select(key, F.col("r.word").alias("word"))

    (title_words, title_rare), (query_words, query_rare) = each(titles, "th", "words"), each(asked, "qh", "q_words")
    near = query_rare.join(title_words, "word").unionByName(title_rare.join(query_words, "word")).select("qh", "th").distinct()
    met = near.join(asked, "qh").join(titles, "th")
    met = met.select("qh", "th", boost_ladder(F.col("t"), F.col("q"), F.col("words"), F.col("q_words")).alias("boost")).where("boost > 1")
    met = met.join(queries.select("qid", name("q").alias("qh")), "qh")
    return met.join(docs.where("t IS NOT NULL").select("doc_id", name("t").alias("th")), "th").select("qid", "doc_id", "boost")


def rrf(lists: list[tuple[DataFrame, float, float, Column | None]], item: str) -> DataFrame:
    """(qid, item, fused): the sum of weight * factor / (k + rank) over the lists, in one aggregation."""
    parts = None
    for df, weight, k, factor in lists:
        part = df.select("qid", item, (F.lit(weight) * (F.lit(1.0) if factor is None else factor) / (k + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("qid", item).agg(F.round(F.sum("part"), 6).alias("fused"))


def first_gold_rank(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, rank or null) for every query of ``gold``."""
    found = hits.join(gold, ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    return gold.select("qid").distinct().join(found, "qid", "left")


def recall_mrr(ranks: DataFrame) -> DataFrame:
    at = [F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 4).alias(f"recall_at_{k}") for k in (1, 3, 5, 10)]
    return ranks.agg(F.count(F.lit(1)).alias("n_queries"), *at, F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))
