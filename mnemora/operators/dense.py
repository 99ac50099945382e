"""Dense search over an index in cells: every vector is in the cell of its nearest centroid, a query reads the cells nearest to it.

Centroids are fitted on a bounded sample; all rows are indexed. How many cells
a query reads follows from the recall asked for, measured against reading all
of them, which is the exact search. Cells and the queries that meet there are
dealt over parts of ``PART`` rows at most on average, so neither a hot cell nor
a popular one is a single task. Vectors that are null, zero, hold a null or have
another length than the centroids have no direction, rows without an id no
name: they answer nothing and ask nothing. Repeated ids are answered once, with their best score; ties go to
the least id; an empty table has no answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.operators.retrieval import ranked
from mnemora.sources.scratch import keep

#: Rows that centroids are fitted on at most, rows of a part, bytes of centroids that go to every task.
FIT_ROWS, PART, CENTROID_BYTES = 20_000, 4096, 64 << 20
ASKED = 256  # queries at most that recall is measured with
DIGITS = 4  # of a cosine, as in retrieval.cosine


def cells_for(rows: int, most: int = 4096) -> int:
    """The square root of the rows, so a cell and the list of cells grow alike, up to what a task should hold."""
    return max(1, min(most, round(rows**0.5)))


def _valid(vector: str, dim: int | None = None) -> Column:
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)) & F.exists(vector, lambda x: x != 0)
    return whole if dim is None else whole & (F.size(vector) == dim)


def _unit(rows: list | pd.Series) -> np.ndarray:
    m = np.asarray(np.stack([np.asarray(r, dtype=np.float64) for r in rows]))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit(vectors: DataFrame, cells: int, *, rows: int = FIT_ROWS, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids (cells, dim) of unit length: spherical k-means on the ``rows`` vectors whose ids hash least."""
    few = vectors.where(_valid("embedding")).select("embedding", F.xxhash64("vec_id", F.lit(seed)).alias("h")).orderBy("h").limit(rows)
    found = [r["embedding"] for r in few.collect()]  # ``rows`` at most
    if not found:
        return np.zeros((0, 0))
    x = _unit([v for v in found if len(v) == len(found[0])])
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            mean = x[own == j].sum(axis=0)
            if np.linalg.norm(mean) > 0:
                c[j] = mean / np.linalg.norm(mean)
    if c.nbytes > CENTROID_BYTES:
        raise ValueError(f"{c.nbytes} bytes of centroids, more than {CENTROID_BYTES}")
    return c


def _cells(df: DataFrame, vector: str, centroids: np.ndarray, n: int) -> DataFrame:
    """``df`` with ``cell``, a row for each of the ``n`` nearest centroids."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, cell int"

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                best = np.argsort(-(_unit(b[vector]) @ centroids.T), axis=1, kind="stable")[:, :n]
                out = b.loc[b.index.repeat(best.shape[1])].copy()
                out["cell"] = best.ravel().astype("int32")
                yield out

    return df.where(_valid(vector, centroids.shape[1])).mapInPandas(near, schema)


def build(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The index (cell, vec_id, embedding) of all ``vectors`` (vec_id, embedding), sorted by cell so that scans skip the row groups of others."""
    rows = _cells(vectors.where("vec_id IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding", centroids, 1)
    return rows.repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell")


def _dealt(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their part of the cell, and (cell, number of parts)."""
    n = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias(f"{name}_n"))
    return df.join(n, "cell").withColumn(name, F.pmod(F.xxhash64(key), F.col(f"{name}_n")).cast("int")).drop(f"{name}_n"), n


def search(index: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """(qid, vec_id, score, rank): the ``k`` rows of the nearest ``probes`` cells by cosine, a query (qid, q) itself left out. All cells: exact."""
    asked = _cells(queries.where("qid IS NOT NULL").select("qid", F.col("q").cast("array<double>").alias("q")), "q", centroids, max(1, probes))
    asked = keep(asked, "probes")
    rows, row_parts = _dealt(index, "vec_id", "part")
    asks, ask_parts = _dealt(asked, "qid", "turn")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = rows.join(ask_parts, "cell").select("cell", "part", every("turn_n").alias("turn"), "vec_id", "embedding")
    asks = asks.join(row_parts, "cell").select("cell", every("part_n").alias("part"), "turn", "qid", "q")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("vec_id", kind="stable")
            ids, x = left["vec_id"].to_numpy(), _unit(left["embedding"])
            for at in range(0, len(right), 256):
                few = right.iloc[at : at + 256]
                for qid, s in zip(few["qid"], _unit(few["q"]) @ x.T, strict=True):
                    s = np.round(s, DIGITS)
                    order = np.argsort(-s, kind="stable")
                    order = order[ids[order] != qid]
                    _, first = np.unique(ids[order], return_index=True)
                    order = order[np.sort(first)[:k]]
                    out.append(pd.DataFrame({"qid": qid, "vec_id": ids[order], "score": s[order]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "vec_id": [], "score": []})

    types = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *index.schema.fields]}
    met = rows.groupBy("cell", "part", "turn").cogroup(asks.groupBy("cell", "part", "turn"))
    found = met.applyInPandas(best, f"qid {types['qid']}, vec_id {types['vec_id']}, score double")
    return ranked(found.groupBy("qid", "vec_id").agg(F.max("score").alias("score")), k, item="vec_id")


def probes_for(index: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, recall: float = 0.95) -> int:
    """The least power of two of cells (or all) with which ``ASKED`` of the queries find ``recall`` of their exact answers."""
    asked = keep(queries.orderBy(F.xxhash64("qid")).limit(ASKED), "asked")
    exact = keep(search(index, asked, centroids, k, len(centroids)).select("qid", "vec_id"), "exact")
    n, probes = exact.count(), 1
    while probes < len(centroids):
        if exact.join(search(index, asked, centroids, k, probes), ["qid", "vec_id"], "left_semi").count() >= recall * n:
            return probes
        probes *= 2
    return len(centroids)
