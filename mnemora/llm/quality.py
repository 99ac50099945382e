"""Quality by Bradley-Terry pairwise ranking.

A document's score is ``w . x``; ``w`` is learned from preference pairs (a
document of label 1 against one of label 0) by the logistic loss on the
difference of their features. All labelled rows outside the held-out fold are
learned from: they are dealt over parts of bounded size, each part is fitted
in a task, and ``w`` is the mean of the parts' weights. The threshold is the
quantile of the scores of all these rows at the share of label 0, on their
sorted scores. It is put at ``THRESHOLD`` on the 0-1 scale.

Features: shares of pairs of neighbouring character classes over the whole
text, how often a word repeats its predecessor, the share of distinct words,
and mean lengths. Labels, lang, source and doc_id are no features.

Null and empty texts score 0. A table without both labels ranks nothing: every
text that isn't empty scores 1. Every row gives one row; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import crc_fold, materialise, release, table
from mnemora.llm.training import labelled_rows, labelled_sample

THRESHOLD = 0.3
_CLASSES = 16


def _classes() -> np.ndarray:
    lut = np.full(256, 15, np.uint8)  # other ASCII
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".", ",", "!", "|", "*", "$", "%", "&#", "\"'")):
        lut[list(chars.encode())] = k
    lut[128:] = 14
    return lut


_LUT = _classes()
N_FEATURES = _CLASSES * _CLASSES + _CLASSES + 6


def features(text: str) -> np.ndarray:
    """float32 features of a whole text."""
    raw = text.encode("utf-8")
    pairs, step = np.zeros(_CLASSES * _CLASSES, np.int64), 1 << 20
    for at in range(0, len(raw), step):
        c = _LUT[np.frombuffer(raw, np.uint8, min(step + 1, len(raw) - at), at)]
        if len(c) > 1:
            pairs += np.bincount((c[:-1] << 4) | c[1:], minlength=_CLASSES * _CLASSES)
    words = raw.split()
    n, m = max(len(words), 1), max(len(raw), 1)
    share = pairs / m
    one = share.reshape(_CLASSES, _CLASSES).sum(axis=1)
    again = sum(map(eq, words, words[1:])) / n
    rest = (again, np.sqrt(again), len(set(words)) / n, np.log1p(n), m / n / 10.0, raw.count(b"\n") / n)
    return np.concatenate([np.sqrt(share), np.sqrt(one), rest]).astype(np.float32)


class Ranker:
    def __init__(self, w: np.ndarray, mean: np.ndarray, scale: np.ndarray, cut: float, slope: float) -> None:
        self.w, self.bias, self.cut, self.slope = w / scale, float(-(w / scale) @ mean), cut, slope

    def score(self, text: str | None) -> float:
        if not text:
            return 0.0
        raw = float(features(text) @ self.w) + self.bias
        z = self.slope * (raw - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def direction(x: np.ndarray, y: np.ndarray, rounds: int = 1500, batch: int = 512, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> np.ndarray | None:
    """Weights of the features, fitted to preference pairs by Adam on the logistic loss of feature differences; every row is in a pair."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    good, bad = (good - mean) / scale, (bad - mean) / scale
    rounds = max(rounds, -(-max(len(good), len(bad)) // batch))
    rng, w = np.random.default_rng(seed), np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)

    def turns(n: int) -> np.ndarray:
        """Rows in the order of their pairs: all of them, each time in another order."""
        return np.concatenate([rng.permutation(n) for _ in range(-(-rounds * batch // n))])[: rounds * batch].reshape(rounds, batch)

    for t, (i, j) in enumerate(zip(turns(len(good)), turns(len(bad)), strict=True), 1):
        d = good[i] - bad[j]
        g = -(d.T @ (1 / (1 + np.exp(np.clip(d @ w, -40, 40))))) / batch + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w / scale


def ranker(w: np.ndarray, at: list[float], medians: tuple[float, float]) -> Ranker:
    """``at``: the raw scores, sorted, about the share of label 0: the last one under the cut and the next; ``medians`` of either label."""
    cut = float(sum(at) / len(at))  # the score quantile at the share of label 0
    return Ranker(w, np.zeros(len(w)), np.ones(len(w)), cut, 8.0 / max(medians[1] - medians[0], 1e-6))


def learn(x: np.ndarray, y: np.ndarray, **how) -> Ranker | None:
    """The ranker of rows that fit one task."""
    w = direction(x, y, **how)
    if w is None:
        return None
    raw, n_bad = np.sort(x @ w), int((y == 0).sum())
    return ranker(w, list(raw[n_bad - 1 : n_bad + 1]), (float(np.median((x @ w)[y == 0])), float(np.median((x @ w)[y == 1]))))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t.as_py() or "").tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["doc_id", "x"])


def _matrix(rows: list[bytes] | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), N_FEATURES).astype(np.float64)


def _part(rows: pd.DataFrame) -> pd.DataFrame:
    """The weights of a part, a row a feature."""
    rows = rows.sort_values(["doc_id", "x"], kind="stable")
    w = direction(_matrix(rows["x"]), rows["y"].to_numpy())
    return pd.DataFrame({"place": range(N_FEATURES), "part": rows["part"].iloc[0], "n": len(rows), "w": w})


def _places(scores: DataFrame, order: list[str], places: list[int]) -> list[float]:
    """The raw scores of ``places`` in the order of all rows, by a sort over all tasks; places beyond the rows are left out."""
    wanted = set(places)
    ordered = scores.select(*order, "tie").orderBy(*order, "tie")  # equal scores are spread, too
    found = ordered.rdd.zipWithIndex().filter(lambda r: r[1] in wanted).map(lambda r: (r[1], r[0]["raw"])).collect()
    raw = dict(found)  # as many as ``places``
    return [raw[p] for p in places if p in raw]


def fit(docs: DataFrame, labels: DataFrame) -> Ranker | None:
    """Learn from all labelled rows outside the held-out fold; the driver gets ``N_FEATURES`` weights and six scores."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    made = docs.where(F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 0)).select("doc_id", "text").mapInArrow(_extract, f"doc_id {doc_id}, x binary")
    made = materialise(made.join(labelled_rows(labels, "quality"), "doc_id"))
    n = dict(made.groupBy("y").count().collect())  # a row a label
    n_bad, n_good = n.get(0, 0), n.get(1, 0)
    if not n_bad or not n_good:
        release(made)
        return None
    parts = labelled_sample(made.where("y IN (0, 1)")).groupBy("part").applyInPandas(_part, "place int, part int, n long, w double")
    one = F.array_sort(F.collect_list(F.struct("part", "n", "w")))  # in their order, so that reruns add alike
    mean = F.aggregate(one, F.lit(0.0), lambda s, p: s + p["w"] * p["n"]) / F.sum("n")
    w = np.array([r["w"] for r in parts.groupBy("place").agg(mean.alias("w")).orderBy("place").collect()])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_matrix(batch.column(1).to_pylist()) @ w)], ["y", "raw"])

    scores = materialise(made.where("y IN (0, 1)").select("y", "x").mapInArrow(score, "y int, raw double").withColumn("tie", F.monotonically_increasing_id()))
    at = _places(scores, ["raw"], [n_bad - 1, n_bad])
    middle = lambda first, n: [first + (n - 1) // 2, first + n // 2]
    mid = _places(scores, ["y", "raw"], [*middle(0, n_bad), *middle(n_bad, n_good)])
    release(made)
    release(scores)
    return ranker(w, at, ((mid[0] + mid[1]) / 2, (mid[2] + mid[3]) / 2))


def score_quality(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """doc_id, score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ranker)  # N_FEATURES weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        one = model.score if model else lambda t: 1.0 if t else 0.0
        for batch in batches:
            s = [one(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_quality(docs: DataFrame, ranker: Ranker | None, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, whose score is at least ``least``."""
    sent, columns = docs.sparkSession.sparkContext.broadcast(ranker), docs.columns
    at = columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        one = model.score if model else lambda t: 1.0 if t else 0.0
        for batch in batches:
            yield batch.filter(pa.array([one(t.as_py()) >= least for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
