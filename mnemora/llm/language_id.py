"""Language identification by averaged hashed subword embeddings.

Subwords are byte 3- and 4-grams of the text (A-Z lowered, runs of other ASCII
as word borders), hashed to ``BUCKETS``. A document is the average of its
subwords' embeddings; a linear softmax over it predicts the language. Both are
trained by stochastic gradient descent in numpy, and a temperature, fitted on a
part of the sample that the descent doesn't see, calibrates the confidence. The
same part sets the rejection level: the lowest confidence above which at least
``PRECISION`` of its predictions are right. Predictions under it are marked as
rejected.

Null texts and texts without a letter are ``und`` with score 0. Rows without a
label teach nothing; with no labels at all everything is ``und``. Every row
gives one row; extra columns are ignored. At most ``MAX_PER_LANG`` documents a
language (expected, by a hash of doc_id) are learned from, whole texts; should
the hash give more than 1.2 times as many, the last by that hash stay out. The
model has ``BUCKETS`` numbers a language, 128 KiB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import checked_broadcast, crc_fold, table

BITS, DIM, MAX_PER_LANG, PRECISION = 15, 16, 1500, 0.99
BUCKETS, _STEP = 1 << BITS, 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def _fold() -> np.ndarray:
    lut = np.full(256, 32, np.uint32)
    lut[ord("a") : ord("z") + 1] = lut[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    lut[128:] = np.arange(128, 256)
    return lut


_LUT = _fold()


def subwords(raw: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of all 3- and 4-grams, in pieces."""
    raw = b" " + raw + b" "
    for at in range(0, len(raw), _STEP):
        b = _LUT[np.frombuffer(raw, np.uint8, min(_STEP + 3, len(raw) - at), at)]
        if len(b) < 3:
            continue
        three = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
        if at and len(b) <= 3:
            three = three[:0]
        elif len(b) == _STEP + 3:
            three = three[:_STEP]
        grams = [three]
        if len(b) > 3:
            grams.append((b[:-3] * np.uint32(0x27D4EB2F) + b[1:-2] * np.uint32(0x165667B1)) + (b[2:-1] * np.uint32(0x2545F491) + b[3:] * np.uint32(0x9E3779B9)))
        h = np.concatenate(grams)
        yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)


class LanguageModel:
    def __init__(self, langs: list[str], embed: np.ndarray, out: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float = 0.0) -> None:
        self.langs, self.logits, self.bias, self.temperature, self.reject_below = langs, (embed @ out).astype(np.float32), bias, temperature, reject_below

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.langs)), 0
        for h in subwords(text.encode("utf-8")):
            total += self.logits.take(h, axis=0).sum(axis=0, dtype=np.float64)
            n += len(h)
        z = (total / max(n, 1) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (k, n) in enumerate(rows):
        x[i, k] = n / max(n.sum(), 1)
    return x


def learn(rows: list[tuple[np.ndarray, np.ndarray]], y: list[str], epochs: int = 6, batch: int = 32, rate: float = 2.0, seed: int = 11) -> LanguageModel:
    langs = sorted(set(y))
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, DIM)), np.zeros((DIM, 0)), np.zeros(0), 1.0)
    target = np.array([langs.index(v) for v in y])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 10] if len(rows) >= 50 else order
    train = order[len(rows) // 10 :] if len(rows) >= 50 else order
    embed, out, bias = rng.normal(0, 1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs))
    steps, done = epochs * max(1, -(-len(train) // batch)), 0
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            own = train[at : at + batch]
            x = _dense([rows[i] for i in own])
            e = x @ embed
            z = e @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), target[own]] -= 1
            g = (p / len(own)).astype(np.float32)
            lr = rate * (1 - done / steps)
            done += 1
            back = x.T @ (g @ out.T)
            out -= lr * (e.T @ g)
            embed -= lr * 200 * back
            bias -= 0.1 * lr * g.sum(axis=0)
    z = np.concatenate([_dense([rows[i] for i in held[at : at + 64]]) @ embed @ out for at in range(0, len(held), 64)]) + bias
    best = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: _loss(z / t, target[held]))
    return LanguageModel(langs, embed, out, bias, best, rejection_level(z / best, target[held]))


def rejection_level(z: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest confidence such that of the predictions at least as confident ``precision`` are right; 1 if there is none."""
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= precision)
    return float(top[order[good[-1]]]) if len(good) else 1.0


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    z = z - z.max(axis=1, keepdims=True)
    return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts = [], []
        for t in batch.column(1):
            c = np.zeros(BUCKETS, np.int64)
            for h in subwords((t.as_py() or "").encode("utf-8")):
                c += np.bincount(h, minlength=BUCKETS)
            k = np.flatnonzero(c)
            keys.append(k.astype(np.uint16).tobytes())
            counts.append(c[k].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["lang", "k", "n"])


def fit(docs: DataFrame, per_lang: int = MAX_PER_LANG) -> LanguageModel:
    """Learn from text and lang of rows outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id")) != 0)).select("doc_id", "lang", "text")
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.abs(F.xxhash64("doc_id") % 1_000_000) / 1_000_000.0
    n_langs = max(per.count(), 1)
    sample = (
        rows.join(checked_broadcast(per, n_langs, 10_000), "lang").where(share < F.lit(float(per_lang)) / F.col("n"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(int(1.2 * per_lang * n_langs)).select("lang", "text").mapInArrow(_extract, "lang string, k binary, n binary")
    ).toPandas()
    pairs = [(np.frombuffer(k, np.uint16).astype(np.int64), np.frombuffer(n, np.float32)) for k, n in zip(sample.k, sample.n, strict=True)]
    return learn(pairs, list(sample.lang))


def identify(docs: DataFrame, model: LanguageModel, reject_below: float | None = None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row; ``reject_below`` is the model's own level where it isn't given."""
    level = model.reject_below if reject_below is None else reject_below
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = sent.value.predict
        for batch in batches:
            got = [one(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
    return made.withColumn("rejected", (F.col("score") < level) | (F.col("lang_pred") == UNKNOWN))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select(
        "doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected"
    )
