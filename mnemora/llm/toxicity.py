"""Toxicity by noisy-channel deobfuscation.

Suspicious spans (tokens with look-alike digits and signs, with or without
letters, letters repeated three times or more, short pieces with gaps between them) are
read as lattices: each sign offers the letters it may stand for or stays a sign,
each run of a letter one or two of it, each gap of a spaced-out word a space or
nothing. Viterbi decoding under a character language model picks the likeliest
reading, the channel charging for every change and for every stretch of signs
that stays. The restored text is scored by a sparse logistic model over
hashed words and word beginnings.

The language model is gathered from all documents: character trigram counts,
summed per partition before the shuffle, so its table is bounded by the
alphabet while its counts cover every row. The classifier learns from at most
``training.MAX_TRAIN`` labelled rows of each label outside the held-out fold.

Null and empty texts get the model's score of no words at all. Spans of any
length are decoded, in time linear in the span. A table without both labels
scores everything 0. Every row gives one row; repeated rows repeat, rows without
an id are scored but never learned from; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import crc_fold, materialise, release, table
from mnemora.llm.training import bounded_sample, with_text

THRESHOLD, BITS, CACHE, CACHED_SPAN = 0.5, 18, 500_000, 80
BUCKETS = 1 << BITS
#: What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
_SIGNS = re.escape("".join(LOOKALIKES))
_LETTERS = r"[^\W\d_]"
_WORD = re.compile(rf"{_LETTERS}+")
_PIECE, _WIDE_GAP, _TIGHT_GAP = rf"(?:{_LETTERS}|[{_SIGNS}])", r"(?:[ .\-_~]{1,3}|\*{1,2})", r"(?:[.\-_~]{1,3}|\*{1,2})"
#: Three single letters or more with gaps of any signs, or pieces of up to three letters with gaps without blanks.
_SPACED = re.compile(
    rf"(?<![^\W_])(?:{_PIECE}(?:{_WIDE_GAP}{_PIECE}){{2,}}(?![.\-_~*][^\W_]{{2}})|{_PIECE}{{1,3}}(?:{_TIGHT_GAP}{_PIECE}{{1,3}}){{2,}})(?![^\W_])"
)
_PIECES = re.compile(rf"({_PIECE}{{1,3}}?)(?:{_WIDE_GAP}|$)")
#: A stretch of letters and signs, a letter three times in a row.
_MIXED = re.compile(rf"(?:{_LETTERS}|[{_SIGNS}])+")
_RUN = re.compile(r"(\w)\1\1")
_SIGN_RUN = re.compile(rf"([{_SIGNS}])\1*")
_PUNCTUATION = frozenset("!#(*|+")
SUB_COST, DROP_COST, KEEP_COST, GAP_COST, PAIR_COST = 1.0, 0.5, 2.0, 1.5, 6.0
#: Signs that stay: the first of a stretch, a further one, the first digit of a span without letters (a digit after
#: another is free there), three or more alike at the span's edge, punctuation at the edge.
HOLD_COST, HOLD_MORE, HOLD_NUMBER, HOLD_TAIL, HOLD_EDGE = 9.0, 4.0, 4.0, 3.0, 0.0
HELD = "\0"

_SIZE = 64
_ALPHABET = " abcdefghijklmnopqrstuvwxyz"


def _codes() -> np.ndarray:
    """Byte -> symbol: 0 for what isn't a letter, 1-26 a-z, the bytes of other scripts folded onto 27-63."""
    lut = np.zeros(256, np.int64)
    for i, c in enumerate(_ALPHABET):
        lut[ord(c)] = lut[ord(c.upper())] = i
    lut[128:] = 27 + np.arange(128) % 37
    return lut


_LUT = _codes()
_CODES = _LUT.tolist()


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, step = np.zeros(_SIZE**3, np.int64), 1 << 18
    for batch in batches:
        for t in batch.column(0):
            raw = b" " + (t.as_py() or "").encode("utf-8") + b" "
            for at in range(0, len(raw) - 2, step):
                c = _LUT[np.frombuffer(raw, np.uint8, min(step + 2, len(raw) - at), at)]
                k = (c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:]
                total += np.bincount(k, minlength=_SIZE**3) if len(k) > 50_000 else 0
                if len(k) <= 50_000:
                    np.add.at(total, k, 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["k", "n"])


class CharModel:
    """Interpolated trigram log-probabilities over the symbols."""

    def __init__(self, counts: np.ndarray) -> None:
        tri = counts.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1)) + 0.5
        p1 = uni / uni.sum()
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        p3 = (tri + 5 * p2) / (tri.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).astype(np.float32)


def gather_char_model(docs: DataFrame) -> CharModel:
    """From all of ``docs``; at most 64^3 rows reach the driver."""
    got = docs.select("text").mapInArrow(_trigrams, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_SIZE**3, np.int64)
    counts[got.k.to_numpy(np.int64)] = got.n.to_numpy(np.int64)
    return CharModel(counts)


_LETTER, _SIGN, _TIGHT, _OTHER = 1, 2, 4, 8


def _kinds() -> np.ndarray:
    lut = np.full(9000, _OTHER, np.uint8)
    for c in range(len(lut)):
        if _WORD.match(chr(c)):
            lut[c] = _LETTER
        elif chr(c).isalnum():
            lut[c] = 0
    lut[-1] = _LETTER | _OTHER  # what comes after may be a letter, or none
    for c in LOOKALIKES:
        lut[ord(c)] |= _SIGN
    for c in ".-_*~":
        lut[ord(c)] |= _TIGHT
    return lut


_KIND = _kinds()


def may_be_spaced(text: str) -> bool:
    """Whether a text may have spaced-out pieces; never misses one."""
    k = np.zeros(len(text) + 8, np.uint8)
    k[:4] = k[-4:] = _OTHER
    k[4:-4] = _KIND.take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), mode="clip")
    own, edge, tight = (k & (_LETTER | _SIGN)) > 0, (k & _OTHER) > 0, (k & _TIGHT) > 0
    single = np.zeros(len(k), bool)
    single[1:-1] = own[1:-1] & edge[:-2] & edge[2:]
    near = lambda x, y, n: x[:n] & (y[2 : n + 2] | y[3 : n + 3] | y[4 : n + 4])
    n = len(k) - 4
    linked = near(single, single, n)
    if bool(near(linked, linked, n - 4).any()):
        return True
    return bool((near(tight, tight, n) & own[1 : n + 1]).any())


def lattice(span: str, spaced: bool = False) -> list[list[tuple[str, float, float]]]:
    """Per position the readings and what the channel charges, the second charge where the sign before stayed a sign."""
    gaps: set[int] = set()
    if spaced:
        pieces = _PIECES.findall(span)
        gaps, span = set(np.cumsum([len(p) for p in pieces])[:-1].tolist()), "".join(pieces)
    out: list[list[tuple[str, float, float]]] = []
    head, tail = len(span) - len(span.lstrip("".join(_PUNCTUATION))), len(span.rstrip("".join(_PUNCTUATION)))
    number, i = not _WORD.search(span), 0
    while i < len(span):
        c, j = span[i], i
        while j < len(span) and span[j] == c:
            j += 1
        n, base = j - i, LOOKALIKES.get(c)
        letters = [(x, SUB_COST, SUB_COST) for x in base] if base else [(c, 0.0, 0.0)]
        held: list[tuple[str, float, float]] = []
        if base and (i < head or i >= tail):
            held = [(HELD, HOLD_EDGE, HOLD_EDGE)]
        elif base and n > 2 and not spaced and (i == 0 or j == len(span)):
            held = [(HELD, HOLD_TAIL, HOLD_TAIL)]
        elif base and number and c.isdigit():
            held = [(HELD, HOLD_NUMBER, 0.0 if i == 0 or span[i - 1].isdigit() else HOLD_MORE)]
        elif base:
            held = [(HELD, HOLD_COST, HOLD_MORE)]
        if spaced or n == 1:
            for k in range(n):
                out.append(letters + held)
                if i + k + 1 in gaps:
                    out.append([("", 0.0, 0.0), (" ", GAP_COST, GAP_COST)])
        else:
            once = DROP_COST * (n - 1) + PAIR_COST * (n == 2)  # a pair is mostly meant
            runs = [(x, cost + once, cost + once) for x, cost, _ in letters]
            runs += [(x * 2, cost + DROP_COST * (n - 2), cost + DROP_COST * (n - 2)) for x, cost, _ in letters]
            if base is None and n > 2:
                runs.append((c * n, KEEP_COST, KEEP_COST))
            out.append(runs + held)
        i = j
    return out


def decode(steps: list[list[tuple[str, float, float]]], log: list[float]) -> str:
    """The path of least cost; states are the last two symbols and whether a sign that stayed is the last reading.

    A border after a border is no new one. Paths are chains of (path before, reading), so a step costs the same
    however long the span is, and paths that no state ends are freed.
    """
    states: dict[tuple[int, int, bool], tuple[float, tuple | None]] = {(0, 0, False): (0.0, None)}
    for options in [*steps, [(" ", 0.0, 0.0)]]:
        spelt = [(*option, [_CODES[s] for s in option[0].encode("utf-8")]) for option in options]
        new: dict[tuple[int, int, bool], tuple[float, tuple | None]] = {}
        for (a, b, stayed), (cost, path) in states.items():
            for reading, first, later, symbols in spelt:
                x, y, c = a, b, cost + (later if stayed else first)
                for z in symbols:
                    if y or z:
                        c -= log[(x * _SIZE + y) * _SIZE + z]
                        x, y = y, z
                at = x, y, (reading == HELD if reading else stayed)
                old = new.get(at)
                if old is None or c < old[0]:
                    new[at] = (c, (path, reading))
        states = new
    path, out = min(states.values(), key=lambda state: state[0])[1], []
    while path is not None:
        path, reading = path
        out.append(reading)
    return "".join(reversed(out))[:-1]


class _Cache(dict):
    """``made(key)`` for each key, kept for the first ``CACHE`` of them."""

    def __init__(self, made) -> None:
        super().__init__()
        self.made = made

    def __missing__(self, key):
        got = self.made(key)
        if len(self) < CACHE:
            self[key] = got
        return got


class Restorer:
    def __init__(self, log: np.ndarray) -> None:
        self.log, self.tokens = log, _Cache(self.read)
        self.costs = log.ravel().tolist()
        self.spans = _Cache(lambda key: decode(lattice(*key), self.costs))

    def span(self, span: str, spaced: bool = False) -> str:
        return self.spans[span, spaced] if len(span) <= CACHED_SPAN else decode(lattice(span, spaced), self.costs)

    def _spaced(self, m: re.Match) -> str:
        return self.span(m[0], True).replace(HELD, " ")

    def _mixed(self, m: re.Match) -> str:
        held = sum(1 for _ in _SIGN_RUN.finditer(m[0]))
        got = self.span(m[0]) if held else m[0]
        return m[0] if got.count(HELD) == held else got  # no sign is read as a letter: kept as it is

    def read(self, token: str) -> tuple[str, ...]:
        """The restored words of a token without white space."""
        got = token if token.isalpha() else _MIXED.sub(self._mixed, token)
        return tuple([self.span(w) if _RUN.search(w) else w for w in _WORD.findall(got)])

    def words(self, text: str | None) -> set[str]:
        """The distinct words of the restored text."""
        text = (text or "").lower()
        if may_be_spaced(text):
            text = _SPACED.sub(self._spaced, text)
        return set().union(*map(self.tokens.__getitem__, set(text.split())))


def word_features(word: str) -> tuple[int, ...]:
    raw = word.encode("utf-8")
    made = [zlib.crc32(raw, 1)]
    made += [zlib.crc32(word[:n].encode("utf-8"), 1 + n) for n in (4, 5, 6) if len(word) >= n]
    return tuple(h & (BUCKETS - 1) for h in made)


class ToxicityModel:
    def __init__(self, log: np.ndarray, weights: dict[int, float], bias: float) -> None:
        self.restorer, self.weights, self.bias = Restorer(log), weights, bias
        self.by_word = _Cache(lambda word: sum([weights.get(k, 0.0) for k in word_features(word)]))

    def __reduce__(self):
        return ToxicityModel, (self.restorer.log, self.weights, self.bias)

    def score(self, text: str | None) -> float:
        words = self.restorer.words(text)
        z = self.bias + sum(sorted(filter(None, map(self.by_word.__getitem__, words))))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def screen(n: np.ndarray, docs: np.ndarray, least: int = 3, lift: float = 1.5) -> np.ndarray:
    """Which features are learned from, by the documents of either label (``docs``) that have them (``n``, a row a label).

    Those in under ``least`` documents, or with rates closer than ``lift`` times, are left out.
    """
    ratio = (n[1] + 0.5) / (n[0] + 0.5) * (docs[0] / max(docs[1], 1))
    return (n[0] + n[1] >= least) & ((ratio > lift) | (ratio < 1 / lift))


def learn(rows: list[np.ndarray], y: np.ndarray, rounds: int = 300, rate: float = 0.3, sparse: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on feature counts, by Adagrad with soft thresholds (L1)."""
    w, b = np.zeros(BUCKETS, np.float32), 0.0
    if not len(rows) or y.min() == y.max():
        return w, -60.0
    doc, key = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows)
    names, key = np.unique(key, return_inverse=True)
    v, share = np.zeros(len(names)), np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    g2, b2 = np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(doc, v[key], minlength=len(rows)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        g, gb = np.bincount(key, err[doc], minlength=len(names)), err.sum()
        g2 += g * g
        b2 += gb * gb
        step = rate / np.sqrt(g2)
        v -= step * g
        v = np.sign(v) * np.maximum(np.abs(v) - step * sparse, 0)
        b -= rate * gb / np.sqrt(b2)
    w[names] = v
    return w, float(b)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n[y, np.unique(np.frombuffer(x, np.int32))] += 1
    at = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[0, at], pa.int64()), pa.array(n[1, at], pa.int64())], ["k", "n0", "n1"])


def fit(docs: DataFrame, labels: DataFrame, chars: CharModel) -> ToxicityModel:
    """Features are made and counted in the executors; the driver gets ``BUCKETS`` counts at most, then the features that pass the screen."""
    sample = with_text(docs, bounded_sample(labels, "toxic")).select("doc_id", "y", "text")
    sent = docs.sparkSession.sparkContext.broadcast(chars)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value.log)
        for batch in batches:
            x = []
            for t in batch.column(2):
                words = restorer.words(t.as_py())
                x.append(np.array([k for w in words for k in word_features(w)], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    made = materialise(sample.mapInArrow(extract, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x binary"))
    per = made.select("y", "x").mapInArrow(_count_features, "k int, n0 long, n1 long").groupBy("k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    totals, n = {r["y"]: r["n"] for r in made.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}, np.zeros((2, BUCKETS), np.int64)
    n[:, per.k.to_numpy(np.int64)] = np.stack([per.n0, per.n1]) if len(per) else np.zeros((2, 0), np.int64)
    live = docs.sparkSession.sparkContext.broadcast(screen(n, np.array([totals.get(0, 0), totals.get(1, 0)])))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[live.value[r]].tobytes() for r in rows], pa.binary())], ["doc_id", "y", "x"])

    got = made.mapInArrow(kept, made.schema).orderBy("doc_id").select("y", "x").toPandas()
    release(made)
    weights, bias = learn([np.frombuffer(b, np.int32) for b in got.x], got.y.to_numpy(np.int64) if len(got) else np.zeros(0))
    return ToxicityModel(chars.log, {int(k): float(weights[k]) for k in np.flatnonzero(weights)}, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 64^3 numbers and the weights that aren't 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = sent.value.score
        for batch in batches:
            s = [one(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), gather_char_model(docs))
    return score_toxicity(docs, model).select(
        "doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
