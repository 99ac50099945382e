"""Periodic runs of words, found from Lyndon roots without a suffix array.

A run is a stretch of words with smallest period q and at least two periods that
can't be extended. Every run has, under the order of words or under its reverse,
a root that is the longest Lyndon word at its place. So a stack scanned from
right to left gives each place's longest Lyndon word under either order (the
next smaller suffix ends it), and each such word is extended to both sides as
far as its period goes; what spans two periods is a run.

Suffixes are compared and roots extended by common extensions: binary search
over rolling hashes, then the words themselves are compared, so a collision
costs time but changes nothing. What one diagonal (distance of two places) has
shown equal is kept and not compared again; texts of one word, repeated, stay
linear in comparisons.

Only stretches that can hold a run are scanned. A run of ``LEAST`` words and two
periods holds ``LEAST / 2`` words in a row that come again one period later, and all
its words lie in such grams; so a text is first cut to the stretches covered by
grams that recur within their stretch, until nothing more falls away. This loses
no run and no word around one.

Each document is one row of its task, read once; nothing is shuffled. Memory is
a few numbers a word of the longest text. Null and empty texts have no words and
no runs. A null doc_id is reported with its text as it is. Repeated rows repeat,
an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mnemora.llm.common import table
from mnemora.llm.shingles import gram_hashes, word_hashes

LEAST, CUTS = 12, 12
_MOD, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)

Run = tuple[int, int, int]


def changed(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document by the crc32 of its id repeats a stretch from some word on."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode("ascii")), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def stretches(words: list[bytes], least: int = LEAST) -> list[tuple[int, int]]:
    """Disjoint stretches of words, in order, that hold all runs of ``least`` words and more."""
    gram = least // 2
    grams = gram_hashes(word_hashes(words), gram)
    at, group, pieces = np.arange(len(grams)), np.zeros(len(grams), np.int64), 1
    for _ in range(CUTS):  # stopping early would only leave more to scan
        order = np.lexsort((grams[at], group))
        g, x = group[order], grams[at[order]]
        same = (g[1:] == g[:-1]) & (x[1:] == x[:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        kept = at[twice]
        if not len(kept):
            return []
        first = np.flatnonzero(np.diff(kept, prepend=-gram - 1) > gram)  # grams that overlap or touch are one stretch
        last = np.append(first[1:], len(kept)) - 1
        long = kept[last] + gram - kept[first] >= least
        if len(kept) == len(at) and len(first) == pieces and long.all():
            break
        group = np.repeat(np.arange(len(first)), last - first + 1)
        at, group, pieces = kept[long[group]], group[long[group]], int(long.sum())
        if not pieces:
            return []
    edges = np.flatnonzero(np.diff(at) > gram) + 1
    first, last = at[np.concatenate([[0], edges])], at[np.append(edges, len(at)) - 1]
    return [(int(s), int(e) + gram) for s, e in zip(first, last, strict=True)]


class Extensions:
    """Longest common extensions of places in one stretch, exact."""

    def __init__(self, x: list[int]) -> None:
        self.x, self.n = x, len(x)
        self.raw = np.array(x, np.int32).tobytes()
        hashes, powers, h, p = [0], [1], 0, 1
        for v in x:
            h = (h * _BASE + v + 1) % _MOD
            p = p * _BASE % _MOD
            hashes.append(h)
            powers.append(p)
        self.hashes, self.powers = hashes, powers
        self.known: dict[int, tuple[int, int, bool]] = {}  # distance -> equal from, to (as far as it goes), from as far as it goes

    def _equal(self, i: int, j: int, k: int) -> bool:
        h, p = self.hashes, self.powers[k]
        return (h[i + k] - h[i] * p - h[j + k] + h[j] * p) % _MOD == 0

    def _same(self, i: int, j: int, k: int) -> bool:
        """Whether the words themselves are equal."""
        return self.raw[4 * i : 4 * (i + k)] == self.raw[4 * j : 4 * (j + k)]

    def _search(self, i: int, j: int, most: int, back: bool) -> int:
        """Most words equal from (i, j) on, or before it: doubled, then halved, by hashes; then by the words."""
        equal = (lambda k: self._equal(i - k, j - k, k)) if back else (lambda k: self._equal(i, j, k))
        low, step = 0, 1
        while low + step <= most and equal(low + step):
            low += step
            step *= 2
        high = min(most, low + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if equal(mid) else (low, mid - 1)
        x, s, t = self.x, (i - low if back else i), (j - low if back else j)
        if self._same(s, t, low) and (low == most or (x[i - low - 1] != x[j - low - 1] if back else x[i + low] != x[j + low])):
            return low
        low = 0  # two unequal stretches of one hash: word by word
        while low < most and (x[i - low - 1] == x[j - low - 1] if back else x[i + low] == x[j + low]):
            low += 1
        return low

    def forward(self, i: int, j: int) -> int:
        """Words equal from i and j > i on."""
        if j >= self.n or self.x[i] != self.x[j]:
            return 0
        d, got = j - i, self.known.get(j - i)
        if got and got[0] <= i < got[1]:
            return got[1] - i
        if got and i == got[0] - 1:
            self.known[d] = i, got[1], False
            return got[1] - i
        k = self._search(i, j, self.n - j, False)
        self.known[d] = i, i + k, False
        return k

    def start(self, i: int, j: int) -> int:
        """Where the equal stretch around (i, j) begins; ``forward`` has seen it."""
        d = j - i
        low, high, whole = self.known[d]
        if not whole:
            low -= self._search(low, low + d, low, True)
            self.known[d] = low, high, True
        return low


def lyndon_runs(x: list[int], least: int = LEAST) -> set[Run]:
    """(start, length, period) of all runs with ``least`` words and two periods, in a stretch of word numbers."""
    n, ext, found = len(x), Extensions(x), set()
    for reverse in (False, True):
        ends = [n] * (n + 1)  # the next smaller suffix of each place: a stack, its links kept
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n:
                k = ext.forward(i, j)
                if j + k >= n:  # the suffix at j is a beginning of the one at i, so smaller under either order
                    break
                if (x[i + k] > x[j + k]) != reverse:
                    break
                j = ends[j]
            ends[i] = j
            p = j - i
            if j < n and x[i] == x[j]:
                right = ext.forward(i, j)
                left = ext.start(i, j)
                length = j + right - left
                if length >= 2 * p and length >= least:
                    found.add((left, length, p))
    return found


def find_runs(words: list[bytes], least: int = LEAST) -> list[Run]:
    """All runs of a text by start, then period."""
    found = []
    for s, e in stretches(words, least):
        number: dict[bytes, int] = {}
        x = [number.setdefault(w, len(number)) for w in words[s:e]]
        found += [(s + at, length, p) for at, length, p in lyndon_runs(x, least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run repeats: of each run its first period stays, unless another run drops it."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        edge[start + p] += 1
        edge[start + length] -= 1
    return [w for w, k in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not k]


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(words: list[bytes]) -> tuple:
    runs = find_runs(words)
    lines = "".join([f"{s},{n},{p}\n" for s, n, p in runs])
    most = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    best = (*most, 1000 * most[1] // most[2]) if most else (None,) * 4
    return len(runs), *best, hashlib.sha256(lines.encode("ascii")).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()


def periodic_runs(docs: DataFrame, change=None) -> DataFrame:
    """One row per document: its runs counted, the longest one, and digests of all runs and of the text without repetitions.

    ``change(words, doc_id)`` may alter the words first.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8").split()
                rows.append((doc_id, *report(change(words, doc_id) if change else words)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(scan, _SCHEMA)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), changed)
