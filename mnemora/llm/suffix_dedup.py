"""Repeated passages by sparse suffix arrays.

1. Retain: of every window of ``SPAN`` k-gram starts the smallest hash is a
   minimiser; the suffix that begins there is retained, with its head: a 16-bit
   code for each of its first ``PREFIX`` = MIN_WORDS - SPAN + 1 words. A shared
   passage of ``MIN_WORDS`` words has a minimiser, the same in every copy, among
   its first ``SPAN`` words, so its head lies inside the passage.
2. Sort: suffixes are range-partitioned and sorted by head, then by doc_id, so
   that a head that very many documents share is dealt over tasks.
3. Compare neighbours: a suffix stays if the run of equal heads around it holds
   two documents.
4. Extend: each suffix that stays is extended to the left and to the right to
   every stretch of MIN_WORDS words around it whose first minimiser it is.
   Stretches are sorted and compared with their neighbours in the same way (by
   a 96-bit identity of their words); those that two documents have are
   repeated, and overlapping ones unite to the maximal passage.

Both sorts split a run that very many documents share over partitions. Where a
run may go on beyond its partition, its rows are settled by a table of the
partitions' first and last runs, two rows a partition.

Every word inside a passage of at least MIN_WORDS words that another document
has is covered, however often it occurs; nothing is capped. Words are maximal
runs without white space, as they are. Repeats inside one document alone don't
count, nor do texts of fewer words, null or empty ones. Ids are integers (cast to long). Rows that repeat a
doc_id count as one document; rows with a null doc_id are left out. Empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.llm.common import materialise, release, table
from mnemora.llm.shingles import gram_hashes, word_hashes

MIN_WORDS, SPAN, GRAM = 50, 36, 6


def _minimisers(grams: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` grams the position of its smallest (the leftmost of equals)."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, width = grams, np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        left, right = best[: len(best) - step], best[step:]
        at = np.where(right < left, at[step:], at[: len(at) - step])
        best = np.minimum(left, right)
        width += step
    return at[:n]


def _split(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8").split())


def suffixes(text: str | None, least: int = MIN_WORDS, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the retained suffixes and their heads, a row of bytes each that sorts as its codes do."""
    h, size = _split(text), least - span + 1
    if len(h) < least:
        return np.zeros(0, np.int64), np.zeros((0, 2 * size), np.uint8)
    at = np.unique(_minimisers(gram_hashes(h, GRAM), span))
    at = at[at <= len(h) - size]
    codes = (h >> np.uint64(48)).astype(">u2")
    return at, codes[at[:, None] + np.arange(size)].view(np.uint8)


class Runs:
    """Rows that come sorted by key and document, read run by run of equal keys.

    ``feed`` gives (rows, first document of their run, whether the run may go on outside) for runs with two documents and
    for the first run of all, ``last`` what may have its second document outside. Rows that wait for their run's second
    document are one document's.
    """

    def __init__(self) -> None:
        self.key, self.low, self.high, self.first, self.open = None, None, None, True, False
        self.waiting: list[pa.RecordBatch] = []
        self.ends: list[tuple[np.ndarray, int, int]] = []  # of the first and, at last, the last run: key, lowest and highest document

    def feed(self, keys: np.ndarray, docs: np.ndarray, rows: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        n = len(docs)
        starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
        ends = np.concatenate([starts[1:], [n]])
        low, many = np.repeat(docs[starts], ends - starts), docs[starts] != docs[ends - 1]
        goes_on = self.key is not None and bool((keys[0] == self.key).all())
        if goes_on:
            low[: ends[0]], many[0] = self.low, self.open or docs[ends[0] - 1] != self.low
            if many[0]:
                yield from self._held(False)
        else:
            if self.key is not None and self.first:
                self._end()
            self.waiting, self.first = [], self.key is None
        keep, outside = np.repeat(many, ends - starts), np.zeros(n, bool)
        if self.first:
            keep[: ends[0]] = outside[: ends[0]] = True
            self.key, self.low, self.high = keys[ends[0] - 1], low[0], docs[ends[0] - 1]
        if len(starts) > 1:
            if self.first:
                self._end()
            self.waiting, self.first = [], False
        self.key, self.low, self.high, self.open = keys[-1], low[-1], docs[-1], bool(many[-1])
        if not self.open and not self.first:
            self.waiting.append(rows.slice(starts[-1]))
        if keep.any():
            yield rows.filter(pa.array(keep)), low[keep], outside[keep]

    def last(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        yield from self._held(True)
        if self.key is not None:
            self._end()

    def _held(self, outside: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for rows in self.waiting:
            yield rows, np.full(rows.num_rows, self.low, np.int64), np.full(rows.num_rows, outside)
        self.waiting = []

    def _end(self) -> None:
        self.ends.append((self.key, int(self.low), int(self.high)))


def stretches(text: str | None, seeds: np.ndarray, least: int = MIN_WORDS, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the stretches whose first minimiser is one of ``seeds``, and their two hashes."""
    h = _split(text)
    if len(h) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    first = _minimisers(gram_hashes(h, GRAM), span)[: len(h) - least + 1]
    start = np.flatnonzero(np.isin(first, seeds))
    one, two = gram_hashes(h, least, seed=2)[start], gram_hashes(h, least, seed=3)[start]
    return start, one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, span: int = SPAN) -> DataFrame:
    """One row per maximal covered passage: doc_id, start_word, end_word (exclusive), n_words, first_doc_id."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, where, heads = [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, head = suffixes(t.as_py(), least, span)
                ids.append(np.full(len(at), d, np.int64))
                where.append(at)
                heads.append(head)
            if ids:
                bodies = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * (least - span + 1)), sum(map(len, ids)), [None, pa.py_buffer(np.concatenate(heads).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(where).astype(np.int32)), bodies], ["doc_id", "pos", "head"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        for batch in batches:
            if batch.num_rows:
                heads = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for rows, _, _ in runs.feed(heads, batch.column(0).to_numpy(), batch.select([0, 1])):
                    yield rows
        for rows, _, _ in runs.last():  # what may have a twin outside stays
            yield rows

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, start, low, and ``border`` where the run may go on outside: twice the partition's number, and one for its last run.

        A row of each border has no doc_id, its run's key and highest document.
        """
        runs, names, first = Runs(), ["doc_id", "start", "low", "border", "high", "one", "two"], 2 * TaskContext.get().partitionId()

        def made(rows: pa.RecordBatch, low: np.ndarray, outside: np.ndarray, border: int) -> pa.RecordBatch:
            n = len(low)
            at = pc.if_else(pa.array(outside), pa.scalar(border, pa.int32()), None)
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("start"), pa.array(low), at, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names)

        for batch in batches:
            if batch.num_rows:
                keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("one", "two")], axis=1)
                for got in runs.feed(keys, batch.column("doc_id").to_numpy(), batch):
                    yield made(*got, first)
        for got in runs.last():
            yield made(*got, first + 1)
        if runs.ends:
            n, (key, low, high) = len(runs.ends), zip(*runs.ends, strict=True)
            one, two = pa.array([int(k[0]) for k in key], pa.int64()), pa.array([int(k[1]) for k in key], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(low, pa.int64()), pa.array([first + i for i in range(n)], pa.int32()), pa.array(high, pa.int64()), one, two], names)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ones, twos = [], [], [], []
            for d, t, seeds in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                s, one, two = stretches(t.as_py(), np.array(seeds.as_py()), least, span)
                ids.append(np.full(len(s), d, np.int64))
                starts.append(s.astype(np.int32))
                ones.append(one)
                twos.append(two)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, starts, ones, twos)], ["doc_id", "start", "one", "two"])

    seeds = materialise(texts.mapInArrow(retain, "doc_id long, pos int, head binary"))
    array = seeds.repartitionByRange("head", "doc_id").sortWithinPartitions("head", "doc_id", "pos")
    found = materialise(array.mapInArrow(compare, "doc_id long, pos int").groupBy("doc_id").agg(F.collect_set("pos").alias("seeds")))
    release(seeds)
    parts = materialise(texts.join(found, "doc_id").select("doc_id", "text", "seeds").mapInArrow(extend, "doc_id long, start int, one long, two int"))
    order = parts.repartitionByRange("one", "two", "doc_id").sortWithinPartitions("one", "two", "doc_id")
    shared = materialise(order.mapInArrow(match, "doc_id long, start int, low long, border int, high long, one long, two int"))
    release(parts)
    ends, spans = shared.where("doc_id is null").collect(), {}  # two rows a partition
    for r in ends:
        low, high = spans.get((r.one, r.two), (r.low, r.high))
        spans[r.one, r.two] = min(low, r.low), max(high, r.high)
    first = [(r.border, spans[r.one, r.two][0]) for r in ends if len(set(spans[r.one, r.two])) > 1]
    first = F.broadcast(docs.sparkSession.createDataFrame(first, "border int, first long"))
    rows = shared.where("doc_id is not null").join(first, "border", "left")
    hits = rows.select("doc_id", "start", F.when(F.col("border").isNull(), F.col("low")).otherwise(F.col("first")).alias("first_doc_id")).where("first_doc_id is not null")
    hits = hits.repartition("doc_id").groupBy("doc_id", "start").agg(F.min("first_doc_id").alias("first_doc_id"))
    order = Window.partitionBy("doc_id").orderBy("start")
    fresh = (F.col("start") > F.lag("start").over(order) + least).cast("int")
    runs = hits.withColumn("run", F.sum(F.coalesce(fresh, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(
        F.min("start").alias("start_word"), (F.max("start") + least).alias("end_word"), F.min("first_doc_id").alias("first_doc_id")
    ).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
s AS MATERIALIZED (SELECT doc_id, i AS start, hash(array_to_string(w[i + 1:i + 50], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM w WHERE len(w) >= 50)),
a AS (SELECT g, min(doc_id) AS first_doc_id FROM s GROUP BY g HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT doc_id, start, min(first_doc_id) AS first_doc_id FROM s JOIN a USING (g) GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN start > lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 50 THEN 1 ELSE 0 END AS fresh FROM h),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT doc_id, min(start)::INT AS start_word, (max(start) + 50)::INT AS end_word, (max(start) + 50 - min(start))::INT AS n_words, min(first_doc_id) AS first_doc_id
FROM r GROUP BY doc_id, run
"""
