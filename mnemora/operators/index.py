"""A stored full-text index in segments: pages with their terms, postings by term, tombstones.

``by_page`` (rel, length, terms, tf, places, and what a hit shows) has a row a
page, made within the row and written where it is made: nothing is shuffled. A
batch of many queries reads it once, each task ranks its own pages.

``postings`` (term, block, rel, tf, length, places) are the same by term: each
task sorts the terms of some thousand pages, and a search of few queries sends
its terms to the scan as a list, so that Parquet skips what lies between them.
They are stored if ``by_term``, else made of ``by_page`` when they are asked
for. Pages of like length are dealt to blocks of about ``BLOCK``; ``bounds``
(term, block, n, tf, length) has the pages, the greatest frequency and the
smallest length of a term in a block, which bound any score there, whatever the
mean length has become.

An update writes a segment of the changed pages and lists what it supersedes;
readers leave the superseded rows out. ``compact`` merges all segments into one.
A version names the segments that count and is written last, so readers see an
update as a whole or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.arrays import flat, slices
from mnemora.functions.porter import plain, porter
from mnemora.operators.retrieval import LISTED, _small
from mnemora.sources.scratch import keep
from mnemora.sources.vault import _hadoop, exists

FIELDS = ("title", "summary", "body")
SHOWN = ("rel", "stem", "title", "summary", "project", "ts", "valid_to", "source_authority")
BLOCK, MERGE_AT = 1024, 8
WORDS_KEPT = 500_000  # stems that a task holds, so that a word is stemmed once
_LONG_LISTS = "spark.sql.parquet.pushdown.inFilterThreshold"


def terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and marks, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+"), "")


@dataclass
class Index:
    """``totals`` (n, mean) is one row; ``exact`` tells whether no segment holds superseded pages."""

    postings: DataFrame
    bounds: DataFrame
    pages: DataFrame
    totals: DataFrame
    by_page: DataFrame
    stemmed: bool = True
    exact: bool = True

    def status(self) -> DataFrame:
        return self.totals.select(F.col("n").alias("n_pages"), F.round("mean", 4).alias("mean_length"))

    def manifest(self) -> DataFrame:
        return self.pages.select("rel")


def totals(meta: DataFrame) -> DataFrame:
    return meta.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))


def _in_blocks(rows: DataFrame, lengths: DataFrame, segment: str) -> DataFrame:
    """``rows`` (rel, length, ...) with their block: pages of like length, as many parts as ``lengths`` of all pages ask for."""
    band = F.floor(2 * F.log2(F.col("length") + 1)).cast("int")
    sized = lengths.groupBy(band.alias("band")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))  # 128 rows at most
    block = F.concat_ws("-", F.lit(segment), "band", F.pmod(F.xxhash64("rel"), F.col("parts")))
    return rows.withColumn("band", band).join(F.broadcast(sized), "band").withColumn("block", block).drop("band", "parts")


def _by_page(pages: DataFrame, stemmed: bool) -> DataFrame:
    """A row a page: ``SHOWN``, its length, its distinct terms in order of code, how often each is there, and their places one after the other.

    A place is a number that holds position and field. Pages without a rel have no terms.
    """
    lower = F.lower(F.coalesce("project", F.lit("")))
    rows = pages.select(
        "rel", "stem", "title", F.coalesce("summary", F.lit("")).alias("summary"), lower.alias("project"), F.substring(F.coalesce("timestamp", F.lit("")), 1, 10).alias("ts"),
        "valid_to", "source_authority", *[terms(F.col(f)).alias(f"f{i}") for i, f in enumerate(FIELDS)],
    )
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(SHOWN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            for few in slices(batch, range(len(SHOWN), len(SHOWN) + len(FIELDS))):
                if len(known) > WORDS_KEPT:
                    known.clear()
                made = _grouped(few, known, stemmed)
                yield pa.RecordBatch.from_arrays([*few.columns[: len(SHOWN)], *made], [*SHOWN, "length", "terms", "tf", "places"])

    return rows.mapInArrow(run, f"{names}, length long, terms array<string>, tf array<int>, places array<int>")


def _grouped(batch: pa.RecordBatch, known: dict[str, str], stemmed: bool) -> list[pa.Array]:
    """Length, terms, frequencies and places of each row of a batch (``SHOWN``, terms of each field); ``known`` has the stems so far."""
    rows, each, words = batch.num_rows, [], []
    for i in range(len(FIELDS)):
        row, at, value = flat(batch.column(len(SHOWN) + i))
        each.append((row, at.astype(np.int64) * len(FIELDS) + i))
        words.append(value)
    row, place = (np.concatenate(x) for x in zip(*each, strict=True))
    length = np.bincount(row, minlength=rows)
    coded = pa.concat_arrays(words).dictionary_encode()
    bare = []
    for w in coded.dictionary.to_pylist():
        if w not in known:
            known[w] = porter(plain(w)) if stemmed else plain(w)
        bare.append(known[w])
    stem = pa.array(bare, pa.string()).dictionary_encode()
    names = stem.dictionary
    code = stem.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64) if bare else np.zeros(0, np.int64)
    has = batch.column(0).is_valid().to_numpy(zero_copy_only=False)[row]
    if "" in (found := names.to_pylist()):  # terms of marks alone have no stem
        has &= code != found.index("")
    key, place = (row * max(len(names), 1) + code)[has], place[has]
    order = np.argsort(key, kind="stable")  # places come field by field, in order
    key, place = key[order], place[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    tf, page = np.diff(start, append=len(key)), key[start] // max(len(names), 1)
    cut = lambda of: pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32))
    ends = cut(page)
    return [
        pa.array(length.astype(np.int64)), pa.ListArray.from_arrays(ends, names.take(pa.array(key[start] % max(len(names), 1)))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32))),
        pa.ListArray.from_arrays(cut(key // max(len(names), 1)), pa.array(place.astype(np.int32))),
    ]


def _by_term(by_page: DataFrame, segment: str) -> DataFrame:
    """Postings of ``by_page``, those of some thousand pages at a time by term; nothing is shuffled."""
    rows = by_page.where("rel IS NOT NULL").select("rel", "length", "terms", "tf", "places")
    rows = _in_blocks(rows, by_page.select("length"), segment).select("rel", "block", "length", "terms", "tf", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, [5]):
                row, _, words = flat(few.column(3))
                if not len(row):
                    continue
                tf, place = flat(few.column(4))[2].to_numpy(), flat(few.column(5))[2].to_numpy()
                start = np.cumsum(tf) - tf
                order = pc.sort_indices(words).to_numpy()
                tf, page = tf[order], pa.array(row[order])
                ends = np.concatenate([[0], np.cumsum(tf)])
                at = np.arange(ends[-1]) + np.repeat(start[order] - ends[:-1], tf)
                yield pa.RecordBatch.from_arrays(
                    [words.take(pa.array(order)), few.column(1).take(page), few.column(0).take(page), few.column(2).take(page), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[at]))],
                    ["term", "block", "rel", "length", "places"],
                )

    packed = rows.mapInArrow(run, "term string, block string, rel string, length long, places array<int>")
    place = lambda p: F.struct(F.pmod(p, F.lit(len(FIELDS))).cast("int").alias("field"), F.floor(p / F.lit(len(FIELDS))).cast("int").alias("at"))
    return packed.select("term", "block", "rel", F.size("places").cast("long").alias("tf"), "length", F.transform("places", place).alias("places"))


def _bounds(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf"), F.min("length").alias("length"))


def _index(by_page: DataFrame, postings: DataFrame, stemmed: bool, exact: bool = True) -> Index:
    pages = by_page.select(*SHOWN, "length")
    return Index(postings, _bounds(postings), pages, totals(pages), by_page, stemmed, exact)


def build(pages: DataFrame, path: str | None = None, stemmed: bool = True, by_term: bool = True) -> Index:
    """The index of ``pages`` (rel, stem, title, summary, body, project, timestamp, valid_to, source_authority); stored under ``path``, if given, in place of what is there.

    Without ``by_term`` no postings are stored: for batches of many queries, which read the pages.
    """
    if path is None:
        by_page = keep(_by_page(pages, stemmed), "by_page")
        return _index(by_page, _by_term(by_page, "0"), stemmed)
    spark, segment = pages.sparkSession, _write(pages, path, stemmed, by_term)
    _commit(spark, path, [segment], stemmed)
    return load(spark, path)


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores, a small one then, dealt over all cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _write(pages: DataFrame, path: str, stemmed: bool, by_term: bool = True) -> str:
    segment = uuid.uuid4().hex[:12]
    _stored(_by_page(spread(pages), stemmed), path, segment, by_term)
    return segment


def _stored(by_page: DataFrame, path: str, segment: str, by_term: bool) -> None:
    spark, at = by_page.sparkSession, f"{path}/{segment}"
    by_page.write.option("compression", "zstd").parquet(f"{at}/pages")
    if by_term:
        _by_term(spark.read.parquet(f"{at}/pages"), segment).write.option("compression", "zstd").parquet(f"{at}/postings")


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _hadoop(spark, f"{path}/versions")
    if not fs.exists(p):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if exists(spark, f"{path}/versions/{f.getPath().getName()}/_SUCCESS"))


def _commit(spark: SparkSession, path: str, segments: list[str], stemmed: bool) -> None:
    """A version: the segments that count, oldest first. Two writers of one version collide, and the later one fails."""
    number = (_versions(spark, path) or [0])[-1] + 1
    spark.createDataFrame([(segments, stemmed)], "segments array<string>, stemmed boolean").write.mode("error").parquet(f"{path}/versions/{number:08d}")


def _segments(spark: SparkSession, path: str) -> tuple[list[str], bool]:
    number = _versions(spark, path)[-1]
    row = spark.read.parquet(f"{path}/versions/{number:08d}").first()  # one row
    return list(row.segments), row.stemmed


def _each(spark: SparkSession, path: str, segments: list[str], name: str) -> DataFrame:
    """The rows of all segments with the number of theirs; postings that a segment doesn't store are made of its pages."""
    made = None
    for k, s in enumerate(segments):
        there = name == "pages" or exists(spark, f"{path}/{s}/{name}/_SUCCESS")
        part = spark.read.parquet(f"{path}/{s}/{name}") if there else _by_term(spark.read.parquet(f"{path}/{s}/pages"), s)
        part = part.withColumn("segment", F.lit(k))
        made = part if made is None else made.unionByName(part)
    return made


def _dead(spark: SparkSession, path: str, segments: list[str]) -> DataFrame | None:
    """(rel, segment): the rows of a page in each segment before an update of it."""
    made = None
    for k, s in enumerate(segments[1:], 1):
        part = spark.read.parquet(f"{path}/{s}/superseded").select("rel", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("segment"))
        made = part if made is None else made.unionByName(part)
    return None if made is None else made.distinct()


def load(spark: SparkSession, path: str) -> Index:
    """The newest version. Lists of terms longer than Spark's default threshold are sent to the scan as they are, not as a range."""
    if int(spark.conf.get(_LONG_LISTS)) < LISTED:
        spark.conf.set(_LONG_LISTS, str(LISTED))
    segments, stemmed = _segments(spark, path)
    dead = _dead(spark, path, segments)
    by_page, postings = (_each(spark, path, segments, name) for name in ("pages", "postings"))
    if dead is not None:
        gone = _small(dead)
        by_page, postings = (x.join(gone, ["rel", "segment"], "left_anti") for x in (by_page, postings))
    return _index(by_page.drop("segment"), postings.drop("segment"), stemmed, dead is None)


def update(spark: SparkSession, path: str, changed: DataFrame, removed: DataFrame | None = None) -> Index:
    """Pages new or ``changed`` (``build``'s columns) and ``removed`` (rel): one more segment; merged when there are ``MERGE_AT``."""
    segments, stemmed = _segments(spark, path)
    segment = _write(changed, path, stemmed, exists(spark, f"{path}/{segments[-1]}/postings/_SUCCESS"))
    gone = spark.read.parquet(f"{path}/{segment}/pages").select("rel")
    (gone if removed is None else gone.unionByName(removed.select("rel"))).distinct().write.parquet(f"{path}/{segment}/superseded")
    _commit(spark, path, [*segments, segment], stemmed)
    return compact(spark, path) if len(segments) + 1 >= MERGE_AT else load(spark, path)


def compact(spark: SparkSession, path: str) -> Index:
    """All segments merged into one, without the text: pages are filtered, and postings made of them if all segments store theirs.

    Old segments stay until ``clean``, as readers may be at them.
    """
    index, segment = load(spark, path), uuid.uuid4().hex[:12]
    by_term = all(exists(spark, f"{path}/{s}/postings/_SUCCESS") for s in _segments(spark, path)[0])
    _stored(index.by_page, path, segment, by_term)
    _commit(spark, path, [segment], index.stemmed)
    return load(spark, path)


def clean(spark: SparkSession, path: str) -> int:
    """Delete segments and versions that the newest version doesn't name; how many. For when no reader is at work."""
    kept, newest = set(_segments(spark, path)[0]), _versions(spark, path)[-1]
    fs, p = _hadoop(spark, path)
    old = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName() not in kept | {"versions"}]
    old += [f.getPath() for f in fs.listStatus(_hadoop(spark, f"{path}/versions")[1]) if int(f.getPath().getName()) != newest]
    for x in old:
        fs.delete(x, True)
    return len(old)
