"""MinHash near-deduplication with sequential Bayesian verification.

1. Documents with equal shingle sets form a class, which is one node of all
   that follows; ids only name the components at the end.
2. ``BANDS`` bands of ``ROWS`` hashes bucket the classes: a pair at the
   threshold shares no bucket with probability (1 - t^ROWS)^BANDS, 7e-6 here.
3. Star round: in each bucket every class meets the bucket's hub (another in
   each band, by hash), so a bucket of n gives n - 1 pairs. It is repeated
   ``STAR_ROUNDS`` - 1 times where a bucket holds several components yet, with
   the member of most links as the hub.
4. Pairs are verified sequentially: signatures are compared in batches of
   ``BATCH`` hashes, and a pair goes as soon as the posterior probability of a
   similarity of at least t falls below ``MISS``. Survivors are verified
   exactly on their full shingle sets. Links give components.
5. Rest round: buckets that now hold one component need no further pair. In
   each other bucket all pairs across components are compared, sequentially
   again, on signatures of ``WIDE`` hashes made for these classes alone, in
   blocks of ``BLOCK`` classes spread over tasks, each pair in its first
   common band only; survivors are verified exactly. So every candidate pair
   is either tested or already connected: no link between components is lost,
   and groups of copies aren't expanded into their pairs.

Words are maximal runs without white space, A-Z lowered; a set holds the
distinct 5-word shingles (64-bit hashes of 64-bit word hashes), or the whole
sequence as one if there are fewer. Null texts and texts without words are
linked with nothing. Ids are integers (cast to long). Links are between texts: rows
that repeat a doc_id share a component only if their texts do, and rows without an
id are linked like others; a component of such rows alone has a null name.
Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import hot_keys, join_split, materialise, release, table
from mnemora.llm.components import components
from mnemora.llm.shingles import digest, mix64, shingle_set

PERCENT, BANDS, ROWS, HASHES, BATCH, MISS, BLOCK, STAR_ROUNDS, WIDE = 85, 16, 4, 256, 32, 1e-4, 256, 3, 768
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 2**32, WIDE, np.uint64).astype(np.uint32) | np.uint32(1))[None, :]
_B = _rng.integers(0, 2**32, WIDE, np.uint64).astype(np.uint32)[None, :]


def signature(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Minimum hashes; a longer signature begins with the shorter one."""
    x, out = (shingles >> np.uint64(32)).astype(np.uint32)[:, None], np.full(hashes, 0xFFFFFFFF, np.uint32)
    a, b = _A[:, :hashes], _B[:, :hashes]
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[at : at + 1024] * a + b).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, the band's number in it."""
    parts = sig[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return key.view(np.int64)


def least_matches(n: int, t: float, miss: float) -> int:
    """Fewest matches among n at which P(similarity >= t | matches) >= miss, under a uniform prior."""
    total = 0.0
    for m in range(n + 1):  # the posterior is Beta(m+1, n-m+1): P(>= t) = P(Binomial(n+1, t) <= m)
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _steps(percent: int, hashes: int = HASHES) -> list[tuple[int, int]]:
    ends = [*range(BATCH, HASHES + 1, BATCH), *range(HASHES + 4 * BATCH, hashes + 1, 4 * BATCH)]
    return [(n, least_matches(n, percent / 100, MISS)) for n in ends]


def posterior_keep(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of the signature matrices survive all batches."""
    live, got, at = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, need in steps:
        got[live] += (a[live, at:n] == b[live, at:n]).sum(axis=1, dtype=np.int32)
        live, at = live[got[live] >= need], n
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, dig, sig, keys = [], [], [], []
        for t in batch.column(2):
            s = shingle_set(t.as_py())
            n.append(len(s))
            dig.append(digest(s) if len(s) else None)
            m = signature(s) if len(s) else None
            sig.append(m.tobytes() if len(s) else None)
            keys.append(band_keys(m) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "th", "n_shingles", "digest", "sig", "keys"],
        )


def _sign_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = [signature(shingle_set(t.as_py()), WIDE).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.binary())], ["node", "sig"])


def _matrix(column: pa.ChunkedArray | pa.Array, hashes: int = HASHES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, hashes)


def _beside(pairs: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with ``value`` of either node beside them; a hub's is repeated for every part of its pairs."""
    total, made = pairs.count(), pairs
    for c, other in (("a", "b"), ("b", "a")):
        hot = hot_keys(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")), [c], total)
        # texts and signatures of near copies are far larger than their files, so they are never broadcast
        made = join_split(made, nodes.select(F.col("node").alias(c), F.col(value).alias(f"{value}_{c}")).hint("merge"), [c], hot, other)
    return made.select("a", "b", f"{value}_a", f"{value}_b")


def _prune(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the written pairs (a, b) those whose signatures survive, written."""
    steps = _steps(percent)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select([0, 1]).filter(pa.array(posterior_keep(_matrix(batch.column(2)), _matrix(batch.column(3)), steps)))

    made = materialise(_beside(pairs, reps, "sig").mapInArrow(prune, "a long, b long"))
    release(pairs)
    return made


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the written pairs (a, b) those that the full shingle sets confirm, written."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != last:
                    last, own = b, shingle_set(y.as_py())
                other = shingle_set(x.as_py())
                both = np.concatenate([own, other])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(both) - inter))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    made = materialise(_beside(pairs, texts, "text").mapInArrow(verify, "a long, b long"))
    release(pairs)
    return made


def _blocks(percent: int):
    steps = _steps(percent, WIDE)

    def pairs_of(band: int, left: bool, node: np.ndarray, comp: np.ndarray, half: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a_out, b_out, bands = [], [], sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
        for i in range(len(node)):
            if left:  # both halves are one block: each pair once
                j = np.arange(i + 1, len(node))
            elif half[i]:
                continue
            else:
                j = np.flatnonzero(half)
            j = j[comp[j] != comp[i]]
            if not len(j):
                continue
            own = np.broadcast_to(sig[i], (len(j), WIDE))
            j = j[posterior_keep(own, sig[j], steps)]
            if len(j):  # the first common band only
                j = j[(bands[j] == bands[i]).all(axis=2).argmax(axis=1) == band]
                a_out.append(np.full(len(j), node[i]))
                b_out.append(node[j])
        if not a_out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(a_out), np.concatenate(b_out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            unit = np.stack([rows.column(c).to_numpy() for c in ("key", "lo", "hi")], axis=1)
            edges = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1
            node, comp, mine, band = (rows.column(c).to_numpy() for c in ("node", "comp", "mine", "band"))
            sig = _matrix(rows.column("sig"), WIDE)
            for s, e in zip([0, *edges], [*edges, len(unit)], strict=True):
                lo, hi = unit[s, 1], unit[s, 2]
                a, b = pairs_of(int(band[s]), lo == hi, node[s:e], comp[s:e], mine[s:e] != lo, sig[s:e])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2)], axis=1)
            last = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                held.append(batch.slice(0, cut))
                yield from flush(pa.Table.from_batches(held))
                held = []
            elif held and tuple(unit[0]) != tuple(np.array([held[-1].column(c)[-1].as_py() for c in (0, 1, 2)])):
                yield from flush(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from flush(pa.Table.from_batches(held))

    return compare


def _groups(docs: DataFrame, percent: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, th (hash of the text), n_shingles, and ``first``, the (doc_id, th) that comes first in its component.

    A node is a class of equal shingle sets, named by the number of one of its rows: ids may be null or repeat.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    read = texts.mapInArrow(_sign, "doc_id long, th long, n_shingles long, digest binary, sig binary, keys array<long>")
    signed = materialise(read.withColumn("row", F.monotonically_increasing_id()))
    total, many = signed.count(), F.count(F.lit(1)).alias("n")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "row")).alias("first")
    classes = materialise(signed.where("digest is not null").groupBy("digest").agg(first, many).withColumn("node", F.col("first.row")))
    hot = hot_keys(classes.select("digest", "n"), ["digest"], total)
    members = materialise(join_split(signed.select("doc_id", "th", "n_shingles", "digest", "row"), classes.drop("n"), ["digest"], hot, "row", "left").select("doc_id", "th", "n_shingles", "first", "node"))
    reps = signed.join(classes.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "sig", "keys")
    banded = materialise(reps.select("node", F.posexplode("keys").alias("band", "key")))

    hubs = banded.groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key")).alias("hub"), F.min("node").alias("lo"), F.max("node").alias("hi"), many).where("lo <> hi").select("key", "hub", "n")
    shared = materialise(join_split(banded, hubs.drop("n"), ["key"], hot_keys(hubs, ["key"], banded.count()), "node"))  # buckets of two classes at least
    release(banded)
    stars = materialise(shared.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    in_buckets = materialise(shared.select("node").distinct())
    signs = materialise(reps.join(in_buckets, "node", "left_semi").select("node", "sig"))
    release(signed)
    named = in_buckets.join(classes.select("node", "first"), "node").select("node", F.col("first.doc_id").alias("id"), F.col("first.th").alias("h"))
    bodies = materialise(texts.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))).select("node", "text"))
    if bodies.count() > in_buckets.count():  # rows that agree in id and text
        before, bodies = bodies, materialise(bodies.groupBy("node").agg(F.first("text").alias("text")))
        release(before)
    release(in_buckets)

    links = _verify(_prune(stars, signs, percent), bodies, percent)
    tagged, n_shared = shared.select("key", "band", "node"), shared.count()
    old = [shared]
    for again in range(STAR_ROUNDS):
        comps = components(links)
        tagged = tagged.join(comps, "node", "left").select("key", "band", "node", F.coalesce("comp", "node").alias("comp"))
        still = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), many).where("lo <> hi").select("key", "n")
        tagged = materialise(join_split(tagged, still, ["key"], hot_keys(still, ["key"], n_shared), "node"))
        for done in old:
            release(done)
        if again == STAR_ROUNDS - 1 or tagged.isEmpty():
            break
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        ranked = tagged.join(degree, "node", "left").select("key", "node", "comp", F.struct(F.coalesce("degree", F.lit(0)), F.xxhash64("node", "key", F.lit(again))).alias("order"))
        hubs = ranked.groupBy("key").agg(F.max_by(F.struct("node", "comp"), "order").alias("hub"), many)
        meet = join_split(tagged.drop("n"), hubs.drop("n"), ["key"], hot_keys(hubs, ["key"], n_shared), "node").where(F.col("comp") != F.col("hub.comp"))
        pairs = materialise(meet.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct())
        found = _verify(_prune(pairs, signs, percent), bodies, percent)
        before, links = links, materialise(links.unionByName(found))
        release(before)
        release(found)
        old = [tagged, comps]
        tagged = tagged.select("key", "band", "node")
    release(signs)
    release(links)
    if not tagged.isEmpty():
        comps = _rest(tagged, comps, bodies, percent)
    release(tagged)
    release(bodies)

    known = comps.join(classes.select("node", "first"), "node")
    names = known.groupBy("comp").agg(F.min("first").alias("name"), many)
    named = materialise(join_split(comps, names.drop("n"), ["comp"], hot_keys(names.select("comp", "n"), ["comp"], total), "node").select("node", "name"))
    hot = hot_keys(classes.select("node", "n"), ["node"], total)
    made = join_split(members, named, ["node"], hot, "th", "left")
    return made.select("doc_id", "th", "n_shingles", F.coalesce("name", "first").alias("first"))


def _rest(tagged: DataFrame, comps: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Components after all pairs across components within the buckets ``tagged`` were compared."""
    rest = tagged.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wide = materialise(bodies.join(tagged.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_sign_wide, "node long, sig binary"))
    rest = rest.join(wide.hint("merge"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = rest.select(
        "key", F.least("mine", "other").cast("long").alias("lo"), F.greatest("mine", "other").cast("long").alias("hi"), "band", "node", "comp", F.col("mine").cast("long").alias("mine"), "sig"
    )
    units = units.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    pairs = materialise(units.mapInArrow(_blocks(percent), "a long, b long").distinct())
    release(wide)
    more = _verify(pairs, bodies, percent)
    if not more.isEmpty():
        before, comps = comps, components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
        release(before)
    release(more)
    return comps


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return _groups(docs, percent).select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns: of each component the row of smallest doc_id, rows without an id last.

    Texts that share an id but no component are judged apart, so none goes with the other.
    """
    rows = materialise(_groups(docs, percent).where("first is not null").select(F.col("doc_id").alias("its id"), F.col("th").alias("its hash"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))).alias("stays")))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("its id")) & (F.xxhash64(docs["text"]) == F.col("its hash"))
    left = docs.join(rows.where("not stays").select("its id", "its hash").distinct(), on, "left_anti")
    twice = rows.where("stays").groupBy("its id", "its hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if twice.isEmpty():
        return left
    twice = materialise(twice)  # rows that agree in id and text: one of them stays
    again = left.join(twice, on, "left_semi").withColumn("its hash", F.xxhash64("text")).dropDuplicates(["doc_id", "its hash"]).drop("its hash")
    return left.join(twice, on, "left_anti").unionByName(again)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = doc_id
"""
