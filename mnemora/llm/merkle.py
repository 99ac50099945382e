"""Merkle manifest of a dataset, built and verified by Pregel-style RDD supersteps.

Every row is a leaf: the SHA-256 of its fields. The leaves of a source, in the
order of doc_id, make a tree in which ``ARITY`` consecutive nodes become one;
the roots of the sources, in order, make the upper tree in the same way.

Upward supersteps: a node messages its parent, a parent that has all its
children hashes them and forwards the digest. Downward supersteps: a parent
sends each child the path of siblings above it, until the leaves fold their own
digest with it and compare with the root. A vertex of these supersteps is a
block of ``LEVELS`` tree levels (at most ``ARITY ** LEVELS`` children, so no
task gathers more), hence one shuffle serves four levels and a source of n rows
takes log81 n supersteps. Blocks know how many children to expect; a missing or
surplus message is an error. Each round's blocks are checkpointed to the shared
folder. Texts never move: they are hashed where they are read.

Leaves are numbered by source, id and digest without gathering a source
(``common.numbered``).

Null fields count as ``-``, so null, empty and absent texts differ; a null
doc_id or source is a value like any other and comes first. Rows that agree in
all fields are leaves of their own, interchangeable; rows that repeat a doc_id
are ordered by their digests. Texts of any length are one hash. An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import materialise, numbered, table
from mnemora.sources.scratch import root as scratch_root

ARITY, LEVELS, ROWS_A_TASK = 3, 4, 50_000
FANOUT = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

#: A run's place of the own node and the digests of the others.
Step = tuple[int, tuple[bytes, ...]]


def field(col: Column) -> Column:
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def node_hash(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join([d.hex() for d in digests]).encode("ascii")).digest()


def grow(digests: list[bytes], n: int) -> list[list[bytes]]:
    """The levels of one block, from its children up; ``n``: nodes of the whole tree's level. It ends early where the tree does."""
    levels = [digests]
    for _ in range(LEVELS):
        if n == 1:
            break
        row = levels[-1]
        levels.append([node_hash(row[i : i + ARITY]) for i in range(0, len(row), ARITY)])
        n = -(-n // ARITY)
    return levels


def siblings(levels: list[list[bytes]], at: int) -> list[Step]:
    """The path of the block's child ``at``, from below."""
    path = []
    for row in levels[:-1]:
        first = at - at % ARITY
        path.append((at - first, tuple([d for i, d in enumerate(row[first : first + ARITY]) if i + first != at])))
        at //= ARITY
    return path


def fold(own: bytes, path: list[Step]) -> bytes:
    for at, others in path:
        own = node_hash([*others[:at], own, *others[at:]])
    return own


def _place(key: tuple) -> int:
    """The same in every process, unlike Python's own hash."""
    return int.from_bytes(hashlib.blake2b(repr(key).encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big")


def _block(messages: list[tuple], key: tuple) -> tuple:
    """A block that has all its children: (n, children in order, what they carry in order)."""
    messages = sorted(messages, key=lambda m: m[0])
    n = messages[0][1]
    if [m[0] for m in messages] != list(range(min(FANOUT, n - key[1] * FANOUT))):
        raise ValueError(f"block {key} has {len(messages)} children of {min(FANOUT, n - key[1] * FANOUT)}")
    return n, [m[2] for m in messages], [m[3] for m in messages]


class Forest:
    """Trees, one a group, over an RDD of ((group, idx), (n, digest, carried))."""

    def __init__(self, nodes: RDD, rows: int, largest: int) -> None:
        self.rounds: list[RDD] = []
        while True:
            tasks = max(1, -(-rows // ROWS_A_TASK))
            met = nodes.map(lambda x: ((x[0][0], x[0][1] // FANOUT), (x[0][1] % FANOUT, *x[1]))).groupByKey(tasks, _place)
            blocks = met.map(lambda x: (x[0], _block(list(x[1]), x[0])), preservesPartitioning=True)
            blocks.checkpoint()
            rows = blocks.count()
            self.rounds.append(blocks)
            nodes = blocks.map(lambda x: (x[0], (-(-x[1][0] // FANOUT), grow(x[1][1], x[1][0])[-1][0], None)))
            if largest <= FANOUT:
                break
            largest = -(-largest // FANOUT)
        #: (group, digest)
        self.roots = nodes.map(lambda x: (x[0][0], x[1][1]))

    def send(self, above: RDD) -> RDD:
        """(carried, digest, path, said) of every leaf. ``above``: (group, (path, said)) from beyond the roots."""
        down = above.map(lambda x: ((x[0], 0), x[1]))
        for blocks in reversed(self.rounds[1:]):
            met = blocks.cogroup(down, blocks.getNumPartitions())
            down = met.flatMap(_to_blocks)
        last = self.rounds[0]
        return last.cogroup(down, last.getNumPartitions()).flatMap(_to_leaves)


def _meet(met: tuple) -> Iterator[tuple]:
    key, (blocks, said) = met
    blocks, said = list(blocks), list(said)
    if len(blocks) != 1 or len(said) != 1:
        raise ValueError(f"block {key} got {len(said)} messages from above")
    (n, digests, carried), (path, more) = blocks[0], said[0]
    levels = grow(digests, n)
    for at, own in enumerate(digests):
        yield at, own, carried[at], siblings(levels, at) + path, more


def _to_blocks(met: tuple) -> Iterator[tuple]:
    (group, b), _ = met
    for at, _, _, path, more in _meet(met):
        yield (group, b * FANOUT + at), (path, more)


def _to_leaves(met: tuple) -> Iterator[tuple]:
    for _, own, carried, path, more in _meet(met):
        yield carried, own, path, more


def _result(x: tuple) -> tuple:
    (doc_id, changed), own, path, (subroot, root) = x
    proof = hashlib.sha256("".join([d.hex() for _, others in path for d in others]).encode("ascii")).hexdigest()
    folded = fold(own if changed is None else changed, path)
    return doc_id, own.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root


def manifest(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per row of ``docs``: its digests, the hash of its proof, and whether the row as it is now, with ``tampered`` for its text, folds to the root."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_root(spark))
    own, now = leaf(*[F.col(c) for c in fields]), leaf(*[tampered if c == "text" else F.col(c) for c in fields])
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.unhex(own).alias("leaf"), F.unhex(now).alias("now"))
    leaves = materialise(leaves.withColumn("now", F.when(F.col("now") != F.col("leaf"), F.col("now"))))  # texts are hashed once
    ranked = numbered(leaves, "source", ["doc_id", "leaf"])
    ranked = materialise(ranked)
    size = ranked.agg(F.count(F.lit(1)), F.max("n")).first()
    if not size[0]:
        return spark.createDataFrame([], RESULT)
    given = ranked.rdd.map(lambda r: ((r["source"], r["idx"]), (r["n"], bytes(r["leaf"]), (r["doc_id"], r["now"] and bytes(r["now"])))))
    trees = Forest(given, *size)

    tops = numbered(spark.createDataFrame(trees.roots, "source string, digest binary", verifySchema=False).withColumn("all", F.lit(0)), "all", ["source"])
    tops = materialise(tops)
    many = tops.count()
    upper = Forest(tops.rdd.map(lambda r: (("", r["idx"]), (r["n"], bytes(r["digest"]), r["source"]))), many, many)
    above = upper.roots.map(lambda x: ("", ([], x[1])))
    told = upper.send(above).map(lambda x: (x[0], (x[2], (x[1], x[3]))))
    return spark.createDataFrame(trees.send(told).map(_result), RESULT, verifySchema=False)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document by the crc32 of its id loses its line ends."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(table(spark, sf_dir, "documents"), F.when(chosen, F.translate("text", "\n", "")).otherwise(F.col("text")))


ORACLE_SQL = r"""
WITH RECURSIVE f(v) AS (SELECT 0),
crc AS (SELECT DISTINCT doc_id, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c FROM documents),
d AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN (xor(c, 4294967295) & 1) = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents LEFT JOIN crc USING (doc_id)),
e AS (SELECT doc_id, source, text, now, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d),
l AS MATERIALIZED (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS now,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM e),
t(source, lev, i, n, h) AS (SELECT source, 0, i, n, leaf FROM l
  UNION ALL SELECT source, min(lev) + 1, i // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, i // 3),
s AS MATERIALIZED (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lev, i, n, h) AS (SELECT 0, i, n, subroot FROM s
  UNION ALL SELECT min(lev) + 1, i // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY i // 3),
nodes AS MATERIALIZED (SELECT 0 AS up, source, lev, i, n, h FROM t UNION ALL SELECT 1, NULL, lev, i, n, h FROM u),
runs AS MATERIALIZED (SELECT up, source, lev, i // 3 AS p, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY up, source, lev, i // 3),
path AS MATERIALIZED (
  SELECT l.source, l.i AS leaf_i, up, lev, (l.i // (3 ** lev)::BIGINT) % 3 AS pos, hs FROM l JOIN runs r ON r.up = 0 AND r.source IS NOT DISTINCT FROM l.source AND r.p = l.i // (3 ** (lev + 1))::BIGINT
  UNION ALL SELECT l.source, l.i, up, lev, (s.i // (3 ** lev)::BIGINT) % 3, hs FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN runs r ON r.up = 1 AND r.p = s.i // (3 ** (lev + 1))::BIGINT),
steps AS MATERIALIZED (SELECT source, leaf_i, list({'pos': pos, 'hs': hs} ORDER BY up, lev) AS steps,
    sha256(string_agg(array_to_string(list_concat(hs[1:pos], hs[pos + 2:]), ''), '' ORDER BY up, lev)) AS proof FROM path GROUP BY source, leaf_i),
folds(source, leaf_i, k, h) AS (SELECT source, i, 0, now FROM l
  UNION ALL SELECT f.source, f.leaf_i, k + 1, sha256(array_to_string(list_concat(list_append(x.steps[k + 1].hs[1:x.steps[k + 1].pos], f.h), x.steps[k + 1].hs[x.steps[k + 1].pos + 2:]), ''))
    FROM folds f JOIN steps x ON x.source IS NOT DISTINCT FROM f.source AND x.leaf_i = f.leaf_i WHERE k < len(x.steps)),
folded AS (SELECT source, leaf_i, arg_max(h, k) AS h FROM folds GROUP BY source, leaf_i)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, coalesce(proof, sha256('')) AS proof_sha256, folded.h AS folded_root, folded.h = r.h AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN folded ON folded.source IS NOT DISTINCT FROM l.source AND folded.leaf_i = l.i
LEFT JOIN steps x ON x.source IS NOT DISTINCT FROM l.source AND x.leaf_i = l.i CROSS JOIN (SELECT h FROM u WHERE n = 1) r
"""
