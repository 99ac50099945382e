"""Periodic runs, license scan and Merkle manifest against brute force and on odd rows."""

import hashlib
import random
import zlib

import pytest
from helpers import duck_rows, spark_rows

from mnemora.llm import license_scan, merkle, periodic_runs
from mnemora.llm.license_scan import TEMPLATES

# periodic runs


def slow_runs(w, least=12):
    """Every maximal stretch of every period, smallest periods first."""
    found = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            s, n = i, j + p - i
            if j > i and n >= max(least, 2 * p) and not any(s2 <= s and s2 + n2 >= s + n and p % p2 == 0 for s2, n2, p2 in found):
                found.append((s, n, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(250):
        n, k = rnd.randint(0, 110), rnd.choice([1, 2, 2, 3, 5, 40])
        w = [b"%d" % rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randint(0, 2)):  # stretches repeated, of any period
            if n:
                a, b = sorted((rnd.randrange(n), rnd.randrange(n)))
                p = rnd.randint(1, max(1, (b - a) // 2))
                w[a:b] = [w[a + (i - a) % p] for i in range(a, b)]
        assert periodic_runs.find_runs(w) == slow_runs(w), w


def test_stretches_keep_every_run_and_its_neighbours():
    rnd = random.Random(1)
    for _ in range(200):
        w = [b"%d" % rnd.randrange(10**6) for _ in range(400)]
        for _ in range(3):
            a, p = rnd.randrange(300), rnd.randint(1, 20)
            for i in range(a + p, min(400, a + rnd.randint(12, 90))):
                w[i] = w[i - p]
        runs = slow_runs(w)
        spans = periodic_runs.stretches(w)
        assert all(any(s <= at and at + n <= e for s, e in spans) for at, n, _ in runs)
        assert periodic_runs.find_runs(w) == runs


def test_collisions_change_nothing(monkeypatch):
    """With a hash that tells nothing apart, words decide."""
    monkeypatch.setattr(periodic_runs.Extensions, "_equal", lambda *_: True)
    rnd = random.Random(2)
    for _ in range(100):
        w = [b"%d" % rnd.randrange(2) for _ in range(40)]
        assert periodic_runs.find_runs(w) == slow_runs(w)


def test_known_runs():
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 300:
        fib = fib[1], fib[1] + fib[0]
    assert periodic_runs.find_runs(fib[1]) == slow_runs(fib[1])
    assert periodic_runs.find_runs([b"x"] * 200_000) == [(0, 200_000, 1)]
    assert periodic_runs.find_runs([b"x"] * 11) == [] and periodic_runs.find_runs([b"x"] * 12) == [(0, 12, 1)]
    assert periodic_runs.find_runs([]) == []


def test_runs_of_documents(spark):
    rnd = random.Random(4)
    texts = [None, "", " \x0b\x1f ", "one", "é " * 30, "a b c d " * 9, " ".join(f"w{rnd.randrange(3)}" for _ in range(3000))]
    texts += [" ".join(f"v{rnd.randrange(400)}" for _ in range(rnd.randint(1, 300))) for _ in range(120)]
    rows = [(i if i != 5 else None, t, "x", 1) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, start int")
    got = sorted(map(tuple, periodic_runs.periodic_runs(docs, periodic_runs.changed).collect()), key=repr)
    want, altered = [], 0
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
            altered += 1
        runs = slow_runs(w)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        best = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(runs), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert got == sorted(want, key=repr) and altered > 4


# license scan


def test_license_blocks_equal_all_pairs(spark):
    """Whole notices, cut, mixed and broken over lines, at every place: the join finds what counting all pairs finds."""
    rnd, texts = random.Random(6), list(TEMPLATES)
    filler = lambda n: [rnd.choice(["and", "of", "the", "use", "zebra", "blue", "x1", "license"]) for _ in range(n)]
    rows = [None, "", "?!", "The MIT license; cc-by, Gnu General PUBLIC license apache license", "mit"]
    for _ in range(150):
        w = filler(rnd.randint(0, 200))
        for _ in range(rnd.randint(0, 2)):
            t = rnd.choice(texts).split()
            t = [x for x in t if rnd.random() < rnd.choice([1.0, 0.9, 0.75])]
            at = rnd.randint(0, len(w))
            w[at:at] = t
        rows.append("".join(x.upper() + rnd.choice([" ", "\n", ", ", " // "]) for x in w))
    rows += [rows[-1]] * 3
    docs = spark.createDataFrame([(i // 2 if i % 7 else None, t, "z", 0) for i, t in enumerate(rows)], "doc_id long, text string, words string, row int")
    got = sorted(map(tuple, license_scan.scan(docs).collect()), key=repr)
    width, want, found = license_scan.block_words(TEMPLATES), [], 0
    for i, t in enumerate(rows):
        w = [x.decode() for x in license_scan.words_of(t)]
        places = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        parts = {}
        for s in range(0, len(w), width // 2):
            for text, label in TEMPLATES.items():
                both, all_ = len(set(w[s : s + width]) & set(text.split())), len(set(text.split()))
                if 100 * both >= license_scan.PERCENT * all_:
                    parts[label] = max(parts.get(label, 0), both / all_)
        base = sorted({x for _, x in places})
        found += bool(parts)
        starts = [k for k, _ in places]
        want.append((i // 2 if i % 7 else None, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *parts})), 1.0 if base else max(parts.values(), default=0.0)))
    assert got == sorted(want, key=repr) and found > 40


def test_license_sql_on_notices(spark, tmp_path):
    rnd, rows = random.Random(8), []
    for i in range(60):
        w = [rnd.choice(["the", "of", "é1", "zz"]) for _ in range(rnd.randint(0, 150))]
        w[len(w) // 2 : len(w) // 2] = rnd.choice([*TEMPLATES, "Apache License", "CC BY", ""]).split()[: rnd.choice([99, 15])]
        rows.append((i, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = spark_rows(license_scan.op11_license_scan(spark, str(tmp_path)))
    assert got == duck_rows(license_scan.ORACLE_SQL, tmp_path) and any(0 < r[-1] < 1 or r[3] for r in got[1])


def test_every_notice_is_found_alone():
    for t in TEMPLATES:
        assert len(t.split()) <= license_scan.block_words(TEMPLATES) // 2
        assert license_scan.needed(len(set(t.split())), license_scan.PERCENT) >= 8  # a few common words never suffice


# Merkle manifest


def slow_manifest(rows, tamper):
    """Trees level by level, in one process."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(digests):
        """(root, per leaf its path of (place, others))."""
        paths, level, where = [[] for _ in digests], digests, list(range(len(digests)))
        while len(level) > 1:
            runs = [level[i : i + 3] for i in range(0, len(level), 3)]
            for k, at in enumerate(where):
                run = runs[at // 3]
                paths[k].append((at % 3, run[: at % 3] + run[at % 3 + 1 :]))
                where[k] = at // 3
            level = [sha("".join(r)) for r in runs]
        return level[0], paths

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r, sha("".join(map(part, r))), sha("".join(map(part, (*r[:4], tamper(r)))))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {s: tree([x[1] for x in by[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        sub, paths = trees[s]
        for (r, leaf, now), path in zip(by[s], paths, strict=True):
            h = now
            for at, others in path + top:
                h = sha("".join(others[:at] + [h] + others[at:]))
            out.append((r[0], leaf, sub, root, sha("".join(x for _, o in path + top for x in o)), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (700, 81, 82, 1, 3, 9), (1,) * 100])
def test_manifest_equals_one_process(spark, sizes):
    rnd, rows = random.Random(len(sizes)), []
    for k, n in enumerate(sizes):
        for _ in range(n):
            i = rnd.choice([None, *range(40)]) if n == 82 else len(rows)
            rows.append((i, None if k == 0 and len(sizes) > 1 else f"é{k}", rnd.choice(["en", None, ""]), rnd.choice([1, None]), rnd.choice([None, "", "a\nb", "x" * 5000, f"t{i}\n"])))
    docs = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, part string, n int").repartition(5)
    F = merkle.F
    got = merkle.manifest(docs, F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text")))
    want = slow_manifest(rows, lambda r: r[4].replace("\n", "") if r[4] and r[0] is not None and r[0] % 2 == 0 else r[4])
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_tampering_shows(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"t{i}") for i in range(200)], "doc_id long, source string, lang string, n_chars long, text string")
    F = merkle.F
    got = {r.doc_id: r.verified for r in merkle.manifest(docs, F.when(F.col("doc_id") == 77, F.lit("t77!")).otherwise(F.col("text"))).collect()}
    assert [i for i, ok in got.items() if not ok] == [77]


def test_blocks_need_all_their_children():
    merkle._block([(1, 2, b"b", None), (0, 2, b"a", None)], ("s", 0))
    for messages in ([(0, 2, b"a", None)], [(0, 2, b"a", None), (0, 2, b"a", None), (1, 2, b"b", None)]):
        with pytest.raises(ValueError):
            merkle._block(messages, ("s", 0))
