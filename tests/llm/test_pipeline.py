"""The pipeline's stages against brute force on the smallest tables."""

import hashlib
import re

import corpus_pipeline
from helpers import SF

from mnemora.llm import mixing, quality

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _near(docs):
    """The smallest id of each component of shingle sets with a similarity of 0.85 and more."""
    sets = {}
    for i, t in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", _lower(t))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(len(ws) - 4, 1))} if ws else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, b in enumerate(ids):
        for a in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def _clean(docs, items):
    windows = {}
    for it in items:
        ws = _WORD.findall(_lower(it))
        n = min(len(ws), 13)
        if n:
            windows.setdefault(n, set()).update(tuple(ws[s : s + n]) for s in range(len(ws) - n + 1))
    out = set()
    for i, t in docs:
        ws, hit = _WORD.findall(_lower(t)), set()
        for n, grams in windows.items():
            for s in range(len(ws) - n + 1):
                if tuple(ws[s : s + n]) in grams:
                    hit |= set(range(s, s + n))
        if not (hit and 20 * len(hit) >= len(ws)):
            out.add(i)
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "quality classifier":
            ranker = quality.fit(docs, labels)
            want = {i for i, t in before if ranker is None or ranker.score(t) >= quality.THRESHOLD}
        elif name == "exact dedup":
            top = {}
            for i, t in before:
                key = hashlib.sha256((t or "").encode()).digest()
                top[key] = max(i, top.get(key, i))
            want = set(top.values())
        elif name == "near dedup":
            want = _near(before)
        elif name == "decontamination":
            want = _clean(before, items)
        else:
            copies = {r.doc_id: r.copies for r in mixing.plan_copies(docs).collect()}
        made = stage(spark, docs, SF)
        made.write.parquet(f"{tmp_path}/{k}")
        made = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == columns and {r.doc_id for r in made.collect()} == want, name
            assert made.exceptAll(docs).isEmpty()
        else:
            given = {r.doc_id: r["count"] for r in made.groupBy("doc_id").count().collect()}
            assert given == {i: n for i, n in copies.items() if n} and made.where("copy > 2").isEmpty()
        docs = made


def test_exact_stage_keeps_the_largest(spark):
    rows = [(1, "x", "en", "s", 1), (2, "x", "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_exact(spark, docs, SF).collect()) == [2, 4]
