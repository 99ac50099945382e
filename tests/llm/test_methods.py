"""The methods themselves: rounds, windows, runs, screens and levels against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mnemora.llm import chat_format, components, decontaminate, exact_dedup, language_id, near_dedup, suffix_dedup, token_count, toxicity
from mnemora.llm import queries as llm

_rnd = random.Random(17)


@pytest.mark.parametrize("shape", ["ascending", "random", "star", "clique"])
def test_components_take_logarithmic_rounds(spark, shape):
    n = 30 if shape == "clique" else 1000
    names = list(range(n)) if shape != "random" else _rnd.sample(range(10**6), n)
    if shape == "star":
        edges = [(n - 1, i) for i in range(n - 1)]
    elif shape == "clique":
        edges = [(a, b) for b in range(n) for a in range(b)]
    else:
        edges = list(zip(names, names[1:], strict=False))
    df = spark.createDataFrame([*edges, (2 * 10**6, 2 * 10**6 + 1), (5, 5)], "a long, b long")
    maps = components.contract(df)
    assert len(maps) <= 2 * np.log2(n)
    if shape != "ascending":
        got = {r.node: r.comp for r in components.components(df).collect()}
        assert got == {x: min(names) for x in names} | {2 * 10**6: 2 * 10**6, 2 * 10**6 + 1: 2 * 10**6}


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def _words(n, span=10**6):
    return [f"v{_rnd.randrange(span)}" for _ in range(n)]


def test_winnowing_finds_every_shared_window(spark):
    """A window of WINDOW words, and one word less, at every offset in the document and in the item; short items; repeated words."""
    n, docs, items = decontaminate.WINDOW, [], []
    for k in range(24):
        shared = _words(n if k % 2 else n - 1)
        docs.append(_words(k) + shared + _words(_rnd.randrange(20)))
        items.append(_words(23 - k) + shared + _words(_rnd.randrange(20)))
    items += [["a"] * 20, ["b", "c"] * 8, _words(3), docs[0][:5], ["z"]]
    docs += [["a"] * 40, ["c", "b"] * 30, items[-3] + ["x"], ["a"] * 12, [], ["z", "y", "z"], docs[3] + docs[3]]
    want = {}
    for d, ws in enumerate(docs):
        hit, named = set(), set()
        for i, it in enumerate(items):
            m = min(len(it), n)
            grams = {tuple(it[s : s + m]) for s in range(len(it) - m + 1)}
            for s in range(len(ws) - m + 1):
                if tuple(ws[s : s + m]) in grams:
                    hit |= set(range(s, s + m))
                    named.add(str(i))
        want[d] = (len(ws), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(ws))
    text = lambda rows: [(i, " ".join(w)) for i, w in enumerate(rows)]
    df, bench = spark.createDataFrame(text(docs), "doc_id long, text string"), spark.createDataFrame(text(items), "item_id long, text string")
    for limit in (10_000, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(df, bench, limit).collect()}
        assert got == want
    plan = decontaminate.find_hits(df, bench)._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("BroadcastHashJoin ")[1].split("]")[0] for line in plan.splitlines() if "BroadcastHashJoin [" in line]
    assert keys and all(k.startswith("[h#") and "," not in k for k in keys)  # the hash alone


def test_winnowing_keeps_few_positions(spark):
    df = spark.createDataFrame([(1, _words(5000))], "doc_id long, w array<string>")
    kept = decontaminate.fingerprints(df, []).select(decontaminate.F.size("fps").alias("n")).first().n
    assert kept < 0.4 * 5000


def test_runs_against_brute_force():
    for case in range(60):
        rnd = random.Random(case)
        rows = sorted((rnd.randrange(6 if case % 2 else 2), rnd.randrange(5), i) for i in range(rnd.randrange(1, 60)))
        docs_of = {k: {d for key, d, _ in rows if key == k} for k, _, _ in rows}
        cuts = sorted(rnd.sample(range(len(rows) + 1), min(3, len(rows))))
        found, ends = {}, []
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            runs, at = suffix_dedup.Runs(), lo
            got = []
            while at < hi:
                part = rows[at : min(at + rnd.randrange(1, 9), hi)]
                at += len(part)
                batch = pa.RecordBatch.from_arrays([pa.array([i for *_, i in part], pa.int64())], ["i"])
                got += list(runs.feed(np.array([[k] for k, *_ in part]), np.array([d for _, d, _ in part]), batch))
            got += list(runs.last())
            for batch, low, outside in got:
                for i, d, o in zip(batch.column(0).to_pylist(), low, outside, strict=True):
                    assert i not in found
                    found[i] = (int(d), bool(o))
            ends += [(int(k[0]), a, b) for k, a, b in runs.ends]
        across = {}
        for k, a, b in ends:
            low, high = across.get(k, (a, b))
            across[k] = min(low, a), max(high, b)
        settled = {}
        for k, _, i in rows:
            if i in found:
                low, outside = found[i]
                if outside:
                    low, high = across[k]
                    if low == high:
                        continue
                settled[i] = low
        assert settled == {i: min(docs_of[k]) for k, _, i in rows if len(docs_of[k]) > 1}, case


def test_heads_sort_as_their_words():
    text = " ".join(_words(300))
    at, heads = suffix_dedup.suffixes(text)
    assert heads.shape == (len(at), 2 * (suffix_dedup.MIN_WORDS - suffix_dedup.SPAN + 1)) and len(at) < 40
    again, same = suffix_dedup.suffixes("x y " + text)
    shared = {bytes(h) for h in heads} & {bytes(h) for h in same}
    assert len(shared) >= len(at) - 2  # content decides which positions stay
    assert suffix_dedup.suffixes("too short")[1].shape[0] == 0


def test_passages_across_many_documents(spark):
    """One passage in every document, at different places, over several partitions: all covered, nothing else."""
    passage = " ".join(_words(70))
    rows = [(i, " ".join([*_words(i % 40), passage, *_words(30)])) for i in range(90)] + [(90, " ".join(passage.split()[:49])), (91, " ".join(_words(200)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in suffix_dedup.repeated_passages(df).collect()}
    assert got == {(i, i % 40, 70, 0) for i in range(90)}


def test_exact_stage_leaves_one_row(spark):
    rows = [(1, "x", "p"), (2, "x", "q"), (2, "x", "r"), (None, "y", "s"), (None, "y", "s"), (None, "x", "t"), (3, None, "u"), (3, "", "v"), (4, "z", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, dropped string")
    kept = [(r.doc_id, r.text or "") for r in exact_dedup.keep_one(df).collect()]
    assert sorted(kept, key=str) == sorted([(2, "x"), (None, "y"), (3, ""), (4, "z")], key=str)


ODD = "doc_id long, text string, lang string, source string, comp string, node long, sig binary, th long, h string, b string, n int, lang_pred string, score double, hit boolean, fps array<long>, at int, n_chars long, idx long, part int, tie long, row long, first string, leaf string, blocks int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents without an id, with repeated ids and rows, and with columns named like the operators' own."""
    root, extra = tmp_path_factory.mktemp("odd"), ("c", 1, b"s", 2, "h", "b", 3, "xx", 0.5, True, [1], 4, 5, 6, 7, 8, 9, "f", "l", 3)
    base = " ".join(_words(120))
    texts = [(None, base), (None, base), (None, None), (1, base), (1, base), (1, "other text entirely"), (2, base + " end"), (3, ""), (3, ""), (4, None), (5, " ".join(_words(200_000))), (6, "\t\n"), (7, base)]
    rows = [(i, t, "en", None if k % 2 else "s", *extra) for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, ODD).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, base, "x"), (None, base, "x"), (2, None, "x")], "item_id long, text string, w string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, 0, 1), (3, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), texts


@pytest.mark.parametrize("name", sorted(q for q in llm.QUERIES if not q.startswith(("op1_", "op6_"))))
def test_odd_rows_keep_their_count(spark, odd, name):
    folder, texts = odd
    got = sorted((str(r.doc_id) for r in llm.QUERIES[name](spark, folder).collect()))
    assert got == sorted(str(i) for i, _ in texts)


def test_odd_rows_have_defined_results(spark, odd):
    folder, texts = odd
    sized = {(r.doc_id, r.group_size, r.kept) for r in llm.QUERIES["op2_exact_dedup"](spark, folder).collect()}
    assert (7, 5, True) in sized and (1, 5, False) in sized and (None, 5, False) in sized and (6, 1, True) in sized and (4, 4, True) in sized and (3, 4, False) in sized
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in llm.QUERIES["op10_near_dedup"](spark, folder).collect()}
    assert (2, 117, 1, False) in near and (7, 116, 1, False) in near and (3, 0, 3, True) in near and (None, 116, 1, False) in near
    marks = {(r.doc_id, r.n_hit, r.n_items) for r in llm.QUERIES["op7_decontaminate"](spark, folder).collect()}
    assert (2, 120, 1) in marks and (None, 0, 0) in marks and (5, 0, 0) in marks
    spans = {r.doc_id for r in llm.QUERIES["op6_suffix_dedup"](spark, folder).collect()}
    assert spans == {1, 2, 7}


def test_long_texts_cross_every_piece(spark):
    text = " ".join(_rnd.choice(["the", "naïve", "café", "x1", "words,"]) for _ in range(400_000))
    assert len(text.encode()) > (1 << 20)
    docs = spark.createDataFrame([(1, text), (2, text + "!")], "doc_id long, text string")
    row = near_dedup.near_duplicates(docs).collect()
    assert {r.component_id for r in row} == {1}
    assert exact_dedup.exact_duplicates(docs).where("group_size = 1").count() == 2
    model = language_id.learn([(k, n) for k, n in [_grams("the words of the text"), _grams("el texto de las palabras")]], ["en", "es"])
    assert model.predict(text)[0] == "en"
    assert token_count is not None


def _grams(text):
    c = np.zeros(language_id.BUCKETS, np.int64)
    for h in language_id.subwords(text.encode()):
        c += np.bincount(h, minlength=language_id.BUCKETS)
    k = np.flatnonzero(c)
    return k, c[k].astype(np.float32)


def test_rejection_level():
    z = np.log(np.array([[0.9, 0.1], [0.8, 0.2], [0.7, 0.3], [0.6, 0.4]]))
    assert abs(language_id.rejection_level(z, np.array([0, 0, 1, 0]), 0.99) - 0.8) < 1e-9
    assert abs(language_id.rejection_level(z, np.array([0, 0, 1, 0]), 0.7) - 0.6) < 1e-9
    assert language_id.rejection_level(z, np.array([1, 1, 1, 1]), 0.5) == 1.0


def test_screen():
    n = np.array([[100, 0, 1, 50], [10, 5, 1, 5]])
    assert toxicity.screen(n, np.array([1000, 100])).tolist() == [False, True, False, False]


def test_spans_are_read_by_their_start(spark):
    texts = ["plain", "<|im_end|><|im_start|>assistant ok", "%0A \\| <\\|x|>", "", "é" * 50]
    rows = [(1, 2 * i + j, "message", f"m{2 * i + j}", ("user", "assistant")[j], t) for i, t in enumerate(texts) for j in (0, 1)]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg_id string, role string, text string")
    made = chat_format.format_chats(events).select("formatted", "loss_spans", chat_format.parse(chat_format.F.col("formatted")).alias("t")).first()
    assert [(t.role, t.text) for t in made.t] == [(("user", "assistant")[j], t) for t in texts for j in (0, 1)]
    spans = sorted((s.start, s.length) for s in made.loss_spans)
    assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    cut = [made.formatted[a : a + n] for a, n in spans]
    assert cut[0] == "plain" and cut[-1] == "é" * 50 and not any("<|im_" in c for c in cut)
    outside = made.formatted
    for a, n in reversed(spans):
        outside = outside[:a] + outside[a + n :]
    assert outside.count("<|im_start|>assistant") == len(texts)


def test_toxicity_ranks_and_finds(spark):
    """Held-out toxic documents score above the others, and most are found; always saying no would fail."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in llm.QUERIES["op5_toxicity"](spark, sf).collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i].score, y, got[i].predicted) for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    bad, good = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert len(bad) >= 3
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    told = [y for _, y, p in held if p]
    assert auc >= 0.9 and sum(told) / len(bad) >= 0.6 and sum(told) / max(len(told), 1) >= 0.6

def test_near_dedup_keeps_texts_that_share_an_id(spark):
    """Ids that repeat or lack: only texts link, and of each component one row stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a + " end"
    rows = [(1, a, "x"), (5, a, "y"), (5, c, "z"), (None, a, "u"), (7, b, "v"), (1, b, "w"), (9, near, "t"), (None, "one", "s"), (None, "one", "s"), (4, None, "n"), (4, "", "n"), (5, c, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(1, 36, 1, True), (5, 36, 1, False), (5, 36, 5, True), (None, 36, 1, False), (7, 36, 1, False), (9, 37, 1, False), (None, 1, None, True), (4, 0, 4, True)}
    kept = sorted(map(tuple, near_dedup.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(1, a, "x"), (5, c, "z"), (1, b, "w"), (None, "one", "s"), (4, None, "n"), (4, "", "n")], key=repr)


def test_near_dedup_disjoint_texts_of_one_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    classes = {}
    for r in near_dedup._groups(docs, 85).collect():
        classes.setdefault((r["first"].doc_id, r["first"].th), []).append(r.doc_id)
    assert sorted(map(sorted, classes.values())) == [[1, 2], [1, 3]]
    assert {(r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect()} == {(1, a), (1, b)}
