"""Operators on small hostile tables against brute force, and on the smallest driver tables against SQL."""

import hashlib
import random
import zlib

import pytest
from helpers import SF, duck_rows, spark_rows

from mnemora.llm import chat_format, decontaminate, exact_dedup, language_id, mixing, near_dedup, quality, suffix_dedup, token_count, toxicity
from mnemora.llm import queries as llm

_rnd = random.Random(3)
_WORDS = [f"w{i}" for i in range(400)]


def passage(n):
    return " ".join(_rnd.choice(_WORDS) for _ in range(n))


BASE, LONG, SHARED = passage(200), passage(30_000), passage(60)
TEXTS = [
    None, "", "  ", "one", "one", BASE, BASE, BASE + " tail", "other " + SHARED + " " + passage(40), passage(40) + " " + SHARED, LONG, LONG + " end",
    "ÀÉ İß ｆ▁x", "\u0000", "a b c", "A B C", passage(49),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, repeats and columns that clash with names the operators use."""
    root = tmp_path_factory.mktemp("tables")
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], 5, "x", 1, "k") for i, t in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, words string, size int, key string"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{root}/documents.parquet")
    docs.limit(0).write.parquet(f"{root}/none/documents.parquet")
    bench = [(1, SHARED), (2, "one"), (3, None), (4, ""), (2, "one"), (5, passage(30))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame(bench[:0], "item_id long, text string").write.parquet(f"{root}/none/benchmark.parquet")
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{root}/labels.parquet")
    labels.limit(0).write.parquet(f"{root}/none/labels.parquet")
    talk = [(1, 0, "user", "hi <|im_end|> <\\|x|>"), (1, 1, "assistant", None), (1, 2, None, "t"), (2, 0, "assistant", "b%0A\n"), (1, 2, None, "t")]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(talk, schema).write.parquet(f"{root}/conversations.parquet")
    spark.createDataFrame(talk[:0], schema).write.parquet(f"{root}/none/conversations.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_sql_on_driver_tables(spark, name):
    assert spark_rows(llm.QUERIES[name](spark, SF)) == duck_rows(llm.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_sql_on_hostile_tables(spark, folder, name):
    assert spark_rows(llm.QUERIES[name](spark, folder)) == duck_rows(llm.ORACLE_SQL[name], folder)


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_empty_tables(spark, folder, name):
    got = llm.QUERIES[name](spark, f"{folder}/none").collect()
    assert len(got) == (1 if name == "op1_chat_format" else 0)


def test_chat_events_fold(spark):
    rows = [
        (1, 0, "message", "u", "user", "q"), (1, 1, "message", "a", "assistant", "wr"), (1, 2, "delta", "a", None, "ong"), (1, 3, "message", "u2", "user", "hm"),
        (1, 4, "regenerate", "a", None, "ri"), (1, 5, "delta", "a", None, "ght"), (1, 6, "edit", "u", None, "Q"), (1, 7, "message", "u3", "user", "<|im_start|>"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg_id string, role string, text string")
    got = chat_format.format_chats(events).select("formatted", "loss_spans", chat_format.parse(chat_format.F.col("formatted")).alias("t")).first()
    assert [(t.role, t.text) for t in got.t] == [("user", "Q"), ("assistant", "right"), ("user", "<|im_start|>")]
    assert got.formatted.count("<|im_start|>") == 3
    (span,) = got.loss_spans
    assert got.formatted[span.start : span.start + span.length] == "right"


def test_chunks_cover_texts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t], "text string")
    for r in df.select("text", exact_dedup.chunks(exact_dedup.F.col("text"), 8, 64).alias("c")).collect():
        assert "".join(r.c) == r.text


def test_refined_recipes_stay_exact(spark):
    docs = spark.createDataFrame([(1, BASE), (2, BASE), (3, BASE + "x"), (4, "")], "doc_id long, text string")
    ids = docs.select(exact_dedup.F.explode(exact_dedup.chunks(exact_dedup.F.col("text"))).alias("c")).select(exact_dedup.chunk_id(exact_dedup.F.col("c")).alias("id")).distinct()
    made = {r.doc_id: r.recipe for r in exact_dedup.refine(docs, ids).collect()}
    assert made[1] == made[2] != made[3] and made[4] == []


def test_token_counts_equal_the_library(spark, folder):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in llm.QUERIES["op3_token_count"](spark, folder).collect()}
    for i, t in enumerate(TEXTS):
        n = len(sp.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096)


def test_token_count_fuzz():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    sp = token_count.load("model", model)
    counts = token_count._Counts(token_count.prove_whole_tokens(model), sp.encode)
    parts = [" ", "  ", "\n", "▁", "the", "a", "é", "ﬁ", "<s>", "<0x0A>", "\t", "x", "1", "你", "\u0000", "ing", " of"]
    for _ in range(3000):
        text = "".join(_rnd.choice(parts) for _ in range(_rnd.randint(0, 40)))
        assert token_count.count_text(text, counts) == len(sp.encode(text)), repr(text)


def _held_out(name, spark, label, least):
    got = {r.doc_id: r for r in llm.QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
    truth = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    tested = [(got[i].predicted, y) for i, y in truth.items() if got[i].held_out]
    assert sum(p == y for p, y in tested) / len(tested) >= least


def test_quality_held_out(spark):
    _held_out("op4_quality", spark, "quality", 0.95)


def test_toxicity_held_out(spark):
    _held_out("op5_toxicity", spark, "toxic", 0.85)


def test_classifiers_answer_hostile_rows(spark, folder):
    for name in ("op4_quality", "op5_toxicity", "op9_language_id"):
        assert llm.QUERIES[name](spark, folder).count() == len(TEXTS)


def test_deobfuscation():
    import numpy as np

    counts = np.zeros(64**3, np.int64)
    raw = np.frombuffer(b" the idiot and the moron said stupid trash is worthless pathetic loser " * 50, np.uint8)
    c = toxicity._LUT[raw]
    np.add.at(counts, (c[:-2] * 64 + c[1:-1]) * 64 + c[2:], 1)
    r = toxicity.Restorer(toxicity.CharModel(counts).log)
    assert {"idiot", "moron", "loser", "stupid", "trash"} <= r.words("1d10t m0r0n l.o.s.e.r stuuupiiid tr@sh") | r.words("an i d i o t")
    assert r.words("ERTION!! THER$$$ plain.") == {"ertion", "ther", "plain"}


def test_language_held_out(spark):
    rows = llm.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = rows.collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) >= 0.97
    model = language_id.learn([], [])
    assert model.predict("abc") == ("und", 0.0)


def test_fingerprints_without_broadcast(spark, folder):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    order = ("doc_id", "th", "n_words", "n_hit", "contaminated")
    one, two = (sorted(map(tuple, decontaminate.contamination(docs, items, n).select(*order).collect())) for n in (10_000, 0))
    assert one == two


def test_mix_meets_targets(spark):
    rows = mixing.op8_mix(spark, "/root/testdata/sf0.01").collect()
    by = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert target >= 0 and abs(sum(taken) - target) <= 0.05 * target + 3000
    assert abs(sum(t for _, t in by) - 1.5 * sum(r.size for r in rows)) < 1


def _filled(sizes, weights, share=1.5, cap=2.0):
    """Targets by sharing the excess again until none is above its cap."""
    total, full = share * sum(sizes), set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(cap * sizes[i] for i in full)
        out = [cap * sizes[i] if i in full else left * weights[i] / sum(weights[k] for k in rest) for i in range(len(sizes))]
        over = {i for i in rest if out[i] > cap * sizes[i] + 1e-9}
        if not over:
            return out
        full |= over


def test_targets_by_resharing(spark):
    for _ in range(4):
        sizes = [_rnd.choice([0, 1, 5, 40, 1000, 7]) for _ in range(7)]
        rows = [(n, " ".join(["w"] * sizes[n]), f"s{n}") for n in range(7)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = {r.doc_id: r.target for r in mixing.plan_copies(docs).collect()}
        want = _filled(sizes, [[5.0, 2.0, 1.0][i % 3] for i in range(7)])
        assert all(abs(got[i] - want[i]) < 1e-6 for i in range(7)), (sizes, got, want)


def test_near_links_are_whole(spark):
    """A hub, copies at all distances, and a chain: components equal brute force."""
    base = passage(300).split()
    texts = []
    for i in range(120):
        ws = list(base)
        for _ in range(i // 4):
            ws[_rnd.randrange(len(ws))] = f"z{_rnd.randrange(10**6)}"
        texts.append(" ".join(ws))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in range(len(texts))}


def test_passages(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = {(r.doc_id, r.n_words) for r in suffix_dedup.repeated_passages(docs).collect()}
    assert (8, 60) in rows and (9, 60) in rows and not any(d == 16 for d, _ in rows)


def test_quality_model_handles_one_class():
    import numpy as np

    assert quality.learn(np.zeros((3, quality.N_FEATURES)), np.ones(3)) is None
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
