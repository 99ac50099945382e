"""Places where an operator once did less than the whole job."""

import functools
import itertools
import random
import time
import zlib

import numpy as np

from mnemora.llm import mixing, quality, toxicity


def _restorer(text):
    counts = np.zeros(64**3, np.int64)
    c = toxicity._LUT[np.frombuffer(text.encode() * 50, np.uint8)]
    np.add.at(counts, (c[:-2] * 64 + c[1:-1]) * 64 + c[2:], 1)
    return toxicity.Restorer(toxicity.CharModel(counts).log)


def test_long_spans_are_decoded():
    r = _restorer(" you are a stupid worthless idiot and the moron said stupid trash is pathetic ")
    said = "you are a stupid worthless idiot and the moron said stupid trash"
    assert len(said.replace(" ", "")) > 41
    assert {"stupid", "worthless", "idiot", "moron", "trash"} <= r.words(" ".join(said.replace(" ", "")))
    assert "stupid" in r.words("st" + "u" * 60 + "pid")
    assert r.words("st0pid" * 10) != {"st", "pid"}
    began = time.monotonic()
    for n in (1, 200):
        r.words(" ".join("stupid" * 50 * n))
    assert time.monotonic() - began < 30  # linear: 60000 letters


def test_heavily_substituted_tokens_are_decoded():
    r = _restorer(" you ass hole the asshole will kill and piss on this shit i hate a worthless loser bitch ")
    said = {"a$$": "ass", "ki11": "kill", "pi$$": "piss", "w0r7h1355": "worthless", "$h17": "shit", "h473": "hate", "4$$h0l3": "asshole", "@$$h0l3": "asshole", "10$3r": "loser", "@$$#0|3": "asshole"}
    assert {t: r.words(t) for t in said} == {t: {w} for t, w in said.items()}
    assert r.words("2019 $100 100 loser!! kill! (see ***you***") == {"loser", "kill", "see", "you"}
    assert r.words("will,10$3r") == {"will", "loser"}


def test_quality_cut_does_not_depend_on_the_cap(spark, monkeypatch):
    """One text in seven is bad and scores overlap: the share under the cut stays, whatever the sample."""
    rnd = random.Random(5)
    rows = [(i, int(i % 7 != 0)) for i in range(2100)]
    texts = [(i, " ".join(rnd.choice(["word", "text"] if rnd.random() < (0.6 if y else 0.5) else ["!!!", "***"]) for _ in range(40))) for i, y in rows]
    docs = spark.createDataFrame(texts, "doc_id long, text string").cache()
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    monkeypatch.setattr(quality, "labelled_sample", functools.partial(quality.labelled_sample, per_class=150))
    ranker = quality.fit(docs, labels)
    low = sum(ranker.score(t) < quality.THRESHOLD for _, t in texts) / len(texts)
    assert abs(low - 1 / 7) < 0.06, low


def test_quality_learns_from_all_labelled_rows(spark, monkeypatch):
    """With parts of 40 rows a label: every row is in a part, each part has both labels, and the cut is the exact quantile of all rows."""
    rnd = random.Random(6)
    rows = [(i, int(i % 7 != 0)) for i in range(2100)]
    texts = [(i, " ".join(rnd.choice(["word", "text"] if rnd.random() < (0.6 if y else 0.5) else ["!!!", "***"]) for _ in range(40))) for i, y in rows]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, quality int")
    seen = []
    sample = functools.partial(quality.labelled_sample, per_class=40)
    monkeypatch.setattr(quality, "labelled_sample", lambda df: seen.append(df) or sample(df))
    dealt = sample(quality.labelled_rows(labels, "quality")).collect()
    learned = [(i, y) for i, y in rows if zlib.crc32(str(i).encode()) % 5]
    assert {(r.doc_id, r.y) for r in dealt} == set(learned)
    for part in range(max(r.part for r in dealt) + 1):
        n = [sum(r.part == part and r.y == y for r in dealt) for y in (0, 1)]
        assert min(n) >= 20 and max(n) <= 120
    ranker = quality.fit(docs, labels)
    low = sum(ranker.score(texts[i][1]) < quality.THRESHOLD for i, _ in learned)
    assert seen and low == sum(y == 0 for _, y in learned)


def test_mix_gives_equal_rows_their_copies(spark):
    """Repeated rows, rows without an id, and rows of their own: the copies planned are the rows given."""
    rows = [(7, "a b c", "big")] * 500 + [(None, f"t{i} x", "big") for i in range(300)] + [(1000 + i, "y z", "big") for i in range(40)]
    rows += [(5000 + i, "w", "small") for i in range(90)] + [(None, "w", "small")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((1.0, 50.0), (5.0, 2.0)):
        planned, given = {}, {}
        for r in mixing.plan_copies(docs, weights=weights).collect():
            planned[r.doc_id, r.sk, r.size] = planned.get((r.doc_id, r.sk, r.size), 0) + r.copies
        made = mixing.mix(docs, weights=weights)
        assert made.columns == ["doc_id", "text", "source", "copy"]
        for r in made.collect():
            key = r.doc_id, "0" + r.source, len(r.text.split())
            given[key] = given.get(key, 0) + 1
        assert given == {k: n for k, n in planned.items() if n}


def _all_paths(steps, log):
    """The least cost of all paths, each spelt out and read as a whole, and the readings that have it."""
    best, found = None, set()
    for path in itertools.product(*steps):
        cost, stayed, x, y = 0.0, False, 0, 0
        for reading, first, later in [*path, (" ", 0.0, 0.0)]:
            cost += later if stayed else first
            stayed = reading == toxicity.HELD if reading else stayed
            for z in (toxicity._CODES[b] for b in reading.encode()):
                if y or z:
                    cost -= log[(x * 64 + y) * 64 + z]
                    x, y = y, z
        if best is None or cost < best - 1e-9:
            best, found = cost, set()
        if cost <= best + 1e-9:
            found.add("".join(reading for reading, *_ in path))
    return found


def test_decode_takes_the_best_of_all_paths():
    r = _restorer(" you are a stupid worthless idiot and the moron said stupid trash is pathetic so die you ass in a fire ")
    rnd = random.Random(9)
    for k in range(400):
        spaced = k % 2 == 1
        if spaced:
            pieces = ["".join(rnd.choice("stupida10$!*e") for _ in range(rnd.randint(1, 2))) for _ in range(rnd.randint(3, 4))]
            span = pieces[0] + "".join(rnd.choice([".", "-", "..", "_-"]) + p for p in pieces[1:])
        else:
            span = "".join(rnd.choice("stupid1140$!|aae") * rnd.choice([1, 1, 2, 3]) for _ in range(rnd.randint(1, 5)))
        steps = toxicity.lattice(span, spaced)
        assert toxicity.decode(steps, r.costs) in _all_paths(steps, r.costs), span


def test_pieces_with_any_gaps_are_decoded():
    r = _restorer(" you are a stupid worthless idiot and the moron said stupid trash is pathetic ass die in a fire so die ass you kill the ass ")
    said = {
        "a s s": "ass", "d i e": "die", "s  t  u  p  i  d": "stupid", "s.t-u.p-i.d": "stupid", "st.up.id": "stupid", "s*t*u*p*i*d": "stupid", "s t * p i d": "stupid",
        "a.s.s": "ass", "st-u-p1d": "stupid", "s _ t _ u _ p _ i _ d": "stupid", "s.t.u p.i.d": "stupid", "i d i 0 t": "idiot",
    }
    assert {t: r.words(t) for t in said} == {t: {w} for t, w in said.items()}
    assert r.words("the.idiot.said") == {"the", "idiot", "said"} and r.words("you (d i e) are") == {"you", "die", "are"}


def test_the_screen_misses_no_spaced_text():
    rnd = random.Random(10)
    parts = ["a", "i", "é", "st", "upi", "word", "1", "$", "*", " ", " ", "  ", ".", "-", "_", "~", "(", ",", "\u4e2d", "\U0001f600", "\n"]
    seen = 0
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        if toxicity._SPACED.search(text):
            seen += 1
            assert toxicity.may_be_spaced(text), text
    assert seen > 500 and not toxicity.may_be_spaced("there is a word, a été and of the 3 in it. U.S")
