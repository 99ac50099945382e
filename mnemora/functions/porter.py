"""Porter's suffix stripping (1980) for index terms.

Spark has no stemmer; ``stems`` runs on the distinct terms of a table only, in
Arrow batches, so its cost grows with the vocabulary.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")
#: Suffixes of steps 2, 3 and 4 of the algorithm with what replaces them.
_STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
_STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c+", _shape(stem)))


def _cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _longest(word: str, rules: tuple[tuple[str, str], ...]) -> tuple[str, str] | None:
    hits = [r for r in rules if word.endswith(r[0])]
    return max(hits, key=lambda r: len(r[0])) if hits else None


def porter(word: str) -> str:
    """The stem of a lower-case word; words of under three or with other letters than a-z stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + new
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix):
                if "v" in _shape(stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _cvc(word)):
                        word += "e"
                    elif _double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP_2, _STEP_3):
        hit = _longest(word, rules)
        if hit and _measure(word[: -len(hit[0])]) > 0:
            word = word[: -len(hit[0])] + hit[1]
    hit = _longest(word, tuple((s, "") for s in _STEP_4))
    if hit:
        stem = word[: -len(hit[0])]
        if _measure(stem) > 1 and (hit[0] != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def plain(term: str) -> str:
    """Without the marks of its letters."""
    return "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c))


def stems(terms: DataFrame, stem: bool = True) -> DataFrame:
    """(term, stem) for the distinct terms of a one-column table; terms of marks alone have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bare = [plain(t) for t in batch.column(0).to_pylist()]
            made = pa.array([porter(b) if stem else b for b in bare], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["term", "stem"])

    return terms.toDF("term").distinct().mapInArrow(run, "term string, stem string").where("stem <> ''")
