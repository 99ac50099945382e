"""Column functions on text: tokens, Markdown parts, clips, slugs, predicates.

All are built-in expressions; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.functions import fixed


def whole_words(pattern: str) -> str:
    """``pattern`` between word boundaries of any script, in a form that Java and RE2 read alike."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{pattern})(?:$|[^\p{{L}}\p{{N}}_])"


NEGATION = rf"(?i)(?:{'|'.join(fixed.NEGATIONS)})"
IMPERATIVE = whole_words(fixed.IMPERATIVES)
ACKNOWLEDGEMENT = rf"(?i)^(?:{fixed.ACKNOWLEDGEMENTS})$"


def strip(text: Column) -> Column:
    """White space at both ends taken off."""
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, an ellipsis for what is cut."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def frontmatter(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*\n?", 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*\n?", "")


def field(fm: Column, key: str) -> Column:
    """A scalar of the frontmatter, quotes and blanks stripped; null if absent or empty."""
    raw = F.regexp_extract(fm, rf"(?m)^{key}:[ \t]*(.+?)[ \t]*$", 1)
    return F.nullif(F.trim(F.regexp_replace(raw, r"^[\"']|[\"']$", "")), F.lit(""))


def title(text: Column, stem: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(body(text), r"(?m)^#[ \t]+(.+?)[ \t]*$", 1), F.lit("")), stem)


def summary(text: Column) -> Column:
    return F.regexp_extract(body(text), r"(?mi)^One-sentence summary:[ \t]*(.+?)[ \t]*$", 1)


def wikilinks(text: Column) -> Column:
    """Targets of ``[[target]]`` and ``[[target|alias]]``; a target with ``#`` is none."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]\|#]+?)(?:\|[^\]]+)?\]\]"), F.lit(1))


def section(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"(?ms)^##[ \t]*{name}[ \t]*$\n(.*?)(?=\n##[ \t]|\z)", 1)


def content_words(text: Column) -> Column:
    """Words outside blank lines, rules and headings."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("---") & ~F.trim(x).startswith("#"))
    return F.size(tokens(F.array_join(lines, "\n"))).cast("long")


def slug(text: Column, limit: int = 60) -> Column:
    """Lower-case words joined by hyphens, cut, and six hex digits of the hash."""
    base = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_]+", "-")
    base = F.regexp_replace(base, r"^[-_]+|[-_]+$", "")
    base = F.regexp_replace(F.substring(base, 1, limit - 7), r"[-_]+$", "")
    tail = F.substring(F.sha2(text, 256), 1, 6)
    return F.when(base == "", tail).otherwise(F.concat(base, F.lit("-"), tail))


def title_words(text: Column, stop: tuple[str, ...] = fixed.TITLE_STOP) -> Column:
    """Distinct lower-case words split at blanks, stop words left out."""
    return F.array_except(F.array_distinct(F.filter(F.split(F.lower(text), " "), lambda t: t != "")), F.array(*[F.lit(s) for s in stop]))


#: The families of secrets, in the order they are replaced.
SECRET_PATTERNS = (
    ("pem", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("bearer", r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{16,}=*"),
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{30,}"),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("aws", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    ("key", r"\bsk-[A-Za-z0-9_-]{20,}"),
    ("payment", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("registry", r"\b(?:npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{32,})"),
    ("url", r"\b[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@"),
    ("assigned", r"(?i)\b(?:api[_-]?key|token|secret|password|passwd)\b\s*[=:]\s*[\"']?[A-Za-z0-9+/_.-]{16,}[\"']?"),
)


#: What a text must hold, small letters taken, for a family to match; a plain search is far cheaper than a pattern.
_MARKS = {
    "pem": ("-----begin",), "jwt": ("eyj",), "bearer": ("bearer",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "slack": ("xox",), "aws": ("akia", "asia"),
    "google": ("aiza",), "key": ("sk-",), "payment": ("k_live_", "k_test_"), "registry": ("npm_", "pypi-"), "url": ("://",),
    "assigned": ("key", "token", "secret", "passw"),
}

#: A token of no known family is a secret from this entropy (bits a character) on, if it mixes digits, capitals and small letters.
ENTROPY, TOKEN = 4.0, r"[A-Za-z0-9+/_=-]{20,}"


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def entropy(token: Column) -> Column:
    """Shannon entropy of a token's characters, in bits."""
    n = F.length(token)
    share = lambda c: (n - F.length(F.replace(token, c, F.lit("")))) / n
    parts = F.transform(F.array_distinct(F.filter(F.split(token, ""), lambda c: c != "")), lambda c: share(c) * F.log2(share(c)))
    return F.round(-F.aggregate(F.array_sort(parts), F.lit(0.0), lambda a, x: a + x), 9)


def _known(text: Column, low: Column) -> Column:
    """The families replaced, each where its marks are; ``low`` is the text in small letters, which replacements add no mark to."""
    for name, pattern in SECRET_PATTERNS:
        marks = [F.contains(low, F.lit(m)) for m in _MARKS[name]]
        there = marks[0]
        for m in marks[1:]:
            there = there | m
        text = _once(text, _replacing(there, pattern, f"[REDACTED:{name}]"))
    return text


def _replacing(there: Column, pattern: str, by: str):
    return lambda t: F.when(there, F.regexp_replace(t, pattern, by)).otherwise(t)


def _random(text: Column) -> Column:
    """Tokens of high entropy replaced, longest first."""
    mixed = lambda t: t.rlike("[0-9]") & t.rlike("[A-Z]") & t.rlike("[a-z]")
    odd = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), lambda t: mixed(t) & (entropy(t) >= ENTROPY))
    longest = F.array_sort(F.transform(odd, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.aggregate(longest, text, lambda acc, x: F.replace(acc, x["t"], F.lit("[REDACTED:entropy]")))


def redact(text: Column) -> Column:
    """Secrets replaced by ``[REDACTED:family]``, first known families, then tokens of high entropy; prose and bare hexadecimal digests stay."""
    known = _once(F.struct(text.alias("t"), F.lower(text).alias("low")), lambda x: _known(x["t"], x["low"]))
    return _once(known, lambda t: F.when(t.rlike(TOKEN), _random(t)).otherwise(t))


def feedback_family(text: Column) -> tuple[Column, Column]:
    """(family, confidence): the first family that matches, 0.9 if two do; null under ten characters and for acknowledgements."""
    hits = [text.rlike(whole_words(p)) for _, p in fixed.FEEDBACK_FAMILIES]
    count = sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))
    live = (F.length(strip(text)) >= 10) & ~strip(text).rlike(ACKNOWLEDGEMENT)
    name = F.lit(None).cast("string")
    for (family, _), hit in reversed(list(zip(fixed.FEEDBACK_FAMILIES, hits, strict=True))):
        name = F.when(hit, family).otherwise(name)
    return F.when(live, name), F.when(live & (count >= 2), 0.9).when(live & (count == 1), 0.7)


def is_noise(line: Column) -> Column:
    """Blank lines and those that carry only metadata."""
    out = strip(line) == ""
    for pattern in fixed.NOISE_LINES:
        out = out | line.rlike(pattern)
    return out


def is_mojibake(line: Column) -> Column:
    """Marks of a wrong code page make up a set share of the line."""
    marks = [(F.length(line) - F.length(F.replace(line, F.lit(m), F.lit("")))) / len(m) for m in fixed.MOJIBAKE]
    hits = sum(marks[1:], marks[0])
    return (hits > 0) & (hits >= fixed.MOJIBAKE_SHARE * F.length(line))


def authority_weight(authority: Column) -> Column:
    weight = F.lit(1.0)
    for name, w in fixed.AUTHORITY.items():
        weight = F.when(F.lower(strip(authority)) == name, w).otherwise(weight)
    return weight


def known_type(kind: Column) -> Column:
    """The type, its canonical name for an alias, null for a type out of the domain."""
    for alias, name in fixed.TYPE_ALIASES.items():
        kind = F.when(kind == alias, name).otherwise(kind)
    return F.when(kind.isin(*fixed.TYPES), kind)


def open_at(valid_to: Column, day: Column) -> Column:
    """Valid at ``day``: no end, an open end, or an end not before it."""
    end = F.lower(F.regexp_replace(strip(valid_to), r"^[\"']+|[\"']+$", ""))
    return valid_to.isNull() | end.isin("", "null", "none", "~") | (F.substring(end, 1, 10) >= F.substring(day, 1, 10))
