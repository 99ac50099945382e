"""Token counts with the whole-token shortcut.

Offline, on the driver, each vocabulary string that the tokenizer encodes alone
as one token is proven to do so; these strings are counted as one wherever a
pre-token equals one of them. Only the other pre-tokens are merged by the
library, once per worker for each distinct one (a bounded cache).

The shortcut needs pre-tokens whose borders no merge crosses. For sentencepiece
models this is proven from the vocabulary: an identity normaliser, no
user-defined pieces, and no piece with the space mark after another character
or with a line feed inside. Where the proof fails, and for tokenizers ``.json``
files, whole texts go to the library.

Null text counts as empty and has 0 tokens. Every row of the input gives one
row; repeated rows repeat. Extra columns are ignored. Texts of any length are
cut at pre-token borders and counted piece by piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import table

SPACE = "▁"
LIMIT, CACHE, PIECE = 4096, 400_000, 1 << 20
_RUNS = re.compile(r" +[^ ]*")
_workers: dict = {}


def load(kind: str, model: bytes):
    if kind == "json":
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(model.decode("utf-8"))
        made.no_padding()
        made.no_truncation()
        return made
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def prove_whole_tokens(model: bytes) -> list[str] | None:
    """Strings that encode alone as one token, or None if pre-tokens can't be told apart safely."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    spec, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
    normal = [p.piece for p in proto.pieces if p.type == 1]
    safe = (
        spec.name == "identity" and not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces
        and not spec.remove_extra_whitespaces and proto.trainer_spec.model_type == 2 and kinds <= {1, 2, 3, 6}
        and not proto.trainer_spec.treat_whitespace_as_suffix
        and not any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in normal)
    )
    if not safe:
        return None
    alone = [p[1:] for p in normal if p.startswith(SPACE) and SPACE not in p[1:] and len(p) > 1]
    encoded = load("model", model).encode(alone, num_threads=1)
    return [s for s, ids in zip(alone, encoded, strict=True) if len(ids) == 1]


class _Counts(dict):
    """Tokens of a pre-token (its first space mark left out)."""

    def __init__(self, whole: list[str], encode) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.encode, self.fixed, self.tails, self[""] = encode, len(whole) + 1, {}, 1

    def __missing__(self, key: str) -> int:
        if "\n" in key:  # no piece crosses a line feed: the rest of each line is counted behind one
            first, *rest = key.split("\n")
            return self[first] + sum(map(self.tail, rest))
        n = len(self.encode(key))
        if len(self) < self.fixed + CACHE:
            self[key] = n
        return n

    def tail(self, part: str) -> int:
        n = self.tails.get(part)
        if n is None:
            n = len(self.encode("\n" + part)) - 1  # without the dummy prefix
            if len(self.tails) < CACHE:
                self.tails[part] = n
        return n


def _slices(text: str) -> Iterator[str]:
    """Parts of a long text, each but the first beginning with the space that begins a pre-token."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.find(" ", at + PIECE)
        while 0 < cut and text[cut - 1] == " ":
            cut -= 1
        if cut <= at:
            cut = next((m.start() for m in re.compile(r"(?<! ) ").finditer(text, at + PIECE)), -1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_text(text: str, counts: _Counts) -> int:
    if not text:
        return 0
    text, total, get = text.replace(SPACE, " "), 0, counts.__getitem__
    for k, part in enumerate(_slices(text)):
        part = part if k == 0 else part[1:]  # that space is the pre-token's own mark, as the dummy prefix is the first one's
        if "  " in part or part.startswith(" "):
            total += sum(get(run[1:]) for run in _RUNS.findall(" " + part))
        else:
            total += sum(map(get, part.split(" ")))
    return total


def _counter(key, kind: str, model: bytes, whole: list[str] | None):
    if key not in _workers:
        _workers.clear()
        tokenizer = load(kind, model)
        if kind == "json":
            _workers[key] = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids) if text else 0
        elif whole is None:
            _workers[key] = lambda text: len(tokenizer.encode(text)) if text else 0
        else:
            counts = _Counts(whole, tokenizer.encode)
            _workers[key] = lambda text: count_text(text, counts)
    return _workers[key]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``; ``path``: a ``.model`` or ``.json`` file on the driver."""
    spark = docs.sparkSession
    with open(path, "rb") as f:
        model = f.read()
    kind = "json" if path.endswith(".json") else "model"
    whole = None if kind == "json" else prove_whole_tokens(model)
    sent = spark.sparkContext.broadcast((model, whole))  # the tokenizer's file: its size doesn't depend on the data
    key = (path, hash(model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _counter(key, kind, *sent.value)
        for batch in batches:
            n = [one(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    made = rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return made.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
