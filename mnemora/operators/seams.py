"""Where models and callbacks plug in: text models with several back-ends, embedding models, processors.

Nothing here calls a network; a back-end is a probe and a call that the user
passes. Models run in Python workers, in Arrow batches, one client a batch.
"""

from __future__ import annotations

import importlib
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Call = Callable[[str, str, int], str]


@dataclass(frozen=True)
class Backend:
    """A text model: whether it is there now, and its answer to (prompt, system prompt, most tokens)."""

    name: str
    probe: Callable[[], bool]
    call: Call


def fake(reply: str) -> Backend:
    """A model that always answers the same, for tests."""
    return Backend("fake", lambda: True, lambda prompt, system, most: reply)


@dataclass(frozen=True)
class Model:
    """Back-ends in the order in which they are tried; ``only`` names one that alone may answer.

    The answer is empty for an empty prompt and None when no back-end answers.
    A back-end that fails or says nothing passes on to the next.
    """

    backends: tuple[Backend, ...]
    only: str | None = None

    def __call__(self, prompt: str, system: str = "", most: int = 2000) -> str | None:
        if not prompt or not prompt.strip():
            return ""
        names = {b.name for b in self.backends}
        for backend in self.backends:
            if self.only in names and backend.name != self.only:
                continue
            try:
                reply = backend.call(prompt, system, most) if backend.probe() else ""
            except Exception:  # noqa: BLE001 - whatever a back-end raises, the next one is asked
                continue
            if reply and reply.strip():
                return reply.strip()
        return None


def ask(prompts: DataFrame, column: str, model: Callable[[], Model], system: str = "", most: int = 2000, out: str = "reply") -> DataFrame:
    """``prompts`` with the model's answer to each (null: none). ``model`` makes a client in each worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for frame in frames:
            frame[out] = [client(p or "", system, most) for p in frame[column]]
            yield frame

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField(out, T.StringType())]))


CLASSIFY = "Decide how much of this session lasts. First line: FLUSH_MAJOR, FLUSH_MINOR or FLUSH_OK. Then, unless OK, decisions, lessons and gotchas as bullets.\n\n"
ANSWER = "Answer the question from this index of pages alone. Name the pages you use under **Sources:**, and say so if none helps.\n\n"
ADVISE = "Say in two or three sentences what deserves attention next.\n\n"


def classify(sessions: DataFrame, text: str, model: Callable[[], Model]) -> DataFrame:
    """Sessions with tier and body; secrets are removed before the model sees them. No answer counts as ok, like a failed one."""
    from mnemora.functions import replies
    from mnemora.functions.text import redact

    rows = sessions.withColumn("prompt", F.concat(F.lit(CLASSIFY), redact(F.col(text))))
    told = ask(rows, "prompt", model, most=1500).drop("prompt")
    got = replies.tier(F.col("reply"))
    return told.select(*sessions.columns, got["tier"].alias("tier"), got["body"].alias("body"))


def answer(questions: DataFrame, index: str, model: Callable[[], Model]) -> DataFrame:
    """(question, reply): the model sees the catalogue's text and no page."""
    rows = questions.select("question", F.concat(F.lit(ANSWER + index + "\n\n--- question ---\n"), "question").alias("prompt"))
    return ask(rows, "prompt", model, most=1500).select("question", F.coalesce("reply", F.lit("(no LLM response)")).alias("reply"))


def advise(block: str, model: Model, limit: int = 800) -> str:
    """A rule-made block with the model's insight before it; the block alone if there is no answer."""
    told = model(ADVISE + block, most=200) if block else ""
    if not told:
        return block
    text = f"**Insight:** {told}\n\n{block}"
    return text if len(text) <= limit else text[: limit - 20].rstrip() + "..."


def load_embedder(module: str = "sentence_transformers", name: str = "all-MiniLM-L6-v2"):
    """A sentence embedder with ``encode``; None where the module isn't installed, and search is then lexical."""
    try:
        return importlib.import_module(module).SentenceTransformer(name)
    except (ImportError, AttributeError, OSError):
        return None


class HashedEmbedder:
    """Unit vectors of hashed words and letter triples; needs no weights."""

    def __init__(self, size: int = 384) -> None:
        self.size = size

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.size
            for word in text.lower().split():
                for part in (word, *(f"#{word}#"[i : i + 3] for i in range(len(word)))):
                    vector[zlib.crc32(part.encode()) % self.size] += 1.0
            norm = math.sqrt(sum(v * v for v in vector)) or 1.0
            out.append([v / norm for v in vector])
        return out


def embed(make: Callable[[], object]) -> Callable[[Column], Column]:
    """A column function that embeds texts; ``make`` gives the embedder, once a worker's batch iterator."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series([[float(v) for v in vector] for vector in model.encode(list(batch.fillna("")))])

    return run


def context_tool(spark, block: DataFrame) -> str:
    """What an agent's ``context`` tool returns: the session-start block."""
    row = block.first()
    return row[0] if row else ""


def recall_tool(index, query: str, limit: int = 5, **options) -> list[dict]:
    """What an agent's ``recall`` tool returns: the first results of one query, blank queries none."""
    from mnemora.operators.search import search

    if not query or not query.strip():
        return []
    spark = index.pages.sparkSession
    asked = spark.createDataFrame([(0, query)], "qid int, query string")
    return [r.asDict() for r in search(index, asked, limit, **options).orderBy("rank").collect()]
