"""Places for models from outside: embedders, annotators, language models for cleaning, speech. Each gets batches of rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from glyphmill.functions import text as T
from glyphmill.operators.chunking import pack

DIMENSIONS = 64


class Transcriber(Protocol):
    """Speech to text."""

    def __call__(self, audio: bytes, language: str) -> str: ...


class Synthesizer(Protocol):
    """Text to speech; gives the bytes of a WAV file."""

    def __call__(self, text: str, voice: str, rate: int, volume: int) -> bytes: ...


class Translator(Protocol):
    def __call__(self, text: str, source: str, target: str) -> str: ...


def embedder(model: Callable[[list[str]], Iterable[Iterable[float]]]) -> Callable[[Column], Column]:
    """A column function from a model that embeds a batch of texts. Null texts have no vector."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        given = texts.dropna()
        return pd.Series([list(map(float, v)) for v in model(list(given))], index=given.index, dtype=object).reindex(texts.index).where(texts.notna(), None)

    return run


_WORD = re.compile(T.ALPHABETS["en"])


@lru_cache(maxsize=200_000)
def _place(word: str) -> tuple[int, float]:
    """A hash of the word, and 1 or -1. The memory of words only saves time."""
    h = hashlib.md5(word.encode()).hexdigest()
    return int(h[:6], 16), 1.0 if h[6] < "8" else -1.0


def _hashed(text: str, dimensions: int) -> list[float]:
    vector = [0.0] * dimensions
    for w in _WORD.findall(text):
        h, sign = _place(w)
        vector[h % dimensions] += sign
    return vector


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A vector without a model, in one pass over the words: each adds 1 or -1 at a hashed place. A text without words has zeros."""
    return embedder(lambda texts: [_hashed(t, dimensions) for t in texts])(F.lower(text))


def backfill(docs: DataFrame, key: str, text: str, vectors: DataFrame, vector_key: str, vector: str, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """(key, embedding, stored): the stored vector of each document, else one that is computed; only missing ones are.

    `vectors` has one row per key. A document with neither vector nor text has a null embedding. `embed` gets a null text
    for documents that have a vector.
    """
    known = vectors.select(F.col(vector_key).alias(key), F.col(vector).cast("array<double>").alias("_vector")).filter("_vector is not null")
    d = docs.select(key, F.col(text).alias("_text")).join(known, key, "left")
    missing = F.col("_vector").isNull()
    return d.select(key, F.coalesce("_vector", embed(F.when(missing, F.col("_text")))).alias("embedding"), (~missing).alias("stored"))


_TOKEN = StructType([StructField("i", IntegerType()), *[StructField(n, StringType()) for n in ("text", "lemma", "pos", "tag", "dep")], StructField("head", IntegerType())])


def annotator(model: Callable[[str], Iterable[dict]]) -> Callable[[Column], Column]:
    """A column function from a parser of sentences: array of (i, text, lemma, pos, tag, dep, head). Null sentences have none."""

    @F.pandas_udf(ArrayType(_TOKEN))
    def run(sentences: pd.Series) -> pd.Series:
        return sentences.map(lambda s: None if s is None else [{n: t.get(n) for n in _TOKEN.names} for t in model(s)])

    return run


def cleaned_by(model: Callable[[str], str], limit: int = 12_000, least: int = 100, share: float = 0.4) -> Callable[[Column], Column]:
    """A column function that has a language model clean texts in chunks of `limit` characters.

    A text whose answer is shorter than `least` characters or than `share` of it, or whose model fails, is cleaned by
    rules instead; so is one that needs no model.
    """

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not t:
                return t
            try:
                answer = "\n\n".join(model(chunk).strip() for chunk in pack(t, limit)).strip()
            except Exception:  # whatever the model fails with
                return None
            return answer if len(answer) >= max(least, share * len(t)) else None

        return texts.map(one)

    return lambda text: F.coalesce(run(F.when(T.is_dirty(text), T.clean(text))), T.clean(text))
