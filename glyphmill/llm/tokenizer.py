"""Encoding of a corpus with a public byte-level BPE tokenizer, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrow import flat_map

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in parts.
PART = 50_000

# No piece of PATTERN reaches over these: white space begins after something else, or letters, digits and others meet
# (away from apostrophes, which may begin a piece with letters).
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=[\p{L}])(?=[^\s\p{L}'])|(?<=[\p{N}])(?=[^\s\p{N}'])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> list[str]:
    """`text` in parts of about `size` characters, cut only where no piece of the pattern reaches over."""
    out, start = [], 0
    while len(text) - start > size and (m := _SAFE.search(text, start + size)):
        if m.start() >= len(text):
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def encode(text: str | None, path: str = RANKS) -> list[int]:
    """Ids of a text; none for a null or empty text."""
    if not text:
        return []
    e = _encoding(path)
    return e.encode_ordinary(text) if len(text) <= PART else [i for p in parts(text) for i in e.encode_ordinary(p)]


def decode(ids: Iterable[int], path: str = RANKS) -> str:
    """The text of `ids`, joined as raw bytes first, as one character may be spread over several ids."""
    return _encoding(path).decode_bytes(list(ids)).decode("utf-8")


def encode_corpus(docs: DataFrame, doc_id: str, text: str, path: str = RANKS) -> DataFrame:
    """(doc_id, ids) of every row. Null and empty texts have no ids (an empty list, never null)."""

    def make():
        return lambda keys, texts: ((k, encode(t, path)) for k, t in zip(keys, texts, strict=True))

    return flat_map(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id bigint, ids array<int>", make)


def decode_corpus(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def make():
        return lambda keys, lists: ((k, None if x is None else decode(x, path)) for k, x in zip(keys, lists, strict=True))

    return flat_map(encoded.select("doc_id", "ids"), "doc_id bigint, text string", make)
