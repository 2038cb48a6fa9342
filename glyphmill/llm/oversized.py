"""Splitting oversized items at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrow import flat_map

# Sentence marks that need white space after them, marks that don't, and closers.
SPACED_MARKS = ".!?…।؟"
FREE_MARKS = "。！？"
CLOSERS = "\"'”’»“)]」』）"

_BREAK = re.compile(r"\r?\n")
_MARK = re.compile(f"[{SPACED_MARKS}][{re.escape(CLOSERS)}]*(?=[ \t\r\n])|[{FREE_MARKS}][{re.escape(CLOSERS)}]*")


def _last(places: list[int], low: float, high: int) -> int | None:
    k = bisect_right(places, high) - 1
    return places[k] if k >= 0 and places[k] >= low else None


def boundary_levels(text: str) -> list[list[int]]:
    """Places directly behind a blank line, a line break, a sentence mark with its closers; ascending."""
    blank, line, before = [], [], -1
    for m in _BREAK.finditer(text):
        if m.start() == before:
            blank.append(m.end())
        before = m.end()
        line.append(before)
    return [blank, line, [m.end() for m in _MARK.finditer(text)]]


def split_at_boundaries(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of at most `limit` characters, each cut at the best boundary in the window's second half."""
    if len(text) <= limit:
        return [(0, len(text))]
    levels, pieces, start = boundary_levels(text), [], 0
    while len(text) - start > limit:
        low, high, end = start + limit / 2, start + limit, None
        for places in levels:
            end = _last(places, low, high)
            if end is not None:
                break
        if end is None:
            k = text.rfind(" ", start, high) + 1
            end = k if k and k >= low else high
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, len(text)))
    return pieces


_GEAR = np.random.default_rng(20240).integers(0, 2**63, 4096, dtype=np.uint64)
_REACH = 24


def landmarks(text: str, mean: int) -> np.ndarray:
    """Places whose preceding characters hash to a landmark, about one in `mean`; they depend on _REACH characters only."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    values, rolling = _GEAR[codes % len(_GEAR)], np.zeros(len(codes), dtype=np.uint64)
    for k in range(min(_REACH, len(codes))):
        rolling[k:] += values[: len(codes) - k] << np.uint64(k)
    return np.flatnonzero((rolling >> np.uint64(20)) % np.uint64(mean) == 0) + 1


def split_by_content(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of at most `limit` characters whose cuts follow the content.

    The first landmark in a piece's second half is moved to the last natural boundary before it (in that half);
    without a landmark the piece ends at the last natural boundary, or at the limit. An edit alters the pieces around
    it only, as the cuts after the next common landmark are the same again.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    levels, marks, pieces, start, size = boundary_levels(text), landmarks(text, max(8, limit // 4)), [], 0, limit - overlap
    while len(text) - start > size:
        low, high = start + size // 2, start + size
        k = int(np.searchsorted(marks, low))
        aim, end = int(marks[k]) if k < len(marks) and marks[k] <= high else high, None
        for places in levels:
            end = _last(places, low, aim)
            if end is not None:
                break
        if end is None:
            k = text.rfind(" ", start, aim) + 1
            end = k if k and k >= low else aim
        pieces.append((max(0, start - overlap), end))
        start = end
    pieces.append((max(0, start - overlap), len(text)))
    return pieces


def split_oversized(items: DataFrame, item_id: str, text: Column, limit: int, overlap: int, method: str = "boundary") -> DataFrame:
    """(item_id, piece_start, piece_end) of every text with more than `limit` characters.

    method `boundary` applies the fixed boundary rule, `content` content-defined chunking. 0 <= overlap < limit / 2.
    Null texts and texts within the limit give no piece; equal rows give their pieces once; an item without id keeps a
    null id. Offsets are code points, the end exclusive.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be from 0 to less than half the limit")
    cut = {"boundary": split_at_boundaries, "content": split_by_content}[method]
    long = items.select(F.col(item_id).cast("bigint").alias("item_id"), text.alias("text")).filter(F.char_length("text") > limit)

    def make():
        return lambda ids, texts: ((i, a, b) for i, t in zip(ids, texts, strict=True) for a, b in cut(t, limit, overlap))

    return flat_map(long, "item_id bigint, piece_start bigint, piece_end bigint", make).distinct()
