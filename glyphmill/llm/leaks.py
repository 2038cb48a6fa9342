"""Evaluation texts inside training text.

Each task turns its documents into shards of words and builds a suffix array of each shard (prefix doubling). Every
suffix of every evaluation item is looked up there by binary search; the places found are extended to the longest
verbatim match, whose location is kept. Words that occur in no item can't take part in a match, nor can a run of fewer
than `min_words` words between them; such suffixes are left out of the array, which loses no match. The corpus is read
once for any number of items: blocks of items take turns at each shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrow import flat_map

#: Words of a shard; bounds a task's memory (about 200 bytes a word).
SHARD_WORDS = 1_000_000
#: Evaluation words that are looked up at once; a larger collection is searched in blocks of items, shard by shard.
BLOCK_WORDS = 2_000_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words of a text in small letters; each keeps its place among the words of the text as it is."""
    if text.isascii():
        return _WORD.findall(text.lower())
    low = text.casefold()
    if len(low) == len(text):
        return _WORD.findall(low)
    return [x for w in _WORD.findall(text) for x in _WORD.findall(w.casefold())]


def suffix_order(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of `ids` sorted by their first `depth` or more ids, and the rank of each. Prefix doubling."""
    rank, reach = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    n = len(ids)
    while True:
        if reach >= min(depth, n):
            return np.argsort(rank, kind="stable"), rank  # ties are equal to that depth
        behind = np.full(n, -1, dtype=np.int64)
        behind[: n - reach] = rank[reach:]
        rank = np.unique(rank * (n + 1) + behind + 1, return_inverse=True)[1].astype(np.int64)
        reach *= 2


def _lower_bound(shard: np.ndarray, order: np.ndarray, probes: np.ndarray, after: bool) -> np.ndarray:
    """For each probe (row of ids) the first place in `order` whose suffix isn't less (with `after`: is greater)."""
    n, width = len(order), probes.shape[1]
    low, high = np.zeros(len(probes), dtype=np.int64), np.full(len(probes), n, dtype=np.int64)
    padded = np.concatenate([shard, np.full(width, -1, dtype=shard.dtype)])
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at = order[np.minimum(middle, n - 1)]
        sign, undecided = np.zeros(len(probes), dtype=np.int8), open_.copy()
        for k in range(width):
            a, b = padded[at + k], probes[:, k]
            sign[undecided & (a < b)], sign[undecided & (a > b)] = -1, 1
            undecided &= a == b
            if not undecided.any():
                break
        up = open_ & ((sign < 0) | (after & (sign == 0)))
        low, high = np.where(up, middle + 1, low), np.where(open_ & ~up, middle, high)
    return low


class Probes:
    """The evaluation items as one array of word ids, with every suffix of `min_words` or more words."""

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.min_words, self.vocabulary = min_words, {}
        ids, ends, owner, begins = [], [], [], []
        for item, text in items:
            found = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if len(found) >= min_words:
                begins += [len(ids)] * len(found)
                ids += found
                owner += [item] * len(found)
                ends += [len(ids)] * len(found)
        self.ids, self.ends, self.owner = np.array(ids, dtype=np.int64), np.array(ends, dtype=np.int64), np.array(owner, dtype=np.int64)
        self.begins = np.array(begins, dtype=np.int64)
        starts = np.arange(len(ids))
        starts = starts[self.ends - starts >= min_words] if len(ids) else starts
        self.rows = self.ids[starts[:, None] + np.arange(min_words)] if len(starts) else np.zeros((0, min_words), dtype=np.int64)
        self.starts = starts
        # equal suffix heads are searched once
        self.heads, self.of = np.unique(self.rows, axis=0, return_inverse=True) if len(starts) else (self.rows, starts)

    def runs(self, found: Sequence[str]) -> Iterator[tuple[int, list[int]]]:
        """(place, ids) of the runs of known words that are long enough to hold a match."""
        run: list[int] = []
        for at, k in enumerate(map(self.vocabulary.get, found)):
            if k is not None:
                run.append(k)
            elif run:
                if len(run) >= self.min_words:
                    yield at - len(run), run
                run = []
        if len(run) >= self.min_words:
            yield len(found) - len(run), run

    def search(self, docs: Sequence[tuple[int, Sequence[str]]]) -> list[tuple[int, int, int, int, int]]:
        """(doc, item, words, place in the document, place in the item) of the longest match of each document and item."""
        ids: list[int] = []
        nth: list[int] = []
        place: list[int] = []
        for i, (_, found) in enumerate(docs):
            for at, run in self.runs(found):
                ids += [*run, 0]
                nth += [i] * (len(run) + 1)
                place += range(at, at + len(run) + 1)
        rows = self.matches(np.array(ids, dtype=np.int64), np.array(nth, dtype=np.int64))
        return [(docs[d][0], item, n, place[at], first) for d, item, n, at, first in rows]

    def matches(self, shard: np.ndarray, docs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(doc, item, words, place in the shard, place in the item) for a shard; ids of 0 or less part documents and runs."""
        if not len(self.heads) or not len(shard):
            return []
        order, _ = suffix_order(shard, self.min_words)
        low, high = _lower_bound(shard, order, self.heads, False), _lower_bound(shard, order, self.heads, True)
        low, count = low[self.of], (high - low)[self.of]
        hit = np.flatnonzero(count)
        padded, best = np.concatenate([shard, [0]]), np.zeros((0, 5), dtype=np.int64)
        for block in np.array_split(hit, max(1, int(count[hit].sum()) // 500_000 + 1)):  # pairs of places at once
            n = count[block]
            probe = np.repeat(block, n)
            place = order[np.repeat(low[block], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            start, length = self.starts[probe], np.full(len(probe), self.min_words)
            end, active = self.ends[start], np.arange(len(probe))
            while len(active):
                p, s = np.minimum(place[active] + length[active], len(shard)), start[active] + length[active]
                active = active[(s < end[active]) & (padded[p] == self.ids[np.minimum(s, len(self.ids) - 1)])]
                length[active] += 1
            rows = np.concatenate([best, np.stack([docs[place], self.owner[start], -length, place, start - self.begins[start]], axis=1)])
            rows = rows[np.lexsort(rows.T[::-1])]  # by document, item, falling length, place
            first = np.ones(len(rows), dtype=bool)
            first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            best = rows[first]
        best[:, 2] *= -1
        return [tuple(r) for r in best.tolist()]


@lru_cache(1)
def _probes(items: tuple[tuple[int, str], ...], min_words: int) -> Probes:
    return Probes(list(items), min_words)


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 10, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word): every document holding `min_words` consecutive words of an item.

    Words are runs of letters and digits, ignoring case and whatever stands between them; match_words is the longest
    verbatim match, doc_word and item_word count the words before it (of equal ones the first). Rows without id, null and
    empty texts, and items of fewer words, match nothing. Repeated rows count once. The items reach the driver and the
    tasks in blocks of `block_words` words, so their size at once is bounded.
    """
    corpus = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("length(text) > 0 and doc_id is not null")
    wanted = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).filter(F.length("text") > 0).distinct()
    context, blocks, block, size = docs.sparkSession.sparkContext, [], [], 0
    for row in wanted.toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text) // 2
        if size >= block_words:
            blocks.append(context.broadcast(tuple(block)))
            block, size = [], 0
    if block:
        blocks.append(context.broadcast(tuple(block)))
    columns = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("match_words", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, list[str]]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for b in blocks:
                found = list(zip(*_probes(b.value, min_words).search(shard), strict=True)) or [[]] * len(columns)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(found, columns, strict=True)], names=[n for n, _ in columns])

        n = 0
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard.append((key, words(t)))
                n += len(shard[-1][1])
                if n >= shard_words:
                    yield from flush()
                    shard, n = [], 0
        if shard:
            yield from flush()

    out = corpus.mapInArrow(run, ", ".join(f"{n} bigint" for n, _ in columns))
    # a repeated document may fall into several tasks, an item into several blocks
    longest = F.struct("match_words", -F.col("doc_word"), -F.col("item_word"))
    found = out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("match_words", "doc_word", "item_word"), longest).alias("x"))
    return found.select("doc_id", "item_id", "x.*")


def locations(docs: DataFrame, doc_id: str, text: str, found: DataFrame) -> DataFrame:
    """(doc_id, item_id, match_start, match_end, match_words): where the matches of `leaked` stand; code points, end exclusive.

    Only the documents found are read with their texts; a document in several rows has the places of its first text.
    """
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).join(found.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    def make():
        def rows(keys, items, counts, starts, texts):
            for key, item, n, at, t in zip(keys, items, counts, starts, texts, strict=True):
                ends = [m.span() for m in _WORD.finditer(t) for _ in _WORD.findall(m.group().casefold())]
                yield key, item, ends[at][0], ends[at + n - 1][1], n

        return rows

    joined = found.join(texts, "doc_id").select("doc_id", "item_id", "match_words", "doc_word", "text")
    return flat_map(joined, "doc_id bigint, item_id bigint, match_start bigint, match_end bigint, match_words bigint", make)


def without_leaks(docs: DataFrame, doc_id: str, found: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    return docs.join(found.select(F.col("doc_id").alias("_leaked")).distinct(), F.col(doc_id) == F.col("_leaked"), "left_anti")
