"""Operators with an exact definition, against plain versions and on odd inputs."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.llm import components, copies, frequencies, leaks, oversized, tokenizer

# --- p1 ---


def cuts_plainly(text, limit, overlap):
    """The rule read off place by place."""
    closers = "\"'”’»“)]」』）"

    def ends_break(e):
        return 2 if text[:e].endswith("\r\n") else 1 if text[:e].endswith("\n") else 0

    def blank(e):
        n = ends_break(e)
        return n and ends_break(e - n)

    def sentence(e):
        k = e
        while k and text[k - 1] in closers:
            k -= 1
        if e < len(text) and text[e] in closers or not k:
            return False
        return text[k - 1] in "。！？" or (text[k - 1] in ".!?…।؟" and text[e : e + 1] in (" ", "\t", "\n", "\r"))

    out, s = [], 0
    while len(text) - s > limit:
        window = [e for e in range(s + limit, s, -1) if e >= s + limit / 2]
        for good in (blank, ends_break, sentence, lambda e: text[e - 1] == " "):
            e = next((e for e in window if good(e)), None)
            if e is not None:
                break
        e = s + limit if e is None else e
        out.append((s, e))
        s = e - overlap
    return [*out, (s, len(text))]


PIECES = st.lists(st.sampled_from(["word", " ", ". ", "! ", "。", "」", "”", "\n", "\r\n", "\n\n", ".”", "é", "🙂", "\t", ")"]), max_size=200).map("".join)


@given(PIECES, st.integers(6, 50), st.integers(0, 2))
@settings(max_examples=300, deadline=None)
def test_boundary_cuts(text, limit, overlap):
    assert oversized.split_at_boundaries(text, limit, overlap) == (cuts_plainly(text, limit, overlap) if len(text) > limit else [(0, len(text))])


@given(PIECES, st.integers(10, 60), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_content_cuts_cover_the_text(text, limit, overlap):
    p = oversized.split_by_content(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(b - a <= limit for a, b in p)
    assert all(x[1] - overlap <= y[0] <= x[1] for x, y in zip(p, p[1:], strict=False))


def test_an_edit_alters_neighbouring_pieces_only():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(6000))
    edited = text[:9000] + "inserted words " + text[9000:]
    a = {text[s:e] for s, e in oversized.split_by_content(text, 800, 0)}
    b = {edited[s:e] for s, e in oversized.split_by_content(edited, 800, 0)}
    assert len(b - a) <= 8 < len(b)


def test_oversized_rows(spark):
    d = spark.createDataFrame([(1, "x" * 30), (1, "x" * 30), (2, None), (3, ""), (4, "short"), (None, "y" * 12)], "id bigint, text string")
    got = sorted((r.item_id or 0, r.piece_start, r.piece_end) for r in oversized.split_oversized(d, "id", F.col("text"), 10, 2).collect())
    assert got == [(0, 0, 10), (0, 8, 12), (1, 0, 10), (1, 8, 18), (1, 16, 26), (1, 24, 30)]
    assert oversized.split_oversized(d.limit(0), "id", F.col("text"), 10, 2).collect() == []
    with pytest.raises(ValueError):
        oversized.split_oversized(d, "id", F.col("text"), 10, 5)


# --- p2 ---


def groups_plainly(rows):
    def card(t):
        ls = [x for x in re.split(r"\r\n|\r|\n", t) if x.strip()]
        return len(ls) >= 3 and all(re.match(r"\s*\w[^:]{0,40}:\s*\S", x) for x in ls)

    def letters(t):
        return "".join(c for c in unicodedata.normalize("NFC", t) if c.isalnum()).upper()

    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    hashes = defaultdict(list)
    for i, t, h in rows:
        h = re.sub(r"^SHA256", "", letters(h or ""))
        if t is None:
            if h:
                hashes[h].append((i, True))
                parent.setdefault(("d", i), ("d", i))
        elif letters(t):
            key = ("c", "\n".join(sorted(letters(x) for x in re.split(r"\r\n|\r|\n", t) if x.strip()))) if card(t) else ("p", letters(t))
            parent[root(("d", i))] = root(key)
            if h:
                hashes[h].append((i, False))
    for members in hashes.values():
        if any(n for _, n in members):
            for i, _ in members[1:]:
                parent[root(("d", i))] = root(("d", members[0][0]))
    out = defaultdict(set)
    for x in list(parent):
        if x[0] == "d":
            out[root(x)].add(x[1])
    return {(min(g), i) for g in out.values() for i in g if i != min(g)}


def test_copies_against_union_find(spark):
    rng = random.Random(4)
    texts = ["One tower.", "ONE  tower!", "one\ntower", "Straße", "STRASSE", "Title: a\nYear: 1\nNote: c", "note: C\nTITLE: a\n\nYear: 1", "...", "  ", "", None, None, "é x", "é x", "Title: a\nYear: 1"]
    hashes = ["AB12", "sha256:ab12", "ab-12", "cd", " CD ", "ef", "gh", None, "", "SHA256: EF"]
    rows = [(i, rng.choice(texts), rng.choice(hashes)) for i in range(1, 90)]
    d = spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string, file_hash string").withColumn("key", F.lit("x")).withColumn("tk", F.lit(1))
    got = copies.copies(d, "doc_id", "text", "file_hash")
    assert {(r.first_doc_id, r.doc_id) for r in got.filter("doc_id <> first_doc_id").collect()} == groups_plainly(rows)
    want = groups_plainly(rows)
    counts = Counter(a for a, _ in want)
    assert {r.first_doc_id: r.n_copies for r in copies.copy_counts(got).collect()} == {a: n + 1 for a, n in counts.items()}


def test_copies_of_nothing_and_a_hot_group(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, file_hash string")
    assert copies.copies(empty, "doc_id", "text", "file_hash").collect() == []
    d = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}", None) for i in range(300)], empty.schema)
    got = copies.copies(d, "doc_id", "text", "file_hash").filter("doc_id <> first_doc_id").collect()
    assert len(got) == 199 and {r.first_doc_id for r in got} == {1}


def test_hubs_of_hashes_and_labels(spark):
    """A null text's hash shared by most rows, with many different texts: one group of everything."""
    rows = [(0, None, "ab")] + [(i, f"text {i}", "AB" if i % 10 else f"c{i}") for i in range(1, 600)]
    got = copies.copies(spark.createDataFrame(rows, "doc_id bigint, text string, file_hash string"), "doc_id", "text", "file_hash")
    want = {(0, i) for i in range(1, 600) if i % 10}
    assert {(r.first_doc_id, r.doc_id) for r in got.filter("doc_id <> first_doc_id").collect()} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert {r.node: r["first"] for r in components.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- p3 ---


def test_deltas_keep_counts_up_to_date(spark):
    rng = random.Random(6)
    schema = "id bigint, word string, doc string, n bigint"
    field = frequencies.Field("w", "id", "word", "doc", "n")
    word = lambda: rng.choice(["a", "A ", "b", " b", "", None, "é", "é", "c"])
    old = {i: (i, word(), rng.choice(["x", "y", "z", None]), rng.choice([0, 1, 2, None])) for i in range(60)}
    new = {i: r for i, r in old.items() if i % 7} | {i: (i, word(), "y", 3) for i in range(50, 75)}
    frame = lambda rows: spark.createDataFrame(list(rows.values()) + list(rows.values())[:4], schema)

    def plainly(rows):
        n, docs = Counter(), defaultdict(set)
        for _, w, d, k in rows.values():
            w = unicodedata.normalize("NFC", (w or "").strip().lower())
            if w:
                n[w] += k or 0
                docs[w] |= {d} - {None}
        return {w: (n[w], len(docs[w])) for w in n if n[w] or docs[w]}

    def counted(state):
        return {r.term: (r.occurrences, r.records) for r in frequencies.counts(state).collect() if r.occurrences or r.records}

    first = frequencies.merge(None, frequencies.deltas(frame(old), None, field))
    assert counted(first) == plainly(old)
    stored = spark.read.parquet(frequencies.store(first))
    assert counted(stored) == plainly(old)
    # whole states, and the rows that changed only
    gone = {i: r for i, r in old.items() if new.get(i) != r}
    come = {i: r for i, r in new.items() if old.get(i) != r}
    for added, removed in ((new, old), (come, gone)):
        changes = frequencies.deltas(frame(added), frame(removed), field)
        again = spark.read.parquet(frequencies.store(frequencies.merge(stored, changes)))
        assert counted(again) == plainly(new)
    assert counted(frequencies.merge(stored, frequencies.deltas(None, frame(old), field))) == {}
    assert frequencies.deltas(frame(old), frame(old), field).collect() == []
    assert counted(frequencies.merge(None, frequencies.deltas(frame(old).limit(0), None, field))) == {}


# --- p7 ---

needs_ranks = pytest.mark.skipif(not Path(tokenizer.RANKS).exists(), reason="no vocabulary")


@needs_ranks
@given(st.text(max_size=400), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_parts_give_the_same_ids(text, size):
    parts = tokenizer.parts(text, size)
    assert "".join(parts) == text
    e = tokenizer._encoding(tokenizer.RANKS)
    assert [i for p in parts for i in e.encode_ordinary(p)] == e.encode_ordinary(text)


@needs_ranks
def test_round_trip_and_defined_ids(spark):
    texts = ["", None, "plain", "中文🙂é​", "a" * 60_000, " \n\t ", "<|endoftext|>", "it's 12 o'clock"]
    d = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    ids = tokenizer.encode_corpus(d, "k", "t")
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got[0] == [] and got[1] == [] and 50256 not in got[6]
    back = {r.doc_id: r.text for r in tokenizer.decode_corpus(ids).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert tokenizer.encode_corpus(d.limit(0), "k", "t").collect() == []


# --- p8 ---


def leaks_plainly(docs, items, n):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").casefold())
    out = {}
    for i, t in items:
        w = words(t)
        for d, text in docs:
            x = words(text)
            best = max((k for k in range(n, len(w) + 1) if any(x[b : b + k] == w[a : a + k] for a in range(len(w) - k + 1) for b in range(len(x) - k + 1))), default=0)
            if best:
                out[d, i] = best
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(0, 9)))) for i in range(12)] + [(50, None), (51, "")]
    docs = [(d, rng.choice([", ", " ", "; "]).join(rng.choice(["ab", "CD", "ef", "gh", "zz"]) for _ in range(rng.randint(0, 30)))) for d in range(60)] + [(90, None), (91, ""), (92, "ab_cd ef")]
    want = leaks_plainly(docs, items, 4)
    frame = spark.createDataFrame(docs + docs[:3] + [(None, "ab cd ef gh")], "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    item_frame = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    for sizes in ({}, {"shard_words": 20}, {"block_words": 5}):
        got = leaks.leaked(frame, "doc_id", "text", item_frame, "item_id", "text", 4, **sizes)
        texts, wanted = dict(docs), dict(items)
        for r in leaks.locations(frame, "doc_id", "text", got).collect():
            passage = leaks.words(texts[r.doc_id][r.match_start : r.match_end])
            assert len(passage) == r.match_words and " ".join(passage) in " ".join(leaks.words(wanted[r.item_id]))
        assert {(r.doc_id, r.item_id): r.match_words for r in got.collect()} == want
    clean = leaks.without_leaks(frame, "doc_id", got)
    assert {r.doc_id for r in clean.collect() if r.doc_id is not None} == {d for d, _ in docs} - {d for d, _ in want}
    assert leaks.leaked(frame, "doc_id", "text", item_frame.limit(0), "item_id", "text", 4).collect() == []


def test_places_where_small_letters_are_longer(spark):
    d = spark.createDataFrame([(1, "İİ ẞ one Two ßß three four İ")], "doc_id bigint, text string")
    item = spark.createDataFrame([(7, "ONE two SSSS three four")], "item_id bigint, text string")
    found = leaks.leaked(d, "doc_id", "text", item, "item_id", "text", 3)
    assert [tuple(r)[2:] for r in leaks.locations(d, "doc_id", "text", found).collect()] == [(5, 26, 5)]


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_suffix_order(ids, depth):
    a = np.array(ids, dtype=np.int64)
    order, _ = leaks.suffix_order(a, depth)
    heads = [ids[k : k + depth] for k in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(ids))) and heads == sorted(heads)


def test_hash_width():
    assert len(hashlib.md5(b"").digest()) * 8 == 128
