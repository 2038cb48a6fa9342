import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill import resources as R
from glyphmill.functions import text as T
from glyphmill.operators import catalog, chunking, commands, dispatch, evaluate, index, langid, search, summarize, translate
from glyphmill.streaming import events as ev

TEXT = st.text(alphabet="ab .!?\n'é中", max_size=300)


@given(TEXT, st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_chunks_and_chapters(text, limit):
    assert "".join(chunking.chapters(text, limit)) == text
    assert all(len(x) <= limit for x in chunking.chapters(text, limit))
    chunks = list(chunking.pack(text, limit))
    assert all(0 < len(c) <= limit for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())


def sentences_plainly(text):
    out = []
    for m in re.finditer(r".+?(?:(?:\r?\n){2,}|\Z)", text, re.S):
        length = max(len(m.group().strip()), 1)
        for k in re.finditer(r"[^.!?]+(?:[.!?]+|$)", m.group(), re.S):
            s = re.sub(r"\s+", " ", k.group()).strip()
            if len(s) >= 20:
                out.append((s, m.start() + k.start(), k.start(), length))
    return out or ([(text.strip(), 0, 0, max(len(text), 1))] if text.strip() else [])


def test_sentences_point_into_the_text(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["word ", "another one", ". ", "! ", "\n\n", "\r\n\r\n", "?", "end"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [r[1] for r in R.TEXTS.rows if r[1]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.sentences(F.col("text")).alias("s")).collect()
    for r in rows:
        assert [tuple(x) for x in r.s or []] == sentences_plainly(texts[r.id])


def test_pagerank_sums_to_one_and_agrees_with_the_definition():
    rng = random.Random(3)
    for n in (1, 2, 7):
        edges = {(a, b): rng.random() for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        graph = {i: {} for i in range(n)}
        for (a, b), w in edges.items():
            graph[a][b] = graph[b][a] = w
        rank = [1 / n] * n
        for _ in range(30):
            new = [0.15 / n] * n
            for i in range(n):
                total = sum(graph[i].values())
                for j in range(n):
                    new[j] += 0.85 * rank[i] * (graph[i].get(j, 0) / total if total else 1 / n)
            rank = new
        pairs = np.array(list(edges), dtype=np.int64).reshape(-1, 2).T
        got = summarize.pagerank(n, *pairs, np.array(list(edges.values()), dtype=float))
        assert abs(sum(got) - 1) < 1e-12 and max(abs(a - b) for a, b in zip(got, rank, strict=True)) < 1e-12


def test_pairs_of_sentences_in_any_portion(monkeypatch):
    rng = random.Random(8)
    lists = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))] for _ in range(30)]
    sets = [set(x) for x in lists]
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(30) for j in range(i + 1, 30) if sets[i] & sets[j]}
    for portion in (10**6, 5):
        monkeypatch.setattr(summarize, "PORTION", portion)
        a, b, s = summarize.shared_terms(lists)
        assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), s.tolist(), strict=True)) == pytest.approx(want)
    assert list(summarize.sentence_ranks([])) == [] and summarize.word_ranks([]) == {} and summarize.word_ranks(["a"]) == {"a": 1.0}


@given(st.text(alphabet="ab é中🙂\n", max_size=80), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_top_ngrams(text, top):
    t = re.sub(r"[ \t\n\x0B\f\r]+", " ", text).lower()
    counts = Counter(t[k : k + n] for n in (2, 3, 4) for k in range(len(t) - n + 1))
    assert langid.top_ngrams(text, top) == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "comet comet map"), (2, "comet tower"), (3, "tower"), (4, None), (5, "")], "doc_id bigint, text string")
    toks, sizes = index.tokens(docs, "doc_id", "en", ()), index.lengths(docs, "doc_id", "en", ())
    q = spark.createDataFrame([(0, "comet"), (0, "comet"), (0, "map")], "query_id int, term string")
    got = {r.doc_id: r.score for r in search.scores(q, index.postings(toks), index.term_stats(toks, sizes), index.collection_stats(sizes)).collect()}

    def part(tf, length, df):
        return math.log10(3 / df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 2))

    assert got == {1: round(part(2 / 3, 3, 2) + part(1 / 3, 3, 1), 6), 2: round(part(1 / 2, 2, 2), 6)}
    with pytest.raises(ValueError):
        search.check(9, 0.5, 1)


def test_evaluation_edges(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id bigint, doc_id bigint, rank bigint")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (3, 10)], "query_id bigint, doc_id bigint")
    ap = {r.query_id: r.ap for r in evaluate.average_precision(queries, ranked, relevant).collect()}
    assert ap == {1: round((1 / 2 + 2 / 3) / 3, 6), 2: 0.0, 3: 0.0}
    ks = spark.createDataFrame([(2,), (5,)], "k bigint")
    at = {(r.query_id, r.k): (r.precision, r.recall) for r in evaluate.at_k(queries, ranked, relevant, ks).collect()}
    assert at[1, 2] == (0.5, round(1 / 3, 6)) and at[1, 5] == (round(2 / 3, 6), round(2 / 3, 6)) and at[3, 5] == (0.0, 0.0)
    curve = {(r.query_id, r.level): r.precision for r in evaluate.curve(queries, ranked, relevant).collect()}
    assert curve[1, 0] == curve[1, 6] == round(2 / 3, 6) and curve[1, 7] == 0.0 and len(curve) == 33


def test_snippet(spark):
    d = spark.createDataFrame([("1 <b>One</b> two  three four", [1], ["two"]), ("", [], []), ("12 & 3", [], [])], "t string, p array<bigint>, w array<string>")
    got = [r.s for r in d.select(search.snippet(F.col("t"), F.col("p"), F.col("w"), 1).alias("s")).collect()]
    assert got[1:] == ["", "12 &amp; 3"]
    assert got[0] == "b&gt;One&lt;/b ..."


def test_ngrams(spark):
    text = "Ab  c🙂d"
    t = re.sub(r"\s+", " ", text).lower()
    want = Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1))
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(T.ngrams(F.col("t")).alias("g")).collect()
    assert Counter(got[0].g) == want and not got[1].g


def test_majority(spark):
    rows = spark.createDataFrame([("a", "b", "b"), ("a", "b", "c"), ("a", "a", "c")], "x string, y string, z string")
    assert [r[0] for r in rows.select(langid.majority(F.col("x"), F.col("y"), F.col("z"))).collect()] == ["b", "a", "a"]


def test_catalog_states(spark):
    s = "p string, h string, v int"
    before = spark.createDataFrame([("a", "1", 2), ("b", "1", 2), ("c", "1", 1), ("d", None, 2), ("e", "1", 2)], s)
    after = spark.createDataFrame([("a", "1", 2), ("b", "2", 2), ("c", "1", 2), ("d", None, 2), ("f", "1", 2)], s)
    got = {r.p: r.status for r in catalog.diff(before, after, "p", "h", "v").collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "stale", "d": "unchanged", "e": "removed", "f": "new"}
    assert [r.p for r in catalog.removed(before, after, "p").collect()] == ["e"]


def test_trees():
    tokens = [dict(zip(("sent_id", "i", "text", "lemma", "pos", "tag", "dep", "head"), r, strict=True)) for r in R.TOKENS.rows]
    for s in {t["sent_id"] for t in tokens}:
        own = [t for t in tokens if t["sent_id"] == s]
        assert sorted(translate.linearize(own)) == [t["i"] for t in own]
        tree = translate.constituency(own)
        assert tree.count("(") == tree.count(")") and all(t["text"] in tree for t in own if t["dep"] != "punct")
    assert translate.climb({0: 1, 1: 2, 2: 2, 3: 1}, {0, 3}) == {0: 0, 3: 3}
    assert translate.climb({0: 1, 1: 2, 2: 2, 3: 1}, {0, 2}) == {0: 2, 2: 2}
    assert translate.linearize([]) == []


def test_debounce_compares_with_the_last_accepted(spark):
    rows = [("a", k, t) for k, t in enumerate((0, 400, 900, 1000, 1900, 2000, 2600))] + [("b", 20, 100), (None, 21, 5)]
    d = spark.createDataFrame(rows, "k string, id bigint, ms bigint").withColumn("at", F.timestamp_millis("ms").cast("timestamp_ntz"))
    got = sorted(r.event_id for r in ev.debounce(d, "k", "at", "id", 1.0).collect())
    assert got == [0, 3, 5, 20]
    assert ev.debounce(d.limit(0), "k", "at", "id", 1.0).collect() == []


def tree(*words):
    return [dict(zip(("i", "text", "pos", "dep", "head"), (i, *w), strict=True)) for i, w in enumerate(words)]


def test_constituency_rules():
    s = tree(("The", "DET", "det", 2), ("old", "ADJ", "amod", 2), ("captain", "NOUN", "nsubj", 5), ("has", "AUX", "aux", 5), ("quietly", "ADV", "advmod", 5), ("opened", "VERB", "ROOT", 5), ("maps", "NOUN", "obj", 5), ("and", "CCONJ", "cc", 6), ("drums", "NOUN", "conj", 6), ("in", "ADP", "case", 10), ("forests", "NOUN", "obl", 5), (".", "PUNCT", "punct", 5))
    assert translate.constituency(s) == "(S (NP (ADJP (DET The)) (ADJP (ADJ old)) (NOUN captain)) (VP (AUX has) (ADVP (ADV quietly)) (V opened) (NP (NOUN maps) (CoordNP (CC and) (NP (NOUN drums)))) (PP (P in) (NP (NOUN forests))) (PUNCT .)))"
    s = tree(("Towers", "NOUN", "nsubj", 2), ("are", "AUX", "cop", 2), ("famous", "ADJ", "ROOT", 2))
    assert translate.constituency(s) == "(S (NP (NOUN Towers)) (VP (COP are) (V famous)))"
    s = tree(("She", "PRON", "nsubj", 1), ("said", "VERB", "ROOT", 1), ("that", "SCONJ", "mark", 4), ("he", "PRON", "nsubj", 4), ("left", "VERB", "ccomp", 1))
    assert translate.constituency(s) == "(S (NP (PRON She)) (VP (V said) (CCOMP (S (NP (PRON he)) (VP (MARK (SCONJ that)) (V left))))))".replace("(MARK (SCONJ that))", "(MARK that)")
    assert translate.constituency([]) == "(S)"


def test_tree_shape(spark):
    d = spark.createDataFrame([(1, "(S (NP (PRON She)) (VP (V said)))"), (2, "(S)")], "sent_id int, tree string")
    assert [tuple(r) for r in translate.tree_shape(d).collect()] == [(1, 3, 2), (2, 1, 0)]


def test_linearization():
    s = tree(("Yesterday", "ADV", "advmod", 2), ("captain", "NOUN", "nsubj", 2), ("found", "VERB", "ROOT", 2), ("maps", "NOUN", "obj", 2), ("and", "CCONJ", "cc", 3), ("drums", "NOUN", "conj", 3), ("old", "ADJ", "amod", 3))
    assert translate.linearize(s) == [1, 0, 2, 4, 6, 3, 5]  # the conjunction leads its first later sibling
    loop = [{"i": 0, "dep": "obj", "head": 1}, {"i": 1, "dep": "obj", "head": 0}]
    assert translate.linearize(loop) == [0, 1]
    chain = [{"i": k, "dep": "obj" if k else "ROOT", "head": max(0, k - 1)} for k in range(3000)]
    assert translate.linearize(chain) == list(range(3000))


def test_commands(spark):
    want = {
        "найди в тексте комета": ("search", "комета", None),
        'Please, find "the old captain" !': ("search", "the old captain", None),
        "look  for: towers": ("search", "towers", None),
        "find it's here": ("search", "it's here", None),
        "find finding": ("search", "finding", None),
        "find a, then read": None,
        "find a\nread": None,
        "find 'a and read'": ("search", "a and read", None),
        'find "a" b': None,
        'find "a': None,
        "find ?!": None,
        "прочитай мне вслух": None,
        "Translate the text into RUSSIAN.": ("translation", "", "ru"),
        "translate to ru язык": ("translation", "", "ru"),
        "translate": None,
        "create a summary of this document!": ("summary", "", None),
        "readable": None,
        "": None,
        None: None,
    }
    d = spark.createDataFrame(list(enumerate(want)), "id int, text string").withColumn("action", F.lit("x")).drop("action")
    got = {r.text: (r.action, r.argument, r.target_language) if r.action else None for r in commands.parsed(d, "text").collect()}
    assert got == want
    assert commands.parsed(d.limit(0), "text").collect() == []


def test_outcomes_and_failures(spark):
    c = spark.createDataFrame([(1, None), (2, None), (3, None), (4, None), (5, None), (6, None), (None, None), (1, "invalid_command")], "doc_id bigint, error_code string")
    docs = spark.createDataFrame([(1, "processed", "EN-us", "t", None), (2, "pending", "en", "t", None), (3, "processed", "xx", "t", None), (4, "processed", "ru", " ", None), (5, "processed", "en", "t", "2025")], "doc_id bigint, status string, lang string, text string, deleted_at string")
    got = sorted((r.doc_id or 0, r.code) for r in dispatch.outcome(c, docs).collect())
    assert got == [(0, "document_not_found"), (1, "invalid_command"), (1, "ok"), (2, "document_not_ready"), (3, "language_unknown"), (4, "document_text_unavailable"), (5, "document_not_found"), (6, "document_not_found")]

    def step(x):
        if x == "voice":
            raise dispatch.Failure("voice_unavailable")
        return str(1 // int(x))

    rows = spark.createDataFrame([("1",), ("0",), ("voice",), (None,)], "t string").select(dispatch.attempted(step)(F.col("t")).alias("x")).collect()
    assert [tuple(r.x) for r in rows] == [("1", None), (None, "operation_failed"), (None, "voice_unavailable"), (None, None)]


def test_registry_and_deletes(spark):
    assert "el" in R.language_tools("es").stopwords and "the" in R.language_tools("en").stopwords
    with pytest.raises(ValueError):
        R.language_tools("xx")
    R.register_language("xx", ["a"], F.upper)
    assert R.language_tools("xx").stopwords == ("a",)
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, w string")
    left, n = index.delete_where(d, F.col("w") == "a")
    assert sorted(r.id for r in left.collect()) == [2, 3] and n.first()[0] == 1 and index.delete_all(d).count() == 0


def test_debounce_in_batches_is_debounce(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), k, rng.randint(0, 60_000)) for k in range(120)]
    rows.sort(key=lambda r: r[2])
    d = spark.createDataFrame(rows, "k string, id bigint, ms bigint").withColumn("at", F.timestamp_millis("ms").cast("timestamp_ntz"))
    want = sorted(r.event_id for r in ev.debounce(d, "k", "at", "id", 2.0).collect())
    through = ev.Debouncer(spark, str(tmp_path / "rows"), "k", "at", "id", 2.0)
    for number, (low, high) in enumerate(((0, 20_000), (20_000, 20_001), (20_001, 70_000))):
        for _ in range(2):  # a repeated batch replaces itself
            through.write(d.filter((F.col("ms") >= low) & (F.col("ms") < high)), number)
    assert sorted(r.event_id for r in through.accepted().collect()) == want


def test_streams_start_again(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []

    def write(batch, number):
        seen.append(number)
        if len(seen) == 1:
            raise RuntimeError("once")
        batch.write.mode("overwrite").parquet(str(tmp_path / "out"))

    s = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    ev.run_stream(lambda: ev.polled(s.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")), None).start(), wait_seconds=0.01)
    assert seen == [0, 0] and spark.read.parquet(str(tmp_path / "out")).count() == 5
