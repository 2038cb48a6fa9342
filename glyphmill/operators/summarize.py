"""Extractive summaries and keywords: position-weighted TF-IDF combined with TextRank. A document is one row throughout."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Types
from pyspark.sql.window import Window as W

from glyphmill.functions import text as T

ITERATIONS, DAMPING = 30, 0.85
#: Pairs of sentences that are made before equal ones are counted together.
PORTION = 4_000_000


def terms(text: Column, language: str, stopwords: Sequence[str]) -> Column:
    """Words of more than two letters that aren't stopwords."""
    return T.kept(T.words(text, language), stopwords, 2)


def sentence_rows(docs: DataFrame, doc_id: str, text: str, language: str, stopwords: Sequence[str]) -> DataFrame:
    """(doc_id, doc_length, sentences): array of structs with text, starts and terms."""
    s = T.sentences(F.col(text))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.greatest(F.length(text), F.lit(1)).alias("doc_length"), terms(F.col(text), language, stopwords).alias("doc_terms"), s.alias("s")).filter("s is not null")
    with_terms = F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["doc_start"].alias("doc_start"), x["para_start"].alias("para_start"), x["para_length"].alias("para_length"), terms(x["text"], language, stopwords).alias("terms")))
    return d.select("doc_id", "doc_length", "doc_terms", with_terms.alias("sentences"))


def document_frequency(docs: DataFrame, text: str, language: str, stopwords: Sequence[str]) -> DataFrame:
    """(term, df) over the collection; each document counts once, without a shuffle of pairs."""
    return docs.select(F.explode(F.array_distinct(terms(F.col(text), language, stopwords))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_weights(docs: DataFrame, doc_id: str, text: str, language: str, stopwords: Sequence[str], n_docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, weight): 0.5 (1 + tf / max tf) ln(N / df). `n_docs` is one row."""
    tf = docs.select(F.col(doc_id).alias("doc_id"), F.explode(terms(F.col(text), language, stopwords)).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    top = tf.groupBy("doc_id").agg(F.max("tf").alias("max_tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(top, "doc_id").join(df, "term").crossJoin(F.broadcast(n_docs))
    return w.select("doc_id", "term", "tf", (0.5 * (1 + F.col("tf") / F.col("max_tf")) * F.log(F.col("n_docs") / F.col("df"))).alias("weight"))


def pagerank(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted PageRank of an undirected graph with edges (a, b): 30 synchronous steps; a node without edges gives its rank to all."""
    if not n:
        return np.zeros(0)
    src, dst, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weight, weight])
    total = np.bincount(src, weights=w, minlength=n)
    share = w / total[src] if len(src) else w
    rank = np.full(n, 1.0 / n)
    for _ in range(ITERATIONS):
        loose = rank[total <= 0].sum()
        rank = (1 - DAMPING) / n + DAMPING * (np.bincount(dst, weights=rank[src] * share, minlength=n) + loose / n)
    return rank


def _counted(codes: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(weights))


def shared_terms(term_lists: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, Jaccard similarity) of the pairs a < b of lists that share a term; only such pairs are ever made.

    Pairs are made term by term and counted in portions of PORTION, so memory holds the distinct pairs and one portion.
    """
    n, where = len(term_lists), {}
    sizes = np.zeros(n)
    for i, ts in enumerate(term_lists):
        for t in dict.fromkeys(ts):
            where.setdefault(t, []).append(i)
            sizes[i] += 1
    codes, weights, open_ = [np.zeros(0, dtype=np.int64)], [np.zeros(0)], 0
    for places in where.values():
        if len(places) < 2:
            continue
        x = np.array(places, dtype=np.int64)
        for k in range(1, len(x)):  # each place with the one k further on
            codes.append(x[:-k] * n + x[k:])
            weights.append(np.ones(len(x) - k))
            open_ += len(x) - k
            if open_ >= PORTION:
                one, count = _counted(codes, weights)
                codes, weights, open_ = [one], [count], 0
    pairs, both = _counted(codes, weights)
    a, b = np.divmod(pairs, max(n, 1))
    return a, b, both / (sizes[a] + sizes[b] - both)


def sentence_ranks(term_lists: Sequence[Sequence[str]]) -> np.ndarray:
    """TextRank of sentences whose edges are the Jaccard similarities of their terms."""
    return pagerank(len(term_lists), *shared_terms(term_lists))


def word_ranks(words: Sequence[str], window: int = 2) -> dict[str, float]:
    """TextRank of words that stand within `window` places of each other."""
    nodes = list(dict.fromkeys(words))
    at = {w: i for i, w in enumerate(nodes)}
    n, x = len(nodes), np.fromiter((at[w] for w in words), dtype=np.int64, count=len(words))
    near = [(x[:-k], x[k:]) for k in range(1, window + 1) if len(x) > k] or [(x[:0], x[:0])]
    codes = [(np.minimum(a, b) * n + np.maximum(a, b))[a != b] for a, b in near]
    pairs, count = _counted(codes, [np.ones(len(c)) for c in codes])
    return dict(zip(nodes, pagerank(n, *np.divmod(pairs, max(n, 1)), count).tolist(), strict=True))


@F.pandas_udf(Types.ArrayType(Types.DoubleType()))
def rank_sentences(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: [] if x is None else sentence_ranks([list(t) for t in x]).tolist())


@F.pandas_udf(Types.ArrayType(Types.StructType([Types.StructField("a", Types.LongType()), Types.StructField("b", Types.LongType()), Types.StructField("similarity", Types.DoubleType())])))
def similar_sentences(lists: pd.Series) -> pd.Series:
    """Pairs of sentences that share a term, with their Jaccard similarity."""
    return lists.map(lambda x: [] if x is None else [{"a": a, "b": b, "similarity": s} for a, b, s in zip(*(v.tolist() for v in shared_terms([list(t) for t in x])), strict=True)])


@F.pandas_udf(Types.ArrayType(Types.StructType([Types.StructField("term", Types.StringType()), Types.StructField("rank", Types.DoubleType())])))
def rank_words(words: pd.Series) -> pd.Series:
    return words.map(lambda x: [] if x is None else [{"term": t, "rank": r} for t, r in sorted(word_ranks(list(x)).items())])


def scored_sentences(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, idx, text, score): sum of tf x weight, times how early the sentence stands in text and paragraph."""
    each = rows.select("doc_id", "doc_length", F.posexplode("sentences").alias("idx", "s"))
    hits = each.select("doc_id", "idx", F.explode("s.terms").alias("term")).groupBy("doc_id", "idx", "term").agg(F.count(F.lit(1)).alias("n"))
    sums = hits.join(weights.select("doc_id", "term", "weight"), ["doc_id", "term"]).groupBy("doc_id", "idx").agg(F.sum(F.col("n") * F.col("weight")).alias("sum"))
    early = F.greatest(1 - F.col("s.doc_start") / F.col("doc_length"), F.lit(0.0)) * F.greatest(1 - F.col("s.para_start") / F.col("s.para_length"), F.lit(0.0))
    return each.join(sums, ["doc_id", "idx"], "left").select("doc_id", "idx", F.col("s.text").alias("text"), (early * F.coalesce("sum", F.lit(0.0))).alias("score"))


def summarize(rows: DataFrame, weights: DataFrame, count: int = 10, sentence_weight: float = 0.2, rank_weight: float = 0.8) -> DataFrame:
    """(doc_id, idx, text, combined) of the best `count` sentences of each document."""
    ranks = rows.select("doc_id", F.posexplode(rank_sentences(F.transform("sentences", lambda x: x["terms"]))).alias("idx", "rank"))
    both = scored_sentences(rows, weights).join(ranks, ["doc_id", "idx"])
    top = both.groupBy("doc_id").agg(F.max("score").alias("most"), F.max("rank").alias("most_rank"))
    share = lambda x, m: F.when(F.col(m) > 0, F.col(x) / F.col(m)).otherwise(0.0)
    s = both.join(top, "doc_id").select("doc_id", "idx", "text", F.round(sentence_weight * share("score", "most") + rank_weight * share("rank", "most_rank"), 6).alias("combined"))
    w = W.partitionBy("doc_id").orderBy(F.desc("combined"), "idx")
    return s.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= count).drop("r")


def keywords(rows: DataFrame, weights: DataFrame, count: int = 20, sentence_weight: float = 0.2, rank_weight: float = 0.8) -> DataFrame:
    """(doc_id, rank, term, score): terms of the sentences by TF-IDF and word TextRank."""
    used = rows.select("doc_id", F.explode(F.flatten(F.transform("sentences", lambda x: x["terms"]))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    own = used.join(weights.select("doc_id", "term", "weight"), ["doc_id", "term"]).select("doc_id", "term", (F.col("n") * F.col("weight")).alias("score"))
    ranks = rows.select("doc_id", F.explode(rank_words("doc_terms")).alias("x")).select("doc_id", "x.term", "x.rank")
    both = own.join(ranks, ["doc_id", "term"], "left")
    top_own, top_rank = own.groupBy("doc_id").agg(F.max("score").alias("most")), ranks.groupBy("doc_id").agg(F.max("rank").alias("most_rank"))
    share = lambda x, m: F.when(F.col(m) > 0, F.coalesce(F.col(x), F.lit(0.0)) / F.col(m)).otherwise(0.0)
    s = both.join(top_own, "doc_id").join(top_rank, "doc_id").select("doc_id", "term", F.round(sentence_weight * share("score", "most") + rank_weight * share("rank", "most_rank"), 6).alias("score"))
    w = W.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= count).select("doc_id", F.col("rank").cast("bigint").alias("rank"), "term", "score")
