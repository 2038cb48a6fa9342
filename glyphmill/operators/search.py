"""Ranked search: BM25 on relative term frequencies, vector re-ranking, snippets, document references."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glyphmill.functions import text as T
from glyphmill.plans.skew import if_small


def check(k1: float, b: float, limit: int) -> None:
    if not 0 <= k1 <= 3 or not 0 <= b <= 1.5 or limit < 1:
        raise ValueError("k1 must be from 0 to 3, b from 0 to 1.5, limit at least 1")


def bm25_weight(idf: Column, tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    """A term's part of the score; 0 where the denominator is 0."""
    below = tf + k1 * (1 - b + b * length / average)
    return F.coalesce(idf * tf * (k1 + 1) / F.nullif(below, F.lit(0.0)), F.lit(0.0))


def scores(queries: DataFrame, postings: DataFrame, stats: DataFrame, collection: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, positions) of every document with a term of a query (query_id, term).

    Repeated query terms count once. Scores are summed with map-side combining and rounded to 6 digits.
    """
    wanted = queries.distinct()
    weighted = if_small(wanted.join(stats, "term"), wanted)  # statistics have a row per term
    hits = postings.join(weighted, "term").crossJoin(F.broadcast(collection))  # one row
    weight = bm25_weight(F.col("idf"), F.col("tf"), F.col("doc_length"), F.col("avg_length"), k1, b)
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))


def top(scored: DataFrame, limit: int, by: str = "query_id") -> DataFrame:
    """The best `limit` documents of each query with their rank; ties by doc_id. Spark cuts each task's rows to the limit first."""
    w = W.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= limit)


def query_terms(queries: DataFrame, query_id: str, text: str, language: str, stopwords: Sequence[str]) -> DataFrame:
    """(query_id, term), distinct."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(T.kept(T.words(F.col(text), language), stopwords)).alias("term")).distinct()


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def rerank(ranked: DataFrame, vectors: DataFrame, query_vector: Column, limit: int = 20) -> DataFrame:
    """(doc_id, bm25, cosine, final, rank): final = round(round(bm25, 4) * round(cosine, 4), 4), joined by document."""
    joined = ranked.join(vectors, "doc_id")
    s = joined.select("doc_id", F.round("score", 4).alias("bm25"), F.round(cosine(F.col("embedding"), query_vector), 4).alias("cosine"))
    s = s.withColumn("final", F.round(F.col("bm25") * F.col("cosine"), 4))
    return s.orderBy(F.desc("final"), "doc_id").limit(limit)


def snippet(text: Column, positions: Column, terms: Column, window: int = 15, language: str = "en") -> Column:
    """Words around the first hit, hits marked, everything escaped, white space collapsed."""
    low, high = {"en": ("a-z", "A-Z"), "ru": ("а-яё", "А-ЯЁ")}[language]
    parts = T.matches(text, f"[{low}{high}]+|[^{low}{high}]+")
    is_word = lambda p: p.rlike(f"^[{low}{high}]")
    # words and what stands between them take turns, so a part's place tells which word it is or follows
    lead = F.when(F.size(parts) > 0, F.when(is_word(F.get(parts, F.lit(0))), 0).otherwise(1)).otherwise(0)
    nth = F.transform(parts, lambda _, i: F.floor((i - lead) / 2).cast("int"))
    total = F.floor((F.size(parts) - lead + 1) / 2).cast("int")
    best = F.least(F.coalesce(F.array_min(positions).cast("int"), F.lit(0)), total - 1)
    start, end = F.greatest(F.lit(0), best - window), F.least(total, best + window + 1)
    items = F.arrays_zip(parts.alias("p"), nth.alias("n"))
    inside = F.filter(items, lambda x: (x["n"] >= start) & (x["n"] < end) & ~((x["n"] == end - 1) & ~is_word(x["p"]) & (end < total)))
    shown = F.transform(inside, lambda x: F.when(is_word(x["p"]) & F.array_contains(terms, F.lower(x["p"])), F.concat(F.lit("<mark>"), x["p"], F.lit("</mark>"))).otherwise(T.escaped(x["p"])))
    body = F.concat(F.when(start > 0, "... ").otherwise(""), F.array_join(shown, ""), F.when(end < total, " ...").otherwise(""))
    return F.regexp_replace(F.when(total == 0, T.escaped(F.substring(text, 1, 300))).otherwise(body), r"[ \t\n\x0B\f\r]+", " ")


def resolve(references: DataFrame, docs: DataFrame, block: int = 10_000) -> DataFrame:
    """(ref_no, n_matches, doc_id): what a reference names, by path, exact title or file name, then a part of them.

    doc_id is the document if there is just one. An empty reference names none. References are broadcast in blocks of
    about `block`, each against all documents, and only counts and the smallest id leave a task.
    """
    r = references.select("ref_no", F.lower(F.trim("reference")).alias("ref"))
    r = r.withColumn("bare", F.trim(F.regexp_replace("ref", r"[.!?]+$", "")))
    d = docs.select("doc_id", F.lower("title").alias("t"), F.lower("file_path").alias("p"), F.lower(F.regexp_extract("file_path", r"([^/\\]+)$", 1)).alias("f"))
    blocks = max(1, -(-r.count() // block))
    fits = (F.col("ref") != "") & (F.col("t").contains(F.col("bare")) | F.col("f").contains(F.col("bare")) | (F.col("p") == F.col("ref")))
    found = reduce(DataFrame.unionByName, [d.join(F.broadcast(r.filter(F.pmod(F.xxhash64("ref_no"), F.lit(blocks)) == k)), fits) for k in range(blocks)])
    level = F.when(F.col("p") == F.col("ref"), 1).when((F.col("t") == F.col("ref")) | (F.col("f") == F.col("ref")), 2).when((F.col("t") == F.col("bare")) | (F.col("f") == F.col("bare")), 3).otherwise(4)
    counted = found.withColumn("level", level).groupBy("ref_no", "level").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    best = counted.groupBy("ref_no").agg(F.min_by(F.struct("n", "least"), "level").alias("x"))
    return r.join(best, "ref_no", "left").select("ref_no", F.coalesce("x.n", F.lit(0)).cast("bigint").alias("n_matches"), F.when(F.col("x.n") == 1, F.col("x.least")).alias("doc_id"))
