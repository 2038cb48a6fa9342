"""Inverted index: postings with relative term frequency and positions, collection and term statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T


def kept_words(docs: DataFrame, language: str, stopwords: Sequence[str], text: str = "text", longer_than: int = 1) -> DataFrame:
    """`docs` with `kept`: array<struct<pos, term>> of the words that count; pos is the place among all words."""
    w = T.words(F.col(text), language)
    placed = F.transform(w, lambda x, i: F.struct(i.cast("bigint").alias("pos"), x.alias("term")))
    return docs.withColumn("kept", F.filter(placed, lambda x: (F.length(x["term"]) > longer_than) & ~x["term"].isin(list(stopwords))))


def tokens(docs: DataFrame, doc_id: str, language: str, stopwords: Sequence[str], normalizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, doc_length, pos, term) of the words that count. Null and empty texts have none."""
    k = kept_words(docs.select(F.col(doc_id).alias("doc_id"), "text"), language, stopwords)
    out = k.select("doc_id", F.size("kept").cast("bigint").alias("doc_length"), F.explode("kept").alias("k")).select("doc_id", "doc_length", "k.pos", "k.term")
    return out.withColumn("term", normalizer(F.col("term"))) if normalizer else out


def lengths(docs: DataFrame, doc_id: str, language: str, stopwords: Sequence[str]) -> DataFrame:
    """(doc_id, doc_length) of the documents that have a word that counts. Needs no shuffle."""
    k = kept_words(docs.select(F.col(doc_id).alias("doc_id"), "text"), language, stopwords)
    return k.select("doc_id", F.size("kept").cast("bigint").alias("doc_length")).filter("doc_length > 0")


def postings(toks: DataFrame) -> DataFrame:
    """(doc_id, doc_length, term, cnt, tf, positions); tf is relative to the document's length."""
    p = toks.groupBy("doc_id", "doc_length", "term").agg(F.count(F.lit(1)).alias("cnt"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return p.select("doc_id", "doc_length", "term", "cnt", (F.col("cnt") / F.col("doc_length")).alias("tf"), "positions")


def collection_stats(sizes: DataFrame) -> DataFrame:
    """One row (n_docs, avg_length)."""
    return sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_length").alias("avg_length"))


def term_stats(toks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = log10(N / df). Pairs are made distinct before the count."""
    df = toks.select("doc_id", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = sizes.agg(F.count(F.lit(1)).alias("n_docs"))  # one row
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log10(F.col("n_docs") / F.col("df")).alias("idf"))


def without_documents(rows: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deletes the rows of some documents (their keys)."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def replace_documents(rows: DataFrame, new: DataFrame, touched: DataFrame, key: str = "doc_id") -> DataFrame:
    """Replaces the rows of the touched documents by `new`."""
    return without_documents(rows, touched, key).unionByName(new)


def current(docs: DataFrame, state: DataFrame, version: int) -> DataFrame:
    """Documents whose index is up to date: same version, same hash, a length above 0."""
    fresh = state.filter((F.col("processing_version") == version) & (F.col("doc_length") > 0)).select("doc_id", "indexed_hash")
    return docs.join(fresh, "doc_id").filter(F.col("file_hash") == F.col("indexed_hash")).drop("indexed_hash")


def missing_terms(terms: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct terms that aren't known yet."""
    return terms.select("term").distinct().join(known.select("term").distinct(), "term", "left_anti")


def upsert_latest(rows: DataFrame, keys: Sequence[str], *latest: str) -> DataFrame:
    """One row per key: the one with the greatest `latest` columns. Aggregates on the map side, so hot keys don't matter."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(*latest, *[c for c in rest if c not in latest])
    return rows.groupBy(*keys).agg(F.max(order).alias("x")).select(*keys, *[f"x.{c}" for c in rest])


def delete_all(rows: DataFrame) -> DataFrame:
    """The table without any row."""
    return rows.filter(F.lit(False))


def delete_where(rows: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and one row (n_deleted); a condition that is null deletes nothing."""
    sure = F.coalesce(gone, F.lit(False))
    return rows.filter(~sure), rows.agg(F.count_if(sure).alias("n_deleted"))
