"""Quality of retrieval: precision, recall and F1 at k, average precision, 11-point curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def k_ladder(n: DataFrame, column: str = "n_docs") -> DataFrame:
    """(k): 5, 10, 20, ... below the size, then the size itself; of a one-row frame."""
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: (5 * F.pow(F.lit(2.0), i)).cast("bigint")), lambda k: k < F.col(column))
    return n.filter(F.col(column) > 0).select(F.explode(F.array_distinct(F.concat(steps, F.array(F.col(column).cast("bigint"))))).alias("k"))


def judged(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Ranked rows with hit (0 or 1); `relevant` has distinct (query_id, doc_id)."""
    return ranked.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def at_k(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, ks: DataFrame) -> DataFrame:
    """(query_id, k, precision, recall, f1) of every query; precision divides by what was retrieved, at most k."""
    totals = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = judged(ranked, relevant).crossJoin(F.broadcast(ks)).filter(F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("seen"))
    all_ = queries.select("query_id").crossJoin(F.broadcast(ks)).join(hits, ["query_id", "k"], "left").join(totals, "query_id", "left")
    p = F.coalesce(F.col("hits") / F.col("seen"), F.lit(0.0))
    r = F.coalesce(F.col("hits") / F.col("n_relevant"), F.lit(0.0))
    out = all_.select("query_id", "k", p.alias("p"), r.alias("r"))
    return out.select("query_id", "k", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(F.coalesce(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0)), 6).alias("f1"))


def _hits(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)  # a query has few ranks
    return judged(ranked, relevant).withColumn("so_far", F.sum("hit").over(w)).filter("hit = 1").withColumn("p", F.col("so_far") / F.col("rank"))


def average_precision(queries: DataFrame, ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, n_relevant, ap); a query without relevant documents has 0."""
    totals = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    sums = _hits(ranked, relevant).groupBy("query_id").agg(F.sum("p").alias("s"))
    out = queries.select("query_id").join(totals, "query_id", "left").join(sums, "query_id", "left")
    return out.select("query_id", F.coalesce("n_relevant", F.lit(0)).cast("bigint").alias("n_relevant"), F.round(F.coalesce(F.col("s") / F.col("n_relevant"), F.lit(0.0)), 6).alias("ap"))


def curve(queries: DataFrame, ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, level, precision): interpolated precision at the recall levels 0, 0.1, ..., 1 (level counts tenths)."""
    totals = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    points = _hits(ranked, relevant).join(totals, "query_id").select("query_id", "p", F.floor(F.col("so_far") * 10 / F.col("n_relevant") + 1e-9).alias("reached"))
    best = points.groupBy("query_id").agg(*[F.max(F.when(F.col("reached") >= i, F.col("p"))).alias(f"p{i}") for i in range(11)])
    out = queries.select("query_id").join(best, "query_id", "left").select("query_id", F.posexplode(F.array(*[F.coalesce(f"p{i}", F.lit(0.0)) for i in range(11)])).alias("level", "precision"))
    return out.select("query_id", F.col("level").cast("bigint").alias("level"), F.round("precision", 6).alias("precision"))
