"""Language identification by word profiles: frequent words, short words, normalized profiles, votes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glyphmill.functions import text as T

WORD = r"[\p{L}\p{N}_]+"
LETTERS = r"\p{L}+"
PROFILE_WORD = r"\p{L}{2,}"
_BLANKS = re.compile(r"[ \t\n\x0B\f\r]+")
LEAST = 1e-10
SHORT = 5


def word_counts(docs: DataFrame, doc_id: str, text: str, pattern: str = WORD, *carry: str) -> DataFrame:
    """(doc_id, carry..., word, n)."""
    w = docs.select(F.col(doc_id).alias("doc_id"), *carry, F.explode(T.matches(F.lower(F.col(text)), pattern)).alias("word"))
    return w.groupBy("doc_id", *carry, "word").agg(F.count(F.lit(1)).alias("n"))


def frequent_profile(docs: DataFrame, lang: str, text: str, top: int = 300) -> DataFrame:
    """(lang, word, weight): the most frequent words of each language; ties by word."""
    counts = docs.select(F.col(lang).alias("lang"), F.explode(T.matches(F.lower(F.col(text)), PROFILE_WORD)).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("weight"))
    w = W.partitionBy("lang").orderBy(F.desc("weight"), "word")  # each task keeps only its best rows
    return counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).drop("r")


def short_profile(docs: DataFrame, lang: str, text: str, longest: int = SHORT, above: int = 3) -> DataFrame:
    """(lang, word, p): share of each short word that occurs more than `above` times, of all such words."""
    words = docs.select(F.col(lang).alias("lang"), F.explode(F.filter(T.matches(F.lower(F.col(text)), PROFILE_WORD), lambda x: F.length(x) <= longest)).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > above)
    totals = counts.groupBy("lang").agg(F.sum("c").alias("total"))  # a row per language
    return counts.join(totals, "lang").select("lang", "word", (F.col("c") / F.col("total")).alias("p"))


def normalized(profiles: DataFrame) -> DataFrame:
    """(lang, word, weight) with weights that sum to 1 per language."""
    totals = profiles.groupBy("lang").agg(F.sum("weight").alias("t"))
    return profiles.join(totals, "lang").select("lang", "word", (F.col("weight") / F.col("t")).alias("weight"))


def _best(scored: DataFrame) -> DataFrame:
    """The language with the highest score per document; ties by language."""
    return scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.ascii("lang") * 1000 - F.ascii(F.substring("lang", 2, 1))).alias("order"), "lang")).alias("x")).select("doc_id", "x.lang", "x.score")


def by_frequent_words(counts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, vote): the language with the greatest sum of weight x count; Unknown if no word is known."""
    scored = counts.join(profiles, "word").groupBy("doc_id", "lang").agg(F.round(F.sum(F.col("weight") * F.col("n")), 6).alias("score"))
    best = _best(scored.filter("score > 0"))
    return counts.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("lang", F.lit("Unknown")).alias("vote"))


def by_short_words(counts: DataFrame, profiles: DataFrame, longest: int = SHORT) -> DataFrame:
    """(doc_id, lang, score): sum of ln(p) over the short words; unknown ones have p = 1e-10."""
    short = counts.filter(F.length("word") <= longest)
    languages = sorted(r.lang for r in profiles.select("lang").distinct().collect() if r.lang)  # a row per language
    totals = short.groupBy("doc_id").agg(F.sum("n").alias("total")).select("doc_id", "total", F.explode(F.array(*map(F.lit, languages)).cast("array<string>")).alias("lang"))
    known = short.join(profiles, "word").groupBy("doc_id", "lang").agg(F.sum(F.col("n") * F.log("p")).alias("s"), F.sum("n").alias("k"))
    floor = F.log(F.lit(LEAST))
    score = F.coalesce("s", F.lit(0.0)) + (F.col("total") - F.coalesce("k", F.lit(0))) * floor
    return totals.join(known, ["doc_id", "lang"], "left").select("doc_id", "lang", F.round(score, 4).alias("score"))


def detect(counts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, vote): the language with the greatest normalized score; unknown if two tie or no word is known."""
    scored = counts.join(profiles, "word").groupBy("doc_id", "lang").agg(F.round(F.sum(F.col("weight") * F.col("n")), 9).alias("score"))
    per = scored.filter("score > 0").groupBy("doc_id").agg(F.max("score").alias("best"), F.collect_list(F.struct("score", "lang")).alias("all"))  # at most one entry per language
    vote = F.filter("all", lambda x: x["score"] == F.col("best"))
    picked = per.select("doc_id", F.when(F.size(vote) == 1, F.get(vote, F.lit(0))["lang"]).otherwise("unknown").alias("vote"))
    return counts.select("doc_id").distinct().join(picked, "doc_id", "left").select("doc_id", F.coalesce("vote", F.lit("unknown")).alias("vote"))


def majority(*votes: Column) -> Column:
    """The most frequent vote; of equally frequent ones the first."""
    same = [sum(((v == o).cast("int") for o in votes), F.lit(0)) for v in votes]
    most = F.greatest(*same)
    out = votes[-1]
    for v, n in list(zip(votes, same, strict=True))[::-1]:
        out = F.when(n == most, v).otherwise(out)
    return out


def char_windows(docs: DataFrame, doc_id: str, text: str, size: int = 200, step: int = 100, letters: int = 50) -> DataFrame:
    """(doc_id, start, chunk): sliding windows over the text with white space collapsed, if they have enough letters."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ").alias("t")).filter(F.length("t") > size)
    w = t.select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.length("t") - size - 1, F.lit(step))).alias("start"))
    chunk = F.substring(F.col("t"), F.col("start") + 1, F.lit(size))
    return w.select("doc_id", F.col("start").cast("bigint").alias("start"), chunk.alias("chunk")).filter(F.length(F.regexp_replace("chunk", r"[^\p{L}]", "")) > letters)


def top_ngrams(text: str, top: int, low: int = 2, high: int = 4) -> list[tuple[str, int]]:
    """The most frequent character n-grams of a text in small letters, white space as one blank; ties by n-gram.

    Characters are numbered in order, from 1; an n-gram is a number of `high` digits in that base, so that a shorter one
    stands before those it begins. high is so small that it fits 64 bits: 4 for up to 65,534 different characters.
    """
    t = _BLANKS.sub(" ", text).lower()
    letters, at = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
    base = len(letters) + 2
    if base**high >= 2**64:
        raise ValueError("too many different characters for n-grams of this length")
    digits, grams = at.astype(np.uint64) + np.uint64(1), []
    for n in range(low, high + 1):
        if len(digits) >= n:
            code = np.zeros(len(digits) - n + 1, dtype=np.uint64)
            for k in range(high):
                code = code * np.uint64(base) + (digits[k : k + len(code)] if k < n else np.uint64(0))
            grams.append(code)
    if not grams:
        return []
    codes, counts = np.unique(np.concatenate(grams), return_counts=True)
    least = np.partition(counts, len(counts) - top)[len(counts) - top] if len(counts) > top else 0
    some = np.flatnonzero(counts >= least)
    out = []
    for c, n in sorted(zip(codes[some].tolist(), counts[some].tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:top]:
        gram = []
        while c:
            c, digit = divmod(c, base)
            if digit:
                gram.append(chr(letters[digit - 1]))
        out.append(("".join(reversed(gram)), n))
    return out


def char_ngrams(docs: DataFrame, doc_id: str, text: str, top: int = 100) -> DataFrame:
    """(doc_id, ngram, n): the most frequent character 2-, 3- and 4-grams of each text.

    A document's n-grams are counted where its row is: as rows they would be three times as many as the characters of
    the corpus, all to be shuffled. Null and empty texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, g, n) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for g, n in top_ngrams(t, top)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "ngram", "n"])

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(run, "doc_id bigint, ngram string, n bigint")


#: Sizes of the classifier: windows per language, characters of a window and its step, n-grams, hidden layers.
WINDOWS, WINDOW, STEP, VOCABULARY, LAYERS = 150, 200, 100, 5000, (200, 100, 50)


def fit_classifier(chunks: DataFrame, vocabulary: int = VOCABULARY, layers: Sequence[int] = LAYERS, iterations: int = 20, least: int = 2, seed: int = 42):
    """A pipeline of character n-gram counts (of unit length, so that long texts are read as short ones) and a multilayer
    perceptron, fitted on (lang, chunk)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import CountVectorizer, Normalizer, StringIndexer

    sample = chunks.select("lang", T.ngrams(F.col("chunk")).alias("grams"))
    stages = [StringIndexer(inputCol="lang", outputCol="label", stringOrderType="alphabetAsc"), CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=vocabulary, minDF=least), Normalizer(inputCol="counts", outputCol="features")]
    model = Pipeline(stages=stages).fit(sample)
    sizes = [len(model.stages[1].vocabulary), *layers, len(model.stages[0].labels)]
    mlp = MultilayerPerceptronClassifier(layers=sizes, maxIter=iterations, seed=seed, blockSize=64)
    return model, mlp.fit(model.transform(sample))


def train_classifier(docs: DataFrame, lang: str, text: str, per_language: int = WINDOWS, window: int = WINDOW, step: int = STEP, seed: int = 42, **sizes):
    """A classifier fitted on sliding windows over whole labelled texts.

    Of each language the `per_language` windows with the smallest hashes are taken, which each task cuts before the
    shuffle; all bounds are parameters. Texts no longer than a window take part as they are.
    """
    d = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("doc_id"), F.col(text).alias("text"))
    windows = char_windows(d, "doc_id", "text", window, step).select(F.col("doc_id").alias("lang"), "chunk")
    short = d.select(F.col("doc_id").alias("lang"), F.regexp_replace("text", r"\s+", " ").alias("chunk")).filter((F.length("chunk") <= window) & (F.length(F.regexp_replace("chunk", r"[^\p{L}]", "")) > window // 4))
    rank = W.partitionBy("lang").orderBy(F.xxhash64("chunk", F.lit(seed)), "chunk")
    sample = windows.unionByName(short).withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= per_language).drop("r")
    return fit_classifier(sample, seed=seed, **sizes)


def stub_classifier(spark, sentences: dict[str, Sequence[str]], repeats: int = 50):
    """A small classifier of a few sentences per language, for places without a corpus."""
    rows = [(lang, s) for lang, ss in sentences.items() for s in ss for _ in range(repeats)]
    return fit_classifier(spark.createDataFrame(rows, "lang string, chunk string"), 1000, (100, 50), least=1)


def classify(docs: DataFrame, doc_id: str, text: str, model) -> DataFrame:
    """(doc_id, vote) by a trained classifier; a text without any known n-gram has what the bias says."""
    from pyspark.ml.feature import IndexToString

    features, mlp = model
    f = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), T.ngrams(F.col(text)).alias("grams"))
    for stage in features.stages[1:]:
        f = stage.transform(f)
    named = IndexToString(inputCol="prediction", outputCol="vote", labels=features.stages[0].labels).transform(mlp.transform(f))
    return named.select("doc_id", "vote")
