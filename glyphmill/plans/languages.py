"""Queries of language identification, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill import resources as R
from glyphmill.functions.labels import LANGUAGES as LANGS
from glyphmill.functions.labels import label_code, label_sql
from glyphmill.operators import langid
from glyphmill.sources.tables import table


def _docs(spark, folder) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text", "lang").filter("text is not null")


def _labelled(spark, folder) -> DataFrame:
    """Texts of all languages, with the code that the label names."""
    return _docs(spark, folder).withColumn("lang", label_code(F.col("lang"))).filter("lang is not null")


def _profiles(spark, folder, method: str) -> DataFrame:
    return table(spark, folder, "lang_profiles").filter(F.col("method") == method).select("lang", "word", "weight")


def _counts(spark, folder) -> DataFrame:
    return langid.word_counts(_docs(spark, folder), "doc_id", "text")


def word_counts(spark, folder):
    return _counts(spark, folder)


def profile_frequent(spark, folder):
    return langid.frequent_profile(_labelled(spark, folder), "lang", "text")


def profile_short(spark, folder):
    return langid.short_profile(_labelled(spark, folder), "lang", "text").withColumn("p", F.round("p", 8))


def profile_normalize(spark, folder):
    return langid.normalized(_profiles(spark, folder, "frequent")).withColumn("weight", F.round("weight", 8))


def profile_metadata(spark, folder):
    return table(spark, folder, "lang_profiles").groupBy("lang", "method").agg(F.count(F.lit(1)).alias("n_words"), F.round(F.sum("weight"), 4).alias("total"))


def lang_frequent(spark, folder):
    return langid.by_frequent_words(_counts(spark, folder), _profiles(spark, folder, "frequent"))


def _short(spark, folder) -> DataFrame:
    return langid.by_short_words(_counts(spark, folder), _profiles(spark, folder, "short").withColumnRenamed("weight", "p"))


def lang_short(spark, folder):
    best = _short(spark, folder).groupBy("doc_id").agg(F.max("score").alias("score"), F.min_by("lang", F.struct(-F.col("score"), "lang")).alias("vote"))
    return best.select("doc_id", "vote", "score")


def lang_detect(spark, folder):
    counts = langid.word_counts(_docs(spark, folder), "doc_id", "text", langid.LETTERS)
    return langid.detect(counts, langid.normalized(_profiles(spark, folder, "frequent")))


def lang_vote(spark, folder):
    a, b, c = (q(spark, folder).select("doc_id", F.col("vote").alias(n)) for q, n in ((lang_frequent, "frequent"), (lang_short, "short"), (lang_detect, "detected")))
    votes = _docs(spark, folder).select("doc_id").join(a, "doc_id", "left").join(b, "doc_id", "left").join(c, "doc_id", "left").fillna("Unknown", ["frequent", "short", "detected"])
    return votes.select("doc_id", "frequent", "short", "detected", langid.majority(F.col("frequent"), F.col("short"), F.col("detected")).alias("final"))


def lang_nn(spark, folder):
    """The votes of the classifier, trained on windows of the labelled texts."""
    model = langid.train_classifier(_labelled(spark, folder), "lang", "text")
    return langid.classify(_docs(spark, folder), "doc_id", "text", model)


def lang_nn_stub(spark, folder):
    """Votes between English and Spanish of a classifier that knows a few sentences."""
    docs = _labelled(spark, folder).filter(F.col("lang").isin(*R.STUB_SENTENCES))
    return langid.classify(docs, "doc_id", "text", langid.stub_classifier(spark, R.STUB_SENTENCES))


def lang_vote_nn(spark, folder):
    """The vote of frequent words, short words and the classifier."""
    a, b, c = (q(spark, folder).select("doc_id", F.col("vote").alias(n)) for q, n in ((lang_frequent, "frequent"), (lang_short, "short"), (lang_nn, "nn")))
    votes = _docs(spark, folder).select("doc_id").join(a, "doc_id", "left").join(b, "doc_id", "left").join(c, "doc_id", "left").fillna("Unknown", ["frequent", "short", "nn"])
    return votes.select("doc_id", "frequent", "short", "nn", langid.majority(F.col("frequent"), F.col("short"), F.col("nn")).alias("final"))


def vote_crosstab(spark, folder):
    d = table(spark, folder, "documents", "status", "res_frequent_words", "res_short_words", "res_nn", "final_language").filter("status = 'processed'")
    name = lambda c: F.coalesce(F.nullif(F.initcap(F.lower(F.trim(c))), F.lit("")), F.lit("None"))
    long = d.select(F.explode(F.array(*[F.struct(F.lit(m).alias("method"), name(c).alias("language")) for m, c in (("frequent", "res_frequent_words"), ("short", "res_short_words"), ("nn", "res_nn"), ("final", "final_language"))])).alias("x")).select("x.*")
    count = lambda m: F.count_if(F.col("method") == m).alias(m)
    return long.groupBy("language").agg(count("frequent"), count("short"), count("nn"), count("final"))


def profile_doc_freq(spark, folder):
    d = _labelled(spark, folder)
    counts = langid.word_counts(d, "doc_id", "text")
    rows = d.select("doc_id", "lang").join(_profiles(spark, folder, "frequent"), "lang")
    return rows.join(counts, ["doc_id", "word"], "left").select("doc_id", "word", F.col("weight").cast("bigint").alias("train_freq"), F.coalesce("n", F.lit(0)).cast("bigint").alias("doc_freq"))


def short_word_probs(spark, folder):
    counts = langid.word_counts(_labelled(spark, folder), "doc_id", "text", langid.WORD, "lang").filter(F.length("word") <= langid.SHORT)
    rows = counts.join(_profiles(spark, folder, "short"), ["lang", "word"], "left")
    return rows.select("doc_id", "word", F.coalesce("weight", F.lit(0.0)).alias("train_prob"), F.coalesce("weight", F.lit(langid.LEAST)).alias("assigned_prob"), F.col("n").alias("doc_freq"))


def profile_coverage(spark, folder):
    f = profile_doc_freq(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_profile"), F.count_if(F.col("doc_freq") > 0).alias("n_found"))
    s = short_word_probs(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_short"), F.count_if(F.col("train_prob") > 0).alias("n_known"), F.round(F.sum(F.log("assigned_prob")), 4).alias("log_sum"))
    return f.join(s, "doc_id").select("doc_id", "n_profile", "n_found", F.floor(F.col("n_found") * 100 / F.col("n_profile")).alias("found_percent"), "n_short", "n_known", "log_sum")


def char_windows(spark, folder):
    return langid.char_windows(_labelled(spark, folder), "doc_id", "text").select("doc_id", "start", F.md5("chunk").alias("digest"))


def char_ngrams(spark, folder):
    return langid.char_ngrams(_docs(spark, folder), "doc_id", "text")


def freq_union(spark, folder):
    """The frequent words of all languages in one table with a language column."""
    each = [_profiles(spark, folder, "frequent").filter(F.col("lang") == x).select("word", "weight").withColumn("lang", F.lit(x)) for x in LANGS]
    return reduce(DataFrame.unionByName, each).select("lang", "word", F.col("weight").cast("bigint").alias("weight"))


_ALL = (word_counts, profile_frequent, profile_short, profile_normalize, profile_metadata, lang_frequent, lang_short, lang_detect, lang_vote, lang_nn, lang_nn_stub, lang_vote_nn, vote_crosstab, profile_doc_freq, short_word_probs, profile_coverage, char_windows, char_ngrams, freq_union)
QUERIES = {q.__name__: q for q in _ALL}

_IN = "('" + "', '".join(LANGS) + "')"
_LAB = f"(select * replace ({label_sql('lang')} as lang) from documents where text is not null and {label_sql('lang')} is not null)"
_WC = f"wc as materialized (select doc_id, w as word, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '{langid.WORD}')) as w from documents where text is not null) group by all)"
_PW = f"pw as materialized (select lang, unnest(regexp_extract_all(lower(text), '{langid.PROFILE_WORD}')) as word from {_LAB})"
_FREQ = "freq as (select lang, word, weight from lang_profiles where method = 'frequent'), short as (select lang, word, weight as p from lang_profiles where method = 'short')"
_NORM = "norm as (select lang, word, weight / sum(weight) over (partition by lang) as weight from freq)"
_VF = "vf as (select d.doc_id, coalesce(lang, 'Unknown') as vote from (select distinct doc_id from wc) d left join (select doc_id, lang from (select doc_id, lang, round(sum(weight * n), 6) as score from wc join freq using (word) group by all having round(sum(weight * n), 6) > 0) qualify row_number() over (partition by doc_id order by score desc, lang) = 1) using (doc_id))"
_VS = "sc as materialized (select t.doc_id, l.lang, round(coalesce(s, 0) + (total - coalesce(k, 0)) * ln(1e-10), 4) as score from (select doc_id, sum(n) as total from wc where length(word) <= 5 group by doc_id) t cross join (select distinct lang from short) l left join (select doc_id, lang, sum(n * ln(p)) as s, sum(n) as k from wc join short using (word) where length(word) <= 5 group by all) using (doc_id, lang)), vs as (select doc_id, lang as vote, score from sc qualify row_number() over (partition by doc_id order by score desc, lang) = 1)"
_VD = f"lc as materialized (select doc_id, w as word, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '{langid.LETTERS}')) as w from documents where text is not null) group by all), ds as materialized (select doc_id, lang, round(sum(weight * n), 9) as score from lc join norm using (word) group by all), dm as (select doc_id, max(score) as best from ds where score > 0 group by doc_id), dv as (select doc_id, case when count(*) = 1 then any_value(lang) else 'unknown' end as vote from ds join dm using (doc_id) where score = best group by doc_id), vd as (select doc_id, coalesce(vote, 'unknown') as vote from (select distinct doc_id from lc) left join dv using (doc_id))"
_NAME = "coalesce(nullif(upper(substr(trim({0}), 1, 1)) || lower(substr(trim({0}), 2)), ''), 'None')"
_PDF = f"pdf as materialized (select d.doc_id, f.word, cast(f.weight as bigint) as train_freq, coalesce(n, 0) as doc_freq from (select doc_id, lang from {_LAB}) d join freq f using (lang) left join wc on wc.doc_id = d.doc_id and wc.word = f.word)"
_SWP = f"swp as materialized (select d.doc_id, wc.word, coalesce(p, 0) as train_prob, coalesce(p, 1e-10) as assigned_prob, n as doc_freq from (select doc_id, lang from {_LAB}) d join wc using (doc_id) left join short s on s.lang = d.lang and s.word = wc.word where length(wc.word) <= 5)"
_GRAM = "g as (select doc_id, lower(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as t from documents where text is not null), gg as (select doc_id, unnest(flatten(list_transform([2, 3, 4], lambda k: list_transform(range(1, length(t) - k + 2), lambda i: substr(t, i, k))))) as ngram from g)"
SQL = {
    "word_counts": f"with {_WC} select doc_id, word, n from wc",
    "profile_frequent": f"with {_PW} select lang, word, count(*) as weight from pw group by all qualify row_number() over (partition by lang order by count(*) desc, word) <= 300".replace("group by all", "group by lang, word"),
    "profile_short": f"with {_PW}, c as (select lang, word, count(*) as c from pw where length(word) <= 5 group by lang, word having count(*) > 3) select lang, word, round(c / sum(c) over (partition by lang), 8) as p from c",
    "profile_normalize": f"with {_FREQ}, {_NORM} select lang, word, round(weight, 8) as weight from norm",
    "profile_metadata": "select lang, method, count(*) as n_words, round(sum(weight), 4) as total from lang_profiles group by lang, method",
    "lang_frequent": f"with {_WC}, {_FREQ}, {_VF} select doc_id, vote from vf",
    "lang_short": f"with {_WC}, {_FREQ}, {_VS} select doc_id, vote, score from vs",
    "lang_detect": f"with {_FREQ}, {_NORM}, {_VD} select doc_id, vote from vd",
    "lang_vote": f"with {_WC}, {_FREQ}, {_NORM}, {_VF}, {_VS}, {_VD}, v as (select d.doc_id, coalesce(vf.vote, 'Unknown') as frequent, coalesce(vs.vote, 'Unknown') as short, coalesce(vd.vote, 'Unknown') as detected from documents d left join vf using (doc_id) left join vs using (doc_id) left join vd using (doc_id) where text is not null) select *, case when frequent = short or frequent = detected then frequent when short = detected then short else frequent end as final from v",
    "vote_crosstab": "with x as (" + " union all ".join(f"select '{m}' as method, {_NAME.format(c)} as language from documents where status = 'processed'" for m, c in (("frequent", "res_frequent_words"), ("short", "res_short_words"), ("nn", "res_nn"), ("final", "final_language"))) + ") select language, " + ", ".join(f"count(*) filter (where method = '{m}') as {m}" for m in ("frequent", "short", "nn", "final")) + " from x group by language",
    "profile_doc_freq": f"with {_WC}, {_FREQ}, {_PDF} select doc_id, word, train_freq, doc_freq from pdf",
    "short_word_probs": f"with {_WC}, {_FREQ}, {_SWP} select doc_id, word, train_prob, assigned_prob, doc_freq from swp",
    "profile_coverage": f"with {_WC}, {_FREQ}, {_PDF}, {_SWP}, f as (select doc_id, count(*) as n_profile, count(*) filter (where doc_freq > 0) as n_found from pdf group by doc_id), s as (select doc_id, count(*) as n_short, count(*) filter (where train_prob > 0) as n_known, round(sum(ln(assigned_prob)), 4) as log_sum from swp group by doc_id) select doc_id, n_profile, n_found, cast(floor(n_found * 100 / n_profile) as bigint) as found_percent, n_short, n_known, log_sum from f join s using (doc_id)",
    "char_windows": f"with t as (select doc_id, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') as t from {_LAB}), w as (select doc_id, s as start, substr(t, s + 1, 200) as chunk from (select doc_id, t, unnest(range(0, length(t) - 200, 100)) as s from t where length(t) > 200)) select doc_id, start, md5(chunk) as digest from w where length(regexp_replace(chunk, '[^\\p{{L}}]', '', 'g')) > 50",
    "char_ngrams": f"with {_GRAM}, c as (select doc_id, ngram, count(*) as n from gg group by doc_id, ngram) select doc_id, ngram, n from c qualify row_number() over (partition by doc_id order by n desc, ngram) <= 100",
    "freq_union": f"select lang, word, cast(weight as bigint) as weight from lang_profiles where method = 'frequent' and lang in {_IN}",
}
