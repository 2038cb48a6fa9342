"""Queries of text processing and summaries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glyphmill import resources as R
from glyphmill.functions import text as T
from glyphmill.functions.labels import label_code, label_sql
from glyphmill.operators import chunking, summarize
from glyphmill.sources import files
from glyphmill.sources.tables import table

STOP = R.STOPWORDS["en"]


def _docs(spark, folder) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").filter("text is not null")


def _english(spark, folder) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text", "lang").filter((label_code(F.col("lang")) == "en") & F.col("text").isNotNull()).drop("lang")


def paragraphs(spark, folder):
    p = _docs(spark, folder).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("idx", "p"))
    w = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    return p.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.coalesce(F.sum(F.length("p")).over(w), F.lit(0)).cast("bigint").alias("start"), F.length("p").cast("bigint").alias("n_chars"))


def sentences(spark, folder):
    s = _docs(spark, folder).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "s"))
    return s.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.col("s.doc_start").cast("bigint").alias("doc_start"), F.col("s.para_start").cast("bigint").alias("para_start"), F.md5("s.text").alias("digest"))


def _rows(spark, folder) -> DataFrame:
    return summarize.sentence_rows(_english(spark, folder), "doc_id", "text", "en", STOP)


def _weights(spark, folder) -> DataFrame:
    return summarize.term_weights(_english(spark, folder), "doc_id", "text", "en", STOP, _english(spark, folder).agg(F.count(F.lit(1)).alias("n_docs")))


def summary_terms(spark, folder):
    return _english(spark, folder).select("doc_id", F.explode(summarize.terms(F.col("text"), "en", STOP)).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def summary_df(spark, folder):
    return summarize.document_frequency(_english(spark, folder), "text", "en", STOP)


def term_weights(spark, folder):
    return _weights(spark, folder).select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


def sentence_scores(spark, folder):
    return summarize.scored_sentences(_rows(spark, folder), _weights(spark, folder)).select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.round("score", 5).alias("score"))


def sentence_similarity(spark, folder):
    """Jaccard similarities of a document's sentences that share a term, computed in the document's row."""
    p = _rows(spark, folder).select("doc_id", F.explode(summarize.similar_sentences(F.transform("sentences", lambda x: x["terms"]))).alias("x"))
    return p.select("doc_id", "x.a", "x.b", F.round("x.similarity", 6).alias("similarity"))


def word_cooccurrence(spark, folder):
    """Pairs of words of the whole collection that stand within two places, per document, with their counts."""
    d = _english(spark, folder).select("doc_id", summarize.terms(F.col("text"), "en", STOP).alias("w"))
    pair = lambda k: F.transform(F.arrays_zip(F.col("w").alias("a"), F.slice("w", k + 1, F.greatest(F.size("w"), F.lit(1))).alias("b")), lambda x: F.struct(F.least(x["a"], x["b"]).alias("a"), F.greatest(x["a"], x["b"]).alias("b"), (x["b"].isNotNull() & (x["a"] != x["b"])).alias("ok")))
    p = d.select("doc_id", F.explode(F.filter(F.concat(pair(1), pair(2)), lambda x: x["ok"])).alias("p"))
    return p.groupBy("doc_id", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def textrank_sentences(spark, folder):
    r = _rows(spark, folder).select("doc_id", F.posexplode(summarize.rank_sentences(F.transform("sentences", lambda x: x["terms"]))).alias("idx", "rank"))
    return r.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.round("rank", 6).alias("rank"))


def textrank_words(spark, folder):
    d = _english(spark, folder).select("doc_id", F.explode(summarize.rank_words(summarize.terms(F.col("text"), "en", STOP))).alias("x"))
    return d.select("doc_id", "x.term", F.round("x.rank", 6).alias("rank"))


def summarize_(spark, folder):
    return summarize.summarize(_rows(spark, folder), _weights(spark, folder)).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "text", "combined")


def keywords(spark, folder):
    return summarize.keywords(_rows(spark, folder), _weights(spark, folder))


def summary_text(spark, folder):
    """The summary as numbered lines and the keywords as bullets."""
    s = summarize.summarize(_rows(spark, folder), _weights(spark, folder)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("s"))  # ten at most
    k = summarize.keywords(_rows(spark, folder), _weights(spark, folder), 15).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("k"))
    lines = F.transform("s", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["text"]))
    bullets = F.transform(F.coalesce("k", F.array().cast("array<struct<rank:bigint,term:string>>")), lambda x: F.concat(F.lit("- "), x["term"]))
    return s.join(k, "doc_id", "left").select("doc_id", F.array_join(F.concat(lines, F.array(F.lit("")), bullets), "\n").alias("summary"))


def clean_text(spark, folder):
    return _docs(spark, folder).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


def dirty_flag(spark, folder):
    return _docs(spark, folder).select("doc_id", T.is_dirty(F.col("text")).alias("dirty"))


def normalize_text(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest"), F.length(T.normalize(F.col("text"))).cast("bigint").alias("n_chars"))


def validate_text(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "text")
    return d.select("doc_id", F.coalesce(T.reading_error(F.col("text"), 5000), F.lit("ok")).alias("verdict"))


def decode_validate(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    error = files.decoded(F.col("content"), most=10_000)["error"]
    return d.select("doc_id", F.when(F.col("content").isNull(), "unreadable").otherwise(F.coalesce(error, F.lit("ok"))).alias("verdict"))


def html_text_extract(spark, folder):
    return R.PAGES.frame(spark).select("id", T.html_text(F.col("html")).alias("text"))


def natural_sort(spark, folder):
    w = W.orderBy("key", "name")
    return R.NAMES_TO_SORT.frame(spark).select("name", T.natural_key(F.col("name")).alias("key")).select("name", F.row_number().over(w).cast("bigint").alias("place"))


def chunk_greedy(spark, folder):
    c = chunking.chunk_greedy(_docs(spark, folder), "doc_id", "text", 500)
    return c.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("digest"))


def chapter_split(spark, folder):
    c = chunking.chapter_split(_docs(spark, folder), "doc_id", "text", 2000)
    return c.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.length("fragment").cast("bigint").alias("n_chars"), F.md5("fragment").alias("digest"))


_ALL = (paragraphs, sentences, summary_terms, summary_df, term_weights, sentence_scores, sentence_similarity, word_cooccurrence, textrank_sentences, textrank_words, keywords, summary_text, clean_text, dirty_flag, normalize_text, validate_text, decode_validate, html_text_extract, natural_sort, chunk_greedy, chapter_split)
QUERIES = {q.__name__: q for q in _ALL} | {"summarize": summarize_}

_S = R.sql_list(STOP)
_EN = f"{label_sql('lang')} = 'en' and text is not null"
_TERMS = f"tt as materialized (select doc_id, term from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from documents where {_EN}) where length(term) > 2 and term not in {_S})"
_TW = f"tf as materialized (select doc_id, term, count(*) as tf from tt group by all), df as (select term, count(*) as df from tf group by term), nd as (select count(*) as n from documents where {_EN}), tw as materialized (select doc_id, term, tf, 0.5 * (1 + tf / max(tf) over (partition by doc_id)) * ln(n / df) as weight from tf join df using (term), nd)"
_WS = "[\\s\\p{Z}\\x{85}\\x0B\\x1C-\\x1F]"
_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g')"


def _sentences(where: str) -> str:
    """para and sent: the numbered sentences of the chosen documents."""
    return f"""pa as (select doc_id, text, regexp_extract_all(text, '(?s).+?(?:(?:\\r?\\n){{2,}}|\\z)') as ps from documents where {where}),
 para as (select doc_id, unnest(range(len(ps))) as pi, unnest(ps) as p from pa), pst as (select doc_id, pi, p, coalesce(sum(length(p)) over (partition by doc_id order by pi rows between unbounded preceding and 1 preceding), 0) as pstart from para),
 sx as (select doc_id, pi, p, pstart, regexp_extract_all(p, '[^.!?]+(?:[.!?]+|$)') as ms, length(regexp_extract(p, '^[.!?]*')) as lead from pst),
 se as (select doc_id, pi, p, pstart, lead, unnest(range(len(ms))) as si, unnest(ms) as m from sx),
 so as (select doc_id, pi, si, p, pstart, m, lead + coalesce(sum(length(m)) over (partition by doc_id, pi order by si rows between unbounded preceding and 1 preceding), 0) as st from se),
 sn as (select doc_id, pi, si, trim(regexp_replace(m, '{_WS}+', ' ', 'g')) as text, pstart + st as doc_start, st as para_start, greatest(length({_STRIP.format('p')}), 1) as para_length from so),
 sl as (select * from sn where length(text) >= 20),
 sent as materialized (select doc_id, row_number() over (partition by doc_id order by pi, si) - 1 as idx, text, doc_start, para_start, para_length from sl
  union all select doc_id, 0, {_STRIP.format('text')}, 0, 0, greatest(length(text), 1) from documents where {where} and doc_id not in (select doc_id from sl) and {_STRIP.format('text')} <> '')"""


_ST = f"st as materialized (select doc_id, idx, term, count(*) as n from (select doc_id, idx, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from sent) where length(term) > 2 and term not in {_S} group by all)"
# written out apart from the implementation's; RE2 has no class of unassigned characters
_UNCLEAN = "(?:[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\p{Cf}\\p{Co}\\p{So}\\x{FFFD}\\x{1F000}-\\x{1FAFF}]|[^\\p{L}\\p{M}\\p{N}\\p{P}\\p{S}\\p{Z}\\p{C}])"
_CONTROLS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]"


def _clean(t: str) -> str:
    x = f"regexp_replace({t}, '{_UNCLEAN}', ' ', 'g')"
    x = f"regexp_replace({x}, '\\r\\n|\\r', '\n', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), ' ?\\n ?', '\n', 'g')"
    return f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', '\n\n', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


def _norm(t: str) -> str:
    x = f"regexp_replace(regexp_replace(regexp_replace(nfc_normalize({t}), '\\r\\n|\\r|\\x{{2028}}', '\n', 'g'), '\\x{{2029}}', '\n\n', 'g'), '[\\x{{FEFF}}\\x{{200B}}\\x{{00AD}}]', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[\\t\\x0B\\f\\p{{Zs}}]+', ' ', 'g'), ' ?\\n ?', '\n', 'g')"
    return f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', '\n\n', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


SQL = {
    "paragraphs": f"with {_sentences('text is not null')} select doc_id, pi as idx, cast(pstart as bigint) as start, length(p) as n_chars from pst",
    "sentences": f"with {_sentences('text is not null')} select doc_id, idx, cast(doc_start as bigint) as doc_start, cast(para_start as bigint) as para_start, md5(text) as digest from sent",
    "summary_terms": f"with {_TERMS} select doc_id, term, count(*) as n from tt group by all",
    "summary_df": f"with {_TERMS} select term, count(distinct doc_id) as df from tt group by term",
    "term_weights": f"with {_TERMS}, {_TW} select doc_id, term, tf, round(weight, 6) as weight from tw",
    "sentence_scores": f"with {_TERMS}, {_TW}, {_sentences(_EN)}, {_ST}, sm as (select doc_id, idx, sum(n * weight) as s from st join tw using (doc_id, term) group by all) select sent.doc_id, sent.idx, round(greatest(1 - doc_start / greatest(length(d.text), 1), 0) * greatest(1 - para_start / para_length, 0) * coalesce(s, 0), 5) as score from sent join documents d using (doc_id) left join sm using (doc_id, idx)",
    "sentence_similarity": f"with {_sentences(_EN)}, {_ST}, nn as (select doc_id, idx, count(*) as n from st group by all), k as (select a.doc_id, a.idx as a, b.idx as b, count(*) as k from st a join st b on a.doc_id = b.doc_id and a.term = b.term and a.idx < b.idx group by all) select k.doc_id, k.a, k.b, round(k / (x.n + y.n - k), 6) as similarity from k join nn x on x.doc_id = k.doc_id and x.idx = k.a join nn y on y.doc_id = k.doc_id and y.idx = k.b",
    "word_cooccurrence": f"with o as (select doc_id, pos, term from (select doc_id, unnest(range(len(w))) as pos, unnest(w) as term from (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w from documents where {_EN})) where length(term) > 2 and term not in {_S}), l as (select doc_id, term as a, unnest([lead(term, 1) over w, lead(term, 2) over w]) as b from o window w as (partition by doc_id order by pos)) select doc_id, least(a, b) as a, greatest(a, b) as b, count(*) as n from l where b is not null and a <> b group by 1, 2, 3",
    "clean_text": f"select doc_id, {_clean('text')} as cleaned from documents where text is not null",
    "dirty_flag": f"with c as (select doc_id, text, {_clean('text')} as c from documents where text is not null) select doc_id, case when c = '' then false else contains(text, chr(65533)) or length(text) - length(regexp_replace(text, '{_UNCLEAN}', '', 'g')) > greatest(10, floor(length(text) / 200)) or length(regexp_replace(c, '[^\\p{{L}}]', '', 'g')) < 50 end as dirty from c",
    "normalize_text": f"select doc_id, md5({_norm('text')}) as digest, length({_norm('text')}) as n_chars from documents where text is not null",
    "validate_text": f"with p as (select doc_id, text, {_norm('text')} as p from documents), l as (select *, length(regexp_replace(p, '[^\\p{{L}}]', '', 'g')) as n, length(regexp_replace(p, '[^A-Za-zªºÀ-ÖØ-öø-ʸḀ-ỿ]', '', 'g')) as k from p) select doc_id, case when text is null then 'no_text' when regexp_matches(text, '{_CONTROLS}') then 'control_characters' when p = '' then 'empty' when length(p) > 5000 then 'too_long' when n = 0 then 'no_letters' when k / n < 0.7 then 'not_latin' else 'ok' end as verdict from l",
    "decode_validate": f"select doc_id, case when text is null then 'unreadable' when strlen(text) = 0 then 'empty' when strlen(text) > 10000 then 'too_large' when regexp_matches(text, '{_CONTROLS}') then 'control_characters' else 'ok' end as verdict from documents",
    "html_text_extract": f"select id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '{_WS}+', ' ', 'g')) as text from {R.PAGES.values()}",
    "natural_sort": f"with k as (select name, array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda x: case when regexp_matches(x, '^[0-9]') then chr(1) || lpad(ltrim(x, '0'), 18, '0') else x end), '') as key from {R.NAMES_TO_SORT.values()}) select name, row_number() over (order by key, name) as place from k",
}


def _pagerank(nodes: str, edges: str, key: str) -> str:
    """r30: 30 steps of PageRank over nodes (doc_id, key) and undirected edges (doc_id, a, b, w), each a table of its own."""
    out = f"""pn as materialized (select doc_id, {key}, count(*) over (partition by doc_id) as n from {nodes}), pe as materialized (select doc_id, a, b, w from {edges} union all select doc_id, b, a, w from {edges}),
 po as materialized (select doc_id, a, sum(w) as total from pe group by doc_id, a), ps as materialized (select pe.doc_id, pe.a, pe.b, w / total as share from pe join po on po.doc_id = pe.doc_id and po.a = pe.a),
 pl as materialized (select pn.*, po.total is null as loose from pn left join po on po.doc_id = pn.doc_id and po.a = pn.{key}), r0 as materialized (select *, 1 / n as rank from pl)"""
    for k in range(30):
        out += f""", r{k + 1} as materialized (select r.doc_id, r.{key}, r.n, r.loose, 0.15 / r.n + 0.85 * (coalesce(i.s, 0) + coalesce(l.s, 0) / r.n) as rank from r{k} r
 left join (select ps.doc_id, ps.b, sum(q.rank * share) as s from ps join r{k} q on q.doc_id = ps.doc_id and q.{key} = ps.a group by ps.doc_id, ps.b) i on i.doc_id = r.doc_id and i.b = r.{key} left join (select doc_id, sum(rank) as s from r{k} where loose group by doc_id) l on l.doc_id = r.doc_id)"""
    return out


_SIMILAR = "nn as (select doc_id, idx, count(*) as n from st group by all), sk as (select a.doc_id, a.idx as a, b.idx as b, count(*) as k from st a join st b on a.doc_id = b.doc_id and a.term = b.term and a.idx < b.idx group by all), se2 as materialized (select sk.doc_id, sk.a, sk.b, k / (x.n + y.n - k) as w from sk join nn x on x.doc_id = sk.doc_id and x.idx = sk.a join nn y on y.doc_id = sk.doc_id and y.idx = sk.b)"
_NEAR = f"o as (select doc_id, pos, term from (select doc_id, unnest(range(len(w))) as pos, unnest(w) as term from (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w from documents where {_EN})) where length(term) > 2 and term not in {_S}), nl as (select doc_id, term as a, unnest([lead(term, 1) over w, lead(term, 2) over w]) as b from o window w as (partition by doc_id order by pos)), ne as materialized (select doc_id, least(a, b) as a, greatest(a, b) as b, count(*) as w from nl where b is not null and a <> b group by 1, 2, 3)"
_SENTENCE_RANKS = f"{_sentences(_EN)}, {_ST}, {_SIMILAR}, {_pagerank('(select doc_id, idx from sent)', 'se2', 'idx')}"
_WORD_RANKS = f"{_NEAR}, {_pagerank('(select distinct doc_id, term from o)', 'ne', 'term')}"
_RANKED = f"""{_TERMS}, {_TW}, {_SENTENCE_RANKS}, sm as (select doc_id, idx, sum(n * weight) as s from st join tw using (doc_id, term) group by all),
 sc as (select sent.doc_id, sent.idx, sent.text, greatest(1 - doc_start / greatest(length(d.text), 1), 0) * greatest(1 - para_start / para_length, 0) * coalesce(s, 0) as score from sent join documents d using (doc_id) left join sm using (doc_id, idx)),
 cb as (select sc.doc_id, sc.idx, sc.text, score, rank, max(score) over (partition by sc.doc_id) as ms, max(rank) over (partition by sc.doc_id) as mr from sc join r30 on r30.doc_id = sc.doc_id and r30.idx = sc.idx),
 cc as (select doc_id, idx, text, round(0.2 * case when ms > 0 then score / ms else 0 end + 0.8 * case when mr > 0 then rank / mr else 0 end, 6) as combined from cb), top10 as materialized (select * from cc qualify row_number() over (partition by doc_id order by combined desc, idx) <= 10)"""
_KEYS = f"""{_TERMS}, {_TW}, {_sentences(_EN)}, {_ST}, {_WORD_RANKS}, ks as (select doc_id, term, sum(n) * any_value(weight) as score from st join tw using (doc_id, term) group by doc_id, term),
 mk as (select doc_id, max(score) as ms from ks group by doc_id), mr as (select doc_id, max(rank) as mr from r30 group by doc_id),
 kc as (select ks.doc_id, ks.term, round(0.2 * case when ms > 0 then score / ms else 0 end + 0.8 * case when mr > 0 then coalesce(rank, 0) / mr else 0 end, 6) as score from ks join mk using (doc_id) join mr using (doc_id) left join r30 on r30.doc_id = ks.doc_id and r30.term = ks.term),
 kr as materialized (select doc_id, row_number() over (partition by doc_id order by score desc, term) as rank, term, score from kc)"""
SQL |= {
    "textrank_sentences": f"with {_SENTENCE_RANKS} select doc_id, idx, round(rank, 6) as rank from r30",
    "textrank_words": f"with {_WORD_RANKS} select doc_id, term, round(rank, 6) as rank from r30",
    "summarize": f"with {_RANKED} select doc_id, idx, text, combined from top10",
    "keywords": f"with {_KEYS} select doc_id, rank, term, score from kr where rank <= 20",
    "summary_text": f"""select doc_id, array_to_string(list_concat(list_concat(lines, ['']), coalesce(bullets, [])), chr(10)) as summary
 from (select doc_id, list(place || '. ' || text order by place) as lines from (select doc_id, text, row_number() over (partition by doc_id order by idx) as place from (with {_RANKED} select doc_id, idx, text from top10)) group by doc_id)
 left join (select doc_id, list('- ' || term order by rank) as bullets from (with {_KEYS} select doc_id, rank, term from kr where rank <= 15) group by doc_id) using (doc_id)""",
}
