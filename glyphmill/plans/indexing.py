"""Queries of index, search and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill import resources as R
from glyphmill.functions import text as T
from glyphmill.functions.labels import label_code, label_sql
from glyphmill.operators import evaluate, index, search
from glyphmill.plans.skew import if_small
from glyphmill.sources.tables import table

QUERY = "The famous comet and the old archive near the northern harbour"
QUERY_RU = "старая карта порта и жёлтое письмо"
VERSION = 2


def _docs(spark: SparkSession, folder: str, language: str = "en", *more: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text", "lang", *more).filter(label_code(F.col("lang")) == language)


def _tokens(spark: SparkSession, folder: str, language: str = "en") -> DataFrame:
    return index.tokens(_docs(spark, folder, language), "doc_id", language, R.STOPWORDS[language])


def _lengths(spark: SparkSession, folder: str, language: str = "en") -> DataFrame:
    return index.lengths(_docs(spark, folder, language), "doc_id", language, R.STOPWORDS[language])


def documents_listed(spark, folder):
    """Documents by title, then id; a sort by ranges, so no task gathers them."""
    return table(spark, folder, "documents", "doc_id", "title").select("doc_id", "title").orderBy(F.col("title").asc_nulls_last(), "doc_id")


def scan_documents(spark, folder):
    return table(spark, folder, "documents", "doc_id", "title", "file_path", "source", "n_chars").select("doc_id", "title", "file_path", "source", F.col("n_chars").cast("bigint").alias("n_chars"), F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1).alias("extension"))


def content_hash(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "text", "file_hash")
    digest = F.sha2(F.encode("text", "UTF-8"), 256)
    return d.select("doc_id", digest.alias("digest"), F.coalesce(digest == F.col("file_hash"), F.lit(False)).alias("intact"))


def tokenize_en(spark, folder):
    return _tokens(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("term").alias("n_terms"))


def tokenize_lang(spark, folder):
    both = [_tokens(spark, folder, x).select(F.lit(x).alias("lang"), "doc_id", "term") for x in ("en", "ru")]
    return both[0].unionByName(both[1]).groupBy("lang", "doc_id", "term").agg(F.count(F.lit(1)).alias("cnt"))


def token_positions(spark, folder):
    return _tokens(spark, folder).select("doc_id", "pos", "term")


def inverted_index(spark, folder):
    return index.postings(_tokens(spark, folder)).select("doc_id", "term", "cnt", F.round("tf", 8).alias("tf"), F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def collection_stats(spark, folder):
    return index.collection_stats(_lengths(spark, folder)).select("n_docs", F.round("avg_length", 6).alias("avg_length"))


def term_stats(spark, folder):
    return index.term_stats(_tokens(spark, folder), _lengths(spark, folder)).select("term", "df", F.round("idf", 6).alias("idf"))


def term_stats_lang(spark, folder):
    each = [index.term_stats(_tokens(spark, folder, x), _lengths(spark, folder, x)).select(F.lit(x).alias("lang"), "term", "df", F.round("idf", 6).alias("idf")) for x in ("en", "ru")]
    return each[0].unionByName(each[1])


def _scored(spark, folder, queries: DataFrame, language: str = "en", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    search.check(k1, b, 1)
    toks, sizes = _tokens(spark, folder, language), _lengths(spark, folder, language)
    hits = toks.join(if_small(queries.select("term").distinct()), "term", "left_semi")  # only words of the queries are shuffled
    return search.scores(queries, index.postings(hits), index.term_stats(hits, sizes), index.collection_stats(sizes), k1, b)


def _literal_query(spark, text: str, language: str) -> DataFrame:
    return search.query_terms(spark.range(1).select(F.lit(0).alias("id"), F.lit(text).alias("q")), "id", "q", language, R.STOPWORDS[language])


def bm25_search(spark, folder):
    ranked = search.top(_scored(spark, folder, _literal_query(spark, QUERY, "en")), 100)
    return ranked.select("rank", "doc_id", F.round("score", 4).alias("score"))


def bm25_by_lang(spark, folder):
    parts = [search.top(_scored(spark, folder, _literal_query(spark, q, x), x), 20).select(F.lit(x).alias("lang"), "rank", "doc_id", F.round("score", 4).alias("score")) for x, q in (("en", QUERY), ("ru", QUERY_RU))]
    return parts[0].unionByName(parts[1])


def bm25_positions(spark, folder):
    ranked = search.top(_scored(spark, folder, _literal_query(spark, QUERY, "en")), 100)
    return ranked.select("doc_id", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def snippet(spark, folder):
    ranked = search.top(_scored(spark, folder, _literal_query(spark, QUERY, "en")), 20)
    terms = F.lit([w for w in QUERY.lower().split() if w not in R.STOPWORDS["en"]])
    return _docs(spark, folder).join(F.broadcast(ranked.select("doc_id", "positions")), "doc_id").select("doc_id", search.snippet(F.col("text"), F.col("positions"), terms).alias("snippet"))


def _queries(spark, folder) -> DataFrame:
    return table(spark, folder, "evaluation_query", "id", "query_text").select(F.col("id").alias("query_id"), "query_text")


def _latest_judgments(spark, folder) -> DataFrame:
    j = table(spark, folder, "evaluation_judgment", "id", "query_id", "doc_id", "relevant", "created_at").filter("query_id is not null and doc_id is not null")
    return index.upsert_latest(j, ["query_id", "doc_id"], "created_at", "id")


def _ranked(spark, folder) -> DataFrame:
    q = _queries(spark, folder)
    return search.top(_scored(spark, folder, search.query_terms(q, "query_id", "query_text", "en", R.STOPWORDS["en"])).drop("positions"), 50)


def _relevant(spark, folder) -> DataFrame:
    return _latest_judgments(spark, folder).filter("relevant = 1").select("query_id", "doc_id")


def _ks(spark, folder) -> DataFrame:
    return evaluate.k_ladder(_lengths(spark, folder).agg(F.count(F.lit(1)).alias("n_docs")))


def k_ladder(spark, folder):
    return _ks(spark, folder)


def precision_recall_at_k(spark, folder):
    return evaluate.at_k(_queries(spark, folder), _ranked(spark, folder), _relevant(spark, folder), _ks(spark, folder))


def average_precision(spark, folder):
    return evaluate.average_precision(_queries(spark, folder), _ranked(spark, folder), _relevant(spark, folder))


def map_(spark, folder):
    return average_precision(spark, folder).agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("ap"), 6).alias("map"))


def pr_curve_11pt(spark, folder):
    c = evaluate.curve(_queries(spark, folder), _ranked(spark, folder), _relevant(spark, folder))
    return c.groupBy("level").agg(F.round(F.avg("precision"), 5).alias("precision"))


def evaluation_report(spark, folder):
    each = precision_recall_at_k(spark, folder).groupBy("k").agg(*[F.round(F.avg(m), 5).alias(m) for m in ("precision", "recall", "f1")])
    return each.crossJoin(F.broadcast(map_(spark, folder).select(F.round("map", 5).alias("map"))))


def judgment_status(spark, folder):
    ranked = _ranked(spark, folder).select("query_id", "doc_id", "rank")
    status = F.when(F.col("relevant") == 1, "relevant").when(F.col("relevant") == 0, "not relevant").otherwise("not assessed")
    return ranked.join(_latest_judgments(spark, folder).select("query_id", "doc_id", "relevant"), ["query_id", "doc_id"], "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def upsert_latest(spark, folder):
    return _latest_judgments(spark, folder).select("query_id", "doc_id", "id", F.col("relevant").cast("bigint").alias("relevant"))


def _vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings", "vec_id", "embedding").filter("embedding is not null")


def _query_vector(spark, folder) -> DataFrame:
    return _vectors(spark, folder).agg(F.min_by("embedding", "vec_id").alias("q"))  # one row


def cosine_topk(spark, folder):
    v = _vectors(spark, folder).crossJoin(F.broadcast(_query_vector(spark, folder)))
    return v.select("vec_id", F.round(search.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(20)


def rerank(spark, folder):
    ranked = search.top(_scored(spark, folder, _literal_query(spark, QUERY, "en")), 100)
    v = _vectors(spark, folder).crossJoin(F.broadcast(_query_vector(spark, folder))).select(F.col("vec_id").alias("doc_id"), "embedding", "q")
    return search.rerank(ranked, v, F.col("q"), 20)


def terms_missing(spark, folder):
    known = table(spark, folder, "terms", "term_text", "language").filter(label_code(F.col("language")) == "en").select(F.lower(F.trim("term_text")).alias("term"))
    return index.missing_terms(_tokens(spark, folder), known)


def _half(docs: DataFrame) -> DataFrame:
    """A state of the collection from before 2026."""
    return docs.filter(F.col("date_added") < F.lit("2026-01-01").cast("timestamp_ntz"))


def index_replace_doc(spark, folder):
    docs = _docs(spark, folder, "en", "date_added")
    old = index.postings(index.tokens(_half(docs), "doc_id", "en", R.STOPWORDS["en"]))
    touched = docs.join(_half(docs).select("doc_id"), "doc_id", "left_anti")
    new = index.postings(index.tokens(touched, "doc_id", "en", R.STOPWORDS["en"]))
    return index.replace_documents(old, new, touched).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("cnt"))


def index_delete_doc(spark, folder):
    docs = _docs(spark, folder, "en", "deleted_at")
    left = index.without_documents(index.postings(_tokens(spark, folder)), docs.filter("deleted_at is not null"))
    return left.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("cnt"))


def index_current(spark, folder):
    docs = _docs(spark, folder, "en", "file_hash", "date_added", "status")
    old = F.col("date_added") < F.lit("2025-01-01").cast("timestamp_ntz")
    state = index.lengths(docs, "doc_id", "en", R.STOPWORDS["en"]).join(docs.select("doc_id", F.lower("file_hash").alias("indexed_hash"), F.when(old, VERSION - 1).otherwise(VERSION).alias("processing_version")), "doc_id")
    return index.current(docs.select("doc_id", "file_hash", "status"), state, VERSION).select("doc_id", "status")


def resolve_document(spark, folder):
    return search.resolve(R.REFERENCES.frame(spark), table(spark, folder, "documents", "doc_id", "title", "file_path"))


_ALL = (scan_documents, documents_listed, content_hash, tokenize_en, tokenize_lang, token_positions, inverted_index, collection_stats, term_stats, term_stats_lang, bm25_search, bm25_by_lang, bm25_positions, snippet, k_ladder, precision_recall_at_k, average_precision, pr_curve_11pt, evaluation_report, judgment_status, upsert_latest, cosine_topk, rerank, terms_missing, index_replace_doc, index_delete_doc, index_current, resolve_document)
QUERIES = {q.__name__: q for q in _ALL} | {"map": map_}


def _tok(language: str) -> str:
    return f"""(select doc_id, pos, term from (select doc_id, unnest(range(len(w))) as pos, unnest(w) as term from (select doc_id, regexp_extract_all(lower(text), '{T.ALPHABETS[language]}') as w from documents where {label_sql('lang')} = '{language}' and text is not null))
 where length(term) > 1 and term not in {R.sql_list(R.STOPWORDS[language])})"""


def _base(language: str = "en", name: str = "") -> str:
    """tok, len, col, stats and post of a language."""
    n = name
    return f"""tok{n} as materialized {_tok(language)}, len{n} as materialized (select doc_id, count(*) as doc_length from tok{n} group by doc_id), col{n} as (select count(*) as n_docs, avg(doc_length) as avg_length from len{n}),
 post{n} as materialized (select doc_id, doc_length, term, count(*) as cnt, count(*) / doc_length as tf, list_sort(list(pos)) as positions from tok{n} join len{n} using (doc_id) group by doc_id, doc_length, term),
 stats{n} as materialized (select term, count(*) as df, log10(any_value(n_docs) / count(*)) as idf from post{n}, col{n} group by term)"""


def _score(query_cte: str, n: str = "") -> str:
    return f"(select query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_length / avg_length))), 6) as score, list_sort(list_distinct(flatten(list(positions)))) as positions from post{n} join {query_cte} using (term) join stats{n} using (term), col{n} group by query_id, doc_id)"


def _literal(text: str, language: str) -> str:
    return f"(select distinct 0 as query_id, t as term from (select unnest(regexp_extract_all(lower('{text}'), '{T.ALPHABETS[language]}')) as t) where length(t) > 1 and t not in {R.sql_list(R.STOPWORDS[language])})"


_RANK = "row_number() over (partition by query_id order by score desc, doc_id) as rank"
_ONE = f"with {_base()}, q as {_literal(QUERY, 'en')}, s as materialized {_score('q')}, r as (select *, {_RANK} from s)"
_LATEST = "(select query_id, doc_id, id, relevant from evaluation_judgment where query_id is not null and doc_id is not null qualify row_number() over (partition by query_id, doc_id order by created_at desc, id desc, relevant desc) = 1)"
_EVAL = f"""with {_base()}, qs as (select id as query_id, query_text from evaluation_query),
 q as (select distinct query_id, t as term from (select query_id, unnest(regexp_extract_all(lower(query_text), '[a-z]+')) as t from qs) where length(t) > 1 and t not in {R.sql_list(R.STOPWORDS["en"])}),
 s as materialized {_score("q")}, r as materialized (select * from (select query_id, doc_id, score, {_RANK} from s) where rank <= 50),
 latest as materialized {_LATEST}, rel as (select query_id, doc_id from latest where relevant = 1), tot as (select query_id, count(*) as n_relevant from rel group by query_id),
 ks as (select unnest(list_distinct(list_append(list_filter(list_transform(range(0, 51), lambda i: cast(5 * pow(2, i) as bigint)), lambda k: k < n_docs), n_docs))) as k from col where n_docs > 0),
 j as materialized (select r.*, case when rel.doc_id is null then 0 else 1 end as hit from r left join rel using (query_id, doc_id)),
 h as (select query_id, k, sum(hit) as hits, count(*) as seen from j, ks where rank <= k group by query_id, k),
 raw as (select query_id, k, coalesce(hits / seen, 0) as p, coalesce(hits / n_relevant, 0) as rc from qs cross join ks left join h using (query_id, k) left join tot using (query_id)),
 prk as (select query_id, k, round(p, 6) as precision, round(rc, 6) as recall, round(coalesce(2 * p * rc / nullif(p + rc, 0), 0), 6) as f1 from raw),
 so as (select query_id, rank, hit, sum(hit) over (partition by query_id order by rank) as so_far from j), pts as materialized (select query_id, so_far, so_far / rank as p from so where hit = 1),
 ap as (select query_id, coalesce(any_value(n_relevant), 0) as n_relevant, round(coalesce(sum(p) / any_value(n_relevant), 0), 6) as ap from qs left join tot using (query_id) left join pts using (query_id) group by query_id),
 lv as (select query_id, unnest(range(11)) as level from qs),
 cv as (select lv.query_id, lv.level, round(coalesce(max(pts.p), 0), 6) as precision from lv left join tot using (query_id) left join pts on pts.query_id = lv.query_id and floor(so_far * 10 / n_relevant + 1e-9) >= lv.level group by all)
"""
_COS = "list_dot_product(cast(embedding as double[]), cast(q as double[])) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product(cast(q as double[]), cast(q as double[]))))"
_VEC = "vec as (select vec_id, embedding, (select arg_min(embedding, vec_id) from embeddings) as q from embeddings where embedding is not null)"
_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
SQL = {
    "documents_listed": "select doc_id, title from documents order by title nulls last, doc_id",
    "scan_documents": "select doc_id, title, file_path, source, n_chars, regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1) as extension from documents",
    "content_hash": "select doc_id, sha256(text) as digest, coalesce(sha256(text) = file_hash, false) as intact from documents",
    "tokenize_en": f"select doc_id, count(*) as n_tokens, count(distinct term) as n_terms from {_tok('en')} group by doc_id",
    "tokenize_lang": f"select 'en' as lang, doc_id, term, count(*) as cnt from {_tok('en')} group by doc_id, term union all select 'ru', doc_id, term, count(*) from {_tok('ru')} group by doc_id, term",
    "token_positions": f"select doc_id, pos, term from {_tok('en')}",
    "inverted_index": f"with {_base()} select doc_id, term, cnt, round(tf, 8) as tf, array_to_string(positions, ',') as positions from post",
    "collection_stats": f"with {_base()} select n_docs, round(avg_length, 6) as avg_length from col",
    "term_stats": f"with {_base()} select term, df, round(idf, 6) as idf from stats",
    "term_stats_lang": f"with {_base()}, {_base('ru', '2')} select 'en' as lang, term, df, round(idf, 6) as idf from stats union all select 'ru', term, df, round(idf, 6) from stats2",
    "bm25_search": f"{_ONE} select rank, doc_id, round(score, 4) as score from r where rank <= 100",
    "bm25_by_lang": f"with {_base()}, {_base('ru', '2')}, q as {_literal(QUERY, 'en')}, q2 as {_literal(QUERY_RU, 'ru')}, a as (select 'en' as lang, *, {_RANK} from {_score('q')}), b as (select 'ru' as lang, *, {_RANK} from {_score('q2', '2')}) select lang, rank, doc_id, round(score, 4) as score from (select * from a union all select * from b) where rank <= 20",
    "bm25_positions": f"{_ONE} select doc_id, array_to_string(positions, ',') as positions from r where rank <= 100",
    "k_ladder": f"{_EVAL} select k from ks",
    "precision_recall_at_k": f"{_EVAL} select query_id, k, precision, recall, f1 from prk",
    "average_precision": f"{_EVAL} select query_id, n_relevant, ap from ap",
    "map": f"{_EVAL} select count(*) as n_queries, round(avg(ap), 6) as map from ap",
    "pr_curve_11pt": f"{_EVAL} select level, round(avg(precision), 5) as precision from cv group by level",
    "evaluation_report": f"{_EVAL} select k, round(avg(precision), 5) as precision, round(avg(recall), 5) as recall, round(avg(f1), 5) as f1, (select round(round(avg(ap), 6), 5) from ap) as map from prk group by k",
    "judgment_status": f"{_EVAL} select case relevant when 1 then 'relevant' when 0 then 'not relevant' else 'not assessed' end as status, count(*) as n from r left join latest using (query_id, doc_id) group by 1",
    "upsert_latest": f"select query_id, doc_id, id, cast(relevant as bigint) as relevant from {_LATEST}",
    "cosine_topk": f"with {_VEC} select vec_id, round({_COS}, 6) as cosine from vec order by cosine desc, vec_id limit 20",
    "rerank": f"{_ONE}, {_VEC}, f as (select doc_id, round(score, 4) as bm25, round({_COS}, 4) as cosine from r join vec on vec_id = doc_id where rank <= 100) select doc_id, bm25, cosine, round(bm25 * cosine, 4) as final from f order by final desc, doc_id limit 20",
    "terms_missing": f"select distinct term from {_tok('en')} where term not in (select lower(trim(term_text)) from terms where {label_sql('language')} = 'en' and term_text is not null)",
    "index_replace_doc": f"with {_base()} select term, count(*) as df, cast(sum(cnt) as bigint) as cnt from post group by term",
    "index_delete_doc": f"with {_base()} select term, count(*) as df, cast(sum(cnt) as bigint) as cnt from post where doc_id in (select doc_id from documents where deleted_at is null) group by term",
    "index_current": f"with {_base()} select doc_id, status from documents join len using (doc_id) where {label_sql('lang')} = 'en' and file_hash = lower(file_hash) and not coalesce(date_added < timestamp '2025-01-01', false)",
    "resolve_document": f"""with r as (select ref_no, lower(trim(reference)) as ref, trim(regexp_replace(lower(trim(reference)), '[.!?]+$', '')) as bare from {R.REFERENCES.values()}),
 d as (select doc_id, lower(title) as t, lower(file_path) as p, lower(regexp_extract(file_path, '([^/\\\\]+)$', 1)) as f from documents),
 m as (select ref_no, doc_id, case when p = ref then 1 when t = ref or f = ref then 2 when t = bare or f = bare then 3 else 4 end as level from r, d where ref <> '' and (contains(t, bare) or contains(f, bare) or p = ref)),
 c as (select * from (select ref_no, level, count(*) as n, min(doc_id) as least from m group by ref_no, level) qualify row_number() over (partition by ref_no order by level) = 1)
 select ref_no, coalesce(n, 0) as n_matches, case when n = 1 then least end as doc_id from r left join c using (ref_no)""",
}
_KEPT_TERMS = "['famous', 'comet', 'old', 'archive', 'near', 'northern', 'harbour']"
SQL["snippet"] = f"""{_ONE}, hits as (select doc_id, positions from r where rank <= 20), p as (select doc_id, text, positions, regexp_extract_all(text, '[a-zA-Z]+|[^a-zA-Z]+') as p, length(regexp_extract(text, '^[^a-zA-Z]+')) > 0 as led from hits join documents using (doc_id)),
 m as (select *, case when led then 1 else 0 end as lead, (len(p) - case when led then 1 else 0 end + 1) // 2 as total from p), w as (select *, least(list_min(positions), total - 1) as best from m),
 x as (select *, greatest(0, best - 15) as s, least(total, best + 16) as e from w),
 y as (select doc_id, s, e, total, text, list_transform(range(2 * s + lead + 1, least(len(p), 2 * e - 1 + lead + case when e = total then 1 else 0 end) + 1), lambda k: p[k]) as shown from x)
 select doc_id, regexp_replace(case when total = 0 then {_ESCAPED.format("substr(text, 1, 300)")} else case when s > 0 then '... ' else '' end || array_to_string(list_transform(shown, lambda w: case when regexp_matches(w, '^[a-zA-Z]') then case when list_contains({_KEPT_TERMS}, lower(w)) then '<mark>' || w || '</mark>' else w end else {_ESCAPED.format("w")} end), '') || case when e < total then ' ...' else '' end end, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') as snippet from y"""
