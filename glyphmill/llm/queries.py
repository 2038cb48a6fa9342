"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.labels import label_code
from glyphmill.llm import copies, frequencies, languages, leaks, oversized, pii, sentences, tokenizer
from glyphmill.plans.lineage import cut
from glyphmill.sources.tables import table

FIELDS = {
    "terms": frequencies.Field("terms.term_text", "id", "term_text", "language", "df", "updated_at"),
    "freq_words_english": frequencies.Field("freq_words_english.word", "id", "word", "document_filename", "doc_freq"),
    "tokens": frequencies.Field("tokens.lemma", "id", "lemma", "doc_id", None, "created_at"),
}
#: The moment of the first stored state of counts; later rows come as deltas. And the end of what a sliding state leaves out.
MOMENT, EXPIRED = "2025-07-01", "2024-07-01"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, "boundary")


def p1_content(spark: SparkSession, folder: str) -> DataFrame:
    """The same items cut by content-defined chunking."""
    return _pieces(spark, folder, "content")


def _pieces(spark: SparkSession, folder: str, method: str) -> DataFrame:
    docs = oversized.split_oversized(table(spark, folder, "documents", "doc_id", "text"), "doc_id", F.col("text"), 2000, 100, method)
    requests = oversized.split_oversized(table(spark, folder, "synthesis_request", "request_id", "text"), "request_id", F.col("text"), 600, 40, method)
    kind = lambda df, name: df.select(F.lit(name).alias("item_kind"), *df.columns)
    return kind(docs, "document").unionByName(kind(requests, "request"))


def _members(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copies(table(spark, folder, "documents", "doc_id", "text", "file_hash"), "doc_id", "text", "file_hash")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _members(spark, folder).filter("doc_id <> first_doc_id").select("first_doc_id", F.col("doc_id").alias("copy_doc_id"))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copy_counts(_members(spark, folder))


def _rows(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: table(spark, folder, t, *(c for c in (f.row_id, f.value, f.record, f.amount, f.at) if c)) for t, f in FIELDS.items()}


def _deltas(read: dict[str, DataFrame], added: Callable[[frequencies.Field], Column | None], removed: Callable[[frequencies.Field], Column | None]) -> DataFrame:
    """Deltas of all fields by the rows that the conditions choose; None chooses no row of a field."""
    parts = []
    for t, f in FIELDS.items():
        sides = [None if (c := chosen(f)) is None else read[t].filter(c) for chosen in (added, removed)]
        if any(x is not None for x in sides):
            parts.append(frequencies.deltas(*sides, f))
    return reduce(DataFrame.unionByName, parts)


def _before(f: frequencies.Field) -> Column:
    """Rows of the first state; those without time are in it."""
    return F.coalesce(F.col(f.at) < F.lit(MOMENT).cast("timestamp_ntz"), F.lit(True)) if f.at else F.lit(True)


def _after(f: frequencies.Field) -> Column | None:
    return ~_before(f) if f.at else None


def _nothing(f: frequencies.Field) -> None:
    return None


def _first_state(spark: SparkSession, read: dict[str, DataFrame]) -> DataFrame:
    """The state of MOMENT, stored and read again."""
    return spark.read.parquet(frequencies.store(frequencies.merge(None, _deltas(read, _before, _nothing))))


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    read = _rows(spark, folder)
    state = frequencies.merge(_first_state(spark, read), _deltas(read, _after, _nothing))
    counted = frequencies.counts(spark.read.parquet(frequencies.store(state)))
    above = lambda t: read[t].agg((F.count_distinct(FIELDS[t].record) * 0.4).alias("common_above"))
    totals = reduce(DataFrame.unionByName, [above(t).select(F.lit(FIELDS[t].name).alias("field_name"), "common_above") for t in ("tokens", "freq_words_english")])
    totals = totals.unionByName(spark.range(1).select(F.lit("terms.term_text").alias("field_name"), F.lit(3.0).alias("common_above")))
    return frequencies.verdicts(counted, totals)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).filter("verdict is not null").select("field_name", "term", "verdict")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder)


def p3_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a sliding state: the stored one of MOMENT, plus the rows since then, minus those from before EXPIRED."""
    read = _rows(spark, folder)
    expired = lambda f: _before(f) & (F.col(f.at) < F.lit(EXPIRED).cast("timestamp_ntz")) if f.at else None
    return frequencies.counts(frequencies.merge(_first_state(spark, read), _deltas(read, _after, expired)))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.split_sentences(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "source_language", "final_language")
    training = languages.train(languages.labelled_sample(docs, "doc_id", "text", "source_language", "final_language"))
    labels = docs.select("doc_id", "text", label_code(F.col("source_language")).alias("s"), label_code(F.col("final_language")).alias("f"))
    return languages.passages(labels, "doc_id", "text", training, ["s", "f"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.label_findings(_passages(spark, folder), "s", "f").select("doc_id", "language")


def p6_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's passages with language and confidence."""
    return _passages(spark, folder).drop("s", "f")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def _leaked(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "benchmark", "item_id", "text"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaked(spark, folder).select("doc_id", "item_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which evaluation items leaked, into how many documents, and the longest verbatim match."""
    return _leaked(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("match_words").cast("bigint").alias("longest_words"))


def p8_places(spark: SparkSession, folder: str) -> DataFrame:
    """Where the longest match of each document and item stands in the document."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return leaks.locations(docs, "doc_id", "text", cut(_leaked(spark, folder)))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are left when those with leaked passages are removed."""
    return leaks.without_leaks(table(spark, folder, "documents", "doc_id"), "doc_id", _leaked(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "given_names", "name"))


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text with placeholders."""
    return pii.redact_personal(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "given_names", "name"))


QUERIES = {q.__name__: q for q in (p1_found, p1_content, p2_found, p2_counts, p3_found, p3_counts, p3_delta, p4_found, p6_found, p6_passages, p7_ids, p8_found, p8_items, p8_places, p8_clean, p9_found, p9_redacted)}

_P3 = """
with all_rows as (
  select distinct 'tokens.lemma' as field_name, id, lemma as v, cast(doc_id as varchar) as record, 1 as amount, created_at as made from tokens
  union all select distinct 'freq_words_english.word', id, word, document_filename, coalesce(doc_freq, 0), null from freq_words_english
  union all select distinct 'terms.term_text', id, term_text, language, coalesce(df, 0), updated_at from terms
), rows as (select * from all_rows {where}), named as (
  select field_name, record, amount, nfc_normalize(lower(regexp_replace(v, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g'))) as term from rows
), counts as (
  select field_name, term, cast(sum(amount) as bigint) as occurrences, count(distinct record) as records from named where term <> '' group by all
), totals as (
  select field_name, case field_name when 'terms.term_text' then 3.0 else count(distinct record) * 0.4 end as above from rows group by field_name
), judged as (
  select field_name, term, occurrences, records, case when occurrences <= 2 then 'rare' when records > above then 'common' end as verdict from counts join totals using (field_name)
)
"""
_LETTERS = "replace(lower(regexp_replace(nfc_normalize({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')), 'ß', 'ss')"
_P2 = f"""
with recursive t as (
  select doc_id, text, text is null as no_text, nullif(regexp_replace(regexp_replace(lower(coalesce(file_hash, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '^sha256', ''), '') as hk,
    list_filter(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]')) as ls from documents
), c as (
  select *, len(ls) >= 3 and len(list_filter(ls, lambda x: not regexp_matches(x, '^\\s*[\\p{{L}}\\p{{N}}][^:：.!?]{{0,30}}[:：]\\s*\\S'))) = 0 as card from t
), k as (
  select doc_id, no_text, hk, nullif(case when card then 'card ' || array_to_string(list_sort(list_transform(ls, lambda x: {_LETTERS.format("x")})), chr(10)) else {_LETTERS.format("text")} end, '') as form from c
), keyed as (select doc_id, no_text, hk, coalesce(form, 'hash ' || hk) as key, form from k where form is not null or (no_text and hk is not null)),
pairs as (select distinct form as a, 'hash ' || hk as b from keyed where form is not null and hk in (select hk from keyed where no_text)),
e as (select a, b from pairs union select b, a from pairs),
r as (select a as key, a as other from e union select r.key, e.b from r join e on r.other = e.a),
g as (select key, min(doc_id) as least from keyed group by key),
f as (select g.key, min(coalesce(o.least, g.least)) as first_doc_id from g left join r on r.key = g.key left join g o on o.key = r.other group by g.key),
m as (select distinct doc_id, first_doc_id from keyed join f using (key))
"""
# the cut rule read off each piece's window of limit + 1 characters, from its start: the last blank line, line break, sentence mark, blank
_CLOSE = "\"''’”»“)\\]」』）"
_P1 = f"""with recursive items as (
  select 'document' as item_kind, doc_id as item_id, text, 2000 as lim, 100 as overlap from documents where length(text) > 2000
  union select 'request', request_id, text, 600, 40 from synthesis_request where length(text) > 600
), steps as (
  select item_kind, item_id, text, lim, overlap, 0 as s, cast(null as bigint) as e, false as done from items
  union all
  select item_kind, item_id, text, lim, overlap, s, case when length(text) - s <= lim then length(text) else s + coalesce(
    case when blank >= lim / 2 then blank end, case when line >= lim / 2 then line end, case when greatest(mark, free) >= lim / 2 then greatest(mark, free) end, case when gap >= lim / 2 then gap end, lim) end, length(text) - s <= lim
  from (select *, length(regexp_extract(substr(w, 1, lim), '(?s)^.*\\r?\\n\\r?\\n')) as blank, length(regexp_extract(substr(w, 1, lim), '(?s)^.*\\n')) as line,
    length(regexp_extract(w, '(?s)^(.*[.!?…।؟][{_CLOSE}]*)[ \\t\\r\\n]', 1)) as mark, length(regexp_extract(w, '(?s)^(.*[。！？][{_CLOSE}]*)[^{_CLOSE}]', 1)) as free, length(regexp_extract(substr(w, 1, lim), '(?s)^.* ')) as gap
    from (select item_kind, item_id, text, lim, overlap, case when e is null then 0 else e - overlap end as s, substr(text, case when e is null then 1 else e - overlap + 1 end, lim + 1) as w from steps where not done))
)
"""
_P8 = """with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
 i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from benchmark where text is not null),
 dw as (select doc_id, unnest(range(len(w) - 9)) as k, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) as g from d where len(w) >= 10),
 iw as (select item_id, unnest(range(len(w) - 9)) as k, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) as g from i where len(w) >= 10),
 pairs as materialized (select distinct doc_id, item_id, dw.k as dk, iw.k as ik from dw join iw using (g)), hit as (select distinct doc_id, item_id from pairs)
"""
# runs of pairs on one diagonal are one match
_P8_LONGEST = _P8 + """, islands as (select doc_id, item_id, dk - ik as diagonal, dk - row_number() over (partition by doc_id, item_id, dk - ik order by dk) as island from pairs),
 longest as (select doc_id, item_id, max(n) as n from (select doc_id, item_id, count(*) + 9 as n from islands group by doc_id, item_id, diagonal, island) group by doc_id, item_id)
"""
SQL = {
    "p1_found": _P1 + "select distinct item_kind, item_id, s as piece_start, e as piece_end from steps where e is not null",
    "p3_delta": _P3.format(where=f"where made is null or made >= timestamp '{EXPIRED}'") + "select field_name, term, occurrences, records from counts",
    "p3_found": _P3.format(where="") + "select field_name, term, verdict from judged where verdict is not null",
    "p3_counts": _P3.format(where="") + "select field_name, term, occurrences, records, verdict from judged",
    "p2_found": _P2 + "select first_doc_id, doc_id as copy_doc_id from m where doc_id <> first_doc_id",
    "p2_counts": _P2 + "select first_doc_id, count(*) as n_copies from m group by first_doc_id having count(*) > 1",
    "p8_found": _P8 + "select doc_id, item_id from hit",
    "p8_clean": _P8 + "select doc_id from documents where doc_id not in (select doc_id from hit)",
    "p8_items": _P8_LONGEST + "select item_id, count(*) as n_docs, max(n) as longest_words from longest group by item_id",
}
