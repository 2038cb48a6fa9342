"""Queries of the general training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.operators.orphans import Reference, Target, orphan_references, orphan_report
from glyphmill.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    sentences = table(spark, folder, "sentences", "id", "doc_id", "created_at")
    return orphan_references(
        [
            Reference("sentences", sentences, "doc_id", "documents"),
            Reference("evaluation_judgment", table(spark, folder, "evaluation_judgment", "id", "doc_id", "created_at"), "doc_id", "documents"),
            Reference("tokens", table(spark, folder, "tokens", "id", "sentence_id", "created_at"), "sentence_id", "sentences"),
        ],
        [
            Target("documents", table(spark, folder, "documents", "doc_id", "date_added", "deleted_at"), "doc_id", "date_added", "deleted_at"),
            Target("sentences", sentences, "id", "created_at"),
        ],
    )


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(p5_found(spark, folder))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

_P5 = """
with refs as (
  select 'sentences' as table_name, id, doc_id as ref, created_at as made, 'documents' as target from sentences
  union all select 'evaluation_judgment', id, doc_id, created_at, 'documents' from evaluation_judgment
  union all select 'tokens', id, sentence_id, created_at, 'sentences' from tokens
), known as (
  select 'documents' as target, doc_id as ref, min(date_added) as arrived, min(deleted_at) as gone from documents group by doc_id
  union all select 'sentences', id, min(created_at), null from sentences group by id
), judged as (
  select r.table_name, r.id as record_id, strftime(r.made, '%Y-%m') as period,
    case when k.ref is null then 'missing' when k.gone is not null then 'deleted' when k.arrived > r.made then 'late' end as reason
  from refs r left join known k on k.target = r.target and k.ref = r.ref where r.ref is not null
), found as (select distinct table_name, record_id, period, reason from judged where reason is not null)
"""
SQL = {
    "p5_found": _P5 + "select table_name, record_id, period, reason from found",
    "p5_report": _P5 + "select table_name, period, reason, count(*) as n_records from found group by all",
}
