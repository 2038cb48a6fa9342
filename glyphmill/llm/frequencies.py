"""Frequency of every distinct value or term, kept up to date by signed deltas.

The persistent state holds a row per term and record: how many occurrences and rows it has there. Rows that come, change
or go are aggregated into signed deltas of such pairs and merged into the state; the counts of a term are sums over it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.forms import nfc
from glyphmill.llm.forms import stripped
from glyphmill.plans.lineage import written

#: In place of a record for rows that have none; a few of them, so that a hot term's rows without record are spread.
NO_RECORD, NO_RECORDS = "\0", 32


@dataclass(frozen=True)
class Field:
    """Where terms stand: `value` in rows known by `row_id`; a row adds `amount` occurrences (None: 1) to `record`.

    `at` is the time that a row came into its state (None: the table tells no time).
    """

    name: str
    row_id: str
    value: str
    record: str
    amount: str | None = None
    at: str | None = None


def occurrences(rows: DataFrame, field: Field) -> DataFrame:
    """(term, record, row_id, amount) of the rows whose value isn't null or blank; null amounts count 0."""
    amount = F.coalesce(F.col(field.amount).cast("bigint"), F.lit(0)) if field.amount else F.lit(1).cast("bigint")
    term = F.nullif(nfc(F.lower(stripped(F.col(field.value)))), F.lit(""))
    none = F.concat(F.lit(NO_RECORD), F.pmod(F.xxhash64(field.row_id), F.lit(NO_RECORDS)).cast("string"))
    return rows.select(term.alias("term"), F.coalesce(F.col(field.record).cast("string"), none).alias("record"), F.col(field.row_id).alias("row_id"), amount.alias("amount")).filter("term is not null")


def deltas(added: DataFrame | None, removed: DataFrame | None, field: Field) -> DataFrame:
    """(field_name, term, record, d_amount, d_rows): signed changes by added and removed rows; a changed row is in both.

    Both may also be whole states of a table: what is in both cancels out. Repeated rows count once; where rows of one
    term and record share an id, the greatest amount counts. One shuffle: equal rows, and all rows of a pair, meet by
    term and record.
    """
    sides = [occurrences(rows, field).withColumn("s", F.lit(sign)) for sign, rows in ((1, added), (-1, removed)) if rows is not None]
    rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    once = rows.repartition("term", "record").groupBy("term", "record", "row_id", "s").agg(F.max("amount").alias("amount"))
    pairs = once.groupBy("term", "record").agg(F.sum(F.col("s") * F.col("amount")).cast("bigint").alias("d_amount"), F.sum("s").cast("bigint").alias("d_rows"))
    return pairs.filter("d_amount <> 0 or d_rows <> 0").select(F.lit(field.name).alias("field_name"), "term", "record", "d_amount", "d_rows")


def merge(state: DataFrame | None, changes: DataFrame) -> DataFrame:
    """(field_name, term, record, amount, n_rows) after `changes`; a pair whose last row went is gone."""
    rows = changes.select("field_name", "term", "record", F.col("d_amount").alias("amount"), F.col("d_rows").alias("n_rows"))
    if state is not None:
        both = state.select(*rows.columns).unionByName(rows)
        rows = both.groupBy("field_name", "term", "record").agg(F.sum("amount").alias("amount"), F.sum("n_rows").alias("n_rows"))
    return rows.filter("n_rows > 0 or amount <> 0")


def store(state: DataFrame) -> str:
    """Writes the state by field, in files by term and record as it is partitioned already, as many as its size asks for; gives the path."""
    return written(state, "counts", "field_name")


def counts(state: DataFrame) -> DataFrame:
    """(field_name, term, occurrences, records) of a state; rows without record add occurrences only."""
    has = (~F.col("record").startswith(NO_RECORD)).cast("bigint")
    return state.groupBy("field_name", "term").agg(F.sum("amount").cast("bigint").alias("occurrences"), F.sum(has).alias("records"))


def verdicts(counted: DataFrame, totals: DataFrame, rare: int = 2) -> DataFrame:
    """(field_name, term, occurrences, records, verdict); verdict is `rare`, `common` or null.

    `totals` has one row per field: (field_name, common_above), the number of records above which a term is common.
    """
    judged = counted.join(F.broadcast(totals), "field_name")
    verdict = F.when(F.col("occurrences") <= rare, "rare").when(F.col("records") > F.col("common_above"), "common")
    return judged.select("field_name", "term", "occurrences", "records", verdict.alias("verdict"))
