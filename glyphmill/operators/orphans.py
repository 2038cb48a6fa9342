"""References to records that do not exist.

Skew-aware split: references are pre-aggregated per target, key and period (on the map side first). Keys that hold many
rows, whose number is bounded by HEAVY_KEYS, are checked by broadcasting them to the target tables; all other keys by a
shuffled join of distinct keys. The groups found bad by either way are united, and only rows of these groups are read
again, those of heavy keys by broadcast, so that no hot key's rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.plans.lineage import cut
from glyphmill.plans.skew import HEAVY_KEYS, split_join


@dataclass(frozen=True)
class Reference:
    """`rows` refers by `key` to the target named `target`; a row's own id and time are in `row_id` and `at`."""

    name: str
    rows: DataFrame
    key: str
    target: str
    row_id: str = "id"
    at: str = "created_at"


@dataclass(frozen=True)
class Target:
    """A referred-to table: its key, when a record arrived, and when it was deleted (None: never)."""

    name: str
    rows: DataFrame
    key: str
    arrived: str
    deleted: str | None = None


_KEY, _GROUP = ["target", "ref"], ["target", "ref", "period"]


def _known(targets: Sequence[Target], only: DataFrame | None = None) -> DataFrame:
    """(target, ref, arrived, gone): a row per key of the targets; with `only`, of these keys, which are broadcast."""
    parts = []
    for t in targets:
        gone = F.col(t.deleted) if t.deleted else F.lit(None).cast("timestamp_ntz")
        rows = t.rows.filter(F.col(t.key).isNotNull()).select(F.lit(t.name).alias("target"), F.col(t.key).cast("bigint").alias("ref"), F.col(t.arrived).alias("arrived"), gone.alias("gone"))
        rows = rows if only is None else rows.join(F.broadcast(only), _KEY, "left_semi")
        parts.append(rows.groupBy(*_KEY).agg(F.min("arrived").alias("arrived"), F.min("gone").alias("gone")))
    return reduce(DataFrame.unionByName, parts)


def orphan_references(references: Sequence[Reference], targets: Sequence[Target], heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """(table_name, record_id, period, reason): one row per referring record whose reference doesn't hold.

    reason is the first that fits of `missing`, `deleted` and `late` (the target arrived after the referring row).
    A null key refers to nothing and isn't reported. A row without time has a null period and is never late. Repeated
    rows count once; if rows share an id but differ, the one with the smallest period and reason stays. A target with a
    repeated key counts as deleted or arrived by its earliest values. Empty tables give an empty result.
    """
    refs = reduce(DataFrame.unionByName, (r.rows.filter(F.col(r.key).isNotNull()).select(F.lit(r.name).alias("table_name"), F.col(r.row_id).alias("record_id"), F.col(r.key).cast("bigint").alias("ref"), F.col(r.at).alias("at"), F.lit(r.target).alias("target")) for r in references))
    refs = refs.withColumn("period", F.date_format("at", "yyyy-MM"))
    groups = cut(refs.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    heavy = groups.groupBy(*_KEY).agg(F.sum("n").alias("n")).filter(F.col("n") > total / heavy_keys).select(*_KEY)
    heavy = cut(heavy)  # fewer than heavy_keys rows

    def bad(checked: DataFrame) -> DataFrame:
        """The groups whose key is missing or deleted, or arrived after the group's first row."""
        return checked.filter(F.col("there").isNull() | F.col("gone").isNotNull() | (F.col("arrived") > F.col("first_at")))

    there = F.lit(True).alias("there")
    of_heavy = groups.join(F.broadcast(heavy), _KEY, "left_semi").join(F.broadcast(_known(targets, heavy).select("*", there)), _KEY, "left")
    rest = groups.join(F.broadcast(heavy), _KEY, "left_anti").join(_known(targets).select("*", there), _KEY, "left")
    found = cut(bad(of_heavy).unionByName(bad(rest)))

    # a row without time has a null period, which equals no other; such rows meet under an empty one
    period = F.coalesce("period", F.lit("")).alias("period")
    rows = split_join(refs.select("table_name", "record_id", "at", *_KEY, period), found.select(*_KEY, period, "n", "there", "gone", "arrived"), _GROUP, "n", heavy_keys)
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("gone").isNotNull(), "deleted").when(F.col("arrived") > F.col("at"), "late")
    rows = rows.select("table_name", "record_id", F.date_format("at", "yyyy-MM").alias("period"), reason.alias("reason")).filter(F.col("reason").isNotNull())
    return rows.groupBy("table_name", "record_id").agg(F.min(F.struct("period", "reason")).alias("x")).select("table_name", "record_id", "x.period", "x.reason")


def orphan_report(found: DataFrame) -> DataFrame:
    """(table_name, period, reason, n_records) of the rows of `orphan_references`, which are one per record."""
    return found.groupBy("table_name", "period", "reason").agg(F.count(F.lit(1)).alias("n_records"))
