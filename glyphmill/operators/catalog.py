"""Incremental catalogs: differences of two states, removals, labels, caches."""

from __future__ import annotations

import locale

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, key: str, digest: str, version: str) -> DataFrame:
    """(key, status) of `new`, `changed`, `stale` (same content, older version), `unchanged` or `removed`; a full outer join."""
    b = before.select(F.col(key).alias("bk"), F.col(digest).alias("bd"), F.col(version).alias("bv"))
    a = after.select(F.col(key).alias("ak"), F.col(digest).alias("ad"), F.col(version).alias("av"))
    status = F.when(F.col("bk").isNull(), "new").when(F.col("ak").isNull(), "removed").when(~F.col("bd").eqNullSafe(F.col("ad")), "changed").when(F.col("bv") < F.col("av"), "stale").otherwise("unchanged")
    return b.join(a, F.col("bk") == F.col("ak"), "full_outer").select(F.coalesce("ak", "bk").alias(key), status.alias("status"))


def removed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return before.select(key).join(after.select(key), key, "left_anti").distinct()


def disambiguate(rows: DataFrame, label: str, row_id: str) -> DataFrame:
    """(row_id, label): labels that several rows share get the id; counts are joined back, so a hot label isn't gathered."""
    shared = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    out = rows.join(shared, label, "left")
    return out.select(row_id, F.when(F.col("_n").isNotNull(), F.concat(F.col(label), F.lit(" ["), F.col(row_id).cast("string"), F.lit("]"))).otherwise(F.col(label)).alias("label"))


def valid_cache(cache: DataFrame, now: DataFrame) -> DataFrame:
    """Cached results whose document still has the same hash and language."""
    return cache.join(now, ["doc_id", "file_hash", "language"], "left_semi")


def speech_rate(percent: Column) -> Column:
    """Tempo step of a rate in percent: 10 log2(1 + r / 100), rounded half to even, from -10 to 10."""
    return F.greatest(F.lit(-10), F.least(F.lit(10), F.bround(10 * F.log2(F.greatest(1 + percent / 100, F.lit(1e-9)))).cast("int")))


_ENGLISH = {number: name.replace("_", "-") for number, name in locale.windows_locale.items() if number & 0x3FF == 9}


def english_locale(codes: Column) -> Column:
    """Locale of the first English code of a `;` list of hexadecimal ones; null if none is. An English code without name is en-001."""
    numbers = F.transform(F.split(codes, ";"), lambda c: F.conv(F.when(F.trim(c).rlike("^(?:0[xX])?[0-9A-Fa-f]+$"), F.regexp_replace(F.trim(c), "^0[xX]", "")), 16, 10).cast("int"))
    first = F.get(F.filter(numbers, lambda n: n.bitwiseAND(1023) == 9), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in _ENGLISH.items() for x in kv])
    return F.when(first.isNotNull(), F.coalesce(F.element_at(names, first), F.lit("en-001")))
