"""What becomes of a command on a document: the first error that stands in its way, by code."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glyphmill.functions.labels import label_code

# Codes of errors.
DEFAULT = "operation_failed"
CODES = (
    "invalid_command", "document_not_found", "ambiguous_document", "document_text_unavailable", "document_not_ready", "language_unknown", "storage_unavailable", "database_unavailable",
    "translation_model_unavailable", "translation_failed", "voice_unavailable", "synthesis_failed", "recognition_failed", "nlp_resource_unavailable",
)


class Failure(Exception):
    """An error with a code of CODES; others count as DEFAULT."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code if code in CODES else DEFAULT


def outcome(commands: DataFrame, docs: DataFrame, languages: tuple[str, ...] = ("en", "ru")) -> DataFrame:
    """`commands` (parsed, with doc_id) with code: an error's, or ok.

    `docs` has one row per doc_id with status, lang, text and deleted_at. A command is checked first, then whether there is
    the document, whether it is processed, its language, and its text.
    """
    d = docs.select("doc_id", F.col("status").alias("_status"), label_code(F.col("lang")).alias("_lang"), (F.coalesce(F.trim("text"), F.lit("")) != "").alias("_text"), F.col("deleted_at").isNotNull().alias("_gone"), F.lit(True).alias("_there"))
    j = commands.join(d, "doc_id", "left")
    there = F.coalesce("_there", F.lit(False)) & ~F.coalesce("_gone", F.lit(False))
    known = F.coalesce(F.col("_lang").isin(*languages), F.lit(False))
    code = F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(~there, "document_not_found").when(F.coalesce(F.col("_status"), F.lit("")) != "processed", "document_not_ready").when(~known, "language_unknown").when(~F.col("_text"), "document_text_unavailable").otherwise("ok")
    return j.withColumn("code", code).drop("_status", "_lang", "_text", "_gone", "_there")


def attempted(step: Callable[[str], str]) -> Callable[[Column], Column]:
    """A column function struct<value, error_code> of a step that may fail: its Failure's code, or the default one."""

    @F.pandas_udf(StructType([StructField("value", StringType()), StructField("error_code", StringType())]))
    def run(inputs: pd.Series) -> pd.DataFrame:
        def one(x: str | None) -> tuple[str | None, str | None]:
            try:
                return (None, None) if x is None else (step(x), None)
            except Failure as e:
                return None, e.code
            except Exception:  # whatever a step fails with has a code
                return None, DEFAULT

        return pd.DataFrame([one(x) for x in inputs], columns=["value", "error_code"])

    return run
