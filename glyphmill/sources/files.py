"""Text files as tables: folders of documents, training corpora by language, libraries of books."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glyphmill.functions.text import CONTROL, natural_key
from glyphmill.sources.formats import READERS

#: Extensions that are read, and their content types.
CONTENT_TYPES = {"txt": "text/plain", "pdf": "application/pdf", "rtf": "application/rtf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
MOST_BYTES = 1_000_000


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def content_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(table, extension(path)), F.lit("application/octet-stream"))


def decoded(content: Column, strict: bool = True, most: int = MOST_BYTES) -> Column:
    """struct<text, error>: bytes as UTF-8, or UTF-16 with a byte-order mark; a UTF-8 mark is dropped.

    strict: `empty`, `too_large`, `undecodable` and `control_characters` are errors; else bad bytes are left out.
    """
    first = F.hex(F.substring(content, 1, 3))
    utf16 = first.startswith("FFFE") | first.startswith("FEFF")
    body = F.when(first == "EFBBBF", F.substring(content, F.lit(4), F.octet_length(content))).otherwise(content)
    text = F.when(utf16, F.decode(content, "UTF-16")).otherwise(F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")))
    if not strict:
        return F.struct(F.when(utf16, F.decode(content, "UTF-16")).otherwise(F.replace(F.make_valid_utf8(body.cast("string")), F.lit("�"), F.lit(""))).alias("text"), F.lit(None).cast("string").alias("error"))
    error = F.when(content.isNull() | (F.octet_length(content) == 0), "empty").when(F.octet_length(content) > most, "too_large").when(text.isNull(), "undecodable").when(text.rlike(CONTROL), "control_characters")
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
def _extracted(extensions: pd.Series, contents: pd.Series) -> pd.DataFrame:
    """Text or error of files of other formats than plain text."""

    def one(ext: str | None, data: bytes | None) -> tuple[str | None, str | None]:
        if ext not in READERS or data is None:
            return None, "unsupported"
        try:
            text = READERS[ext](bytes(data))
        except Exception:  # a broken file is a row with an error, whatever it breaks
            return None, "unreadable"
        return (text, None) if text.strip() else (None, "empty")

    return pd.DataFrame([one(e, c) for e, c in zip(extensions, contents, strict=True)], columns=["text", "error"])


def read_documents(spark: SparkSession, folder: str, recursive: bool = True, strict: bool = True) -> DataFrame:
    """(path, title, extension, size, modified, file_hash, text, error) of the TXT, DOCX, RTF and PDF files of a folder.

    Files whose name begins with a dot or a tilde are left out, as are files of no bytes (Spark gives no row for them).
    Other kinds have the error `unsupported`, broken files `unreadable`, files without text `empty`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = extension(F.col("path"))
    d = files.filter(~name.rlike(r"^[.~]")).select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), ext.alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_hash"), "content")
    # only files of other formats go to Python
    d = d.withColumn("x", _extracted("extension", F.when(F.col("extension").isin(list(READERS)), F.col("content"))))
    d = d.withColumn("d", F.when(F.col("extension") == "txt", decoded(F.col("content"), strict)).otherwise(F.struct("x.text", "x.error")))
    return d.select("path", "title", "extension", "size", "modified", "file_hash", "d.text", "d.error")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Measured seconds per file and stage, from a CSV with a header."""
    seconds = ", ".join(f"{x}_seconds double" for x in ("extraction", "cleaning", "language_detection", "summarization", "total", "cumulative"))
    return spark.read.csv(path, header=True, schema=f"file_name string, file_path string, language string, token_count bigint, summary_sentence_count bigint, keyword_count bigint, cumulative_token_count bigint, {seconds}")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(lang, word, weight) of a JSON file {language: {word: weight}}."""
    text = spark.read.text(path, wholetext=True)
    maps = text.select(F.explode(F.from_json("value", "map<string, map<string, double>>")).alias("lang", "words"))
    return maps.select("lang", F.explode("words").alias("word", "weight"))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(lang, path, text) of training texts in one folder per language; they stay apart, so no language is one huge row."""
    return read_documents(spark, folder, strict=False).filter("text is not null").select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("lang"), "path", "text")


def read_library(spark: SparkSession, folder: str) -> DataFrame:
    """(book, title, author, place, chapter, path) of a library: a folder is a book, its text files are chapters.

    book.json gives title and author; without it the folder's name is `Author - Title`. Chapters are in natural order,
    their place counts from 1 in a book.
    """
    from pyspark.sql.window import Window as W

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    f = files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("book"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content").filter(~F.col("book").rlike(r"^[.~]") & ~F.col("name").rlike(r"^[.~]"))
    meta = f.filter("name = 'book.json'").select("book", F.from_json(F.decode("content", "UTF-8"), "title string, author string").alias("m")).select("book", F.nullif(F.trim("m.title"), F.lit("")).alias("t"), F.nullif(F.trim("m.author"), F.lit("")).alias("a"))
    both = F.split("book", " - ", 2)
    chapters = f.filter(extension(F.col("name")) == "txt").select("book", "path", F.regexp_replace("name", r"\.[^.]*$", "").alias("chapter"))
    w = W.partitionBy("book").orderBy(natural_key(F.col("chapter")), "chapter")
    d = chapters.join(meta, "book", "left").withColumn("place", F.row_number().over(w))
    return d.select("book", F.coalesce("t", F.get(both, F.lit(1)), "book").alias("title"), F.coalesce("a", F.when(F.size(both) > 1, F.get(both, F.lit(0))), F.lit("unknown")).alias("author"), "place", "chapter", "path")


def safe_path(path: Column) -> Column:
    """Whether a relative path stays in its folder."""
    return ~path.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)") & ~path.rlike(r"^[/\\]|^[A-Za-z]:") & (path != "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a text file, for dictionaries."""
    return spark.read.text(path).withColumnRenamed("value", "line")
