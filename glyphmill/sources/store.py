"""Objects by key in a shared folder, through Hadoop's file system; stored texts with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ObjectStore:
    """Bytes by key below a root (any file system that Hadoop knows)."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._root = spark._jvm, root.rstrip("/")
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, key: str):
        if key.startswith("/") or ".." in key.split("/"):
            raise ValueError("a key must stay below the root")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{key}" if key else self._root)

    def put(self, key: str, data: bytes) -> None:
        out = self._files.create(self._path(key), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def get(self, key: str) -> bytes | None:
        """The bytes; None if there is no such key."""
        path = self._path(key)
        if not self._files.exists(path):
            return None
        source = self._files.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def delete(self, key: str) -> bool:
        """Whether there was such a key."""
        return bool(self._files.delete(self._path(key), False))


def stored_or_extracted(docs: DataFrame, key: str, stored: str, extracted: DataFrame, text: str) -> DataFrame:
    """(key, text): the stored text, else the extracted one; null if there is neither. `extracted` has a row per key."""
    other = extracted.select(F.col(key), F.col(text).alias("_extracted"))
    return docs.select(key, F.col(stored).alias("_stored")).join(other, key, "left").select(key, F.coalesce("_stored", "_extracted").alias("text"))


def vectors_to_json(vector: Column) -> Column:
    return F.to_json(vector)


def vectors_from_json(text: Column) -> Column:
    """array<double>; null for null and broken text."""
    return F.from_json(text, "array<double>")
