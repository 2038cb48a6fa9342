"""Events by key: debouncing, silences, windows; in batch and as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.window import Window as W


def debounce(events: DataFrame, key: str, at: str, event_id: str, gap_seconds: float, *carry: str) -> DataFrame:
    """(key, event_id, at, carry...) of the accepted events: those at least `gap_seconds` after the key's last accepted one.

    Keys are hashed to partitions and sorted there; a task reads its rows as a stream with the last accepted time in
    hand, so a hot key needs no memory. Events of the same time are taken by id; one without key or time is left out.
    `carry` names boolean columns that come along.
    """
    gap = int(gap_seconds * 1_000_000)
    rows = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("bigint").alias("event_id"), F.col(at).cast("timestamp_ntz").alias("at"), *[F.col(c).cast("boolean").alias(c) for c in carry])
    rows = rows.repartition("key").sortWithinPartitions("key", "at", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, 0
        for b in batches:
            keep = []
            for k, t in zip(b.column(0).to_pylist(), b.column(2).cast(pa.int64()).to_pylist(), strict=True):
                ok = k != last_key or t - last >= gap
                if ok:
                    last_key, last = k, t
                keep.append(ok)
            yield b.filter(pa.array(keep))

    return rows.mapInArrow(run, "key string, event_id bigint, at timestamp_ntz" + "".join(f", {c} boolean" for c in carry))


class Debouncer:
    """Debouncing of a stream by micro-batches: `write` is for foreachBatch, `accepted` reads what came through.

    A batch's events and the last accepted time of their keys are sorted by key and time and read as a stream, so a task
    needs constant memory whatever a key's share of the events. A batch is written under its number, so that a repeated
    one replaces itself; the state of a key is its latest accepted time of earlier batches.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, at: str, event_id: str, gap_seconds: float):
        self._spark, self._folder, self._columns, self._gap = spark, folder, (key, at, event_id), gap_seconds

    def accepted(self, before: int | None = None) -> DataFrame:
        """(key, event_id, at) of the batches so far, or of those with a smaller number."""
        schema = "key string, event_id bigint, at timestamp_ntz, batch bigint"
        exists = _exists(self._spark, self._folder)
        rows = self._spark.read.schema(schema).parquet(self._folder) if exists else self._spark.createDataFrame([], schema)
        return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")

    def write(self, batch: DataFrame, number: int) -> None:
        key, at, event_id = self._columns
        rows = batch.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp_ntz").alias("at"), F.col(event_id).cast("bigint").alias("event_id"), F.lit(False).alias("old"))
        last = self.accepted(number).groupBy("key").agg(F.max_by(F.struct("at", "event_id"), "at").alias("x")).select("key", "x.at", "x.event_id", F.lit(True).alias("old"))
        out = debounce(rows.unionByName(last), "key", "at", "event_id", self._gap, "old").filter("not old").drop("old")
        out.write.mode("overwrite").parquet(f"{self._folder}/batch={number}")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))


def run_stream(start: Callable[[], StreamingQuery], retries: int = 3, wait_seconds: float = 1.0) -> None:
    """Runs a stream to its end and starts it again after an error, `retries` times, with growing waits; it goes on at its checkpoint."""
    for attempt in range(retries + 1):
        try:
            start().awaitTermination()
            return
        except StreamingQueryException:
            if attempt == retries:
                raise
            time.sleep(wait_seconds * 2**attempt)


def polled(writer: DataStreamWriter, seconds: float | None = 3.0) -> DataStreamWriter:
    """Looks for new files every few seconds, or, with None, once for all there are. What came meanwhile is one batch."""
    return writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")


def coalesced(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key: of many changes of a file in a batch only one is worked on. Combined on the map side."""
    rest = [c for c in events.columns if c != key]
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


class IndexStream:
    """An inverted index that follows file events: `write` is for foreachBatch, `postings` reads the current state.

    Events are (doc_id, kind, no), kind is created, modified or deleted. A batch writes the postings of the documents it
    touched and a row per document under its number; of each document the batch with the highest number counts.
    """

    def __init__(self, spark: SparkSession, folder: str, postings_of: Callable[[DataFrame], DataFrame]):
        """postings_of: the postings of the documents with the given ids (doc_id)."""
        self._spark, self._folder, self._postings_of = spark, folder, postings_of

    def write(self, batch: DataFrame, number: int) -> None:
        last = coalesced(batch.select("doc_id", "kind", "no"), "doc_id", "no")
        last.select("doc_id", (F.col("kind") == "deleted").alias("gone")).write.mode("overwrite").parquet(f"{self._folder}/touched/batch={number}")
        touched = self._spark.read.parquet(f"{self._folder}/touched/batch={number}")
        self._postings_of(touched.filter("not gone").select("doc_id")).write.mode("overwrite").parquet(f"{self._folder}/postings/batch={number}")

    def postings(self) -> DataFrame:
        touched = self._spark.read.parquet(f"{self._folder}/touched")
        now = touched.groupBy("doc_id").agg(F.max("batch").alias("batch"), F.max_by("gone", "batch").alias("gone")).filter("not gone").drop("gone")
        return self._spark.read.parquet(f"{self._folder}/postings").join(now, ["doc_id", "batch"]).drop("batch")


def expand_moves(events: DataFrame) -> DataFrame:
    """A move is a deletion and a creation; everything else stays."""
    two = F.array(F.struct(F.col("path"), F.lit("deleted").alias("kind")), F.struct(F.col("dest_path").alias("path"), F.lit("created").alias("kind")))
    one = F.array(F.struct(F.col("path"), F.col("kind")))
    return events.select("event_no", F.posexplode(F.when(F.col("kind") == "moved", two).otherwise(one)).alias("part", "x")).select("event_no", F.col("part").cast("bigint").alias("part"), "x.path", "x.kind")


def stable(events: DataFrame) -> DataFrame:
    """(event_no, path, stable): whether size and time of change are those of the path's event before."""
    w = W.partitionBy("path").orderBy("seen_at", "event_no")
    same = F.lag("size").over(w).eqNullSafe(F.col("size")) & F.lag("mtime").over(w).eqNullSafe(F.col("mtime")) & F.col("size").isNotNull()
    return events.select("event_no", "path", same.alias("stable"))


def silence_runs(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """(key, n_events, started, ended) of runs whose events are less than `gap_seconds` apart: session windows."""
    s = events.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), F.session_window(F.col(at), f"{gap_seconds} seconds").alias("s")).agg(F.count(F.lit(1)).alias("n_events"), F.max(at).alias("ended"))
    return s.select("key", "n_events", F.col("s.start").alias("started"), "ended")


def window_rms(events: DataFrame, at: str, value: str, width: str = "1 day") -> DataFrame:
    """(started, rms, peak) per time window."""
    g = events.groupBy(F.window(at, width).alias("w")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(F.abs(value)).alias("peak"))
    return g.select(F.col("w.start").alias("started"), F.round("rms", 4).alias("rms"), F.round("peak", 4).alias("peak"))


def last_events(events: DataFrame, key: str, at: str, event_id: str, n: int = 8) -> DataFrame:
    """The last `n` events of each key; tasks cut to n before the shuffle."""
    w = W.partitionBy(key).orderBy(F.desc(at), F.desc(event_id))
    return events.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")
