"""Ingest as streams: canonical records into two sinks, filters against frozen sets, dedup, run events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import canonicalise
from ..operators.homology import checkpointed


def stream_table(spark: SparkSession, path: str, per_trigger: int = 4) -> DataFrame:
    """A file stream over Parquet files with the schema of those that are there; path is a folder or a pattern."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def two_sinks(records: DataFrame, primary: str, ambiguous: str, checkpoint: str) -> StreamingQuery:
    """Canonical records of (accession, seq, rna_type) appended to one of two Parquet tables by their alphabet.

    A batch that is run again after a failure replaces its own files: each batch has its own directory.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for path, kind in ((primary, "primary"), (ambiguous, "ambiguous")):
            batch.where(F.col("alphabet_status") == kind).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return canonicalise(records).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def new_against(stream: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """Rows of the stream whose key the frozen table does not hold (a stream-static left join).

    The frozen keys are made distinct once and checkpointed; each batch reads only these. A row with a null key is new.
    """
    known = checkpointed(frozen.select(F.col(key).alias("frozen key")).distinct())
    return stream.join(known, F.col(key) == F.col("frozen key"), "left").where("`frozen key` is null").drop("frozen key")


def timed(events: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events with a watermark; the time column is made a timestamp with time zone first."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def dedup_events(events: DataFrame, keys: list[str], column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events without repeats of a key that come within delay of the first; a key's state is kept that long."""
    return timed(events, column, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, column: str = "ts", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total over tumbling windows."""
    out = timed(events, column, delay) if events.isStreaming else events.withColumn(column, F.col(column).cast("timestamp"))
    out = out.groupBy(F.window(column, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def best_so_far(events: DataFrame, keys: list[str]) -> DataFrame:
    """The event with the smallest value of each key, kept up to date (update or complete mode)."""
    return events.groupBy(*keys).agg(F.min_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.min("value").alias("value"))


def run_to_table(stream: DataFrame, folder: str, mode: str = "complete", poll: str | None = None) -> DataFrame:
    """Runs a stream over all that is there into Parquet under a shared folder and returns the result table.

    Each batch has its own directory, which a batch that is run again replaces. In append mode they are the
    table together; in complete mode the last one is; in update mode a batch has the changed keys only, the table
    is all of them with their batch (column version), and latest() has each key's last row. poll: a processing-time interval at which the stream
    looks for input as a daemon would; it is stopped once everything that is there has been taken.
    """
    numbers = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        numbers.append(number)

    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(**trigger).foreachBatch(write).start()
    if poll:
        query.processAllAvailable()
        query.stop()
    else:
        query.awaitTermination()
    spark = stream.sparkSession
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    wanted = [max(numbers)] if mode == "complete" else sorted(set(numbers))
    read = [spark.read.schema(stream.schema).parquet(f"{folder}/rows/batch={n}") for n in wanted]
    if mode == "update":
        read = [rows.withColumn("version", F.lit(n)) for n, rows in zip(wanted, read)]
        return reduce(DataFrame.unionByName, read)
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/rows/batch={n}" for n in wanted])


def latest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the largest version of each key, without the version."""
    others = [c for c in versions.columns if c not in (*keys, "version")]
    last = F.max_by(F.struct(*others), "version").alias("last")
    return versions.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}").alias(c) for c in others])
