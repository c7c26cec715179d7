"""Counts of spikes in tumbling or sliding windows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def binned_counts(events: DataFrame, ts: str, neuron: str, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(neuron, start, n) of a stream or table, in tumbling windows or, with `slide`, sliding ones.

    On a stream in append mode a window is given out once, in the batch after the one whose newest time is `late` past its
    end; then its state is dropped, and rows that come for it later are left out. In complete mode no window is ever closed, so all rows count.
    """
    rows = events.select(F.col(ts).cast("timestamp").alias("ts"), F.col(neuron).alias("neuron"))
    counted = rows.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "neuron").agg(F.count("*").alias("n"))
    return counted.select("neuron", F.col("w.start").alias("start"), "n")


def append_closed(counted: DataFrame, out: str, state: str) -> StreamingQuery:
    """Runs a stream of binned_counts() to its present end; closed windows are appended to the Parquet table `out`, each once."""
    return counted.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()


def run_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the events table into windows of six hours, one every two: (neuron, hour, n) of those that are a day past."""
    from infospan.sources.store import scratch

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")
    counted = binned_counts(stream, "ts", "event_type", "6 hours", "1 day", "2 hours")
    out = scratch(spark, "closed-out")
    append_closed(counted, out, scratch(spark, "closed-state")).awaitTermination()
    rows = spark.read.schema(counted.schema).parquet(out)
    return rows.select("neuron", F.floor(F.unix_timestamp("start") / 3600).alias("hour"), "n")


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the events table once, to the end, into a table: (neuron, hour, n)."""
    from infospan.sources.store import scratch

    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as streams read folders
    out, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    counted = binned_counts(stream, "ts", "event_type")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = counted.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("neuron", F.floor(F.unix_timestamp("start") / 3600).alias("hour"), "n")
