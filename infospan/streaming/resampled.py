"""Resampling of a stream, with each channel's last sample carried from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from infospan.operators import windows as W

#: Grid points of a channel that one row stands for until they are dealt to tasks.
BLOCK = 65_536


def grid_points(spans: DataFrame, seconds: float) -> DataFrame:
    """(channel, k, t): k * seconds within each row's (channel, low, high, open); the low end itself is left out if `open`."""
    first = F.ceil(F.col("low") / seconds)
    first = F.when(F.col("open") & (first * seconds == F.col("low")), first + 1).otherwise(first)
    ends = spans.select("channel", first.cast("long").alias("first"), F.floor(F.col("high") / seconds).cast("long").alias("last")).where("first <= last")
    blocks = ends.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(last - first) DIV {BLOCK}")))).repartition("channel", "block")
    low = F.col("first") + F.col("block") * BLOCK
    points = blocks.select("channel", F.explode(F.sequence(low, F.least(low + (BLOCK - 1), F.col("last")))).alias("k"))
    return points.withColumn("t", F.col("k") * F.lit(float(seconds)))


def resampled(samples: DataFrame, carried: DataFrame, seconds: float, bucket: float = 86_400.0) -> tuple[DataFrame, DataFrame]:
    """((channel, k, t, value), (channel, t, value)): a batch's grid points and the samples to carry on.

    Samples at or before their channel's carried one come too late and are left out; rows without a channel or time are, too.
    Between the carried sample and the batch's newest, each multiple of `seconds` gets the line between its neighbours.
    """
    old = carried.select("channel", F.col("t").alias("_old"))  # a row for each channel
    fresh = samples.where("channel IS NOT NULL AND t IS NOT NULL AND value IS NOT NULL").join(old, "channel", "left").where("_old IS NULL OR t > _old")
    fresh = fresh.select("channel", F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"))
    all_samples = fresh.unionByName(carried.select("channel", "t", "value"))
    spans = all_samples.groupBy("channel").agg(F.min("t").alias("low"), F.max("t").alias("high")).join(old, "channel", "left")
    points = grid_points(spans.select("channel", "low", "high", F.col("_old").isNotNull().alias("open")), seconds)
    last = all_samples.groupBy("channel").agg(F.max(F.struct("t", "value")).alias("s")).select("channel", "s.t", "s.value")
    return W.interpolated(all_samples, points, bucket).select("channel", "k", "t", "value"), last


def resample_stream(stream: DataFrame, seconds: float, folder: str, bucket: float = 86_400.0) -> StreamingQuery:
    """Runs a stream (channel, t, value) to its present end: grid points go to folder/out/batch=n, carried samples to folder/carried/n.

    A batch reads the samples that the one before carried and overwrites its own places, so one that is run again after
    a failure gives the same rows; a stream started again on the folder goes on where it stopped. Channels that a batch
    doesn't name are carried on.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema["channel"].dataType.simpleString()
        shape = f"channel {kind}, t double, value double"
        before = spark.read.schema(shape).parquet(f"{folder}/carried/{number - 1}") if number else spark.createDataFrame([], shape)
        points, last = resampled(batch, before, seconds, bucket)
        last.write.mode("overwrite").parquet(f"{folder}/carried/{number}")
        points.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def run_once(spark: SparkSession, sf_dir: str, seconds: float = 1800.0) -> DataFrame:
    """Streams the events table to its end: (channel, k, value) of each event type on a grid of half hours."""
    from infospan.sources.store import scratch

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")
    signal = stream.select(F.col("event_type").alias("channel"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    folder = scratch(spark, "resampled")
    resample_stream(signal.select("channel", (F.col("us") / 1e6).alias("t"), "value"), seconds, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("channel", "k", "value")
