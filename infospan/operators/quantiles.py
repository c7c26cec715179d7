"""Exact medians by a global sort of counted values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from infospan.sources.store import shuffle_parts, written


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys..., name): the exact median of each key's values; of an even number, the mean of the two in the middle.

    Equal values are counted before they move. The counts are sorted by (keys, value) in ranges, so that a key of most
    rows spreads over tasks; then only the ranges that hold a middle rank are summed up. Nulls don't count: a key
    without values has a null median. NaN comes after all numbers. A null key is a key. Without keys there is one row.
    """
    spark = df.sparkSession
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(value).alias("_n"))
    order = [*map(F.col, keys), F.col("_v")]
    dealt = counts.repartitionByRange(shuffle_parts(spark), *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "medians")
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))  # a row for each range that a key lies in
    along = Window.partitionBy(*keys)
    ends = sums.withColumns({"_before": F.sum("_in").over(along.orderBy("_part")) - F.col("_in"), "_all": F.sum("_in").over(along)})
    middle = ends.where("_all = 0 OR (_before <= _all DIV 2 AND _before + _in > (_all - 1) DIV 2)")
    middle = middle.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"), "_before", "_all")
    same = [dealt[k].eqNullSafe(middle[f"_k{i}"]) for i, k in enumerate(keys)]
    found = dealt.join(middle, reduce(lambda a, b: a & b, same, dealt["_part"] == middle["_at"]))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("_upto", F.col("_before") + upto)
    at = lambda rank: F.max(F.when(F.expr(f"_upto > {rank} AND _upto - _n <= {rank}"), F.col("_v").cast("double")))
    return found.groupBy(*keys).agg(((at("(_all - 1) DIV 2") + at("_all DIV 2")) / 2).alias(name))
