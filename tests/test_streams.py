"""Streams of several files, with late rows, against the same rows at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from infospan.operators import correlate
from infospan.plans import modes
from infospan.streaming import binned, resampled


def files(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_closed_windows_leave_late_rows_out(spark, tmp_path):
    hour = lambda h, name="a": (name, int(h * 3600))
    batches = [[hour(1), hour(1.5), hour(3)], [hour(20), hour(21, "b")], [hour(22)], [hour(2), hour(2.5), hour(20.5), hour(60)]]
    schema = "neuron string, t long"
    stream = files(spark, str(tmp_path / "in"), batches, schema).withColumn("ts", F.timestamp_seconds("t"))
    counted = binned.binned_counts(stream, "ts", "neuron", "4 hours", "6 hours", "2 hours")
    binned.append_closed(counted, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = {(r["neuron"], r["s"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).select("neuron", F.unix_timestamp("start").alias("s"), "n").collect()}
    kept = [r for r in sum(batches, []) if r not in (hour(2), hour(2.5))]
    table = spark.createDataFrame(kept, schema).withColumn("ts", F.timestamp_seconds("t"))
    wanted = {(r["neuron"], r["s"]): r["n"] for r in binned.binned_counts(table, "ts", "neuron", "4 hours", "6 hours", "2 hours").select("neuron", F.unix_timestamp("start").alias("s"), "n").collect()}
    assert found == {k: n for k, n in wanted.items() if k[1] + 4 * 3600 <= (60 - 6) * 3600}
    assert found[("a", 0)] == 3 and ("a", 58 * 3600) not in found


def test_resampling_carries_the_last_sample_over_batches(spark, tmp_path):
    batches = [
        [("a", 0.5, 1.0), ("a", 2.0, 4.0), ("b", 1.0, 7.0)],
        [("a", 1.0, 99.0), ("a", 2.0, 99.0), ("a", 5.5, 11.0), ("a", None, 1.0), (None, 1.0, 1.0)],
        [("b", 4.0, 1.0), ("c", 3.0, 5.0), ("a", 5.6, None), ("a", 7.0, 11.0)],
    ]
    schema = "channel string, t double, value double"
    stream = files(spark, str(tmp_path / "in"), batches, schema)
    folder = str(tmp_path / "work")
    resampled.resample_stream(stream, 1.0, folder).awaitTermination()
    found = {(r["channel"], r["k"]): r["value"] for r in spark.read.parquet(f"{folder}/out").collect()}
    known = {"a": ([0.5, 2.0, 5.5, 7.0], [1.0, 4.0, 11.0, 11.0]), "b": ([1.0, 4.0], [7.0, 1.0]), "c": ([3.0], [5.0])}
    wanted = {(c, k): np.interp(k, t, v) for c, (t, v) in known.items() for k in range(int(np.ceil(t[0])), int(t[-1]) + 1)}
    assert found == pytest.approx(wanted)
    files(spark, str(tmp_path / "in"), [[("c", 5.0, 7.0)]], schema)
    resampled.resample_stream(stream, 1.0, folder).awaitTermination()
    again = {(r["channel"], r["k"]): r["value"] for r in spark.read.parquet(f"{folder}/out").collect()}
    assert again == pytest.approx(wanted | {("c", 4): 6.0, ("c", 5): 7.0})


@pytest.mark.parametrize("block", [None, 1, 4, 64])
def test_sums_at_all_lags_equal_direct_ones(spark, block):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=37), rng.normal(size=23)
    a = [(i - 10, float(v)) for i, v in enumerate(x) if i not in (3, 4)] + [(None, 1.0), (5, None)]
    b = [(i + 40, float(v)) for i, v in enumerate(y) if i != 7] + [(50, 2.0)]
    wanted = {}
    for i, v in a:
        for j, w in b:
            if i is not None and v is not None:
                wanted[j - i] = wanted.get(j - i, 0.0) + v * w
    found = {r["lag"]: r["s"] for r in correlate.all_lag_sums(spark.createDataFrame(a, "idx long, x double"), spark.createDataFrame(b, "idx long, y double"), block).collect()}
    assert set(found) == set(range(min(wanted), max(wanted) + 1))
    assert found == pytest.approx({k: wanted.get(k, 0.0) for k in found}, abs=1e-9)


def test_correlations_of_empty_and_constant_series(spark):
    x = spark.createDataFrame([(i, 1.0) for i in range(5)], "idx long, x double")
    y = spark.createDataFrame([(i, float(i)) for i in range(5)], "idx long, y double")
    assert modes.cross_correlations(x, y).count() == 0
    assert modes.cross_correlations(x.where("false"), y).count() == 0
    moved = y.select((F.col("idx") - 1).alias("idx"), F.col("y").alias("x"))
    best = modes.cross_correlations(moved, y).orderBy(F.desc("r")).first()
    assert best["lag"] == 1 and best["r"] == pytest.approx(1.0)
