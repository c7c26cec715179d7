"""Results of the plans, streams and generators that SQL doesn't cover."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from infospan.errors import DataShapeError
from infospan.functions import bounds, corrupt, spectra
from infospan.operators import align, splits
from infospan.operators import windows as W
from infospan.plans import critics, generators, modes
from infospan.plans.api import run, view_pairs
from infospan.sources import tables


def brute_interpolation(samples, targets):
    t, v = np.array(sorted(samples)).T
    return [0.0 if x < t[0] or x > t[-1] else float(np.interp(x, t, v)) for x in targets]


def test_interpolation_across_gaps_and_buckets(spark):
    samples = [(float(t), math.sin(t)) for t in [*range(0, 40), *range(90, 130, 3), 401]]
    targets = [-5.0, 0.0, 0.5, 39.0, 39.5, 64.2, 90.0, 91.0, 300.25, 401.0, 401.5]
    signal = spark.createDataFrame([(t, 0, v) for t, v in samples], "t double, channel int, value double")
    wanted = spark.createDataFrame([(0, x, k) for k, x in enumerate(targets)], "channel int, t double, k int")
    for bucket in (10.0, 1000.0):
        found = {r["k"]: r["value"] for r in W.interpolated(signal, wanted, bucket).collect()}
        assert [found[k] for k in range(len(targets))] == pytest.approx(brute_interpolation(samples, targets), abs=1e-12)


def test_interpolation_of_a_full_bucket_is_linear(spark):
    signal = spark.range(40_000).select(F.col("id").cast("double").alias("t"), F.lit(0).alias("channel"), F.sin(F.col("id") / 50).alias("value"))
    targets = spark.range(40_000).select(F.lit(0).alias("channel"), (F.col("id") + 0.25).alias("t"))
    start = time.time()
    assert W.interpolated(signal, targets, 1e9).where("value <> 0").count() > 39_000
    assert time.time() - start < 40


def test_paired_streams_keep_covered_windows_only(spark):
    signal = spark.createDataFrame([(float(t), 0, 1.0) for t in [*range(0, 40), *range(70, 100)]], "t double, channel int, value double")
    spikes = spark.createDataFrame([("a", t + 0.5) for t in range(0, 100) if t < 20 or t > 60] + [("a", 99.0)], "neuron string, t double")
    wx, wy = tables.paired(signal, spikes, "continuous", "spike", size=1.0, options_x={"seconds": 0.5}, options_y={"bin_size": 1.0})
    covered = [w for w in range(98) if (w + 0.5 < 40 or w + 0.5 >= 69.5) and (w < 20 or w > 60)]
    kept = {r["w"] for r in wx.select("w").distinct().collect()}
    assert kept == {r["w"] for r in wy.select("w").distinct().collect()} == set(range(len(kept)))
    assert abs(len(kept) - len(covered)) <= 2 and wy.agg(F.min("value")).first()[0] >= 1
    states = spark.createDataFrame([(float(t), 0, t % 3) for t in range(0, 100, 2)], "t double, channel int, category int")
    both = tables.paired(signal, states, "continuous", "categorical", size=4.0, options_x={"sample_rate": 1.0}, options_y={"slots": 2, "min_coverage": 1.0})
    assert both[0].select("w").distinct().count() == both[1].select("w").distinct().count() > 10


def test_period_of_a_known_rate(spark):
    signal = spark.createDataFrame([(0.0, 0, 1.0), (1.0, 0, 1.0), (2.0, 0, 1.0)], "t double, channel int, value double")
    assert W.period(signal, sample_rate=1.0).first()["period"] == 1.0
    with pytest.warns(UserWarning):
        assert W.period(signal, sample_rate=2.0).first()["period"] == 0.5


def test_scored_rows_give_the_bounds_of_their_matrix(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 60, 4))
    samples = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(60)], "id long, x array<double>, y array<double>")
    s = x @ y.T
    scores = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(60) for j in range(60)], "i long, j long, s double")
    for name, bound in bounds.BOUNDS.items():
        clip = 1.0 if name == "smile" else None
        options = {"clip": clip} if clip else {}
        found = bound(bounds.scored_rows(samples, 100, clip=clip), ["batch"], **options).first()["mi"]
        assert found == pytest.approx(bound(scores, **options).first()["mi"], abs=1e-9)
    assert [r["n"] for r in bounds.infonce(bounds.scored_rows(samples, 25), ["batch"]).orderBy("batch").collect()] == [25, 25, 10]


def test_permutations_differ_and_are_permutations(spark):
    found = splits.permutations(spark.range(50), "id", 30, seed=1, parts=4).collect()
    orders = {}
    for r in found:
        orders.setdefault(r["trial"], {})[r["id"]] = r["rank"]
    assert all(sorted(o.values()) == list(range(50)) for o in orders.values())
    assert len({tuple(o[k] for k in range(50)) for o in orders.values()}) == 30
    shifts = {tuple((o[k] - orders[0][k]) % 50 for k in range(50)) for o in orders.values()}
    assert all(len(set(s)) > 10 for s in shifts if any(s))  # no order is another one shifted


def test_critic_is_done_or_refused(spark):
    pairs = generators.correlated_gaussians(spark, 600, 1, 1.5, seed=5)
    with pytest.raises(ValueError):
        run(pairs, "transfer", critic="mlp")
    quick = {"critic": "mlp", "n_epochs": 4, "learning_rate": 5e-3, "hidden_dim": 16, "embedding_dim": 4}
    swept = run(pairs, "sweep", grid={"scale": [0.0, 1.0]}, prepare=lambda t: t.withColumn("x", F.transform("x", lambda v: v * F.col("scale"))), **quick).table
    mi = {r["scale"]: r["mi_mean"] for r in swept.collect()}
    assert mi[1.0] > mi[0.0] + 0.2


def test_a_critic_trains_on_all_shards(spark):
    pairs = generators.correlated_gaussians(spark, 3000, 1, 1.5, seed=6)
    t = critics.Training(n_epochs=6, learning_rate=5e-3, hidden_dim=16, embedding_dim=4, shard_rows=700, max_eval_samples=150)
    r = critics.learned(pairs, t).first()
    assert r["error"] is None and 0.6 < r["test_mi"] < 2.2 and len(r["test_mi_history"]) == 6 and r["eval_size"] < 250
    again = critics.learned(pairs.repartition(7), t).first()
    assert again["test_mi"] == pytest.approx(r["test_mi"], abs=1e-6)
    tiny = critics.learned(pairs.limit(3), t).first()
    assert tiny["error"] and tiny["train_mi"] is None


def test_corruption_by_kind(spark):
    cells = spark.createDataFrame([(0, 0.0), (1, 1.24), (2, -1.0), (3, 2.6)], "k int, value double")
    of = lambda df: [r["value"] for r in df.orderBy("k").collect()]
    assert of(corrupt.apply_precision(cells, "static", 0.5)) == [0.0, 1.0, -1.0, 2.5]
    assert of(corrupt.apply_precision(cells, "spike", 1.0)) == [0.0, 1.0, -1.0, 3.0]
    assert of(corrupt.apply_precision(cells, "binned", 0.0)) == [0.0, 1.24, -1.0, 2.6]
    noisy = of(corrupt.apply_noise(cells, "continuous", 1.0, 3, ["k"]))
    assert noisy[0] == 0.0 and noisy[1] != 1.24 and noisy == of(corrupt.apply_noise(cells.repartition(3), "continuous", 1.0, 3, ["k"]))
    jitter = of(corrupt.apply_noise(cells, "spike", 0.2, 3, ["k"]))
    assert jitter[2] == -1.0 and 0 < abs(jitter[3] - 2.6) <= 0.1
    assert of(corrupt.apply_noise(cells, "binned", 9.0, 3, ["k"]))[0] == 0.0 and min(of(corrupt.apply_noise(cells, "binned", 9.0, 3, ["k"]))[k] for k in (0, 1, 3)) >= 0
    with pytest.raises(DataShapeError):
        corrupt.apply_noise(cells, "categorical", 1.0, 3, ["k"])
    many = corrupt.apply_noise(spark.range(20_000).select("id", F.lit(1.0).alias("value")), "static", 2.0, 1, ["id"]).agg(F.avg("value"), F.stddev("value")).first()
    assert many[0] == pytest.approx(1.0, abs=0.06) and many[1] == pytest.approx(2.0, abs=0.05)


def test_noise_lowers_information(spark):
    pairs = generators.correlated_gaussians(spark, 2000, 1, 2.0, seed=8).select("id", F.get("x", F.lit(0)).alias("x"), F.get("y", F.lit(0)).alias("y"))
    r = run(pairs, "precision", corruption_method="noise", tau_grid=(1.0, 8.0), n_noise_samples=4, corrupt_target="both")
    rows = {x["tau"]: x for x in r.table.collect()}
    assert rows[0.0]["n_runs"] == 1 and rows[0.0]["mi_std"] == 0 and rows[1.0]["n_runs"] == 4 and rows[1.0]["mi_std"] > 0
    assert rows[0.0]["mi"] > rows[1.0]["mi"] > rows[8.0]["mi"]


def test_rigorous_scalars_and_arrays(spark):
    s = generators.correlated_gaussians(spark, 1500, 2, 2.0, seed=9).withColumn("z", F.array(F.randn(1)))
    flat = s.select("id", F.get("x", F.lit(0)).alias("x"), F.get("y", F.lit(0)).alias("y"), F.get("z", F.lit(0)).alias("z"))
    assert run(flat, "conditional", rigorous=True).table.first()["mi_corrected"] == pytest.approx(1.0, abs=0.2)
    assert run(s, "conditional").table.first()["cmi"] == pytest.approx(2.0, abs=0.3)
    te = run(flat.withColumnRenamed("id", "idx"), "transfer", rigorous=True).table.collect()
    assert {r["way"] for r in te} == {"xy", "yx"} and all(abs(r["mi_corrected"]) < 0.1 for r in te)
    runs = spark.createDataFrame([(g, c, 2 + 0.5 * g + g**3) for g in range(1, 6) for c in range(g)], "gamma int, chunk int, train_mi double")
    bent = modes.rigorous_scalar(runs, least=9).first()
    assert bent["all_gammas"] and bent["gamma_max"] == 5


def test_pairwise_forms_agree(spark, monkeypatch):
    table = spark.range(300).select("id", F.randn(1).alias("a"), F.randn(2).alias("b")).withColumn("c", F.col("a") + F.col("b"))
    one = {(r["a"], r["b"]): r["mi"] for r in modes.pairwise(table, ["a", "b", "c"]).collect()}
    monkeypatch.setattr(modes, "PAIRS_IN_PLAN", 1)
    rows = {(r["a"], r["b"]): r["mi"] for r in modes.pairwise(table, ["a", "b", "c"]).collect()}
    assert one.keys() == rows.keys() and all(one[k] == pytest.approx(rows[k]) for k in one)
    constant = table.withColumn("a", F.lit(1.0))
    assert modes.estimate(constant.select(F.col("a").alias("x"), F.col("b").alias("y"))).first()["mi"] == 0


def test_views_and_whitening(spark):
    images = spark.range(400).select("id", F.array(*[F.randn(k) for k in range(12)]).alias("x"))
    for method in splits.PIXEL_SIDES:
        a, b = splits.positions(method, 12, shape=(3, 4))
        sides = {r["h"] * 4 + r["w"]: r["side"] for r in splits.pixel_sides(spark.range(12).select(F.expr("id DIV 4").alias("h"), F.expr("id % 4").alias("w")), method, 3, 4).collect()}
        assert a == [k for k in range(12) if not sides[k]] and b == [k for k in range(12) if sides[k]]
    r = run(images, "dimensionality", split_method="horizontal", shape=(3, 4), whitening="zca", levels=(0.1, 1.0))
    assert r.table.count() == 2 and {x["sigma_add"] for x in r.details["summary"].collect()} == {0.1, 1.0}
    for bad in ({"split_method": "temporal"}, {"split_method": "index", "indices": (1, 1)}, {"split_method": "vertical"}):
        with pytest.raises(ValueError):
            run(images, "dimensionality", **bad)
    later = view_pairs(images, 1, "temporal", 0, lag=2)
    assert later.count() == 398
    pairs = images.select(F.slice("x", 1, 6).alias("x"), F.slice("x", 7, 6).alias("y")).toPandas()
    x, y = (np.stack(pairs[c].to_list()) for c in "xy")
    root = lambda m: np.linalg.inv(np.linalg.cholesky(m)).T
    c = np.cov(x.T, y.T)
    found = spectra.cross_covariance(images.select(F.slice("x", 1, 6).alias("x"), F.slice("x", 7, 6).alias("y")), "zca").toPandas().pivot(index="i", columns="j", values="c").to_numpy()
    wanted = root(c[:6, :6]).T @ c[:6, 6:] @ root(c[6:, 6:])
    assert np.linalg.svd(found)[1] == pytest.approx(np.linalg.svd(wanted)[1], abs=1e-9)  # whitenings differ by rotations


def test_epoch_shifts(spark):
    assert align.epoch_shift(10.0, 0, 1) == 0 and 0 <= align.epoch_shift(10.0, 3, 1) <= 6 and align.epoch_shift(10.0, 50, 1) <= 10
    moved = align.randomly_shifted(spark.createDataFrame([(5.0,)], "t double"), 10.0, 9, 2).first()["t"]
    assert moved == 5.0 - align.epoch_shift(10.0, 9, 2)


def correlation(df, x="x", y="y"):
    return df.agg(F.corr(x, y)).first()[0]


def test_generators_have_their_statistics(spark):
    g = generators
    flat = lambda df: df.select(F.get("x", F.lit(0)).alias("x"), F.get("y", F.lit(0)).alias("y"))
    latent = g.nonlinear_from_latent(spark, 4000, 2, 5, 2.0, seed=1)
    assert latent.select(F.size("x")).first()[0] == 5 and modes.estimate_arrays(latent.select(F.col("latent_x").alias("x"), F.col("latent_y").alias("y"))).first()["mi"] == pytest.approx(2.0, abs=0.25)
    lagged = lambda df, lag: correlation(align.lagged(df.select("idx", "x"), df.select("idx", "y"), lag))
    walk = g.convolved(spark, 5000, lag=30, seed=2)
    assert lagged(walk, -30) > lagged(walk, 0) and lagged(walk, -30) > 0.98
    bits = g.xor(spark, 3000, noise=0.05, seed=3)
    assert abs(correlation(flat(bits))) < 0.08 and bits.where(F.abs(F.get("y", F.lit(0)) - F.abs(F.get("x", F.lit(0)) - F.get("x", F.lit(1)))) > 0.4).count() == 0
    x, y = g.correlated_spikes(spark, 3, 200.0, rate=5.0, delay=0.02, jitter=0.001, seed=4)
    assert x.count() / 600 == pytest.approx(5.0, abs=0.5) and abs(x.count() - y.count()) < 10
    near = x.alias("a").join(y.alias("b"), (F.col("a.neuron") == F.col("b.neuron")) & (F.abs(F.col("b.t") - F.col("a.t") - 0.02) < 0.006))
    assert near.count() >= 0.98 * x.count()
    chain = g.categorical_series(spark, 4000, categories=3, transition=0.8, seed=5)
    assert chain.agg(F.avg((F.col("x") == F.col("y")).cast("int"))).first()[0] == pytest.approx(0.8 + 0.2 / 3, abs=0.04)
    events = g.event_related(spark, 4000, lag=20, seed=6)
    assert lagged(events, 35) > lagged(events, -35) + 0.1
    line = g.linear(spark, 4000, lag=10, noise=0.05, seed=7)
    assert lagged(line, 10) > 0.9 and abs(lagged(line, 0)) < 0.15
    square = g.nonlinear(spark, 4000, lag=10, noise=0.02, seed=8)
    assert abs(lagged(square, 10)) < 0.3 and lagged(square.withColumn("x", F.col("x") * F.col("x")), 10) > 0.9
    assert lagged(g.history(spark, 4000, duration=5, noise=0.05, seed=9), 0) > 0.3 and lagged(g.full(spark, 4000, lag=10, duration=5, noise=0.05, seed=10), 10) > 0.3
    slow = g.windowed_dependency(spark, 6000, channels=2, timescale=10.0, window=20, seed=11)
    own = slow.where("channel = 0")
    assert slow.select("channel").distinct().count() == 2 and own.agg(F.stddev("x")).first()[0] == pytest.approx(math.sqrt(2), abs=0.35) and correlation(own) > 0.3
    a, b = g.modulated_spikes(spark, 5, 300.0, rate=10.0, depth=0.9, frequency=1.0, seed=12)
    phase = lambda s: s.groupBy((F.floor(F.pmod("t", F.lit(1.0)) * 2)).alias("h")).count().orderBy("h").collect()
    assert all(p[0]["count"] > 2 * p[1]["count"] for p in (phase(a), phase(b)))
    c, d = g.timing_code(spark, 2, 200.0, seed=13)
    assert c.count() / 400 == pytest.approx(10.0, abs=1.0) and d.count() / 400 == pytest.approx(10.0, abs=1.0)


def test_oscillations_carry_their_information(spark):
    for options in ({"latent_mi": 1.0, "snr": 3.0}, {"latent_mi": 2.0, "snr": 0.3}):
        made = generators.oscillatory(spark, 3000, size=64, seed=14, **options)
        carrier = [math.sin(2 * math.pi * 20.0 * k / 256.0) for k in range(64)]
        seen = made.select(*[F.aggregate(F.zip_with(c, F.array(*map(F.lit, carrier)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias(c) for c in "xy"])
        assert modes.estimate(seen).first()["mi"] == pytest.approx(generators.oscillatory_mi(size=64, **options), abs=0.12)
    assert generators.oscillatory_mi(channels=3) == pytest.approx(3 * generators.oscillatory_mi())
    other = generators.bandpower_interference(spark, 200, seed=1)
    many = generators.multichannel(spark, 200, channels=3, seed=1)
    assert other.count() == 200 and many.select("channel").distinct().count() == 3
