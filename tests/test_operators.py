"""Hand-checked cases."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from infospan import queries
from infospan.functions import bounds, regression, scalar, spectra
from infospan.operators import align, splits
from infospan.operators import windows as W
from infospan.operators.quantiles import medians
from infospan.plans import critics, generators, modes
from infospan.sources import tables


def test_grid(spark):
    assert [r["t_start"] for r in W.Grid(1, 0, 10).windows(spark).orderBy("w").collect()] == list(map(float, range(10)))
    assert W.Grid(2, 0, 10, 0.5).every == 1.0
    assert W.Grid(2, 0, 10, 3).every == 3.0
    assert W.Grid(2, 0, 10, step_seconds=0.25).count == 40


def test_half_open_and_overlap(spark):
    points = spark.createDataFrame([(1.0,), (1.5,)], "t double")
    tumbling = W.Grid(1, 0, 10).assign(points).orderBy("t").collect()
    assert [r["w"] for r in tumbling] == [1, 1]
    wide = W.Grid(2, 0, 10, 1.0).assign(points.where("t = 1.5")).orderBy("w").collect()
    assert [r["w"] for r in wide] == [0, 1]
    gaps = W.Grid(1, 0, 10, 2.0).assign(points)
    assert gaps.count() == 0


def test_most_events_equal_two_pointers(spark):
    rng = np.random.default_rng(0)
    times = np.sort(rng.integers(0, 300, 400) / 4)
    s = spark.createDataFrame([("a", float(t)) for t in times] + [("b", 1.0)], "neuron string, t double")
    brute = max(int(((times >= t - 2.5) & (times <= t)).sum()) for t in times)
    found = {r["neuron"]: r["most"] for r in W.max_events(s, 2.5, bucket=3.0).collect()}
    assert found == {"a": brute, "b": 1}


@pytest.mark.parametrize("bucket", [None, 1.0, 100.0])
def test_most_events_equal_sql_with_nulls_ties_and_rounding(spark, bucket):
    rng = np.random.default_rng(3)
    rows = [("a", float(t)) for t in np.cumsum(rng.integers(0, 3, 300)) * 0.1] + [("b", 5.0)] * 7 + [("c", None)] * 3 + [("c", 1.0)] + [("n", float("nan"))] * 2 + [(None, -0.3), (None, 0.0)]
    c = duckdb.connect()
    c.sql("CREATE TABLE s (neuron VARCHAR, t DOUBLE)")
    c.executemany("INSERT INTO s VALUES (?, ?)", [list(r) for r in rows])
    wanted = c.sql("SELECT neuron, max(n) FROM (SELECT neuron, count(*) OVER (PARTITION BY neuron ORDER BY t RANGE BETWEEN 0.3 PRECEDING AND CURRENT ROW) AS n FROM s) GROUP BY 1").fetchall()
    found = W.max_events(spark.createDataFrame(rows, "neuron string, t double"), 0.3, bucket).collect()
    assert {r["neuron"]: r["most"] for r in found} == dict(wanted)


def test_most_events_in_one_span_cost_no_square(spark):
    """100,000 spikes in one span: counted over again for each, 5,000,000,000 steps."""
    s = spark.range(100_000).select(F.lit("a").alias("neuron"), (F.col("id") / 1e5).alias("t"))
    frames = W.max_events(s, 2.0)
    assert frames.collect() == [("a", 100_000)]
    assert "RangeFrame, -" not in frames._jdf.queryExecution().executedPlan().toString()


def test_packed_spikes_equal_sql_where_values_are_small(spark, tmp_path):
    """Values below 1e-3 and 1e-4, which Spark writes with an exponent and SQL without, or with another one."""
    at = [0.0, 0.000946, 0.000012, 3600.000001, 3600.00001, 3600.0001, 3600.00095, 3600.001, 3600.002, 9000.5]
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + to_microseconds({round(t * 1e6)}), 'a', 1.0)" for i, t in enumerate(at))
    c = duckdb.connect()
    c.sql(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) v(event_id, ts, event_type, value)")
    c.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    found = queries.packed_spikes(spark, str(tmp_path)).toPandas()
    wanted = c.sql(queries.ORACLES["packed_spikes"]).df()
    assert sorted(found.itertuples(index=False, name=None)) == sorted(wanted[list(found.columns)].itertuples(index=False, name=None))
    assert "[1e-06, 1e-05, 0.0001, 0.00095]" in set(found["x"])


def test_text_of_doubles_equals_python(spark):
    values = [0.0, -0.0, 1e-3, -9.5e-4, 1e-4, 9.5e-5, 1e7, -12345678.25, 1e15, 1e16, 1.5e100, 1e-100, float("nan"), float("inf"), float("-inf")]
    found = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", scalar.plain_text(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in found] == list(map(repr, values))


def test_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 100, 60))
    v = rng.normal(size=60)
    wanted = rng.uniform(-5, 105, 200)
    signal = spark.createDataFrame([(float(a), 0, float(b)) for a, b in zip(t, v, strict=True)], "t double, channel int, value double")
    targets = spark.createDataFrame([(0, float(x), i) for i, x in enumerate(wanted)], "channel int, t double, k int")
    found = {r["k"]: r["value"] for r in W.interpolated(signal, targets, bucket=7.0).collect()}
    brute = np.interp(wanted, t, v, left=0, right=0)
    assert np.allclose([found[i] for i in range(200)], brute)


def test_majority_tie_takes_smallest(spark):
    s = spark.createDataFrame([(0.1, 0, 1), (0.2, 0, 0)], "t double, channel int, category int")
    assert W.majority(s, W.Grid(1, 0, 1)).first()["category"] == 0


def test_bounds_of_known_matrices(spark):
    n = 8
    rows = lambda f: spark.createDataFrame([(i, j, f(i, j)) for i in range(n) for j in range(n)], "i int, j int, s double")
    assert bounds.infonce(rows(lambda i, j: 500.0 * (i == j))).first()["mi"] == pytest.approx(math.log(n))
    assert bounds.infonce(rows(lambda i, j: 3.0)).first()["mi"] == pytest.approx(0)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(n, n))
    table, off = rows(lambda i, j: float(m[i, j])), m[~np.eye(n, dtype=bool)]
    assert bounds.tuba(table).first()["mi"] == pytest.approx(1 + m.diagonal().mean() - np.exp(off).mean())
    assert bounds.nwj(table).first()["mi"] == pytest.approx(m.diagonal().mean() - np.exp(off - 1).mean())
    clipped = np.clip(m, -0.1, 0.1)
    assert bounds.smile(table, clip=0.1).first()["mi"] == pytest.approx(clipped.diagonal().mean() - np.log(np.exp(clipped[~np.eye(n, dtype=bool)]).mean()))
    assert bounds.smile(table, clip=0.1).first()["mi"] != pytest.approx(bounds.smile(table, clip=None).first()["mi"])


def test_line_through_exact_points(spark):
    runs = spark.createDataFrame([(g, 2 + 0.5 * g) for g in range(1, 6) for _ in range(g)], "gamma int, train_mi double")
    r = regression.extrapolated(runs).first()
    assert r["mi_corrected"] == pytest.approx(2) and r["slope"] == pytest.approx(0.5) and r["mi_error"] == pytest.approx(0, abs=1e-6)
    assert r["reliable"] and not r["leverage_flag"] and r["n_gammas"] == 5


def test_leverage_of_first_gamma(spark):
    runs = spark.createDataFrame([(1, 10.0)] + [(g, 2 + 0.5 * g) for g in range(2, 6)], "gamma int, train_mi double")
    r = regression.extrapolated(runs).first()
    assert r["leverage_flag"] and not r["reliable"]


def test_student_t():
    assert regression.student_t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert regression.student_t_quantile(0.95, 1) == pytest.approx(6.313752, abs=1e-4)


def test_smoothing_equals_brute_force(spark):
    v = [float(x) for x in np.random.default_rng(3).normal(size=30)]
    found = [r["smooth"] for r in regression.smoothed(spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, i int, v double"), ["k"], "i", "v").orderBy("i").collect()]
    reflect = lambda a, i: a[i % (2 * len(a)) if i % (2 * len(a)) < len(a) else 2 * len(a) - 1 - i % (2 * len(a))]
    med = [sorted(reflect(v, i + k) for k in range(-2, 3))[2] for i in range(30)]
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    w /= w.sum()
    assert np.allclose(found, [sum(w[k + 4] * reflect(med, i + k) for k in range(-4, 5)) for i in range(30)])


@pytest.mark.parametrize("sigma,pr", [([10.0, 0.0, 0.0, 0.0], 1), ([2.0] * 4, 4)])
def test_participation(spark, sigma, pr):
    s = spectra.spectrum_summary(spark.createDataFrame([(k, v) for k, v in enumerate(sigma)], "k int, sigma double")).first()
    assert s["pr_eig"] == pytest.approx(pr) and s["pr_singular"] == pytest.approx(pr) and s["effective_rank"] == pytest.approx(pr)


def test_pr_without_svd_equals_svd(spark):
    rng = np.random.default_rng(4)
    samples = spark.createDataFrame([(i, [float(a) for a in rng.normal(size=4)], [float(a) for a in rng.normal(size=3)]) for i in range(50)], "id long, x array<double>, y array<double>")
    cov = spectra.cross_covariance(samples)
    assert spectra.pr_eig(cov).first()[0] == pytest.approx(spectra.spectrum_summary(spectra.singular_values(cov)).first()["pr_eig"])


def test_gamma_chunks_are_array_split(spark):
    ids = spark.range(55)
    sizes = splits.gamma_chunks(ids, gammas=10).where("gamma = 10").groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in sizes] == [6] * 5 + [5] * 5


def test_histories(spark):
    s = spark.createDataFrame([(i, float(i)) for i in range(300)], "idx long, v double")
    found = align.histories(s, 10, 1)
    assert found.count() == 290
    r = found.where("idx = 7").first()
    assert r["past"] == [float(x) for x in range(7, 17)] and r["future"] == [17.0]


def test_rounding_halves_to_even(spark):
    v = spark.createDataFrame([(x,) for x in (0.2, 0.8, 1.2, 1.8, 2.1, 2.5)], "x double").select(scalar.rounded(F.col("x"), 1.0).alias("y"), scalar.rounded(F.col("x"), 0.0).alias("z")).collect()
    assert [r["y"] for r in v] == [0, 1, 1, 2, 2, 2] and [r["z"] for r in v] == [0.2, 0.8, 1.2, 1.8, 2.1, 2.5]


def test_split_roles_do_not_overlap(spark):
    roles = splits.blocked_split(spark.range(1000), seed=2).groupBy("role").count().collect()
    count = {r["role"]: r["count"] for r in roles}
    assert count["test"] == 100 and 800 <= count["train"] <= 840 and sum(count.values()) == 1000


def test_permutation_keeps_values(spark):
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    found = splits.permuted(df, "v", seed=5).collect()
    assert sorted(r["v"] for r in found) == [2 * i for i in range(50)] and [r["v"] for r in found] != [2 * r["id"] for r in found]


def test_gaussian_estimates_truth(spark):
    s = generators.correlated_gaussians(spark, 4000, 3, 2.0, seed=7)
    assert modes.estimate_arrays(s).first()["mi"] == pytest.approx(2.0, abs=0.2)


def test_learned_critic_finds_information(spark):
    s = generators.correlated_gaussians(spark, 3000, 2, 2.0, seed=8)
    r = critics.learned(s, critics.Training(n_epochs=15, learning_rate=3e-3)).first()
    assert r["error"] is None and abs(r["train_mi"] - 2.0) < 0.7


def test_embeddings_of_a_model(spark):
    s = generators.correlated_gaussians(spark, 400, 2, 2.0, seed=8)
    t = critics.Training(n_epochs=2, embedding_dim=3)
    found = critics.embed(s, critics.learned(s, t), t)
    r = found.first()
    assert found.count() == 400 and len(r["x_embedding"]) == len(r["y_embedding"]) == 3 and r["x_embedding"] != r["y_embedding"]


@pytest.mark.parametrize("estimator", ["infonce", "smile"])
def test_gradients(estimator):
    rng = np.random.default_rng(9)
    s = rng.normal(size=(6, 6))
    _, grad = critics.bound_and_gradient(s, estimator, 5.0)
    off = ~np.eye(6, dtype=bool)
    target = (lambda m: critics.bound_and_gradient(m, "infonce", 5.0)[0]) if estimator == "infonce" else (lambda m: -np.log1p(np.exp(-m.diagonal())).mean() - np.log1p(np.exp(m[off])).mean())
    for i, j in [(0, 0), (1, 3), (5, 2)]:
        d = np.zeros_like(s)
        d[i, j] = 1e-6
        assert grad[i, j] == pytest.approx((target(s + d) - target(s - d)) / 2e-6, abs=1e-6)


def test_failed_training_gives_a_row(spark):
    s = spark.createDataFrame([(0, [1.0], [1.0])], "id long, x array<double>, y array<double>")
    assert "few rows" in critics.learned(s, critics.Training()).first()["error"]


def test_finite_and_sign_checks(spark):
    bad = spark.createDataFrame([(float("nan"), -1.0)], "v double, t double")
    with pytest.raises(Exception, match="NaN"):
        align.require_finite(bad, "v").collect()
    with pytest.raises(Exception, match="negative"):
        align.require_not_negative(bad).collect()


def test_paired_streams(spark):
    x = spark.createDataFrame([(i / 100, 0, math.sin(i)) for i in range(1000)], "t double, channel int, value double")
    y = spark.createDataFrame([("a", i / 20) for i in range(200)], "neuron string, t double")
    wx, wy = tables.paired(x, y, "continuous", "spike", 0.1, options_x={"seconds": 0.01}, options_y={})
    n = wx.select("w").distinct().count()
    assert 90 <= n <= 110 and n == wy.select("w").distinct().count()


def test_tables_round_trip(spark, tmp_path):
    df = spark.range(5)
    tables.save(df, str(tmp_path / "a"))
    assert tables.load(spark, str(tmp_path / "a")).count() == 5
    with pytest.raises(Exception):
        tables.save(df, str(tmp_path / "a"))


def test_conservative_epoch(spark):
    rows = [(0, [0.1, 0.5, 0.4, 0.9, 0.9005, 1.0]), (1, [-3.0, -1.0, -2.0]), (2, []), (3, [float("nan"), 0.2]), (4, [None, 0.3])]
    found = spark.createDataFrame(rows, "k int, h array<double>").select("k", regression.conservative_epoch(F.col("h"), 0.85).alias("e")).collect()
    assert {r["k"]: r["e"] for r in found} == {0: 3, 1: 1, 2: None, 3: 1, 4: 1}


def test_transfer_with_histories(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=3000)
    y = 0.8 * np.roll(x, 2) + 0.6 * rng.normal(size=3000)
    series = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "idx long, x double, y double")
    one, plain = modes.transfer_histories(series, 1).first(), modes.transfer(series).first()
    assert one["te_xy"] == pytest.approx(plain["te_xy"], abs=1e-6) and one["te_yx"] == pytest.approx(plain["te_yx"], abs=1e-6)
    two = modes.transfer_histories(series, 2).first()
    assert one["te_xy"] < 0.02 and two["te_xy"] == pytest.approx(-np.log2(0.6), abs=0.05) and two["directionality"] > 0.9
    past = np.stack([y[:-2], y[1:-1], x[:-2], x[1:-1], y[2:]], axis=1)
    logdet = lambda c: np.linalg.slogdet(np.corrcoef(past[:, c].T))[1] if len(c) > 1 else 0.0
    brute = 0.5 * (logdet([0, 1, 2, 3]) - logdet([0, 1, 2, 3, 4]) - logdet([0, 1]) + logdet([0, 1, 4])) / np.log(2)
    assert two["te_xy"] == pytest.approx(brute, abs=1e-6)


def test_circle_of_a_heatmap(spark):
    heat = spark.createDataFrame([(w, lag, 0.0 if w < 4 else 1.0 if lag >= 0 else 0.1) for w in range(1, 9) for lag in range(-2, 5)], "window int, lag int, mi double")
    points = {(r["lag"], round(r["window"], 3)) for r in modes.significant_contour(heat, 0.5).collect()}
    assert (0.0, 3.5) in points and all(p[1] == 3.5 or -1 < p[0] < 0 for p in points)
    r = modes.parsimonious_circle(heat, 0.5).first()
    assert r["contour"] == 4 and r["length"] == pytest.approx(math.hypot(4 / 9, 0)) and r["radius"] == pytest.approx(r["length"] / 2 * 1.2)
    assert modes.parsimonious_circle(heat, 5.0).count() == 0


def test_queries_without_sql_take_all_channels(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    e = np.array([r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("embedding").cast("array<double>")).collect()])
    x, y = ((v - v.mean(0)) / v.std(0) for v in (e[:, :32], e[:, 32:]))
    sigma = np.linalg.svd(x.T @ y / (len(e) - 1), compute_uv=False)
    assert queries.spectrum_summary(spark, sf).first()["pr_singular"] == pytest.approx(sigma.sum() ** 2 / (sigma**2).sum(), rel=1e-4)
    sizes = lambda df, *columns: {tuple(r) for r in df.select(*[F.size(c) for c in columns]).distinct().collect()}
    assert sizes(queries.rotated_embeddings(spark, sf), "x", "y", "u", "v") == {(32,) * 4}
    assert {r["channel"] for r in queries.fixed_noise(spark, sf).select("channel").distinct().collect()} == set(range(32))
    real, taken = critics.learned, []
    monkeypatch.setattr(critics, "learned", lambda samples, *a: taken.append(sizes(samples, "x", "y")) or real(samples, *a))
    assert queries.learned_estimate(spark, sf).first()["eval_size"] > 0 and taken == [{(32, 32)}]


def test_windowed_pairs_take_every_step(spark, monkeypatch):
    rng = np.random.default_rng(3)
    days = [k for k in range(100, 160) if k not in (120, 121)]
    v = {k: (float(a), float(b)) for k, (a, b) in zip(days, rng.normal(size=(len(days), 2)), strict=True)}
    found = {tuple(r)[:3]: tuple(r)[3:] for r in modes.windowed_pairs(spark.createDataFrame([(k, *p) for k, p in v.items()], "idx long, x double, y double"), [2, 5, 80], [-3, 0, 4]).collect()}
    mean = lambda a, n, c: np.mean([v[k][c] for k in range(a, a + n) if k in v] or [np.nan])
    brute = {(n, lag, a): (mean(a, n, 0), mean(a + lag, n, 1)) for n in (2, 5) for lag in (-3, 0, 4) for a in range(100, 161 - n) if 100 <= a + lag <= 160 - n}
    brute = {k: p for k, p in brute.items() if not np.isnan(p).any()}
    assert found.keys() == brute.keys() and all(found[k] == pytest.approx(brute[k]) for k in brute)
    real, rows = modes.estimate, []
    monkeypatch.setattr(modes, "estimate", lambda t, keys: rows.append(t.where("window = 80 AND lag = 0").count()) or real(t, keys))
    assert queries.parsimonious_circle(spark, "/root/testdata/sf0.001").count() == 1 and rows[0] > 2000


def test_windows_of_names_are_made_in_blocks(spark):
    from infospan.operators.windows import Grid, each_window

    names = spark.createDataFrame([("a",), ("b",)], "neuron string")
    found = sorted(map(tuple, each_window(names, Grid(1.0, 0.0, 10.0), block=3).collect()))
    assert found == [(n, w) for n in "ab" for w in range(10)]
    assert each_window(names, Grid(1.0, 5.0, 5.0)).count() == 0
    assert each_window(names, Grid(1.0, 0.0, 3e9)).limit(3).count() == 3


def test_blocks_are_drawn_from_all_placements(spark):
    seen = set()
    for seed in range(1000):
        starts = splits.test_starts(1000 - 5 * 20, 5, seed)
        lows = [s + b * 20 for b, s in enumerate(starts)]
        assert len(lows) == 5 and lows[0] >= 0 and lows[-1] + 20 <= 1000
        assert all(b - a >= 21 for a, b in zip(lows, lows[1:], strict=False))
        seen.add(tuple(splits.test_starts(5, 2, seed)))
    assert seen == {(a, b) for a in range(5) for b in range(a + 1, 5)}
    blocks = splits.test_blocks(spark, 53, fraction=0.7, blocks=4, seed=1).collect()
    assert [r["hi"] - r["lo"] + 1 for r in blocks] == [4, 4, 4, 3] and max(r["hi"] for r in blocks) < 53
    few = splits.blocked_split(spark.range(20), fraction=0.9, blocks=5, gap=0.0, seed=1).groupBy("role").count()
    assert {r["role"]: r["count"] for r in few.collect()} == {"test": 2, "train": 18}
    assert splits.blocked_split(spark.range(5), fraction=0.9).where("role = 'train'").count() == 5


def test_medians_equal_sorted_ones(spark):
    import statistics

    rows = [(k, float((i * i * 7919) % 101)) for k, n in (("a", 1), ("b", 2), ("c", 501), ("d", 500)) for i in range(n)]
    rows += [("e", 5.0)] * 300 + [(None, 1.0), (None, 4.0), ("f", None)] + [("c", None)] * 50
    df = spark.createDataFrame(rows, "k string, v double")
    values = {}
    for k, v in rows:
        values.setdefault(k, []).extend([] if v is None else [v])
    wanted = {k: statistics.median(v) if v else None for k, v in values.items()}
    assert {r["k"]: r["median"] for r in medians(df, ["k"], "v").collect()} == wanted
    assert medians(df, [], "v").first()["median"] == statistics.median([v for _, v in rows if v is not None])
    assert medians(df.where("false"), [], "v").collect()[0]["median"] is None
    assert medians(df.where("false"), ["k"], "v").count() == 0


def test_ranks_follow_the_order_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(None if i % 50 == 0 else i % 3 if i < 400 else i, i) for i in range(600)], "k int, id int")
    found = sorted(map(tuple, align.numbered(df, "k", "rank").select("rank", "k", "id").collect()))
    assert [r[0] for r in found] == list(range(600)) and {r[2] for r in found} == set(range(600))
    keys = [-1 if r[1] is None else r[1] for r in found]
    assert keys == sorted(keys)
    assert align.numbered(df.where("false"), "k", "rank").count() == 0
