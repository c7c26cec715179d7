"""Learned critics: many tasks from one state table, resumed runs, frozen scores, spectra and alignment of embeddings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from infospan.plans import critics, generators
from infospan.plans.api import run

QUICK = {"critic": "mlp", "n_epochs": 4, "learning_rate": 5e-3, "hidden_dim": 16, "embedding_dim": 4}


@pytest.fixture(scope="module")
def pairs(spark):
    return generators.correlated_gaussians(spark, 900, 2, 2.0, seed=5).persist()


@pytest.mark.parametrize("estimator", ["infonce", "smile"])
def test_bound_in_slices_is_that_of_the_matrix(estimator):
    rng = np.random.default_rng(2)
    t = critics.Training(embedding_dim=3, estimator=estimator, clip=1.5)
    for n in (2, 513, 1100):
        a, b = rng.normal(size=(n, 3)), rng.normal(size=(n, 3))
        assert critics.bound(a, b, t) == pytest.approx(critics.bound_and_gradient(a @ b.T / np.sqrt(3), estimator, 1.5)[0], abs=1e-9)


def test_a_stopped_run_goes_on_where_it_stopped(spark, pairs, tmp_path, monkeypatch):
    t = critics.Training(n_epochs=5, learning_rate=5e-3, hidden_dim=16, embedding_dim=4, shard_rows=200, max_eval_samples=50)
    whole = critics.train(pairs, t).runs.first()
    real, done = critics._pass, []

    def failing(met, t, epoch):
        if epoch == 3 and not done:
            done.append(epoch)
            raise RuntimeError("the driver is lost")
        return real(met, t, epoch)

    monkeypatch.setattr(critics, "_pass", failing)
    folder = f"file://{tmp_path}/critic"
    with pytest.raises(RuntimeError):
        critics.train(pairs, t, folder=folder)
    seen = []
    monkeypatch.setattr(critics, "_pass", lambda met, t, epoch: seen.append(epoch) or real(met, t, epoch))
    again = critics.train(pairs, t, folder=folder).runs.first()
    assert seen == [3, 4, 5]
    assert again == whole


def test_the_rows_are_shuffled_once(spark, pairs):
    t = critics.Training(n_epochs=1, hidden_dim=16, embedding_dim=4, shard_rows=200)
    trained = critics.train(pairs, t)
    plan = critics._pass(critics._met(trained.shards, trained.states.where("epoch = 1"), 1, 4, t), t, 1)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_tasks_train_as_if_alone(spark, pairs):
    t = critics.Training(n_epochs=3, learning_rate=5e-3, hidden_dim=16, embedding_dim=4)
    both = pairs.withColumn("scale", F.explode(F.array(F.lit(1.0), F.lit(0.0)))).withColumn("x", F.transform("x", lambda v: v * F.col("scale")))
    found = {r["scale"]: r for r in critics.learned(both, t, ["scale"]).collect()}
    alone = critics.learned(pairs, t).first()
    assert found[1.0]["test_mi_history"] == pytest.approx(alone["test_mi_history"], abs=1e-9)
    assert found[1.0]["x_weights"] == pytest.approx(alone["x_weights"], abs=1e-9)
    assert found[0.0]["test_mi"] < found[1.0]["test_mi"]


def test_conservative_epoch_is_the_first_near_the_best(spark, pairs):
    t = critics.Training(n_epochs=8, learning_rate=2e-3, hidden_dim=16, embedding_dim=4, peak_fraction=0.5)
    trained = critics.train(pairs, t)
    r = trained.runs.first()
    history, best = r["test_mi_history"], r["best_epoch"]
    improving = [e for e in range(best + 1) if e == 0 or history[e] > max(history[:e])]
    assert r["conservative_epoch"] == next(e for e in improving if history[e] >= 0.5 * history[best]) <= best
    assert r["conservative_test_mi"] == history[r["conservative_epoch"]]
    assert sorted(w["epoch"] for w in trained.weights.collect()) == list(range(8))


def test_frozen_critic_scores_corrupted_copies(spark, pairs):
    found = run(pairs, "precision", tau_grid=(0.01, 1.0, 8.0), **QUICK | {"n_epochs": 10})
    mi = {r["tau"]: r["mi"] for r in found.table.collect()}
    assert set(mi) == {0.0, 0.01, 1.0, 8.0} and mi[0.01] == pytest.approx(mi[0.0], abs=0.02) and mi[8.0] < 0.5 * mi[0.0] < mi[0.0]
    assert found.details["thresholds"].first()["tau"] in (1.0, 8.0)
    assert found.details["runs"].count() == 1
    noisy = run(pairs, "precision", tau_grid=(6.0,), corruption_method="noise", n_noise_samples=3, **QUICK).table
    assert {r["tau"]: r["n_runs"] for r in noisy.collect()} == {0.0: 1, 6.0: 3}


def test_frozen_scores_at_zero_are_those_of_the_rows(spark, pairs):
    t = critics.Training(n_epochs=2, learning_rate=5e-3, hidden_dim=16, embedding_dim=4)
    trained = critics.train(pairs, t)
    r = critics.corrupted_scores(trained, [], bits=False).first()
    shard = trained.shards.where("part >= 0").first()
    model = trained.runs.first()
    x, y = (np.frombuffer(shard[c]).reshape(shard["n"], 2) for c in ("x", "y"))
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y array<double>")
    found = critics.embed(rows, trained.runs, t).collect()
    a, b = (np.array([f[c] for f in found]) for c in ("x_embedding", "y_embedding"))
    assert model["error"] is None and r["n"] == shard["n"]
    assert r["mi"] == pytest.approx(critics.bound(a, b, t), abs=1e-9)


def test_other_modes_take_the_critic(spark):
    wide = generators.correlated_gaussians(spark, 700, 1, 2.0, seed=9).select("id", "x", "y", F.array(F.hash("id") / 1e9).alias("z")).persist()
    lag = run(wide.withColumnRenamed("id", "idx"), "lag", lags=(0, 3), **QUICK)
    mi = {r["lag"]: r["mi"] for r in lag.table.collect()}
    assert mi[0] > mi[3] and lag.details["runs"].count() == 2
    pair = run(wide, "pairwise", columns=("x", "y", "z"), **QUICK).table
    found = {(r["a"], r["b"]): r["mi"] for r in pair.collect()}
    assert set(found) == {("x", "y"), ("x", "z"), ("y", "z")} and found["x", "y"] == max(found.values())
    null = run(wide, "permutation", n_permutations=3, **QUICK)
    assert null.table.count() == 3 and null.details["observed"].first()["mi"] > max(r["mi"] for r in null.table.collect())
    assert run(wide, "conditional", **QUICK).table.first()["cmi"] is not None


def test_rigorous_with_the_critic(spark, pairs):
    found = run(pairs, "rigorous", gammas=3, min_gamma_points=2, **QUICK)
    assert found.details["runs"].count() == 6 and found.table.count() == 1


def test_dimensionality_of_embeddings(spark):
    rows = generators.correlated_gaussians(spark, 600, 3, 3.0, seed=11).select("id", F.concat("x", "y").alias("x"))
    found = run(rows, "dimensionality", split_method="spatial", **QUICK)
    r = found.table.first()
    assert 1 <= r["pr_eig"] <= 4 and r["mi"] is not None
    assert found.details["epochs"].count() == 4


def test_turned_embeddings_come_back(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 4))
    turns = {e: np.linalg.qr(rng.normal(size=(4, 4)))[0] for e in range(3)}
    rows = [(e, i, (base[i] @ turns[e]).tolist(), [0.0]) for e in turns for i in range(80)]
    found = critics.aligned(spark.createDataFrame(rows, "epoch int, id long, x array<double>, y array<double>"), to=2).collect()
    wanted = {i: base[i] @ turns[2] for i in range(80)}
    assert len(found) == 240 and all(np.abs(np.array(r["x"]) - wanted[r["id"]]).max() < 1e-6 for r in found)


def test_weights_meet_blocks_of_samples(spark, pairs):
    """Embeddings after each epoch are the encoders' own, of either task, and no row of the samples carries weights."""
    t = critics.Training(n_epochs=2, learning_rate=5e-3, hidden_dim=16, embedding_dim=4)
    both = pairs.withColumn("task", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("x", F.when(F.col("task") == "a", F.col("x")).otherwise(F.reverse("x")))
    trained = critics.train(both, t, ["task"])
    embedded = critics.embeddings_by_epoch(trained, both, keys=["task"])
    assert "ids#" in embedded._jdf.queryExecution().executedPlan().toString()
    found = embedded.toPandas()
    assert len(found) == 2 * 2 * 900 and list(found.columns) == ["task", "epoch", "id", "x", "y"]
    samples = both.toPandas().set_index(["task", "id"])
    for r in trained.weights.collect():
        own = found[(found["task"] == r["task"]) & (found["epoch"] == r["epoch"])].sort_values("id")
        rows = samples.loc[[(r["task"], i) for i in own["id"]]]
        for side in ("x", "y"):
            v, flat = np.stack(rows[side].to_list()), np.asarray(r[f"{side}_weights"])
            d = v.shape[1]
            wanted = critics.Encoder(d, t, np.random.default_rng(0)).load(flat[2 * d :])((v - flat[:d]) / flat[d : 2 * d])
            assert np.allclose(np.stack(own[side].to_list()), wanted, atol=1e-12)
