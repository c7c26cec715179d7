import pytest
from pyspark.sql import functions as F

from infospan.functions import augment
from infospan.plans import generators
from infospan.plans.api import run
from infospan.results import Results, compared


@pytest.fixture(scope="module")
def pairs(spark):
    s = generators.correlated_gaussians(spark, 1000, 1, 1.0, seed=3)
    return s.select("id", F.col("id").alias("idx"), F.col("x")[0].alias("x"), F.col("y")[0].alias("y"), F.rand(1).alias("z")).cache()


def test_modes(spark, pairs):
    assert run(pairs).estimate() == pytest.approx(1.0, abs=0.2)
    assert run(pairs, output_units="nats").estimate() == pytest.approx(0.693, abs=0.15)
    assert run(pairs, "rigorous").estimate() == pytest.approx(1.0, abs=0.2)
    assert run(pairs, "lag", lags=(-1, 0, 1)).table.orderBy(F.desc("mi")).first()["lag"] == 0
    p = run(pairs, "precision", tau_grid=(0.1, 4.0), threshold_ratio=[0.5, 0.9])
    assert p.table.count() == 3 and p.details["thresholds"].count() == 2
    assert run(pairs, "conditional").estimate() == pytest.approx(1.0, abs=0.2)
    assert abs(run(pairs, "transfer").estimate()) < 0.1
    assert run(pairs, "pairwise", columns=("x", "y", "z")).table.count() == 3
    assert run(pairs, "permutation", n_permutations=5).table.agg(F.max("mi")).first()[0] < 0.1
    s = run(pairs, "sweep", grid={"k": [1, 2]}, repeats=2, fraction=0.5)
    assert s.table.count() == 2 and s.details["runs"].count() == 4


def test_dimensionality(spark):
    s = generators.correlated_gaussians(spark, 500, 4, 2.0, seed=4).select("id", F.concat("x", "y").alias("x"))
    r = run(s, "dimensionality", split_method="spatial").table.first()
    assert 3 < r["pr_eig"] <= 4


def test_bad_parameters(pairs):
    for options in ({"mode": "other"}, {"mode": "lag", "unknown": 1}, {"output_units": "x"}, {"mode": "rigorous", "gammas": 1}):
        with pytest.raises(ValueError):
            run(pairs, **options)
    with pytest.raises(ValueError):
        run(pairs.drop("y"))


def test_save_and_compare(spark, pairs, tmp_path):
    r = run(pairs, "lag", lags=(0, 1))
    r.save(str(tmp_path / "r"))
    assert Results.load(spark, str(tmp_path / "r")).table.count() == 2
    assert compared({"a": r, "b": r}).count() == 4 and "lag" in r.summary()


def test_augmentations(spark):
    image = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))
    r = spark.range(1).select(
        augment.flip_h(image, 1.0).alias("h"), augment.flip_v(image, 1.0).alias("v"), augment.rotate_90(image).alias("r"), augment.time_mask(image, F.lit(0), 1).alias("t"), augment.freq_mask(image, F.lit(1), 1).alias("f"), augment.crop(image, F.lit(1), F.lit(0), 1, 2).alias("c"), augment.erase(image, F.lit(0), F.lit(1), 1, 1).alias("e"),
    ).first()
    assert r["h"] == [[2, 1], [4, 3]] and r["v"] == [[3, 4], [1, 2]] and r["r"] == [[2, 4], [1, 3]]
    assert r["t"] == [[0, 2], [0, 4]] and r["f"] == [[1, 2], [0, 0]] and r["c"] == [[3, 4]] and r["e"] == [[1, 0], [3, 4]]
