"""Means and centred products against numpy, by keys and over many tasks."""

import math

import numpy as np
import pytest

from infospan.functions import gram, spectra


def test_sums_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = 1e6 + rng.normal(size=(500, 3)), rng.normal(size=(500, 2))
    rows = [(i % 3 if i % 3 else None, "a" if i % 2 else "b", x[i].tolist(), y[i].tolist()) for i in range(500)]
    rows += [(1, "a", None, [1.0, 2.0]), (1, "a", [1.0, None, 2.0], [1.0, 2.0]), (1, "a", [1.0, math.nan, 2.0], [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "k int, name string, x array<double>, y array<double>").repartition(7)
    found = gram.sums(frame, ["k", "name"]).collect()
    assert len(found) == 6
    v = np.hstack([x, y])
    for r in found:
        at = [i for i in range(500) if (i % 3 if i % 3 else None) == r["k"] and ("a" if i % 2 else "b") == r["name"]]
        n, dx, mean, products = gram.unpacked(r)
        assert (n, dx) == (len(at), 3)
        assert mean == pytest.approx(v[at].mean(axis=0), rel=1e-12)
        assert products == pytest.approx((v[at] - v[at].mean(axis=0)).T @ (v[at] - v[at].mean(axis=0)), rel=1e-6, abs=1e-6)
    alone = gram.sums(frame).collect()
    assert len(alone) == 1 and gram.unpacked(alone[0])[0] == 500
    assert gram.sums(frame.where("k > 100"), ["k"]).count() == 0


def test_covariances_of_one_row_are_null(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], [3.0])], "k int, x array<double>, y array<double>")
    assert [r["c"] for r in spectra.cross_covariance(frame, "std", ["k"]).collect()] == [None, None]


def test_no_row_a_cell_and_sample_in_the_plan(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], [3.0])] * 3, "k int, x array<double>, y array<double>")
    plan = spectra.cross_covariance(frame)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan
