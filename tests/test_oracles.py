"""Every core query with SQL gives DuckDB's rows: all at the smallest scale, those of rounded means and thresholds at a larger one, too."""

import duckdb
import pandas as pd
import pytest

from infospan import queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


@pytest.fixture(scope="module")
def larger():
    return connected(LARGER)


def rows(df):
    """Rows with floats to 9 significant digits: rounding is the queries' own."""
    cell = lambda v: None if v is None or v is pd.NA or v != v else float(f"{v:.9g}") if isinstance(v, float) else v
    columns = sorted(df.columns)
    return sorted((tuple(map(cell, r)) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found, wanted = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", ["sweep_summary", "wls_extrapolate", "noise_precision", "lag_grid", "pairwise_grid", "longest_contour", "parsimonious_circle", "noise_ladder", "cross_correlations", "stream_closed_windows", "stream_resampled", "period_median"])
def test_query_equals_sql_on_more_rows(spark, larger, name):
    found, wanted = queries.QUERIES[name](spark, LARGER).toPandas(), larger.sql(queries.ORACLES[name]).df()
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
