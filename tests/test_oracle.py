"""Every SQL-checked query equals its DuckDB oracle (the driver's gate), at sf0.001."""

import pytest

import __spark_entry__ as E
from cardlens.plans.check import compare, duck
from conftest import SF0001

SQL = E.oracle_sql()
NAMES = sorted(k for k in SQL if not k.startswith("op"))  # the training-data operators have tests of their own


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


def test_every_query_has_an_oracle_or_is_a_model():
    from cardlens.plans.registry import QUERIES
    missing = set(QUERIES) - set(SQL)
    assert all(("predictions" in m) or m in ("feature_importance", "split_importance", "top_features", "fraud_rf_evaluation") for m in missing), missing


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["credit_score_band", "band_order", "n_rows"]
    assert sorted(r.n_rows for r in df.collect()) == [52, 63, 603, 782]  # FIXTURES.md §5 at sf0.001


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, E.queries()[name], SQL[name], SF0001, con)
    assert r["ok"], r
