"""Clustered layout: same rows from fewer files."""

import uuid

import pytest
from pyspark.sql import functions as F

from cardlens.operators import explore
from cardlens.plans.portfolio import portfolio_table
from cardlens.session import ensure_checkpoint_dir
from cardlens.sources import layout
from conftest import SF0001

COLS = ["Txn_Id", *layout.SEARCH]


@pytest.fixture(scope="module")
def table(spark):
    p = portfolio_table(spark, SF0001, COLS)
    odd = p.limit(5).withColumns({"Income": F.lit(None).cast("long"), "Gender": F.lit(None).cast("string")}).select(*p.columns)
    return p.unionByName(odd)


@pytest.fixture(scope="module")
def path(spark, table):
    at = f"{ensure_checkpoint_dir(spark)}/layout-{uuid.uuid4().hex}"
    layout.write_clustered(table, at, n_files=32)
    return at


SEARCHES = [{}, {"age": (25, 50), "income": (30000, 120000), "gender": "F", "band": "Good"}, {"age": (40, 42), "income": (50000, 60000)},
            {"gender": "M"}, {"band": "Excellent", "age": (0, 200), "income": (0, 10 ** 9)}, {"age": (300, 400)}, {"band": "None"}]


@pytest.mark.parametrize("wanted", SEARCHES, ids=str)
def test_same_rows(spark, table, path, wanted):
    want = sorted(r["Txn_Id"] for r in explore.customer_search(table, **wanted).collect())
    assert sorted(r["Txn_Id"] for r in layout.clustered_search(spark, path, **wanted).collect()) == want


def test_fewer_files_are_read(spark, table, path):
    every = len(spark.read.parquet(f"{path}/rows").inputFiles())
    narrow = layout.clustered_search(spark, path, age=(40, 42), income=(50000, 60000), gender="F", band="Good")
    assert every >= 24 and 0 < len(narrow.inputFiles()) <= every // 4
    assert spark.read.parquet(f"{path}/rows").count() == table.count()
    assert spark.read.parquet(f"{path}/manifest").agg(F.sum("n")).first()[0] == table.count()


def test_hot_position_fills_several_files(spark):
    at = f"{ensure_checkpoint_dir(spark)}/layout-{uuid.uuid4().hex}"
    rows = [(i, 40, 50000, "F", "Good") if i % 3 else (i, 20 + i % 60, 1000 * i, "M", "Fair") for i in range(3000)]
    layout.write_clustered(spark.createDataFrame(rows, "Txn_Id long, Customer_Age long, Income long, Gender string, credit_score_band string"), at, n_files=12)
    assert spark.read.parquet(f"{at}/manifest").agg(F.max("n")).first()[0] < 900


def test_empty_table(spark, table):
    at = f"{ensure_checkpoint_dir(spark)}/layout-{uuid.uuid4().hex}"
    layout.write_clustered(table.where("false"), at)
    assert layout.clustered_search(spark, at).collect() == []
