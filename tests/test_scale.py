"""Neighbour search, prefix sums, table scopes and lazy fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlens.functions.ranking import prefix_sums
from cardlens.operators import cleanse, metrics
from cardlens.operators.knn import exact_top_k
from cardlens.sources import tables
from conftest import SF0001


def brute(cands, probes, k, metric, key_desc, exclude_self):
    out = set()
    for p, v in probes:
        scored = []
        for c, u in cands:
            if exclude_self and c == p:
                continue
            if metric == "cosine":
                n = np.linalg.norm(v) * np.linalg.norm(u)
                s = -round(float(np.dot(v, u) / n), 9) if n else 0.0
            else:
                s = round(float(((np.array(v) - np.array(u)) ** 2).sum()), 9)
            scored.append((s, -c if key_desc else c))
        out |= {(p, r + 1, abs(c)) for r, (_, c) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("metric,key_desc,exclude_self", [("cosine", True, False), ("sqeuclidean", False, True)])
def test_neighbours_equal_brute_force(spark, metric, key_desc, exclude_self):
    """A third of all vectors are one vector; others are clustered, zero, null or repeated."""
    rng = np.random.default_rng(3)
    same = [1.0, 2.0, 0.5]
    vectors = [same if i % 3 == 0 else list(map(float, rng.integers(-4, 5, 3) + (i % 7) * 3)) for i in range(1, 900)]
    vectors[10] = [0.0, 0.0, 0.0]
    rows = list(enumerate(vectors, 1))
    df = spark.createDataFrame(rows + [(1000, None), (1001, [1.0, None, 2.0])], "k long, v array<double>")
    probes = df.where("k % 5 = 0 OR k >= 1000")
    got = exact_top_k(df, "k", probes, "k", "v", 4, metric, key_desc, exclude_self, slice_rows=256, cand_payload="k")
    found = {(r.probe_key, r.nn_rank, r.cand_key) for r in got.collect()}
    assert found == brute(rows, [r for r in rows if r[0] % 5 == 0], 4, metric, key_desc, exclude_self)
    assert got.where("cand_payload <> cand_key").isEmpty()


def test_neighbours_with_many_blocks(spark, monkeypatch):
    from cardlens.operators import knn
    rng = np.random.default_rng(4)
    rows = [(i, list(map(float, rng.normal(size=4) + 8 * rng.integers(0, 6, 4)))) for i in range(1, 5001)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = exact_top_k(df, "k", df.where("k % 50 = 0"), "k", "v", 3, "sqeuclidean", False, True)
    found = {(r.probe_key, r.nn_rank, r.cand_key) for r in got.collect()}
    assert found == brute(rows, [r for r in rows if r[0] % 50 == 0], 3, "sqeuclidean", False, True)


def test_no_neighbours_of_an_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0])], "k long, v array<double>")
    assert exact_top_k(df.where("false"), "k", df, "k", "v", 2).collect() == []
    assert exact_top_k(df, "k", df.where("false"), "k", "v", 2).collect() == []


def test_prefix_sums_use_the_parts_asked_for(spark):
    from cardlens.functions.ranking import range_parts
    df = spark.range(40_000).select(F.col("id").alias("x"), F.lit(2).cast("long").alias("v"))
    assert range_parts(df, "x", 300).select("_part").distinct().count() > 270
    got = prefix_sums(df, "x", ["v"], 300)
    assert got.where("cum_v <> 2 * (x + 1)").isEmpty() and got.count() == 40_000


def test_null_scores_have_no_place(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None), (0, None)], "label int, score double")
    assert metrics.roc_auc(df).first()[0] == 1.0
    assert metrics.pr_curve(df).where("threshold IS NULL").isEmpty()


def test_confusion_matrix_of_many_classes(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("label"), F.col("id").cast("string").alias("prediction"))
    got = metrics.confusion_matrix(df)
    assert got.count() == 90_000 and got.agg(F.sum("n")).first()[0] == 300


def test_table_scope_deletes_its_tables(spark, tmp_path):
    with tables.table_scope():
        df = tables.materialize(spark.range(10))
        path = df.inputFiles()[0]
        assert df.count() == 10
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_boolean_mode_is_filled(spark):
    df = spark.createDataFrame([(True, "a"), (True, None), (None, "a"), (False, "b")], "f boolean, s string")
    out = cleanse.fill_mode(df)
    assert [r.f for r in out.collect()].count(None) == 0 and out.where("f").count() == 3
    nothing = cleanse.fill_mode(spark.createDataFrame([(None, None)], "f boolean, s string")).first()
    assert nothing.f is None and nothing.s == "Unknown"


def test_building_a_query_of_numbers_starts_no_job(spark):
    from cardlens.plans.registry import QUERIES
    QUERIES["weekly_trends"](spark, SF0001)  # the tables' schemas are read once a session
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    QUERIES["weekly_trends"](spark, SF0001)
    jobs = tracker.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 0
