"""Cleansing, exploration, sources, metrics and neighbour-search invariants."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlens.functions import hashing, ranking
from cardlens.operators import cleanse, explore, knn, metrics, predictions, smote
from cardlens.sources import csv, schema, tables


def test_mode_ties_and_all_null(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)],
                               "x string, y string")
    out = cleanse.fill_mode(df)
    assert [r.x for r in out.collect()][-1] == "a"      # tie -> smallest value
    assert {r.y for r in out.collect()} == {"Unknown"}  # no values -> Unknown


def test_parse_dates_bad_value_is_null(spark):
    df = spark.createDataFrame([("31-12-2023",), ("n/a",), ("31-02-2023",)], "Week_Start_Date string")
    got = [r[0] for r in cleanse.parse_dates(df).collect()]
    assert got == [dt.date(2023, 12, 31), None, None]


def test_recent_transactions_null_dates_last(spark):
    rows = [(1, 10, None), (1, 11, dt.date(2020, 1, 6)), (1, 12, dt.date(2020, 1, 13)), (1, 13, dt.date(2020, 1, 13))]
    df = spark.createDataFrame(rows, "Client_Num long, Txn_Id long, Week_Start_Date date").withColumns(
        {"Total_Trans_Amt": F.lit(1), "Total_Trans_Ct": F.lit(1), "Exp_Type": F.lit("x")})
    got = [r.Txn_Id for r in explore.recent_transactions(df, 3).orderBy("recent_rank").collect()]
    assert got == [12, 13, 11]


def test_absent_customer_defaults(spark):
    req = spark.createDataFrame([(1,), (2,)], "Client_Num long")
    scored = spark.createDataFrame([(1, "Good", 0.7, {"Good": 0.7, "Fair": 0.3})],
                                   "Client_Num long, credit_score_band_pred string, probability double, "
                                   "all_probabilities map<string,double>")
    out = {r.Client_Num: r for r in predictions.score_requests(req, scored).collect()}
    assert out[1].error is None and out[1].credit_score_band == "Good"
    assert out[2].error == "Customer not found" and out[2].credit_score_band == "Unknown"
    assert out[2].probability == 0.0 and out[2].all_probabilities == {}


def test_split_stable_under_repartition(spark):
    df = spark.range(0, 5000).withColumn("s", hashing.split_label(F.col("id")))
    a = {r.id: r.s for r in df.collect()}
    b = {r.id: r.s for r in df.repartition(7).collect()}
    assert a == b and 0.77 < sum(v == "train" for v in a.values()) / len(a) < 0.83


def test_csv_reader_handles_bom_crlf_and_blank_headers(spark):
    d = tempfile.mkdtemp(prefix="cardlens-csv-")
    header = ",".join("Use Chip" if f.name == "Use_Chip" else "Exp Type" if f.name == "Exp_Type" else f.name
                      for f in schema.CC_SCHEMA.fields)
    row = "911017231,Blue,95,1,87,31-12-2023,Week-53,Q4,2023,1438.3,0,687,12,0.5,Swipe ,Bills,82,0"
    with open(os.path.join(d, "cc.csv"), "wb") as fh:
        fh.write(("﻿" + header + "\r\n" + row + "\r\n").encode("utf-8"))
    df = cleanse.parse_dates(csv.read_cc_csv(spark, os.path.join(d, "cc.csv")))
    r = df.first()
    assert "Use_Chip" in df.columns and r.Use_Chip == "Swipe" and r.Client_Num == 911017231
    assert r.Week_Start_Date == dt.date(2023, 12, 31)


def test_append_load_and_empty_input(spark):
    d = tempfile.mkdtemp(prefix="cardlens-tbl-")
    path = os.path.join(d, "t")
    a = spark.createDataFrame([(1, "x")], "Client_Num long, Gender string")
    tables.write_table(a, path, schema.CUST_SCHEMA)
    tables.append_load(a, path, schema.CUST_SCHEMA)
    back = spark.read.parquet(path)
    assert back.count() == 2 and back.schema == schema.CUST_SCHEMA
    with pytest.raises(tables.EmptyInputError):
        tables.require_rows(a.where("false"))


def test_prefix_sums_match_cumsum(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 100, 2000)
    df = spark.createDataFrame([(float(i), int(v)) for i, v in enumerate(vals)], "k double, v long")
    got = {r.k: r.cum_v for r in ranking.prefix_sums(df, "k", ["v"], n_buckets=7).collect()}
    assert [got[float(i)] for i in range(len(vals))] == list(np.cumsum(vals))


def test_auc_equals_pairwise_count(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) + 0.3 * y, 1)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label long, score double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    got = metrics.roc_auc(df, n_buckets=5).first()[0]
    assert abs(got - want) < 1e-12


@pytest.mark.parametrize("metric", ["cosine", "sqeuclidean"])
def test_knn_equals_brute_force(spark, metric):
    rng = np.random.default_rng(11)
    pts = np.round(rng.normal(size=(300, 3)), 1)  # coarse values -> ties
    pts[5] = 0.0                                    # a zero vector
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "k long, a double, b double, c double")
    largest = metric == "cosine"
    got = knn.exact_top_k(df, "k", df, "k", ["a", "b", "c"], 4, metric=metric, key_desc=largest,
                          exclude_self=not largest, slice_rows=256)
    got = {(r.probe_key, r.nn_rank): r.cand_key for r in got.collect()}
    for i in range(0, 300, 37):
        if largest:
            n = np.linalg.norm(pts, axis=1)
            u = np.divide(pts, n[:, None], out=np.zeros_like(pts), where=n[:, None] > 0)
            sc = np.round(u @ u[i], 9)
            order = sorted(range(300), key=lambda j: (-sc[j], -j))
        else:
            sc = np.round(((pts - pts[i]) ** 2).sum(axis=1), 9)
            order = sorted((j for j in range(300) if j != i), key=lambda j: (sc[j], j))
        assert [got[(i, r)] for r in range(1, 5)] == order[:4]


def test_smote_needs_six_minority_rows(spark):
    df = spark.createDataFrame([(i, float(i), 1 if i < 5 else 0) for i in range(40)], "k long, x double, y long")
    with pytest.raises(smote.NotEnoughMinority):
        smote.smote_plan(df, ["x"], "y", "k")


def test_smote_points_lie_on_segments_and_balance(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal()), float(rng.normal()), 1 if i % 4 == 0 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y long")
    out = smote.oversample(df, ["a", "b"], "y", "k")
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 150
    mino = np.array([(r[1], r[2]) for r in rows if r[3] == 1])
    syn = np.array([(r.a, r.b) for r in out.where(F.col("synth_index").isNotNull()).collect()])
    # every synthetic point is a convex combination of two minority points
    for p in syn[:25]:
        a, b = mino[None, :, :] - p, mino[:, None, :] - p
        d = np.abs(a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0])
        assert d.min() < 1e-9


def test_results_do_not_depend_on_partition_count(spark):
    from cardlens.plans.registry import QUERIES
    from conftest import SF0001
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(QUERIES["pr_curve"](spark, SF0001).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        b = sorted(QUERIES["pr_curve"](spark, SF0001).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_customer_csv_and_feature_list(spark):
    from cardlens.operators import features
    d = tempfile.mkdtemp(prefix="cardlens-csv-")
    header = ",".join({"state_cd": "State_cd", "contact": "Contact", "Personal_loan": "Personal_Loan"}.get(f.name, f.name)
                      for f in schema.CUST_SCHEMA.fields)
    row = "708082083,24,M,2,Graduate,Single,FL,91750,no,yes,no,cellular,Businessman,202326,3"
    with open(os.path.join(d, "cust.csv"), "wb") as fh:
        fh.write(("﻿" + header + "\r\n" + row + "\r\n").encode("utf-8"))
    df = csv.read_cust_csv(spark, os.path.join(d, "cust.csv"))
    assert df.columns == [f.name for f in schema.CUST_SCHEMA.fields] and df.first().Income == 202326
    oh, dummies = features.one_hot(spark.createDataFrame(
        [("Blue", "F", 1.0), ("Gold", "M", 2.0), ("Silver", "M", 3.0)], "Card_Category string, Gender string, Income double"))
    assert dummies == ["Card_Category_Gold", "Card_Category_Silver", "Gender_M"]
    cols = features.feature_columns(oh, numeric=["Income"])
    assert cols == ["Income", "Card_Category_Gold", "Card_Category_Silver", "Gender_M"]


def test_label_order_and_catalog(spark):
    from cardlens.operators import models, recommend
    idx = models.label_indexer("band", ["Poor", "Fair", "Good", "Excellent"])
    df = spark.createDataFrame([("Excellent",), ("Poor",), ("Good",)], "band string")
    assert [r.label for r in idx.transform(df).collect()] == [3.0, 0.0, 2.0]
    cat = recommend.card_catalog(spark).orderBy("catalog_pos").collect()
    assert [c.name for c in cat][:2] == ["Premium Rewards Card", "Cash Back Plus"] and len(cat) == 5
    assert cat[4].min_income == 75000 and len(cat[0].benefits) == 4


def test_vector_one_hot_matches_named_form(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    from cardlens.operators import features
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "Gender string")
    named, dummies = features.one_hot(df, ["Gender"])
    m = Pipeline(stages=features.one_hot_vector_stages(["Gender"])).fit(df)
    vec = m.transform(df).select(vector_to_array("Gender_vec").alias("v")).collect()
    # alphabetDesc indices: c=0, b=1, a=2; dropLast removes a
    got = [sorted(i for i, x in enumerate(r.v) if x == 1.0) for r in vec]
    want = [[j for j, d in enumerate(["Gender_c", "Gender_b"]) if r[d] == 1] for r in named.collect()]
    assert got == want and sorted(dummies) == ["Gender_b", "Gender_c"]


def test_bucketed_tables_join_without_shuffle(spark):
    from cardlens.operators import scoring
    from cardlens.sources import adapter
    from conftest import SF0001
    d = tempfile.mkdtemp(prefix="cardlens-bucket-")
    tables.write_bucketed(adapter.cc_detail(spark, SF0001), "cc_bucketed", "Client_Num", 8, os.path.join(d, "cc"))
    tables.write_bucketed(adapter.cust_detail(spark, SF0001), "cust_bucketed", "Client_Num", 8, os.path.join(d, "cu"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the sort-merge plan
    try:
        j = scoring.join_profile(spark.table("cc_bucketed"), spark.table("cust_bucketed"))
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == 1500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_auc_agrees_with_mllib_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 3000)
    s = rng.random(3000) + 0.5 * y  # continuous: no ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label long, score double")
    ours = metrics.roc_auc(df).first()[0]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                       numBins=0)
    theirs = ev.evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert abs(ours - theirs) < 1e-9


def test_fraud_request_defaults(spark):
    req = spark.createDataFrame([(1,), (2,)], "Client_Num long")
    scored = spark.createDataFrame([(1, 1, 0.8, "High")],
                                   "Client_Num long, fraud_prediction long, fraud_probability double, risk_level string")
    out = {r.Client_Num: r for r in predictions.score_fraud_requests(req, scored).collect()}
    assert (out[1].error, out[1].fraud_flag, out[1].risk_level) == (None, 1, "High")
    assert (out[2].error, out[2].fraud_flag, out[2].fraud_probability, out[2].risk_level) == \
        ("Customer not found", 0, 0.0, "Unknown")
    nm = predictions.score_fraud_requests(req, scored, model_ready=False).collect()
    assert {r.error for r in nm} == {"Model not ready"}


def test_shuffle_partition_sizing(spark):
    from cardlens.session import size_shuffle_partitions
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        cores = spark.sparkContext.defaultParallelism
        assert size_shuffle_partitions(spark, 10 << 20) == cores            # small: one per core
        assert size_shuffle_partitions(spark, 100 << 40) == 409600          # 100 TiB / 256 MiB
        assert spark.conf.get("spark.sql.shuffle.partitions") == "409600"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_write_table_conforms_and_partitions(spark):
    d = tempfile.mkdtemp(prefix="cardlens-tbl-")
    path = os.path.join(d, "cc")
    df = spark.createDataFrame([(1, "Blue", 2023), (2, "Gold", 2024)], "Client_Num int, Card_Category string, current_year int")
    tables.write_table(df, path, schema.CC_SCHEMA, partition_by=["current_year"])
    back = spark.read.parquet(path)
    assert {"current_year=2023", "current_year=2024"} <= set(os.listdir(path))
    assert back.schema["Client_Num"].dataType == schema.CC_SCHEMA["Client_Num"].dataType  # int -> bigint
    assert back.where("current_year = 2024").first().Credit_Limit is None                  # missing -> typed null
    assert back.where("current_year = 2024").count() == 1                                   # partition pruning path
