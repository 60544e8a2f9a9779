"""Incremental batch loads: each landed file is loaded exactly once."""

import os
import tempfile

from cardlens.sources.schema import CC_SCHEMA
from cardlens.streaming import ingest

HEADER = ",".join("Use Chip" if f.name == "Use_Chip" else "Exp Type" if f.name == "Exp_Type" else f.name
                  for f in CC_SCHEMA.fields)


def _batch(path, first_client, n, week="31-12-2023"):
    lines = [HEADER] + [f"{first_client + i},Blue,95,1,87,{week},Week-53,Q4,2023,5000,{i * 100},{1000 + i},"
                        f"{10 + i},0.{i % 10},Swipe ,Bills,82,0" for i in range(n)]
    with open(path, "wb") as fh:
        fh.write(("﻿" + "\r\n".join(lines) + "\r\n").encode("utf-8"))


def test_incremental_load_is_exactly_once(spark):
    root = tempfile.mkdtemp(prefix="cardlens-stream-")
    landing, table, ckpt = (os.path.join(root, x) for x in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    _batch(os.path.join(landing, "week1.csv"), 100, 5)
    _batch(os.path.join(landing, "week2.csv"), 200, 3)
    ingest.load_new_batches(spark, landing, table, ckpt).awaitTermination()
    assert spark.read.parquet(table).count() == 8
    ingest.load_new_batches(spark, landing, table, ckpt).awaitTermination()   # nothing new
    assert spark.read.parquet(table).count() == 8
    _batch(os.path.join(landing, "week3.csv"), 300, 4, week="07-01-2024")
    ingest.load_new_batches(spark, landing, table, ckpt).awaitTermination()
    df = spark.read.parquet(table)
    assert df.count() == 12 and set(df.columns) == {f.name for f in CC_SCHEMA.fields}
    assert {r.Use_Chip for r in df.collect()} == {"Swipe"}


def test_scored_stream_matches_batch_rules(spark):
    root = tempfile.mkdtemp(prefix="cardlens-stream-")
    landing, table, ckpt = (os.path.join(root, x) for x in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    _batch(os.path.join(landing, "week1.csv"), 100, 6)
    cust = spark.createDataFrame(
        [(100 + i, 45, "F", 1, None if i == 0 else "Graduate", "Married", "NY", "1", "yes", "yes", "no",
          "cellular", "Govt", 60000, 5) for i in range(6)],
        "Client_Num long, Customer_Age long, Gender string, Dependent_Count long, Education_Level string, "
        "Marital_Status string, state_cd string, Zipcode string, Car_Owner string, House_Owner string, "
        "Personal_loan string, contact string, Customer_Job string, Income long, Cust_Satisfaction_Score long")
    q = ingest.score_batches(spark, landing, cust, {"Education_Level": "Graduate"}, table, ckpt, os.path.join(root, "pending"))
    q.awaitTermination()
    out = ingest.scored_accounts(spark, table).orderBy("Client_Num").collect()
    assert len(out) == 6 and out[0].Education_Level == "Graduate"
    # income > 50000, balance < 1000, no delinquency, house, no loan, age > 40, satisfaction >= 4
    assert out[0].credit_score == 70 - 0 and out[0].credit_score_band == "Excellent"


def test_stream_scores_equal_batch_scores(spark):
    from cardlens.operators import cleanse, scoring
    from cardlens.sources import csv as csv_src
    root = tempfile.mkdtemp(prefix="cardlens-stream-")
    landing, table, ckpt = (os.path.join(root, x) for x in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    _batch(os.path.join(landing, "week1.csv"), 100, 7)
    _batch(os.path.join(landing, "week2.csv"), 200, 5, week="07-01-2024")
    cust = spark.createDataFrame(
        [(k, 30 + k % 30, "M", 0, "Graduate", "Single", "NY", "1", "no", "yes" if k % 2 else "no", "no",
          "cellular", "Govt", 20000 + 1000 * (k % 50), 1 + k % 5) for k in list(range(100, 107)) + list(range(200, 205))],
        "Client_Num long, Customer_Age long, Gender string, Dependent_Count long, Education_Level string, "
        "Marital_Status string, state_cd string, Zipcode string, Car_Owner string, House_Owner string, "
        "Personal_loan string, contact string, Customer_Job string, Income long, Cust_Satisfaction_Score long")
    ingest.score_batches(spark, landing, cust, {}, table, ckpt, os.path.join(root, "pending")).awaitTermination()
    streamed = ingest.scored_accounts(spark, table)
    batch_cc = cleanse.parse_dates(csv_src.read_cc_csv(spark, landing))
    batch = scoring.add_scores(cleanse.fill_numeric(scoring.join_profile(batch_cc, cust)))
    cols = ["Client_Num", "Week_Start_Date", "credit_score", "credit_score_band", "fraud_flag", "Trans_Avg"]
    assert sorted(streamed.select(*cols).collect()) == sorted(batch.select(*cols).collect())
    assert streamed.count() == 12


CUST_DDL = ("Client_Num long, Customer_Age long, Gender string, Dependent_Count long, Education_Level string, "
            "Marital_Status string, state_cd string, Zipcode string, Car_Owner string, House_Owner string, "
            "Personal_loan string, contact string, Customer_Job string, Income long, Cust_Satisfaction_Score long")


def _customers(spark, keys):
    return spark.createDataFrame([(k, 45, "F", 1, "Graduate", "Married", "NY", "1", "yes", "yes", "no",
                                   "cellular", "Govt", 60000, 5) for k in keys], CUST_DDL)


def test_late_customers_are_scored_once(spark):
    root = tempfile.mkdtemp(prefix="cardlens-stream-")
    landing, table, ckpt, pending = (os.path.join(root, x) for x in ("landing", "table", "ckpt", "pending"))
    os.makedirs(landing)
    known = {"keys": range(100, 103)}

    def run():
        ingest.score_batches(spark, landing, lambda: _customers(spark, known["keys"]), {}, table, ckpt, pending).awaitTermination()
        return sorted(r.Client_Num for r in ingest.scored_accounts(spark, table).collect())

    _batch(os.path.join(landing, "week1.csv"), 100, 6)
    assert run() == [100, 101, 102]  # 103-105 wait
    known["keys"] = range(100, 105)
    _batch(os.path.join(landing, "week2.csv"), 200, 2)
    assert run() == [100, 101, 102, 103, 104]  # 105, 200, 201 wait
    ingest.score_pending(spark, _customers(spark, [105, 200]), {}, table, pending)
    ingest.score_pending(spark, _customers(spark, [105, 200]), {}, table, pending)
    assert sorted(r.Client_Num for r in ingest.scored_accounts(spark, table).collect()) == [100, 101, 102, 103, 104, 105, 200]
    known["keys"] = range(100, 300)
    _batch(os.path.join(landing, "week3.csv"), 300, 1)
    assert run() == [100, 101, 102, 103, 104, 105, 200, 201]  # 300 waits


def test_replayed_batch_drops_what_pending_scored_since(spark):
    """The batch wrote its output but was not committed; its pending accounts were scored in between."""
    root = tempfile.mkdtemp(prefix="cardlens-stream-")
    landing, table, ckpt, pending = (os.path.join(root, x) for x in ("landing", "table", "ckpt", "pending"))
    os.makedirs(landing)
    known = {"keys": range(100, 102)}

    def run():
        ingest.score_batches(spark, landing, lambda: _customers(spark, known["keys"]), {}, table, ckpt, pending).awaitTermination()
        return sorted(r.Client_Num for r in ingest.scored_accounts(spark, table).collect())

    _batch(os.path.join(landing, "week1.csv"), 100, 5)
    assert run() == [100, 101]
    known["keys"] = range(100, 104)
    ingest.score_pending(spark, _customers(spark, known["keys"]), {}, table, pending)
    assert sorted(r.Client_Num for r in ingest.scored_accounts(spark, table).collect()) == [100, 101, 102, 103]
    for name in ("0", ".0.crc"):
        os.remove(os.path.join(ckpt, "commits", name))
    assert run() == [100, 101, 102, 103]  # each once
    ingest.score_pending(spark, _customers(spark, range(100, 105)), {}, table, pending)
    assert sorted(r.Client_Num for r in ingest.scored_accounts(spark, table).collect()) == [100, 101, 102, 103, 104]
