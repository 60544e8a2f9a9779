"""Physical-plan properties that matter at scale, and a one-third hot key."""

from pyspark.sql import functions as F

from cardlens.operators import explore, recommend, similar
from conftest import SF0001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _hot_portfolio(spark, n=3000):
    """A third of all rows belong to client 7."""
    return (spark.range(n).select(
        F.col("id").alias("Txn_Id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 97 + 100).alias("Client_Num"),
        F.date_add(F.lit("2020-01-06").cast("date"), (F.col("id") * 7 % 400).cast("int")).alias("Week_Start_Date"),
        (F.col("id") % 50).alias("Total_Trans_Amt"), (F.col("id") % 9).alias("Total_Trans_Ct"),
        F.lit("Bills").alias("Exp_Type")))


def test_recent_transactions_limits_before_the_shuffle(spark):
    df = explore.recent_transactions(_hot_portfolio(spark), 10)
    plan = _plan(df)
    assert plan.count("WindowGroupLimit") >= 2  # partial (before the exchange) and final
    rows = df.where("Client_Num = 7").orderBy("recent_rank").collect()
    hot = _hot_portfolio(spark).where("Client_Num = 7").orderBy(F.desc("Week_Start_Date"), "Txn_Id").limit(10)
    assert [r.Txn_Id for r in rows] == [r.Txn_Id for r in hot.collect()]


def test_first_row_per_client_aggregates_partially(spark):
    df = explore.first_rows(_hot_portfolio(spark), cols=["Txn_Id", "Total_Trans_Amt"])
    assert "partial_min" in _plan(df)
    assert df.where("Client_Num = 7").first().Txn_Id == 0


def test_card_ranking_needs_no_join_or_shuffle(spark):
    prof = spark.createDataFrame([(1, 60000, 30.0, 0.2, 3000, 40)],
                                 "Client_Num long, Income long, credit_score double, Avg_Utilization_Ratio double, "
                                 "Total_Trans_Amt long, Total_Trans_Ct long")
    plan = _plan(recommend.recommend_cards(prof, 3))
    assert "Join" not in plan and "Exchange" not in plan


def test_similarity_emits_no_pairs(spark):
    from cardlens.plans.portfolio import portfolio
    from cardlens.plans.registry import client_profiles
    p = portfolio(spark, SF0001)
    plan = _plan(similar.similar_customers(p, client_profiles(spark, SF0001, p), 5))
    assert "row_number" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
