"""Golden adapter numbers from FIXTURES.md section 5 (sf0.001)."""

from pyspark.sql import functions as F

from cardlens.plans.portfolio import portfolio
from conftest import SF0001


def test_adapter_goldens_sf0001(spark):
    p = portfolio(spark, SF0001)
    r = p.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("Client_Num").alias("clients"),
        F.sum("fraud_flag").alias("fraud"),
        F.sum(F.when((F.col("Total_Trans_Amt") > 10000) & (F.col("Total_Trans_Ct") < 20), 1).otherwise(0)).alias("r1"),
        F.sum(F.when(F.col("Avg_Utilization_Ratio") > 0.9, 1).otherwise(0)).alias("r2"),
        F.sum(F.when(F.col("Total_Trans_Amt") > F.col("Income") * 3, 1).otherwise(0)).alias("r3"),
        F.sum("Total_Trans_Ct").alias("ct"), F.sum("Total_Trans_Amt").alias("amt"),
        F.sum(F.when(F.col("Total_Trans_Ct") == 0, 1).otherwise(0)).alias("zero_ct"),
        F.sum(F.when(F.col("Credit_Limit") == 0, 1).otherwise(0)).alias("zero_lim"),
        F.countDistinct("Week_Start_Date").alias("weeks"),
        F.min("credit_score").alias("smin"), F.max("credit_score").alias("smax"),
    ).first()
    assert (r.rows, r.clients, r.fraud) == (1500, 150, 245)
    assert (r.r1, r.r2, r.r3) == (67, 146, 48)
    assert (r.ct, r.amt) == (152257, 37443952)
    assert (r.zero_ct, r.zero_lim, r.weeks) == (27, 16, 343)
    assert (r.smin, r.smax) == (0, 70)
    bands = {x.credit_score_band: x["count"] for x in p.groupBy("credit_score_band").count().collect()}
    assert bands == {"Poor": 52, "Fair": 603, "Good": 782, "Excellent": 63}
