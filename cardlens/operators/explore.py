"""Relational and exploration queries D2-D17 over the scored portfolio.

Scale notes
* Per-client "first row" is a grouped min over a struct: partial
  aggregation runs before the shuffle, so a client holding a third of all
  rows sends one row per task.
* Per-client top-n uses ``row_number() <= n``; Spark plans a partial
  WindowGroupLimit before the shuffle, so a hot client ships at most n rows
  per map task.
* Global statistics are single-stage aggregates with map-side partials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, rules


def _domain(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    """A fixed, ordered category domain (a handful of literal rows)."""
    return spark.createDataFrame([(v, i + 1) for i, v in enumerate(values)],
                                 f"{name} string, {name}_order int")


def r6(c):
    return F.round(c, 6)


PROFILE_COLS = ["Txn_Id", "Customer_Age", "Income", "Credit_Limit", "Total_Revolving_Bal",
                "Total_Trans_Amt", "Total_Trans_Ct", "Avg_Utilization_Ratio", "credit_score",
                "credit_score_band", "fraud_flag"]


def first_rows(df: DataFrame, key: str = "Client_Num", order: str = "Txn_Id",
               cols: list[str] | None = None) -> DataFrame:
    """First row per key by an explicit order column (the reference's iloc[0])."""
    cols = [c for c in (cols or df.columns) if c not in (key,)]
    rest = [c for c in cols if c != order]
    agg = df.groupBy(key).agg(F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_f"))
    return agg.select(key, *[F.col("_f")[c].alias(c) for c in [order] + rest])


def customer_profile(requests: DataFrame, df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """First portfolio row for each requested Client_Num; absent -> nulls, found=0."""
    firsts = first_rows(df, cols=cols or PROFILE_COLS)
    return (requests.select("Client_Num").join(firsts, "Client_Num", "left")
            .withColumn("found", F.when(F.col("Txn_Id").isNull(), 0).otherwise(1).cast("long")))


def key_status(requests: DataFrame, df: DataFrame, key: str = "Client_Num") -> DataFrame:
    """D3: existence test per requested key: one left join to the distinct
    keys (partial aggregate before the shuffle, so a key holding a third of the
    rows ships one row per task).  A null key is missing."""
    keys = df.select(key).distinct().withColumn("_there", F.lit(True))
    return requests.select(key).join(keys, key, "left").select(
        key, F.when(F.col("_there"), "found").otherwise("missing").alias("status"))


def recent_transactions(df: DataFrame, n: int = 10) -> DataFrame:
    """N most recent rows per client, date descending with null dates
    last, ties by row key; projected to the columns the view shows."""
    w = Window.partitionBy("Client_Num").orderBy(F.col("Week_Start_Date").desc_nulls_last(),
                                                 F.col("Txn_Id").asc())
    return (df.select("Client_Num", "Txn_Id", "Week_Start_Date", "Total_Trans_Amt", "Total_Trans_Ct", "Exp_Type")
            .withColumn("recent_rank", F.row_number().over(w))
            .where(F.col("recent_rank") <= n)
            .withColumn("recent_rank", F.col("recent_rank").cast("long")))


def aggregate_stats(df: DataFrame) -> DataFrame:
    """Portfolio statistics in one aggregate (band counts are D6)."""
    return df.agg(
        F.countDistinct("Client_Num").alias("total_customers"),
        F.sum("Total_Trans_Ct").cast("long").alias("total_transactions"),
        F.sum("Total_Trans_Amt").cast("long").alias("total_transaction_amount"),
        r6(F.avg("Credit_Limit")).alias("avg_credit_limit"),
        r6(F.avg("Avg_Utilization_Ratio")).alias("avg_utilization"),
        r6(F.avg("fraud_flag") * 100).alias("fraud_rate"),
    )


def band_distribution(df: DataFrame) -> DataFrame:
    """Count per credit band, all four bands kept (zeros included)."""
    spark = df.sparkSession
    counts = df.groupBy("credit_score_band").agg(F.count(F.lit(1)).alias("n_rows"))
    dom = _domain(spark, "credit_score_band", rules.BANDS)
    # counts has at most one row per band (a fixed domain): broadcast it
    return (dom.join(F.broadcast(counts), "credit_score_band", "left")
            .select("credit_score_band", F.col("credit_score_band_order").cast("long").alias("band_order"),
                    F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows")))


def fraud_distribution(df: DataFrame) -> DataFrame:
    """Count per fraud flag with its label."""
    return (df.groupBy("fraud_flag").agg(F.count(F.lit(1)).alias("n_rows"))
            .select("fraud_flag", rules.fraud_label(F.col("fraud_flag")).alias("fraud_label"), "n_rows"))


def overview_metrics(df: DataFrame) -> DataFrame:
    """Record count, distinct clients and six means."""
    return df.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct("Client_Num").alias("n_customers"),
        r6(F.avg("Credit_Limit")).alias("avg_credit_limit"),
        r6(F.avg("Total_Revolving_Bal")).alias("avg_revolving_bal"),
        r6(F.avg("Total_Trans_Amt")).alias("avg_trans_amt"),
        r6(F.avg("Total_Trans_Ct")).alias("avg_trans_ct"),
        r6(F.avg("Avg_Utilization_Ratio")).alias("avg_utilization"),
        r6(F.avg("fraud_flag")).alias("fraud_rate"),
    )


PREVIEW_COLS = ["Txn_Id", "Client_Num", "Card_Category", "Week_Start_Date", "Credit_Limit",
                "Total_Trans_Amt", "credit_score", "credit_score_band", "fraud_flag"]


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First n rows by key (a top-k, not a full sort)."""
    return df.select(*PREVIEW_COLS).orderBy("Txn_Id").limit(n)


def customer_search(df: DataFrame, age=(30, 60), income=(20000, 100000),
                    gender: str = "All", band: str = "All") -> DataFrame:
    """Inclusive ranges; gender / band predicates only when not 'All'."""
    out = df.where(F.col("Customer_Age").between(*age) & F.col("Income").between(*income))
    if gender != "All":
        out = out.where(F.col("Gender") == gender)
    if band != "All":
        out = out.where(F.col("credit_score_band").isNotNull() & (F.col("credit_score_band") == band))
    return out


SEARCH_COLS = ["Txn_Id", "Client_Num", "Customer_Age", "Gender", "Income", "Credit_Limit",
               "credit_score_band", "fraud_flag"]


def search_results(df: DataFrame, **filters) -> DataFrame:
    """The displayed projection of a search."""
    return customer_search(df, **filters).select(*SEARCH_COLS)


def search_aggregates(df: DataFrame, **filters) -> DataFrame:
    """Count and means over the searched rows."""
    return customer_search(df, **filters).agg(
        F.count(F.lit(1)).alias("n_records"),
        r6(F.avg("Customer_Age")).alias("avg_age"),
        r6(F.avg("Income")).alias("avg_income"),
        r6(F.avg("Credit_Limit")).alias("avg_credit_limit"),
        r6(F.avg("Total_Revolving_Bal")).alias("avg_revolving_bal"),
        r6(F.avg("fraud_flag")).alias("fraud_rate"),
        r6(F.avg("Cust_Satisfaction_Score")).alias("avg_satisfaction"),
    )


def weekly_trends(df: DataFrame) -> DataFrame:
    """Weekly means of amount, count and fraud percentage; null weeks dropped."""
    return (df.where(F.col("Week_Start_Date").isNotNull())
            .groupBy("Week_Start_Date")
            .agg(r6(F.avg("Total_Trans_Amt")).alias("avg_trans_amt"),
                 r6(F.avg("Total_Trans_Ct")).alias("avg_trans_ct"),
                 r6(F.avg("fraud_flag") * 100).alias("fraud_percentage")))


def with_age_group(df: DataFrame) -> DataFrame:
    """Right-closed age bins."""
    return df.withColumn("Age_Group", rules.age_group("Customer_Age"))


def age_band_counts(df: DataFrame) -> DataFrame:
    """Dense age-group x band grid (zeros kept, null age groups dropped)."""
    spark = df.sparkSession
    grid = spark.createDataFrame(
        [(a, i + 1, b, j + 1) for i, a in enumerate(rules.AGE_GROUPS) for j, b in enumerate(rules.BANDS)],
        "Age_Group string, age_order int, credit_score_band string, band_order int")
    counts = (with_age_group(df).where(F.col("Age_Group").isNotNull())
              .groupBy("Age_Group", "credit_score_band").agg(F.count(F.lit(1)).alias("n_rows")))
    return (grid.join(F.broadcast(counts), ["Age_Group", "credit_score_band"], "left")
            .select("Age_Group", F.col("age_order").cast("long").alias("age_order"),
                    "credit_score_band", F.col("band_order").cast("long").alias("band_order"),
                    F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows")))


def bounded_sample(df: DataFrame, n: int = 1000) -> DataFrame:
    """All rows when there are at most n, else n rows chosen by a
    stable key hash (top-k by hash: each task keeps n rows, no full sort)."""
    return (df.withColumn("sample_hash", hashing.sample_hash(F.col("Txn_Id")))
            .orderBy("sample_hash", "Txn_Id").limit(n))


def income_limit_points(df: DataFrame, n: int = 1000) -> DataFrame:
    """Scatter input over the bounded sample."""
    return bounded_sample(df, n).select("Txn_Id", "Income", "Credit_Limit", "credit_score_band")
