"""Card recommendation: catalogue (F1), segment (F2), eligibility (F3),
match score (F4), top-n (F5), tiers (F10), custom profiles (C13, F11).

The catalogue is five fixed records.  Instead of joining customers to a
catalogue table, each card's score is a column expression with the card's
constants folded in; the five results form an array per customer that is
sorted and sliced in place.  No join, no shuffle, no window: a customer
key holding a third of all rows is just more rows in a narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

# The card catalogue, in catalogue order (position matters
# for ties).  Fields: name, annual_fee, rewards_rate, points_multiplier,
# intro_apr, foreign_transaction_fee, min_credit_score, min_income,
# benefits, ideal_for.
CATALOG = [
    ("Premium Rewards Card", 95, 0.02, 3, "0% for 12 months", 0.0, 720, 60000,
     ["Travel insurance", "Airport lounge access", "3x points on dining and travel",
      "No foreign transaction fees"],
     "High income customers who travel frequently"),
    ("Cash Back Plus", 0, 0.015, 2, "0% for 15 months", 0.03, 680, 40000,
     ["2x points on groceries and gas", "Cell phone protection", "Extended warranty"],
     "Everyday spenders looking for cash back on regular purchases"),
    ("Secured Builder Card", 0, 0.01, 1, "N/A", 0.03, 580, 25000,
     ["Credit building tools", "Free credit score monitoring", "Automatic credit line reviews"],
     "Customers looking to build or repair credit"),
    ("Balance Transfer Elite", 0, 0.01, 1, "0% for 18 months", 0.03, 690, 45000,
     ["No balance transfer fee for first 60 days", "Long 0% intro APR period", "Free credit score access"],
     "Customers with existing credit card debt looking to save on interest"),
    ("Business Rewards Card", 125, 0.018, 3, "0% for 9 months", 0.0, 700, 75000,
     ["3x points on business expenses", "Employee cards at no additional cost",
      "Detailed spending reports", "Travel and purchase protections"],
     "Small business owners and entrepreneurs"),
]
FIELDS = ["name", "annual_fee", "rewards_rate", "points_multiplier", "intro_apr",
          "foreign_transaction_fee", "min_credit_score", "min_income", "benefits", "ideal_for"]
# Profile defaults for missing fields and the custom-profile limit rule.
DEFAULT_INCOME, DEFAULT_SCORE = 0.0, 650.0
CUSTOM_LIMIT_SHARE, CUSTOM_LIMIT_CAP = 0.3, 30000.0


def card_catalog(spark: SparkSession) -> DataFrame:
    """the catalogue as a 5-row DataFrame with its position."""
    rows = [(i + 1, *card) for i, card in enumerate(CATALOG)]
    schema = ("catalog_pos int, name string, annual_fee int, rewards_rate double, points_multiplier int, "
              "intro_apr string, foreign_transaction_fee double, min_credit_score int, min_income int, "
              "benefits array<string>, ideal_for string")
    return spark.createDataFrame(rows, schema)


def _d(x) -> Column:
    return F.lit(float(x))


def profile_inputs(df: DataFrame, score_col: str = "credit_score") -> dict[str, Column]:
    """Customer attributes with the reference's defaults for missing values."""
    def get(c, default=0.0):
        return F.coalesce(F.col(c).cast("double"), _d(default)) if c in df.columns else _d(default)
    return {
        "income": get("Income", DEFAULT_INCOME),
        "score": get(score_col, DEFAULT_SCORE),
        "util": get("Avg_Utilization_Ratio"),
        "amt": get("Total_Trans_Amt"),
        "ct": get("Total_Trans_Ct"),
    }


def eligible(p: dict[str, Column], card) -> Column:
    """meets both the score and the income minimum."""
    return (p["score"] >= card[6]) & (p["income"] >= card[7])


def match_score(p: dict[str, Column], card) -> Column:
    """0..100 score of one card for one customer (constants folded in)."""
    name, fee, rewards, mult, _apr, _ftf, min_score, min_income = card[:8]
    s = F.when(eligible(p, card), _d(0)).otherwise(_d(-50))
    s = s + _d(20) * F.least(p["income"] / _d(min_income), _d(2.0))
    s = s + _d(20) * F.greatest(_d(0), F.least((p["score"] - _d(min_score)) / _d(150), _d(1.0)))
    if "Balance Transfer" in name:
        s = s + F.when(p["util"] > 0.5, _d(30)).otherwise(_d(0))
    if rewards > 0.015:
        s = s + F.when(p["ct"] > 50, _d(25)).otherwise(_d(0))
    if mult > 1:
        s = s + F.when(p["amt"] > 5000, _d(20)).otherwise(_d(0))
    if fee > 0:
        s = s - _d(min(20.0, fee / 10))
    return F.least(_d(100), F.greatest(_d(0), s))


def _card_struct(p, pos: int, card, score: Column) -> Column:
    return F.struct(
        (-F.round(score, 9)).alias("neg_score"),
        F.lit(pos).alias("catalog_pos"),
        F.lit(card[0]).alias("card_name"),
        score.alias("match_score"),
        eligible(p, card).cast("long").alias("eligible"),
        F.lit(card[1]).cast("long").alias("annual_fee"),
        F.lit(card[2]).alias("rewards_rate"),
        F.lit(card[4]).alias("intro_apr"),
        F.array(*[F.lit(b) for b in card[8]]).alias("benefits"),
    )


SCORE_COLS = [f"_card_score_{i + 1}" for i in range(len(CATALOG))]


def with_card_scores(df: DataFrame, score_col: str = "credit_score") -> DataFrame:
    """The five match scores as columns (each evaluated once per row)."""
    p = profile_inputs(df, score_col)
    return df.withColumns({c: match_score(p, card) for c, card in zip(SCORE_COLS, CATALOG)})


def card_array(df: DataFrame, score_col: str = "credit_score") -> Column:
    """Per-row array of card structs; ``df`` must come from ``with_card_scores``."""
    p = profile_inputs(df, score_col)
    return F.array(*[_card_struct(p, i + 1, card, F.col(c))
                     for i, (c, card) in enumerate(zip(SCORE_COLS, CATALOG))])


def card_match_scores(df: DataFrame, key: str = "Client_Num", score_col: str = "credit_score") -> DataFrame:
    """one row per customer x card with eligibility and score."""
    df = with_card_scores(df, score_col)
    return (df.select(key, F.inline(card_array(df, score_col)))
            .select(key, F.col("catalog_pos").cast("long").alias("catalog_pos"), "card_name",
                    "eligible", "match_score"))


def recommend_cards(df: DataFrame, top_n: int = 3, key: str = "Client_Num",
                    score_col: str = "credit_score", keep: tuple = ()) -> DataFrame:
    """top-n cards per customer, score descending, ties in catalogue order.
    ``keep`` columns are carried through unchanged."""
    df = with_card_scores(df, score_col)
    ranked = F.slice(F.sort_array(card_array(df, score_col)), 1, top_n)
    return (df.select(key, *keep, F.posexplode(ranked).alias("pos0", "c"))
            .select(key, *keep, (F.col("pos0") + 1).cast("long").alias("rec_rank"),
                    F.col("c.card_name").alias("card_name"), F.col("c.match_score").alias("match_score"),
                    F.col("c.catalog_pos").cast("long").alias("catalog_pos"),
                    F.col("c.annual_fee").alias("annual_fee"), F.col("c.rewards_rate").alias("rewards_rate"),
                    F.col("c.intro_apr").alias("intro_apr"), F.col("c.benefits").alias("benefits")))


def with_segment(df: DataFrame, score_col: str = "credit_score") -> DataFrame:
    """premium / standard / starter."""
    score = F.col(score_col) if score_col in df.columns else F.lit(None)
    income = F.col("Income") if "Income" in df.columns else F.lit(None)
    return df.withColumn("segment", rules.user_segment(income, score))


def with_bureau_score(df: DataFrame, score_col: str = "credit_score", out: str = "bureau_score") -> DataFrame:
    """Option: express the 0..70 portfolio score on the 300..850 scale."""
    return df.withColumn(out, rules.bureau_scale(F.col(score_col)))


def custom_profiles(df: DataFrame) -> DataFrame:
    """Applicant profiles -> estimated limit = min(0.3 income, 30000),
    utilisation = balance / limit (0 when the limit is 0).  Input columns:
    Customer_Age, Income, credit_score (300..850), Total_Revolving_Bal,
    Total_Trans_Amt, Total_Trans_Ct."""
    limit = F.least(F.col("Income").cast("double") * _d(CUSTOM_LIMIT_SHARE), _d(CUSTOM_LIMIT_CAP))
    return (df.withColumn("Credit_Limit", limit)
            .withColumn("Avg_Utilization_Ratio",
                        F.when(F.col("Credit_Limit") > 0,
                               F.col("Total_Revolving_Bal").cast("double") / F.col("Credit_Limit"))
                        .otherwise(_d(0))))


def with_match_tier(df: DataFrame, col: str = "match_score") -> DataFrame:
    """F10."""
    return df.withColumn("match_tier", rules.match_tier(F.col(col)))
