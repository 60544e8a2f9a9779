"""Derived columns C1-C6 and the account-customer join D1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def join_profile(cc: DataFrame, cust: DataFrame) -> DataFrame:
    """Inner equi-join on Client_Num (many-to-many allowed).

    Left to the planner: a size-checked broadcast when the customer side is
    small, otherwise a sort-merge join whose skewed partitions AQE splits.
    """
    return cc.join(cust, "Client_Num", "inner")


def add_scores(df: DataFrame) -> DataFrame:
    """C1 score, C2 band, C3 fraud flag, C4-C6 ratios, in one projection
    (the band repeats the score expression; codegen evaluates it once)."""
    return df.withColumns({
        "credit_score": rules.credit_score(),
        "credit_score_band": rules.score_band(),
        "fraud_flag": rules.fraud_flag(),
        "Trans_Avg": rules.safe_ratio(F.col("Total_Trans_Amt"), F.col("Total_Trans_Ct")),
        "Income_to_Credit_Ratio": rules.safe_ratio(F.col("Income"), F.col("Credit_Limit")),
        "Revolving_to_Credit_Ratio": rules.safe_ratio(F.col("Total_Revolving_Bal"), F.col("Credit_Limit")),
    })
