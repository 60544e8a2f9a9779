"""Scoring and labelling rules as Spark column expressions.

Fixed values below (thresholds, points, bin edges, labels) must equal the
reference application's rules for the results to agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: credit score rules (column, predicate, points) -------
# Income > 50000 -> 10; Total_Revolving_Bal < 1000 -> 10;
# Avg_Utilization_Ratio < 0.3 -> 10; Delinquent_Acc = 0 -> 20;
# House_Owner = 'yes' -> 5; Personal_loan = 'no' -> 5;
# Customer_Age > 40 -> 5; Cust_Satisfaction_Score >= 4 -> 5.
# ---- fixed values: score bands, right-closed ----------------------------
# (0,20] Poor, (20,40] Fair, (40,60] Good, (60,70] Excellent; else Fair.
BANDS = ["Poor", "Fair", "Good", "Excellent"]
BAND_EDGES = [0, 20, 40, 60, 70]
BAND_DEFAULT = "Fair"
# ---- fixed values: age groups, right-closed -----------------------------
# (0,30] <30, (30,40] 30-40, (40,50] 40-50, (50,60] 50-60, (60,100] 60+.
AGE_GROUPS = ["<30", "30-40", "40-50", "50-60", "60+"]
AGE_EDGES = [0, 30, 40, 50, 60, 100]
# ---- fixed values: fraud labels, risk levels, match tiers ---------------
FRAUD_LABELS = {0: "Legitimate", 1: "Fraudulent"}
RISK_HIGH, RISK_MEDIUM = 0.7, 0.3
FRAUD_THRESHOLD = 0.5
TIER_EXCELLENT, TIER_GOOD = 80, 60
# ---- fixed values: customer segments ------------------------------------
# premium: income >= 75000 and score >= 720; standard: >= 45000 and >= 680.
SEGMENT_DEFAULT_INCOME, SEGMENT_DEFAULT_SCORE = 0, 650


CREDIT_RULES = [
    ("Income > 50000", 10),
    ("Total_Revolving_Bal < 1000", 10),
    ("Avg_Utilization_Ratio < 0.3D", 10),
    ("Delinquent_Acc = 0", 20),
    ("House_Owner = 'yes'", 5),
    ("Personal_loan = 'no'", 5),
    ("Customer_Age > 40", 5),
    ("Cust_Satisfaction_Score >= 4", 5),
]


def credit_score_sql() -> str:
    # a null comparison adds nothing, as a boolean mask would
    return "CAST(" + " + ".join(f"(CASE WHEN {p} THEN {k} ELSE 0 END)" for p, k in CREDIT_RULES) + " AS BIGINT)"


def credit_score() -> Column:
    """Additive score, 0..70 (one SQL expression)."""
    return F.expr(credit_score_sql())


def bins_sql(x: str, edges: list, labels: list[str], default: str | None) -> str:
    """pd.cut semantics as SQL: (e0,e1] -> labels[0] ...; outside -> default."""
    arms = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{lab}'"
                    for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {arms} ELSE " + (f"'{default}'" if default is not None else "CAST(NULL AS STRING)") + " END"


def score_band(score: str | None = None) -> Column:
    """Right-closed bands of a score column (SQL); a score in no bin (0) is
    Fair.  Without an argument the score comes from its rules directly."""
    return F.expr(bins_sql(score or "(" + credit_score_sql() + ")", BAND_EDGES, BANDS, BAND_DEFAULT))


FRAUD_RULES = [
    "(Total_Trans_Amt > 10000 AND Total_Trans_Ct < 20)",
    "Avg_Utilization_Ratio > 0.9D",
    "Total_Trans_Amt > Income * 3",
]


def fraud_flag() -> Column:
    """OR of the three suspicious-pattern rules."""
    return F.expr("CAST(CASE WHEN " + " OR ".join(FRAUD_RULES) + " THEN 1 ELSE 0 END AS BIGINT)")


def safe_ratio(num: Column, den: Column) -> Column:
    """Num / den with a zero denominator replaced by 1."""
    return num.cast("double") / F.when(den == 0, F.lit(1)).otherwise(den).cast("double")


def age_group(age: str) -> Column:
    """Right-closed age bins of an age column (SQL), null outside (0,100]."""
    return F.expr(bins_sql(age, AGE_EDGES, AGE_GROUPS, None))


def fraud_label(flag: Column) -> Column:
    """0 -> Legitimate, 1 -> Fraudulent."""
    return F.when(flag == 0, FRAUD_LABELS[0]).when(flag == 1, FRAUD_LABELS[1])


def risk_level(p: Column) -> Column:
    """> 0.7 High, > 0.3 Medium, else Low."""
    return F.when(p > RISK_HIGH, "High").when(p > RISK_MEDIUM, "Medium").otherwise("Low")


def predicted_flag(p: Column) -> Column:
    """Fraud when p > 0.5."""
    return F.when(p > FRAUD_THRESHOLD, F.lit(1)).otherwise(F.lit(0)).cast("long")


def match_tier(score: Column) -> Column:
    """>= 80 excellent, >= 60 good, else fair."""
    return (F.when(score >= TIER_EXCELLENT, "Excellent match")
            .when(score >= TIER_GOOD, "Good match").otherwise("Fair match"))


def bureau_scale(score: Column) -> Column:
    """Map the 0..70 portfolio score onto the 300..850 range the card rules expect."""
    return F.lit(300.0) + score.cast("double") * F.lit(550.0) / F.lit(70.0)


def user_segment(income: Column, score: Column) -> Column:
    """F2: premium / standard / starter; missing income 0, missing score 650."""
    inc = F.coalesce(income.cast("double"), F.lit(float(SEGMENT_DEFAULT_INCOME)))
    sc = F.coalesce(score.cast("double"), F.lit(float(SEGMENT_DEFAULT_SCORE)))
    return (F.when((inc >= 75000) & (sc >= 720), "premium")
            .when((inc >= 45000) & (sc >= 680), "standard").otherwise("starter"))
