"""Deterministic scorers used to exercise the metric operators.

Trained models are random; to check the metric operators value-for-value
against SQL, the registered metric queries evaluate two rule-based
scorers over the held-out split of the portfolio:

* bands: probabilities from the distance of a perturbed score to four
  band centres (w_c = 100 - |s' - centre_c|, normalised), argmax = band;
* fraud: score = (utilisation + hash-derived jitter) / 2.

The same metric operators evaluate the MLlib models in models.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, rules
from ..operators import predictions

# Band centres of the rule-based band scorer.
BAND_CENTRES = [10, 30, 50, 65]


def band_probabilities(df: DataFrame) -> DataFrame:
    s = F.col("credit_score") + (F.col("Txn_Id") * 7) % 11 - 5
    ws = [F.lit(100) - F.abs(s - F.lit(c)) for c in BAND_CENTRES]
    tot = ws[0] + ws[1] + ws[2] + ws[3]
    return df.withColumn("band_probs", F.array(*[w.cast("double") / tot.cast("double") for w in ws]))


def band_predictions(df: DataFrame) -> DataFrame:
    return predictions.band_output(band_probabilities(df), "band_probs", rules.BANDS, "rule")


def fraud_scores(df: DataFrame) -> DataFrame:
    jitter = ((F.col("Txn_Id") * 13) % 100).cast("double") / F.lit(100.0)
    return df.withColumn("fraud_probability", (F.col("Avg_Utilization_Ratio") + jitter) / F.lit(2.0))


def test_rows(df: DataFrame) -> DataFrame:
    return df.where(hashing.split_label(F.col("Txn_Id")) == "test")


def train_rows(df: DataFrame) -> DataFrame:
    return df.where(hashing.split_label(F.col("Txn_Id")) == "train")


def labelled(df: DataFrame) -> DataFrame:
    """(task, label, prediction) over the test rows, both tasks in one pass."""
    scored = predictions.fraud_output(fraud_scores(band_predictions(test_rows(df))))
    return scored.select(F.inline(F.array(
        F.struct(F.lit("credit").alias("task"), F.col("credit_score_band").alias("label"),
                 F.col("credit_score_band_pred").alias("prediction")),
        F.struct(F.lit("fraud").alias("task"), F.col("fraud_flag").cast("string").alias("label"),
                 F.col("fraud_prediction").cast("string").alias("prediction")))))
