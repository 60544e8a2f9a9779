"""Shaping model outputs: class argmax and probability map (E7), fraud flag
and risk level (E8), request scoring with defaults (E9), probability rows
(E21).  Inputs are per-row probability arrays in a fixed class order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def argmax_label(probs: Column, labels: list[str]) -> Column:
    """Label of the largest probability; ties -> first in class order."""
    pos = F.array_position(probs, F.array_max(probs))
    return F.element_at(F.array(*[F.lit(x) for x in labels]), pos.cast("int"))


def band_output(df: DataFrame, probs: str, labels: list[str], model_type: str) -> DataFrame:
    """Predicted band, its probability, class -> p map, model type."""
    p = F.col(probs)
    return df.withColumns({
        "credit_score_band_pred": argmax_label(p, labels),
        "probability": F.array_max(p),
        "all_probabilities": F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), p),
        "model_type": F.lit(model_type),
    })


def fraud_output(df: DataFrame, p: str = "fraud_probability") -> DataFrame:
    """Flag (p > 0.5) and risk level (> 0.7 High, > 0.3 Medium, else Low)."""
    return df.withColumns({"fraud_prediction": rules.predicted_flag(F.col(p)),
                           "risk_level": rules.risk_level(F.col(p))})


def score_requests(requests: DataFrame, scored: DataFrame | None, key: str = "Client_Num",
                   model_ready: bool = True, model_type: str = "rule", missing: list[str] | None = None) -> DataFrame:
    """Every request gets an answer; unknown customers (or no model, or
    customer data that lack features the model needs) get error text, band
    'Unknown', probability 0 and an empty map.  ``model_type`` is answered in
    each case."""
    empty = F.create_map().cast("map<string,double>")
    if not model_ready or missing:
        error = "Model not ready" if not model_ready else f"Missing features: {missing}"
        return requests.select(key, F.lit(error).alias("error"), F.lit("Unknown").alias("credit_score_band"),
                               F.lit(0.0).alias("probability"), empty.alias("all_probabilities"),
                               F.lit(model_type).alias("model_type"))
    s = scored.select(key, "credit_score_band_pred", "probability", "all_probabilities")
    j = requests.select(key).join(s, key, "left")
    miss = F.col("credit_score_band_pred").isNull()
    return j.select(
        key,
        F.when(miss, F.lit("Customer not found")).alias("error"),
        F.when(miss, F.lit("Unknown")).otherwise(F.col("credit_score_band_pred")).alias("credit_score_band"),
        F.when(miss, F.lit(0.0)).otherwise(F.col("probability")).alias("probability"),
        F.when(miss, empty).otherwise(F.col("all_probabilities")).alias("all_probabilities"),
        F.lit(model_type).alias("model_type"))


def probability_rows(df: DataFrame, key: str, map_col: str = "all_probabilities") -> DataFrame:
    """One row per class with its probability."""
    return df.select(key, F.explode(F.col(map_col)).alias("class", "probability"))


def score_fraud_requests(requests: DataFrame, scored: DataFrame | None, key: str = "Client_Num",
                         model_ready: bool = True, model_type: str = "rule", missing: list[str] | None = None) -> DataFrame:
    """E9 for the fraud model: unknown customers (or no model, or missing
    features) get error text, flag 0, probability 0 and risk level 'Unknown'."""
    if not model_ready or missing:
        error = "Model not ready" if not model_ready else f"Missing features: {missing}"
        return requests.select(key, F.lit(error).alias("error"), F.lit(0).cast("long").alias("fraud_flag"),
                               F.lit(0.0).alias("fraud_probability"), F.lit("Unknown").alias("risk_level"),
                               F.lit(model_type).alias("model_type"))
    s = scored.select(key, F.col("fraud_prediction").alias("_flag"), F.col("fraud_probability").alias("_p"),
                      F.col("risk_level").alias("_risk"))
    j = requests.select(key).join(s, key, "left")
    miss = F.col("_p").isNull()
    return j.select(
        key,
        F.when(miss, F.lit("Customer not found")).alias("error"),
        F.when(miss, F.lit(0)).otherwise(F.col("_flag")).cast("long").alias("fraud_flag"),
        F.when(miss, F.lit(0.0)).otherwise(F.col("_p")).alias("fraud_probability"),
        F.when(miss, F.lit("Unknown")).otherwise(F.col("_risk")).alias("risk_level"),
        F.lit(model_type).alias("model_type"))
