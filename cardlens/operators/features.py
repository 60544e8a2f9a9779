"""Feature engineering: one-hot (C7), feature list (C8), null fill (C9),
standardisation (C10), class weights (E6).  SMOTE (C11) is in smote.py and
the split (C12) is a key hash in functions/hashing.py.

Fitted statistics (category levels, means, standard deviations, class
counts) are a few values per column; they are computed by one distributed
aggregate and held as literals, like a fitted model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categorical columns one-hot encoded, and the numeric
# feature list, in the reference's order.
CATEGORICALS = ["Card_Category", "Use_Chip", "Exp_Type", "Gender", "Education_Level",
                "Marital_Status", "Customer_Job"]
NUMERIC_FEATURES = ["Customer_Age", "Dependent_Count", "Income", "Credit_Limit", "Total_Revolving_Bal",
                    "Total_Trans_Amt", "Total_Trans_Ct", "Avg_Utilization_Ratio", "Trans_Avg",
                    "Income_to_Credit_Ratio", "Revolving_to_Credit_Ratio"]
# The recommender's seven similarity features.
RECOMMENDER_FEATURES = ["Customer_Age", "Income", "Credit_Limit", "Total_Revolving_Bal", "Total_Trans_Amt",
                        "Total_Trans_Ct", "Avg_Utilization_Ratio"]


def category_levels(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column, from one distinct job.  They
    become the names of result columns, so the driver holds them by contract;
    for columns with very many values use the vector form."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return {}
    pairs = (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in cols])).alias("p"))
        .select("p.col", "p.val").where(F.col("val").isNotNull()).distinct())
    levels: dict[str, list[str]] = {c: [] for c in cols}
    for r in pairs.collect():
        levels[r["col"]].append(r["val"])
    return {c: sorted(v) for c, v in levels.items()}


def dummy_name(col: str, level: str) -> str:
    return f"{col}_{level}"


def one_hot(df: DataFrame, cols: list[str] = CATEGORICALS, drop_first: bool = True,
            levels: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """Named 0/1 columns ``<col>_<level>``; the alphabetically first
    level is dropped.  Returns the frame and the new column names."""
    levels = levels or category_levels(df, cols)
    new_cols, exprs = [], []
    for c in cols:
        if c not in levels:
            continue
        for lev in levels[c][1:] if drop_first else levels[c]:
            name = dummy_name(c, lev)
            new_cols.append(name)
            exprs.append(F.when(F.col(c) == lev, F.lit(1)).otherwise(F.lit(0)).cast("long").alias(name))
    return df.select("*", *exprs), new_cols


def one_hot_vector_stages(cols: list[str] = CATEGORICALS, out_suffix: str = "_vec") -> list:
    """C7, vector form for ML pipelines: indices in descending alphabetical
    order and the last index dropped, i.e. the alphabetically first level is
    the all-zero reference, as in the named form.  Unseen levels raise (a
    "keep" slot would be the one dropped instead)."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    idx = StringIndexer(inputCols=cols, outputCols=[c + "_idx" for c in cols],
                        stringOrderType="alphabetDesc", handleInvalid="error")
    enc = OneHotEncoder(inputCols=[c + "_idx" for c in cols], outputCols=[c + out_suffix for c in cols],
                        dropLast=True, handleInvalid="error")
    return [idx, enc]


def feature_columns(df: DataFrame, numeric: list[str] = NUMERIC_FEATURES,
                    categoricals: list[str] = CATEGORICALS) -> list[str]:
    """Numerics, then every derived column whose name contains a
    categorical's name (the dummies)."""
    out = list(numeric)
    for c in df.columns:
        if c not in categoricals and c not in out and any(cat in c for cat in categoricals):
            out.append(c)
    return out


def fill_features(df: DataFrame, features: list[str], label: str | None = None,
                  label_default=None) -> DataFrame:
    """Remaining nulls in features -> 0, label -> its default."""
    out = df.fillna(0, subset=features)
    if label is not None and label_default is not None:
        out = out.fillna({label: label_default})
    return out


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """C10 fit: mean and population std of each column, one aggregate."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    r = df.agg(*aggs).collect()[0]
    return {c: (r[f"m_{c}"] or 0.0, r[f"s_{c}"] or 0.0) for c in cols}


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """C10 apply: z = (x - mean) / std, with std 0 -> 1."""
    return df.withColumns({
        c + suffix: (F.col(c).cast("double") - F.lit(m)) / F.lit(s if s != 0 else 1.0)
        for c, (m, s) in stats.items()
    })


def standardize(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fit on all rows by default (the reference's order), or on ``fit_on``."""
    return apply_scaler(df, fit_scaler(fit_on if fit_on is not None else df, cols))


def binary_counts(df: DataFrame, label: str) -> tuple[int, int]:
    """Rows with label 0 and with label 1, by one conditional aggregate."""
    r = df.agg(*[F.count(F.when(F.col(label) == v, 1)).alias(f"n{v}") for v in (0, 1)]).first()
    return r["n0"], r["n1"]


def class_weights(df: DataFrame, label: str = "fraud_flag") -> DataFrame:
    """Balanced weight n / (k * n_c) per class and scale_pos_weight n0 / n1.
    The per-class counts are written once; the totals and the result read them."""
    from ..sources.tables import materialize
    counts = materialize(df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows")))
    totals = counts.agg(F.sum("n_rows").alias("n"), F.count(F.lit(1)).alias("k"),
                        F.sum(F.when(F.col(label) == 0, F.col("n_rows"))).alias("n0"),
                        F.sum(F.when(F.col(label) == 1, F.col("n_rows"))).alias("n1")).first()
    spw = (totals["n0"] or 0) / totals["n1"] if totals["n1"] else None
    return counts.select(
        F.col(label).alias("label"), "n_rows",
        (F.lit(float(totals["n"] or 0)) / (F.lit(float(totals["k"])) * F.col("n_rows").cast("double"))).alias("class_weight"),
        F.lit(spw).cast("double").alias("scale_pos_weight"))


def balanced_weight(n0: int, n1: int, label: str) -> Column:
    """E6 as a column for weightCol: n / (k * n_c) of the row's class, k the
    classes that occur."""
    k = (n0 > 0) + (n1 > 0)
    return F.when(F.col(label) == 1, F.lit((n0 + n1) / (k * n1) if n1 else 1.0)).otherwise(
        F.lit((n0 + n1) / (k * n0) if n0 else 1.0))


def positive_weight(n0: int, n1: int, label: str) -> Column:
    """E6 scale_pos_weight as a column: n0 / n1 for positives, 1 for the rest."""
    return F.when(F.col(label) == 1, F.lit(n0 / n1 if n1 else 1.0)).otherwise(F.lit(1.0))
