"""Training frames and fitted models, in the reference's order:
features -> one-hot -> standardise (fit on all rows) -> [SMOTE] -> split.

The standardised frame is written once (under the shared
``spark.checkpoint.dir``) because every fit makes several passes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import boosting, features, metrics, models, smote
from ..operators.model_store import ModelStore
from ..functions import rules
from ..session import ensure_checkpoint_dir
from ..sources import tables
from .portfolio import materialized, portfolio_table


MODEL_INPUT_COLS = ["Txn_Id", "credit_score_band", "fraud_flag", *features.NUMERIC_FEATURES,
                    *features.CATEGORICALS]


def filled_frame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], dict]:
    """(rows, features, category levels) before standardisation, from the written portfolio."""
    table = portfolio_table(spark, sf_dir, MODEL_INPUT_COLS)
    tables.require_rows(table, "portfolio")
    levels = features.category_levels(table, features.CATEGORICALS)
    df, _ = features.one_hot(table, levels=levels)
    cols = features.feature_columns(df)
    df = features.fill_features(df.select("Txn_Id", "credit_score_band", "fraud_flag", *cols), cols,
                                "credit_score_band", "Fair")
    return df, cols, levels


def model_frame(spark: SparkSession, sf_dir: str, fit_on: str = "all", filled=None) -> tuple[DataFrame, list[str], dict, dict]:
    """(rows, features, scaler, category levels).  ``fit_on='all'`` fits the scaler on every row before the split (the
    reference's order); ``'train'`` fits it on the training rows only.  ``filled`` is a ``filled_frame`` of these tables."""
    df, cols, levels = filled or filled_frame(spark, sf_dir)
    if fit_on not in ("all", "train"):
        raise ValueError(fit_on)
    fit_rows = df if fit_on == "all" else df.where(hashing.split_label(F.col("Txn_Id")) == "train")
    stats = features.fit_scaler(fit_rows, cols)
    z = features.apply_scaler(df, stats)
    return materialized(z), cols, stats, levels


def split(df: DataFrame, key_col: str = "row_key") -> tuple[DataFrame, DataFrame]:
    lab = hashing.split_label(F.col(key_col))
    return df.where(lab == "train"), df.where(lab == "test")


def credit_sets(spark, sf_dir, fit_on: str = "all", filled=None):
    """(train, test, features, scaler, levels)."""
    z, cols, stats, levels = model_frame(spark, sf_dir, fit_on, filled)
    z = z.withColumn("row_key", F.col("Txn_Id"))
    tr, te = split(z)
    return tr, te, cols, stats, levels


def fraud_sets(spark, sf_dir, oversample: str = "all", filled=None):
    """(train, test, features, scaler, levels).  ``oversample='all'`` (the
    reference's order): SMOTE before the split, so synthetic rows also reach
    the test set; they get the negative keys -(synth_index + 1) for the split
    hash.  ``'train_only'``: split the real rows first and oversample only the
    training part."""
    z, cols, stats, levels = model_frame(spark, sf_dir, filled=filled)
    base = z.select("Txn_Id", "fraud_flag", *cols)
    if oversample not in ("all", "train_only"):
        raise ValueError(oversample)
    real, te = (base, None) if oversample == "all" else split(base.withColumn("row_key", F.col("Txn_Id")))
    res = smote.oversample(real.select("Txn_Id", "fraud_flag", *cols), cols, "fraud_flag", "Txn_Id")
    res = materialized(res.withColumn("row_key", F.coalesce(F.col("Txn_Id"), -(F.col("synth_index") + 1))))
    tr, te = split(res) if oversample == "all" else (res, te)
    return tr, te, cols, stats, levels


def fit_credit(spark, sf_dir, kind="rf", rounds=100, fit_on="all"):
    tr, te, cols, stats, levels = credit_sets(spark, sf_dir, fit_on)
    return models.train_credit(tr, cols, kind, rounds=rounds, scaler=stats, levels=levels), te


def fit_fraud(spark, sf_dir, kind="rf", rounds=200, oversample="all"):
    tr, te, cols, stats, levels = fraud_sets(spark, sf_dir, oversample)
    return models.train_fraud(tr, cols, kind, rounds=rounds, scaler=stats, levels=levels), te


def session_store(spark: SparkSession) -> ModelStore:
    """The store of this session, under the shared folder; the process deletes
    it at its end.  A lasting store is a ``ModelStore`` at a path of one's own."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-store"
    if path not in _STORES:
        _STORES.add(path)
        tables.own_always(spark, path)
    return ModelStore(spark, path)


_STORES: set[str] = set()


def stored_credit(spark, sf_dir, kind: str = "rf", rounds: int = 100, fit_on: str = "all", store: ModelStore | None = None):
    """(model, test rows, whether it was trained): the stored credit model of
    these rows and features, or a new one.  ``kind='softmax'``: all bands jointly.
    The version is of the rows before standardisation, which with ``fit_on`` decide the
    scaler: its own sums depend in their last bits on the order in which tasks end."""
    store = store or session_store(spark)
    filled = rows, cols, levels = filled_frame(spark, sf_dir)
    version = store.version("credit", kind, rows, ["Txn_Id", "credit_score_band", *cols], rounds=rounds, fit_on=fit_on, levels=levels)
    tr, te, cols, stats, levels = credit_sets(spark, sf_dir, fit_on, filled)

    def train():
        if kind == "softmax":
            return boosting.train_softmax(tr, cols, boosting.Plan(rounds=rounds), scaler=stats, levels=levels)
        return models.train_credit(tr, cols, kind, rounds=rounds, scaler=stats, levels=levels)

    model, trained = store.load_or_train(version, train)
    return model, te, trained


def stored_fraud(spark, sf_dir, kind: str = "rf", rounds: int = 200, oversample: str = "all", store: ModelStore | None = None):
    """(model, test rows, whether it was trained) for the fraud task; versions as ``stored_credit``."""
    store = store or session_store(spark)
    filled = rows, cols, levels = filled_frame(spark, sf_dir)
    version = store.version("fraud", kind, rows, ["Txn_Id", "fraud_flag", *cols], rounds=rounds, oversample=oversample, levels=levels)
    tr, te, cols, stats, levels = fraud_sets(spark, sf_dir, oversample, filled)
    model, trained = store.load_or_train(version, lambda: models.train_fraud(tr, cols, kind, rounds=rounds, scaler=stats, levels=levels))
    return model, te, trained


def beats_majority(model: models.FittedModel, rows: DataFrame) -> tuple[float, float]:
    """(accuracy, share of the most frequent class) on ``rows``: what a model must beat."""
    label, guess = ("credit_score_band", "credit_score_band_pred") if model.task == "credit" else ("fraud_flag", "fraud_prediction")
    pairs = model.predict(rows).groupBy(F.col(label).alias("y"), F.col(guess).alias("p")).count().collect()  # classes squared
    n, by = sum(r["count"] for r in pairs), {}
    for r in pairs:
        by[r["y"]] = by.get(r["y"], 0) + r["count"]
    return (sum(r["count"] for r in pairs if r["y"] == r["p"]) / n, max(by.values()) / n) if n else (0.0, 0.0)


def reloaded(model: models.FittedModel, spark: SparkSession) -> models.FittedModel:
    """The model, saved under the shared folder and loaded from there."""
    path = tables.own(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}")
    model.save(path)
    return models.FittedModel.load(path)


def credit_laws(model: models.FittedModel, rows: DataFrame) -> DataFrame:
    """E7 output of ``rows`` with what must hold of it, as flags."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    spread = F.array_min("probs") >= 0
    return model.predict(rows).withColumns({
        "in_domain": F.col("credit_score_band_pred").isin(rules.BANDS) & spread,
        "sums_to_one": F.abs(total - 1) < 1e-9,
        "is_argmax": (F.col("probability") == F.array_max("probs"))
        & (F.element_at("all_probabilities", F.col("credit_score_band_pred")) == F.col("probability"))})


def fraud_laws(model: models.FittedModel, rows: DataFrame) -> DataFrame:
    """E8 output of ``rows`` with what must hold of it, as flags."""
    p = F.col("fraud_probability")
    risk = F.when(p > 0.7, "High").when(p > 0.3, "Medium").otherwise("Low")
    return model.predict(rows).withColumns({
        "in_range": p.between(0, 1), "flag_follows": F.col("fraud_prediction") == (p > 0.5).cast("long"),
        "risk_follows": F.col("risk_level") == risk})


def importance_laws(model: models.FittedModel, spark: SparkSession, task: str) -> DataFrame:
    """(task, feature, sums_to_one, top_is_largest) for each feature of a model."""
    imp = model.feature_importance(spark)
    total = imp.agg(F.sum("importance").alias("total"))  # one row
    least = models.top_features(imp, 10).agg(F.min("importance").alias("least"), F.collect_set("feature").alias("top"))  # one row
    return imp.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(least)).select(
        F.lit(task).alias("task"), "feature", (F.abs(F.col("total") - 1) < 1e-9).alias("sums_to_one"),
        F.when(F.array_contains("top", F.col("feature")), F.col("importance") >= F.col("least"))
        .otherwise(F.col("importance") <= F.col("least")).alias("top_is_largest"))


def evaluation_laws(model: models.FittedModel, spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The evaluate step of a model of either task and kind on its held-out
    rows, as what is determined of it: (task, kind, measure, n, lawful).

    accuracy (n: rows), report (n: report rows), confusion (n: its total),
    importance (n: features), and for fraud roc_auc and the end of the
    precision-recall curve."""
    label, guess = ("credit_score_band", "credit_score_band_pred") if model.task == "credit" else ("fraud_flag", "fraud_prediction")
    scored = model.predict(rows)
    score = F.col("fraud_probability") if model.task == "fraud" else F.lit(0.0)
    pred = materialized(scored.select(F.col(label).cast("string").alias("label"), F.col(guess).cast("string").alias("prediction"),
                                      (F.col(label).cast("string") == "1").cast("int").alias("y"), score.alias("score")))
    unit = lambda c: F.col(c).between(0, 1)
    report = metrics.classification_report(pred)
    parts = [
        pred.agg(F.lit("accuracy").alias("measure"), F.count(F.lit(1)).alias("n")).join(metrics.accuracy(pred)).select(
            "measure", "n", unit("accuracy").alias("lawful")),
        report.where(~F.col("class").isin(metrics.MACRO, metrics.WEIGHTED)).agg(
            F.lit("report").alias("measure"), F.sum("support").alias("n"),
            F.min(unit("precision") & unit("recall") & unit("f1")).alias("lawful")),
        metrics.confusion_matrix(pred).agg(F.lit("confusion").alias("measure"), F.sum("n").alias("n"), (F.min("n") >= 0).alias("lawful")),
        model.feature_importance(spark).agg(F.lit("importance").alias("measure"), F.count(F.lit(1)).alias("n"),
                                            (F.abs(F.sum("importance") - 1) < 1e-9).alias("lawful"))]
    if model.task == "fraud":
        curve = pred.select(F.col("y").alias("label"), "score")
        parts += [
            metrics.roc_auc(curve).select(F.lit("roc_auc").alias("measure"), F.lit(1).cast("long").alias("n"), unit("roc_auc").alias("lawful")),
            metrics.pr_curve(curve).agg(F.lit("pr_curve").alias("measure"), F.count(F.when(
                (F.col("recall") == 0) & (F.col("precision") == 1) & (F.col("threshold") == 0), 1)).alias("n"),
                                        F.min(unit("precision") & unit("recall")).alias("lawful"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.lit(model.task).alias("task"), F.lit(model.kind).alias("kind"), "measure", "n", "lawful")


def fraud_metrics(model: models.FittedModel, rows: DataFrame) -> DataFrame:
    """(metric, value): accuracy, ROC AUC, positive-class precision."""
    pred = materialized(model.predict(rows).select(
        F.col("fraud_flag").cast("string").alias("label"), F.col("fraud_prediction").cast("string").alias("prediction"),
        F.col("fraud_flag").alias("y"), F.col("fraud_probability").alias("score")))
    acc = metrics.accuracy(pred).select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    auc = metrics.roc_auc(pred.select(F.col("y").alias("label"), "score")).select(
        F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
    prec = metrics.class_precision(metrics.classification_report(pred), "1").select(
        F.lit("precision_1").alias("metric"), F.col("precision").alias("value"))
    return acc.unionByName(auc).unionByName(prec)
