"""Model quality, probability sums and save -> load round trip."""

import tempfile

from pyspark.sql import functions as F

from cardlens.operators import metrics, models
from cardlens.plans import training
from conftest import SF0001


def test_credit_rf_quality_and_round_trip(spark):
    tr, te, cols, stats, levels = training.credit_sets(spark, SF0001)
    m = models.train_credit(tr, cols, "rf", scaler=stats, levels=levels)
    pred = m.predict(te).cache()
    sums = pred.select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
    acc = metrics.accuracy(pred, "credit_score_band", "credit_score_band_pred").first()[0]
    majority = te.groupBy("credit_score_band").count().agg(F.max("count")).first()[0] / te.count()
    assert acc > majority
    path = tempfile.mkdtemp(prefix="cardlens-model-") + "/m"
    m.save(path)
    back = models.FittedModel.load(path)
    a = sorted((r.Txn_Id, r.credit_score_band_pred) for r in pred.collect())
    b = sorted((r.Txn_Id, r.credit_score_band_pred) for r in back.predict(te).collect())
    assert a == b and back.features == cols


def test_fraud_gbt_small_and_missing_features(spark):
    m, te = training.fit_fraud(spark, SF0001, "gbt", rounds=5)
    out = m.predict(te)
    assert {"fraud_probability", "fraud_prediction", "risk_level"} <= set(out.columns)
    try:
        m.predict(te.drop(m.features[0]))
        raise AssertionError("expected MissingFeatures")
    except models.MissingFeatures as e:
        assert m.features[0] in str(e)


def test_scaler_fit_on_train_only(spark):
    tr_all, _, cols, stats_all, _ = training.credit_sets(spark, SF0001, "all")
    tr, te, cols2, stats_tr, _ = training.credit_sets(spark, SF0001, "train")
    assert cols == cols2 and stats_all["Income"] != stats_tr["Income"]
    # fitted on the training rows: their standardised Income has mean ~0
    m = tr.agg(F.avg("Income")).first()[0]
    assert abs(m) < 1e-9


def test_raw_rows_score_like_prepared_rows(spark):
    """A reloaded model scores a raw customer as it scores the prepared row."""
    from cardlens.functions import hashing
    from cardlens.plans.portfolio import portfolio
    m, te = training.fit_credit(spark, SF0001, "rf")
    back = training.reloaded(m, spark)
    raw = portfolio(spark, SF0001, training.MODEL_INPUT_COLS).where(hashing.split_label(F.col("Txn_Id")) == "test")
    a = {r.Txn_Id: (r.credit_score_band_pred, r.probability) for r in m.predict(te).collect()}
    b = {r.Txn_Id: (r.credit_score_band_pred, r.probability) for r in back.predict_raw(raw).collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-9 for k in a)
    # a null and a level that the fit has not seen are filled and all zeros, not errors
    odd = raw.withColumn("Income", F.lit(None).cast("long")).withColumn("Exp_Type", F.lit("Moon"))
    assert back.predict_raw(odd).where("credit_score_band_pred IS NULL").isEmpty()
    try:
        back.predict_raw(raw.drop("Exp_Type", "Income"))
        raise AssertionError("expected MissingFeatures")
    except models.MissingFeatures as e:
        assert "Exp_Type" in str(e) and "Income" in str(e)


def test_requests_name_model_and_missing_features(spark):
    from cardlens.operators import predictions
    req = spark.createDataFrame([(1,), (2,)], "Client_Num long")
    out = predictions.score_requests(req, None, missing=["Income"], model_type="rf").collect()
    assert {(r.error, r.model_type, r.credit_score_band) for r in out} == {("Missing features: ['Income']", "rf", "Unknown")}
    out = predictions.score_fraud_requests(req, None, model_ready=False, model_type="gbt").collect()
    assert {(r.error, r.model_type, r.risk_level) for r in out} == {("Model not ready", "gbt", "Unknown")}


def test_training_rows_of_a_task_are_bounded(spark, monkeypatch):
    """few large files are not few large tasks."""
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    rows = spark.range(0, 1050, 1, 2)
    held = models._spread(rows).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in held) <= 200 and sum(r["count"] for r in held) == 1050
    assert models._spread(rows.repartition(30)).rdd.getNumPartitions() == 30
