"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the supplied tables through the adapter, over whole
tables; parameters are the reference's defaults unless stated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import cleanse, explore, features, metrics, predictions, recommend, similar, smote
from ..operators import models as mdl
from ..session import ensure_checkpoint_dir
from ..sources import adapter, csv, layout, tables
from ..streaming import aggregates
from ..streaming.aggregates import AggregateState
from .portfolio import customers, joined, materialized, portfolio, portfolio_table
from . import evaluation, training

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


#: Columns without text to fill (B3): most queries read no other.
NUMBERS = ["Txn_Id", "Client_Num", "Week_Start_Date", "Credit_Limit", "Total_Revolving_Bal", "Total_Trans_Amt", "Total_Trans_Ct",
           "Avg_Utilization_Ratio", "Customer_Age", "Dependent_Count", "Income", "Gender", "Cust_Satisfaction_Score",
           "credit_score", "credit_score_band", "fraud_flag", "Trans_Avg", "Income_to_Credit_Ratio", "Revolving_to_Credit_Ratio"]


def numbers(spark, d) -> DataFrame:
    return portfolio(spark, d, NUMBERS)


# ---- A: sources ------------------------------------------------------------

@query("append_batches")
def q_append_batches(spark, d):
    """A3: base batch (weeks before 1999) + additional batch that lacks Interest_Earned."""
    cc = adapter.cc_detail(spark, d)
    base = cc.where(F.col("current_year") < 1999).withColumn("batch", F.lit("base"))
    extra = (cc.where(F.col("current_year") >= 1999).drop("Interest_Earned")
             .withColumn("batch", F.lit("additional")))
    return tables.append_batches(base, extra).select(
        "Txn_Id", "Client_Num", "Week_Start_Date", "Total_Trans_Amt", "Interest_Earned", "batch")


@query("normalize_values")
def q_normalize_values(spark, d):
    """CSV-shaped headers and padded values back to canonical form."""
    raw = adapter.raw_cc_detail(spark, d)
    return csv.normalize_values(raw).select("Txn_Id", "Card_Category", "Use_Chip", "Exp_Type")


# ---- B: cleansing ----------------------------------------------------------

@query("parse_dates")
def q_parse_dates(spark, d):
    raw = adapter.raw_cc_detail(spark, d)
    return cleanse.parse_dates(raw).select("Txn_Id", "Week_Start_Date")


@query("fill_numeric")
def q_fill_numeric(spark, d):
    return cleanse.fill_numeric(joined(spark, d)).select(
        "Txn_Id", "Total_Revolving_Bal", "Credit_Limit", "Total_Trans_Ct")


@query("fill_mode")
def q_fill_mode(spark, d):
    cols = ["Education_Level", "Marital_Status", "Card_Category"]
    return cleanse.fill_mode(cleanse.fill_numeric(joined(spark, d)), only=cols).select("Txn_Id", *cols)


@query("fill_default")
def q_fill_default(spark, d):
    df = cleanse.fill_default(joined(spark, d), "Personal_loan", "no")
    return df.groupBy("Personal_loan").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- C: derived columns ----------------------------------------------------

@query("credit_score")
def q_credit_score(spark, d):
    return numbers(spark, d).select("Txn_Id", "credit_score")


@query("credit_score_band")
def q_credit_score_band(spark, d):
    return numbers(spark, d).select("Txn_Id", "credit_score", "credit_score_band")


@query("fraud_flag")
def q_fraud_flag(spark, d):
    return numbers(spark, d).select("Txn_Id", "fraud_flag")


@query("ratio_features")
def q_ratio_features(spark, d):
    return numbers(spark, d).select(
        "Txn_Id", *[F.round(c, 6).alias(c) for c in
                    ["Trans_Avg", "Income_to_Credit_Ratio", "Revolving_to_Credit_Ratio"]])


@query("train_test_split")
def q_train_test_split(spark, d):
    return numbers(spark, d).select("Txn_Id", hashing.split_label(F.col("Txn_Id")).alias("split"))


# ---- D: relational and exploration -----------------------------------------

@query("account_profile_join")
def q_account_profile_join(spark, d):
    return joined(spark, d).select("Txn_Id", "Client_Num", "Customer_Age", "Income", "Total_Trans_Amt")


@query("customer_profile")
def q_customer_profile(spark, d):
    return explore.customer_profile(customers(spark, d), numbers(spark, d))


@query("customers_missing")
def q_customers_missing(spark, d):
    """D3 over the fraud-flagged accounts: which customers have none."""
    flagged = numbers(spark, d).where(F.col("fraud_flag") == 1)
    return explore.key_status(customers(spark, d), flagged)


@query("recent_transactions")
def q_recent_transactions(spark, d):
    return explore.recent_transactions(portfolio(spark, d, ["Client_Num", "Txn_Id", "Week_Start_Date", "Total_Trans_Amt",
                                                                "Total_Trans_Ct", "Exp_Type"]), n=10)


@query("aggregate_stats")
def q_aggregate_stats(spark, d):
    return explore.aggregate_stats(numbers(spark, d))


@query("band_distribution")
def q_band_distribution(spark, d):
    return explore.band_distribution(numbers(spark, d))


@query("fraud_distribution")
def q_fraud_distribution(spark, d):
    return explore.fraud_distribution(numbers(spark, d))


@query("overview_metrics")
def q_overview_metrics(spark, d):
    return explore.overview_metrics(numbers(spark, d))


@query("preview")
def q_preview(spark, d):
    return explore.preview(portfolio(spark, d, explore.PREVIEW_COLS))


@query("customer_search")
def q_customer_search(spark, d):
    return explore.search_results(numbers(spark, d))


@query("search_aggregates")
def q_search_aggregates(spark, d):
    return explore.search_aggregates(numbers(spark, d))


@query("customer_search_filtered")
def q_customer_search_filtered(spark, d):
    return explore.search_aggregates(numbers(spark, d), age=(25, 50), income=(30000, 120000),
                                     gender="F", band="Good")


@query("clustered_search_filtered")
def q_clustered_search_filtered(spark, d):
    """D10 and D12 over the portfolio laid out for the search: only files whose
    boxes meet the filters are read."""
    cols = ["Txn_Id", *layout.SEARCH, "Credit_Limit", "Total_Revolving_Bal", "fraud_flag", "Cust_Satisfaction_Score"]
    path = tables.own(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/layout/{uuid.uuid4().hex}")
    layout.write_clustered(portfolio_table(spark, d, cols), path)
    wanted = {"age": (25, 50), "income": (30000, 120000), "gender": "F", "band": "Good"}
    found = layout.clustered_search(spark, path, **wanted)
    return explore.search_aggregates(found, **wanted)


@query("weekly_trends")
def q_weekly_trends(spark, d):
    return explore.weekly_trends(numbers(spark, d))


def appended_state(spark, d) -> AggregateState:
    """The dashboard's state after the base batch (weeks before 1999), the
    additional one, and a replay of the latter (A5)."""
    p = portfolio_table(spark, d, aggregates.READS)
    state = AggregateState(spark, tables.own(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/state/{uuid.uuid4().hex}"))
    late = F.coalesce(F.year("Week_Start_Date") >= 1999, F.lit(False))
    for number, rows in ((0, p.where(~late)), (1, p.where(late)), (1, p.where(late))):
        state.update(rows, number)
    return state


@query("appended_overview")
def q_appended_overview(spark, d):
    """A5 with D8: the overview from the state that appends keep up."""
    return appended_state(spark, d).overview_metrics()


@query("appended_weekly_trends")
def q_appended_weekly_trends(spark, d):
    """A5 with D13: weekly trends from the state that appends keep up."""
    return appended_state(spark, d).weekly_trends()


@query("age_groups")
def q_age_groups(spark, d):
    return explore.with_age_group(numbers(spark, d)).select("Txn_Id", "Customer_Age", "Age_Group")


@query("age_band_counts")
def q_age_band_counts(spark, d):
    return explore.age_band_counts(numbers(spark, d))


@query("bounded_sample")
def q_bounded_sample(spark, d):
    return explore.bounded_sample(numbers(spark, d)).select("Txn_Id", "Client_Num", "sample_hash")


@query("income_limit_points")
def q_income_limit_points(spark, d):
    return explore.income_limit_points(numbers(spark, d))


# ---- F: recommendation -----------------------------------------------------


def client_profiles(spark, d, p: DataFrame | None = None):
    """One profile per client: its first account row (the reference's lookup)."""
    return explore.first_rows(p if p is not None else numbers(spark, d), cols=explore.PROFILE_COLS)


def applicant_profiles(spark, d):
    """Custom-profile inputs taken from every account row, with the score
    expressed on the 300..850 scale the form uses."""
    p = recommend.with_bureau_score(numbers(spark, d), out="bureau_score")
    return recommend.custom_profiles(p.select(
        F.col("Txn_Id").alias("Profile_Id"), "Customer_Age", "Income",
        F.col("bureau_score").alias("credit_score"), "Total_Revolving_Bal", "Total_Trans_Amt",
        "Total_Trans_Ct"))


@query("user_segment")
def q_user_segment(spark, d):
    return recommend.with_segment(client_profiles(spark, d)).select("Client_Num", "Income", "credit_score", "segment")


@query("card_eligibility")
def q_card_eligibility(spark, d):
    return recommend.card_match_scores(client_profiles(spark, d)).select(
        "Client_Num", "catalog_pos", "card_name", "eligible")


@query("card_match_scores")
def q_card_match_scores(spark, d):
    return recommend.card_match_scores(client_profiles(spark, d)).select(
        "Client_Num", "catalog_pos", "card_name", F.round("match_score", 6).alias("match_score"))


@query("recommend_cards")
def q_recommend_cards(spark, d):
    return recommend.recommend_cards(client_profiles(spark, d), top_n=3).select(
        "Client_Num", "rec_rank", "card_name", F.round("match_score", 6).alias("match_score"), "annual_fee")


@query("custom_profiles")
def q_custom_profiles(spark, d):
    return applicant_profiles(spark, d).select(
        "Profile_Id", F.round("Credit_Limit", 6).alias("Credit_Limit"),
        F.round("Avg_Utilization_Ratio", 6).alias("Avg_Utilization_Ratio"))


@query("custom_recommendations")
def q_custom_recommendations(spark, d):
    prof = recommend.with_segment(applicant_profiles(spark, d))
    recs = recommend.recommend_cards(prof, top_n=3, key="Profile_Id", keep=("segment",))
    return (recommend.with_match_tier(recs)
            .select("Profile_Id", "segment", "rec_rank", "card_name",
                    F.round("match_score", 6).alias("match_score"), "match_tier"))


def bureau_profiles(spark, d):
    """Client profiles with the score on the 300..850 scale, where every
    branch of the segment and card rules occurs."""
    prof = recommend.with_bureau_score(client_profiles(spark, d), out="bureau_score")
    return prof.drop("credit_score").withColumnRenamed("bureau_score", "credit_score")


@query("user_segment_bureau")
def q_user_segment_bureau(spark, d):
    return recommend.with_segment(bureau_profiles(spark, d)).select(
        "Client_Num", "Income", F.round("credit_score", 6).alias("credit_score"), "segment")


@query("card_match_scores_bureau")
def q_card_match_scores_bureau(spark, d):
    return recommend.card_match_scores(bureau_profiles(spark, d)).select(
        "Client_Num", "catalog_pos", "card_name", "eligible", F.round("match_score", 6).alias("match_score"))


@query("match_tiers")
def q_match_tiers(spark, d):
    recs = recommend.recommend_cards(client_profiles(spark, d), top_n=3)
    return recommend.with_match_tier(recs).select("Client_Num", "rec_rank", "match_tier")


# ---- E: features, scoring outputs and metrics ------------------------------


def _r6(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


TASK = ("task",)


def labelled(spark, d) -> DataFrame:
    return evaluation.labelled(numbers(spark, d))


@query("one_hot")
def q_one_hot(spark, d):
    df, dummies = features.one_hot(portfolio(spark, d, ["Txn_Id", *features.CATEGORICALS]))
    return df.select("Txn_Id", *dummies)


@query("standardize")
def q_standardize(spark, d):
    p = features.fill_features(numbers(spark, d), features.NUMERIC_FEATURES)
    z = features.standardize(p, features.NUMERIC_FEATURES)
    return _r6(z.select("Txn_Id", *features.NUMERIC_FEATURES), features.NUMERIC_FEATURES)


@query("class_weights")
def q_class_weights(spark, d):
    return _r6(features.class_weights(evaluation.train_rows(numbers(spark, d)), "fraud_flag"),
               ["class_weight", "scale_pos_weight"])


@query("band_argmax")
def q_band_argmax(spark, d):
    t = evaluation.band_predictions(evaluation.test_rows(numbers(spark, d)))
    return _r6(t.select("Txn_Id", "credit_score_band_pred", "probability"), ["probability"])


@query("probability_rows")
def q_probability_rows(spark, d):
    t = evaluation.band_predictions(evaluation.test_rows(numbers(spark, d)))
    return _r6(predictions.probability_rows(t, "Txn_Id"), ["probability"])


@query("risk_levels")
def q_risk_levels(spark, d):
    t = predictions.fraud_output(evaluation.fraud_scores(evaluation.test_rows(numbers(spark, d))))
    return _r6(t.select("Txn_Id", "fraud_probability", "fraud_prediction", "risk_level"), ["fraud_probability"])


@query("score_requests")
def q_score_requests(spark, d):
    scored = evaluation.band_predictions(client_profiles(spark, d))
    out = predictions.score_requests(customers(spark, d), scored)
    return _r6(out.select("Client_Num", "error", "credit_score_band", "probability", "model_type",
                          F.size("all_probabilities").cast("long").alias("n_classes")), ["probability"])


@query("fraud_requests")
def q_fraud_requests(spark, d):
    scored = predictions.fraud_output(evaluation.fraud_scores(client_profiles(spark, d)))
    out = predictions.score_fraud_requests(customers(spark, d), scored)
    return _r6(out, ["fraud_probability"])


@query("accuracy")
def q_accuracy(spark, d):
    return _r6(metrics.accuracy(labelled(spark, d), by=TASK), ["accuracy"])


@query("classification_report")
def q_classification_report(spark, d):
    return _r6(metrics.classification_report(labelled(spark, d), by=TASK), ["precision", "recall", "f1"])


@query("confusion_matrix")
def q_confusion_matrix(spark, d):
    return metrics.confusion_matrix(labelled(spark, d), by=TASK)


@query("avg_f1")
def q_avg_f1(spark, d):
    return _r6(metrics.avg_f1(metrics.classification_report(labelled(spark, d), by=TASK), TASK), ["avg_f1"])


@query("report_long")
def q_report_long(spark, d):
    return _r6(metrics.report_long(metrics.classification_report(labelled(spark, d), by=TASK), ("task", "class")), ["value"])


@query("fraud_precision")
def q_fraud_precision(spark, d):
    fraud = labelled(spark, d).where("task = 'fraud'")
    return _r6(metrics.class_precision(metrics.classification_report(fraud), "1"), ["precision"])


def _fraud_scored(spark, d):
    t = evaluation.fraud_scores(evaluation.test_rows(numbers(spark, d)))
    return t.select(F.col("fraud_flag").alias("label"), F.col("fraud_probability").alias("score"))


@query("roc_auc")
def q_roc_auc(spark, d):
    return _r6(metrics.roc_auc(_fraud_scored(spark, d)), ["roc_auc"])


@query("pr_curve")
def q_pr_curve(spark, d):
    return _r6(metrics.pr_curve(_fraud_scored(spark, d)), ["threshold", "precision", "recall"])


# ---- F6-F9: similarity -----------------------------------------------------


@query("recommender_scaler")
def q_recommender_scaler(spark, d):
    stats = similar.fit_recommender(numbers(spark, d))
    return _r6(similar.scaler_frame(spark, stats), ["mean", "std"])


@query("probe_imputation")
def q_probe_imputation(spark, d):
    """New-applicant probes from the customer dimension: only age and income
    are known, the account features take the portfolio means."""
    stats = similar.fit_recommender(numbers(spark, d))
    probes = similar.impute_probes(customers(spark, d).select("Client_Num", "Customer_Age", "Income"), stats)
    return _r6(probes.select("Client_Num", *[F.col(c).cast("double").alias(c) for c in stats]), list(stats))


SIMILARITY_COLS = ["Client_Num", *explore.PROFILE_COLS]


@query("similar_customers")
def q_similar_customers(spark, d):
    p = portfolio_table(spark, d, SIMILARITY_COLS)
    return _r6(similar.similar_customers(p, client_profiles(spark, d, p), top_n=5), ["similarity"])


@query("similar_vectors")
def q_similar_vectors(spark, d):
    return _r6(similar.similar_vectors(adapter.table(spark, d, "embeddings"), top_n=5), ["similarity"])


@query("approximate_search")
def q_approximate_search(spark, d):
    """F7 by hash tables against the exact search, for all customers and all
    vectors: at least 90 % of the neighbours are found, and every score is exact."""
    p = portfolio_table(spark, d, SIMILARITY_COLS)
    profiles, v = client_profiles(spark, d, p), adapter.table(spark, d, "embeddings")
    customers = similar.search_agreement(similar.similar_customers(p, profiles, 5), similar.approximate_customers(p, profiles, 5),
                                         "Client_Num", "neighbor_txn")
    vectors = similar.search_agreement(similar.similar_vectors(v), similar.approximate_vectors(v), "vec_id", "neighbor_id")
    law = ["n_probes", (F.col("recall") >= 0.9).alias("recall_ok"), (F.col("wrong") == 0).alias("scores_ok")]
    return customers.select(F.lit("customers").alias("searched"), *law).unionByName(
        vectors.select(F.lit("vectors").alias("searched"), *law))


@query("recommender_requests")
def q_recommender_requests(spark, d):
    """Every client's similar customers from a recommender that was
    saved and loaded again; the request fits nothing."""
    p = portfolio_table(spark, d, SIMILARITY_COLS)
    saved = similar.Recommender.fit(p)
    return _r6(similar.Recommender.load(spark, saved.path).similar(client_profiles(spark, d, p), 5), ["similarity"])


@query("recommendation_bundle")
def q_recommendation_bundle(spark, d):
    p = portfolio_table(spark, d, SIMILARITY_COLS)
    return similar.recommendation_bundle(client_profiles(spark, d, p), p)


# ---- C11: SMOTE --------------------------------------------------------------


def fraud_training_frame(spark, d):
    """Standardised model features (11 numerics + dummies) with the fraud label."""
    df, _ = features.one_hot(portfolio_table(spark, d, training.MODEL_INPUT_COLS))
    cols = features.feature_columns(df)
    z = features.standardize(df.select("Txn_Id", "fraud_flag", *cols), cols)
    return materialized(z), cols


@query("smote_counts")
def q_smote_counts(spark, d):
    z, cols = fraud_training_frame(spark, d)
    return smote.oversample(z, cols, "fraud_flag", "Txn_Id").groupBy("fraud_flag").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("smote_neighbors")
def q_smote_neighbors(spark, d):
    z, cols = fraud_training_frame(spark, d)
    nn = smote.minority_neighbours(z, cols, "fraud_flag", "Txn_Id", 1)
    return nn.select(F.col("probe_key").alias("Txn_Id"), "nn_rank", F.col("cand_key").alias("neighbor_txn"))


@query("smote_rows")
def q_smote_rows(spark, d):
    z, cols = fraud_training_frame(spark, d)
    s = smote.synthetic_rows(z, cols, "fraud_flag", "Txn_Id")
    return _r6(s, cols)


# ---- E1-E5, E7-E9, E16, E17: trained models ----------------------------------
# Each model query is trained in full on the supplied tables.  Values of a
# random model have no SQL; the contract queries below check with SQL all that
# is determined: keys, labels, held-out membership, and the laws that
# probabilities, labels and importances obey.

KINDS = ("rf", "gbt")


def _credit_preds(spark, d, kind):
    m, te = training.fit_credit(spark, d, kind)
    out = m.predict(te)
    return _r6(out.select("Txn_Id", "credit_score_band", "credit_score_band_pred", "probability", "model_type"),
               ["probability"])


def _fraud_preds(spark, d, kind):
    m, te = training.fit_fraud(spark, d, kind)
    out = m.predict(te)
    return _r6(out.select("row_key", "fraud_flag", "fraud_prediction", "fraud_probability", "risk_level",
                          "model_type"), ["fraud_probability"])


@query("credit_rf_predictions")
def q_credit_rf_predictions(spark, d):
    return _credit_preds(spark, d, "rf")


@query("credit_gbt_predictions")
def q_credit_gbt_predictions(spark, d):
    return _credit_preds(spark, d, "gbt")


@query("fraud_rf_predictions")
def q_fraud_rf_predictions(spark, d):
    return _fraud_preds(spark, d, "rf")


@query("fraud_gbt_predictions")
def q_fraud_gbt_predictions(spark, d):
    return _fraud_preds(spark, d, "gbt")


@query("credit_softmax_predictions")
def q_credit_softmax_predictions(spark, d):
    """E3 jointly: one model of all bands on softmax gradients."""
    m, te, _ = training.stored_credit(spark, d, "softmax")
    return _r6(m.predict(te).select("Txn_Id", "credit_score_band", "credit_score_band_pred", "probability", "model_type"), ["probability"])


@query("softmax_contract")
def q_softmax_contract(spark, d):
    """E3 jointly: the laws of the output, and two that a bad model breaks: the
    training loss falls each round, and the accuracy on held-out rows is at least
    half way from the most frequent band's share to 1."""
    m, te, _ = training.stored_credit(spark, d, "softmax")
    accuracy, majority = training.beats_majority(m, te)
    falls = len(m.losses) == 100 and all(a > b for a, b in zip(m.losses, m.losses[1:]))
    return training.credit_laws(m, te).select(
        "Txn_Id", "credit_score_band", "in_domain", "sums_to_one", "is_argmax", "model_type",
        F.lit(falls).alias("loss_falls"), F.lit(accuracy >= (1 + majority) / 2).alias("learned"))


@query("split_importance")
def q_split_importance(spark, d):
    """E16 by splits: how often the trees of each task's boosted model split on
    each feature."""
    parts = [m.split_importance(spark).select(F.lit(m.task).alias("task"), F.lit(m.kind).alias("kind"), "feature", "importance")
             for m in (training.stored_credit(spark, d, "softmax")[0], training.stored_fraud(spark, d, "gbt")[0])]
    return parts[0].unionByName(parts[1])


@query("feature_importance")
def q_feature_importance(spark, d):
    m, _ = training.fit_credit(spark, d, "rf")
    return m.feature_importance(spark)


@query("top_features")
def q_top_features(spark, d):
    m, _ = training.fit_credit(spark, d, "rf")
    return mdl.top_features(m.feature_importance(spark), 10)


@query("fraud_rf_evaluation")
def q_fraud_rf_evaluation(spark, d):
    """The reference's evaluate step on a trained model: accuracy, ROC AUC and
    positive-class precision of the fraud forest on its held-out rows."""
    m, te = training.fit_fraud(spark, d, "rf")
    return _r6(training.fraud_metrics(m, te), ["value"])


@query("credit_contract")
def q_credit_contract(spark, d):
    """The credit forest's held-out rows, with the laws of its output as flags."""
    m, te = training.fit_credit(spark, d, "rf")
    return training.credit_laws(m, te).select("Txn_Id", "credit_score_band", "in_domain", "sums_to_one", "is_argmax", "model_type")


@query("fraud_contract")
def q_fraud_contract(spark, d):
    """The fraud forest's real held-out rows and the laws of its output."""
    m, te = training.fit_fraud(spark, d, "rf", oversample="train_only")
    return training.fraud_laws(m, te).select("row_key", "fraud_flag", "in_range", "flag_follows", "risk_follows", "model_type")


@query("boosted_contract")
def q_boosted_contract(spark, d):
    """E3 and E5 uncut (100 and 200 rounds): the laws of both boosted models' outputs."""
    credit, held = training.fit_credit(spark, d, "gbt")
    fraud, rows = training.fit_fraud(spark, d, "gbt", oversample="train_only")
    c = training.credit_laws(credit, held).select(
        F.lit("credit").alias("task"), F.col("Txn_Id").alias("key"),
        (F.col("in_domain") & F.col("sums_to_one") & F.col("is_argmax")).alias("lawful"))
    f = training.fraud_laws(fraud, rows).select(
        F.lit("fraud").alias("task"), F.col("row_key").alias("key"),
        (F.col("in_range") & F.col("flag_follows") & F.col("risk_follows")).alias("lawful"))
    return c.unionByName(f)


@query("evaluation_contract")
def q_evaluation_contract(spark, d):
    """E11-E16 of trained models: credit and fraud, forest and boosted trees,
    all in full, each evaluated on its held-out rows."""
    credit, fraud = training.credit_sets(spark, d), training.fraud_sets(spark, d, "train_only")
    parts = []
    for kind in KINDS:
        for fit, (train, held, cols, stats, levels) in ((mdl.train_credit, credit), (mdl.train_fraud, fraud)):
            parts.append(training.evaluation_laws(fit(train, cols, kind, scaler=stats, levels=levels), spark, held))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("importance_contract")
def q_importance_contract(spark, d):
    """E16 and E17 of the credit and fraud forests: every feature is there once,
    importances sum to 1, and the top ten are the ten largest."""
    parts = [training.importance_laws(fit(spark, d, "rf")[0], spark, task)
             for task, fit in (("credit", training.fit_credit), ("fraud", training.fit_fraud))]
    return parts[0].unionByName(parts[1])


@query("request_answers")
def q_request_answers(spark, d):
    """E7-E9 through the stored credit model (trained if there is none) on raw customer
    rows: every customer gets an answer, those without an account an error."""
    training.stored_credit(spark, d, "rf")
    m, _, trained = training.stored_credit(spark, d, "rf")
    assert not trained, "the model that was published is not found"
    raw = explore.first_rows(portfolio(spark, d, training.MODEL_INPUT_COLS + ["Client_Num"]))
    out = predictions.score_requests(customers(spark, d), m.predict_raw(raw), model_type=m.kind)
    return out.select("Client_Num", "error", "model_type", (F.size("all_probabilities") > 0).alias("has_probabilities"),
                      (F.col("credit_score_band") != "Unknown").alias("has_band"))
