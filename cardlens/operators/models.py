"""Credit and fraud classifiers as Spark MLlib models, grown by trees.py.

* credit band, random forest (E2): 100 trees, depth 10, seed 42;
* credit band, boosted trees (E3): MLlib boosting is binary, so one
  GBTClassifier per band (eta 0.1, depth 6, subsample 0.8, feature subset
  0.8), probabilities normalised across bands; boosting.py fits all bands
  jointly on softmax gradients;
* fraud, random forest with balanced class weights (E4);
* fraud, boosted trees with positives weighted n0/n1 (E5): 200 rounds,
  eta 0.05, depth 5, subsample 0.8, feature subset 0.8.

Labels use a fixed class order (E1).  Features are the standardised
columns prepared by features.py; a fitted model keeps the feature names,
the scaler statistics and its type, and saves/loads as a directory of
MLlib models plus a JSON sidecar (A7).
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.tables import own
from . import features as feat
from . import predictions

SEED = 42
TASK_ROWS = 200_000  # training rows of one task, about


class MissingFeatures(ValueError):
    pass


def check_features(df: DataFrame, features: list[str]) -> None:
    """Refuse input lacking model features, naming them."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise MissingFeatures(f"Missing features: {missing}")


def label_indexer(label_col: str, labels: list[str], out: str = "label") -> StringIndexerModel:
    """Fixed class order; unseen labels are an error."""
    return StringIndexerModel.from_labels(labels, inputCol=label_col, outputCol=out, handleInvalid="error")


def _assembler(features):
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


class FittedModel:
    def __init__(self, task, kind, features, labels, stages, scaler=None, levels=None):
        self.task, self.kind, self.features, self.labels = task, kind, features, labels
        self.stages = stages          # list of PipelineModel: one, or one per class (boosted multiclass)
        self.scaler = scaler or {}    # column -> (mean, std) of the fit
        self.levels = levels or {}    # categorical -> its levels at the fit

    # -- scoring -----------------------------------------------------------
    def class_probabilities(self, df: DataFrame) -> DataFrame:
        """Adds ``probs``: array<double> in ``labels`` order."""
        check_features(df, self.features)
        if len(self.stages) == 1:
            out = self.stages[0].transform(df)
            return out.withColumn("probs", vector_to_array("probability")).drop(
                "features", "rawPrediction", "probability", "prediction", "label")
        cols = []
        out = df
        for i, m in enumerate(self.stages):
            out = m.transform(out).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop(
                "features", "rawPrediction", "probability", "prediction", "label", "bin_label")
            cols.append(F.col(f"_p{i}"))
        tot = cols[0]
        for c in cols[1:]:
            tot = tot + c
        probs = F.array(*[F.when(tot > 0, c / tot).otherwise(F.lit(1.0 / len(cols))) for c in cols])
        return out.withColumn("probs", probs).drop(*[f"_p{i}" for i in range(len(cols))])

    def raw_columns(self) -> list[str]:
        """Columns of a raw customer row that the model needs."""
        dummies = {feat.dummy_name(c, v) for c, vs in self.levels.items() for v in vs}
        return [f for f in self.features if f not in dummies] + list(self.levels)

    def prepare(self, df: DataFrame) -> DataFrame:
        """A raw row as the fit saw it: one-hot with the fitted levels (a value
        that was not there is all zeros), nulls filled, standardised."""
        check_features(df, self.raw_columns())
        encoded, _ = feat.one_hot(df, list(self.levels), levels=self.levels)
        return feat.apply_scaler(feat.fill_features(encoded, self.features), self.scaler)

    def predict_raw(self, df: DataFrame) -> DataFrame:
        """E7 / E8 outputs for raw customer rows."""
        if not self.scaler:
            raise ValueError("the model was fitted without a scaler; it takes prepared rows only")
        return self.predict(self.prepare(df))

    def predict(self, df: DataFrame) -> DataFrame:
        """E7 (credit) / E8 (fraud) outputs for prepared rows."""
        p = self.class_probabilities(df)
        if self.task == "credit":
            return predictions.band_output(p, "probs", self.labels, self.kind)
        p = p.withColumn("fraud_probability", F.col("probs")[1]).withColumn("model_type", F.lit(self.kind))
        return predictions.fraud_output(p, "fraud_probability")

    def feature_importance(self, spark) -> DataFrame:
        """Per-feature importance (impurity gain; averaged over per-class
        models for boosted multiclass), sorted descending."""
        acc = [0.0] * len(self.features)
        for m in self.stages:
            imp = m.stages[-1].featureImportances.toArray()
            for i, v in enumerate(imp):
                acc[i] += float(v) / len(self.stages)
        rows = list(zip(self.features, acc))
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.col("importance").desc(), F.col("feature"))

    def tree_rows(self, spark) -> DataFrame:
        """The fitted trees as rows (tree, node, feature, split, gain); feature
        is null at a leaf.  They are read from the saved form of the model."""
        from ..session import ensure_checkpoint_dir
        names = F.array(*[F.lit(c) for c in self.features])
        at = F.col("nodeData.split.featureIndex")
        root = own(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees/{uuid.uuid4().hex}")
        parts = []
        for i, m in enumerate(self.stages):
            m.stages[-1].write().save(f"{root}/{i}")
            parts.append(spark.read.parquet(f"{root}/{i}/data").select(
                F.format_string(f"{i}-%d", "treeID").alias("tree"), F.col("nodeData.id").alias("node"),
                F.when(at >= 0, F.get(names, at)).alias("feature"),
                F.when(at >= 0, F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0))).alias("split"), F.col("nodeData.gain").alias("gain")))
        return reduce(DataFrame.unionByName, parts)

    def split_importance(self, spark) -> DataFrame:
        """E16 by splits: (feature, importance), how often the trees split on
        each feature; 0 for one that is never used."""
        counts = self.tree_rows(spark).where("feature IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
        return self._over_features(spark, counts, "n", "importance")

    def _over_features(self, spark, found: DataFrame, col: str, out: str, share: bool = False) -> DataFrame:
        """Every feature once with its value in ``found``, largest first."""
        every = spark.createDataFrame([(c,) for c in self.features], "feature string")
        rows = every.join(found, "feature", "left").select("feature", F.coalesce(col, F.lit(0)).alias(out))
        if share:
            total = rows.agg(F.sum(out)).first()[0] or 1.0
            rows = rows.withColumn(out, F.col(out) / F.lit(total))
        return rows.orderBy(F.col(out).desc(), F.col("feature"))

    # -- persistence (A7) ----------------------------------------------------
    def save(self, path: str) -> None:
        for i, m in enumerate(self.stages):
            m.write().overwrite().save(os.path.join(path, f"stage_{i}"))
        meta = {"task": self.task, "kind": self.kind, "features": self.features, "labels": self.labels,
                "n_stages": len(self.stages), "scaler": self.scaler, "levels": self.levels}
        write_text(path, "meta.json", json.dumps(meta))

    @classmethod
    def load(cls, path: str) -> "FittedModel":
        meta = json.loads(_read_text(path, "meta.json"))
        if meta["kind"] == "softmax":
            from .boosting import SoftmaxModel
            return SoftmaxModel.restore(path, meta)
        stages = [PipelineModel.load(os.path.join(path, f"stage_{i}")) for i in range(meta["n_stages"])]
        return cls(meta["task"], meta["kind"], meta["features"], meta["labels"], stages,
                   {k: tuple(v) for k, v in meta["scaler"].items()}, meta.get("levels"))


def write_text(path: str, name: str, text: str) -> None:
    """Sidecar through Spark's filesystem layer so shared storage works too."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        os.path.join(path, name))


def _read_text(path: str, name: str) -> str:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return "\n".join(r[0] for r in spark.read.text(os.path.join(path, name)).collect())


def _kind(kind: str) -> None:
    if kind not in ("rf", "gbt"):
        raise ValueError(f"model kind {kind!r} is neither 'rf' (forest) nor 'gbt' (boosted trees)")


def _spread(rows: DataFrame) -> DataFrame:
    """Training rows in parts of about ``TASK_ROWS`` at most.  MLlib keeps a part, with
    each row's draws for all trees, as one block that one task reads at each level."""
    parts = -(-rows.count() // TASK_ROWS)
    return rows if parts <= rows.rdd.getNumPartitions() else rows.repartition(parts)


def _number(label_col: str, labels: list) -> Column:
    """The place of a row's label; one that is no class is an error."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label_col)) - 1
    bad = F.raise_error(F.concat(F.lit(f"{label_col} is none of the classes: "), F.coalesce(F.col(label_col).cast("string"), F.lit("null"))))
    return F.when(at >= 0, at).otherwise(bad)


def _boosted(clf: GBTClassifier, train: DataFrame, features: list[str], number, targets: list[int], weights: list[float]) -> list:
    """Boosted models with ``clf``'s settings, one a target, fitted in the same jobs."""
    from . import trees
    grown, cuts = trees.grow_boosted(train, features, number, targets, weights, clf.getMaxIter(), clf.getStepSize(), clf.getMaxDepth(),
                                     clf.getSubsamplingRate(), float(clf.getFeatureSubsetStrategy()), SEED)
    steps = [1.0] + [clf.getStepSize()] * (clf.getMaxIter() - 1)
    return [trees.as_mllib(train.sparkSession, clf, GBTClassificationModel, part, cuts, steps, 0) for part in grown]


def _forest(clf: RandomForestClassifier, train: DataFrame, features: list[str], number, weights: list[float]):
    """A forest with ``clf``'s settings and a weight a class."""
    from . import trees
    grown, cuts = trees.grow_forest(train, features, number, weights, clf.getNumTrees(), clf.getMaxDepth(), SEED)
    return trees.as_mllib(train.sparkSession, clf, RandomForestClassificationModel, grown, cuts, [1.0] * len(grown), len(weights))


def train_credit(train: DataFrame, features: list[str], kind: str = "rf", rounds: int = 100,
                 label_col: str = "credit_score_band", scaler: dict | None = None, levels: dict | None = None) -> FittedModel:
    """E2 / E3.  Boosted bands: one model a band, as one-versus-rest does, all
    fitted in the same jobs."""
    _kind(kind)
    labels = list(rules.BANDS)
    assembler, number = _assembler(features), _number(label_col, labels)
    if kind == "rf":
        clf = RandomForestClassifier(numTrees=100, maxDepth=10, seed=SEED, labelCol="label")
        model = PipelineModel(stages=[label_indexer(label_col, labels), assembler, _forest(clf, train, features, number, [1.0] * len(labels))])
        return FittedModel("credit", kind, features, labels, [model], scaler, levels)
    clf = GBTClassifier(maxIter=rounds, stepSize=0.1, maxDepth=6, subsamplingRate=0.8,
                        featureSubsetStrategy="0.8", seed=SEED, labelCol="bin_label")
    found = _boosted(clf, train, features, number, list(range(len(labels))), [1.0, 1.0])
    return FittedModel("credit", kind, features, labels, [PipelineModel(stages=[assembler, m]) for m in found], scaler, levels)


def train_fraud(train: DataFrame, features: list[str], kind: str = "rf", rounds: int = 200,
                label_col: str = "fraud_flag", scaler: dict | None = None, levels: dict | None = None) -> FittedModel:
    """E4 (balanced class weights) / E5 (positives weighted n0 / n1)."""
    _kind(kind)
    n0, n1 = feat.binary_counts(train, label_col)
    weight = feat.balanced_weight(n0, n1, label_col) if kind == "rf" else feat.positive_weight(n0, n1, label_col)
    pair = train.sparkSession.createDataFrame([(0,), (1,)], f"{label_col} int").select(label_col, weight.alias("w")).collect()
    weights = [float(r["w"]) for r in sorted(pair)]
    number = _number(label_col, [0, 1])
    if kind == "rf":
        clf = RandomForestClassifier(numTrees=100, maxDepth=10, seed=SEED, weightCol="weight")
        found = _forest(clf, train, features, number, weights)
    else:
        clf = GBTClassifier(maxIter=rounds, stepSize=0.05, maxDepth=5, subsamplingRate=0.8,
                            featureSubsetStrategy="0.8", seed=SEED, weightCol="weight")
        found = _boosted(clf, train, features, number, [1], weights)[0]
    return FittedModel("fraud", kind, features, ["0", "1"], [PipelineModel(stages=[_assembler(features), found])], scaler, levels)


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    """The n most important features, then in ascending order."""
    return importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(n).orderBy("importance", "feature")
