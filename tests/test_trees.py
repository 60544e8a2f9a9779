"""Forests and boosted trees grown for all trees in one job a level."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cardlens.functions import rules
from cardlens.operators import models, trees

COLS = ["a", "b", "c"]


def rows_of(spark, n=240):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 7, (n, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] > 6).astype(int) + (x[:, 2] > 4) * (rng.random(n) < 0.8)
    df = spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int").coalesce(1)
    return df, x, y


def test_forest_equals_plain_trees(spark):
    """One node at a time on the same draws: the same splits, gains and class sums."""
    df, x, y = rows_of(spark)
    weights = np.array([1.0, 0.5, 2.0])
    grown, cuts = trees.grow_forest(df, COLS, F.col("y"), list(weights), 3, 3, 42)

    def gini(s):
        return 1 - ((s / s.sum()) ** 2).sum()

    for t, tree in enumerate(grown):
        draws = np.searchsorted(trees.POISSON, trees.uniform(np.arange(len(y)), 42 * 1_000_003 + t), side="right")

        def grow(rows, at, level):
            """{node: (gain, class sums)}, and the class that all its leaves say or -1."""
            s = np.array([draws[rows][y[rows] == k].sum() * w for k, w in enumerate(weights)])
            best = (0.0, None, None)
            if level < 3:
                for f in trees._subsets([42, t, level], 1 << level, 3, math.ceil(math.sqrt(3)))[at - (1 << level) + 1]:
                    for cut in cuts[f]:
                        left = x[rows, f] <= cut
                        parts = [np.array([draws[r][y[r] == k].sum() * w for k, w in enumerate(weights)]) for r in (rows[left], rows[~left])]
                        if all(p.sum() for p in parts):
                            gain = gini(s) - sum(p.sum() * gini(p) for p in parts) / s.sum()
                            if gain > best[0] + 1e-12:
                                best = (gain, int(f), cut)
            if best[1] is None:
                return {at: (-1, s)}, int(s.argmax())
            left = x[rows, best[1]] <= best[2]
            (a, p), (b, q) = grow(rows[left], 2 * at + 1, level + 1), grow(rows[~left], 2 * at + 2, level + 1)
            if p == q != -1:
                return {at: (-1, s)}, p
            return {at: (best[0], s), **a, **b}, -1

        want, _ = grow(np.arange(len(y)), 0, 0)
        for at, (gain, s) in want.items():
            assert np.allclose(tree.sums[at], s) and (tree.feature[at] >= 0) == (gain > 0) and (gain < 0 or abs(tree.gain[at] - gain) < 1e-9)


@pytest.mark.parametrize("weight", [1.0, 2.5])
def test_boosting_equals_mllib(spark, weight):
    """All rows and features in each round: MLlib's own probabilities and importances."""
    df, _, _ = rows_of(spark)
    df = df.select(*COLS, (F.col("y") > 0).cast("int").alias("y"))
    clf = GBTClassifier(maxIter=4, stepSize=0.1, maxDepth=3, subsamplingRate=1.0, featureSubsetStrategy="1.0", seed=1, labelCol="y", weightCol="w")
    ready = VectorAssembler(inputCols=COLS, outputCol="features").transform(df.withColumn("w", F.when(F.col("y") == 1, weight).otherwise(1.0)))
    want = clf.fit(ready)
    got = models._boosted(clf, df, COLS, models._number("y", [0, 1]), [1], [1.0, weight])[0]
    p = [[r[0] for r in m.transform(ready).select(vector_to_array("probability")[1]).collect()] for m in (want, got)]
    assert np.allclose(*p, atol=1e-4) and np.allclose(want.featureImportances.toArray(), got.featureImportances.toArray(), atol=1e-3)
    assert got.getNumTrees == 4 and got.getStepSize() == 0.1 and list(got.treeWeights) == list(want.treeWeights)


def test_same_forest_whatever_the_tasks(spark, monkeypatch):
    """Blocks of nodes, chunks of rows and tasks decide nothing."""
    df, _, _ = rows_of(spark)

    def grown():
        found, _ = trees.grow_forest(df, COLS, F.col("y"), [1.0] * 3, 4, 4, 42)
        return [(t.feature.tolist(), t.bin.tolist(), t.sums.tolist()) for t in found]

    whole = grown()
    for name, value in (("NODES", 3), ("CHUNK", 50), ("TASK_ROWS", 40)):
        monkeypatch.setattr(trees, name, value)
    assert grown() == whole


def test_written_margins_change_nothing(spark, monkeypatch):
    df, _, _ = rows_of(spark)
    nodes = []
    for rows in (10_000, 1):
        monkeypatch.setattr(trees, "KEEP_ROWS", rows)
        found, _ = trees.grow_boosted(df, COLS, F.col("y"), [0, 1, 2], [1.0, 1.0], 3, 0.1, 3, 0.8, 0.8, 42)
        nodes.append([(t.feature.tolist(), t.bin.tolist(), t.sums.tolist()) for part in found for t in part])
    assert nodes[0] == nodes[1]


def test_bands_share_their_jobs(spark):
    """a level of all four bands is one job; before, each band had jobs of its own in threads."""
    df, _, _ = rows_of(spark)
    train = df.select("a", "b", "c", F.element_at(F.array(*[F.lit(x) for x in rules.BANDS]), F.col("y") + 1).alias("credit_score_band"))
    spark.sparkContext.setJobGroup("boosted", "boosted")
    try:
        counts = []
        for rounds in (1, 3):
            before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted"))
            m = models.train_credit(train, COLS, "gbt", rounds=rounds)
            counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted")) - before)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(m.stages) == 4 and 0 < counts[1] - counts[0] <= 2 * 6 * 2


def test_one_class_and_odd_labels(spark):
    df, _, _ = rows_of(spark)
    one = df.select(*COLS, F.lit(0).alias("fraud_flag"))
    for kind in ("rf", "gbt"):
        m = models.train_fraud(one, COLS, kind, rounds=2)
        assert m.predict(one).where("fraud_probability > 0.5").isEmpty()
    with pytest.raises(Exception, match="none of the classes"):
        models.train_fraud(one.withColumn("fraud_flag", F.lit(None).cast("int")).unionByName(one), COLS, "rf")
    with pytest.raises(ValueError, match="no training rows"):
        models.train_fraud(one.where("false"), COLS, "rf")


def test_softmax_margins_are_written_sooner_for_many_rows(spark, monkeypatch):
    """F16: the same trees, whatever the rounds between written margins."""
    from cardlens.operators import boosting
    df, _, _ = rows_of(spark)
    train = df.withColumn("band", F.element_at(F.array(*[F.lit(x) for x in "xyz"]), F.col("y") + 1))
    found = []
    for rows in (10_000, 1):
        monkeypatch.setattr(boosting, "KEEP_ROWS", rows)
        found.append(boosting.train_softmax(train, COLS, boosting.Plan(rounds=3, depth=2), "band", "id", ["x", "y", "z"]).nodes)
    assert found[0] == found[1]
