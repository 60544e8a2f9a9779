"""Joint multiclass gradient boosting with softmax gradients.

One tree a class and round, all classes on the same probabilities.  Features become
bins between quantiles once, and rounds.py runs the rounds on binned rows that are
kept.  Gradients and Hessians are whole numbers of ``1 / UNIT``, so that sums by (tree,
node, feature, bin) do not depend on their order and a task that is run again after a
lost executor changes nothing.  No row reaches the driver.

A node that no split improves is a leaf with the Newton step ``-G / (H + l2)``.
Each tree draws its columns, each round its rows, by hash of the row key.
"""

from __future__ import annotations

import json
import os
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from . import rounds as together
from .models import SEED, FittedModel, check_features, write_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = 1 << 20  # gradients are counted in 1 / UNIT
KEEP_ROWS = 2_000_000  # of a task in memory, about
BINS = 64
GROUP_BYTES = 64 << 20  # tasks' sums that come to the driver at once
ROWS = "round int, class int, node int, feature int, threshold double, value double, gain double, cover double"


@dataclass(frozen=True)
class Plan:
    """What a fit is asked for."""

    rounds: int = 100
    eta: float = 0.1
    depth: int = 6
    rows: float = 0.8
    columns: float = 0.8
    least_hessian: float = 1.0
    l2: float = 1.0
    seed: int = SEED


class Tree:
    """One tree as a heap: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, depth: int):
        size = (1 << (depth + 1)) - 1
        self.feature = np.full(size, -1, np.int16)  # -1: leaf
        self.bin = np.zeros(size, np.int16)
        self.value = np.zeros(size)
        self.gain, self.cover = np.zeros(size), np.zeros(size)

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` steps; rows stay in a leaf."""
        # a leaf is its own child, and no bin is greater than 255
        inner = self.feature >= 0
        column = np.where(inner, self.feature, 0).astype(np.int64)
        limit = np.where(inner, self.bin, 255).astype(np.uint8)
        every = np.arange(len(inner))
        kid = np.where(inner, 2 * every + 1, every)
        at = np.zeros(len(bins), np.int64)
        flat, start = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        for _ in range(levels):
            at = kid.take(at) + (flat.take(start + column.take(at)) > limit.take(at))
        return at


def cut_points(df: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Greatest values of all bins but the last, a column at a time: quantiles
    by Spark's bounded sketch, with the least value, so that a column of two
    values has both in bins of their own."""
    found = df.approxQuantile(columns, [i / bins for i in range(bins + 1)], 0.25 / bins)
    return [np.unique(np.array(q, np.float64))[:-1] for q in found]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, values[:, j], side="left") for j, c in enumerate(cuts)], 1).astype(np.uint8)


def probabilities(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def drawn(keys: np.ndarray, plan: Plan, number: int) -> np.ndarray:
    """Which rows round ``number`` uses."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((plan.seed * 1_000_003 + number) % (1 << 63))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) < plan.rows * (1 << 53)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.nbytes // max(1, len(rows)))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0]: at[-1]].view(kind).reshape(-1, width) if len(column) else np.zeros((0, width), kind)


class Softmax:
    """What rounds.py asks of a joint model of all classes."""

    weighed, fields, sides = 2, 2, 1

    def __init__(self, classes: int, widths: list[int], plan: Plan):
        self.plan, self.targets, self.depth = plan, list(range(classes)), plan.depth
        self.inner = np.arange(max(widths) - 1) < np.array(widths)[:, None] - 1  # limits that a feature has

    def tree(self, state: dict | None = None) -> Tree:
        tree = Tree(self.depth)
        tree.__dict__.update(state or {})
        return tree

    def leaves(self, tree: Tree, number: int) -> np.ndarray:
        return tree.value

    def drawn(self, keys: np.ndarray, number: int) -> np.ndarray:
        return drawn(keys, self.plan, number)

    def values(self, number: int, y: np.ndarray, margin: np.ndarray) -> tuple[list, int]:
        p = probabilities(margin.T)
        loss = int(np.rint(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-15)) * UNIT).sum())
        p = np.ascontiguousarray(p.T)
        hit = y == np.array(self.targets)[:, None]
        return [np.rint((p - hit) * UNIT), np.rint(np.maximum(2.0 * p * (1.0 - p), 1e-6) * UNIT)], loss

    def weights(self, values: list) -> list:
        return [v.astype(np.float64) for v in values]  # whole numbers below 2**53: exact in doubles

    def settled(self, found: np.ndarray) -> np.ndarray:
        return found.astype(np.int64)

    def split(self, number: int, level: int, k: int, tree: Tree, nodes: list[int], total: np.ndarray) -> list[tuple[int, bool]]:
        plan, features = self.plan, len(self.inner)
        rng = np.random.default_rng([plan.seed, number])
        share = max(1, int(plan.columns * features))
        own = [np.sort(rng.choice(features, share, replace=False)) for _ in self.targets][k]
        total = total[:, :, :, 0][:, own]
        whole = total[:, :1].sum(2, keepdims=True)
        left = total.cumsum(2)[:, :, :-1]
        right = whole - left
        fits = (left[..., 1] >= plan.least_hessian * UNIT) & (right[..., 1] >= plan.least_hessian * UNIT) & self.inner[own]

        def score(s):
            return (s[..., 0] / UNIT) ** 2 / (s[..., 1] / UNIT + plan.l2) / 2

        gain = np.where(fits, score(left) + score(right) - score(whole), 0.0).reshape(len(nodes), -1)
        split = []
        for i, (node, at) in enumerate(zip(nodes, gain.argmax(1) if gain.size else [0] * len(nodes))):
            (g, h), best = whole[i, 0, 0], gain[i, at] if gain.size else 0.0
            self._leaf(tree, node, g, h)
            if best > 0.0:
                f, b = divmod(int(at), left.shape[2])
                tree.feature[node], tree.bin[node], tree.gain[node] = own[f], b, best
                left_g, left_h = left[i, f, b]
                self._leaf(tree, 2 * node + 1, left_g, left_h)
                self._leaf(tree, 2 * node + 2, g - left_g, h - left_h)
                split.append((node, bool(2 * left_h <= h)))
        return split

    def _leaf(self, tree: Tree, at: int, g: int, h: int) -> None:
        tree.value[at] = -self.plan.eta * (g / UNIT) / (h / UNIT + self.plan.l2)
        tree.cover[at] = h / UNIT


def rows_of_trees(done: list[list[Tree]], cuts: list[np.ndarray]) -> list[tuple]:
    """Nodes that hold rows, as tuples of ``ROWS``."""
    out = []
    for number, trees in enumerate(done):
        for k, tree in enumerate(trees):
            for node in np.flatnonzero(tree.cover > 0):
                f = int(tree.feature[node])
                out.append((number, k, int(node), f, float(cuts[f][tree.bin[node]]) if f >= 0 else None,
                            float(tree.value[node]) if f < 0 else None, float(tree.gain[node]), float(tree.cover[node])))
    return out


class SoftmaxModel(FittedModel):
    """A fitted joint model; ``nodes`` are its trees as tuples of ``ROWS``."""

    def __init__(self, features, labels, nodes, losses, scaler=None, levels=None):
        super().__init__("credit", "softmax", features, labels, [], scaler, levels)
        self.nodes, self.losses = nodes, losses  # losses: mean log-loss of the training rows before each round

    def class_probabilities(self, df: DataFrame) -> DataFrame:
        check_features(df, self.features)
        score = _scorer(self.nodes, len(self.labels))
        udf = F.pandas_udf(score, "array<double>")
        return df.withColumn("probs", udf(*[F.col(c).cast("double") for c in self.features]))

    def feature_importance(self, spark) -> DataFrame:
        """E16 by gain: a feature's share of all gain."""
        rows = self.tree_rows(spark).where("feature IS NOT NULL").groupBy("feature").agg(F.sum("gain").alias("gain"))
        return self._over_features(spark, rows, "gain", "importance", share=True)

    def tree_rows(self, spark) -> DataFrame:
        names = F.array(*[F.lit(c) for c in self.features])
        rows = spark.createDataFrame(self.nodes, ROWS)
        return rows.select((F.col("round") * len(self.labels) + F.col("class")).alias("tree"), "node",
                           F.when(F.col("feature") >= 0, F.get(names, "feature")).alias("feature"), F.col("threshold").alias("split"), "gain")

    def save(self, path: str) -> None:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(self.nodes, ROWS).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "trees"))
        write_text(path, "meta.json", json.dumps({"kind": self.kind, "features": self.features, "labels": self.labels, "losses": self.losses,
                                                  "scaler": self.scaler, "levels": self.levels}))

    @classmethod
    def restore(cls, path: str, meta: dict) -> "SoftmaxModel":
        from pyspark.sql import SparkSession
        rows = SparkSession.getActiveSession().read.schema(ROWS).parquet(os.path.join(path, "trees")).collect()  # the model itself
        return cls(meta["features"], meta["labels"], sorted(map(tuple, rows), key=lambda r: r[:3]), meta["losses"],
                   {k: tuple(v) for k, v in meta["scaler"].items()}, meta["levels"])


def _scorer(nodes: list[tuple], classes: int):
    """Series of features -> class probabilities."""
    trees: dict[tuple[int, int], dict] = {}
    for number, k, node, f, threshold, value, _, _ in nodes:
        trees.setdefault((number, k), {})[node] = (f, threshold, value)

    def heap(tree: dict):
        size = max(tree) + 1
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        for node, (f, t, v) in tree.items():
            feature[node], threshold[node], value[node] = f, t or 0.0, v or 0.0
        return feature, threshold, value, size.bit_length()

    packed = [(k, *heap(tree)) for (_, k), tree in sorted(trees.items())]

    def score(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(np.float64) for c in columns], 1)
        every, margins = np.arange(len(x)), np.zeros((len(x), classes))
        for k, feature, threshold, value, depth in packed:
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + ~(x[every, f] <= threshold[at]), at)
            margins[:, k] += value[at]
        return pd.Series(list(probabilities(margins)))

    return score


def train_softmax(train: DataFrame, features: list[str], plan: Plan = Plan(), label_col: str = "credit_score_band", key_col: str = "Txn_Id",
                  labels: list[str] | None = None, scaler: dict | None = None, levels: dict | None = None, bins: int = BINS) -> SoftmaxModel:
    """E3 jointly: a model of all bands.  Null features go to the greatest bin,
    as they do in scoring; a label that is no class is an error."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    labels = list(labels or rules.BANDS)
    cuts, n = cut_points(train, features, bins), train.count()
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label_col)) - 1
    bad = F.raise_error(F.concat(F.lit(f"{label_col} is none of the classes: "), F.coalesce(F.col(label_col).cast("string"), F.lit("null"))))
    done, losses = together.run(train, F.coalesce(F.col(key_col).cast("long"), F.lit(0)), F.when(number >= 0, number).otherwise(bad).cast("int"),
                                [F.col(c).cast("double") for c in features], n, cuts, binned, Softmax(len(labels), [len(c) + 1 for c in cuts], plan),
                                plan.rounds if n else 0, KEEP_ROWS, GROUP_BYTES)
    return SoftmaxModel(features, labels, rows_of_trees(done, cuts), [loss / UNIT / n for loss in losses], scaler, levels)
