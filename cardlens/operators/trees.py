"""Forests and boosted trees by MLlib's rules, grown a level at a time for all trees.

MLlib sends a histogram of every node from every partition as a Java object, and each
boosted tree of each band takes its own jobs.  Here features become bins between
quantiles once (``BINS``, MLlib's default) and the binned rows are written.  Boosted
trees of all bands grow together by rounds.py.  A level of all trees of a forest is one job:

1. a task finds the nodes of its rows and adds up whole numbers by (tree, node,
   feature, bin): draws of each class;
2. one shuffle brings the tasks' sums of a block of nodes together, where the best
   splits are found;
3. the driver receives one row a node.  No row and no histogram reaches it.

So the number of tasks, not the number of rows, sets what is shuffled.  The rules are
MLlib's: a forest draws rows by Poisson(1) and ceil(sqrt) of the features a node, splits
by Gini impurity and merges leaves that say the same; boosting fits the labels -1 and 1
first and then residuals of the log loss, by variance, with a share of rows a round and
of features a node.  Grown trees go to MLlib in the form its models are saved in, so
scores, importances and files are MLlib's.  A boosted node's sum of squares is not
kept: its stored impurity is -1.
"""

from __future__ import annotations

import json
import math
import sys
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import delete, own
from . import rounds as together
from .boosting import GROUP_BYTES, Tree, _binary, _matrix, binned, cut_points

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
TASK_ROWS = 20_000  # of one task, at least
PART_ROWS = 1_000_000  # of one task, about, where there are more than the cores take
CHUNK = 1 << 17  # rows that a forest's task counts at once
NODES = 32  # whose sums travel together
KEEP_ROWS = 2_000_000  # of a boosting task in memory, about
SCALE, ROWS = 1 << 18, float(1 << 36)  # a row adds its residual in 1 / SCALE and one of ROWS: exact in doubles for 2**15 rows
KINDS = ("uint8", "uint16", "int32", "int64")  # of the sums that travel: the first that holds them
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
NODE = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
        "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")


def uniform(keys: np.ndarray, number: int) -> np.ndarray:
    """Draws in [0, 1) by hash of the key."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number * 0xD1342543DE82EF95 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


class Grown(Tree):
    """A tree with what its nodes hold: weighted sums, and how many rows."""

    def __init__(self, depth: int, sums: int):
        super().__init__(depth)
        self.sums, self.held = np.zeros((len(self.value), sums)), np.zeros(len(self.value), np.int64)

    def split(self, at: int, feature: int, limit: int, gain: float, sums, held: int, left, left_held: int) -> None:
        self.sums[at], self.held[at] = sums, held
        if feature >= 0:
            self.feature[at], self.bin[at], self.gain[at] = feature, limit, gain
            self.sums[2 * at + 1], self.held[2 * at + 1] = left, left_held
            self.sums[2 * at + 2], self.held[2 * at + 2] = np.subtract(sums, left), held - left_held

    def steps(self) -> Tree:
        """What a task needs of it."""
        out = Tree.__new__(Tree)
        out.feature, out.bin = self.feature, self.bin
        return out


class Coded:
    """Training rows, binned and written: id, class, bins and ``margins`` doubles."""

    def __init__(self, train: DataFrame, features: list[str], y: Column, margins: int = 0):
        spark = train.sparkSession
        self.spark, self.features, self.written = spark, features, 0
        self.root = own(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees/{uuid.uuid4().hex}")
        self.n = train.count()
        if not self.n:
            raise ValueError("there are no training rows")
        self.cuts = cuts = cut_points(train, features, BINS)
        self.widths = np.array([len(c) + 1 for c in cuts])
        rows = train.select(F.monotonically_increasing_id().alias("id"), y.cast("int").alias("y"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))

        def encode(batches):
            for batch in batches:
                x = batch.column(2).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], _binary(binned(x, cuts)), _binary(np.zeros((len(x), margins)))], names=["id", "y", "bins", "margin"])

        self.tasks = min(1 + self.n // TASK_ROWS, max(spark.sparkContext.defaultParallelism, self.n // PART_ROWS))
        self.write(rows.mapInArrow(encode, "id long, y int, bins binary, margin binary").repartition(self.tasks, "id"))

    def write(self, rows: DataFrame) -> None:
        old, self.written = self.written, self.written + 1
        rows.write.parquet(f"{self.root}/{self.written}")
        self.rows = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{self.written}")
        if old:
            delete(self.spark, f"{self.root}/{old}")

    def level(self, sums, splits, width: int, groups: int) -> list:
        """Rows of ``splits`` (nodes, their sums over all rows) where ``sums`` gives each task's as (tree, nodes, counts)."""

        def parts(batches):
            for tree, nodes, counts in sums(batches):
                for block in np.unique(nodes // NODES):
                    of = nodes // NODES == block
                    some = counts[of]
                    kind = next(k for k in KINDS if np.iinfo(k).min <= some.min() and some.max() <= np.iinfo(k).max)
                    yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([block], pa.int32()), pa.array([nodes[of].astype(np.int32).tobytes()], pa.binary()),
                                                      pa.array([kind], pa.string()), pa.array([some.astype(kind).tobytes()], pa.binary())], names=["tree", "block", "nodes", "kind", "counts"])

        def best(group: pa.Table) -> pa.Table:
            tree, block = group.column(0)[0].as_py(), group.column(1)[0].as_py()
            total, seen = np.zeros((NODES, width), np.int64), np.zeros(NODES, bool)
            for nodes, kind, counts in zip(group.column(2), group.column(3), group.column(4)):
                at = np.frombuffer(nodes.as_py(), np.int32) - block * NODES
                total[at] += np.frombuffer(counts.as_py(), kind.as_py()).reshape(-1, width)
                seen[at] = True
            at = np.flatnonzero(seen)
            found = splits(tree, at + block * NODES, total[at])
            kept = [pa.array(c.tolist(), t) for c, (_, t) in zip(found, kinds[2:])]
            return pa.Table.from_arrays([pa.array([tree] * len(at), pa.int32()), pa.array(at + block * NODES, pa.int32()), *kept], schema=schema)

        kinds = (("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()), ("sums", pa.list_(pa.float64())),
                 ("held", pa.int64()), ("left", pa.list_(pa.float64())), ("left_held", pa.int64()))
        schema = pa.schema(kinds)
        made = self.rows.mapInArrow(parts, "tree int, block int, nodes binary, kind string, counts binary").repartition(min(groups, self.spark.sparkContext.defaultParallelism), "tree", "block")
        return made.groupBy("tree", "block").applyInArrow(best, "tree int, node int, feature int, bin int, gain double, sums array<double>, held long, "
                                                                "left array<double>, left_held long").collect()


def _best(columns: np.ndarray, gain: np.ndarray, sums: np.ndarray, held: np.ndarray, left: np.ndarray, left_held: np.ndarray) -> list:
    """What ``Grown.split`` takes after the node, a column each: of gains (node, feature, bin) the greatest, if it is above 0."""
    nodes, _, cuts = gain.shape
    every = np.arange(nodes)
    at = gain.reshape(nodes, -1).argmax(1)
    f, b = at // cuts, at % cuts
    top = gain[every, f, b]
    splits = top > 0
    return [np.where(splits, columns[every, f].astype(np.int32), -1), b, np.where(splits, top, 0.0), sums, held, left[every, f, b], left_held[every, f, b]]


def _subsets(seed: list[int], count: int, features: int, share: int) -> np.ndarray:
    """``share`` of the features for each of ``count`` nodes."""
    return np.sort(np.random.default_rng(seed).random((count, features)).argpartition(share - 1, 1)[:, :share], 1).astype(np.uint8)


def grow_forest(train: DataFrame, features: list[str], y: Column, weights: list[float], trees: int, depth: int, seed: int) -> tuple[list[Grown], list[np.ndarray]]:
    """(trees, cuts) of a forest over the classes 0, 1, ... of ``weights``."""
    coded = Coded(train, features, y)
    classes, width, share = len(weights), int(coded.widths.max()), math.ceil(math.sqrt(len(features)))
    of, grown = np.array(weights), [Grown(depth, len(weights)) for _ in range(trees)]
    for level in range(depth):
        first, count = (1 << level) - 1, 1 << level
        steps, columns = [t.steps() for t in grown], [_subsets([seed, t, level], count, len(features), share) for t in range(trees)]
        if not level:
            going = range(trees)
        else:
            going = [t for t in range(trees) if (grown[t].feature[first >> 1: first] >= 0).any()]

        def sums(batches):
            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            ids, label = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1))
            bins = np.concatenate([_matrix(b.column(2), np.uint8, len(features)) for b in batches])
            batches.clear()
            flat = bins.ravel()
            for t in going:
                total = np.zeros((share, count * width * classes))
                for low in range(0, len(ids), CHUNK):
                    draw = uniform(ids[low: low + CHUNK], seed * 1_000_003 + t)
                    at = np.flatnonzero(draw >= POISSON[0])
                    held = np.searchsorted(POISSON, draw[at], side="right")
                    at += low
                    node = steps[t].nodes(bins[at], level) - first
                    if level:
                        here = np.flatnonzero(node >= 0)
                        at, held, node = at[here], held[here], node[here]
                    place, held, start = node * (width * classes) + label[at], held.astype(np.float64), at * len(features)
                    for j in range(share):  # a column at a time stays in the cache
                        column = columns[t][:, j].astype(np.int64).take(node)
                        total[j] += np.bincount(place + flat.take(start + column) * np.int64(classes), held, total.shape[1])
                total = total.astype(np.int64).reshape(share, count, -1).swapaxes(0, 1).reshape(count, -1)
                some = np.flatnonzero(total.any(1))
                yield t, some, total[some]

        def splits(tree, nodes, total):
            total = total.reshape(len(nodes), share, width, classes)
            left = total.cumsum(2)[:, :, :-1]
            whole = total[:, :1].sum(2, keepdims=True)
            right = whole - left
            fits = (left.sum(3) > 0) & (right.sum(3) > 0)
            (lw, l), (rw, r), (ww, w) = (impurity(s * of) for s in (left, right, whole))
            gain = np.where(fits, w - (lw * l + rw * r) / np.maximum(ww, 1e-300), -1.0)
            return _best(columns[tree][nodes], gain, (whole * of)[:, 0, 0], whole[:, 0, 0].sum(1), left * of, left.sum(3))

        for r in coded.level(sums, splits, share * width * classes, len(going) * -(-count // NODES)):
            grown[r["tree"]].split(first + r["node"], *r[2:])
        if not any((t.feature[first: 2 * first + 1] >= 0).any() for t in grown):
            break
    delete(coded.spark, coded.root)
    for t in grown:
        _merge(t, 0)
    return grown, coded.cuts


def impurity(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, Gini impurity) of class sums in the last axis."""
    weight = sums.sum(-1)
    return weight, 1.0 - (sums ** 2).sum(-1) / np.maximum(weight ** 2, 1e-300)


def _merge(tree: Grown, at: int) -> int:
    """The class that all leaves below ``at`` say, or -1; such nodes become leaves."""
    said = int(tree.sums[at].argmax())
    if tree.feature[at] < 0:
        return said
    below = {_merge(tree, 2 * at + 1), _merge(tree, 2 * at + 2)}
    if len(below) > 1 or -1 in below:
        return -1
    tree.feature[at] = -1
    return below.pop()


class Binary:
    """What rounds.py asks of the models of some classes against the others, each with a weight of either label."""

    weighed, fields = 1, 1

    def __init__(self, features: int, width: int, targets: list[int], weights: list[float], eta: float, depth: int, rows: float, columns: float, seed: int):
        self.features, self.width, self.targets, self.eta, self.depth, self.rows, self.seed = features, width, targets, eta, depth, rows, seed
        self.share = math.ceil(columns * features)
        self.sides, self.of = (1, np.ones(1)) if weights[0] == weights[1] == 1.0 else (2, np.array(weights))

    def tree(self, state: dict | None = None) -> Grown:
        tree = Grown(self.depth, 2)
        tree.__dict__.update(state or {})
        return tree

    def leaves(self, tree: Grown, number: int) -> np.ndarray:
        return np.where(tree.held > 0, tree.sums[:, 1] / np.maximum(tree.sums[:, 0], 1e-300), 0.0) * (self.eta if number else 1.0)

    def drawn(self, keys: np.ndarray, number: int) -> np.ndarray:
        return uniform(keys, self.seed * 1_000_003 + number) < self.rows

    def values(self, number: int, y: np.ndarray, margin: np.ndarray) -> tuple[list, int]:
        sign = np.where(y == np.array(self.targets)[:, None], 1.0, -1.0)
        rest = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin)) if number else sign
        return [np.rint(rest * SCALE)], 0

    def weights(self, values: list) -> list:
        return [values[0] + ROWS]

    def settled(self, found: np.ndarray) -> np.ndarray:
        """(rows, residuals) of sums of weights."""
        held = np.floor(found[0] / ROWS + 0.5)
        return np.stack([held, found[0] - held * ROWS]).astype(np.int64)

    def split(self, number: int, level: int, k: int, tree: Grown, nodes: list[int], total: np.ndarray) -> list[tuple[int, bool]]:
        first = (1 << level) - 1
        held = total[..., 0].sum(3)
        total = (total * self.of[:, None]).sum(3) * np.array([1.0, 1.0 / SCALE])
        whole, n = total[:, :1].sum(2, keepdims=True), held[:, :1].sum(2, keepdims=True)
        chosen = _subsets([self.seed, number, k, level], 1 << level, self.features, self.share)[np.array(nodes) - first]
        every = np.arange(len(nodes))[:, None]
        left, left_held = total[every, chosen].cumsum(2)[:, :, :-1], held[every, chosen].cumsum(2)[:, :, :-1]
        right = whole - left
        fits = (left_held > 0) & (left_held < n)
        mean = [s[..., 1] ** 2 / np.where(s[..., 0] > 0, s[..., 0], 1.0) for s in (left, right, whole)]
        gain = np.where(fits, (mean[0] + mean[1] - mean[2]) / whole[..., 0], -1.0)
        gain[gain < 1e-15] = -1.0  # rounding is no gain
        found = list(zip(nodes, *(c.tolist() for c in _best(chosen, gain, whole[:, 0, 0], n[:, 0, 0], left, left_held))))
        for r in found:
            tree.split(*r)
        return [(at, 2 * left <= all_held) for at, feature, _, _, _, all_held, _, left in found if feature >= 0]


def grow_boosted(train: DataFrame, features: list[str], y: Column, targets: list[int], weights: list[float], rounds: int, eta: float, depth: int,
                 rows: float, columns: float, seed: int) -> tuple[list[list[Grown]], list[np.ndarray]]:
    """(trees of each target, cuts): for each class of ``targets`` a model of it against the others, with a weight of either label."""
    n = train.count()
    if not n:
        raise ValueError("there are no training rows")
    cuts = cut_points(train, features, BINS)
    objective = Binary(len(features), max(len(c) + 1 for c in cuts), targets, weights, eta, depth, rows, columns, seed)
    done, _ = together.run(train, F.monotonically_increasing_id(), y.cast("int"), [F.col(c).cast("double") for c in features], n, cuts, binned, objective, rounds,
                           KEEP_ROWS, GROUP_BYTES)
    return [[trees[k] for trees in done] for k in range(len(targets))], cuts


def as_mllib(spark, estimator, model_class, trees: list[Grown], cuts: list[np.ndarray], weights: list[float], classes: int):
    """The trees as a fitted model of MLlib's, by way of the form such models are saved in."""
    forest = classes > 0
    path = own(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees/{uuid.uuid4().hex}")
    params = [{p.name: estimator.getOrDefault(p) for p in estimator.params if has(p)} for has in (estimator.isSet, estimator.hasDefault)]

    def described(kind, given, defaults, **more):
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                           "uid": f"{kind.split('.')[1]}_{uuid.uuid4().hex[:12]}", "paramMap": given, "defaultParamMap": defaults, **more})

    kind = "classification.RandomForestClassificationModel" if forest else "classification.GBTClassificationModel"
    more = {"numFeatures": len(cuts), "numTrees": len(trees), **({"numClasses": classes} if forest else {})}
    of_tree = "classification.DecisionTreeClassificationModel" if forest else "regression.DecisionTreeRegressionModel"
    spark.createDataFrame([(described(kind, *params, **more),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, described(of_tree, {"impurity": "gini" if forest else "variance"}, {}), w) for i, w in enumerate(weights)],
                          "treeID int, metadata string, weights double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    rows = []
    for i, tree in enumerate(trees):
        numbers, order, stack = {}, [], [0]
        while stack:  # parents before children, the left side first
            at = stack.pop()
            numbers[at] = len(order)
            order.append(at)
            if tree.feature[at] >= 0:
                stack += [2 * at + 2, 2 * at + 1]
        for at in order:
            sums, f = tree.sums[at], int(tree.feature[at])
            said = float(sums.argmax()) if forest else float(sums[1] / (sums[0] or 1.0))
            stats = sums.tolist() if forest else [float(sums[0]), float(sums[1]), float(sums[1] ** 2 / (sums[0] or 1.0))]
            below = (numbers[2 * at + 1], numbers[2 * at + 2]) if f >= 0 else (-1, -1)
            rows.append((i, (numbers[at], said, float(impurity(sums)[1]) if forest else -1.0, stats, int(tree.held[at]), float(tree.gain[at]) if f >= 0 else -1.0, *below,
                             (f, [float(cuts[f][tree.bin[at]])] if f >= 0 else [], -1))))
    spark.createDataFrame(rows, NODE, verifySchema=False).coalesce(1).write.parquet(f"{path}/data")
    return model_class.load(path)
