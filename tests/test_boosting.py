"""Joint boosting, split counts and the model store."""

import re
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlens.operators import boosting, metrics, models
from cardlens.operators.model_store import ModelStore, fingerprint
from cardlens.plans import training
from cardlens.session import ensure_checkpoint_dir
from conftest import SF0001


@pytest.fixture(scope="module")
def sets(spark):
    return training.credit_sets(spark, SF0001)


@pytest.fixture(scope="module")
def softmax(sets):
    tr, _, cols, stats, levels = sets
    return boosting.train_softmax(tr, cols, boosting.Plan(rounds=8), scaler=stats, levels=levels)


def accuracy(model, rows):
    return metrics.accuracy(model.predict(rows), "credit_score_band", "credit_score_band_pred").first()[0]


def test_loss_falls_and_no_worse_than_one_versus_rest(sets, softmax):
    tr, te, cols, _, _ = sets
    assert len(softmax.losses) == 8 and abs(softmax.losses[0] - np.log(4)) < 1e-4
    assert all(a > b for a, b in zip(softmax.losses, softmax.losses[1:]))
    apart = models.train_credit(tr, cols, "gbt", rounds=8)
    assert accuracy(softmax, te) >= accuracy(apart, te) - 0.01
    got, majority = training.beats_majority(softmax, te)
    assert got > majority


def test_one_round_equals_plain_newton_trees(spark):
    """No sampling, few rows: the trees of one round are those of an exhaustive search."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (200, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] > 5).astype(int) + (x[:, 2] > 3)
    rows = [(i, *map(float, r), "abc"[k]) for i, (r, k) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, band string").repartition(3)
    plan = boosting.Plan(rounds=1, depth=2, rows=1.0, columns=1.0)
    m = boosting.train_softmax(df, ["a", "b", "c"], plan, "band", "id", ["a", "b", "c"])

    def grow(rows, k, node, depth, out):
        g, h = ((1 / 3) - (y[rows] == k)).sum(), len(rows) * 2 * (1 / 3) * (2 / 3)
        best = (1e-9, None, None)
        for f in range(3) if depth else ():
            for cut in np.unique(x[:, f])[:-1]:
                left = x[rows, f] <= cut
                if not left.any() or left.all():
                    continue
                parts = [((1 / 3 - (y[r] == k)).sum(), len(r) * 4 / 9) for r in (rows[left], rows[~left])]
                if min(p[1] for p in parts) < 1:
                    continue
                gain = (sum(a * a / (b + 1) for a, b in parts) - g * g / (h + 1)) / 2
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
        if best[1] is None:
            out[node] = (None, None, -0.1 * g / (h + 1))
            return out
        out[node] = (best[1], best[2], None)
        left = x[rows, best[1]] <= best[2]
        grow(rows[left], k, 2 * node + 1, depth - 1, out)
        return grow(rows[~left], k, 2 * node + 2, depth - 1, out)

    for k in range(3):
        want = grow(np.arange(200), k, 0, 2, {})
        got = {n: (f if f >= 0 else None, t, v) for _, c, n, f, t, v, _, _ in m.nodes if c == k}
        assert got.keys() == want.keys()
        for node, (f, t, v) in want.items():
            assert got[node][:2] == (f, t) and (v is None or abs(got[node][2] - v) < 1e-5)


def test_same_trees_whatever_the_partitions(sets, monkeypatch):
    """With the same bins: the sketch of the quantiles alone depends on the partitions."""
    tr, _, cols, _, _ = sets
    plan, cuts = boosting.Plan(rounds=2, depth=3), boosting.cut_points(tr, cols)
    monkeypatch.setattr(boosting, "cut_points", lambda *_: cuts)
    a, b = (boosting.train_softmax(tr.repartition(n), cols, plan).nodes for n in (1, 7))
    assert a == b


def test_small_groups_of_histograms(sets, monkeypatch):
    """Blocks of features and several slots give the same trees."""
    tr, _, cols, _, _ = sets
    plan = boosting.Plan(rounds=1, depth=3)
    whole = boosting.train_softmax(tr, cols, plan).nodes
    monkeypatch.setattr(boosting, "GROUP_BYTES", 2000)
    assert boosting.train_softmax(tr, cols, plan).nodes == whole


def test_softmax_round_trip_and_odd_rows(spark, sets, softmax):
    _, te, cols, _, _ = sets
    back = training.reloaded(softmax, spark)
    a, b = (sorted(tuple(r) for r in m.predict(te).select("Txn_Id", "credit_score_band_pred", "probability").collect()) for m in (softmax, back))
    assert a == b and back.losses == softmax.losses
    odd = te.limit(3).withColumn(cols[0], F.lit(None).cast("double"))
    assert softmax.predict(odd).where("probability > 0").count() == 3
    with pytest.raises(models.MissingFeatures):
        softmax.predict(te.drop(cols[0]))


def test_unknown_label_and_no_rows(sets):
    tr, te, cols, _, _ = sets
    with pytest.raises(Exception, match="none of the classes"):
        boosting.train_softmax(tr.withColumn("credit_score_band", F.lit("Odd")), cols, boosting.Plan(rounds=1))


def test_split_counts_equal_the_tree_dump(spark, sets, softmax):
    tr, _, cols, _, _ = sets
    fraud, _ = training.fit_fraud(spark, SF0001, "gbt", rounds=2)
    for m in (models.train_credit(tr, cols, "gbt", rounds=1), fraud):
        dump = Counter(m.features[int(k)] for s in m.stages for k in re.findall(r"If \(feature (\d+) ", s.stages[-1].toDebugString))
        got = {r["feature"]: r["importance"] for r in m.split_importance(spark).collect()}
        assert got == {f: dump.get(f, 0) for f in m.features}
    used = Counter(softmax.features[n[3]] for n in softmax.nodes if n[3] >= 0)
    assert {r["feature"]: r["importance"] for r in softmax.split_importance(spark).collect()} == {f: used.get(f, 0) for f in softmax.features}
    gains = [r["importance"] for r in softmax.feature_importance(spark).collect()]
    assert abs(sum(gains) - 1) < 1e-9 and gains == sorted(gains, reverse=True)


def test_store_trains_once_and_again_for_other_features(spark, sets):
    tr, te, cols, stats, levels = sets
    store, calls = ModelStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"), []

    def fit(rows, features):
        version = store.version("credit", "softmax", rows, ["Txn_Id", "credit_score_band", *features], rounds=2)

        def train():
            calls.append(version)
            return boosting.train_softmax(rows, features, boosting.Plan(rounds=2, depth=2), scaler=stats, levels=levels)

        return store.load_or_train(version, train)

    assert store.versions() == []
    first, trained = fit(tr, cols)
    again, trained_again = fit(tr.repartition(3), cols)
    assert (trained, trained_again, len(calls)) == (True, False, 1) and again.nodes == first.nodes
    assert fit(tr, cols[:-1])[1] and fit(tr.where("Txn_Id % 50 <> 0"), cols)[1]
    changed = tr.withColumn(cols[0], F.when(F.col("Txn_Id") == tr.first()["Txn_Id"], 9.0).otherwise(F.col(cols[0])))
    assert fit(changed, cols)[1] and len(store.versions()) == len(calls) == 4
    with pytest.raises(KeyError):
        store.load("none")


def test_unpublished_and_twice_published_versions(spark, softmax):
    path = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    store = ModelStore(spark, path)
    softmax.save(f"{path}/half")  # saved without its marker
    assert not store.has("half") and store.versions() == []
    for _ in range(2):
        store.publish("whole", softmax.save)
    assert store.versions() == ["whole"] and store.load("whole").nodes == softmax.nodes
    at, fs = store._at(path)
    assert sorted(s.getPath().getName() for s in fs.listStatus(at)) == ["half", "whole"]


def test_fingerprint_is_of_the_multiset(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k long, v string")
    assert fingerprint(a, ["k", "v"]) == fingerprint(a.orderBy(F.desc("k")), ["k", "v"])
    assert fingerprint(a, ["k", "v"]) != fingerprint(a.distinct(), ["k", "v"])
    assert fingerprint(a.where("false"), ["k", "v"]) != fingerprint(a, ["k", "v"])


def test_last_bits_of_the_scaler_make_no_other_version(spark, monkeypatch):
    """sums of doubles depend on the order in which tasks end."""
    from cardlens.operators import features
    store, fit = ModelStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"), features.fit_scaler
    assert training.stored_credit(spark, SF0001, "softmax", rounds=1, store=store)[2]
    monkeypatch.setattr(features, "fit_scaler", lambda *a: {c: (float(np.nextafter(m, 9e9)), float(np.nextafter(s, 9e9))) for c, (m, s) in fit(*a).items()})
    assert not training.stored_credit(spark, SF0001, "softmax", rounds=1, store=store)[2]
    assert training.stored_credit(spark, SF0001, "softmax", rounds=1, fit_on="train", store=store)[2]


@pytest.mark.parametrize("kind", ["binary", "softmax"])
def test_one_task_and_many_grow_the_same_trees(spark, monkeypatch, kind):
    """Rounds by one task, and by a job a level over kept chunks, whose sums come to the driver or are added up before."""
    from cardlens.operators import rounds, trees
    rng = np.random.default_rng(3)
    x = rng.integers(0, 7, (400, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] > 6).astype(int) + (x[:, 2] > 4) * (rng.random(400) < 0.8)
    df = spark.createDataFrame([(i, *map(float, r), int(k), "abc"[k]) for i, (r, k) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int, band string").coalesce(1)

    def fit():
        if kind == "softmax":
            m = boosting.train_softmax(df, ["a", "b", "c"], boosting.Plan(rounds=4, depth=3), "band", "id", ["a", "b", "c"])
            return m.nodes, m.losses
        found, _ = trees.grow_boosted(df, ["a", "b", "c"], F.col("y"), [0, 2], [1.0, 2.5], 4, 0.1, 3, 0.8, 0.8, 42)
        return [(t.feature.tolist(), t.bin.tolist(), t.sums.tolist(), t.held.tolist()) for part in found for t in part]

    alone = fit()
    for name, value in (("FIT_ROWS", 0), ("TASK_ROWS", 150), ("SAVED", 2), ("CHUNK", 64), ("MOST", 128)):
        monkeypatch.setattr(rounds, name, value)
    assert fit() == alone
    monkeypatch.setattr(boosting, "GROUP_BYTES", 1)
    monkeypatch.setattr(trees, "GROUP_BYTES", 1)
    assert fit() == alone


def test_packed_columns_keep_their_sums():
    from cardlens.operators.rounds import Packing
    rng, widths = np.random.default_rng(1), [2, 31, 2, 3, 1, 2, 7, 2]
    p = Packing(widths)
    bins = np.stack([rng.integers(0, w, 500) for w in widths], 1).astype(np.uint8)
    packed = p.pack(bins)
    assert packed.shape[1] < len(widths) and all((p.digits(f)[packed[:, p.of[f]]] == bins[:, f]).all() for f in range(len(widths)))
    joint = np.stack([np.bincount(packed[:, g], minlength=p.width) for g in range(packed.shape[1])])
    got = p.unpacked(joint[None, :, None, None, :])[0, :, :, 0, 0]
    assert all((got[f] == np.bincount(bins[:, f], minlength=max(widths))).all() for f in range(len(widths)))
