"""Search index: pruning, persistence, hot and odd vectors."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlens.operators import features as feat
from cardlens.operators import knn, similar
from cardlens.plans.portfolio import portfolio_table
from cardlens.plans.registry import SIMILARITY_COLS, client_profiles
from cardlens.session import ensure_checkpoint_dir
from conftest import SF0001


def points(n, seed, dims=3):
    rng = np.random.default_rng(seed)
    return [(i, list(map(float, rng.normal(size=dims) + 10 * rng.integers(0, 12, dims)))) for i in range(n)]


def brute(cands, probes, k, metric):
    c = np.array([v for _, v in cands])
    keys = np.array([i for i, _ in cands])
    out = set()
    for p, v in probes:
        if metric == "cosine":
            norms = np.linalg.norm(c, axis=1) * np.linalg.norm(v)
            s = np.round(np.divide(c @ np.array(v), norms, out=np.zeros(len(c)), where=norms > 0), 9)
        else:
            s = -np.round(((c - np.array(v)) ** 2).sum(1), 9)
        out |= {(p, r + 1, int(keys[j])) for r, j in enumerate(np.lexsort((-keys, -s))[:k])}
    return out


def found(df):
    return {(r["probe_key"], r["nn_rank"], r["cand_key"]) for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "sqeuclidean"])
def test_many_leaves_equal_brute_force_and_reload(spark, metric, monkeypatch):
    rows = points(3000, 1) + [(5000 + i, [1.0, 2.0, 0.5]) for i in range(1500)] + [(9000, [0.0] * 3), (9001, [0.0] * 3)]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(5)
    probes = [r for r in rows if r[0] % 37 == 0] + [rows[-1], (-1, [0.0] * 3), (-2, [1e6, 1e6, -1e6]), (-3, [2.0, 4.0, 1.0])]
    asked = spark.createDataFrame(probes, "k long, v array<double>")
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    index = knn.SearchIndex.build(df, "k", "v", 4, metric, path=path, leaf_rows=60)
    want = brute(rows, probes, 4, metric)
    assert len(index.tree.leaves) > 30 and found(index.search(asked, "k", "v", 4)) == want
    monkeypatch.setattr(knn.SearchIndex, "build", None)
    back = knn.SearchIndex.load(spark, path)
    assert found(back.search(asked, "k", "v", 4, slice_rows=256)) == want
    assert found(back.search(asked, "k", "v", 2)) == {w for w in want if w[1] <= 2}
    with pytest.raises(ValueError):
        back.search(asked, "k", "v", 5)


def test_scored_pairs_grow_slower_than_probes_times_candidates(spark):
    scored = []
    for n in (4000, 16_000):
        df = spark.createDataFrame(points(n, 2), "k long, v array<double>")
        index = knn.SearchIndex.build(df, "k", "v", 3, "sqeuclidean", leaf_rows=100)
        assert index.search(df.where("k % 20 = 0"), "k", "v", 3).count() == 3 * n // 20
        scored.append(index.pairs)
    assert scored[1] < 8 * scored[0] and scored[1] < 16_000 * 800 / 8  # 16 times the product


def test_empty_index(spark):
    df = spark.createDataFrame([(1, [1.0])], "k long, v array<double>")
    index = knn.SearchIndex.build(df.where("false"), "k", "v", 2)
    assert index.search(df, "k", "v", 2).collect() == []


def test_saved_recommender_gives_the_same_neighbours_without_a_fit(spark, monkeypatch):
    p = portfolio_table(spark, SF0001, SIMILARITY_COLS)
    prof = client_profiles(spark, SF0001, p)
    path = f"{ensure_checkpoint_dir(spark)}/recommender-{uuid.uuid4().hex}"
    want = sorted(map(tuple, similar.similar_customers(p, prof, 5).select(F.round("similarity", 9), "Client_Num", "sim_rank", "neighbor_txn", "neighbor_client").collect()))
    similar.Recommender.fit(p, path)
    for owner, name in ((knn.SearchIndex, "build"), (similar, "fit_recommender"), (feat, "fit_scaler")):
        monkeypatch.setattr(owner, name, None)
    got = similar.Recommender.load(spark, path).similar(prof, 5)
    assert sorted(map(tuple, got.select(F.round("similarity", 9), "Client_Num", "sim_rank", "neighbor_txn", "neighbor_client").collect())) == want
    part = similar.Recommender.load(spark, path).similar(prof.select("Client_Num", "Income"), 2)  # the rest is imputed
    assert part.count() == 2 * prof.count()


def test_mixed_columns_are_pruned_and_exact(spark):
    """0/1 columns beside numbers, as the SMOTE features are."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(8000, 3)), 2.5 * rng.integers(0, 2, (8000, 9))], 1)
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    index = knn.SearchIndex.build(df, "k", "v", 3, "sqeuclidean", leaf_rows=100)
    probes = [r for r in rows if r[0] % 20 == 0]
    assert found(index.search(df.where("k % 20 = 0"), "k", "v", 3)) == brute(rows, probes, 3, "sqeuclidean")
    assert index.pairs < 8000 * 400 / 10


def test_a_tile_of_buckets_meets_only_what_is_asked():
    import pyarrow as pa
    rng = np.random.default_rng(7)
    x, buckets = knn._unit(rng.normal(size=(900, 5))), rng.integers(0, 12, 900)
    asks = [sorted(rng.choice(14, rng.integers(0, 6), replace=False).tolist()) for _ in range(50)]
    got = knn.top_k_of_buckets("cosine", 4, True, 9, np.arange(50), x[:50], np.full(50, -np.inf), pa.array(asks, pa.list_(pa.int32())),
                               np.arange(900), x, buckets)
    found_, want = {}, {}
    for p, c in zip(got["pid"].to_pylist(), got["cand_key"].to_pylist()):
        found_.setdefault(p, []).append(c)
    for p, ask in enumerate(asks):
        here = np.flatnonzero(np.isin(buckets, ask))
        if len(here):
            want[p] = here[np.lexsort((-here, -np.round(x[here] @ x[p], 9)))[:4]].tolist()
    assert found_ == want


def test_equal_vectors_are_one_whatever_their_zeros_sign(spark):
    """The collapse sorts by a hash of the vector first; 0.0 and -0.0 are equal, and so are NaNs."""
    odd = [[0.0, 1.0, 2.0], [-0.0, 1.0, 2.0], [float("nan"), 1.0, 2.0]]
    rows = [(i, odd[i % 3]) for i in range(60)] + [(100 + i, v) for i, v in points(300, 8)]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(4)
    index = knn.SearchIndex.build(df.where("k < 60"), "k", "v", 4, "sqeuclidean")
    kept = {r["key"] for r in index.placed.collect()}
    assert kept == {58, 57, 55, 54} | {59, 56, 53, 50}  # four of the zeros, four of the NaNs
    index = knn.SearchIndex.build(df.where("k % 3 < 2 OR k > 60"), "k", "v", 4, leaf_rows=40)
    got = {(r["probe_key"], r["nn_rank"]): r["cand_key"] for r in index.search(df.where("k < 2"), "k", "v", 4).collect()}
    assert [got[0, r] for r in range(1, 5)] == [got[1, r] for r in range(1, 5)] == [58, 57, 55, 54]


def test_bundle_works_out_its_profiles_once(spark):
    """the profiles are grouped from the accounts once, and what is left to run reads them."""
    p = portfolio_table(spark, SF0001, SIMILARITY_COLS)
    prof = client_profiles(spark, SF0001, p)
    bundle = similar.recommendation_bundle(prof, p)
    plan = bundle._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct" in prof._jdf.queryExecution().optimizedPlan().toString() and "min(struct" not in plan
    assert bundle.count() == prof.count()
