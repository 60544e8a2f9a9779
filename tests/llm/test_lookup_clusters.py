"""Centroid clustering against a plain version."""

import hashlib
import math
import random

import numpy as np
import pytest
from cardlens.llm import lookup_clusters as lc

SCHEMA = "vec_id long, embedding array<float>, cluster string, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows, dims, clusters, rounds=5):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    points = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(points, key=lambda p: (sha(f"2:{'' if p[0] is None else p[0]}"), p[1]))
    at = [v for _, v in first[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(at))

    for _ in range(rounds):
        groups = {}
        for _, v in points:
            groups.setdefault(near(v)[1], []).append(v)
        for k, vs in groups.items():
            at[k] = [sum(column) // len(vs) for column in zip(*vs)]
    found = [(i, *near(v)[::-1]) for i, v in points]
    sums = {}
    for _, k, d in found:
        sums[k] = sums.get(k, 0) + d
    return sorted(((i, k, d, sums[k], sum(sums.values()), sha(",".join(map(str, at[k])))) for i, k, d in found), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("clusters", [1, 6, 40])
def test_equal_to_plain_version(spark, clusters):
    rng = random.Random(clusters)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]  # one vector with a third of the rows
    rows += [(7, rows[3][1]), (7, rows[7][1]), (None, rows[5][1]), (None, [0.25] * 8)]  # repeated and null ids
    rows += [(2000, None), (2001, []), (2002, [1.0] * 7), (2003, [1.0] * 9), (2004, [None] + [1.0] * 7), (2005, [math.nan] + [1.0] * 7),
             (2006, [math.inf] + [1.0] * 7), (2007, [-0.0] * 8), (2008, [5000.0, -5000.0] + [1e-30] * 6)]
    got = lc.centroid_clusters(frame(spark, rows), dims=8, clusters=clusters)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 8, clusters)


def test_ties_fewer_vectors_and_empty_table(spark):
    few = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])]
    got = lc.centroid_clusters(frame(spark, few), dims=2)
    assert sorted(map(tuple, got.collect()), key=str) == plain(few, 2, 40)
    assert lc.centroid_clusters(frame(spark, few).where("false"), dims=2).collect() == []
    assert lc.centroid_clusters(frame(spark, [(1, None), (2, [1.0])]), dims=2).collect() == []


def test_large_components(spark):
    edge = lc.LARGEST / 256
    rows = [(1, [edge, -edge]), (2, [-edge, edge]), (3, [edge, edge])]
    got = lc.centroid_clusters(frame(spark, rows), dims=2, clusters=1)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 2, 1)
    with pytest.raises(Exception, match="beyond"):
        lc.centroid_clusters(frame(spark, [(1, [1e9, 0.0])]), dims=2)


def test_tables_of_wide_and_narrow_integers():
    rng = np.random.default_rng(1)
    for spread in (1, 300, 1 << 26):
        points = rng.integers(-spread, spread + 1, (50, 9)).astype(np.int32)
        centroids = rng.integers(-spread, spread + 1, (4, 9))
        want = ((points[:, None].astype(object) - centroids[None].astype(object)) ** 2).sum(2)
        assert (lc.squared_distances(points, centroids).astype(object) == want).all()
