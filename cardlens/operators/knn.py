"""Exact top-k neighbours between a probe table and a candidate table.

No probe or candidate passes through the driver, and nothing that grows with
the data is broadcast.  The plan:

1. *Collapse.*  Equal vectors are one vector.  Of candidates with one vector
   only the best k + 1 keys can be anyone's neighbours (ties go by key), so the
   others are dropped by a group limit, partial before the shuffle.  Probes
   with one vector share one search.
2. *Cells.*  Candidates go to the leaves of a binary tree, each node cut in two at the
   mean of the column whose cut takes most variance away (a 0/1 column is cut
   between its values).  The tree is fitted on a hash sample, the driver's part; it
   only steers pruning.  A node knows the box of its rows (least and greatest
   value of each column).  Placed rows and tree are written: a ``SearchIndex``.
3. *First pass.*  A probe is scored in its own cell, which gives a bound on
   its k-th score.
4. *Second pass.*  A probe goes down the tree where the box can hold a row
   as good as that bound, and to every cell it reaches; all of them if the first
   pass found fewer than k.
5. A tile, one slice of a cell with one share of the probes that ask it, is a grouped
   Arrow function in numpy.  It cuts its rows into blocks by the same rule, scores a
   probe in the block nearest to it and then in those whose box can still hold a better
   row, and emits k rows a probe at most.  ``row_number() <= k`` over the probe
   merges them, limited before the shuffle.  A probe travels once a cell it asks,
   whatever it is scored with there.

A candidate table that fits in one tile is scored whole, without written tables.

Scores are rounded to ``round_digits`` before ranking so that ties and
near-ties rank identically in any engine; remaining ties are broken by the
candidate key (descending or ascending).
"""

from __future__ import annotations

import heapq
import itertools
import json
import sys
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import materialize, own

# The scoring functions below run inside Python workers.  Ship them by
# value so executors need only numpy and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_BUDGET = 1_000_000  # probe x candidate cells scored at once per task
MAX_LEAVES = 16_384
LEAF_ROWS = (512, 16_384)  # of a cell: as many as leave two cells a core, within these
SAMPLE_ROWS = 32_768  # that the tree is fitted on, at most (on average over a hash)
BLOCK_ROWS = 256  # of a block within a tile
FEW = 4096  # candidates that are one tile
SLICE_ROWS = 16_384  # candidates, and probes, of one tile at most (on average over a hash)
SCORED_ARROW = pa.schema([("pid", pa.int64()), ("cand_key", pa.int64()), ("score", pa.float64()), ("rank_score", pa.float64())])
F32_EPS = float(np.finfo(np.float32).eps)


def _stack(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow column of lists without nulls, of one length."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_lists(c) if c.ndim == 2 else pa.array(c) for c in columns.values()], names=list(columns))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    return np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)


def _exact_sq(pb: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """Squared distances summed left to right over dimensions (as SQL adds)."""
    acc = (pb[..., 0] - cb[..., 0]) ** 2
    for j in range(1, pb.shape[-1]):
        acc = acc + (pb[..., j] - cb[..., j]) ** 2
    return acc


def _f32_bound(dims: int) -> float:
    """Bound on |float32 dot - exact dot| per unit of |p||c| (inputs rounded
    to float32, then a d-term sum), with a factor-2 safety margin."""
    return 2.0 * (dims + 2) * F32_EPS


def _cut(x: np.ndarray):
    """(column, value) whose cut ``<= value`` takes most variance away, the value
    being the column's mean; None if all rows are equal."""
    n, total = len(x), x.sum(0)
    low = x <= total / n
    n_low, sum_low = low.sum(0), np.where(low, x, 0.0).sum(0)
    fits = (n_low > 0) & (n_low < n)
    with np.errstate(all="ignore"):
        gain = np.where(fits, n_low * (n - n_low) * (sum_low / n_low - (total - sum_low) / (n - n_low)) ** 2, 0.0)
    gain[~np.isfinite(gain)] = 0.0
    j = int(gain.argmax())
    return (j, total[j] / n) if gain[j] > 0 else None


def _blocks(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of ``x`` in blocks of ``size`` at most, near rows together."""
    open_, out = [np.arange(len(x))], []
    while open_:
        rows = open_.pop()
        cut = _cut(x[rows]) if len(rows) > size else None
        if cut is None:
            out += [rows[i: i + size] for i in range(0, len(rows), size)]
            continue
        low = x[rows, cut[0]] <= cut[1]
        open_ += [rows[low], rows[~low]]
    return out


def _outside(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``x`` to each box."""
    out = np.zeros((len(x), len(lo)))
    for j in range(x.shape[1]):
        at = x[:, j, None]
        out += np.square(np.maximum(np.maximum(lo[None, :, j] - at, at - hi[None, :, j]), 0.0))
    return out


def _reachable(sq: np.ndarray, cosine: bool, zero: np.ndarray) -> np.ndarray:
    """Best possible score at a squared distance of ``sq`` at least; ``zero`` marks
    zero vectors, whose similarity is 0 with all (of cosine; others are unit vectors)."""
    return np.where(zero, 0.0, 1.0 - sq / 2.0) if cosine else -sq


def _least(worst: np.ndarray) -> np.ndarray:
    """``worst`` with room for its rounding."""
    return worst - 1e-6 * (1.0 + np.abs(np.where(np.isfinite(worst), worst, 0.0)))


class _Tile:
    """Candidates of one tile in blocks, and the best of them for each probe so far."""

    def __init__(self, metric: str, k: int, key_desc: bool, digits: int, pids, probes, worst, ckeys, cands):
        self.metric, self.k, self.key_desc, self.digits = metric, k, key_desc, digits
        self.pids, self.probes, self.ckeys, self.cands = pids, probes, ckeys, cands
        self.small = probes.astype(np.float32)
        self.bound = np.array(worst, np.float64)  # of the rank_score: what is less is nobody's neighbour
        self.best = np.full((len(pids), k), -np.inf)
        self.found = [[], [], [], []]

    def _shortlist(self, at: np.ndarray, cands: np.ndarray):
        """(rows, columns) of every pair that may be among the row's k best after
        exact recomputation and no worse than its bound: a float32 screen with a
        proven margin."""
        pb, k = self.probes[at], min(self.k, len(cands))
        bound = _f32_bound(pb.shape[1])
        screen = self.small[at] @ cands.astype(np.float32).T
        if self.metric == "cosine":
            margin = 2.0 * bound + 2.0 * 10.0 ** -self.digits
        else:
            pn, cn = np.einsum("ij,ij->i", pb, pb), np.einsum("ij,ij->i", cands, cands)
            screen *= np.float32(2.0)  # minus the squared distance, so that larger is better here too
            screen -= cn.astype(np.float32)[None, :]
            screen -= pn.astype(np.float32)[:, None]
            margin = 4.0 * 10.0 ** -self.digits + 2.0 * bound * (np.sqrt(pn) + np.sqrt(cn.max())) ** 2 + 1e-30
        least = self.bound[at]
        open_ = np.flatnonzero(~np.isfinite(least))
        if len(open_):
            place = screen.shape[1] - k
            least[open_] = np.partition(screen[open_], place, axis=1)[:, place]
        return np.nonzero(screen >= (least - margin).astype(np.float32)[:, None])

    def score(self, at: np.ndarray, block: np.ndarray) -> None:
        """Score the probes ``at`` with the candidates ``block``."""
        cands = self.cands[block]
        step = max(1, CELL_BUDGET // max(1, len(block)))
        for s in range(0, len(at), step):
            part = at[s: s + step]
            rows, cols = self._shortlist(part, cands)
            pb = self.probes[part[rows]]
            if self.metric == "cosine":
                score = np.einsum("ij,ij->i", pb, cands[cols])
                rank = np.round(score, self.digits)
            else:
                score = _exact_sq(pb, cands[cols])
                rank = -np.round(score, self.digits)
            keys = self.ckeys[block[cols]]
            order = np.lexsort((-keys if self.key_desc else keys, -rank, rows))
            order = order[rank[order] >= self.bound[part[rows[order]]]]
            rows, keys, score, rank = rows[order], keys[order], score[order], rank[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep = place < self.k
            rows, place = rows[keep], place[keep]
            for held, values in zip(self.found, (part[rows], keys[keep], score[keep], rank[keep])):
                held.append(values)
            new = np.full((len(part), self.k), -np.inf)
            new[rows, place] = rank[keep]
            self.best[part] = np.sort(np.concatenate([self.best[part], new], 1), 1)[:, self.k:]
            self.bound[part] = np.maximum(self.bound[part], self.best[part, 0])

    def sweep(self, blocks: list[np.ndarray], asked: np.ndarray | None = None) -> pa.Table:
        """Each probe meets the blocks it asks (all without ``asked``): the one
        that can hold the best row, then those that can still hold a better one."""
        cosine = self.metric == "cosine"
        step = max(1, 4 * CELL_BUDGET // max(1, len(blocks)))
        lo = np.stack([self.cands[b].min(0) for b in blocks])
        hi = np.stack([self.cands[b].max(0) for b in blocks])
        # similarity with a zero vector is 0 wherever it lies
        zeros = np.array([cosine and not self.cands[b].any(1).all() for b in blocks])
        for s in range(0, len(self.pids), step):
            at = np.arange(s, min(s + step, len(self.pids)))
            x = self.probes[at]
            reach = _reachable(_outside(x, lo, hi), cosine, ~x.any(1)[:, None])
            if zeros.any():
                reach[:, zeros] = np.maximum(reach[:, zeros], 0.0)
            if asked is not None:
                reach[~asked[at]] = -np.inf
            some = np.isfinite(reach).any(1)
            first = np.where(some, reach.argmax(1), -1)
            for b, block in enumerate(blocks):
                here = np.flatnonzero((first == b) & (reach[:, b] >= _least(self.bound[at])))
                if len(here):
                    self.score(at[here], block)
            for b, block in enumerate(blocks):
                here = np.flatnonzero((first != b) & np.isfinite(reach[:, b]) & (reach[:, b] >= _least(self.bound[at])))
                if len(here):
                    self.score(at[here], block)
        if not self.found[0]:
            return SCORED_ARROW.empty_table()
        row, keys, score, rank = (np.concatenate(held) for held in self.found)
        order = np.lexsort((-keys if self.key_desc else keys, -rank, row))
        order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < self.k]
        return pa.Table.from_arrays([pa.array(c) for c in (self.pids[row[order]], keys[order], score[order], rank[order])], schema=SCORED_ARROW)


def top_k_of_tile(metric: str, k: int, key_desc: bool, digits: int, pids, probes, worst, ckeys, cands) -> pa.Table:
    """The k best candidates of each probe that are not worse than its bound
    ``worst``: (pid, cand_key, score, rank_score); a larger rank_score is better.
    Of cosine, vectors are unit vectors or zero."""
    if not len(ckeys) or not len(pids):
        return SCORED_ARROW.empty_table()
    return _Tile(metric, k, key_desc, digits, pids, probes, worst, ckeys, cands).sweep(_blocks(cands, BLOCK_ROWS))


def top_k_of_buckets(metric: str, k: int, key_desc: bool, digits: int, pids, probes, worst, asks: pa.Array, ckeys, cands, buckets) -> pa.Table:
    """As ``top_k_of_tile``; probe i meets the candidates whose bucket is in ``asks[i]`` only."""
    if not len(ckeys) or not len(pids):
        return SCORED_ARROW.empty_table()
    names, of = np.unique(buckets, return_inverse=True)
    wanted = asks.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(pids)), pc.list_value_length(asks).to_numpy(zero_copy_only=False))
    place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    there = names[place] == wanted  # a slice may lack a bucket
    asked = np.zeros((len(pids), len(names)), bool)
    asked[row[there], place[there]] = True
    order = np.argsort(of, kind="stable")
    blocks = np.split(order, np.cumsum(np.bincount(of))[:-1])
    return _Tile(metric, k, key_desc, digits, pids, probes, worst, ckeys, cands).sweep(blocks, asked)


def _vectors(df: DataFrame, key: str, features: list[str] | str) -> DataFrame:
    """(key, vec): rows whose vector, or any element of it, is null are left out."""
    vec = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    return (df.select(F.col(key).cast("long").alias("key"), vec.alias("vec"))
            .where(F.col("key").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())))


def _hashed(vectors: DataFrame) -> DataFrame:
    """With a hash of the vector in front: what is sorted by vector is sorted by ``SAME``,
    where two numbers are compared and the elements only if those are equal."""
    return vectors.withColumn("hash", F.xxhash64("vec"))


SAME = ["hash", "vec"]
SCORED = "pid long, cand_key long, score double, rank_score double"
PLACED = "key long, vec array<double>, leaf int"
NODES = "node int, column int, value double, low int, high int, leaf int, n long, lo array<double>, hi array<double>"
ASKED = "pid long, vec array<double>, leaf int, worst double"


def _best(scored: DataFrame, k: int, key_desc: bool) -> DataFrame:
    """The k best rows of each probe vector."""
    order = [F.col("rank_score").desc(), F.col("cand_key").desc() if key_desc else F.col("cand_key").asc()]
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(*order))
    return scored.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def tile_scores(placed: DataFrame, rows, asked: DataFrame, k: int, metric: str, key_desc: bool, digits: int,
                slice_rows: int) -> tuple[DataFrame, int]:
    """Scores of the written ``asked`` (pid, vec, leaf, worst) against ``placed``
    (key, vec, leaf), ``rows[leaf]`` of them a leaf, and how many pairs that are: a
    tile is one slice of a leaf with one share of the probes that ask it, and
    gives its k best rows a probe.  Leaves that nobody asks are not read."""
    spark = asked.sparkSession
    counts = {r["leaf"]: r["count"] for r in asked.groupBy("leaf").count().collect()}  # a row a leaf
    # so many rows to a slice that all cores have tiles
    size = max(256, min(slice_rows, sum(int(rows[leaf]) for leaf in counts) // (2 * spark.sparkContext.defaultParallelism) + 1))
    deal = spark.createDataFrame([(leaf, int(-(-rows[leaf] // size)), -(-n // slice_rows)) for leaf, n in counts.items()],
                                 "leaf int, slices int, shares int")
    deal = F.broadcast(deal)  # a row of three integers a leaf, whose number is bounded
    buckets = "buckets" in asked.columns
    left = placed.join(deal, "leaf").select(*placed.columns, F.pmod(F.xxhash64("key", F.lit(7)), "slices").cast("int").alias("slice"),
                                            F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    right = asked.join(deal, "leaf").select(*asked.columns, F.pmod(F.xxhash64("pid"), "shares").cast("int").alias("share"),
                                            F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def score(cands: pa.Table, probes: pa.Table) -> pa.Table:
        if not cands.num_rows or not probes.num_rows:
            return SCORED_ARROW.empty_table()
        ask = probes["pid"].to_numpy(), _matrix(probes["vec"]), probes["worst"].to_numpy()
        held = cands["key"].to_numpy(), _matrix(cands["vec"])
        if buckets:
            return top_k_of_buckets(metric, k, key_desc, digits, *ask, probes["buckets"].combine_chunks(), *held, cands["bucket"].to_numpy())
        return top_k_of_tile(metric, k, key_desc, digits, *ask, *held)

    keys = ["leaf", "slice", "share"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, SCORED), sum(int(rows[leaf]) * n for leaf, n in counts.items())


class BoxTree:
    """A binary tree of cuts.  Node i has ``column[i]`` (-1: a leaf, numbered
    ``leaf[i]``), ``value[i]``, its children ``kids[i]`` and the box of the rows that were
    placed below it.  Cosine works on unit vectors, where a similarity is a
    distance; the zero vector has leaf ``len(leaves)``, similarity 0 with all."""

    def __init__(self, nodes: list[tuple], cosine: bool, dims: int):
        self.cosine = cosine
        self.column, self.leaf = np.array([n[0] for n in nodes]), np.array([n[4] for n in nodes])
        self.value, self.kids = np.array([n[1] for n in nodes]), np.array([n[2:4] for n in nodes])
        self.leaves = np.flatnonzero(self.column < 0)
        self.rows = np.zeros(len(self.leaves) + 1, np.int64)
        self.lo, self.hi = np.full((len(nodes), dims), np.inf), np.full((len(nodes), dims), -np.inf)

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, cosine: bool) -> "BoxTree":
        """A tree of ``leaves`` leaves at most; the node with most rows is cut next."""
        nodes, rows = [(-1, 0.0, -1, -1)], [np.arange(len(sample))]
        largest = [(-len(sample), 0)]
        while largest and len(nodes) < 2 * leaves - 1:
            _, i = heapq.heappop(largest)
            cut = _cut(sample[rows[i]]) if len(rows[i]) > 1 else None
            if cut is None:
                continue
            low = sample[rows[i], cut[0]] <= cut[1]
            nodes[i] = (cut[0], float(cut[1]), len(nodes), len(nodes) + 1)
            for part in (rows[i][low], rows[i][~low]):
                heapq.heappush(largest, (-len(part), len(nodes)))
                nodes.append((-1, 0.0, -1, -1))
                rows.append(part)
        number = itertools.count()
        return cls([(*n, next(number) if n[0] < 0 else -1) for n in nodes], cosine, sample.shape[1])

    def hold(self, leaf: int, n: int, lo, hi) -> None:
        """What was placed in a leaf; ``close`` follows."""
        self.rows[leaf] = n
        if leaf < len(self.leaves):
            at = self.leaves[leaf]
            self.lo[at], self.hi[at] = lo, hi

    def close(self) -> None:
        for i in range(len(self.column) - 1, -1, -1):  # children come after their parent
            if self.column[i] >= 0:
                self.lo[i], self.hi[i] = self.lo[self.kids[i]].min(0), self.hi[self.kids[i]].max(0)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.zeros(len(x), np.int64)
        every = np.arange(len(x))
        while True:
            column = self.column[at]
            inner = column >= 0
            if not inner.any():
                break
            go = self.kids[at, (~(x[every, column] <= self.value[at])).astype(np.int64)]
            at = np.where(inner, go, at)
        leaf = self.leaf[at]
        if self.cosine:
            leaf[~x.any(1)] = len(self.leaves)
        return leaf

    def reach(self, x: np.ndarray, worst: np.ndarray, own: np.ndarray):
        """(probe, leaf) pairs, without the probe's own leaf, whose leaf can hold
        a candidate at least as good as ``worst``: down the tree, in parts."""
        zero, least = ~x.any(1), _least(worst)
        last, step = len(self.leaves), max(1, CELL_BUDGET // (4 * x.shape[1]))
        open_ = [(np.arange(len(x)), np.zeros(len(x), np.int64))]
        while open_:
            row, at = open_.pop()
            if len(row) > step:
                open_ += [(row[i: i + step], at[i: i + step]) for i in range(0, len(row), step)]
                continue
            gap = np.maximum(np.maximum(self.lo[at] - x[row], x[row] - self.hi[at]), 0.0)
            ends = self.leaf[at]
            keep = _reachable(np.einsum("ij,ij->i", gap, gap), self.cosine, zero[row]) >= least[row]
            keep &= np.isfinite(self.lo[at, 0]) & ((ends < 0) | (ends != own[row]))  # an empty box holds nothing
            row, at, ends = row[keep], at[keep], ends[keep]
            if (ends >= 0).any():
                yield row[ends >= 0], ends[ends >= 0]
            row, at = row[ends < 0], at[ends < 0]
            if len(row):
                open_.append((np.repeat(row, 2), self.kids[at].ravel()))
        if self.rows[last]:
            at = np.flatnonzero((least <= 0.0) & (own != last))
            yield at, np.full(len(at), last)


class SearchIndex:
    """An exact search index over candidate vectors, written once under ``path``:
    the placed rows, the tree with what its leaves hold, and what was asked
    for.  ``load`` reads it back; a search of a loaded index fits nothing."""

    def __init__(self, spark: SparkSession, path: str, facts: dict, tree: BoxTree):
        self.spark, self.path, self.facts, self.tree = spark, path, facts, tree
        self.placed = spark.read.schema(PLACED).parquet(f"{path}/placed")
        self.pairs = 0  # probes times candidates that the last search scored

    @classmethod
    def build(cls, candidates: DataFrame, cand_key: str, features: list[str] | str, k: int, metric: str = "cosine", key_desc: bool = True,
              path: str | None = None, leaf_rows: int | None = None) -> "SearchIndex":
        """Index for up to ``k`` neighbours of any probe."""
        if metric not in ("cosine", "sqeuclidean"):
            raise ValueError(metric)
        spark, cosine = candidates.sparkSession, metric == "cosine"
        path = path or own(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/search/{uuid.uuid4().hex}")
        best = F.col("key").desc() if key_desc else F.col("key").asc()
        vectors = _vectors(candidates, cand_key, features)
        n = vectors.count()
        leaf_rows = leaf_rows or int(np.clip(n // (2 * spark.sparkContext.defaultParallelism), *LEAF_ROWS))
        leaves = int(np.clip(n // leaf_rows, 1, MAX_LEAVES))
        share = min(1.0, min(SAMPLE_ROWS, 32 * leaves) / max(1, n))
        drawn = vectors.where(F.pmod(F.xxhash64("key", "vec"), F.lit(1 << 30)) < int(share * (1 << 30)))
        # one task after the draw: a limit alone would go through the partitions a few at a time
        sample = drawn.select("vec").repartition(1).limit(2 * SAMPLE_ROWS).collect() or vectors.select("vec").limit(1).collect()  # the driver's part
        sample = _stack([r["vec"] for r in sample]) if sample else np.zeros((1, 1))
        tree = BoxTree.fit(_unit(sample) if cosine else sample, leaves, cosine)

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(1))
                    x = _unit(x) if cosine else x
                    yield _batch(key=batch.column(0).to_numpy(), vec=x, leaf=tree.place(x).astype(np.int32))

        same = F.row_number().over(Window.partitionBy(*SAME).orderBy(best))
        cand = _hashed(vectors).withColumn("_same", same).where(F.col("_same") <= k).select("key", "vec")
        cand.mapInArrow(place, PLACED).write.mode("overwrite").parquet(f"{path}/placed")
        placed = spark.read.schema(PLACED).parquet(f"{path}/placed")
        at = [F.get("vec", F.lit(j)) for j in range(sample.shape[1])]
        for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(c) for c in at]).alias("lo"),
                                            F.array(*[F.max(c) for c in at]).alias("hi")).collect():  # a row a leaf
            tree.hold(r["leaf"], r["n"], r["lo"], r["hi"])
        tree.close()
        facts = {"metric": metric, "key_desc": key_desc, "k": k, "n": n, "zeros": int(tree.rows[-1])}
        rows = [(i, int(c), float(v), *map(int, kids), int(leaf), int(tree.rows[leaf]) if leaf >= 0 else 0, lo.tolist(), hi.tolist())
                for i, (c, v, kids, leaf, lo, hi) in enumerate(zip(tree.column, tree.value, tree.kids, tree.leaf, tree.lo, tree.hi))]
        spark.createDataFrame(rows, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
        return cls(spark, path, facts, tree)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SearchIndex":
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        rows = sorted(spark.read.schema(NODES).parquet(f"{path}/tree").collect(), key=lambda r: r["node"])  # two rows a leaf
        tree = BoxTree([(r["column"], r["value"], r["low"], r["high"], r["leaf"]) for r in rows], facts["metric"] == "cosine", len(rows[0]["lo"]))
        tree.lo, tree.hi = _stack([r["lo"] for r in rows]), _stack([r["hi"] for r in rows])
        tree.rows = np.array([r["n"] for r in rows if r["leaf"] >= 0] + [facts.pop("zeros")])
        return cls(spark, path, facts, tree)

    def _tiles(self, asked: DataFrame, k: int, digits: int, slice_rows: int) -> DataFrame:
        scored, pairs = tile_scores(self.placed, self.tree.rows, asked, k, self.facts["metric"], self.facts["key_desc"], digits, slice_rows)
        self.pairs += pairs
        return _best(scored, k, self.facts["key_desc"])

    def _scored(self, wanted: DataFrame, k: int, digits: int, slice_rows: int) -> DataFrame:
        """(pid, cand_key, score, rank_score): the k best candidates of each probe vector (pid, vec)."""
        tree, cosine = self.tree, self.facts["metric"] == "cosine"
        self.pairs = 0
        if not self.facts["n"]:
            return self.spark.createDataFrame([], SCORED)

        def own_leaf(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(1))
                    x = _unit(x) if cosine else x
                    leaf = tree.place(x)
                    if not tree.rows[leaf].all():  # an empty leaf, or no zero vector: any leaf with rows
                        leaf = np.where(tree.rows[leaf] > 0, leaf, int(tree.rows.argmax()))
                    yield _batch(pid=batch.column(0).to_numpy(), vec=x, leaf=leaf.astype(np.int32), worst=np.full(len(x), -np.inf))

        start = materialize(wanted.select("pid", "vec").mapInArrow(own_leaf, ASKED))
        first = self._tiles(start, k, digits, slice_rows)
        if (tree.rows > 0).sum() == 1:
            return first
        first = materialize(first)

        def others(batches):
            for batch in batches:
                if batch.num_rows:
                    pid, x, own_, worst = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                    for row, leaf in tree.reach(x, worst, own_):
                        yield _batch(pid=pid[row], vec=x[row], leaf=leaf.astype(np.int32), worst=worst[row])

        bound = first.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.min("rank_score").alias("least")).where(F.col("n") >= k)
        asked = start.drop("worst").join(bound.select("pid", "least"), "pid", "left").select(
            "pid", "vec", "leaf", F.coalesce("least", F.lit(float("-inf"))).alias("worst"))
        second = self._tiles(materialize(asked.mapInArrow(others, ASKED)), k, digits, slice_rows)
        return _best(first.unionByName(second), k, self.facts["key_desc"])

    def search(self, probes: DataFrame, probe_key: str, features: list[str] | str, k: int, exclude_self: bool = False,
               round_digits: int = 9, slice_rows: int = SLICE_ROWS) -> DataFrame:
        """(probe_key, nn_rank, cand_key, score) for the k best candidates of each probe."""
        kk = k + 1 if exclude_self else k
        if kk > self.facts["k"]:
            raise ValueError(f"the index was built for {self.facts['k']} neighbours, {kk} are asked for")
        asked = _hashed(_vectors(probes, probe_key, features).dropDuplicates(["key"]))
        wanted = materialize(asked.groupBy(*SAME).agg(F.min("key").alias("pid")))
        found = self._scored(wanted, kk, round_digits, slice_rows)
        return _ranked(asked.join(wanted, SAME).select(F.col("key").alias("probe_key"), "pid").join(found, "pid"), k, exclude_self, self.facts["key_desc"])


def _ranked(found: DataFrame, k: int, exclude_self: bool, key_desc: bool) -> DataFrame:
    order = [F.col("rank_score").desc(), F.col("cand_key").desc() if key_desc else F.col("cand_key").asc()]
    if exclude_self:
        found = found.where(F.col("cand_key") != F.col("probe_key"))
    out = found.withColumn("nn_rank", F.row_number().over(Window.partitionBy("probe_key").orderBy(*order)).cast("long"))
    return out.where(F.col("nn_rank") <= k).select("probe_key", "nn_rank", "cand_key", "score")


def _few(candidates: DataFrame, n_probes: int, cand_key: str, probes: DataFrame, probe_key: str, features: list[str] | str, k: int, metric: str,
         key_desc: bool, exclude_self: bool, digits: int, slice_rows: int) -> DataFrame:
    """Search of a candidate table that is one tile's: every share of the probes meets all of it, nothing is written."""
    spark, kk = candidates.sparkSession, k + exclude_self
    shares = max(spark.sparkContext.defaultParallelism, -(-n_probes // slice_rows))
    left = _vectors(candidates, cand_key, features).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    right = _vectors(probes, probe_key, features).dropDuplicates(["key"]).withColumn("share", F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int"))

    def score(cands: pa.Table, asked: pa.Table) -> pa.Table:
        if not cands.num_rows or not asked.num_rows:
            return SCORED_ARROW.empty_table()
        own_, theirs = _matrix(cands["vec"]), _matrix(asked["vec"])
        if metric == "cosine":
            own_, theirs = _unit(own_), _unit(theirs)
        return top_k_of_tile(metric, kk, key_desc, digits, asked["key"].to_numpy(), theirs, np.full(len(theirs), -np.inf),
                             cands["key"].to_numpy(), own_)

    found = left.groupBy("share").cogroup(right.groupBy("share")).applyInArrow(score, SCORED)
    return _ranked(found.withColumnRenamed("pid", "probe_key"), k, exclude_self, key_desc)


def exact_top_k(candidates: DataFrame, cand_key: str, probes: DataFrame, probe_key: str,
                features: list[str] | str, k: int, metric: str = "cosine", key_desc: bool = True,
                exclude_self: bool = False, round_digits: int = 9, cand_payload: str | None = None,
                slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(probe_key, nn_rank, cand_key, score[, cand_payload]) for the k best
    candidates per probe.  ``cand_payload`` names a candidate column carried
    into the output.

    ``metric='cosine'``: largest similarity first; ``'sqeuclidean'``:
    smallest squared distance first.  ``features`` is a list of numeric
    columns or the name of one array column (same in both inputs).  Rows whose
    key or vector is null, or holds a null, have no neighbours and are nobody's:
    impute first (F8) where they should.  A probe key that occurs twice
    must have one vector.  ``exclude_self`` leaves out the candidate whose key is the
    probe's.  Candidate keys are unique."""
    if metric not in ("cosine", "sqeuclidean"):
        raise ValueError(metric)
    if candidates.count() <= min(FEW, slice_rows):
        out = _few(candidates, probes.count(), cand_key, probes, probe_key, features, k, metric, key_desc, exclude_self, round_digits, slice_rows)
    else:
        index = SearchIndex.build(candidates, cand_key, features, k + exclude_self, metric, key_desc)
        out = index.search(probes, probe_key, features, k, exclude_self, round_digits, slice_rows)
    if cand_payload is None:
        return out
    named = candidates.select(F.col(cand_key).cast("long").alias("cand_key"), F.col(cand_payload).alias("cand_payload"))
    return out.join(named, "cand_key").select("probe_key", "nn_rank", "cand_key", "score", "cand_payload")
