"""Rounds of boosting on rows that are kept.

A level of a round needs the sums over all rows.  Rows are packed once: columns of few
bins share a byte and are added up together (``Packing``).  A level is:

1. rows go down the trees so far, and whole numbers are added up by (tree, node, feature,
   bin) over the rows that the round drew.  Of two children the one with fewer rows is
   added up, the other is its parent less it;
2. splits are found from the sums.

Up to ``FIT_ROWS`` rows are one task's work: it keeps margins, nodes and gradients, and
the driver receives its trees.  A job a level would cost more than the level.  The first
round, which fits the labels, is a job of its own.

More rows are chunks of an RDD that is kept, in memory or on the executors' disks.  The
first job of a round brings their margins up to date and keeps, compact, the drawn rows
and their gradients, which is all that the jobs of its levels read.  The driver receives
the tasks' sums of a level, which are bounded by nodes, features and bins, and no rows;
sums beyond ``GROUP_BYTES`` are added up by executors first.
"""

from __future__ import annotations

import pickle
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import delete, own

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 14  # rows that are worked on at once, in the cache
SLAB = 64  # chunks whose memory is taken at once
MOST = 1 << 15  # rows whose sums are exact in the doubles of an objective
LEAST_WIDTH = 32  # of a packed column's bins
FIT_ROWS = 200_000  # that one task fits alone
TASK_ROWS = 100_000  # of one task, at least, where there are more
PART_ROWS = 1_000_000  # of one task, about, where there are more than the cores take
SAVED = 20  # rounds between checkpoints of the margins


class Packing:
    """Which columns share a byte: value = sum of bin times stride."""

    def __init__(self, widths: list[int]):
        self.widths = [int(w) for w in widths]
        cap = max(LEAST_WIDTH, *self.widths)
        self.groups: list[list[int]] = []
        size: list[int] = []
        for f in sorted(range(len(widths)), key=lambda f: -self.widths[f]):
            fits = next((g for g, s in enumerate(size) if s * self.widths[f] <= cap), None)
            if fits is None:
                self.groups.append([])
                size.append(1)
                fits = len(size) - 1
            self.groups[fits].append(f)
            size[fits] *= self.widths[f]
        self.sizes, self.width = size, max(size)
        self.of, self.stride = np.zeros(len(widths), np.int64), np.ones(len(widths), np.int64)
        for g, group in enumerate(self.groups):
            step = 1
            for f in group:
                self.of[f], self.stride[f] = g, step
                step *= self.widths[f]

    def pack(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), len(self.groups)), np.uint8)
        for f in range(len(self.widths)):
            out[:, self.of[f]] += bins[:, f] * np.uint8(self.stride[f])
        return out

    def digits(self, feature: int) -> np.ndarray:
        """The feature's bin for each value of its byte."""
        return np.arange(256) // self.stride[feature] % self.widths[feature]

    def unpacked(self, joint: np.ndarray) -> np.ndarray:
        """(sums, packs, nodes, sides, width) -> (nodes, features, bins, sides, sums)."""
        kinds, _, nodes, sides, _ = joint.shape
        out = np.zeros((nodes, len(self.widths), max(self.widths), sides, kinds), np.int64)
        for g, group in enumerate(self.groups):
            part = joint[:, g, :, :, : self.sizes[g]].reshape(kinds, nodes, sides, *[self.widths[f] for f in reversed(group)])
            for i, f in enumerate(group):
                others = tuple(3 + len(group) - 1 - j for j in range(len(group)) if j != i)
                out[:, f, : self.widths[f]] = part.sum(others).transpose(1, 3, 2, 0)
        return out


def _space(size: int, file: bool) -> np.ndarray:
    if not file:
        return np.zeros(size, np.uint8)
    with tempfile.TemporaryFile() as f:  # the mapping outlives its name
        return np.memmap(f, np.uint8, "w+", shape=(size,))


class Chunk:
    """Rows of one task: ``rows`` of them, with views of what is kept of each."""


class Shard:
    """All rows of one task."""

    def __init__(self, batches, packs: int, targets: int, values: int, depth: int, keep_rows: int):
        self.chunks: list[Chunk] = []
        self.packs, self.held, self.keep_rows = packs, 0, keep_rows
        heap = np.uint8 if depth < 8 else np.int32
        self.layout = (("keys", np.int64, ()), ("margin", np.float64, (targets,)), ("values", np.int32, (values, targets)), ("y", np.int32, ()),
                       ("node", heap, (targets,)), ("packs", np.uint8, (packs,)), ("used", bool, ()))
        at = CHUNK
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                if at == CHUNK:
                    self._chunk()
                    at = 0
                n = min(batch.num_rows - done, CHUNK - at)
                chunk, part = self.chunks[-1], batch.slice(done, n)
                chunk.keys[at: at + n], chunk.y[at: at + n] = part.column(0).to_numpy(), part.column(1).to_numpy()
                offsets = np.frombuffer(part.column(2).buffers()[1], np.int32)[part.column(2).offset:]
                chunk.packs[:, at: at + n] = np.frombuffer(part.column(2).buffers()[2], np.uint8)[offsets[0]: offsets[n]].reshape(n, packs).T
                at, done = at + n, done + n
                chunk.rows = at
                self.held += n
        if self.chunks and at < CHUNK:
            last = self.chunks[-1]
            for name, _, _ in self.layout:
                if name != "packs":
                    setattr(last, name, getattr(last, name)[..., :at])

    def _chunk(self) -> None:
        if len(self.chunks) % SLAB == 0:
            row = sum(np.dtype(kind).itemsize * int(np.prod(shape)) for _, kind, shape in self.layout)
            space, low, self.views = _space(row * SLAB * CHUNK, self.held >= self.keep_rows), 0, {}
            for name, kind, shape in self.layout:
                size = np.dtype(kind).itemsize * int(np.prod(shape)) * SLAB * CHUNK
                self.views[name] = space[low: low + size].view(kind).reshape(SLAB, *shape, CHUNK)
                low += size
        chunk = Chunk()
        for name, view in self.views.items():
            setattr(chunk, name, view[len(self.chunks) % SLAB])
        chunk.flat, chunk.rows = chunk.packs.reshape(-1), 0
        self.chunks.append(chunk)


class Steps:
    """One step down a tree from the nodes that ``at`` names."""

    def __init__(self, tree, at, packing: Packing):
        size = len(tree.feature)
        self.kid, self.column, self.right = np.arange(size), np.zeros(size, np.int64), np.zeros((size, 256), np.uint8)
        for node in at:
            f = int(tree.feature[node])
            if f >= 0:
                self.kid[node], self.column[node] = 2 * node + 1, packing.of[f]
                self.right[node] = packing.digits(f) > tree.bin[node]
        self.right = self.right.reshape(-1)

    def take(self, chunk: Chunk, k: int, times: int = 1) -> None:
        every, at, column = EVERY[: chunk.rows], chunk.node[k].astype(np.int64), self.column * chunk.packs.shape[1]
        for _ in range(times):
            byte = chunk.flat.take(column.take(at) + every)
            at = self.kid.take(at) + self.right.take((at << 8) + byte)
        chunk.node[k] = at


EVERY = np.arange(CHUNK)


class Sums:
    """Sums of each target over the drawn rows of its asked nodes."""

    def __init__(self, asked: list[list[int]], objective, packing: Packing):
        self.asked, self.objective, self.width = asked, objective, packing.width
        self.packs, self.cells = len(packing.groups), [len(nodes) * objective.sides * packing.width for nodes in asked]
        self.total = [np.zeros((2, self.packs, cells), np.int64) for cells in self.cells]
        self.found = [np.zeros((objective.weighed, self.packs, cells)) for cells in self.cells]
        self.summed, self.place = [0] * len(asked), []
        for nodes in asked:
            place = np.full(len(objective.tree().feature), -1)
            place[nodes] = np.arange(len(nodes)) * (objective.sides * packing.width)
            self.place.append(place)

    def add(self, chunk: Chunk) -> None:
        objective = self.objective
        for k, cells in enumerate(self.cells):
            if not cells:
                continue
            at = self.place[k].take(chunk.node[k])
            here = np.flatnonzero(at >= 0 if chunk.used is None else (at >= 0) & chunk.used)
            if not len(here):
                continue
            if self.summed[k] + len(here) > MOST:
                self._settle(k)
            self.summed[k] += len(here)
            at = at.take(here)
            if objective.sides > 1:
                at += (chunk.y.take(here) == objective.targets[k]) * self.width
            weights = objective.weights([v[k].take(here) for v in chunk.values])
            for p in range(self.packs):
                cell = at + chunk.packs[p].take(here)
                for w, weight in enumerate(weights):
                    self.found[k][w, p] += np.bincount(cell, weight, cells)

    def _settle(self, k: int) -> None:
        self.total[k] += self.objective.settled(self.found[k])
        self.found[k][:], self.summed[k] = 0, 0

    def result(self) -> np.ndarray:
        """(sums, packs and cells of all targets, one after the other)."""
        for k in range(len(self.cells)):
            self._settle(k)
        return np.concatenate([t.reshape(2, -1) for t in self.total], 1)


class Levels:
    """A round's trees while they grow."""

    def __init__(self, number: int, objective, packing: Packing):
        self.number, self.objective, self.packing, self.level = number, objective, packing, 0
        self.trees = [objective.tree() for _ in objective.targets]
        self.split: list[list[tuple[int, bool]]] = [[] for _ in self.trees]  # nodes split last, and whether the left child has fewer rows
        self.above: list[dict[int, np.ndarray]] = [{} for _ in self.trees]

    def asked(self) -> list[list[int]]:
        return [[2 * at + (1 if left else 2) for at, left in of] if self.level else [0] for of in self.split]

    def grow(self, sums: np.ndarray) -> bool:
        """Split the nodes of this level by the sums of the asked ones; whether any was split."""
        low = 0
        for k, (tree, asked) in enumerate(zip(self.trees, self.asked())):
            shape = (2, len(self.packing.groups), len(asked), self.objective.sides, self.packing.width)
            size = int(np.prod(shape[1:]))
            some = self.packing.unpacked(sums[:, low: low + size].reshape(shape))
            low += size
            known = dict(zip(asked, some))
            for (at, left), part in zip(self.split[k], some):
                known[2 * at + (2 if left else 1)] = self.above[k][at] - part
            nodes = [at for at in sorted(known) if known[at][0].any()]
            self.above[k] = known
            self.split[k] = self.objective.split(self.number, self.level, k, tree, nodes, np.stack([known[at] for at in nodes])) if nodes else []
        self.level += 1
        return any(self.split)


class Growing:
    """The rounds of a task that has all rows."""

    def __init__(self, shard: Shard, objective, packing: Packing):
        self.chunks, self.objective, self.packing = shard.chunks, objective, packing

    def apply(self, trees: list, number: int) -> None:
        """Margins with the trees of a finished round."""
        for k, tree in enumerate(trees):
            steps, value = Steps(tree, range(len(tree.feature)), self.packing), self.objective.leaves(tree, number)
            for chunk in self.chunks:
                chunk.node[k] = 0
                steps.take(chunk, k, self.objective.depth)
                chunk.margin[k] += value.take(chunk.node[k])

    def round(self, number: int) -> tuple[list, int]:
        """(trees, the loss before them in whole numbers)."""
        objective, loss = self.objective, 0
        for chunk in self.chunks:
            chunk.used[:] = objective.drawn(chunk.keys, number)
            values, part = objective.values(number, chunk.y, chunk.margin)
            for i, value in enumerate(values):
                chunk.values[i] = value
            chunk.node[:] = 0
            loss += part
        levels = Levels(number, objective, self.packing)
        for level in range(objective.depth):
            sums = Sums(levels.asked(), objective, self.packing)
            for chunk in self.chunks:
                sums.add(chunk)
            if not levels.grow(sums.result()):
                break
            for k, of in enumerate(levels.split):
                if of:
                    steps = Steps(levels.trees[k], [at for at, _ in of], self.packing)
                    for chunk in self.chunks:
                        steps.take(chunk, k)
        for k, tree in enumerate(levels.trees):
            value = objective.leaves(tree, number)
            for chunk in self.chunks:
                chunk.margin[k] += value.take(chunk.node[k])
        return levels.trees, loss


def _alone(rows: DataFrame, packing: Packing, objective, rounds: int, keep_rows: int) -> tuple[list[list], list[int]]:
    """All rounds by one task."""
    spread, packs, targets = rows.coalesce(1), len(packing.groups), len(objective.targets)
    done, losses = [], []
    for end in (1, rounds)[rounds < 2:]:
        known = pickle.dumps([[vars(t) for t in trees] for trees in done])

        def work(batches, start=len(done), end=end, known=known):
            growing = Growing(Shard(batches, packs, targets, objective.fields, objective.depth, keep_rows), objective, packing)
            for number, trees in enumerate(pickle.loads(known)):
                growing.apply([objective.tree(t) for t in trees], number)
            made = [growing.round(number) for number in range(start, end)]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([([vars(t) for t in trees], loss) for trees, loss in made])], pa.binary())], names=["found"])

        (found,) = spread.mapInArrow(work, "found binary").collect()  # the trees
        for trees, loss in pickle.loads(found["found"]):
            done.append([objective.tree(t) for t in trees])
            losses.append(loss)
    return done, losses


def _chunk(kept: tuple, targets: int) -> Chunk:
    """A chunk of drawn rows, at the root."""
    chunk = Chunk()
    chunk.y, chunk.packs, chunk.values = kept
    chunk.flat, chunk.rows, chunk.used = chunk.packs.reshape(-1), len(chunk.y), None
    chunk.node = np.zeros((targets, chunk.rows), np.int64)
    return chunk


def _together(rows: DataFrame, n: int, packing: Packing, objective, rounds: int, group_bytes: int) -> tuple[list[list], list[int]]:
    """A job a level."""
    spark, packs, targets = rows.sparkSession, len(packing.groups), len(objective.targets)
    tasks = min(1 + n // TASK_ROWS, max(spark.sparkContext.defaultParallelism, n // PART_ROWS))

    def load(batches):
        shard = Shard(batches, packs, targets, 0, 1, 1 << 62)
        for c in shard.chunks:
            kept = (c.keys[: c.rows], c.y[: c.rows], np.ascontiguousarray(c.packs[:, : c.rows]), c.margin[:, : c.rows])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(kept)], pa.binary())], names=["chunk"])

    base = rows.repartition(tasks, "key").mapInArrow(load, "chunk binary").rdd.map(lambda r: pickle.loads(r[0]))
    done, losses, saved, old, drawn = [], [], None, None, None
    for number in range(rounds):
        if done:
            def update(chunks, trees=done[-1], number=number):
                steps, values = [Steps(t, np.flatnonzero(t.feature >= 0), packing) for t in trees], [objective.leaves(t, number - 1) for t in trees]
                for keys, y, packed, margin in chunks:
                    chunk, margin = _chunk((y, packed, None), targets), margin.copy()
                    for k, value in enumerate(values):
                        steps[k].take(chunk, k, objective.depth)
                        margin[k] += value.take(chunk.node[k])
                    yield keys, y, packed, margin

            old, base = base, base.mapPartitions(update)
        base.persist(StorageLevel.MEMORY_AND_DISK)
        if number and number % SAVED == 0:
            base.checkpoint()

        def draw(kept, number=number):
            keys, y, packed, margin = kept
            values, loss = objective.values(number, y, margin)
            used = np.flatnonzero(objective.drawn(keys, number))
            return (y[used], packed[:, used], [v[:, used].astype(np.int32) for v in values]), loss

        last, drawn = drawn, base.map(draw).persist(StorageLevel.MEMORY_AND_DISK)
        levels = Levels(number, objective, packing)
        for level in range(objective.depth):
            asked = levels.asked()

            def add(chunks, asked=asked, level=level, trees=levels.trees):
                sums, steps, total = Sums(asked, objective, packing), [Steps(t, np.flatnonzero(t.feature >= 0), packing) for t in trees], 0
                for kept, loss in chunks:
                    chunk, total = _chunk(kept, targets), total + loss
                    for k, nodes in enumerate(asked):
                        if level and nodes:
                            steps[k].take(chunk, k, level)
                    sums.add(chunk)
                yield sums.result(), total

            parts = drawn.mapPartitions(add)
            many = tasks * 16 * sum(len(nodes) for nodes in asked) * packs * objective.sides * packing.width > group_bytes
            whole = [parts.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))] if many else parts.collect()  # the sums, or those of each task
            if not level:
                losses.append(sum(loss for _, loss in whole))
                for gone in (old, last):
                    if gone is not None:
                        gone.unpersist()
                if base.getCheckpointFile():
                    if saved:
                        delete(spark, saved)
                    saved = base.getCheckpointFile()
            if not levels.grow(sum(part for part, _ in whole)):
                break
        done.append(levels.trees)
    for gone in (base, drawn):
        if gone is not None:
            gone.unpersist()
    if saved:
        delete(spark, saved)
    return done, losses


def run(train: DataFrame, key: Column, y: Column, x: list[Column], n: int, cuts: list[np.ndarray], binned, objective, rounds: int,
        keep_rows: int, group_bytes: int) -> tuple[list[list], list[int]]:
    """(trees of each round, loss before each round) of ``objective`` on the ``n`` rows of ``train``."""
    spark, packing = train.sparkSession, Packing([len(c) + 1 for c in cuts])
    root = own(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/rounds/{uuid.uuid4().hex}")
    packs = len(packing.groups)

    def encode(batches):
        for batch in batches:
            x = batch.column(2).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
            packed = packing.pack(binned(x, cuts))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * packs
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())])],
                                             names=["key", "y", "packs"])

    rows = train.select(key.alias("key"), y.alias("y"), F.array(*x).alias("x")).mapInArrow(encode, "key long, y int, packs binary")
    rows.write.parquet(root)
    rows = spark.read.schema(rows.schema).parquet(root)
    done, losses = _alone(rows, packing, objective, rounds, keep_rows) if n <= FIT_ROWS else _together(rows, n, packing, objective, rounds, group_bytes)
    delete(spark, root)
    return done, losses
