"""Shared helpers: written intermediate tables, Arrow text access, digests."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import delete, own

#: ASCII white space, the only separators of words in every contract.
SPACE = r"[\x20\x09-\x0D]"


class Tables:
    """Intermediate tables of one operator call, written as Parquet under the
    shared ``spark.checkpoint.dir``.  Writing cuts the lineage: a lost executor
    re-reads the table instead of replaying the plan.  Tables that only feed
    later tables are dropped as soon as those are written; those that the result
    reads belong to the open ``sources.tables.table_scope`` or to the process."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = own(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{what}-{uuid.uuid4().hex}")

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """The written table.  ``rows``, if known, sizes its files: at most one
        for every quarter million rows, whatever the shuffle left."""
        path = f"{self.root}/{name}"
        if rows is not None:
            df = df.coalesce(1 + rows // 250_000)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of a table; other columns, clashing names
    included, never reach the operators."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def broadcast_if_small(df: DataFrame, size: int, limit: int = 16 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its known size in bytes is within
    ``limit``; beyond that Spark joins by shuffle as it sees fit."""
    return F.broadcast(df) if size <= limit else df


def text_blocks(column: pa.Array, limit: int = 1 << 18):
    """Cut an Arrow string column into runs of rows of about ``limit`` bytes.

    Yields ``(first_row, bytes, offsets)`` where row ``first_row + i`` is
    ``bytes[offsets[i]:offsets[i + 1]]``.  A longer text is a run of its own,
    whole.  Nulls are empty texts."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def frugal(run):
    """A batch function that gives unused memory back to the system when its
    task ends: Python workers are kept for a while, next to a full heap."""

    def runs(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return runs


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's output function over a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of many texts at once.

    A word's hash is the sum, modulo 2**64, of a pseudo-random value for each
    (byte, place in the word), mixed with its length.  Unlike a polynomial
    modulo a power of two it has no family of long words that share a hash.
    Sums come from one running total, so no word is cut out as a Python
    object.  ``lower`` maps A-Z to a-z first."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, lower: bool = False):
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        if lower:
            values[65:91] = values[97:123]
        self.values = values
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(hashes, bounds, starts, ends)``: text i has the words
        ``bounds[i]:bounds[i + 1]``, word w the bytes ``starts[w]:ends[w]``."""
        n = len(data)
        word = ~self.space[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = True, ~word[:-1]
            after[-1], after[:-1] = True, ~word[1:]
        starts = np.flatnonzero(word & (before | edge[:-1]))
        ends = np.flatnonzero(word & (after | edge[1:])) + 1
        sizes = ends - starts
        last = np.cumsum(sizes)
        place = np.arange(last[-1] if len(last) else 0) - np.repeat(last - sizes, sizes)
        sums = np.zeros(len(place) + 1, np.uint64)
        np.cumsum(mix(self.values[data[word]] + place.astype(np.uint64) * self.STEP), out=sums[1:])
        hashes = mix(sums[last] - sums[last - sizes] + sizes.astype(np.uint64))
        return hashes, np.searchsorted(starts, offsets), starts, ends


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    total = np.full(max(n, 0), seed, np.uint64)
    for j in range(size if n > 0 else 0):
        total = total * np.uint64(0x2545F4914F6CDD1D) + hashes[j: j + n]
    return mix(total)
