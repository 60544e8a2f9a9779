"""Batch append, managed tables, incremental loads, empty-input guard."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EmptyInputError(ValueError):
    pass


def append_batches(base: DataFrame, *batches: DataFrame) -> DataFrame:
    """A3: UNION ALL by column name; columns missing in a batch become null."""
    out = base
    for b in batches:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast ``df`` onto a declared schema (A4); extra columns are dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def write_table(df: DataFrame, path: str, schema: T.StructType | None = None,
                mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """A4/A5: parquet table with an enforced schema; ``mode='append'`` loads
    an additional batch into an existing table."""
    out = conform(df, schema) if schema is not None else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_load(df: DataFrame, path: str, schema: T.StructType) -> None:
    """A5: incremental load (``COPY`` a second time)."""
    write_table(df, path, schema, mode="append")


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Refuse absent or empty input before any processing."""
    if df is None:
        raise EmptyInputError(f"{what} is missing")
    if df.isEmpty():
        raise EmptyInputError(f"{what} is empty")
    return df


_OWNED: list[list[tuple[SparkSession, str]]] = [[]]  # innermost scope last; the first lives as long as the process


def own(spark: SparkSession, path: str) -> str:
    """Give a written folder to the innermost open scope, which deletes it."""
    _OWNED[-1].append((spark, path))
    return path


def own_always(spark: SparkSession, path: str) -> str:
    """Give a written folder to the process, whatever scopes are open."""
    _OWNED[0].append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's file system layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _release(owned: list[tuple[SparkSession, str]]) -> None:
    while owned:
        spark, path = owned.pop()
        try:
            delete(spark, path)
        except Exception:  # the session is gone and its folder cannot be reached
            continue


@contextmanager
def table_scope():
    """Tables materialised inside are deleted when the scope closes; results
    that read them must be consumed before."""
    _OWNED.append([])
    try:
        yield
    finally:
        _release(_OWNED.pop())


# tables of no scope go when the process ends
atexit.register(lambda: _release(_OWNED[0]))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as parquet under the shared checkpoint
    folder (``spark.checkpoint.dir``; a local folder is made only when a local
    session has none, as in tests) and read it back.  Later passes read the
    written table, and a lost executor does not replay the upstream plan.  The
    open ``table_scope`` owns the table and deletes it, else the process does."""
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    path = own(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, n_buckets: int, path: str | None = None) -> None:
    """Catalog table bucketed and sorted by ``key``.  Two tables bucketed the
    same way on the join key (accounts and customers on Client_Num) join
    without a shuffle: each bucket pair is joined in place."""
    w = df.write.mode("overwrite").bucketBy(n_buckets, key).sortBy(key).format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
