"""A table laid out for range search (D10): rows along a space-filling curve.

Each search column gets a code of ``bits`` bits: numbers by quantiles, texts by
their place among the sorted levels.  The codes' bits, interleaved, are a
position on a z-order curve; rows are range-partitioned and sorted by it, so that
a file covers a small box of the search space.  A manifest, one row a file, holds
each file's least and greatest values; a search reads the manifest, then only
the files whose boxes meet its ranges, and filters their rows as always.  Within
a file the sorted rows let Parquet's own statistics skip row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..operators import explore

#: Columns of the customer search.
SEARCH = ["Customer_Age", "Income", "Gender", "credit_score_band"]
MAX_LEVELS = 1000  # of a text column that codes tell apart; further levels share the last code


def _cuts(df: DataFrame, column: str, bits: int) -> list:
    """At most ``2**bits - 1`` values that part a column into codes."""
    n = 1 << bits
    if isinstance(df.schema[column].dataType, T.StringType):
        levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(MAX_LEVELS).collect()]
        step = -(-len(levels) // n) or 1
        return levels[step::step]
    return sorted(set(df.approxQuantile(column, [i / n for i in range(1, n)], 0.1 / n)))


def curve_position(df: DataFrame, columns: list[str], bits: int = 4) -> Column:
    """Position of each row on the z-order curve; nulls have the least code."""
    codes = []
    for c in columns:
        code = F.lit(0)
        for cut in _cuts(df, c, bits):
            code = code + F.coalesce((F.col(c) >= F.lit(cut)).cast("int"), F.lit(0))
        codes.append(code)
    where = F.lit(0).cast("long")
    for b in range(bits):
        for j, code in enumerate(codes):
            bit = F.shiftright(code, b).bitwiseAND(F.lit(1)).cast("long")
            where = where.bitwiseOR(F.shiftleft(bit, b * len(codes) + j))
    return where


def write_clustered(df: DataFrame, path: str, columns: list[str] = SEARCH, n_files: int = 64, bits: int = 4) -> None:
    """Write ``df`` along the curve in about ``n_files`` files, then the manifest.
    Equal positions are parted by a hash of the row, so that a hot position fills several files."""
    spread = F.xxhash64(*df.columns)
    (df.withColumn("_at", curve_position(df, columns, bits)).withColumn("_spread", spread)
     .repartitionByRange(n_files, "_at", "_spread").sortWithinPartitions("_at", *columns).drop("_at", "_spread")
     .write.mode("overwrite").parquet(f"{path}/rows"))
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    limits = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("least", F.min), ("most", F.max))]
    (rows.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), *limits)
     .write.mode("overwrite").parquet(f"{path}/manifest"))


def files_for(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> list[str]:
    """Files that can hold a row with every column within its closed range."""
    meets = F.lit(True)
    for c, (low, high) in ranges.items():
        meets = meets & (F.col(f"most_{c}") >= F.lit(low)) & (F.col(f"least_{c}") <= F.lit(high))
    return [r[0] for r in spark.read.parquet(f"{path}/manifest").where(meets).select("file").orderBy("file").collect()]


def clustered_rows(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> DataFrame:
    """Rows of the files that can hold what is searched; an empty frame if there is none."""
    whole = spark.read.parquet(f"{path}/rows")
    found = files_for(spark, path, ranges)
    return spark.read.schema(whole.schema).parquet(*found) if found else whole.where("false")


def clustered_search(spark: SparkSession, path: str, age=(30, 60), income=(20000, 100000), gender: str = "All", band: str = "All") -> DataFrame:
    """D10 over a clustered table: the same rows as ``explore.customer_search``."""
    ranges = {"Customer_Age": age, "Income": income}
    if gender != "All":
        ranges["Gender"] = (gender, gender)
    if band != "All":
        if band not in rules.BANDS:
            return spark.read.parquet(f"{path}/rows").where("false")
        ranges["credit_score_band"] = (band, band)
    return explore.customer_search(clustered_rows(spark, path, ranges), age, income, gender, band)
