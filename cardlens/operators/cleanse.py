"""Cleansing operators B1-B4.

Fitted statistics (column modes) are small -- one value per column -- and
are collected like an ML ``fit`` result, then applied as literals so the
apply step stays a narrow projection inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_FORMAT = "dd-MM-yyyy"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def parse_dates(df: DataFrame, cols=("Week_Start_Date",), fmt: str = DATE_FORMAT) -> DataFrame:
    """B1: text -> date; unreadable text -> null (try_to_date, safe under ANSI)."""
    out = df
    for c in cols:
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
            out = out.withColumn(c, F.try_to_date(F.col(c), fmt))
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def fill_numeric(df: DataFrame, value=0) -> DataFrame:
    """B2: null -> 0 in every numeric column."""
    return df.fillna(value, subset=numeric_columns(df))


def mode_columns(df: DataFrame, skip=("Week_Start_Date",)) -> list[str]:
    """Non-numeric columns that B3 fills (dates/timestamps excluded).  A
    column the schema marks non-nullable cannot hold a null, so filling it is
    a no-op and its mode is not computed."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in skip and f.nullable]


def column_modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent non-null value per column; ties -> smallest value.

    Distributed form: unpivot to (column, value), count per pair (the
    partial aggregate runs map-side, so a value holding a third of all rows
    costs one counter per task), then pick the winner per column from the
    reduced counts.  Output is one row per column.
    """
    if not cols:
        return {}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in cols
    ])).alias("p")).select("p.col", "p.val").where(F.col("val").isNotNull())
    counts = pairs.groupBy("col", "val").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("col").agg(
        F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("val").alias("val"))).alias("w"))
    found = {r["col"]: r["w"]["val"] for r in best.collect()}
    return {c: found.get(c) for c in cols}


def apply_modes(df: DataFrame, modes: dict, default: str = "Unknown") -> DataFrame:
    """Null -> the column's mode (``column_modes`` gives it as text), cast to
    the column's type; a string column without any value -> ``default``, a
    boolean one stays null."""
    fills = {}
    for c, m in modes.items():
        kind = df.schema[c].dataType
        if m is None and not isinstance(kind, T.StringType):
            continue
        fills[c] = F.coalesce(F.col(c), F.lit(default if m is None else m).cast(kind))
    return df.withColumns(fills) if fills else df


def fill_mode(df: DataFrame, default: str = "Unknown", skip=("Week_Start_Date",),
              only: list[str] | None = None) -> DataFrame:
    """Null -> column mode; a column with no values -> 'Unknown'.  ``only``
    names the columns that later steps read: no other mode is fitted, and
    without any of them no job runs."""
    cols = [c for c in mode_columns(df, skip) if only is None or c in only]
    return apply_modes(df, column_modes(df, cols), default)


def fill_default(df: DataFrame, col: str = "Personal_loan", value: str = "no") -> DataFrame:
    """Constant default for one column."""
    return df.fillna({col: value}) if col in df.columns else df


def clean(df: DataFrame, only: list[str] | None = None) -> DataFrame:
    """B1 -> B2 -> B3 -> B4 in the reference's order; B3 for the columns in
    ``only`` if given."""
    return fill_default(fill_mode(fill_numeric(parse_dates(df)), only=only))
