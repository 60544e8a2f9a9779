"""CSV scans of the shipped card files (A1, A2) and header/value normalisation."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import CC_SCHEMA, CUST_SCHEMA, canonical_name, csv_read_schema


class BadHeader(ValueError):
    pass


REJECT = "_rejected"


def file_schema(spark: SparkSession, path: str, schema: T.StructType) -> tuple[T.StructType, dict[str, str]]:
    """The read schema in the files' own column order, and for each column of
    ``schema`` the header under which the files have it.  Header names go
    through ``canonical_name``; missing and repeated columns are refused, other
    columns are read as text and left out."""
    first = spark.read.text(path).first()  # one line: the header of the files' first
    names = next(csv.reader([first["value"].lstrip("\ufeff")])) if first else []
    found: dict[str, str] = {}
    for name in names:
        if canonical_name(name) in found:
            raise BadHeader(f"{path}: column {canonical_name(name)} is there twice")
        found[canonical_name(name)] = name
    missing = [f.name for f in schema.fields if f.name not in found]
    if missing:
        raise BadHeader(f"{path}: missing columns {missing}")
    kinds = {f.name: f.dataType for f in csv_read_schema(schema).fields}
    read = T.StructType([T.StructField(n, kinds.get(canonical_name(n), T.StringType())) for n in names])
    return read.add(REJECT, T.StringType()), {f.name: found[f.name] for f in schema.fields}


def shaped(raw: DataFrame, names: dict[str, str], schema: T.StructType, reject: bool = False) -> DataFrame:
    """The declared columns of a raw scan, whole lines only (or the others)."""
    columns = [F.col(f"`{names[f.name]}`").alias(f.name) for f in schema.fields]
    # a line is only checked in the columns that are read, so the filter reads them all (always true)
    every = F.pmod(F.xxhash64(*columns), F.lit(2)) < 2
    if reject:
        return raw.where(F.col(REJECT).isNotNull() & every).select(F.col(REJECT).alias("line"))
    return raw.where(F.col(REJECT).isNull() & every).select(*columns)


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, dict[str, str]]:
    read, names = file_schema(spark, path, schema)
    # without enforceSchema Spark refuses a file whose header is another one or in another order
    df = (spark.read.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", REJECT).schema(read).csv(path))
    return df, names


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the right shape and types; the others are ``rejects``."""
    return shaped(*_scan(spark, path, schema), schema)


def rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines that do not fit the schema (too short, too long, a number that is
    none), as text: load them after repair instead of scoring nulls."""
    return shaped(*_scan(spark, path, schema), schema, reject=True)


def read_cc_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: account-week facts; date kept as text for B1."""
    return normalize_values(_read(spark, path, CC_SCHEMA))


def read_cust_csv(spark: SparkSession, path: str) -> DataFrame:
    """A2: customer dimension."""
    return normalize_values(_read(spark, path, CUST_SCHEMA))


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[canonical_name(c) for c in df.columns])


def normalize_values(df: DataFrame) -> DataFrame:
    """Canonical column names, blanks trimmed from every string value."""
    df = normalize_headers(df)
    return df.select(*[
        F.trim(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])
