"""The standard chain: adapter -> D1 join -> B1-B4 cleansing -> C1-C6 scores."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from ..operators import cleanse, scoring
from ..sources import adapter, tables


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.cc_detail(spark, sf_dir)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.cust_detail(spark, sf_dir)


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.join_profile(accounts(spark, sf_dir), customers(spark, sf_dir))


#: String columns that the score and fraud rules read (non-nullable in the
#: adapter, so fitting them costs nothing there).
RULE_STRINGS = ["House_Owner", "Personal_loan"]


def portfolio(spark: SparkSession, sf_dir: str, reads: list[str] | None = None) -> DataFrame:
    """One row per account-week (key ``Txn_Id``) with customer attributes,
    cleansed, scored, banded and flagged.  ``reads`` names the columns that the
    caller uses: modes (B3) are fitted for those alone, and only they come back."""
    only = None if reads is None else [*reads, *RULE_STRINGS]
    p = scoring.add_scores(cleanse.clean(joined(spark, sf_dir), only))
    return p if reads is None else p.select(*dict.fromkeys(reads))


def materialized(df: DataFrame) -> DataFrame:
    """Written once under the shared checkpoint folder (see tables.materialize)."""
    return tables.materialize(df)


def portfolio_table(spark: SparkSession, sf_dir: str, cols: list[str] | None = None) -> DataFrame:
    """The portfolio written once for multi-pass queries; ``cols`` limits the
    written table to the columns the query reads."""
    return materialized(portfolio(spark, sf_dir, cols))
