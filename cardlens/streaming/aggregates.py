"""Dashboard aggregates kept up under appends (A5 with D5-D8 and D13).

Each batch leaves a part of mergeable state under its number: sums and counts by
(week, band, fraud flag), and the clients that no earlier batch had.  The
aggregates are sums over the parts, so appending reads the new rows and the known
client keys, never the old rows.

A batch that is run again overwrites its own part, and asks for earlier parts
alone, so that a replay changes nothing.  Every ``every`` batches the parts so far
become one, written before it is used; parts it holds are no longer read, and a
replay of one of their batches is left out.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import rules
from ..operators.explore import r6

#: Measures of which means are shown; sums are decimals, so that they do not depend on the order.
MEASURES = ["Total_Trans_Amt", "Total_Trans_Ct", "Credit_Limit", "Total_Revolving_Bal", "Avg_Utilization_Ratio"]
CELL = ["Week_Start_Date", "credit_score_band", "fraud_flag"]
READS = ["Client_Num", *CELL, *MEASURES]
EXACT = "decimal(38,15)"


def batch_cells(rows: DataFrame) -> DataFrame:
    """One row for each (week, band, fraud flag) of a batch."""
    return rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(m).cast(EXACT)).alias(f"sum_{m}") for m in MEASURES],
                                   *[F.count(m).alias(f"count_{m}") for m in MEASURES])


def _merged(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*CELL).agg(*[F.sum(c).alias(c) if c == "n" or c.startswith("count_") else F.sum(c).cast(EXACT).alias(c)
                                      for c in cells.columns if c not in CELL])


class AggregateState:
    """The parts under ``path``."""

    def __init__(self, spark: SparkSession, path: str, every: int = 64):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    def _finished(self) -> tuple[int, list[int]]:
        """(last batch of the latest merged part or -1, batches with a part after it)."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        # cells are written last: their marker says that the part is whole
        done = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/cells/_SUCCESS"))]
        merged = max((int(n.partition("=")[2]) for n in done if n.startswith("upto=")), default=-1)
        return merged, sorted(b for n in done if n.startswith("batch=") and (b := int(n.partition("=")[2])) > merged)

    def _read(self, what: str, before: int | None = None) -> DataFrame | None:
        merged, batches = self._finished()
        parts = [f"upto={merged}"] * (merged >= 0) + [f"batch={b}" for b in batches if before is None or b < before]
        if not parts:
            return None
        return self.spark.read.parquet(*[f"{self.path}/{p}/{what}" for p in parts])

    def update(self, rows: DataFrame, batch: int) -> None:
        """Take up batch number ``batch``: scored rows with the columns ``READS``."""
        merged, _ = self._finished()
        if batch <= merged:
            return
        part = f"{self.path}/batch={batch}"
        clients = rows.select("Client_Num").where(F.col("Client_Num").isNotNull()).distinct()
        known = self._read("clients", batch)
        if known is not None:
            clients = clients.join(known, "Client_Num", "left_anti")
        clients.write.mode("overwrite").parquet(f"{part}/clients")
        batch_cells(rows).write.mode("overwrite").parquet(f"{part}/cells")
        if (batch + 1) % self.every == 0:
            self.merge(batch)

    def merge(self, upto: int) -> None:
        """One part of all batches up to ``upto``."""
        clients, cells = (self._read(what, upto + 1) for what in ("clients", "cells"))
        clients.write.mode("overwrite").parquet(f"{self.path}/upto={upto}/clients")
        _merged(cells).write.mode("overwrite").parquet(f"{self.path}/upto={upto}/cells")

    def cells(self) -> DataFrame:
        """The state so far; an error before the first batch."""
        found = self._read("cells")
        if found is None:
            raise ValueError(f"no batch has been taken up under {self.path}")
        return _merged(found)

    def _clients(self) -> DataFrame:
        """One row: the number of distinct clients."""
        return self._read("clients").agg(F.count(F.lit(1)).alias("n_clients"))

    # -- the aggregates, with the columns of operators/explore.py ------------------
    def _one_row(self, *columns) -> DataFrame:
        every = self.cells().agg(*columns)
        return every.join(self._clients())  # one row with one row

    def aggregate_stats(self) -> DataFrame:
        """D5."""
        out = self._one_row(F.sum("sum_Total_Trans_Ct").cast("long").alias("total_transactions"),
                            F.sum("sum_Total_Trans_Amt").cast("long").alias("total_transaction_amount"),
                            mean("Credit_Limit").alias("avg_credit_limit"), mean("Avg_Utilization_Ratio").alias("avg_utilization"),
                            flagged(100).alias("fraud_rate"))
        return out.select(F.col("n_clients").alias("total_customers"), "total_transactions", "total_transaction_amount",
                          "avg_credit_limit", "avg_utilization", "fraud_rate")

    def overview_metrics(self) -> DataFrame:
        """D8."""
        shown = {"avg_credit_limit": "Credit_Limit", "avg_revolving_bal": "Total_Revolving_Bal", "avg_trans_amt": "Total_Trans_Amt",
                 "avg_trans_ct": "Total_Trans_Ct", "avg_utilization": "Avg_Utilization_Ratio"}
        out = self._one_row(F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"), *[mean(m).alias(name) for name, m in shown.items()],
                            flagged(1).alias("fraud_rate"))
        return out.select("n_records", F.col("n_clients").alias("n_customers"), *shown, "fraud_rate")

    def band_distribution(self) -> DataFrame:
        """All bands, zeros included."""
        counts = self.cells().groupBy("credit_score_band").agg(F.sum("n").alias("n_rows"))
        bands = self.spark.createDataFrame([(b, i) for i, b in enumerate(rules.BANDS, 1)], "credit_score_band string, band_order long")
        return bands.join(counts, "credit_score_band", "left").select("credit_score_band", "band_order", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))

    def fraud_distribution(self) -> DataFrame:
        """D7."""
        return self.cells().groupBy("fraud_flag").agg(F.sum("n").alias("n_rows")).select(
            "fraud_flag", rules.fraud_label(F.col("fraud_flag")).alias("fraud_label"), "n_rows")

    def weekly_trends(self) -> DataFrame:
        """D13."""
        return self.cells().where(F.col("Week_Start_Date").isNotNull()).groupBy("Week_Start_Date").agg(
            mean("Total_Trans_Amt").alias("avg_trans_amt"), mean("Total_Trans_Ct").alias("avg_trans_ct"), flagged(100).alias("fraud_percentage"))


def mean(measure: str):
    """Mean of the rows of many cells, rounded as the full aggregate rounds."""
    return r6(F.sum(f"sum_{measure}").cast("double") / F.sum(f"count_{measure}"))


def flagged(scale: int):
    known = F.col("fraud_flag").isNotNull()
    return r6(F.sum(F.when(known, F.col("fraud_flag") * F.col("n"))).cast("double") / F.sum(F.when(known, F.col("n"))) * scale)


def keep_aggregates(scored: DataFrame, state: AggregateState, checkpoint_path: str, available_now: bool = True,
                    also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep ``state`` up to date with a stream of scored accounts.  ``also`` runs
    on each batch too, before the state is updated."""
    def take(rows: DataFrame, batch: int) -> None:
        if also:
            also(rows, batch)
        state.update(rows.select(*READS), batch)

    w = scored.writeStream.option("checkpointLocation", checkpoint_path).outputMode("append").foreachBatch(take)
    return (w.trigger(availableNow=True) if available_now else w).start()
