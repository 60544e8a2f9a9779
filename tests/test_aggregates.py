"""Aggregates kept up under appends equal the full recount."""

import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from cardlens.operators import explore
from cardlens.plans.portfolio import portfolio_table
from cardlens.session import ensure_checkpoint_dir
from cardlens.streaming import aggregates
from conftest import SF0001

VIEWS = ["aggregate_stats", "overview_metrics", "band_distribution", "fraud_distribution", "weekly_trends"]


def same(state, rows):
    for view in VIEWS:
        want, got = getattr(explore, view)(rows), getattr(state, view)()
        assert want.columns == got.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), view


@pytest.fixture(scope="module")
def table(spark):
    p = portfolio_table(spark, SF0001, aggregates.READS)
    odd = p.limit(3).withColumns({"Client_Num": F.lit(None).cast("long"), "Week_Start_Date": F.lit(None).cast("date"),
                                  "Credit_Limit": F.lit(None).cast("long"), "fraud_flag": F.lit(None).cast("long")}).select(*p.columns)
    from cardlens.sources.tables import materialize
    # a third of the rows have one client
    hot = F.when(F.xxhash64("Total_Trans_Amt", "Client_Num") % 3 == 0, F.lit(7)).otherwise(F.col("Client_Num"))
    return materialize(p.withColumn("Client_Num", hot).unionByName(odd).withColumn(
        "b", F.pmod(F.xxhash64("Total_Trans_Amt", "Total_Trans_Ct"), F.lit(5)).cast("int")))


def new_state(spark, every):
    return aggregates.AggregateState(spark, f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4().hex}", every)


@pytest.mark.parametrize("every", [64, 2])
def test_equal_to_the_recount_after_each_batch_and_replay(spark, table, every):
    state = new_state(spark, every)
    with pytest.raises(ValueError):
        state.cells()
    for b in range(5):
        rows = table.where(F.col("b") == b).drop("b")
        state.update(rows, b)
        if b in (1, 3):
            state.update(rows, b)  # run again: the batch was not committed
        if b > 2:
            same(state, table.where(F.col("b") <= b).drop("b"))
    state.update(table.drop("b").where("false"), 5)  # an empty batch
    same(state, table.drop("b"))


def test_half_written_part_is_not_read(spark, table):
    state = new_state(spark, 64)
    first, second = (table.where(F.col("b") == b).drop("b") for b in (0, 1))
    state.update(first, 0)
    second.select("Client_Num").distinct().write.parquet(f"{state.path}/batch=1/clients")  # and then the job was lost
    same(state, first)
    state.update(second, 1)
    same(state, first.unionByName(second))


def test_stream_of_batches(spark, table):
    state, root = new_state(spark, 2), tempfile.mkdtemp(prefix="cardlens-agg-")
    rows, seen = table.drop("b"), []
    for b in range(3):
        table.where(F.col("b") == b).drop("b").coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        aggregates.keep_aggregates(stream, state, f"{root}/ckpt", also=lambda df, n: seen.append(n)).awaitTermination()
    assert seen == [0, 1, 2] and os.path.isdir(f"{root}/ckpt")
    same(state, table.where("b < 3").drop("b"))
