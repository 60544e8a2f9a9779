"""Mixing sources to target weights by temperature (operator 2).

A source's weight is its token share to the power ``x``, normalised: 1 keeps
the corpus as it is, 0 gives each source the same.  ``x`` is bisected so that
the weights reach a target entropy, or so that no source is repeated more than
a limit; with both, the limit wins.  Each step evaluates a row of exponents in
one grouped pass over the table of sources, so any number of sources will do.

A weight and the token budget make a source's tokens to draw.  They are drawn
in blocks: a block is a permutation of the whole source, in the order of a hash
of (seed, document, block).  Full blocks take every document once; the last one
takes documents in its order while the budget lasts.  Where it ends is found by
sums over ever finer ranges of the hash, each a grouped sum, and a running sum
within the last range alone: a source with a third of all rows is never in one
task.  Drawing is then a comparison of hashes, row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, Tables, broadcast_if_small

STEPS, ROUNDS, BITS = 16, 12, (52, 40)


def word_count(text: Column) -> Column:
    """Words of a text; null and empty have none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")).cast("long")


def _sums(sources: DataFrame, total: float, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: sum of powers, entropy, and the largest weight/share."""
    share = F.col("tokens") / total
    powers = [F.sum(F.pow(share, F.lit(x))) for x in exponents]
    logs = [F.sum(F.pow(share, F.lit(x)) * F.log(share)) for x in exponents]
    most = [F.max(F.pow(share, F.lit(x - 1))) for x in exponents]
    row = sources.agg(*powers, *logs, *most).first()
    n = len(exponents)
    return [(row[i], math.log(row[i]) - x * row[n + i] / row[i], row[2 * n + i] / row[i]) for i, x in enumerate(exponents)]


def fit_exponent(sources: DataFrame, total: int, budget: float, target_entropy: float | None,
                 max_repeats: float | None) -> float:
    """The exponent in [0, 1] for the target.  Both the entropy and the largest
    repetition fall as it rises; it is the least that keeps the repetition
    limit and does not exceed the target entropy (0 if all do, 1 if none does)."""
    low, high = 0.0, 1.0

    def fits(entropy: float, ratio: float) -> bool:
        return ((target_entropy is None or entropy <= target_entropy)
                and (max_repeats is None or ratio * budget / total <= max_repeats))

    if target_entropy is None and max_repeats is None:
        return 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / STEPS for k in range(STEPS + 1)]
        good = [x for x, (_, entropy, ratio) in zip(grid, _sums(sources, total, grid)) if fits(entropy, ratio)]
        if not good or good[0] == low:
            return good[0] if good else high
        low, high = good[0] - (high - low) / STEPS, good[0]
    return high


def _same(a: str, b: DataFrame, left: DataFrame) -> Column:
    return left[a].eqNullSafe(b["of"])


def _ends(rows: DataFrame, plan: DataFrame, small: int) -> DataFrame:
    """(of, last): the largest hash that the last block of a source still takes."""
    at = rows.join(broadcast_if_small(plan, small), rows["source"].eqNullSafe(plan["of"])).select(
        "of", "tokens", "rest", F.xxhash64("key", "blocks").alias("order"))
    for bits in BITS:
        bin_ = F.shiftright("order", bits)
        sums = at.groupBy("of", "rest", bin_.alias("bin")).agg(F.sum("tokens").alias("t"))
        before = Window.partitionBy("of").orderBy("bin")
        bins = sums.withColumn("upto", F.sum("t").over(before))
        edge = (bins.where("upto > rest").groupBy("of").agg(F.min(F.struct("bin", (F.col("rest") - F.col("upto") + F.col("t")).alias("rest"))).alias("e"))
                .select(F.col("of").alias("of2"), F.col("e.bin").alias("bin"), F.col("e.rest").alias("rest2")))
        at = at.join(broadcast_if_small(edge, small), at["of"].eqNullSafe(edge["of2"]) & (F.shiftright("order", bits) == F.col("bin"))).select(
            "of", "tokens", F.col("rest2").alias("rest"), "order")
    run = Window.partitionBy("of").orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (at.withColumn("upto", F.sum("tokens").over(run)).where("upto > rest")
            .groupBy("of").agg(F.min("order").alias("last")))


def mix_sources(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                target_entropy_share: float | None = 0.98, max_repeats: float | None = 4.0,
                budget_tokens: int | None = None, seed: int = 17) -> DataFrame:
    """``(row, source, tokens, block, place)``: a row for each drawn document.

    ``row`` is the struct of all its columns, ``block`` the number of the
    permutation (0, 1, ...) and ``place`` its order in it.  ``target_entropy_share``
    is the target entropy as a share of log(number of sources); the budget is
    the corpus itself unless given.  Tokens are words.

    A null source is a source.  Documents without words add no tokens: they are
    drawn in full blocks and as the last block's order has it; a source without
    any word is not drawn.  Equal rows have equal places and are drawn
    together.  Null ids are ids.  An empty table gives no rows."""
    tables = Tables(docs.sparkSession, "mixing")
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(f"`{source_col}`").cast("string").alias("source"),
                        word_count(F.col(f"`{text_col}`")).alias("tokens"), key.alias("key"))
    narrow = tables.write(named.select("source", "tokens", "key"), "narrow")
    sources = tables.write(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "sources")
    found = sources.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).first()
    n, total = found["n"], found["tokens"] or 0
    if not n:
        return named.where("false").select("row", "source", "tokens", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("place"))
    budget = total if budget_tokens is None else budget_tokens
    target = None if target_entropy_share is None else target_entropy_share * math.log(n)
    x = fit_exponent(sources, total, budget, target, max_repeats)
    (power, _, _), = _sums(sources, total, [x])
    draw = F.pow(F.col("tokens") / total, F.lit(x)) / power * budget
    # shares of a source's own tokens; rounding keeps a whole number of blocks whole
    blocks = F.floor(F.round(draw / F.col("tokens"), 9)).cast("long")
    plan = tables.write(sources.select(F.col("source").alias("of"), blocks.alias("blocks"),
                                       F.round(draw - blocks * F.col("tokens")).cast("long").alias("rest")), "plan")
    small = n * 64
    ends = tables.write(_ends(narrow, plan, small), "ends")
    tables.drop("narrow", "sources")
    whole = plan.join(ends.withColumnRenamed("of", "of2"), plan["of"].eqNullSafe(F.col("of2")), "left").select("of", "blocks", "rest", "last")
    drawn = named.join(broadcast_if_small(whole, small), named["source"].eqNullSafe(whole["of"])).select(
        "row", "source", "tokens", "blocks", "rest", "last", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))).alias("block"))
    drawn = drawn.withColumn("place", F.xxhash64("key", "block"))
    # without an end the last block's whole budget covers the source only if there is a budget
    last = (F.col("rest") > 0) & (F.col("last").isNull() | (F.col("place") < F.col("last")))
    return drawn.where((F.col("block") < F.col("blocks")) | last).select("row", "source", "tokens", "block", "place")


def source_weights(drawn: DataFrame) -> DataFrame:
    """(source, documents, tokens) of a drawn mixture."""
    return drawn.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
