"""Exact dedup by distributed MSD radix partitioning (operator 10).

Texts are compared by their bytes, most significant first, without a digest.
A digit is a run of successive bytes of the normalised text; round ``r`` takes
``DIGIT * GROW ** r`` bytes, so a text of b bytes ends after about log(b)
rounds and each byte is looked at once.  A group is split by its next digit;
a group of one row is done, and so is a group whose digit came out short,
because all its texts have ended: they are equal.  Only rows of groups that are
neither go to the next round.

Splitting is a grouped count over (group, digit), summed before the shuffle and
written.  It is joined back by shuffle: a group with a third of all rows is one
row on one side and is split over tasks by the adaptive skew join on the other.
What is shuffled is a row's digit and the bytes after it, so a text's bytes move
once a round and only while its group is undecided.  The first digit alone, which
decides most rows, is joined by broadcast while its groups' measured size is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Tables, broadcast_if_small

DIGIT, GROW = 64, 8


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def _split(data: Column, length: int) -> tuple[Column, Column]:
    """The next digit of a binary column, and what is left of it."""
    return F.substring(data, 1, length), F.substring(data, length + 1, 1 << 30)


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, row)`` for each row of ``docs``.

    Rows are grouped by equal normalised text.  ``kept`` is true for exactly
    one row of a group: the one with the smallest doc_id (null ids last; of
    rows that share it, any one).  ``keep_id`` is that row's doc_id, null only
    if all of the group's are.  ``carry`` names columns to return, for each row,
    in the struct ``row`` (null without it).  Empty and null texts are equal to
    each other.  Extra columns are ignored unless carried; an empty table
    gives no rows."""
    tables = Tables(docs.sparkSession, "radix")
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("struct<none:long>")
    start = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        row.alias("row"))
    digit, rest = _split(normalised(F.col("text")).cast("binary"), DIGIT)
    heads = tables.write(start.select(digit.alias("digit")).groupBy("digit").agg(F.count("*").alias("n"))
                         .where("n > 1").select("digit", F.monotonically_increasing_id().alias("gid")), "heads")
    done = F.col("gid").isNull()
    now = tables.write(
        start.withColumn("digit", digit).join(broadcast_if_small(heads, heads.count() * 2 * DIGIT), "digit", "left")
        .select("doc_id", F.when(~done, rest).alias("rest"), "row", "gid", done.alias("alone"),
                F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
        .withColumn("rid", F.monotonically_increasing_id()), "rows")
    tables.drop("heads")
    single = now.where("alone").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                       F.lit(True).alias("kept"), "text_sha256", "row")
    results, length = [single], DIGIT * GROW
    columns = ["doc_id", "rest", "row", "text_sha256", "rid", "gid"]
    live = now.where("not alone").select(*columns)
    while not live.isEmpty():
        name = f"round-{len(results)}"
        digit, rest = _split(F.col("rest"), length)
        split = live.withColumns({"digit": digit, "rest": rest})
        groups = tables.write(
            split.groupBy("gid", "digit").agg(
                F.count("*").alias("group_size"), F.min("rid").alias("next"),
                F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first")), f"{name}-groups")
        ended = (F.col("group_size") == 1) | (F.length("digit") < length)
        moved = split.join(groups.hint("merge"), ["gid", "digit"]).select(
            "doc_id", F.when(~ended, F.col("rest")).alias("rest"), "row", "text_sha256", "rid",
            F.col("next").alias("gid"), ended.alias("ended"), F.col("first.doc_id").alias("keep_id"), "group_size",
            (F.col("first.rid") == F.col("rid")).alias("kept"))
        moved = tables.write(moved, name)
        tables.drop(f"{name}-groups")
        results.append(moved.where("ended").select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "row"))
        live = moved.where("not ended").select(*columns)
        length *= GROW
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out
