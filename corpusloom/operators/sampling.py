"""Deterministic sorts, limits and samples."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first *n* rows in order; Spark keeps n rows per task and merges them."""
    return df.orderBy(order).limit(n)


def seeded_draw(df: DataFrame, id_column: str, n: int, seed: int, always: list[int]) -> DataFrame:
    """Rows of a seeded draw of *n* ids without replacement, the ids in *always* put first and never drawn.

    An id's place is the hash of seed and id, so the draw is one bounded top-n and does not depend on partitions.
    """
    rest = df.where(~F.col(id_column).isin(always)) if always else df
    drawn = rest.select(id_column).distinct().orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")), 256), id_column).limit(n)
    chosen = drawn.unionByName(df.where(F.col(id_column).isin(always)).select(id_column).distinct()) if always else drawn
    return df.join(F.broadcast(chosen), id_column, "left_semi")  # at most n + len(always) rows


def positions(df: DataFrame, order: str, name: str = "position") -> DataFrame:
    """*df* with each row's number from 0 in the order of the unique column *order*.

    The order is cut into ranges; a row's number is its place within the range and the rows of the ranges before, so
    no task sees more than its own range and the driver's table has a row for each.
    """
    placed = df.orderBy(order).withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = written(placed, "ordered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def library_sample(df: DataFrame, id_column: str, n: int, seed: int, always: list[int] | None = None) -> DataFrame:
    """The rows that the standard library's ``Random(seed).sample`` draws from the ids in order, without those in
    *always*, which are put to them.

    The library draws places, for which it needs the number of ids and not the ids; so only *n* places go to the plan.
    """
    ids = positions(df.where(~F.col(id_column).isin(always or [])).select(id_column).distinct() if always else df.select(id_column).distinct(), id_column, "_at")
    drawn = random.Random(seed).sample(range(ids.count()), n)
    chosen = ids.where(F.col("_at").isin(drawn)).select(id_column)
    if always:
        chosen = chosen.unionByName(df.where(F.col(id_column).isin(always)).select(id_column).distinct())
    return df.join(F.broadcast(chosen), id_column, "left_semi")  # at most n + len(always) rows


def seeded_shuffle(df: DataFrame, id_column: str, seed: int, n: int) -> DataFrame:
    """*n* rows in the order of the hash of id and seed."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed))), 256), id_column).limit(n)
