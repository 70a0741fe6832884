"""Counts, shares, frequency tables, nearest-rank percentiles and capped histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bands of distinct values that nearest_rank sorts apart.
BANDS = 64


def count_shares(df: DataFrame, **conditions: Column) -> DataFrame:
    """(measure, n, share): how many rows meet each condition, in one pass; the share of no rows is null."""
    names = sorted(conditions)
    one = df.agg(F.count("*").alias("total"), *(F.count_if(conditions[n]).alias(n) for n in names))
    pairs = F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).alias("n")) for n in names))
    return one.select("total", F.explode(pairs).alias("p")).select("p.measure", "p.n", F.round(F.try_divide(F.col("p.n").cast("double"), F.col("total").cast("double")), 6).alias("share"))


def checks_all(df: DataFrame, **checks: Column) -> DataFrame:
    """count_shares of each check and, as ``all``, of their conjunction; a null check fails."""
    sure = {n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}
    every = F.lit(True)
    for c in sure.values():
        every = every & c
    return count_shares(df, **sure, all=every)


def top_k(df: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """(value, n): most frequent first; ties by first appearance in *order*, then by value.  Occurrences are counted."""
    first = F.min(order).alias("_first")
    return df.groupBy(value).agg(F.count("*").alias("n"), first).orderBy(F.desc("n"), "_first", value).limit(k).drop("_first")


def nearest_rank(df: DataFrame, values: list[str], percents: list[int]) -> DataFrame:
    """(measure, percent, value): the element at 0-based place min(n - 1, int(q / 100 * n)) of the sorted values.

    Exact without a global sort: values are counted first, so only the distinct ones are ordered.  Approximate
    quantiles of the distinct values cut them into bands of about equal numbers, whatever their spread; each band's
    count is known before any is sorted, and the sort of a band is one task's.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values))).alias("x"))
    counts = long.select("x.measure", "x.value").where("value is not null").groupBy("measure", "value").agg(F.count("*").alias("c"))
    cuts = [i / BANDS for i in range(1, BANDS)]
    bounds = counts.groupBy("measure").agg(F.percentile_approx("value", cuts).alias("cuts"), F.sum("c").alias("n"))
    # As many rows as measures, with BANDS numbers each.
    banded = counts.join(F.broadcast(bounds), "measure").withColumn("band", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    offset = banded.groupBy("measure", "band").agg(F.sum("c").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("measure").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("measure", "band").orderBy("value")
    ranked = banded.join(F.broadcast(offset.select("measure", "band", "before")), ["measure", "band"]).withColumn("upto", F.col("before") + F.sum("c").over(within))
    asked = F.explode(F.array(*(F.lit(q) for q in percents))).alias("percent")
    places = ranked.select("measure", "value", "n", "c", "upto", asked).withColumn("place", F.least(F.col("n") - 1, F.floor(F.col("percent") / F.lit(100.0) * F.col("n"))))
    return places.where("place < upto and place >= upto - c").select("measure", "percent", "value")


def capped_histogram(df: DataFrame, size: Column, cap: int = 4) -> DataFrame:
    """(label, n): rows per size, sizes of *cap* and more together."""
    s = F.least(size, F.lit(cap))
    label = F.when(s == cap, f"{cap}+").otherwise(s.cast("string"))
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
