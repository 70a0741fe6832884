"""De-duplication by key, membership in key sets, and checks of disjoint and complete splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key set up to which it is broadcast; beyond it the join shuffles both sides.
BROADCAST_KEYS = 1_000_000


def small(df: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """*df* with a broadcast hint if it has at most *limit* rows, counted no further than that."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def duplicate_counts(df: DataFrame, key: Column, id_column: str) -> DataFrame:
    """One row: rows, distinct ids, and rows whose key occurs more than once."""
    per = df.select(key.alias("k"), F.col(id_column).alias("i")).groupBy("k").agg(F.count("*").alias("c"))
    ids = df.agg(F.count("*").alias("n_rows"), F.countDistinct(id_column).alias("n_ids"))
    return ids.crossJoin(F.broadcast(per.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n_duplicate_rows"))))


def keep_lowest(df: DataFrame, key: Column, id_column: str) -> DataFrame:
    """*df* with owner: the lowest id among rows of the same non-null key.

    The minimum is a grouped aggregate with partial sums in the map tasks, joined back, rather than a window: a key
    that holds a third of the rows never meets in one task, and adaptive execution splits its side of the join.
    """
    keyed = df.withColumn("_key", key)
    owners = keyed.where("_key is not null").groupBy("_key").agg(F.min(id_column).alias("owner"))
    return keyed.join(owners, "_key", "left").withColumn("owner", F.coalesce("owner", F.col(id_column))).drop("_key")


def duplicate_reason(id_column: str) -> Column:
    return F.when(F.col("owner") != F.col(id_column), F.concat(F.lit("duplicate: same code as uuid "), F.col("owner").cast("string")))


def key_union(*sets: DataFrame) -> DataFrame:
    """Distinct non-null keys of several single-column tables."""
    return reduce(DataFrame.unionByName, [s.toDF("key") for s in sets]).where("key is not null").distinct()


def in_keys(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows whose key is in the set; a null key never is."""
    return df.withColumn("key", key).join(small(keys), "key", "left_semi").drop("key")


def not_in_keys(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The other rows, those with a null key among them."""
    return df.withColumn("key", key).join(small(keys), "key", "left_anti").drop("key")


def split_check(df: DataFrame, group: str, split: str) -> DataFrame:
    """One row: groups in more than one split (0 if the split is clean), rows, and rows with a split."""
    torn = df.groupBy(group).agg(F.countDistinct(split).alias("s")).agg(F.coalesce(F.sum(F.when(F.col("s") > 1, 1)), F.lit(0)).cast("long").alias("n_torn_groups"))
    return torn.crossJoin(F.broadcast(df.agg(F.count("*").alias("n_rows"), F.count(split).alias("n_split_rows"))))


def common_groups(df: DataFrame, group: str, split: str, a: str, b: str) -> DataFrame:
    """Groups present in both splits."""
    return df.where(F.col(split) == a).select(group).intersect(df.where(F.col(split) == b).select(group))
