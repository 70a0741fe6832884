"""Statistics of groups given back to their members, and masked, clipped losses over tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CLIP_HIGH, CLIP_LOW


def positional_group(index: str, size: int) -> Column:
    """The group of rows i*size to i*size + size - 1."""
    return F.floor(F.col(index) / size).cast("long")


def positional_groups(df: DataFrame, index: str, size: int, group: str = "group_id") -> DataFrame:
    """*df* with the positional group of each row; rows that do not divide into groups of *size* are an error.

    *index* numbers the rows from 0.  The check is one aggregate of one row, joined by broadcast.
    """
    whole = df.agg(F.count("*").alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    sound = (F.col("n") % size == 0) & ((F.col("n") == 0) | ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)))
    checked = whole.select(F.when(sound, True).otherwise(F.raise_error(F.lit(f"rows do not divide into groups of {size}"))).alias("_sound"))
    return df.crossJoin(F.broadcast(checked)).where("_sound").drop("_sound").withColumn(group, positional_group(index, size))


def _with(df: DataFrame, group: str, *stats: Column) -> DataFrame:
    """*df* with statistics of its group: partial aggregates joined back, so a hot group is never one window.

    Rows without a group are a group, as they are in a window.
    """
    per = df.groupBy(F.col(group).alias("_group")).agg(*stats)
    return df.join(per, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def group_advantages(df: DataFrame, group: str, reward: str, normalise: bool = False) -> DataFrame:
    """advantage = reward less the group's mean, divided by (sample deviation + 1e-6) if *normalise*.

    In a group of one the deviation does not exist, and the normalised advantage is null.
    """
    out = _with(df, group, F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_std"))
    a = F.col(reward) - F.col("_mean")
    return out.withColumn("advantage", a / (F.col("_std") + 1e-6) if normalise else a).drop("_mean", "_std")


def informative(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Whether the rewards of the row's group are not all equal."""
    out = _with(df, group, F.min(reward).alias("_lo"), F.max(reward).alias("_hi"))
    return out.withColumn("informative", F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False))).drop("_lo", "_hi")


def token_loss(new_logp: str = "new_logp", old_logp: str = "old_logp", advantage: str = "advantage", low: float = CLIP_LOW, high: float = CLIP_HIGH) -> Column:
    """-min(ratio * advantage, clip(ratio, 1 - low, 1 + high) * advantage)."""
    ratio = F.exp(F.col(new_logp) - F.col(old_logp))
    clipped = F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high))
    return -F.least(ratio * F.col(advantage), clipped * F.col(advantage))


def masked_loss(tokens: DataFrame, how: str, completion: str = "completion_id", group: str = "group_id", mask: str = "mask") -> DataFrame:
    """One row (loss): token, the mean over all tokens; sequence, the mean over completions of their means; prompt, the
    mean over groups of theirs.  Masks may be fractional; what stands at a mask of 0 does not count, be it not a
    number.  A completion or group without masked tokens has no mean and does not count."""
    m = F.col(mask).cast("double")
    masked = tokens.withColumn("_l", F.when(m != 0, token_loss() * m).otherwise(F.lit(0.0))).withColumn("_m", m)
    mean = F.try_divide(F.sum("_l"), F.sum("_m"))
    if how == "token":
        return masked.agg(mean.alias("loss"))
    if how in ("sequence", "prompt"):
        return masked.groupBy(completion if how == "sequence" else group).agg(mean.alias("_mean")).agg(F.avg("_mean").alias("loss"))
    raise ValueError(f"unknown aggregation: {how}")


def masked_loss_arrays(df: DataFrame, how: str, **columns: str) -> DataFrame:
    """The same from one row per completion with arrays new_logp, old_logp and mask."""
    zipped = df.select("completion_id", "group_id", "advantage", F.explode(F.arrays_zip("new_logp", "old_logp", "mask")).alias("t"))
    return masked_loss(zipped.select("completion_id", "group_id", "advantage", "t.new_logp", "t.old_logp", "t.mask"), how, **columns)
