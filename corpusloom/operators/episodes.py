"""From nested episode traces to per-task pass rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import flagged, last_end, only, weighted_sum
from .dedup import small

PASS = 1.0


def flatten(episodes: DataFrame, *extra: str) -> DataFrame:
    """(episode_id, task, reward, ok, stop, turns, output_tokens, seconds) of each delivered episode, and *extra*.

    Each episode has exactly one trace.  An empty reward map gives 0; null entries of it are skipped.  No shuffle, so
    it serves tables and streams alike.
    """
    t = only("traces")
    flat = episodes.select(*extra, "episode_id", t.alias("t"), F.coalesce("ok", F.lit(False)).alias("ok"), F.col("num_output_tokens").alias("output_tokens"))
    return flat.select(
        *extra, "episode_id", F.col("t.task.data.name").alias("task"), weighted_sum("t.rewards").alias("reward"), "ok", F.col("t.stop_condition").alias("stop"),
        flagged("t.nodes", "sampled").alias("turns"), "output_tokens", (last_end("t.timing") - F.col("t.timing.start_s")).alias("seconds"),
    )


def summaries(episodes: DataFrame) -> DataFrame:
    """flatten, an episode that was delivered more than once counted once."""
    return flatten(episodes).dropDuplicates(["episode_id"])


def attempts_by_task(summary: DataFrame, *by) -> DataFrame:
    """Attempts, passes, pass rate, errors and means of the error-free attempts per task (and *by*); a task with
    errors only is left out.  One shuffle by task, after partial aggregation."""
    ok = F.col("ok")
    good = lambda c: F.avg(F.when(ok, F.col(c)))
    out = summary.groupBy("task", *by).agg(
        F.count_if(ok).alias("attempts"), F.count_if(ok & (F.col("reward") >= PASS)).alias("passes"), F.count_if(~ok).alias("errors"),
        good("turns").alias("mean_turns"), good("output_tokens").alias("mean_output_tokens"), good("seconds").alias("mean_seconds"))
    return out.where("attempts > 0").withColumn("pass_rate", F.col("passes") / F.col("attempts"))


def pass_buckets(tasks: DataFrame) -> DataFrame:
    p = F.col("pass_rate")
    return tasks.agg(F.count_if(p == 0).alias("always_fail"), F.count_if((p > 0) & (p < 1)).alias("mixed"), F.count_if(p == 1).alias("always_pass"))


def trainable(tasks: DataFrame, train: DataFrame) -> DataFrame:
    """Tasks of the train list (column task) that are neither always passed nor always failed.

    A guard on the whole run comes with it: allowed says whether every reported task is in the list, as it must be
    before the selection may be used; an empty run is allowed.
    """
    names = small(train.select("task").distinct())
    inside = tasks.join(names, "task", "left_semi")
    outside = tasks.join(names, "task", "left_anti").agg((F.count("*") == 0).alias("allowed"))
    return inside.where("pass_rate > 0 and pass_rate < 1").select("task", "pass_rate").crossJoin(F.broadcast(outside))


def stop_histogram(summary: DataFrame) -> DataFrame:
    return summary.groupBy(F.coalesce("stop", F.lit("(none)")).alias("stop")).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"))


def run_means(summary: DataFrame) -> DataFrame:
    """Means over all episodes, those with errors among them."""
    return summary.agg(F.count("*").alias("episodes"), F.avg("turns").alias("mean_turns"), F.avg("output_tokens").alias("mean_output_tokens"), F.avg("seconds").alias("mean_seconds"))
