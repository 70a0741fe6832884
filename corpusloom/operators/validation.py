"""Two-sided validation of answer keys, and outcomes of gate chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import GATES


def two_sided(tasks: DataFrame, oracle: DataFrame, nop: DataFrame) -> DataFrame:
    """(task, oracle, nop, keep, reason): tasks joined to their two results, kept if the answer key scored 1 and the
    empty submission 0.  *oracle* is (task, oracle, failed_gate, message), *nop* (task, nop).  A missing result is a
    failure, never a null decision."""
    joined = tasks.select("task").join(oracle, "task", "left").join(nop, "task", "left")
    good, rejected = F.col("oracle").eqNullSafe(F.lit(1.0)), F.col("nop").eqNullSafe(F.lit(0.0))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    reason = F.when(~good, F.concat(F.lit("oracle failed at "), text("failed_gate"), F.lit(": "), text("message"))).when(~rejected, F.concat(F.lit("nop scored "), text("nop")))
    return joined.select("task", "oracle", "nop", (good & rejected).alias("keep"), reason.alias("reason"))


def gate_histogram(results: DataFrame) -> DataFrame:
    """(failed_gate, n): how often each gate was the one that failed; ``passed`` for none."""
    return results.groupBy(F.coalesce("failed_gate", F.lit("passed")).alias("failed_gate")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "failed_gate")


def gate_funnel(results: DataFrame, gates: list[str] = GATES) -> DataFrame:
    """(place, gate, reached, passed).  The failed gate decides, not the recorded flags: a flag may be set although a
    later repetition failed there.  A crashed grading reached no gate."""
    known = F.array(*(F.lit(g) for g in gates))
    at = F.when(F.col("failed_gate").isNull(), len(gates) + 1).otherwise(F.array_position(known, F.col("failed_gate")))
    spread = results.select(at.alias("at"), F.posexplode(known).alias("place", "gate")).where("at > 0")
    place = F.col("place") + 1
    return spread.groupBy(place.alias("place"), "gate").agg(F.count_if(F.col("at") >= place).alias("reached"), F.count_if(F.col("at") > place).alias("passed"))


def first_failure(df: DataFrame, gates: list[str] = GATES, prefix: str = "gate_") -> DataFrame:
    """failed: the first gate in order whose flag is 0; null if all are passed, ``crash`` if a flag is missing."""
    missing = F.lit(False)
    for g in gates:
        missing = missing | F.col(prefix + g).isNull()
    return df.withColumn("failed", F.when(missing, "crash").otherwise(F.coalesce(*(F.when(F.col(prefix + g) == 0, g) for g in gates))))
