"""Ordered rules that each give a reason or null; the first reason wins.  Rules are columns, so Catalyst sees them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import elements
from ..functions.fixed import LICENSE_PREFIXES, MAX_ELEMENTS, MAX_LINES, SCAN_PATTERNS
from ..functions.text import category, line_count


def first_reason(*reasons: Column) -> Column:
    """The first non-null reason in order; null if no rule objects."""
    return F.coalesce(*reasons)


def license_reason(licenses: str = "licenses", prefixes: Iterable[str] = LICENSE_PREFIXES) -> Column:
    """None listed (null or empty list), or any that starts with one of the prefixes in any letter case."""
    pattern = "^(" + "|".join(p.replace("-", r"\-") for p in prefixes) + ")"
    listed = F.coalesce(F.col(licenses), F.array().cast("array<string>"))
    bad = F.filter(listed, lambda x: F.coalesce(F.upper(x).rlike(pattern), F.lit(False)))
    return F.when(F.size(listed) == 0, "license: none listed").when(F.size(bad) > 0, F.concat(F.lit("license: restricted "), F.array_join(bad, ", ")))


def length_reason(text: str, limit: int = MAX_LINES) -> Column:
    n = line_count(text)
    return F.when(n > limit, F.concat(F.lit("length: "), n.cast("string"), F.lit(f" lines > {limit}")))


def shapes_reason(shapes: str | Column, limit: int = MAX_ELEMENTS) -> Column:
    """Shapes that could not be read, no elements, or too many."""
    s = F.col(shapes) if isinstance(shapes, str) else shapes
    n = elements(s)
    return F.when(s.isNull(), "inputs: shapes not readable").when(n == 0, "inputs: no tensors").when(n > limit, F.concat(F.lit("inputs: "), n.cast("string"), F.lit(f" elements > {limit}")))


def parse_reason(parses: str | Column) -> Column:
    p = F.col(parses) if isinstance(parses, str) else parses
    return F.when(~F.coalesce(p, F.lit(False)), "parse: not valid source")


def pattern_reason(text: str, patterns: list[tuple[str, str]] = SCAN_PATTERNS) -> Column:
    """The reason of the first pattern found anywhere.  ^ stands after newlines only; classes are Unicode-aware."""
    t = F.col(text)
    return F.coalesce(*(F.when(t.rlike("(?mdU)" + p), reason) for p, reason in patterns))


def decide(df: DataFrame, *reasons: Column) -> DataFrame:
    """*df* with the column reason; rows with a null reason are kept."""
    return df.withColumn("reason", first_reason(*reasons))


def fan_out(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of a decided table.  Persist it first if both are written, so that it is computed once."""
    return decided.where("reason is null").drop("reason"), decided.where("reason is not null")


def reason_histogram(decided: DataFrame) -> DataFrame:
    """(category, n): rows per reason category, ``kept`` for none; most frequent first, ties by name."""
    return decided.groupBy(F.coalesce(category("reason"), F.lit("kept")).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")
