"""Expressions over arrays, maps and nested episode traces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import PHASES


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def elements(shapes: str | Column) -> Column:
    """Sum over shapes of the product of their sizes; a scalar shape counts one; null for null."""
    one = F.lit(1).cast("long")
    return F.aggregate(_c(shapes), F.lit(0).cast("long"), lambda a, s: a + F.aggregate(s, one, lambda p, d: p * d))


def weighted_sum(rewards: str | Column) -> Column:
    """Sum of score times weight over the map's non-null values; 0 for an empty or null map."""
    kept = F.filter(F.map_values(_c(rewards)), lambda r: r.isNotNull())
    return F.coalesce(F.aggregate(kept, F.lit(0.0), lambda a, r: a + r["score"] * r["weight"]), F.lit(0.0))


def flagged(nodes: str | Column, field: str) -> Column:
    """How many array elements have the boolean field set; null counts as not set."""
    return F.coalesce(F.size(F.filter(_c(nodes), lambda n: F.coalesce(n[field], F.lit(False)))), F.lit(0)).cast("long")


def only(array: str | Column) -> Column:
    """The single element of an array; an array of another length is an error."""
    a = _c(array)
    return F.when(F.size(a) == 1, a[0]).otherwise(F.raise_error(F.lit("expected exactly one element")))


def last_end(timing: str | Column) -> Column:
    """The end of the last phase that ran; a phase that never ran has the end 0."""
    t = _c(timing)
    return F.greatest(*(t[p]["end_s"] for p in PHASES))


def max_abs_diff(a: str | Column, b: str | Column) -> Column:
    return F.array_max(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def all_close(a: str | Column, b: str | Column, rtol: float = 1e-3, atol: float = 1e-5) -> Column:
    """Whether the arrays have equal length, only finite values, and |a - b| <= atol + rtol * |b| throughout."""
    x, y = _c(a), _c(b)
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    close = F.zip_with(x, y, lambda p, q: finite(p) & finite(q) & (F.abs(p.cast("double") - q.cast("double")) <= atol + rtol * F.abs(q.cast("double"))))
    return F.when(F.size(x) != F.size(y), F.lit(False)).otherwise(F.forall(close, lambda v: F.coalesce(v, F.lit(False))))
