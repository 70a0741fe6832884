"""Splits that keep related records together.

Records that share a value of an entity column (module, author, source) are linked; components come from hooking and
shortcutting over parent tables (:mod:`components`).  Which components go where is then a subset-sum problem over
component sizes: the table of multiplicities (size -> number of components) is small, since sizes that occur number at
most the square root of twice the rows, and bitsets over it give the reachable totals next to the wanted ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, guarded_broadcast
from .components import connected_components

NAMES, SHARES = ("train", "validation", "test"), (0.8, 0.1, 0.1)
#: Rows up to which the subset-sum bitset covers all totals; it needs about 10 bytes a row on the driver.
BITS = 1 << 22
#: Components of one size that a task numbers.
NUMBERED = 100_000
WHITE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def module_group(column: str):
    """The column without white space at both ends, in lower case."""
    return F.lower(F.regexp_replace(F.col(column), WHITE, ""))


def related(scratch: Scratch, rows: DataFrame, key: str, entities: list[str]) -> DataFrame:
    """(id, component): rows linked by an equal non-null value of any entity column have the same component.

    Rows with a null key are left out; a row whose entities are all null is a component of its own.  Each entity value
    is a vertex, so a value held by a third of the rows is as many edges as it has rows and never a set of pairs.
    """
    ids = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *[F.col(e).cast("string").alias(f"e{i}") for i, e in enumerate(entities)])
    ids = scratch.table(ids, "ids")
    edges = None
    for i in range(len(entities)):
        part = ids.where(F.col(f"e{i}").isNotNull()).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 20, "0")).alias("a"), F.concat(F.lit(f"{i}:"), f"e{i}").alias("b"))
        edges = part if edges is None else edges.unionByName(part)
    roots = connected_components(scratch, edges).where(F.col("v").startswith("r"))
    name = F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 20, "0"))
    return ids.select("id", name.alias("v")).distinct().join(roots, "v", "left").select("id", F.coalesce("root", "v").alias("component"))


def _bitset(multiplicity: dict[int, int], target: int) -> dict[int, int]:
    """size -> how many components to take so that the total comes closest to *target* (the smaller at a tie).

    Multiplicities are cut into powers of two, each an item of a bitset of reachable totals.  For each total the item
    that first reached it is kept (4 bytes), so a choice is read back without a copy of the bitset for each item.
    """
    cap = 2 * target + 1  # what lies further above the target than 0 below it is no better
    mask, reach = (1 << cap) - 1, 1
    by = np.full(cap, -1, np.int32)
    items = []
    for size, n in sorted(multiplicity.items(), reverse=True):
        k = 1
        while n > 0:
            items.append((size, min(k, n)))
            n -= items[-1][1]
            k *= 2
    for i, (size, take) in enumerate(items):
        new = (reach << (size * take)) & mask & ~reach
        if new:
            by[np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(-(-cap // 8), "little"), np.uint8), bitorder="little")[:cap])] = i
            reach |= new
            if reach >> target & 1:
                break
    low = (reach & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = reach >> (target + 1)
    high = target + (above & -above).bit_length() if above else None
    at = low if high is None or target - low <= high - target else high
    chosen: dict[int, int] = {}
    while at:
        size, take = items[by[at]]
        chosen[size] = chosen.get(size, 0) + take
        at -= size * take
    return chosen


def _subset(multiplicity: dict[int, int], target: int, bits: int = BITS) -> dict[int, int]:
    """size -> how many components to take so that the total comes closest to *target*, counted in single rows.

    The largest components that fit are taken first; with many small ones that hits the target.  If it leaves a rest,
    a bitset over all totals decides for targets up to *bits* rows.  Beyond, as many components are given back as
    *bits* rows hold, and the bitset chooses among these and those not taken.  A total that hits the target is
    closest; where none does, the best within reach of the exchange is taken.
    """
    target = max(0, min(target, sum(s * n for s, n in multiplicity.items())))
    taken, rest = {}, target
    for size, n in sorted(multiplicity.items(), reverse=True):
        k = min(n, rest // size)
        taken[size], rest = k, rest - k * size
    if rest and target <= bits:
        return _bitset(multiplicity, target)
    if rest:
        back, room = {}, bits - rest
        for size in sorted(taken):  # small ones first: more of them fit, so more totals are in reach
            k = min(taken[size], max(0, room // 2) // size)
            back[size], room = k, room - k * size
        free = {s: min(n - taken[s] + back[s], 2 * bits // s) for s, n in multiplicity.items()}
        again = _bitset({s: n for s, n in free.items() if n}, rest + sum(s * k for s, k in back.items()))
        taken = {s: taken[s] - back[s] + again.get(s, 0) for s in taken}
    return {s: k for s, k in taken.items() if k}


def choose(multiplicity: dict[int, int], shares: tuple[float, ...] = SHARES) -> list[dict[int, int]]:
    """For each split, size -> number of components; smaller splits are filled first, the largest gets the rest."""
    total = sum(s * n for s, n in multiplicity.items())
    left, out = dict(multiplicity), [{} for _ in shares]
    order = sorted(range(len(shares)), key=lambda i: (shares[i], -i))
    for i in order[:-1]:
        out[i] = _subset(left, round(total * shares[i]))
        left = {s: n - out[i].get(s, 0) for s, n in left.items() if n > out[i].get(s, 0)}
    out[order[-1]] = left
    return out


def assign_splits(scratch: Scratch, rows: DataFrame, key: str, entities: list[str], names: tuple[str, ...] = NAMES, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(id, component, split): related records get the same split, shares of rows as near to *shares* as sizes allow.

    Deterministic: among components of equal size, those whose hash is smallest go to the first split that wants some.
    """
    parts = scratch.table(related(scratch, rows, key, entities), "components")
    sizes = scratch.table(parts.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    counts = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    wanted = choose(counts, shares)
    # Components of one size are numbered without gathering them: by hash bucket, then within the bucket.
    buckets = max(1024, max(counts.values(), default=0) // NUMBERED)
    hashed = sizes.withColumn("h", F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("int"))
    per = hashed.groupBy("size", "h").agg(F.count("*").alias("n"))
    offset = per.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = hashed.join(offset.select("size", "h", F.coalesce("before", F.lit(0)).alias("before")), ["size", "h"])
    ranked = ranked.withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("size", "h").orderBy("component")))
    bounds = []
    for size in counts:
        at = 0
        for i, name in enumerate(names):
            n = wanted[i].get(size, 0)
            if n:
                bounds.append((size, at, at + n, name))
                at += n
    limits = scratch.spark.createDataFrame(bounds or [(0, 0, 0, "")], "size long, low long, high long, split string")
    # One row per size and split: at most 3 x sqrt(2 x rows), and its size is checked like any other broadcast.
    placed = ranked.join(guarded_broadcast(limits, len(bounds)), "size").where("at > low and at <= high").select("component", "split")
    return parts.join(placed, "component").select("id", "component", "split")


def torn_modules(scratch: Scratch, rows: DataFrame, key: str, module: str, splits: DataFrame) -> DataFrame:
    """(module_group, id): rows with a split whose component has rows in more than one split.

    *splits* is (id, split_name).  Rows without a module belong to no module and are left out.
    """
    named = rows.where(F.col(key).isNotNull() & F.col(module).isNotNull()).select(F.col(key).cast("long").alias("id"), module_group(module).alias("module_group"))
    placed = related(scratch, named, "id", ["module_group"]).join(splits, "id")
    placed = scratch.table(placed, "placed")
    torn = placed.groupBy("component").agg(F.min("split_name").alias("x"), F.max("split_name").alias("y")).where("x <> y").select("component")
    return placed.join(torn, "component", "left_semi").select("id").distinct().join(named.distinct(), "id").select("module_group", "id")
