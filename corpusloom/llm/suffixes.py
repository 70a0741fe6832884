"""Suffixes in sorted order: neighbours' common prefixes, and the runs of neighbours that share enough of one.

Entries (key, ...) are range-partitioned by key and node and sorted, so that equal prefixes lie side by side, be the
partitions many or few; as ties go by node, a prefix that a third of all rows have is cut into as many partitions as
it needs.  A task then walks along its entries, takes the common prefix of each with the one before and cuts the order
into runs.  The first and the last run of a task may go on in another one; they are put together from one summary per
task and run, which is at most two rows for each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import Scratch

#: Entries that a task looks at in one step.
STEP = 1 << 17
#: Pairs that a task makes in one step.
PAIRS = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _matrix(column: pa.Array) -> np.ndarray:
    """Fixed-length binary keys, or 64-bit numbers, as rows of bytes."""
    if pa.types.is_integer(column.type):
        return np.ascontiguousarray(column.to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)[:2])
    begin = np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0]
    width = int(sizes[0])
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, begin).reshape(-1, width)


def common_prefix(keys: np.ndarray) -> np.ndarray:
    """Bytes that each key has in common with the one before; 0 for the first."""
    out = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differs = keys[1:] != keys[:-1]
        out[1:] = np.where(differs.any(1), differs.argmax(1), keys.shape[1])
    return out


def _named(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One number for the first *lengths* bytes of each key."""
    width = -(-keys.shape[1] // 8) * 8
    padded = np.zeros((len(keys), width), np.uint8)
    padded[:, : keys.shape[1]] = np.where(np.arange(keys.shape[1]) < lengths[:, None], keys, 0)
    out = lengths.astype(np.uint64)
    for part in padded.view(np.uint64).T:
        out = (out ^ part) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _pairs(rows: pa.Table, distinct: np.ndarray, counts: np.ndarray, ratio: float) -> Iterator[pa.RecordBatch]:
    """All pairs of rows within each of the runs that *distinct*, row numbers in order of run and node, holds by
    *counts*; sizes of a pair differ by no more than *ratio*."""
    ends = np.cumsum(counts)
    sizes = rows["size"].to_numpy()
    for n in np.unique(counts):
        left, right = np.triu_indices(n, 1)
        members = distinct[(ends[counts == n] - n)[:, None] + np.arange(n)]
        step = max(1, PAIRS // len(left))
        for at in range(0, len(members), step):
            a, b = members[at : at + step][:, left].ravel(), members[at : at + step][:, right].ravel()
            near = np.minimum(sizes[a], sizes[b]) >= ratio * np.maximum(sizes[a], sizes[b])
            a, b = pa.array(a[near]), pa.array(b[near])
            if len(a):
                kept = [c for c in rows.column_names if c != "key"]
                columns = [rows[c].take(a).combine_chunks() for c in kept] + [rows[c].take(b).combine_chunks() for c in kept]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *(f"{c}_b" for c in kept)])


def _walk(need: Callable[[np.ndarray], np.ndarray] | None, across: bool, small: int = 0, ratio: float = 0.0, schema: pa.Schema | None = None):
    """The task's side: rows of runs, with part, n, hub, has (a row of side 0 is in the run) and edge; of runs of
    *small* nodes or fewer, whole in this task, their pairs instead."""

    def tell(rows: pa.Table, keys: np.ndarray, starts: np.ndarray, first: bool, last: bool, part: int) -> Iterator[pa.RecordBatch]:
        nodes = rows["node"].to_numpy()
        run = np.zeros(len(nodes), np.int64)
        run[starts[1:]] = 1
        run = np.cumsum(run)
        order = np.lexsort((nodes, run))
        new = np.ones(len(order), bool)
        new[1:] = (nodes[order[1:]] != nodes[order[:-1]]) | (run[order[1:]] != run[order[:-1]])
        n = np.bincount(run[order[new]])
        hub = nodes[order[starts]]  # runs are contiguous, so in either order each begins at the same place
        edge = np.zeros(len(starts), bool)
        edge[0] |= first
        edge[-1] |= last
        has = np.ones(len(starts), bool)
        if across:
            own = rows["side"].to_numpy() == 0
            has = np.maximum.reduceat(own, starts)
            kept = np.flatnonzero((~own & has[run]) | edge[run])
        else:
            paired = (n > 1) & (n <= small) & ~edge
            if paired.any():
                yield from _pairs(rows, order[new & paired[run[order]]], n[paired], ratio)
            kept = np.sort(order[new & (((n > 1) & ~paired) | edge)[run[order]]])
        if not len(kept):
            return
        at, chosen = run[kept], keys[kept]
        names = chosen.view(np.int64).ravel() if need is None else _named(chosen, need(chosen))
        out = {"key": pa.array(names), **{c: rows[c].take(pa.array(kept)).combine_chunks() for c in rows.column_names if c != "key"}}
        sizes = rows["size"].to_numpy()[order[starts]] if "size" in rows.column_names else np.zeros(len(starts), np.int32)
        out |= {"part": pa.array(np.full(len(kept), part, np.int32)), "n": pa.array(n[at]), "hub": pa.array(hub[at]), "hub_size": pa.array(sizes[at]), "has": pa.array(has[at]), "edge": pa.array(edge[at])}
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        """With nulls for the columns that only rows or only pairs have."""
        if schema is None:
            return batch
        have = dict(zip(batch.schema.names, batch.columns))
        return pa.RecordBatch.from_arrays([have[f.name].cast(f.type) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, waiting, first = TaskContext.get().partitionId(), [], 0, True

        def step(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, first
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = np.ascontiguousarray(_matrix(rows["key"].chunk(0)))
            wanted = np.full(len(keys), keys.shape[1]) if need is None else need(keys)
            starts = np.flatnonzero(common_prefix(keys) < wanted)
            if not len(starts) or starts[0]:
                starts = np.concatenate(([0], starts))
            upto = len(keys) if end else int(starts[-1])
            if upto:
                yield from map(whole, tell(rows.slice(0, upto), keys[:upto], starts if end else starts[:-1], first, end, part))
                first = False
            held, waiting = rows.slice(upto).to_batches(), 0

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += batch.num_rows
                if waiting >= STEP:
                    yield from step(False)
        if held:
            yield from step(True)

    return walk


def sorted_runs(scratch: Scratch, entries: DataFrame, need: Callable[[np.ndarray], np.ndarray] | None = None, across: bool = False, small: int = 0, ratio: float = 0.0, name: str = "runs"):
    """Entries that stand in a run with another node, under the run's number as key, with its number of nodes n and its
    smallest node hub, and that node's size where entries have one.

    *entries* is (key, node, ...), key a 64-bit number or a binary of one length for all; neighbours are in one run if
    they have *need* bytes of prefix in common (all bytes where need is None).  Each node comes out once for a run.
    With *across*, entries have a column side, and each entry of side 1 comes out that is in a run with one of side 0.

    With *small*, the result is (pairs, entries): where a task has all of a run of so many nodes or fewer, it gives the
    run's pairs (each column, and <column>_b of the larger node) at once and no entries; sizes of a pair differ by
    *ratio* at most.
    """
    rest = [f for f in entries.schema.fields if f.name != "key"]
    fields = ["key long", *(f"{f.name} {f.dataType.simpleString()}" for f in rest), "part int", "n long", "hub long", "hub_size int", "has boolean", "edge boolean"]
    if small:
        fields += [f"{f.name}_b {f.dataType.simpleString()}" for f in rest]
    schema = to_arrow_schema(T.StructType.fromDDL(", ".join(fields))) if small else None
    order, rest = ["key", "node"], [f.name for f in rest]
    walked = entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk(need, across, small, ratio, schema), ", ".join(fields))
    walked = scratch.table(walked, name)
    edges = walked.where("edge")
    # At most two runs of each task are cut, so this side has at most two rows for each partition of the sort.
    merged = edges.select("part", "key", "n", "hub", "hub_size", "has").distinct().groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("hub", "hub_size")).alias("h"), F.max("has").alias("has"))
    merged = F.broadcast(merged.where("has" if across else "n > 1").select("key", "n", "h.hub", "h.hub_size"))
    cut = edges.where("side = 1") if across else edges
    cut = cut.select("key", *rest)
    cut = (cut if across else cut.dropDuplicates(["key", "node"])).join(merged, "key")
    live = walked.where("not edge").select("key", *rest, "n", "hub", "hub_size").unionByName(cut)
    live._scratch_path = walked._scratch_path
    return (walked.where("node_b is not null").select(*rest, *(f"{c}_b" for c in rest)), live) if small else live
