"""From blocking keys to verified groups of texts, without pairing everything in a hot key.

Input is a table of entries (key, node, size): texts whose similarity may reach the threshold share keys, or long
prefixes of them; size is the number of the text's distinct runs of words.  Any one shared key makes a pair a
candidate.  Entries are sorted (:mod:`suffixes`); where SMALL texts or fewer are neighbours, their pairs are made in the
task that sees them, without another shuffle.  A key of more texts is linked
as a star around its smallest text; the texts that the star doesn't link are then compared with every text of the key,
block by block.  So a key of n texts that are all alike costs n - 1 comparisons, and no pair of a key is left out
unless both are already linked to its centre.

A hot key (more than HOT texts) is boilerplate: its texts are mostly unlike, and a star would refuse them all.  Its
texts are all kept, under other keys that miss none of their similar pairs: in an order of runs that is the same for
all texts (rare ones first), similar texts share one of their first runs, as many as the threshold asks for (prefix
filter).  Texts that share few of these, or differ too much in size, cannot reach the threshold and are not compared.

Whatever is compared comes from one written table of texts, coded once: no text is read or cut into words again.
Joins of sides that grow with the input are hinted to merge, so that small and large inputs run one plan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, Scratch, arrow_map, guarded_broadcast, pairs_across
from .components import connected_components
from .shingles import MARKS, Batch, run_sets
from .suffixes import sorted_runs

SMALL, HOT = 8, 64
#: The order of runs is estimated from one text of ORDER_SHARE, but ORDER_TEXTS at least, so that runs of a few texts are
#: told from those of one at every size; at most ORDER_RUNS (12 bytes each) are known as frequent.  Any order gives all
#: pairs, but one that does not know the frequent runs gives candidates with the square of the texts.
ORDER_SHARE, ORDER_TEXTS, ORDER_RUNS = 4, 4_000, 2_000_000


def _cut_pairs(entries: DataFrame) -> DataFrame:
    """The pairs of the runs that lie in several tasks, of which there are two for a task at most."""
    names = [c for c in entries.columns if c not in ("key", "n", "hub", "hub_size")]
    right = entries.select("key", *[F.col(c).alias(f"{c}_b") for c in names])
    return entries.select("key", *names).join(right.hint("merge"), "key").where("node < node_b").drop("key")


def _hot_pairs(scratch: Scratch, nodes: DataFrame, verify, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates (a, b) among the nodes of hot keys, the entries of first runs that are hot again, for stars, and the
    table that both read."""
    first = scratch.table(verify.first_runs(nodes), "first")
    met, held = sorted_runs(scratch, first, small=hot, ratio=verify.threshold, name="held")
    scratch.drop(first)
    large = held.where(F.col("n") > hot).select("key", "node", "size", "hub", "hub_size")
    many = scratch.table(large.groupBy("node").agg(F.count("*").cast("int").alias("many")), "many")
    met = met.unionByName(_cut_pairs(held.where(F.col("n") <= hot)).where(verify.may("size", "size_b")))
    # The shorter text's early runs suffice; of two equally long texts both have it early.
    hit = ((F.col("size") > F.col("size_b")) | F.col("early")) & ((F.col("size_b") > F.col("size")) | F.col("early_b"))
    shared = met.groupBy(F.col("node").alias("a"), F.col("node_b").alias("b"), F.col("size").alias("sa"), F.col("size_b").alias("sb")).agg(F.count("*").alias("c"), F.max(hit).alias("hit")).where("hit")
    for s in "ab":
        shared = shared.join(guarded_broadcast(many.select(F.col("node").alias(s), F.col("many").alias(f"m{s}"))), s, "left")
    most = F.col("c") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0)))
    return shared.where(verify.reaches("sa", "sb", most)).select("a", "b"), large, held


def link(scratch: Scratch, entries: DataFrame, verify, need=None, small: int = SMALL, hot: int = HOT) -> DataFrame:
    """(a, b) verified links between nodes; *entries* is (key, node, size) for :func:`suffixes.sorted_runs`, where texts
    are neighbours by *need* bytes, and is dropped once sorted if it is a written one; *verify*, a :class:`Jaccard`, maps
    a table of distinct pairs to (a, b, ok)."""
    pairs, live = sorted_runs(scratch, entries, need, small=small, ratio=verify.threshold, name="runs")
    scratch.drop(entries)
    cool = live.where(F.col("n") <= hot)
    pairs = pairs.select("node", "node_b").unionByName(_cut_pairs(cool.where(F.col("n") <= small)).where(verify.may("size", "size_b")).select("node", "node_b")).toDF("a", "b")
    large = cool.where(F.col("n") > small).select("key", "node", "size", "hub", "hub_size")
    heavy = scratch.table(live.where(F.col("n") > hot).select("node").distinct(), "heavy")
    done = [live]
    if heavy.limit(1).count():
        more, again, held = _hot_pairs(scratch, heavy, verify, hot)
        done.append(held)
        pairs, large = pairs.unionByName(more), large.unionByName(again)
    large = scratch.table(large, "large")
    stars = large.where("node <> hub").where(verify.may("hub_size", "size"))
    pairs = pairs.unionByName(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    pairs = scratch.table(pairs.distinct(), "pairs")
    scratch.drop(*done)
    checked = verify(pairs)
    ok = checked.where("ok").select("a", "b")
    refused = scratch.table(large.where("node <> hub").join(ok.select(F.col("a").alias("hub"), F.col("b").alias("node")).hint("merge"), ["hub", "node"], "left_anti").select("key", "node", "size"), "refused")
    if refused.limit(1).count():
        other = large.where("node <> hub").select("key", F.struct("node", "size").alias("x"))
        rest = pairs_across(refused.select("key", F.struct("node", "size").alias("x")), other, ["key"], "x")
        rest = rest.where("l.node <> r.node").where(verify.may("l.size", "r.size"))
        rest = rest.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
        rest = scratch.table(rest.join(checked.hint("merge"), ["a", "b"], "left_anti"), "rest")
        ok = ok.unionByName(verify(rest).where("ok").select("a", "b"))
    return ok


class Jaccard:
    """Exact check of pairs: the share of distinct n-word runs that both texts hold among those that either holds.

    *texts* is a written table (field, node, size, marks, codes), one row per node, with marks of
    :func:`shingles.bit_marks` and codes of :meth:`shingles.Batch.codes`.  Words are compared by 32-bit codes, so two
    texts pass for more alike than they are only if words that stand in the same run differ and have equal codes.
    """

    def __init__(self, scratch: Scratch, texts: DataFrame, n: int, threshold: float):
        self.scratch, self.texts, self.n, self.threshold = scratch, texts, n, threshold

    def may(self, a: str, b: str) -> Column:
        """Whether texts of *a* and *b* runs can reach the threshold."""
        return F.least(F.col(a), F.col(b)) / F.greatest(F.col(a), F.col(b)) >= F.lit(self.threshold)

    def reaches(self, a: str, b: str, shared: Column) -> Column:
        """Whether texts of *a* and *b* runs can reach the threshold if they share at most *shared* of their first runs.

        Runs up to the smaller one of both last first runs are first runs of both; behind it, one of the texts has
        only the rest of its runs left."""
        left = F.ceil(F.greatest(a, b) * F.lit(self.threshold) - 1e-9) - 1
        most = F.least(F.col(a), F.col(b), shared + left)
        return most / (F.col(a) + F.col(b) - most) >= F.lit(self.threshold)

    def _codes(self, nodes: DataFrame) -> DataFrame:
        """(node, codes, field) of *nodes*, a written table of distinct nodes."""
        return self.texts.select("node", "codes", "field").join(guarded_broadcast(nodes), "node", "left_semi")

    def _runs(self, nodes: DataFrame) -> DataFrame:
        n = self.n

        def runs(batch):
            sets = run_sets(Batch.of_codes(batch.column(1)), n)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "runs"])

        return arrow_map(self._codes(nodes), runs, "node long, runs array<long>")

    def _frequent(self, nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Frequent runs of *nodes*, sorted, and how many of the sampled texts have each; the most frequent where they
        are more than ORDER_RUNS."""
        every = min(ORDER_SHARE, max(1, nodes.count() // ORDER_TEXTS))
        sample = self.scratch.table(nodes.where(F.pmod("node", F.lit(every)) == 0), "sample")
        counted = self._runs(sample).select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").cast("int").alias("c"))
        often = self.scratch.table(counted.where("c > 1"), "often")
        least, held = 2, 0
        for c, n in often.groupBy("c").agg(F.count("*")).orderBy(F.desc("c")).collect():
            held += n
            if held > ORDER_RUNS:
                least = c + 1
                break
        found = often.where(F.col("c") >= least).toArrow()
        self.scratch.drop(often)
        runs, times = found["run"].to_numpy(), found["c"].to_numpy()
        order = np.argsort(runs)
        return runs[order], times[order]

    def first_runs(self, nodes: DataFrame) -> DataFrame:
        """(key, node, size, early): the first runs of each of *nodes* in one order; texts that reach the threshold
        share one, and an early one of the shorter text."""
        known = self.scratch.spark.sparkContext.broadcast(self._frequent(nodes))
        n, threshold, salts = self.n, self.threshold, Salts()

        def first(batch):
            often, times = known.value
            sets = run_sets(Batch.of_codes(batch.column(1)), n)
            keys, early, nodes, fields = [], [], batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for s, field in zip(sets, fields):
                s = s.view(np.int64)
                rank = np.zeros(len(s), np.int32)
                if len(often):
                    near = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rank = np.where(often[near] == s, times[near], 0)
                k = len(s) - math.ceil(threshold * len(s) - 1e-9) + 1
                keys.append(s[np.lexsort((s, rank))[:k]] ^ salts[field])
                early.append(np.arange(k) <= len(s) - math.ceil(2 * threshold / (1 + threshold) * len(s) - 1e-9))
            if not sets:
                return None
            counts = [len(k) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(nodes, counts)), pa.array(np.repeat(np.array([len(s) for s in sets], np.int32), counts)), pa.array(np.concatenate(early))], ["key", "node", "size", "early"])

        return arrow_map(self._codes(nodes), first, "key long, node long, size int, early boolean")

    def _close(self, pairs: DataFrame) -> DataFrame:
        """(a, b, close): a bit that only one text has stands for a run that only this text has, so the bits bound the
        shared runs from above; pairs that are not close cannot reach the threshold."""
        left, right = (self.texts.select(F.col("node").alias(s), F.col("size").alias(f"s{s}"), *[F.col("marks")[i].alias(f"{s}{i}") for i in range(MARKS)]) for s in "ab")

        def only(x: str, y: str) -> Column:
            return sum((F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(f"{y}{i}"))) for i in range(MARKS)), F.lit(0))

        most = F.least(F.col("sa") - only("a", "b"), F.col("sb") - only("b", "a"))
        return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", (most / (F.col("sa") + F.col("sb") - most) >= F.lit(self.threshold)).alias("close"))

    def __call__(self, pairs: DataFrame) -> DataFrame:
        sorted_out = self.scratch.table(self._close(pairs), "sorted")
        close = sorted_out.where("close").select("a", "b")
        needed = self.scratch.table(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
        # Codes are crossed over, not the runs made of them, which are twice as large and do not compress.
        held = self.texts.select("node", "codes")
        if (n := needed.count()) <= BROADCAST_ROWS:
            held = held.join(guarded_broadcast(needed, n), "node", "left_semi")
        left, right = held.toDF("a", "ca"), held.toDF("b", "cb")
        both = close.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ca", "cb")
        checked = arrow_map(both, self._alike(), "a long, b long, ok boolean", columns=(2, 3))
        checked = self.scratch.table(checked.unionByName(sorted_out.where("not close").select("a", "b", F.lit(False).alias("ok"))), "checked")
        self.scratch.drop(pairs, sorted_out, needed)
        return checked

    def _alike(self):
        n, threshold = self.n, self.threshold

        def alike(batch: pa.RecordBatch) -> pa.RecordBatch:
            ends = batch.num_rows
            _, at, own = np.unique(np.concatenate([batch.column(i).to_numpy() for i in (0, 1)]), return_index=True, return_inverse=True)
            codes = pa.chunked_array([batch.column(2), batch.column(3)]).take(pa.array(at)).combine_chunks()
            sets = run_sets(Batch.of_codes(codes), n)
            ok = []
            for a, b in zip(own[:ends], own[ends:]):
                shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                ok.append(shared / (len(sets[a]) + len(sets[b]) - shared) >= threshold)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

        return alike


class Salts(dict):
    """field -> number that keeps its keys apart from those of other fields."""

    def __missing__(self, field: str) -> np.int64:
        salt = self[field] = np.int64(xxhash.xxh3_64_intdigest(field) - (1 << 63))
        return salt


def groups(scratch: Scratch, members: DataFrame, links: DataFrame) -> DataFrame:
    """(field, id, root): every member with the smallest node linked to its own, itself where there is none."""
    roots = connected_components(scratch, links)
    return members.join(roots.withColumnRenamed("v", "node").hint("merge"), "node", "left").select("field", "id", F.coalesce("root", "node").alias("root"))
