"""Copies hidden by formatting: recursive radix partitioning of canonical bytes, then counting tries.

1. Each text becomes its canonical bytes (:mod:`canonical`), written once.
2. Buckets are prefixes of these bytes.  The whole table is one bucket; a bucket whose bytes exceed ``capacity`` is
   split by twice as many leading bytes, again and again until each fits.  The sizes at all depths come from one
   aggregation with map-side partial sums, so a hot prefix never meets in one task.  What cannot be split further is
   one single text.
3. Each input task first counts its own rows in tries and passes on one entry per distinct text, so that a group of
   copies that holds a third of all rows arrives as one entry per task.  The buckets are then shuffled, and per bucket
   a trie with terminal counters gives the number of copies and the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, arrow_map, guarded_broadcast, pairs_within
from .canonical import canonical_words

#: Canonical bytes that one bucket may hold.
CAPACITY = 8 << 20
#: Leading bytes of the first split; each further split doubles them.
FIRST = 32
#: Bytes of distinct texts that a task's own tries hold before they are passed on.
FLUSH = 32 << 20
#: Too large prefixes up to which they are literals of the plan.
LITERALS = 1000
#: Bytes of one trie edge.
EDGE = 48


class CountingTrie:
    """A trie over byte strings with EDGE bytes an edge; a terminal holds the count and the smallest id."""

    __slots__ = ("root", "bytes")

    def __init__(self):
        self.root: dict = {}
        self.bytes = 0

    def add(self, text: bytes, n: int, least: int) -> None:
        node = self.root
        for at in range(0, len(text), EDGE):
            step = text[at : at + EDGE]
            below = node.get(step)
            if below is None:
                below = node[step] = {}
                self.bytes += len(step) + 300
            node = below
        end = node.get(None)
        if end is None:
            node[None] = [n, least]
        else:
            end[0] += n
            if least < end[1]:
                end[1] = least

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            text, node = stack.pop()
            for step, below in node.items():
                if step is None:
                    yield text, below[0], below[1]
                else:
                    stack.append((text + step, below))


def _canon(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, codes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    keep, texts, digests = [], [], []
    for i, code in zip(ids, codes):
        if i is not None and code and not code.isspace():
            text = " ".join(canonical_words(code)).encode()
            keep.append(i)
            texts.append(text)
            digests.append(xxhash.xxh3_128_digest(text))
    return pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], ["id", "digest", "canon"])


def _entries(tries: dict) -> pa.RecordBatch:
    rows = [(bucket, *item) for bucket, trie in tries.items() for item in trie.items()]
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["bucket", "canon", "n", "least"])


def _count(flush: int, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[int, CountingTrie] = {}
        held = 0
        for batch in batches:
            for bucket, text, n, least in zip(*(batch.column(i).to_pylist() for i in range(4))):
                trie = tries.get(bucket)
                if trie is None:
                    if final and held > flush:  # buckets arrive in order: those before are complete
                        yield _entries(tries)
                        tries, held = {}, 0
                    trie = tries[bucket] = CountingTrie()
                before = trie.bytes
                trie.add(text, n, least)
                held += trie.bytes - before
                if not final and held > flush:
                    yield _entries(tries)
                    tries, held = {}, 0
                    trie = None
        if tries:
            yield _entries(tries)

    return run


def radix_buckets(canon: DataFrame, capacity: int = CAPACITY, longest: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """*canon* (column canon) with the column bucket: the hash of the shortest prefix whose bucket fits.

    Prefixes that do not fit number at most depths x total bytes / capacity; up to LITERALS of them are written into
    the plan, more are joined, broadcast behind a count of their rows.
    """
    if longest is None:
        longest = canon.agg(F.max(F.length("canon"))).first()[0] or 0
    depths = [0]
    while depths[-1] < longest:
        depths.append(depths[-1] * 2 or FIRST)
    prefixes = F.array(*(F.xxhash64(F.lit(d), F.substring("canon", 1, d)) for d in depths))
    sizes = canon.select(F.posexplode(prefixes).alias("level", "prefix"), F.length("canon").alias("len")).groupBy("level", "prefix").agg(F.sum("len").alias("bytes"))
    # A prefix is too large only if all shorter ones are, so a row's depth is the first at which its prefix is not.
    large = sizes.where(F.col("bytes") > capacity).select("level", "prefix")
    few = large.limit(LITERALS + 1).collect()  # small tables: the prefixes go into the plan as literals
    prefix = [F.xxhash64(F.lit(d), F.substring("canon", 1, d)) for d in depths]
    if len(few) <= LITERALS:
        at = {level: [r["prefix"] for r in few if r["level"] == level] for level in range(len(depths))}
        too_large = [p.isin(at[level]) if at[level] else F.lit(False) for level, p in enumerate(prefix)]
        marked = canon
    else:
        large = (scratch or Scratch(canon.sparkSession, "radix")).table(large, "large")
        marked, too_large = canon, []
        for level, p in enumerate(prefix):
            own = large.where(F.col("level") == level).select(F.col("prefix").alias(f"_p{level}"), F.lit(True).alias(f"_l{level}"))
            marked = marked.withColumn(f"_p{level}", p).join(guarded_broadcast(own), f"_p{level}", "left")
            too_large.append(F.coalesce(F.col(f"_l{level}"), F.lit(False)))
    bucket = F.xxhash64(F.lit(-1), F.col("canon"))  # a text that fills a bucket alone
    for p, full in zip(reversed(prefix), reversed(too_large)):
        bucket = F.when(full, bucket).otherwise(p)
    return marked.select(*canon.columns, bucket.alias("bucket"))


def copy_classes(scratch: Scratch, rows: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, class_id, copies) of each row with non-blank text: the smallest id of its copies and their number.

    Texts are copies if their canonical word sequences are equal.  Rows with a null key or a null, empty or blank
    text are left out; a text without words is a copy of any other such text; a repeated row counts as a copy of
    itself.
    """
    plain = rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    canon = scratch.table(arrow_map(plain, _canon, "id long, digest binary, canon binary"), "canon")
    bucketed = radix_buckets(canon, capacity, scratch=scratch).select("bucket", "canon", F.lit(1).cast("long").alias("n"), F.col("id").alias("least"))
    schema = "bucket long, canon binary, n long, least long"
    local = bucketed.mapInArrow(_count(FLUSH, False), schema)
    whole = local.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(FLUSH, True), schema)

    def name(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests = [xxhash.xxh3_128_digest(c) for c in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(1), batch.column(2)], ["digest", "class_id", "copies"])

    classes = arrow_map(whole.where("n > 1").select("canon", "least", "n"), name, "digest binary, class_id long, copies long")
    classes = scratch.table(classes, "classes")
    return canon.select("id", "digest").join(classes, "digest", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def copy_pairs(scratch: Scratch, rows: DataFrame, key: str, text: str, a: str, b: str) -> DataFrame:
    """(a, b): each pair of different keys whose texts are copies, smaller key first."""
    classes = scratch.table(copy_classes(scratch, rows, key, text).where("copies > 1").select("class_id", "id").distinct(), "members")
    return pairs_within(classes, ["class_id"], "id", a, b).select(a, b)
