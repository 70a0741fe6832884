"""Evaluation texts in training text, by a distributed positional inverted index.

Terms are runs of four words.  The index holds postings (term, document, position) of the corpus for the terms that
evaluation items have.  An item's passages of ``RUN`` words are sought from their rarest term on: its postings give
candidates (document, item, offset), and the other terms' lists, adjusted by that offset, are intersected with them;
RUN - 3 consecutive terms at one offset are an exact shared run of RUN words.

The items' terms are sent to the workers, which then post only positions that can be part of a shared run: as they are
where they fit ``VOCABULARY``, beyond that as a filter of ``FILTER`` bits, which lets some other terms pass; the join
on the term does the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, guarded_broadcast, slices
from .shingles import Batch, WordHashes

TERM, RUN = 4, 12
#: Terms of all items up to which they are broadcast (8 bytes each).
VOCABULARY = 1_000_000
#: Bits of the filter that stands for more terms than that (8 MB, whatever their number).
FILTER = 1 << 26


class _Exact:
    """A sorted array of terms."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms

    def has(self, x: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(len(x), bool)
        return self.terms[np.minimum(np.searchsorted(self.terms, x), len(self.terms) - 1)] == x


class _Filter:
    """A bit for each value of a term modulo FILTER."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, x: np.ndarray) -> np.ndarray:
        at = x.view(np.uint64) % np.uint64(len(self.words) * 64)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _postings(known, run: int):
    """Postings of each text; of *known* terms only, and only in stretches of at least *run* - 3 of them."""

    def post(batches):
        hashes = WordHashes()
        table = None if known is None else known.value
        for batch in (part for whole in batches for part in slices(whole, 1)):
            b = Batch.of_texts(batch.column(1).to_pylist(), hashes, TERM)
            if not b.index:
                continue
            ids = batch.column(0).take(pa.array(b.index, pa.int64()))
            terms, begins = b.grams(TERM)
            signed = terms.view(np.int64)
            text = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(terms))))
            if table is None:
                keep = np.arange(len(terms))
            else:
                hit = table.has(signed)
                # Ends of stretches: where a hit does not follow a hit of the same text.
                prev = np.concatenate(([False], hit[:-1] & (text[1:] == text[:-1])))
                first = np.flatnonzero(hit & ~prev)
                stretch = np.cumsum(hit & ~prev) - 1
                lengths = np.bincount(stretch[hit], minlength=len(first))
                keep = np.flatnonzero(hit & (lengths[np.maximum(stretch, 0)] >= run - TERM + 1)) if len(first) else np.zeros(0, int)
            if len(keep):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text[keep])), pa.array(signed[keep]), pa.array((keep - begins[text[keep]]).astype(np.int32)), pa.array((np.append(begins, len(terms))[text[keep] + 1] - begins[text[keep]]).astype(np.int32))], ["id", "term", "pos", "terms"])

    return post


_SCHEMA = "id long, term long, pos int, terms int"


def _index(df: DataFrame, key: str, text: str, known=None, run: int = TERM) -> DataFrame:
    plain = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return plain.mapInArrow(_postings(known, run), _SCHEMA).dropDuplicates(["id", "term", "pos"])  # a repeated row posts once


def _known(scratch: Scratch, items: DataFrame):
    """The items' terms for the workers; on the driver, at most VOCABULARY numbers or FILTER bits."""
    terms = items.select("term").distinct()
    if terms.count() <= VOCABULARY:
        found = _Exact(np.sort(np.array([r[0] for r in terms.collect()], np.int64)))
    else:
        # The unsigned remainder by a power of two is the lower bits.
        at = F.col("term").bitwiseAND(F.lit(FILTER - 1))
        bits = terms.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int((term & {FILTER - 1}) & 63))")).alias("bits"))
        words = np.zeros(FILTER // 64, np.uint64)
        for r in bits.toLocalIterator():
            words[r["word"]] = r["bits"] & (1 << 64) - 1
        found = _Filter(words)
    return scratch.spark.sparkContext.broadcast(found)


def build(scratch: Scratch, docs: DataFrame, doc_key: str, items: DataFrame, item_key: str, text: str, run: int) -> tuple[DataFrame, DataFrame]:
    """(postings of the corpus, postings of the items), both written."""
    asked = scratch.table(_index(items, item_key, text).select(F.col("id").alias("item"), "term", F.col("pos").alias("ipos"), "terms"), "items")
    return scratch.table(_index(docs, doc_key, text, _known(scratch, asked), run).select("id", "term", "pos"), "postings"), asked


def passages(scratch: Scratch, docs: DataFrame, doc_key: str, items: DataFrame, item_key: str, text: str, run: int = RUN) -> DataFrame:
    """(id, item, offset, first, length): maximal runs of *run* or more consecutive words that a document and an item
    share; first is the word's number in the document, offset the document's position less the item's.

    Null keys are left out on both sides; null and empty texts and those of fewer than *run* words hold no passage.
    Repeated rows count once; keys are taken to be unique otherwise.
    """
    postings, asked = build(scratch, docs, doc_key, items, item_key, text, run)
    k = run - TERM + 1
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    rated = scratch.table(asked.join(df, "term").select("item", "ipos", "term", "df"), "rated")
    # Each window of k consecutive terms is sought by its rarest; windows with a term that no document has are out.
    windows = rated.select("item", F.explode(F.sequence(F.col("ipos") - (k - 1), F.col("ipos"))).alias("at"), "ipos", "term", "df").groupBy("item", "at").agg(F.count("*").alias("n"), F.min(F.struct("df", "ipos", "term")).alias("best"))
    anchors = scratch.table(windows.where(F.col("n") == k).select("item", "best.ipos", "best.term").distinct(), "anchors")
    sought = postings.join(guarded_broadcast(anchors), "term").select("id", "item", (F.col("pos") - F.col("ipos")).alias("offset")).distinct()
    candidates = scratch.table(sought, "candidates")
    there = candidates.join(postings, "id").withColumn("ipos", F.col("pos") - F.col("offset"))
    hits = there.join(guarded_broadcast(asked.select("item", "ipos", "term")), ["item", "ipos", "term"]).select("id", "item", "offset", "pos")
    w = Window.partitionBy("id", "item", "offset").orderBy("pos")
    islands = hits.withColumn("island", F.col("pos") - F.row_number().over(w)).groupBy("id", "item", "offset", "island").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    return islands.where(F.col("n") >= k).select("id", "item", "offset", "first", (F.col("n") + TERM - 1).cast("int").alias("length"))


def proximity(scratch: Scratch, docs: DataFrame, doc_key: str, items: DataFrame, item_key: str, text: str, share: float = 0.5, spread: int = 2) -> DataFrame:
    """(id, item, terms, share): documents in which at least *share* of an item's distinct terms stand, in any order,
    within a stretch of *spread* times the item's length.  The best stretch counts.

    Every stretch counts, wherever it starts: an occurrence of a term adds it to the stretches that hold the occurrence
    but not the one before, so a running sum over these bounds is the number of distinct terms.  Terms are taken from
    the rarest half of each item first: a document without any of those cannot reach a share of one half or more.
    """
    postings, asked = build(scratch, docs, doc_key, items, item_key, text, TERM)
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    distinct = asked.groupBy("item", "term").agg(F.max("terms").alias("size"))
    order = Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "term")
    rated = distinct.join(df, "term", "left").withColumn("nth", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("item")))
    rated = scratch.table(rated, "rated")
    rare = rated.where(F.col("nth") <= F.ceil((1 - F.lit(share)) * F.col("total")) + 1)
    pairs = scratch.table(postings.join(guarded_broadcast(rare.select("term", "item")), "term").select("id", "item").distinct(), "pairs")
    there = postings.join(guarded_broadcast(rated.select("term", "item", "size", "total")), "term").join(pairs, ["id", "item"], "left_semi")
    # Of starts after the term's last occurrence, those from which a stretch reaches pos; one less from pos + 1 on.
    last = F.lag("pos").over(Window.partitionBy("id", "item", "term").orderBy("pos"))
    start = F.greatest(F.col("pos") - F.col("size") * spread, F.coalesce(last, F.col("pos") - F.col("size") * spread)) + 1
    bounds = there.withColumn("start", start).select("id", "item", "total", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("more")), F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("more")))).alias("e"))
    steps = bounds.groupBy("id", "item", "total", "e.at").agg(F.sum("e.more").alias("more"))
    found = steps.withColumn("terms", F.sum("more").over(Window.partitionBy("id", "item").orderBy("at")))
    best = found.groupBy("id", "item").agg(F.max("terms").alias("terms"), F.max("total").alias("total"))
    return best.where(F.col("terms") >= F.lit(share) * F.col("total")).select("id", "item", "terms", F.round(F.col("terms") / F.col("total"), 6).alias("share"))
