"""Overlap across splits by a suffix array over the words of all texts.

Every text is a sequence of word codes, and a suffix is a place in a text, known by the words that follow.  Suffixes
are sorted over partitions (:mod:`suffixes`); neighbours with a long common prefix reveal a span that both texts hold.

To find candidates, the array is sampled by minimizers: of any ``WINDOW`` places in a row the one is kept whose next
four words have the smallest hash, so the choice depends on the words alone and texts that share ``SPAN + WINDOW - 1``
words in a row share one of their suffixes, whatever stands before and behind.  Texts of at most ``SHORT_RUNS`` runs
of four words are sorted a second time, with all their places, and are neighbours by four words already.  Runs of
neighbours are the keys of :mod:`linking`, which links the texts of a run without pairing all of a hot one and checks
each link exactly; groups come from the links of all texts, since texts of two splits may be linked by a third.

For coverage, nothing is sampled: all places of evaluation and training texts are sorted, the spans that cross the
splits are merged and give the covered words of each record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, arrow_map, guarded_broadcast, pairs_across, slices
from .linking import Jaccard, groups, link
from .neardup import THRESHOLD, coded_texts
from .shingles import RUN, Batch, WordHashes, bit_marks, run_sets
from .suffixes import sorted_runs

#: Words that neighbours share at least, places of which one is kept, words by which suffixes are sorted.
SPAN, WINDOW, DEPTH = 8, 5, 12
#: Runs of four words of the longest text that can reach the threshold with one of fewer than SPAN + WINDOW - 1 words.
SHORT_RUNS = 15
EVALUATION, TRAINING = ("dev", "test"), "train"


def minimizers(runs: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places (in the flat array of all texts' *runs*) of which SPAN words follow and that are the smallest of WINDOW
    such places in a row; all of them where there are fewer than WINDOW."""
    text = np.repeat(np.arange(len(begins)), counts)
    place = np.arange(len(runs)) - begins[text]
    room = counts[text] - (SPAN - RUN)  # places of the text with enough words behind them
    chosen = np.zeros(len(runs), bool)
    if len(runs) >= WINDOW:
        windows = np.lib.stride_tricks.sliding_window_view(runs, WINDOW)
        inside = place[: len(windows)] + WINDOW <= room[: len(windows)]
        chosen[np.flatnonzero(inside) + windows[inside].argmin(1)] = True
    chosen |= (room < WINDOW) & (place < room)
    return np.flatnonzero(chosen)


def _placed(batch: pa.RecordBatch) -> pa.RecordBatch:
    b = Batch.of_codes(batch.column(2))
    runs, begins = b.grams(RUN)
    counts = b.ends - b.starts - (RUN - 1)
    sets = run_sets(b, RUN)
    kept = minimizers(runs, begins, counts)
    places = [p - at for p, at in zip(np.split(kept, np.searchsorted(kept, begins[1:])), begins)]
    # Places of the second sort are told apart by their sign.
    places = [np.concatenate((p, -1 - np.arange(n))) if len(s) <= SHORT_RUNS else p for p, n, s in zip(places, counts, sets)]
    raw = np.maximum(b.words.astype(">u2"), 1).astype(">u2").view(np.uint8)
    brief = [raw[2 * a : 2 * z].tobytes() for a, z in zip(b.starts, b.ends)]
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array([len(s) for s in sets], pa.int32()), pa.array(bit_marks(sets), pa.list_(pa.int64())), pa.array(brief, pa.binary()), pa.array(places, pa.list_(pa.int32()))],
        ["field", "node", "codes", "size", "marks", "brief", "places"])


def _suffix(codes: str, place: Column, width: int, depth: int) -> Column:
    """The next *depth* word codes of *width* bytes from *place* on, filled up behind the text's end."""
    return F.rpad(F.substr(codes, place * width + 1, F.lit(depth * width)), depth * width, F.lit(b"\0"))


def _need(keys: np.ndarray) -> np.ndarray:
    """Bytes that neighbours must share: the sort they are of, and SPAN words, or RUN in the sort of short texts."""
    return np.where(keys[:, 0] == 0, 1 + 2 * RUN, 1 + 2 * SPAN)


def overlap_groups(scratch: Scratch, rows: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id, root) of each text with words; texts with an equal root are linked, directly or by a chain."""
    plain = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("python_code"))
    members, one_each = coded_texts(scratch, plain, ["python_code"])
    schema = "field string, node long, codes binary, size int, marks array<long>, brief binary, places array<int>"
    texts = scratch.table(arrow_map(one_each, _placed, schema, columns=(2,)), "texts")
    scratch.drop(one_each)
    at = texts.select("node", "size", "brief", F.explode("places").alias("at"))
    sort = F.when(F.col("at") < 0, F.lit(b"\0")).otherwise(F.lit(b"\1"))
    place = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))
    suffixes = at.select(F.concat(sort, _suffix("brief", place, 2, DEPTH)).alias("key"), "node", "size")
    links = link(scratch, suffixes, Jaccard(scratch, texts, RUN, threshold), _need)
    scratch.drop(texts)
    return groups(scratch, members, links).select("id", "root")


def splits_of(validation: DataFrame) -> DataFrame:
    """(id, split_name): the rows' splits, from the number in the task; records without a split or number are left out."""
    number = F.regexp_extract("task", r"^\s*[A-Za-z]+[-/](\d+)", 1)
    return validation.where(F.col("split_name").isNotNull() & (number != "")).select(number.cast("long").alias("id"), F.lower(F.trim("split_name")).alias("split_name")).distinct()


def cross_split_pairs(scratch: Scratch, rows: DataFrame, key: str, text: str, splits: DataFrame, a: str, b: str) -> DataFrame:
    """(split_name, a, b): each pair of rows in one group of which one is in an evaluation split and one in training.

    Rows without a split only serve as links.  Should a row have several splits, each of them counts.
    """
    grouped = overlap_groups(scratch, rows, key, text).distinct()
    placed = scratch.table(grouped.join(splits.hint("merge"), "id").where(F.col("split_name").isin(TRAINING, *EVALUATION)), "placed")
    sides = placed.groupBy("root").agg(F.max(F.col("split_name") == TRAINING).alias("t"), F.max(F.col("split_name") != TRAINING).alias("e")).where("t and e").select("root")
    mixed = scratch.table(placed.join(sides.hint("merge"), "root", "left_semi"), "mixed")
    held, asked = mixed.where(F.col("split_name") == TRAINING).select("root", "id"), mixed.where(F.col("split_name") != TRAINING)
    pairs = pairs_across(asked, held, ["root"], "id").where("l <> r")
    return pairs.select("split_name", F.least("l", "r").alias(a), F.greatest("l", "r").alias(b)).distinct()


def _all_places(batches):
    hashes = WordHashes()
    for whole in batches:
        for batch in slices(whole, 1):
            b = Batch.of_texts(batch.column(1).to_pylist(), hashes, SPAN, "")
            if b.index:
                ids = batch.column(0).take(pa.array(b.index, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(b.node, pa.int64()), pa.array(b.ends - b.starts, pa.int32()), pa.array(b.codes(), pa.binary())], ["id", "node", "words", "codes"])


def coverage(scratch: Scratch, rows: DataFrame, key: str, text: str, splits: DataFrame) -> DataFrame:
    """(id, split_name, words, covered, share): how many words of each evaluation text lie in spans of SPAN or more
    words that some training text holds too.  A text of fewer words counts as SPAN words.  Texts without words are
    left out."""
    plain = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("python_code"))
    placed = scratch.table(splits.where(F.col("split_name").isin(TRAINING, *EVALUATION)).select("id", "split_name").distinct(), "placed")
    read = plain.join(guarded_broadcast(placed.select("id").distinct()), "id", "left_semi").mapInArrow(_all_places, "id long, node long, words int, codes binary")
    signed = scratch.table(read.withColumn("row", F.monotonically_increasing_id()), "texts")
    nodes = signed.join(placed, "id").groupBy("node").agg(F.min("row").alias("row"), F.max(F.col("split_name") == TRAINING).alias("trained"), F.max(F.col("split_name") != TRAINING).alias("asked"))
    first = scratch.table(signed.select("row", "codes", "words").join(nodes, "row").select("node", "words", "codes", "trained", "asked"), "firsts")
    places = first.select("node", "codes", "trained", "asked", F.explode(F.sequence(F.lit(0), F.col("words") - SPAN)).alias("at"))
    sides = F.filter(F.array(F.when(F.col("trained"), 0), F.when(F.col("asked"), 1)), lambda s: s.isNotNull())
    suffixes = places.select(_suffix("codes", F.col("at"), 4, SPAN).alias("key"), "node", "at", F.explode(sides).alias("side"))
    spans = sorted_runs(scratch, suffixes, across=True, need=lambda keys: np.full(len(keys), 4 * SPAN), name="spans").select("node", "at")
    before = Window.partitionBy("node").orderBy("at")
    new = F.least(F.lit(SPAN), F.col("at") - F.coalesce(F.lag("at").over(before), F.lit(-SPAN)))
    covered = spans.withColumn("new", new).groupBy("node").agg(F.sum("new").alias("covered"))
    texts = signed.select("id", "node", "words").distinct()
    out = placed.where(F.col("split_name").isin(*EVALUATION)).join(texts, "id").join(covered, "node", "left")
    return out.select("id", "split_name", F.col("words").cast("long").alias("words"), F.coalesce("covered", F.lit(0)).cast("long").alias("covered")).withColumn("share", F.round(F.col("covered") / F.col("words"), 6)).distinct()
