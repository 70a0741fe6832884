"""Near-duplicates with small edits: one-wildcard segment variants of MinHash signatures, equality join, exact check.

A text's signature has ``SEGMENTS x WIDTH`` symbols, each the minimum of one hash function over the runs of four
words.  Two texts of similarity s agree in a symbol with probability s.  The signature is cut into segments, few
enough that a pair at the threshold has one in which at most one symbol differs; each segment is indexed under its
variants with one symbol deleted, and equal variants meet in an equality join.  (The symbols are 64-bit minima, not
single bits: at a threshold of 0.6 a pair's bit signatures differ in a fifth of all bits, which no cut can tell from
chance.)  At similarity 0.6 a segment of three differs in at most one symbol with probability 0.648, so the chance
that all 12 fail is 4e-6; it falls further with similarity, and chains of links make most groups safe several times.
Candidates are then checked exactly on whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, arrow_map, pairs_within
from .linking import Jaccard, groups, link
from .shingles import CODED, RUN, Batch, bit_marks, coded, minhash, one_wildcard_keys, run_sets

THRESHOLD = 0.6
SEGMENTS, WIDTH = 12, 3


def coded_texts(scratch: Scratch, plain: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """((field, id, node), (field, node, codes)): the members of each node, and one text for each node.

    *plain* is (id, fields).  Equal word sequences of a field are one node; texts without words are left out.
    """
    signed = scratch.table(plain.mapInArrow(coded(fields), CODED), "coded")
    members = scratch.table(signed.select("field", "id", "node").distinct(), "members")
    # All codes of a node are equal; copies fall together in the map tasks already.
    one_each = signed.groupBy("node").agg(F.first("field").alias("field"), F.first("codes").alias("codes")).select("field", "node", "codes")
    one_each._scratch_path = signed._scratch_path
    return members, one_each


def _mark(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = run_sets(Batch.of_codes(batch.column(2)), RUN)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(s) for s in sets], pa.int32()), pa.array(bit_marks(sets), pa.list_(pa.int64()))], ["field", "node", "codes", "size", "marks"])


def _sign(fields: list[str]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, begins = Batch.of_codes(batch.column(2)).grams(RUN)
        keys = one_wildcard_keys(minhash(grams, begins, SEGMENTS * WIDTH), WIDTH)
        apart = np.array([fields.index(f) * 0x5851F42D4C957F2D & (2**64 - 1) for f in batch.column(0).to_pylist()], np.uint64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array((keys ^ apart[:, None]).view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(3), flat], ["node", "size", "keys"])

    return run


def near_duplicate_groups(scratch: Scratch, rows: DataFrame, key: str, fields: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(field, id, root) of each text with words: texts of one field with equal root form a group.

    Rows with a null key and texts without words are left out.  A text of fewer than four words counts as one run.
    Equal word sequences are one node, so copies cost nothing beyond their row.  Should a key repeat with different
    texts, it belongs to each of their groups.
    """
    plain = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *fields)
    members, one_each = coded_texts(scratch, plain, fields)
    texts = scratch.table(arrow_map(one_each, _mark, "field string, node long, codes binary, size int, marks array<long>", columns=(2,)), "texts")
    scratch.drop(one_each)
    signed = scratch.table(arrow_map(texts.select("field", "node", "codes", "size"), _sign(fields), "node long, size int, keys array<long>", columns=(2,)), "signed")
    variants = signed.select("node", "size", F.explode("keys").alias("key"))
    variants._scratch_path = signed._scratch_path
    links = link(scratch, variants, Jaccard(scratch, texts, RUN, threshold))
    scratch.drop(texts)
    return groups(scratch, members, links)


def near_duplicate_pairs(scratch: Scratch, rows: DataFrame, key: str, fields: list[str], a: str, b: str) -> DataFrame:
    """(field_name, a, b): each pair of different keys in one group of a field."""
    grouped = scratch.table(near_duplicate_groups(scratch, rows, key, fields).distinct(), "groups")
    return pairs_within(grouped, ["field", "root"], "id", a, b).select(F.col("field").alias("field_name"), a, b)
