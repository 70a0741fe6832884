"""Encoding of a whole corpus with a byte-level BPE by a global shuffle of distinct words.

1. Documents are cut into pre-tokens chunk by chunk (a chunk is a bounded number of characters, at least one document).
   Within a chunk a pre-token is a number into the chunk's own list of distinct words, so a position costs a number and
   a word crosses the network once per chunk, not once per occurrence.
2. The lists are exploded to (word, chunk, place) and range-partitioned by word and chunk, sorted.  A task encodes each
   of its distinct words once and gives the ids back to (chunk, place).  A word that nearly every chunk holds is cut by
   chunk into as many tasks as it needs, and encoded once in each.
3. Shuffled by chunk, the ids meet the chunk's positions and each document's list is put together in order.

Decoding joins each id with its bytes in the vocabulary and concatenates by position.
"""

from __future__ import annotations

import base64
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, arrow_map

#: Where the vocabulary files are; a parameter of every function that reads one.
TOKENIZERS = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-token pattern that belongs to this vocabulary (a fixed value of its published definition).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of one chunk.
CHUNK = 2_000_000


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _local(path: str) -> str:
    """The file where this process runs: itself, or its copy that the session has shipped."""
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks(_local(path)), special_tokens={})


@functools.lru_cache(maxsize=1)
def _pattern():
    import regex

    # White space is the Unicode property, as in the vocabulary's own implementation.
    return regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})"))


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _chunked(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, findall, part = TaskContext.get().partitionId(), _pattern().findall, 0
        ids: list = []
        counts: list[int] = []
        at: list[np.ndarray] = []
        words, size = _Numbers(), 0

        def flush() -> pa.RecordBatch:
            places = np.concatenate(at) if at else np.zeros(0, np.uint32)
            kind = np.uint16 if len(words) < 1 << 16 else np.uint32
            blob = zlib.compress(places.astype(kind).view(np.uint8).reshape(-1, kind().itemsize).T.tobytes(), 1)
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | part], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([kind().itemsize], pa.int32()), pa.array([blob], pa.binary()), pa.array([list(words)], pa.list_(pa.string()))],
                ["chunk", "ids", "counts", "width", "at", "words"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = findall(text) if text else []
                ids.append(key)
                counts.append(len(found))
                if found:
                    at.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                size += len(text or "") + 16
                if size >= limit:
                    yield flush()
                    part += 1
                    ids, counts, at, words, size = [], [], [], _Numbers(), 0
        if ids:
            yield flush()

    return run


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        last, ids = None, []
        for batch in batches:
            flat: list[int] = []
            lengths = np.zeros(batch.num_rows + 1, np.int32)
            for i, word in enumerate(batch.column(0).to_pylist()):
                if word != last:  # sorted by word: each is encoded once
                    last, ids = word, encode(word)
                flat += ids
                lengths[i + 1] = len(ids)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), lists], ["chunk", "place", "ids"])

    return run


def _reassemble(docs: pa.Table, words: pa.Table) -> pa.Table:
    """Documents of one chunk with their ids, from the chunk's positions and its words' ids."""
    keys = docs["ids"].combine_chunks().flatten()
    counts = docs["counts"].combine_chunks().flatten().to_numpy()
    width = docs["width"][0].as_py()
    raw = np.frombuffer(zlib.decompress(docs["at"][0].as_py()), np.uint8).reshape(width, -1).T
    at = np.ascontiguousarray(raw).view({2: np.uint16, 4: np.uint32}[width]).ravel()
    if len(at):
        place = words["place"].to_numpy()
        lists = words["ids"].combine_chunks()
        begins, lengths, flat = np.asarray(lists.offsets)[:-1].astype(np.int64), lists.value_lengths().to_numpy().astype(np.int64), lists.values.to_numpy()
        begin_of, length_of = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        begin_of[place], length_of[place] = begins, lengths
        n = length_of[at]
        ends = np.cumsum(n)
        out = flat[np.repeat(begin_of[at] - (ends - n), n) + np.arange(ends[-1])]
        tokens = np.concatenate(([0], ends))
    else:
        out, tokens = np.zeros(0, np.int32), np.zeros(1, np.int64)
    offsets = tokens[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
    return pa.table({"id": keys, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.astype(np.int32)))})


def encode(scratch: Scratch, docs: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", chunk: int = CHUNK) -> DataFrame:
    """(id, ids) of every row: the ids of its text without special tokens, whose strings are ordinary text.

    A null or empty text has the empty list.  Rows come out as often as they stand, also with a null key.
    """
    scratch.spark.sparkContext.addFile(vocabulary)
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    cut = scratch.table(plain.mapInArrow(_chunked(chunk), "chunk long, ids array<long>, counts array<int>, width int, at binary, words array<string>"), "chunks")
    words = cut.select("chunk", F.posexplode("words").alias("place", "word")).select("word", "chunk", "place")
    encoded = words.repartitionByRange("word", "chunk").sortWithinPartitions("word").mapInArrow(_encode_words(vocabulary), "chunk long, place int, ids array<int>")
    return cut.drop("words").groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(_reassemble, "id long, ids array<int>")


def vocabulary_table(spark, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(token, bytes) of every id; as many rows as the vocabulary has tokens."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks(path).items()], "token int, bytes binary")


def decode(encoded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, text): the bytes of each document's ids, joined by position; an empty list gives the empty text.

    *encoded* is (id, ids) with unique ids.  The vocabulary is a fixed table, so its broadcast does not grow.  Each
    document's ids are exploded with their distinct values only: a document asks for a token once.
    """
    asked = encoded.select("id", F.explode(F.array_distinct("ids")).alias("token"))
    known = asked.join(F.broadcast(vocabulary), "token").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", F.hex("bytes").alias("hex")))).alias("hexes"))
    joined = F.concat_ws("", F.transform("ids", lambda i: F.element_at("hexes", i)))
    text = F.decode(F.unhex(joined), "UTF-8")
    return encoded.join(known, "id", "left").select("id", F.when(F.size("ids") == 0, "").otherwise(text).alias("text"))


def round_trip(scratch: Scratch, docs: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(id, n_chars, same): whether decoding gives back the text, and its length; null counts as the empty text.

    The token bytes are held by each worker (a fixed table), as a hash join of each position with it.
    """
    pairs = encode(scratch, docs, key, text, vocabulary).join(docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text")), "id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = _token_bytes(vocabulary)
        same = [b"".join([table[i] for i in ids]) == t.encode() for ids, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in batch.column(2).to_pylist()], pa.int64()), pa.array(same, pa.bool_())], ["id", "n_chars", "same"])

    return arrow_map(pairs, run, "id long, n_chars long, same boolean")


@functools.lru_cache(maxsize=1)
def _token_bytes(path: str) -> list[bytes]:
    return [b for b, _ in sorted(ranks(_local(path)).items(), key=lambda x: x[1])]
