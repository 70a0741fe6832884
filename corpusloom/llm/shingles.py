"""Words, word shingles and signatures, computed over whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from ._common import slices
from .canonical import words

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


#: Words of a run by which texts are compared.
RUN = 4
#: 64-bit words of a text's bits.
MARKS = 8


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words of the current batches."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self) -> None:
        if len(self) > self.LIMIT:
            self.clear()


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M3
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Batch:
    """The words of several texts as one flat array; ``starts`` and ``ends`` bound each text's, ``index`` gives its
    position in the input.  Texts without words are left out."""

    def __init__(self, words: np.ndarray, lengths: list[int], index: list[int] | None = None):
        self.words = words
        self.ends = np.cumsum(np.array(lengths, np.int64))
        self.starts = self.ends - np.array(lengths, np.int64)
        self.index = list(range(len(lengths))) if index is None else index

    @classmethod
    def of_texts(cls, texts: list[str | None], hashes: WordHashes, pad: int, salt: str | None = None) -> Batch:
        """Words are 64-bit hashes, texts of fewer than *pad* words are filled up; with a *salt*, ``node`` gives the
        digest of each text's word sequence."""
        hashes.trim()
        index, node, flat, lengths = [], [], [], []
        for i, text in enumerate(texts):
            w = words(text)
            if w:
                index.append(i)
                if salt is not None:
                    node.append(xxhash.xxh3_64_intdigest(salt + " ".join(w)) - (1 << 63))
                w += [""] * (pad - len(w))
                flat += w
                lengths.append(len(w))
        out = cls(np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat)), lengths, index)
        out.node = node
        return out

    def codes(self) -> list[bytes]:
        """Each text as 32-bit word codes, big-endian, so that their order is that of the words' numbers; 0 is kept for
        what lies behind a text's end."""
        raw = np.maximum(self.words.astype(">u4"), 1).astype(">u4").view(np.uint8)
        return [raw[4 * a : 4 * z].tobytes() for a, z in zip(self.starts, self.ends)]

    @classmethod
    def of_codes(cls, codes: pa.Array) -> Batch:
        """From what :meth:`codes` gave."""
        values = codes.to_pylist()
        return cls(np.frombuffer(b"".join(values), ">u4").astype(np.uint64), [len(v) // 4 for v in values])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words that stay within a text, and where each text's runs begin.

        No text may have fewer than n words; those that had are filled up, so they have one run.
        """
        w = self.words
        if not len(w):
            return w, np.zeros(0, np.int64)
        out = np.zeros(len(w) - n + 1, np.uint64)
        for i in range(n):
            out = (out ^ w[i : len(w) - n + 1 + i]) * _M1
            out ^= out >> np.uint64(31)
        inside = np.zeros(len(w) + 1, np.int32)
        np.add.at(inside, self.starts, 1)
        np.add.at(inside, self.ends - (n - 1), -1)
        keep = np.cumsum(inside)[: len(out)] > 0
        counts = self.ends - self.starts - (n - 1)
        return scramble(out[keep]), np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhash(grams: np.ndarray, begins: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """(texts, n) minima of n hash functions over each text's grams."""
    mul, add = _constants(n, seed)
    out = np.empty((len(begins), n), np.uint64)
    for i in range(n):
        out[:, i] = np.minimum.reduceat((grams ^ add[i]) * mul[i], begins)
    return out


def one_wildcard_keys(signature: np.ndarray, width: int) -> np.ndarray:
    """(texts, segments x width) keys: the signature cut into segments of *width* symbols, in each segment every
    symbol once replaced by a wildcard.  Two signatures share a key of a segment exactly if they differ there in at
    most one symbol (but for 64-bit collisions)."""
    texts, n = signature.shape
    seg = signature.reshape(texts, n // width, width)
    out = np.empty((texts, n // width, width), np.uint64)
    for wild in range(width):
        key = np.broadcast_to((np.arange(n // width, dtype=np.uint64) * np.uint64(width) + np.uint64(wild + 1)) * _M1, seg.shape[:2]).copy()
        for i in range(width):
            if i != wild:
                key = (key ^ scramble(seg[:, :, i])) * _M2
                key ^= key >> np.uint64(29)
        out[:, :, wild] = key
    return scramble(out.reshape(texts, -1))


def coded(fields: list[str]):
    """For mapInArrow over (id, fields): (field, id, node, codes) of each text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for f, field in enumerate(fields):
                for batch in slices(whole, f + 1):
                    b = Batch.of_texts(batch.column(f + 1).to_pylist(), hashes, RUN, field + "\n")
                    if b.index:
                        ids = batch.column(0).take(pa.array(b.index, pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array([field] * len(ids)), ids, pa.array(b.node, pa.int64()), pa.array(b.codes(), pa.binary())], ["field", "id", "node", "codes"])

    return run


CODED = "field string, id long, node long, codes binary"


def run_sets(b: Batch, n: int) -> list[np.ndarray]:
    """The sorted distinct runs of n words of each text."""
    grams, begins = b.grams(n)
    return [np.unique(g) for g in np.split(grams, begins[1:])] if len(begins) else []


def bit_marks(sets: list[np.ndarray]) -> list[np.ndarray]:
    """64 * MARKS bits of each set of hashes, those that the hashes fall on."""
    out = []
    for s in sets:
        bits = np.zeros(64 * MARKS, np.uint8)
        bits[(s % np.uint64(64 * MARKS)).astype(np.int64)] = 1
        out.append(np.packbits(bits).view(np.int64))
    return out
