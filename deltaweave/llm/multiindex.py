"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A text's set is its distinct n-word shingles, as of the set join (A-Z lower-cased; fewer words: all of them as one; no word: the empty set, linked
with nothing). Its signature holds, for each of `values` hash functions, `bits` bits of the set's smallest hash. Two sets of similarity s agree in a value
with probability s + (1 - s) / 2**bits, so the values in which two signatures differ, their Hamming distance, tell 1 - s.

The join finds every pair of signatures within `radius`: they are split into chunks, and by the pigeonhole principle two signatures within
(errors + 1) * chunks - 1 have a chunk with at most `errors` values in error. For each chunk all choices of so many values to leave out are
enumerated, and what is left of the chunk is the key of a list. Signatures with at most `errors` differences there share the
list that leaves those out; nothing within the radius is missed.

With the values given, a pair of similarity 0.85 lies beyond the radius with probability missed(0.85), some 5 in a million, and more similar pairs less
often; whoever wants less takes more values. What sketches of parities show to be too far apart to link is left out, the other pairs within the
radius are confirmed on whole sets, and classes of equal sets and components already found are skipped, as in the set join: no pairs within a
component are formed.

Nulls: a null text is the empty one; rows without an id are documents of their own and are kept. Rows that share an id are documents of their own with
one label if their texts link. Ties don't arise; an empty table gives an empty result; texts of any length count in full; other columns aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .setjoin import PARITY_BITS, Parities, Terms, _rows, grouped, parities, set_hash, shingle_sets, wide_parities
from .shared import cut
from .words import blocks, mix

PARITY_WORDS = PARITY_BITS // 64


@dataclass(frozen=True)
class Signature:
    """values hash functions of bits each, in chunks of `chunk` values of which `errors` may differ."""

    values: int = 96
    bits: int = 8
    chunk: int = 6
    errors: int = 1
    seed: int = 20240611

    def __post_init__(self):
        tags = self.chunks * math.comb(self.chunk, self.errors)
        if self.values % 8 or self.values % self.chunk or not 0 <= self.errors < self.chunk or not 1 <= self.bits <= 8:
            raise ValueError("values are whole chunks and whole words of eight, errors fewer than a chunk's values, and bits 1 to 8")
        if (self.chunk - self.errors) * self.bits + tags.bit_length() > 63:
            raise ValueError("a list's key has to fit into 63 bits")

    @property
    def chunks(self) -> int:
        return self.values // self.chunk

    @property
    def radius(self) -> int:
        return (self.errors + 1) * self.chunks - 1

    def missed(self, similarity: float) -> float:
        """The probability that a pair of this similarity lies beyond the radius."""
        p = (1 - similarity) * (1 - 2.0**-self.bits)
        return sum(math.comb(self.values, k) * p**k * (1 - p) ** (self.values - k) for k in range(self.radius + 1, self.values + 1))

    def signatures(self, sets: list[np.ndarray]) -> list[bytes | None]:
        """A byte a value; null for an empty set."""
        rng = np.random.default_rng(self.seed)
        flip = rng.integers(0, 1 << 63, self.values, dtype=np.uint64)
        times = rng.integers(0, 1 << 62, self.values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        some = [s for s in sets if len(s)]
        if not some:
            return [None] * len(sets)
        flat = np.concatenate(some)
        starts = np.cumsum([0, *map(len, some[:-1])])
        out = np.empty((len(some), self.values), np.uint8)
        for k in range(self.values):
            out[:, k] = mix(np.minimum.reduceat((flat ^ flip[k]) * times[k], starts)) >> np.uint64(64 - self.bits)
        made = iter(out)
        return [next(made).tobytes() if len(s) else None for s in sets]

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """Keys of the lists that signatures are in, a row each: the values left out and the chunk, and the other values."""
        sig = signatures.reshape(-1, self.chunks, self.chunk).astype(np.int64)
        out = []
        for tag, left in enumerate(combinations(range(self.chunk), self.errors)):
            key = np.arange(self.chunks) + tag * self.chunks
            for v in range(self.chunk):
                if v not in left:
                    key = (key << self.bits) | sig[:, :, v]
            out.append(key)
        return np.concatenate(out, axis=1)

    def first_shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The key of the first list that both signatures of a pair are in."""
        kx, ky = self.keys(x), self.keys(y)
        return kx[np.arange(len(kx)), np.argmax(kx == ky, axis=1)]


class Neighbours(Parities):
    """Lists by chunks of signatures; before the signatures' distance, the sketch of parities tells sets that can't link. A pair that shares several
    lists is given out by the first of them alone."""

    column, ordered, thin, long, tile = "bits", False, True, 4096, 2048

    def __init__(self, terms: Terms, signature: Signature):
        self.terms, self.signature = terms, signature

    def _signatures(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows[:, PARITY_WORDS:]).view(np.uint8)

    def elements(self, column: pa.Array) -> list[np.ndarray]:
        return list(self.signature.keys(self._signatures(_rows(column)))) if len(column) else []

    def sketch(self, bits: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(bits[:, :PARITY_WORDS])

    def meets(self, e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = self._signatures(x), self._signatures(y)
        return ((a != b).sum(axis=1) <= self.signature.radius) & (self.signature.first_shared(a, b) == e)

    def near(self, nx, bits_x, wide_x, ny, bits_y, wide_y) -> tuple[np.ndarray, np.ndarray]:
        may, far = super().near(nx, bits_x, wide_x, ny, bits_y, wide_y)
        x, y = (self._signatures(_rows(b)) for b in (bits_x, bits_y))
        return may & ((x != y).sum(axis=1) <= self.signature.radius), far


def _signed(rows: DataFrame, n: int, signature: Signature) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, j in blocks(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(i, j - i), n)
                bits = [p + s if s else None for p, s in zip(parities(sets), signature.signatures(sets), strict=True)]
                sid = [set_hash(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(list(map(len, sets)), pa.int64()), pa.array(sid, pa.int64()), pa.array(bits, pa.binary()), pa.array(wide_parities(sets), pa.binary())], ["doc_id", "n", "sid", "bits", "wide"])

    return rows.mapInArrow(run, "doc_id long, n long, sid long, bits binary, wide binary")


def near_duplicates(df: DataFrame, terms: Terms = Terms(), signature: Signature = Signature(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: kept are those whose id is the smallest that links reach, and rows without an id."""
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    found = grouped(rows, cut(_signed(rows, terms.n, signature), "docs"), terms, Neighbours(terms, signature))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
