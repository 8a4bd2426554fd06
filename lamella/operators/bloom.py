"""Split-block bloom filters: built and probed in numpy, built over DataFrames by a mergeable aggregate of fixed size."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format: the eight odd multipliers that pick a bit in each word of a block.
SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)
BLOCK_BYTES, MIN_BYTES, MAX_BYTES = 32, 32, 128 << 20


def optimal_bytes(ndv: int, fpp: float) -> int:
    """Bytes of a filter for so many distinct values and that rate of false positives: a power of two within bounds."""
    if not 0 < fpp < 1:
        raise ValueError("the rate of false positives lies between 0 and 1")
    bits = -8 * ndv / np.log(1 - fpp ** (1 / 8))
    n = MIN_BYTES
    while n < MAX_BYTES and n * 8 < bits:
        n *= 2
    return n


def encode(value, kind: T.DataType) -> bytes:
    """The plain bytes of a value, which are hashed."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return struct.pack("<i", value)
    if isinstance(kind, T.LongType):
        return struct.pack("<q", value)
    if isinstance(kind, T.FloatType):
        return struct.pack("<f", value)
    if isinstance(kind, T.DoubleType):
        return struct.pack("<d", value)
    if isinstance(kind, T.StringType):
        return value.encode()
    if isinstance(kind, T.BinaryType):
        return bytes(value)
    raise TypeError(f"no bloom filter over {kind.simpleString()}")


def hash_of(value, kind: T.DataType) -> int:
    return xxhash.xxh64_intdigest(encode(value, kind), seed=0)


#: Fixed values of the hash that the format names: its five primes.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hash_fixed(words: np.ndarray) -> np.ndarray:
    """The hashes of many four- or eight-byte values at once, given as uint32 or uint64."""
    with np.errstate(over="ignore"):
        x = words.astype(np.uint64)
        if words.dtype.itemsize == 8:
            h = _rotated((P5 + np.uint64(8)) ^ (_rotated(x * P2, 31) * P1), 27) * P1 + P4
        else:
            h = _rotated((P5 + np.uint64(4)) ^ (x * P1), 23) * P2 + P3
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


_WORDS = {T.ByteType: (np.int32, np.uint32), T.ShortType: (np.int32, np.uint32), T.IntegerType: (np.int32, np.uint32), T.LongType: (np.int64, np.uint64), T.FloatType: (np.float32, np.uint32), T.DoubleType: (np.float64, np.uint64)}


def hashes_of(column: pa.Array, kind: T.DataType) -> np.ndarray:
    """The hashes of a column's values, which are not null: numbers at once, texts one by one."""
    if type(kind) in _WORDS:
        own, word = _WORDS[type(kind)]
        return hash_fixed(np.ascontiguousarray(column.to_numpy(zero_copy_only=False).astype(own)).view(word))
    return np.array([hash_of(v, kind) for v in column.to_pylist()], np.uint64)


class SplitBlockBloom:
    def __init__(self, size: int, words: np.ndarray | None = None):
        if size < MIN_BYTES or size & (size - 1):
            raise ValueError("a filter has a power of two of bytes, 32 at least")
        self.words = np.zeros((size // BLOCK_BYTES, 8), np.uint32) if words is None else words

    def _masks(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.asarray(hashes, np.uint64)
        block = ((hashes >> np.uint64(32)) * np.uint64(len(self.words))) >> np.uint64(32)
        with np.errstate(over="ignore"):
            bit = (hashes.astype(np.uint32)[:, None] * SALT) >> np.uint32(27)
        return block.astype(np.int64), np.uint32(1) << bit

    def insert(self, hashes: np.ndarray) -> None:
        block, masks = self._masks(hashes)
        np.bitwise_or.at(self.words, block, masks)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        block, masks = self._masks(hashes)
        return ((self.words[block] & masks) == masks).all(axis=1)

    def __or__(self, other: SplitBlockBloom) -> SplitBlockBloom:
        return SplitBlockBloom(self.words.nbytes, self.words | other.words)

    def to_bytes(self) -> bytes:
        return self.words.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> SplitBlockBloom:
        return cls(len(raw), np.frombuffer(raw, "<u4").reshape(-1, 8).astype(np.uint32))


def build(df: DataFrame, column: str, *, ndv: int, fpp: float = 0.01) -> SplitBlockBloom:
    """The filter of a column's values that are not null. Tasks fill filters of their own; their words are or-ed before and after one shuffle of fixed size."""
    kind, size = df.schema[column].dataType, optimal_bytes(ndv, fpp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SplitBlockBloom(size)
        for b in batches:
            own.insert(hashes_of(b.column(0), kind))
        flat = own.words.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at].astype(np.int64))], ["at", "word"])

    c = F.col(f"`{column}`")
    parts = df.where(c.isNotNull()).select(c).distinct().mapInArrow(run, "at int, word long")
    got = parts.groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()  # at most a row per word of the filter
    out = SplitBlockBloom(size)
    out.words.ravel()[got["at"].to_numpy(np.int64)] = got["word"].to_numpy(np.int64).astype(np.uint32)
    return out


def probe(df: DataFrame, column: str, bloom: SplitBlockBloom, name: str = "may_contain") -> DataFrame:
    """df with whether the filter may hold each value; null for null."""
    kind = df.schema[column].dataType
    held = df.sparkSession.sparkContext.broadcast(bloom)
    out = T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(at)
            there = c.is_valid().to_numpy(zero_copy_only=False)
            hit = np.zeros(len(c), bool)
            hit[there] = held.value.contains(hashes_of(c.drop_null(), kind))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit, mask=~there)], out.names)

    return df.mapInArrow(run, out)


def build_adaptive(df: DataFrame, column: str, *, max_bytes: int = 1 << 20, candidates: int = 5, fpp: float = 0.01) -> SplitBlockBloom:
    """The smallest of several sizes that suits the number of distinct values, found by a first pass that sketches it; the largest if none does."""
    n = df.agg(F.approx_count_distinct(f"`{column}`", 0.02).alias("n")).first()["n"]
    sizes = [max_bytes >> k for k in reversed(range(candidates)) if max_bytes >> k >= MIN_BYTES]
    best = next((s for s in sizes if s >= optimal_bytes(max(1, n), fpp)), sizes[-1])
    lo, hi = 1, max_bytes
    while lo < hi:  # a number of values for which this size is the best
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if optimal_bytes(mid, fpp) <= best else (lo, mid - 1)
    return build(df, column, ndv=lo, fpp=fpp)
