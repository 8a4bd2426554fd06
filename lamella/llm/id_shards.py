"""Operator 9: token ids in binary shards with a minimal perfect hash index: constant-time keyed access over raw id payloads.

A shard is one file: raw little-endian ids of its documents back to back (16 bits where the vocabulary allows, else 32),
then the documents' keys in order, then the index: the perfect hash and, by slot, a fingerprint, the document's first id and its
number of ids; last a fixed footer with the sections' places.
"""

from __future__ import annotations

import array
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import fresh_dir, opened
from .mph import PerfectHash, mix64

MARK = b"LAMIDS01"
FOOTER = struct.Struct("<5QI8s")  # ids, documents, start of keys, start of the hash, start of the entries; bytes an id; mark
KEY = np.dtype([("id", "<i8"), ("null", "u1"), ("nth", "<u4")])
ENTRY = np.dtype([("print", "<u4"), ("start", "<u8"), ("n", "<u4")])
READ_IDS = 1 << 22
#: Bytes of text that a shard is made for.
SHARD_BYTES = 32 << 20
#: Characters of a text by which rows of one key are ordered before its hash is.
HEAD = 32


@dataclass(frozen=True)
class Shard:
    uri: str
    start: int
    ids: int
    docs: int


def hashed(keys: np.ndarray) -> np.ndarray:
    """64-bit hashes of keys (document id, whether it is null, which of the rows with that id)."""
    x = mix64(keys["id"].astype(np.int64).view(np.uint64), 101)
    return mix64(x ^ (keys["nth"].astype(np.uint64) << np.uint64(1)) ^ keys["null"].astype(np.uint64), 102)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(hashed(keys), 103) >> np.uint64(32)).astype(np.uint32)


class ShardWriter:
    """Streams ids to a file; holds keys and starts of its documents only."""

    def __init__(self, out, width: int):
        self.out, self.width, self.last = out, width, None
        self.ids, self.null, self.nth, self.counts = array.array("q"), array.array("B"), array.array("I"), array.array("q")

    def add(self, doc_id: int | None, raw: bytes) -> None:
        nth = self.nth[-1] + 1 if self.nth and self.last == doc_id else 0
        self.last = doc_id
        for a, v in ((self.ids, doc_id or 0), (self.null, doc_id is None), (self.nth, nth), (self.counts, len(raw) // self.width)):
            a.append(v)
        self.out.write(raw)

    def close(self) -> int:
        keys, counts = np.zeros(len(self.ids), KEY), np.array(self.counts, np.int64)
        keys["id"], keys["null"], keys["nth"] = self.ids, self.null, self.nth
        starts, total = np.cumsum(counts) - counts, int(counts.sum())
        mph = PerfectHash.build(hashed(keys))
        entries = np.zeros(len(keys), ENTRY)
        slots = mph.slots(hashed(keys))
        entries["print"][slots], entries["start"][slots], entries["n"][slots] = fingerprints(keys), starts, counts
        sections, at = [keys.tobytes(), mph.to_bytes(), entries.tobytes()], [total * self.width]
        for s in sections:
            self.out.write(s)
            at.append(at[-1] + len(s))
        self.out.write(FOOTER.pack(total, len(keys), *at[:3], self.width, MARK))
        return total


class ShardReader:
    """Keyed access over a random-access file: the footer and the index are read once, payloads by range."""

    def __init__(self, f):
        self.f, size = f, f.size()
        self.ids, self.docs, keys, mph, entries, self.width, mark = FOOTER.unpack(self.at(size - FOOTER.size, FOOTER.size))
        if mark != MARK:
            raise ValueError("not a shard, or cut short")
        self.keys_at = keys
        self.mph = PerfectHash.from_bytes(self.at(mph, entries - mph))
        self.entries = np.frombuffer(self.at(entries, self.docs * ENTRY.itemsize), ENTRY)

    def at(self, pos: int, n: int) -> bytes:
        self.f.seek(pos)
        return self.f.read(n)

    def keys(self) -> np.ndarray:
        return np.frombuffer(self.at(self.keys_at, self.docs * KEY.itemsize), KEY)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; -1 for keys that the shard does not hold (told by the fingerprint, one in 2**32 goes wrong)."""
        slot = self.mph.slots(hashed(keys))
        e = self.entries[np.maximum(slot, 0)] if self.docs else np.zeros(len(keys), ENTRY)
        known = (slot >= 0) & (e["print"] == fingerprints(keys))
        return np.where(known, e["start"].astype(np.int64), -1), np.where(known, e["n"].astype(np.int64), -1)

    def payload(self, start: int, n: int) -> np.ndarray:
        return np.frombuffer(self.at(start * self.width, n * self.width), f"<u{self.width}")

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        start, n = self.find(np.array([(doc_id or 0, doc_id is None, nth)], KEY))
        return None if start[0] < 0 else self.payload(int(start[0]), int(n[0]))


def write(docs: DataFrame, folder: str, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> list[Shard]:
    """Encode every text, append end_id, write shards of some shard_bytes of text in ascending key order; returns the shards in that order.

    One range shuffle of (key, text); each task then encodes and streams its shard. A task that is tried again writes
    another file and only the last one counts. Null texts are empty (the end id alone), null keys come first,
    equal keys stand together, in the order of the text's first characters and then of its hash, over as many shards as their rows fill, and
    are told apart by their number in a shard; repeated rows each get their ids, and share a shard; an empty table gives no shard.
    """
    spark = docs.sparkSession
    shared = bpe.Shared(docs, text, tokenizer_path)
    width = 2 if max(bpe.driver_encoder(shared.source).tok.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.encoder(f"bytes{width}", lambda ids: array.array("H" if width == 2 else "I", ids).tobytes())
        end = end_id.to_bytes(width, "little")
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        uri = f"{folder}/{uuid.uuid4().hex}.ids"
        fs, path = opened(uri)
        with fs.open_output_stream(path) as out:
            w = ShardWriter(out, width)
            for b in (y for x in ([first], batches) for y in x):
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    w.add(i, b"".join(enc.values_of(t) if t else ()) + end)
            total = w.close()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([uri]), pa.array([total], pa.int64()), pa.array([len(w.ids)], pa.int64())], ["part", "uri", "ids", "docs"])

    d = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    size = d.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    order = [F.col("k").asc_nulls_first(), F.substring("t", 1, HEAD).asc_nulls_first(), F.xxhash64("t").asc()]
    made = d.repartitionByRange(-(-size // shard_bytes) or 1, *order).sortWithinPartitions(*order, "t").mapInArrow(encode, "part long, uri string, ids long, docs long").collect()
    out, at = [], 0  # a line per shard, never per document
    for r in sorted(made, key=lambda r: r["part"]):
        out.append(Shard(r["uri"], at, r["ids"], r["docs"]))
        at += r["ids"]
    return out


def read(spark: SparkSession, shards: list[Shard], key: str = "doc_id") -> DataFrame:
    """Per document of the shards: its key, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as 32-bit integers), each found through the index."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                fs, path = opened(shards[k].uri)
                with fs.open_input_file(path) as f:
                    r = ShardReader(f)
                    keys = r.keys()
                    for lo in range(0, len(keys), 5_000):
                        part = keys[lo : lo + 5_000]
                        start, n = r.find(part)
                        if (start < 0).any():
                            raise ValueError(f"{shards[k].uri}: a key is not in its index")
                        crc = [checksum(r, int(s), int(m)) for s, m in zip(start, n, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(part["id"], mask=part["null"].astype(bool)), pa.array(start + shards[k].start), pa.array(n), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    n = len(shards)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(look, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def checksum(r: ShardReader, start: int, n: int) -> int:
    crc = 0
    for at in range(start, start + n, READ_IDS):
        crc = zlib.crc32(r.payload(at, min(READ_IDS, start + n - at)).astype("<u4").tobytes(), crc)
    return crc


def write_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write docs to shards in the shared folder and read them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, fresh_dir(spark, "ids"), tokenizer_path))
