"""Byte-level BPE in two tiers of lookup: a broadcast table of the corpus's frequent pre-tokens, then a bounded cache of each worker.

Used by token counting and by the id writer. Encoding a pre-token never needs its neighbours, so a frequent one is
encoded once, on the driver, and any other by the tokenizers library once per worker, and looked up ever after. Texts with characters whose class could
differ between Unicode versions, and texts with added-token strings, go to the library whole; so results equal
``Tokenizer.encode(text, add_special_tokens=False).ids`` for every text.
"""

from __future__ import annotations

import array
import hashlib
import json
import os
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Letters and numbers up to U+024F; all else there is white space or punctuation.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
PRE_TOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: The same for all scripts; slower.
ANY_SCRIPT = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts within this set are split by PRE_TOKEN, others by ANY_SCRIPT, or by the library itself where unsure() finds a character.
BEYOND = re.compile("[^\\t\\n\\x0b\\x0c\\r\\x20-\\x7e\\x85\\xa0-\\u024f\\u2010-\\u2027]")
#: Counts above this are not told apart when tier one is chosen.
RARE = 1_000
#: Tier one: at most so many pre-tokens of at most so many characters, the most frequent ones of the first texts of each partition (so many texts and characters of them). The bounds touch speed alone.
MAX_FREQUENT, MAX_PIECE, SAMPLE_TEXTS, SAMPLE_CHARS = 1 << 17, 32, 2048, 4 << 20
#: Bound on the vocabulary file that is broadcast.
MAX_FILE = 64 << 20


def read_tokenizer(path: str) -> str:
    """The JSON of a tokenizer file, read on the driver; it is what goes to the workers."""
    if (n := Path(path).stat().st_size) > MAX_FILE:
        raise ValueError(f"{path} has {n} bytes; at most {MAX_FILE} are broadcast")
    return Path(path).read_text(encoding="utf-8")


def byte_alphabet() -> list[str]:
    """The character by which byte-level BPE writes each byte: itself where printable, else the next from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = [], 0
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(256 + n))
            n += 1
    return out


@cache
def unsure() -> re.Pattern:
    """Finds characters whose class (letter, number, space, other) has changed between Unicode 3.2 and Python's, control characters that some call spaces, and lone surrogates."""

    def kind(db, c: str) -> str:
        k = db.category(c)[0]
        return k if k in "LNZ" else "other"

    odd = [k for k in range(sys.maxunicode + 1) if 0xD800 <= k < 0xE000 or 0x1C <= k < 0x20 or kind(unicodedata, c := chr(k)) != kind(unicodedata.ucd_3_2_0, c)]
    ends = [k for k, n in zip(odd, [*odd[1:], -1], strict=True) if n != k + 1]
    starts = [odd[0], *(n for k, n in zip(odd, odd[1:], strict=False) if n != k + 1)]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]")


def pre_tokens(text: str) -> list[str] | None:
    """The pre-tokens of a text in order; None where the library has to tell."""
    if not BEYOND.search(text):
        return PRE_TOKEN.findall(text)
    return None if unsure().search(text) else ANY_SCRIPT.findall(text)


@dataclass(frozen=True)
class Frequent:
    """Tier one in compact arrays: pre-tokens as UTF-8 back to back and their ids back to back, each with the ends."""

    text: bytes
    text_ends: np.ndarray
    ids: np.ndarray
    id_ends: np.ndarray

    @classmethod
    def of(cls, pieces: pa.Array, encode) -> Frequent:
        """From a binary array, value by value, so that the driver never holds them as objects."""
        ids, ends = array.array("I"), array.array("I")
        for p in pieces:
            ids.extend(encode(p.as_py().decode()))
            ends.append(len(ids))
        sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
        return cls(b"".join(p.as_py() for p in pieces), np.cumsum(sizes, dtype=np.uint32), np.frombuffer(ids, np.uint32).copy(), np.frombuffer(ends, np.uint32).copy())

    def items(self) -> Iterator[tuple[str, list[int]]]:
        ids, a, b = self.ids.tolist(), 0, 0
        for e, f in zip(self.text_ends.tolist(), self.id_ends.tolist(), strict=True):
            yield self.text[a:e].decode(), ids[b:f]
            a, b = e, f


def frequent(docs: DataFrame, text: str, tokenizer_json: str) -> Frequent:
    """The frequent pre-tokens of docs, counted over a bounded sample: what each task meets first. Only their counts are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts, chars = Counter(), 0, 0
        for b in batches:
            for t in b.column(0).slice(0, SAMPLE_TEXTS - texts).to_pylist():
                seen.update(p for p in pre_tokens((t or "")[: SAMPLE_CHARS - chars]) or () if len(p) <= MAX_PIECE)
                texts, chars = texts + 1, min(SAMPLE_CHARS, chars + len(t or ""))
            if texts >= SAMPLE_TEXTS or chars >= SAMPLE_CHARS:
                break
        yield pa.RecordBatch.from_arrays([pa.array([k.encode() for k in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

    counts = docs.select(text).mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = stored(counts)
    # how many pre-tokens occur n times or more tells the least n for which they are few enough to fetch
    often = Counter({r["n"]: r["k"] for r in counts.groupBy(F.least("n", F.lit(RARE)).alias("n")).agg(F.count("*").alias("k")).collect()})
    least, room = RARE + 1, MAX_FREQUENT
    while least > 1 and often[least - 1] <= room:
        least, room = least - 1, room - often[least - 1]
    wanted = counts.where(F.col("n") >= least) if least <= RARE else counts.where(F.col("n") >= RARE).limit(MAX_FREQUENT)
    pieces = wanted.select("piece").toArrow().column(0).combine_chunks()
    pieces = pieces.take(pc.array_sort_indices(pieces)) if len(pieces) else pa.array([], pa.binary())
    return Frequent.of(pieces, driver_encoder(tokenizer_json).ids)


@lru_cache(maxsize=1)
def driver_encoder(tokenizer_json: str) -> Encoder:
    """The driver's own encoder, made once."""
    return Encoder(tokenizer_json, {}, list)


def base_table(tokenizer_json: str) -> dict[str, list[int]]:
    """Each vocabulary entry that is a whole pre-token and encodes to itself, with its id: a table that needs no corpus."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    back = {c: b for b, c in enumerate(byte_alphabet())}
    out = {}
    for piece, i in json.loads(tokenizer_json)["model"]["vocab"].items():
        try:
            text = bytes(back[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if not BEYOND.search(text) and PRE_TOKEN.findall(text) == [text] and [t.id for t in tok.model.tokenize(piece)] == [i]:
            out[text] = [i]
    return out


class Encoder(dict):
    """pre-token -> value, where value is made from the ids. Misses are encoded and kept; beyond ``room`` entries the kept ones go."""

    def __init__(self, tokenizer_json: str, table: Frequent | dict[str, list[int]], value, room: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.value, self.room = Tokenizer.from_str(tokenizer_json), value, room
        model = json.loads(tokenizer_json)
        pre = model.get("pre_tokenizer") or {}
        #: Anything but plain byte-level BPE goes to the library whole.
        self.plain = model["model"].get("type", "BPE") == "BPE" and not model.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = re.compile("|".join(re.escape(a["content"]) for a in model["added_tokens"])) if model["added_tokens"] else None
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet())}
        self.table = {k: value(i) for k, i in table.items()}
        self.update(self.table)

    def ids(self, piece: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]

    def __missing__(self, piece: str):
        if len(self) >= self.room:
            self.clear()
            self.update(self.table)
        v = self[piece] = self.value(self.ids(piece))
        return v

    def values_of(self, text: str):
        """The values of a text's pre-tokens in order."""
        pieces = pre_tokens(text) if self.plain and not (self.added and self.added.search(text)) else None
        if pieces is None:
            return [self.value(self.tok.encode(text, add_special_tokens=False).ids)]
        return map(self.__getitem__, pieces)


_made: dict[tuple[str, str], Encoder] = {}


class Shared:
    """A tokenizer and the frequent pre-tokens of a table, broadcast; each worker process makes one encoder of it per kind of value."""

    def __init__(self, docs: DataFrame, text: str, tokenizer_path: str):
        sc, self.source = docs.sparkSession.sparkContext, read_tokenizer(tokenizer_path)
        table = frequent(docs, text, self.source)
        self.key = hashlib.sha256(b"".join([self.source.encode(), table.text, *(x.tobytes() for x in (table.text_ends, table.ids, table.id_ends))])).hexdigest()
        self.held = sc.broadcast((self.source, table))

    def __getstate__(self):
        return {"key": self.key, "held": self.held}

    def encoder(self, kind: str, value) -> Encoder:
        if (kind, self.key) not in _made:
            _made.clear()
            _made[kind, self.key] = Encoder(*self.held.value, value)
        return _made[kind, self.key]
