"""Operator 1: removal of long repeated strings by longest previous factors.

Equal texts are folded first: what occurs whole twice goes whole, and one of its copies stands for all against other texts.
Any string of LENGTH bytes holds an anchor: the place of the least hash of its 200-byte parts. Equal strings have their
anchors at the same distance, so only places with the same anchor string have to meet, and every string belongs to one anchor.
An anchor's span is all the strings that it stands for. A span that occurs whole twice repeats in all its strings; one of its
places meets the other distinct spans around the same anchor string in a block, and there previous and next smaller
positions in suffix order give each string's earlier and later matches. Where more distinct spans share an anchor string than a block
holds, they are cut into parts whose strings share a longer one, twice over: first some STEPS[0] strings a part, then single
strings, which repeat if they occur whole twice. So every group ends in blocks, and none, however large, meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitfilter
from .common import forget, stored
from .lpf import repeated
from .mph import mix64
from .shingles import chunks, texts_of

LENGTH, PART = 400, 200
#: Bytes of a shorter string whose repetition is told of a text, though nothing is removed for it: fifty words or so.
PASSAGE = 280
#: Distinct spans of one anchor string that are compared in one block; more are cut into parts. Bytes of spans in a block.
MAX_SPANS, BLOCK = 500, 1 << 18
#: Strings of a part, at the first and the second cut.
STEPS = (25, 1)
#: Rows of a batch that are worked on at once, and bytes of texts.
ROWS, CHUNK = 256, 1 << 16
#: Texts that a task remembers, so that it takes copies once; beyond it forgets them, which costs time and changes nothing.
SEEN = 100_000
_rng = np.random.default_rng(1_400)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 1 << 63)) | 1
_BACK = pow(_BASE, -1, 1 << 64)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_made: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_made.get(base, ())) < n:
        p = np.full(max(n, 1 << 18), base, np.uint64)
        p[0] = 1
        _made[base] = np.multiply.accumulate(p)
    return _made[base][:n]


def rolling(raw: np.ndarray, part: int) -> np.ndarray:
    """A hash of the part bytes from each place on, good in its upper bits."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * _powers(_BASE, len(raw)), out=sums[1:])
    h = sums[part:] - sums[:-part]
    h *= _powers(_BACK, len(h))
    return h


def least(key: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbouring keys."""
    have = 1
    while have * 2 <= w:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    return np.minimum(key[: -(w - have)], key[w - have :]) if w > have else key


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, first string, last string, hash) of each anchor of the texts in raw, in order; places count all bytes of raw."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none.astype(np.uint64)
    h = rolling(raw, part)
    key = h & _HIGH
    key |= np.arange(len(h), dtype=np.uint64)  # ties go to the first place
    place = least(key, length - part + 1).astype(np.uint32)
    new = np.empty(len(place), bool)
    new[0] = True
    np.not_equal(place[1:], place[:-1], out=new[1:])
    starts = offsets[1:-1]
    new[starts[starts < len(new)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    text = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(last, offsets[text + 1] - length)  # strings that end within the text
    ok = last >= first
    first, last, text = first[ok], last[ok], text[ok]
    place = place[first].astype(np.int64)
    return text, place, first, last, mix64(h[place], 70)


def digest(raw: bytes, offset: int) -> int:
    """64 bits of SHA-256 over a span and the place of its anchor; with the anchor string's own hash 128 bits tell spans."""
    return int.from_bytes(hashlib.sha256(b"%d:%b" % (offset, raw)).digest()[:8], "little", signed=True)


def identity(text: str = "text") -> Column:
    """Half of the SHA-256 of a text: equal for equal texts alone."""
    return F.unhex(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 32))


def fresh(t: list, seen: set) -> np.ndarray:
    """Which texts the task has not met; remembers them."""
    out = np.zeros(len(t), bool)
    for i, x in enumerate(t):
        if x not in seen:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(x)
            out[i] = True
    return out


SPANS = "t binary, h long, g long, lo int, hi int, place int"


def span_rows(t: pa.Array, row: np.ndarray, h: np.ndarray, raw: np.ndarray, base: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows of SPANS; lo, hi and place count a text's own bytes, base is where the text begins in raw."""
    view = raw.tobytes()
    g = [digest(view[a:b], c) for a, b, c in zip((base + lo).tolist(), (base + hi + length).tolist(), (place - lo).tolist(), strict=True)]
    columns = [pa.array(c.astype(np.int32)) for c in (lo, hi, place)]
    return pa.RecordBatch.from_arrays([t.take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(g, pa.int64()), *columns], ["t", "h", "g", "lo", "hi", "place"])


def anchor_rows(docs: DataFrame, length: int, part: int) -> DataFrame:
    """A row of SPANS per anchor of docs (t, text); a task takes equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            b = b.filter(pa.array(fresh(b.column(0).to_pylist(), seen)))
            raw, offsets = texts_of(b.column(1))
            for lo, hi in chunks(offsets, CHUNK):
                start = offsets[lo : hi + 1] - offsets[lo]
                mine = raw[offsets[lo] : offsets[hi]]
                text, place, first, last, h = anchors(mine, start, length, part)
                base = start[text]
                yield span_rows(b.column(0), lo + text, h, mine, base, first - base, last - base, place - base, length)

    return docs.select("t", "text").mapInArrow(run, SPANS)


def parts(b: pa.RecordBatch, step: int, length: int) -> pa.RecordBatch:
    """Rows of SPANS for the parts of the marked spans of rows (t, text, marks): strings whose distance to the anchor falls in one class of step distances.

    All strings of a class hold the same length - step + 1 bytes around the anchor, whose hash is the new h.
    """
    raw, offsets = texts_of(b.column(1))
    row, _, lo, hi, place = marked(b, CUT)
    n = (place - lo) // step - (place - hi) // step + 1
    which = np.repeat(np.arange(len(row)), n)
    kind = ((place - hi) // step)[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]
    row, lo, hi, place = row[which], lo[which], hi[which], place[which]
    base, core = offsets[row], place - kind * step
    view = raw.tobytes()
    h = np.array([digest(view[a:e], c) for a, e, c in zip((base + core).tolist(), (base + core + length - step + 1).tolist(), (-1 - kind).tolist(), strict=True)], np.int64)
    lo, hi = np.maximum(lo, core - step + 1), np.minimum(hi, core)
    return span_rows(b.column(0), row, h, raw, base, lo, hi, place, length)


def kept_by(df: DataFrame, wanted, *key: str) -> DataFrame:
    """The rows of df whose key the bit filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = bitfilter.hits(wanted.value, b.column(b.num_columns - 1).to_numpy())
            if hit.any():
                yield b.filter(pa.array(hit)).select(names)

    names = df.columns
    return df.withColumn("bit_place", bitfilter.place(*(F.col(k) for k in key))).mapInArrow(run, df.schema)


#: What is to be done with a span: all its strings repeat; it goes to a block; it is cut into parts.
WHOLE, COMPARE, CUT = 1, 2, 4


def judged(spans: DataFrame, texts: DataFrame, keep_first: bool) -> DataFrame:
    """(t, lo, hi, place, h, state) of the rows of SPANS (stored, and deleted here) that are not alone; the state's bits as above."""
    often = spans.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    some = stored(kept_by(spans, bitfilter.build(often), "h"))  # most anchor strings are alone; a few of those stay, without harm
    forget(spans)
    place = F.xxhash64("t", "place")  # which of a span's places stands for it: any, or with keep_first the first in the order of doc_id
    if keep_first:
        some = some.join(texts.select("t", "d"), "t")
        place = F.struct("d", "t", "place")
    distinct = some.groupBy("h", "g").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    many = distinct.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    known = distinct.join(many, "h", "left").where("k IS NOT NULL OR a <> b")
    known = stored(known.select(F.col("h").alias("h2"), F.col("g").alias("g2"), "a", (F.col("a") != F.col("b")).alias("twice"), F.coalesce("k", F.lit(1)).alias("k")))
    own = place == F.col("a")
    whole = F.col("twice") & (~own if keep_first else F.lit(True))
    more = F.when(own & (F.col("k") > 1), F.when(F.col("k") > MAX_SPANS, CUT).otherwise(COMPARE)).otherwise(0)
    j = some.join(known, (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")))
    return j.select("t", "lo", "hi", "place", "h", (F.when(whole, WHOLE).otherwise(0) + more).cast("int").alias("state")).where("state > 0")


def per_text(marks: DataFrame) -> DataFrame:
    """t and its marks, each once, whatever the tasks that have met the text; without those that only tell that a span repeats."""
    mark = F.when(F.col("state").bitwiseAND(COMPARE + CUT) > 0, F.struct("h", "lo", "hi", "place", "state"))
    return marks.groupBy("t").agg(F.collect_set(mark).alias("marks"))


def marked(b: pa.RecordBatch, bit: int) -> tuple[np.ndarray, ...]:
    """(row, h, lo, hi, place) of the marks with this bit of rows (t, text, marks, ...)."""
    m = b.column(2)
    size = m.value_lengths().to_numpy(zero_copy_only=False)
    *columns, state = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in m.flatten().flatten())
    go = (state & bit) > 0
    return np.repeat(np.arange(len(size)), size)[go], *(c[go] for c in columns)


def block_matches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For rows (h, d, t, lo, span) sorted by h: blocks of whole groups, and in each the strings with an earlier or a later match."""
    rows: list[tuple] = []
    size, last = 0, None
    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if size > BLOCK and r[0] != last:
                yield from one_block(rows, length)
                rows, size = [], 0
            rows.append(r)
            size, last = size + len(r[4]), r[0]
    yield from one_block(rows, length)


def one_block(rows: list[tuple], length: int):
    if not rows:
        return
    rows = sorted({r[:4]: r for r in rows}.values(), key=lambda r: (r[1], r[2], r[3]))  # text order: what is earlier is so in the corpus
    sizes = np.array([len(r[4]) for r in rows])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    which = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(len(data))
    at = at[at + length <= ends[which]]
    pos, early, late = repeated(data, at, length)
    w = which[pos]
    yield rows, w, pos - (ends - sizes)[w], early, late


def runs(w: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of the runs of neighbouring strings."""
    if not len(w):
        return w, p, p
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (p[1:] != p[:-1] + 1)])
    first = np.flatnonzero(new)
    return w[first], p[first], p[np.append(first[1:], len(p)) - 1]


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def compared(hit: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Ranges (t, a, b) of repeated strings in the marked spans of hit (t, text, marks, d), by blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw, offsets = texts_of(b.column(1))
            row, h, lo, hi, _ = marked(b, COMPARE)
            view, take = raw.tobytes(), pa.array(row)
            spans = [view[s:e] for s, e in zip((offsets[row] + lo).tolist(), (offsets[row] + hi + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(3).take(take), b.column(0).take(take), pa.array(lo.astype(np.int32)), pa.array(spans, pa.binary())], ["h", "d", "t", "lo", "span"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, w, p, early, late in block_matches(slices(batches), length):
            go = early if keep_first else early | late
            w, a, b = runs(w[go], p[go])
            lo = np.array([rows[i][3] for i in w], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][2] for i in w], pa.binary()), pa.array((lo + a).astype(np.int32)), pa.array((lo + b).astype(np.int32))], ["t", "a", "b"])

    spans = hit.select("t", "text", "marks", "d").mapInArrow(cut, "h long, d long, t binary, lo int, span binary")
    return spans.repartition("h").sortWithinPartitions("h").mapInArrow(compare, "t binary, a int, b int")


def repeats(docs: DataFrame, texts: DataFrame, *, length: int = LENGTH, part: int = PART, keep_first: bool = False, decided: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hit, ranges) for docs (d, t, text) and their distinct texts (t, d): the texts with strings that may repeat elsewhere, and the ranges of
    those that do: t, a, b (strings that start at a to b). With keep_first only strings with an earlier match count. Copies of whole texts are not looked at.
    With decided (t) only whether other texts have a range is asked: groups in which no such text is left open are not compared."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()
        for b in batches:
            yield b.filter(pa.array(fresh(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), seen)))

    spans, hit, found = stored(anchor_rows(docs, length, part)), None, []
    for step in (*STEPS, None):
        marks = stored(judged(spans, texts, keep_first))
        found.append(marks.where(F.col("state").bitwiseAND(WHOLE) > 0).select("t", F.col("lo").alias("a"), F.col("hi").alias("b")))
        if hit is None and decided is not None:
            done = decided.select("t").unionAll(marks.where(F.col("state").bitwiseAND(WHOLE) > 0).select("t")).distinct()
            open_groups = marks.where(F.col("state").bitwiseAND(COMPARE + CUT) > 0).join(done, "t", "left_anti").select("h").distinct()
            marks = stored(marks.join(open_groups, "h", "left_semi").select(marks.columns))
        if hit is None:
            some = stored(per_text(marks).join(texts.select("t", "d"), "t"))
            rows = kept_by(docs.select("d", "t", "text"), bitfilter.build(some.select("t")), "t")
            rows = rows.mapInArrow(once, rows.schema).join(some, ["t", "d"]).dropDuplicates(["t"])  # repeated rows are alike; a task passes each once
            hit = open_ = stored(rows.select("t", "text", "marks", "d"))
        else:
            some = stored(per_text(marks.where(F.col("state").bitwiseAND(COMPARE + CUT) > 0)))
            open_ = stored(kept_by(hit.select("t", "text", "d"), bitfilter.build(some.select("t")), "t").join(some, "t").select("t", "text", "marks", "d"))
        found.append(compared(open_, length, keep_first))
        if step is None or marks.where(F.col("state").bitwiseAND(CUT) > 0).isEmpty():
            break

        def cut(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 32):
                yield parts(b, step, length)

        spans = stored(open_.mapInArrow(cut, SPANS))
    return hit, reduce(DataFrame.unionAll, found)


def removals(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, part: int = PART, keep_first: bool = False, texts: bool = True, passage: int | None = PASSAGE) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats and, with texts, kept_text (what is left, as bytes: a removed string may end within a character).

    has_repeats tells whether any string of passage bytes (None: of length bytes) of the text also starts anywhere else in the table; such strings are found in the
    same way, and nothing is removed for them. A byte goes if a string of length bytes that covers it also starts anywhere else in the table, the same text
    included; with keep_first, if it starts earlier in the order of doc_id and place. Texts are judged as they came. Null texts are empty; short ones lose nothing;
    repeated rows are copies of each other, and with keep_first fare alike; other columns are not read; an empty table gives an empty result.
    """
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), d.alias("d"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", identity())
    passage = passage or length
    long = docs.where(F.octet_length("text") >= min(length, passage))
    whole = stored(long.groupBy("t").agg(F.min("d").alias("d"), F.count("*").alias("n")))
    hit, ranges = repeats(long.where(F.octet_length("text") >= length), whole, length=length, part=part, keep_first=keep_first)
    per_doc = ranges.groupBy("t").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    cuts = hit.join(per_doc, "t").select("t", "text", "a", "b")
    schema = "t binary, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * texts
    names = [c.split()[0] for c in schema.split(", ")]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            raw, offsets = texts_of(s.column(1))
            out = []
            for k, (lo, hi) in enumerate(zip(s.column(2).to_pylist(), s.column(3).to_pylist(), strict=True)):
                mine = raw[offsets[k] : offsets[k + 1]]
                edge = np.zeros(len(mine) + 1, np.int32)
                np.add.at(edge, np.array(lo, np.int64), 1)
                np.add.at(edge, np.array(hi, np.int64) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = mine[~gone].tobytes()
                out.append((int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())] + [pa.array([r[3] for r in out], pa.binary())] * texts
            yield pa.RecordBatch.from_arrays([s.column(0), *columns], names)

    lost = stored(cuts.mapInArrow(remove, schema))
    told_of = lost.select("t")
    if passage < length:
        known = stored(lost.select("t").unionAll(whole.where("n > 1").select("t")).distinct())
        told_of = told_of.unionAll(repeats(long, whole, length=passage, part=passage // 2, decided=known)[1].select("t"))
    # one row per text that loses anything, has copies or holds a passage that repeats
    fate = stored(whole.where("n > 1").join(lost, "t", "full").join(told_of.distinct().withColumn("told", F.lit(True)), "t", "full"))
    fate = fate.select(F.col("t").alias("t2"), F.col("d").alias("first"), "n", "told", *(F.col(c).alias(f"cut_{c}") for c in names[1:]))
    t = F.col("text").cast("binary")
    rows = docs.select("doc_id", "d", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(t, 256).alias("plain_sha256"), *([t.alias("plain_text")] * texts))
    r = rows.join(fate, F.col("t") == F.col("t2"), "left")
    all_ = F.col("n").isNotNull() & (F.col("n_bytes") >= length) & ((F.col("d") != F.col("first")) if keep_first else F.lit(True))

    def told(c: str, everything: Column, nothing: Column) -> Column:
        return F.when(all_, everything).otherwise(F.coalesce(F.col(f"cut_{c}"), nothing)).alias(c)

    none = F.lit(0).cast("long")
    out = [told("n_removed", F.col("n_bytes"), none), told("n_spans", F.lit(1).cast("long"), none), told("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), F.col("plain_sha256"))]
    if texts:
        out.append(told("kept_text", F.lit(b""), F.col("plain_text")))
    has = (F.col("told").isNotNull() | F.col("n").isNotNull()).alias("has_repeats")
    return r.select("doc_id", "n_bytes", *out[:3], has, *out[3:])
