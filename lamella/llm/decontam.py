"""Operator 4: benchmark decontamination by spaced seeds.

A seed is the hash of the tokens that a fixed mask selects; tokens under its gaps may differ. Hashes of the benchmark's items
meet those of the documents in the map task, and each hit is verified along its whole alignment: the stretch of most
equal tokens of which four in five are equal. So no document is shuffled, and only matches leave a task. A benchmark too large for that
meets the documents in a join of seeds, and only documents with a common seed are shuffled, to be verified in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitfilter
from .common import free_name, stored
from .mph import mix64
from .shingles import MARKS, _PLACE, chunks, texts_of, words

#: Fixed masks, 1 for a token that counts: seven of up to twelve, gaps in different places.
MASKS = ("111010010111", "110100110111", "111001010101", "1101101101")
SPAN = max(map(len, MASKS))
#: Items of fewer tokens cannot be told from chance and are not searched; those shorter than a mask are met as a whole.
MIN_TOKENS = 5
#: A match has so many equal tokens (or all of a shorter item), at four in five of its stretch or more.
MIN_MATCHED = 10
#: Benchmark text that is broadcast at once; a larger benchmark is searched in blocks of items, a pass over the documents each, up to so many
#: blocks, and by a join of seeds beyond. All ways find the same.
BLOCK_BYTES, MAX_BLOCKS = 8 << 20, 4
FILTER = 20


class Index:
    """Seeds of a block of items: per mask, sorted hashes with item and token place, and a bit table in front."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        column = pc.utf8_lower(pa.array(texts, pa.string()))
        raw, offsets = texts_of(column)
        self.ids = ids
        self.h, _, _, self.first = words(raw, offsets, MARKS)
        self.first = self.first.astype(np.int64)
        sizes = np.diff(self.first)
        self.masks, self.shapes = [], []
        shapes = [(m, sizes >= len(m)) for m in MASKS] + [("1" * n, sizes == n) for n in range(MIN_TOKENS, SPAN) if (sizes == n).any()]
        for mask, fits in shapes:
            at = np.flatnonzero([c == "1" for c in mask])
            s, pos = seeds(self.h, at, len(mask))
            item = np.searchsorted(self.first, pos, "right") - 1
            ok = fits[item] & (pos + len(mask) <= self.first[item + 1]) if len(pos) else np.zeros(0, bool)
            s, pos, item = s[ok], pos[ok], item[ok]
            order = np.argsort(s, kind="stable")
            bits = np.zeros(1 << FILTER, bool)
            bits[(s >> np.uint64(64 - FILTER)).astype(np.int64)] = True
            if len(s):
                self.shapes.append(mask)
                self.masks.append((at, len(mask), s[order], item[order], (pos - self.first[item])[order], bits))

    def matches(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, length, equal tokens) of the best match of each text and item; start counts the text's tokens."""
        found = set()
        for at, span, keys, item, place, bits in self.masks:
            s, _ = seeds(h, at, span)
            near = np.flatnonzero(bits[(s >> np.uint64(64 - FILTER)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, s[near], "left"), np.searchsorted(keys, s[near], "right")
            hit = hi > lo
            near, lo, n = near[hit], lo[hit], (hi - lo)[hit]
            if not len(near):
                continue
            doc = np.searchsorted(first, near, "right") - 1
            inside = near + span <= first[doc + 1]
            near, lo, n, doc = near[inside], lo[inside], n[inside], doc[inside]
            which = np.repeat(np.arange(len(near)), n)
            e = lo[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]
            shift = near[which] - place[e]  # where the item's first token falls
            found.update(zip(doc[which].tolist(), item[e].tolist(), shift.tolist(), strict=True))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, k, shift in found:
            a, b = int(self.first[k]), int(self.first[k + 1])
            lo, hi = max(shift, int(first[doc])), min(shift + b - a, int(first[doc + 1]))
            same = h[lo:hi] == self.h[a + lo - shift : a + hi - shift]
            x, y = stretch(same)
            equal = int(same[x:y].sum())
            if equal >= min(MIN_MATCHED, b - a):
                best[doc, k] = max(best.get((doc, k), (0, 0, 0)), (equal, -(y - x), -(lo + x - int(first[doc]))))
        for (doc, k), (equal, length, start) in sorted(best.items()):
            yield doc, k, -start, -length, equal


def seeds(h: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash under a mask at each place where it fits, and the places."""
    n = max(0, len(h) - span + 1)
    s = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k, p in enumerate(at):
            s += h[p : p + n] * _PLACE[k % 16]
        return mix64(s, 60 + span), np.arange(n)


def stretch(same: np.ndarray) -> tuple[int, int]:
    """The range with most equal tokens among all of which at least four in five are equal; of several the shortest, then the first."""
    ones = np.flatnonzero(same)
    if not len(ones):
        return 0, 0
    # from the i-th equal token to the j-th: 5 (j - i + 1) >= 4 (ones[j] - ones[i] + 1), that is u[j] >= u[i] - 1
    u = 5 * np.arange(len(ones)) - 4 * ones
    far = np.maximum.accumulate(u[::-1])[::-1]
    last = np.searchsorted(-far, 1 - u, "right") - 1
    size = last - np.arange(len(ones))
    most = np.flatnonzero(size == size.max())
    start, end = ones[most], ones[last[most]] + 1
    k = int(np.argmin(end - start))
    return int(start[k]), int(end[k])


def n_blocks(benchmark: DataFrame, text: str) -> int:
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return -(-size // BLOCK_BYTES) or 1


def blocks(benchmark: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """The benchmark in blocks of items of bounded size."""
    n = n_blocks(benchmark, text)
    b = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return [b] if n == 1 else [b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def indexes(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    for b in blocks(benchmark, item_id, text):
        rows = b.collect()
        yield Index([r["item_id"] for r in rows], [r["text"] for r in rows])


def per_text(column: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    raw, offsets = texts_of(pc.utf8_lower(column))
    for lo, hi in chunks(offsets):
        h, _, _, first = words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], MARKS)
        for doc, *rest in index.matches(h, first):
            yield lo + doc, *rest


def shaped(s: np.ndarray, mask: str) -> np.ndarray:
    """Seeds of one mask apart from those of others."""
    return mix64(s ^ np.uint64(int(mask, 2)), 59).view(np.int64)


def common_seeds(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row, item) for rows of docs (row, text) and items (item, text) that have a seed in common; each pair once."""

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = Index(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(0).to_numpy()
            for mask, (_, _, keys, item, _, _) in zip(x.shapes, x.masks, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(shaped(keys, mask)), pa.array(own[item]), pa.array([mask] * len(keys))], ["s", "item", "mask"])

    seeds_ = stored(items.select("item", "text").mapInArrow(of_items, "s long, item long, mask string").distinct())
    masks = [r["mask"] for r in seeds_.select("mask").distinct().collect()]  # eleven at most
    bits = bitfilter.build(seeds_.select("s"), F.pmod(F.col("s"), F.lit(bitfilter.BITS)))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = texts_of(pc.utf8_lower(b.column(1)))
            own = b.column(0).to_numpy()
            for lo, hi in chunks(offsets):
                h, _, _, first = words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], MARKS)
                for mask in masks:
                    s, at = seeds(h, np.flatnonzero([c == "1" for c in mask]), len(mask))
                    s = shaped(s, mask)
                    hit = np.flatnonzero(bitfilter.hits(bits.value, s % bitfilter.BITS))
                    if not len(hit):
                        continue
                    doc = np.searchsorted(first, at[hit], "right") - 1
                    inside = at[hit] + len(mask) <= first[doc + 1]
                    hit, doc = hit[inside], doc[inside]
                    yield pa.RecordBatch.from_arrays([pa.array(own[lo + doc]), pa.array(s[hit])], ["row", "s"])

    found = docs.select("row", "text").mapInArrow(of_docs, "row long, s long")
    return found.join(seeds_.select("s", "item"), "s").select("row", "item").distinct()


def by_join(docs: DataFrame, benchmark: DataFrame, schema: str) -> DataFrame:
    """contamination() of docs (doc_id, text) by a join of seeds with the benchmark (item_id, text); nothing of either is fetched or broadcast."""
    names = [x.split()[0] for x in schema.split(", ")]
    items = stored(benchmark.where("text IS NOT NULL").groupBy("item_id", "text").agg(F.count("*").alias("n")).withColumn("item", F.xxhash64("item_id", "text")))
    rows = docs.where("text IS NOT NULL").withColumn("row", F.xxhash64("doc_id", "text"))
    pairs = common_seeds(rows, items).join(items, "item")
    wanted = stored(pairs.groupBy("row").agg(F.collect_list(F.struct("item_id", "text", "n")).alias("items")).withColumnRenamed("row", "own"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                items = b.column(2)[k].as_py()
                x = Index([i["item_id"] for i in items], [i["text"] for i in items])
                one = list(per_text(b.column(1).slice(k, 1), x))
                out = [(x.ids[r[1]], *r[2:], int(x.first[r[1] + 1] - x.first[r[1]])) for r in one for _ in range(items[r[1]]["n"])]
                ids = b.column(0).take(pa.array([k] * len(out), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[c] for r in out], pa.int64()) for c in range(5))], names)

    bits = bitfilter.build(wanted.select("own"))
    near = rows.withColumn("bit_place", bitfilter.place(F.col("row"))).mapInArrow(filtered(bits), "doc_id long, text string, row long")
    return near.join(wanted, F.col("row") == F.col("own")).select("doc_id", "text", "items").mapInArrow(verify, schema)


def filtered(bits):
    """A map over batches whose last column tells their place in a bit filter: the rows that it may hold, without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = bitfilter.hits(bits.value, b.column(b.num_columns - 1).to_numpy())
            if hit.any():
                kept = b.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], kept.schema.names[:-1])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and item that match: doc_id, item_id, start and length (tokens of the document), n_equal, n_item (the item's tokens).

    Tokens are runs of ASCII letters, digits and any other non-ASCII characters, in lower case. Of several matches of a
    pair the one with most equal tokens counts, then the shortest, then the first. Null and empty texts match nothing; repeated rows each
    give their matches, and so do repeated items; null ids are kept; an empty benchmark or table gives an empty result. Items of fewer than
    five tokens match nothing: so few cannot be told from chance. Whole texts are searched, however long.
    """
    sc = docs.sparkSession.sparkContext
    schema = "doc_id long, item_id long, start long, length long, n_equal long, n_item long"
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if n_blocks(benchmark, item_text) > MAX_BLOCKS:
        return by_join(d, benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")), schema)
    names = [x.split()[0] for x in schema.split(", ")]

    def searched(index: Index) -> DataFrame:
        held = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = held.value
            for b in batches:
                rows = list(per_text(b.column(1), x))
                ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                columns = [[x.ids[r[1]] for r in rows], *([r[k] for r in rows] for k in (2, 3, 4)), [int(x.first[r[1] + 1] - x.first[r[1]]) for r in rows]]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], names)

        return d.mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, (searched(i) for i in indexes(benchmark, item_id, item_text)))


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text matches an item; no shuffle, unless the benchmark is too large for blocks."""
    sc = docs.sparkSession.sparkContext
    if n_blocks(benchmark, item_text) > MAX_BLOCKS:
        key = free_name(docs, "__row")
        keyed = docs.withColumn(key, F.xxhash64(text))
        bench = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
        bad = by_join(keyed.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), bench, "doc_id long, item_id long, start long, length long, n_equal long, n_item long")
        return keyed.join(bad.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)
    at = docs.columns.index(text)
    for index in indexes(benchmark, item_id, item_text):
        held = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bad = np.ones(b.num_rows, bool)
                bad[[r[0] for r in per_text(b.column(at), held.value)]] = False
                yield b.filter(pa.array(bad))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
