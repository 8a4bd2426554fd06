"""Operator 8: near-duplicates by b-bit MinHash, with every link confirmed on full shingle sets.

Exact copies (equal sets) are folded into one class first. Classes get 128 minima: 125 in 25 bands of 5 find candidates, and the low
2 bits of all are packed into 256 bits, from which collision-corrected similarity is read by bit counts. A pair of
similarity 0.85 shares no band once in two million, and falls under the estimate's floor (five deviations below) once in three.
Groups are joined through a few leaders per bucket, found by mergeable minima; then every pair of a bucket whose ends are
still apart is ruled out by what is known of both against a hub, or measured. So no link is lost and no group is written out pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitfilter
from .common import stored
from .components import components
from .mph import mix64
from .shingles import shingle_sets

BANDS, ROWS, HASHES, BITS = 25, 5, 128, 2
WIDTH = 5
#: Rounds of leaders before the rest is tested pair by pair, and how many tests a posting the rest may cost at most while rounds still help.
ROUNDS, PER_POSTING = 6, 64
_rng = np.random.default_rng(8)
_A = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint32)


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for lo in range(0, len(x), 256):
            v = x[lo : lo + 256, None] * _A + _B
            np.minimum(out, v.min(axis=0), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, for rows of minima."""
    with np.errstate(over="ignore"):
        x = np.zeros((len(m), BANDS), np.uint64)
        for r in range(ROWS):
            x = mix64(x ^ m[:, r : BANDS * ROWS : ROWS].astype(np.uint64), 31 + r)
        return mix64(x + np.arange(BANDS, dtype=np.uint64), 41).view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """The low two bits of (remixed) minima, 32 to a word."""
    with np.errstate(over="ignore"):
        low = (m ^ (m >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        low = (low ^ (low >> np.uint32(13))) & np.uint32(3)
    shifts = (np.arange(HASHES) % 32 * BITS).astype(np.uint64)
    return np.bitwise_or.reduce((low.astype(np.uint64) << shifts).reshape(len(m), HASHES // 32, 32), axis=2).view(np.int64)


def agreement(a: list[Column], b: list[Column]) -> Column:
    """How many of the minima agree in their low bits."""
    odd = F.lit(0x5555555555555555)
    differ = [(x.bitwiseXOR(y).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1))).bitwiseAND(odd) for x, y in zip(a, b, strict=True)]
    n = F.bit_count(differ[0])
    for d in differ[1:]:
        n = n + F.bit_count(d)
    return F.lit(HASHES) - n


def floor_of(percent: int) -> int:
    """The least agreement of a pair to test: expected at the threshold, corrected for chance agreement, less five deviations."""
    p = percent / 100 * (1 - 2.0**-BITS) + 2.0**-BITS
    return int(HASHES * p - 5 * (HASHES * p * (1 - p)) ** 0.5)


def row_key(doc_id: str, text: str) -> Column:
    """What tells rows apart: 63 bits of a hash of id and text. Rows with equal ids and texts are one."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 1)


def sketch(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, row, n_shingles, s1 and s2 (a 128-bit hash of the set; null without words), bands and sig."""
    schema = "doc_id long, row long, n_shingles long, s1 long, s2 long, bands array<long>, sig0 long, sig1 long, sig2 long, sig3 long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for sets in shingle_sets(b.column(2), WIDTH):
                n = np.array([len(s) for s in sets], np.int64)
                none = n == 0
                m = np.stack([minima(s) for s in sets])
                with np.errstate(over="ignore"):
                    one = np.array([np.bitwise_xor.reduce(mix64(s, 51)) for s in sets], np.uint64)
                    two = np.array([np.add.reduce(mix64(s, 52)) for s in sets], np.uint64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(m).ravel()))
                sig = packed(m)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), b.column(1).slice(at, len(sets)), pa.array(n), pa.array(one.view(np.int64), mask=none), pa.array(two.view(np.int64), mask=none), keys, *(pa.array(np.ascontiguousarray(sig[:, k])) for k in range(4))], names)
                at += len(sets)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("row"), F.col(text).alias("text")).mapInArrow(run, schema)


def wanted_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """(v, set) of the rows in wanted (v, a row's key): their sorted shingle hashes. A bit filter of fixed size drops most other rows before the join."""
    bits = bitfilter.build(wanted.select("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = bitfilter.hits(bits.value, b.column(2).to_numpy())
            if not hit.any():
                continue
            b = b.filter(pa.array(hit))
            at = 0
            for sets in shingle_sets(b.column(1), WIDTH):
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["v", "set"])
                at += len(sets)

    d = docs.select(row_key(doc_id, text).alias("v"), F.col(text).alias("text"))
    found = d.withColumn("bit", bitfilter.place(F.col("v"))).mapInArrow(run, "v long, set array<long>")
    return stored(found.join(wanted.select("v").distinct(), "v", "left_semi").dropDuplicates(["v"]))


def measured(docs: DataFrame, doc_id: str, text: str, pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The pairs (a, b) with na, nb and both: the sizes of their full sets and of the intersection; and the sets (v, set) of all their ends."""
    pairs = stored(pairs)
    if pairs.isEmpty():
        return pairs.select("a", "b", *(F.lit(0).alias(c) for c in ("na", "nb", "both"))), None
    sets = wanted_sets(docs, doc_id, text, pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "v"))
    p = pairs.join(sets.select(F.col("v").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("v").alias("b"), F.col("set").alias("sb")), "b")
    return stored(p.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))), sets


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def rest_of_pairs(now: DataFrame, left: DataFrame, marks: DataFrame, copies: DataFrame, sigs: list[str], known: DataFrame, sets: DataFrame | None, least: int, percent: int) -> DataFrame:
    """Pairs of a bucket whose ends are still apart, may be linked, and have not been measured.

    A member's hub is the class with most copies among those that it was measured against, itself included: it lacks some of
    the hub's shingles and adds others. Two members of one hub that share no addition differ at least by both their additions and by how much their losses differ in number. Where that is too much for a link,
    only pairs that share an addition remain, and these are found by it. So near copies of one text are not paired off.
    """
    hub = known.select(F.col("a").alias("hub"), F.col("b").alias("v"), (F.col("nb") - F.col("both")).alias("add"), (F.col("na") - F.col("both")).alias("lack"), F.col("nb").alias("size"))
    hub = hub.unionAll(known.select(F.col("b").alias("hub"), F.col("a").alias("v"), F.col("na") - F.col("both"), F.col("nb") - F.col("both"), "na"))
    self_ = hub.select("hub").distinct().join(known.select(F.col("a").alias("hub"), F.col("na").alias("size")).unionAll(known.select(F.col("b").alias("hub"), F.col("nb").alias("size"))).distinct(), "hub")
    hub = hub.unionAll(self_.select("hub", F.col("hub").alias("v"), F.lit(0).alias("add"), F.lit(0).alias("lack"), "size"))
    most = F.max_by(F.struct("hub", "add", "lack", "size"), F.struct("n", -F.col("hub")))
    best = hub.join(copies.select(F.col("v").alias("hub"), "n"), "hub").groupBy("v").agg(most.alias("s")).select("v", "s.*")
    x = stored(now.drop("hub").join(left.select("key", "c0"), "key").join(best, "v", "left").join(marks, "v"))
    y = x.select("key", "hub", F.col("v").alias("w"), F.col("c").alias("d"), *(F.col(s).alias(f"{s}w") for s in (*sigs, "add", "lack", "size")))
    apart = (F.col("c") != F.col("d")) & ((F.col("d") == F.col("c0")) | (F.col("v") < F.col("w"))) & (agreement([F.col(s) for s in sigs], [F.col(f"{s}w") for s in sigs]) >= least)
    gap = F.col("add") + F.col("addw") + F.abs(F.col("lack") - F.col("lackw"))
    near = F.coalesce((F.col("x.hub") != F.col("y.hub")) | ((100 + percent) * gap <= (100 - percent) * (F.col("size") + F.col("sizew"))), F.lit(True))
    pair = [F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")]
    out = x.where("c <> c0").alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & apart & near).select(*pair)
    if sets is not None:
        each = x.where("add > 0").select("hub", "v", "c", *sigs).distinct()
        own = each.join(sets, "v").join(sets.select(F.col("v").alias("hub"), F.col("set").alias("hub_set")), "hub")
        rows = stored(own.select("hub", "v", "c", *sigs, F.explode(F.array_except("set", "hub_set")).alias("shingle")))
        # an edit adds several shingles that the same members share: one of them stands for all with the same members
        who = [F.bit_xor(F.xxhash64(F.lit(k), "v")).alias(f"m{k}") for k in (1, 2)]
        often = rows.groupBy("hub", "shingle").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("n"), *who).where("c1 <> c2")
        often = often.groupBy("hub", "n", "m1", "m2").agg(F.min("shingle").alias("shingle")).select("hub", "shingle")
        rows = stored(rows.join(often, ["hub", "shingle"], "left_semi"))
        other = rows.select(F.col("hub").alias("hub2"), F.col("shingle").alias("shingle2"), F.col("v").alias("w"), F.col("c").alias("d"), *(F.col(s).alias(f"{s}w") for s in sigs))
        agree = agreement([F.col(s) for s in sigs], [F.col(f"{s}w") for s in sigs]) >= least
        more = rows.join(other, (F.col("hub") == F.col("hub2")) & (F.col("shingle") == F.col("shingle2")) & (F.col("v") < F.col("w")) & (F.col("c") != F.col("d")) & agree)
        out = out.unionAll(more.select(*pair))
    return out.distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included) and kept (it is that one).

    Null and empty texts have the empty set, link with nothing and are kept. Rows with equal doc_ids and different texts are
    documents of their own, each with its own component; rows without an id link like any, get the smallest doc_id of their component, or
    null, and are not kept if it has one. Repeated rows each give a row, all alike; an empty table gives an empty result. Other columns are not read.
    """
    rows = stored(sketch(docs, doc_id, text))
    sigs = [f"sig{k}" for k in range(HASHES // 32)]
    full = rows.where("n_shingles > 0")
    # a class is the rows of one set; v, the least of their keys, stands for it
    classes = stored(full.groupBy("s1", "s2").agg(F.min("row").alias("v"), F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"), *(F.any_value(s).alias(s) for s in sigs), F.count("*").alias("n")))
    posts = classes.select("v", "n", F.explode("bands").alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    posts = stored(posts.join(shared, "key", "left_semi").select("key", "v", "n"))
    marks = classes.select("v", *sigs)
    least = floor_of(percent)

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose packed minima agree enough."""
        p = pairs.join(marks.select(F.col("v").alias("a"), *(F.col(s).alias(f"{s}a") for s in sigs)), "a").join(marks.select(F.col("v").alias("b"), *(F.col(s).alias(f"{s}b") for s in sigs)), "b")
        return p.where(agreement([F.col(f"{s}a") for s in sigs], [F.col(f"{s}b") for s in sigs]) >= least).select("a", "b")

    # hub: the class of a bucket with most copies; it stays the same in all rounds
    hubs = posts.groupBy("key").agg(F.max(F.struct("n", (-F.col("v")).alias("v")))["v"].alias("hub")).select("key", (-F.col("hub")).alias("hub"))
    posts = stored(posts.join(hubs, "key").select("key", "v", "hub"))
    now = posts.withColumn("c", F.col("v"))
    known, links, sets, comp = None, None, None, None
    for k in range(ROUNDS):
        far = F.max(F.struct(F.xxhash64("v", F.lit(k)), "v"))["v"]
        b = now.groupBy("key").agg(F.min("v").alias("l1"), far.alias("l2"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2")
        p = now.join(b, "key").select("v", "c", F.explode(F.array_distinct(F.array("hub", "l1", "l2") if k == 0 else F.array("l2"))).alias("l")).where("v <> l")
        if k:
            p = p.join(comp.select(F.col("v").alias("l"), F.col("c").alias("lc")), "l").where("c <> lc")
        p = p.select(F.least("v", "l").alias("a"), F.greatest("v", "l").alias("b")).distinct()
        if known is not None:
            p = p.join(known, ["a", "b"], "left_anti")
        p, own = measured(docs, doc_id, text, likely(p))
        good = linked(p, percent)
        known, links = (p, good) if k == 0 else (known.unionByName(p), links.unionByName(good))
        sets = own if sets is None else sets if own is None else sets.unionByName(own).dropDuplicates(["v"])
        labels = components(links)
        comp = stored(classes.select("v").join(labels, "v", "left").select("v", F.coalesce("c", "v").alias("c")))
        now = stored(posts.join(comp, "v"))
        # what is left: members outside their bucket's first class, against all of the bucket
        left = now.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("v", "c"))["c"].alias("c0"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2")
        out = now.join(left.select("key", "c0"), "key").where("c <> c0").groupBy("key").agg(F.count("*").alias("m"))
        cost = out.join(left, "key").agg(F.sum(F.col("m").cast("double") * F.col("n")).alias("x"), F.sum("n").alias("n")).first()
        if (cost["x"] or 0) <= PER_POSTING * max(cost["n"] or 0, 100_000) or good.isEmpty():
            break
    good = linked(measured(docs, doc_id, text, rest_of_pairs(now, left, marks, classes.select("v", "n"), sigs, known, sets, least, percent))[0], percent)
    if not good.isEmpty():
        labels = components(links.unionByName(good))
    linked_ = classes.join(labels, "v").select("s1", "s2", "c", "id")
    least_id = linked_.groupBy("c").agg(F.min("id").alias("component_id"))
    alone = classes.where("n > 1").join(labels.select("v"), "v", "left_anti").select("s1", "s2", F.col("id").alias("component_id"))
    changed = linked_.join(least_id, "c").select("s1", "s2", "component_id").unionAll(alone).withColumn("told", F.lit(True))
    r = rows.select("doc_id", "n_shingles", "s1", "s2").alias("r").join(changed.alias("k"), (F.col("r.s1") == F.col("k.s1")) & (F.col("r.s2") == F.col("k.s2")), "left")
    c = F.when(F.col("k.told"), F.col("k.component_id")).otherwise(F.col("r.doc_id"))
    return r.select(F.col("r.doc_id").alias("doc_id"), F.col("r.n_shingles").alias("n_shingles"), c.alias("component_id"), F.col("r.doc_id").eqNullSafe(c).alias("kept"))
