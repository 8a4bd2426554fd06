"""Which row groups or pages a predicate can skip, from statistics alone. Pruning never changes results: what may match is kept."""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import And, Compare, Contains, In, Or, Predicate, PredicateError, UserDefined, apply_filter, columns, normalize
from ..sources.chunks import Bounds, Chunk, row_group_chunks
from ..sources.footers import each_file, read_row_groups
from ..sources.values import Kind, literal


def _nan(v: Any) -> bool:
    return isinstance(v, float) and math.isnan(v)


def can_drop(p: Predicate, stats: dict[str, Bounds]) -> bool:
    """True only if no row can satisfy the predicate. Columns without statistics keep; columns that the file lacks are given as all null."""
    return _drop(normalize(p), stats)


def _drop(p: Predicate, stats: dict[str, Bounds]) -> bool:
    match p:
        case And(a, b):
            return _drop(a, stats) or _drop(b, stats)
        case Or(a, b):
            return _drop(a, stats) and _drop(b, stats)
        case Contains(inner, negated):
            return not negated and _drop(inner, stats)
    s = stats.get(p.column)
    if s is None:
        return False
    match p:
        case Compare(_, "eq", None):
            return s.nulls == 0
        case Compare(_, "ne", None):
            return s.all_null
        case Compare(_, "ne", v):
            if s.nulls != 0 or s.low is None or _nan(v) or _nan(s.low) or _nan(s.high) or (isinstance(v, float) and s.nans != 0):
                return False
            return s.low == v == s.high
        case Compare(_, op, v):
            if s.all_null:
                return True
            if s.low is None or _nan(v) or _nan(s.low) or _nan(s.high):
                return False
            if isinstance(s.low, float) and op in ("gt", "ge") and s.nans != 0:
                return False  # NaN is above all numbers and not in the bounds
            return {"eq": v < s.low or v > s.high, "lt": s.low >= v, "le": s.low > v, "gt": s.high <= v, "ge": s.high < v}[op]
        case In(_, values, negated):
            if negated:
                return False
            known = [v for v in values if v is not None]
            if None in values and s.nulls != 0:
                return False
            if s.all_null or not known:
                return True
            if s.low is None or any(map(_nan, known)) or _nan(s.low) or _nan(s.high):
                return False
            return min(known) > s.high or max(known) < s.low
        case UserDefined():
            if s.all_null:
                return p.accepts_null == p.negated
            if s.nulls != 0 and p.accepts_null != p.negated:
                return False
            if s.low is None or _nan(s.low) or _nan(s.high):
                return False
            return bool((p.inverse_can_drop if p.negated else p.can_drop)(s.low, s.high))
    raise PredicateError(f"not a leaf: {p!r}")


def dictionary_can_drop(p: Predicate, dictionaries: dict[str, set], nulls: dict[str, int | None] | None = None) -> bool:
    """True only if no value of complete dictionaries satisfies the predicate. Columns without one keep; nulls has null counts where known."""

    def drop(q: Predicate) -> bool:
        match q:
            case And(a, b):
                return drop(a) or drop(b)
            case Or(a, b):
                return drop(a) and drop(b)
            case Contains(inner, negated):
                return not negated and drop(inner)
        values = dictionaries.get(q.column)
        if values is None:
            return False
        no_nulls = (nulls or {}).get(q.column) == 0
        match q:
            case Compare(_, "eq", None) | Compare(_, "ne", None):
                return False
            case Compare(_, "eq", v):
                return v not in values
            case Compare(_, "ne", v):
                return no_nulls and values == {v}
            case Compare(_, op, v):
                test = {"lt": lambda x: x < v, "le": lambda x: x <= v, "gt": lambda x: x > v, "ge": lambda x: x >= v}[op]
                return not any(_nan(x) or test(x) for x in values)
            case In(_, wanted, negated):
                if negated:
                    return (no_nulls or None in wanted) and values <= wanted
                return None not in wanted and not values & wanted
            case UserDefined():
                import pandas as pd

                if not no_nulls and q.accepts_null != q.negated:
                    return False
                return not any(bool(x) != q.negated for x in q.keep(pd.Series(list(values)))) if values else False
        return False

    return drop(normalize(p))


def bloom_can_drop(p: Predicate, may_contain: dict[str, Any]) -> bool:
    """True only if the filters rule the predicate out; may_contain maps columns to functions of a value. Equality and membership alone can drop."""

    def drop(q: Predicate) -> bool:
        match q:
            case And(a, b):
                return drop(a) or drop(b)
            case Or(a, b):
                return drop(a) and drop(b)
            case Contains(inner, False):
                return drop(inner)
            case Compare(c, "eq", v) if v is not None and c in may_contain and not _nan(v):
                return not may_contain[c](v)
            case In(c, values, False) if c in may_contain and None not in values and not any(map(_nan, values)):
                return not any(map(may_contain[c], values))
        return False

    return drop(normalize(p))


@dataclass(frozen=True)
class RowRanges:
    """Sorted ranges of rows, first and last inclusive, apart by a row or more."""

    ranges: tuple[tuple[int, int], ...] = ()

    @classmethod
    def of(cls, *ranges: tuple[int, int]) -> RowRanges:
        out: list[tuple[int, int]] = []
        for a, b in sorted(ranges):
            if out and a <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            elif a <= b:
                out.append((a, b))
        return cls(tuple(out))

    def __or__(self, other: RowRanges) -> RowRanges:
        return RowRanges.of(*self.ranges, *other.ranges)

    def __and__(self, other: RowRanges) -> RowRanges:
        return RowRanges.of(*((max(a, c), min(b, d)) for a, b in self.ranges for c, d in other.ranges if max(a, c) <= min(b, d)))

    @property
    def count(self) -> int:
        return sum(b - a + 1 for a, b in self.ranges)

    def overlaps(self, first: int, last: int) -> bool:
        k = bisect.bisect_left(self.ranges, first, key=lambda r: r[1])
        return k < len(self.ranges) and self.ranges[k][0] <= last


def page_ranges(p: Predicate, pages: dict[str, list[tuple[int, Bounds]]], rows: int) -> RowRanges:
    """The rows that a predicate may match, from page statistics: by column the first row and the bounds of each page, in order. Columns without them keep all rows."""

    def walk(q: Predicate) -> RowRanges:
        match q:
            case And(a, b):
                return walk(a) & walk(b)
            case Or(a, b):
                return walk(a) | walk(b)
        own = pages.get(q.column)
        if own is None:
            return RowRanges.of((0, rows - 1))
        ends = [first for first, _ in own[1:]] + [rows]
        return RowRanges.of(*((first, end - 1) for (first, s), end in zip(own, ends, strict=True) if not _drop(q, {q.column: s})))

    return walk(normalize(p))


def select_pages(ranges: RowRanges, firsts: list[int], rows: int) -> list[int]:
    """Ordinals of the pages (first rows given) that overlap the ranges."""
    return [k for k, first in enumerate(firsts) if ranges.overlaps(first, (firsts[k + 1] if k + 1 < len(firsts) else rows) - 1)]


def with_literals(p: Predicate, kinds: dict[str, Kind]) -> Predicate:
    """A normalized predicate with its values in the terms of the columns' bounds."""
    match p:
        case And(a, b) | Or(a, b):
            return type(p)(with_literals(a, kinds), with_literals(b, kinds))
        case Contains(inner, negated):
            return Contains(with_literals(inner, kinds), negated)
        case Compare(c, op, v) if c in kinds and v is not None:
            return Compare(c, op, literal(v, kinds[c]))
        case In(c, values, negated) if c in kinds:
            return In(c, frozenset(None if v is None else literal(v, kinds[c]) for v in values), negated)
    return p


#: Levels of pruning, in the order in which they are asked; the first that can drops a row group.
LEVELS = ("statistics", "dictionary", "bloom", "column_index")
REPORT = "file string, row_group int, first_row long, rg_rows long, kept boolean, dropped_by string, rows_left long"


def judge(chunks: dict[str, Chunk], rows: int, p: Predicate, levels: tuple[str, ...]) -> tuple[str | None, RowRanges]:
    """(level that drops the row group, or None; the rows that may match). p is normalized; columns that the file lacks are all null."""
    every = RowRanges.of((0, rows - 1)) if rows else RowRanges()
    wanted = columns(p)
    own = {c: chunks.get(c) or next((x for path, x in chunks.items() if path.startswith(f"{c}.") and path.count(".") == c.count(".") + 2), None) for c in wanted}
    absent = {c for c in wanted if own[c] is None and not any(path.startswith(f"{c}.") for path in chunks)}
    known = {c: x for c, x in own.items() if x is not None}
    q = with_literals(p, {c: x.kind for c, x in known.items()})

    def safe(test) -> bool:
        try:
            return test()
        except TypeError:  # values of another type than the bounds: the record level has to tell
            return False

    stats = {c: Bounds(rows, rows) for c in absent} | {c: x.bounds for c, x in known.items()}
    if "statistics" in levels and safe(lambda: _drop(q, stats)):
        return "statistics", RowRanges()
    if "dictionary" in levels:
        entries = {c: d for c, x in known.items() if (d := x.dictionary()) is not None}
        if entries and safe(lambda: dictionary_can_drop(q, entries, {c: known[c].bounds.nulls for c in entries})):
            return "dictionary", RowRanges()
    if "bloom" in levels and any(x.has_bloom for x in known.values()):
        if safe(lambda: bloom_can_drop(q, {c: x.may_contain for c, x in known.items() if x.has_bloom})):
            return "bloom", RowRanges()
    if "column_index" in levels:
        pages = {c: x.pages() for c, x in known.items()}
        pages = {c: v for c, v in pages.items() if v}
        try:
            left = page_ranges(q, pages, rows) & every if pages else every
        except TypeError:
            left = every
        if not left.count:
            return "column_index", left
        return None, left
    return None, every


def prune_report(spark: SparkSession, path: str, p: Predicate, levels: tuple[str, ...] = ("statistics",)) -> DataFrame:
    """A row per row group under path: file, row_group, first_row, rg_rows, kept, dropped_by (the level that rules it out) and rows_left
    (how many rows its page statistics leave, with column_index).

    Footers and, for the other levels, dictionaries, bloom filters and column indexes of the predicate's columns are read on the executors; no data page is.
    """
    p = normalize(p)
    if unknown := set(levels) - set(LEVELS):
        raise ValueError(f"no level {sorted(unknown)[0]}; known: {', '.join(LEVELS)}")

    def rows(uri: str, f, meta):
        before = 0
        for g, chunks in enumerate(row_group_chunks(f, meta, columns(p))):
            n = meta.metadata.row_group(g).num_rows
            level, left = judge(chunks, n, p, levels)
            yield uri, g, before, n, level is None, level, left.count
            before += n

    return each_file(spark, path, rows, REPORT)


def filtered_count(spark: SparkSession, path: str, p: Predicate, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """One row: n_rows, the rows that the levels leave, an upper bound of those that match."""
    return prune_report(spark, path, p, levels).agg(F.coalesce(F.sum("rows_left"), F.lit(0)).alias("n_rows"))


def prune_by_summary(summary: DataFrame, p: Predicate) -> DataFrame:
    """prune_report() at the level of statistics from a saved summary (see footers.summary): no file is opened."""
    p = normalize(p)
    wanted = columns(p)
    c = F.when(F.col("path").isin(wanted) | F.exists(F.lit(wanted), lambda w: F.startswith("path", F.concat(w, F.lit(".")))), F.struct("path", "kind", "n_values", "null_count", "low", "high"))
    groups = summary.groupBy("file", "row_group", "first_row", "rg_rows").agg(F.collect_list(c).alias("c"))

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                chunks = {x["path"]: Chunk.stated(Kind.from_json(x["kind"]), int(x["n_values"]), None if x["null_count"] is None or x["null_count"] != x["null_count"] else int(x["null_count"]), x["low"], x["high"]) for x in r.c}
                level, left = judge(chunks, int(r.rg_rows), p, ("statistics",))
                out.append((r.file, r.row_group, r.first_row, r.rg_rows, level is None, level, left.count))
            yield pd.DataFrame(out, columns=[x.strip().split()[0] for x in REPORT.split(",")])

    return groups.mapInPandas(run, REPORT)


def read_pruned(spark: SparkSession, path: str, p: Predicate, levels: tuple[str, ...] = LEVELS, names: list[str] | None = None) -> DataFrame:
    """The rows that match: row groups that the levels rule out are not read."""
    kept = prune_report(spark, path, p, levels).where("kept").select("file", "row_group", "first_row")
    d = apply_filter(read_row_groups(spark, path, kept), p)
    return d.select(*names) if names else d


def with_nan_count(b: Bounds, nans: int | None) -> Bounds:
    return replace(b, nans=nans)
