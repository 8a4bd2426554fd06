"""Bounding boxes and type sets of geometries in well-known binary."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z", "m")
SCHEMA = "type int, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double, mmin double, mmax double"


def _coordinates(raw: bytes, at: int) -> tuple[int, list[tuple[float | None, ...]], int]:
    """(type code, points as x, y, z, m, next place) of the geometry that begins at a place."""
    e = "<" if raw[at] == 1 else ">"
    code, = struct.unpack_from(f"{e}I", raw, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4  # a reference system id stands here
    flags, base = code // 1000 % 10 if code < 0x10000000 else 0, code % 1000 if code < 0x10000000 else code & 0xFF
    z, m = bool(code & 0x80000000) or flags in (1, 3), bool(code & 0x40000000) or flags in (2, 3)
    width = 2 + z + m
    points: list[tuple[float | None, ...]] = []

    def take(n: int) -> None:
        nonlocal at
        flat = struct.unpack_from(f"{e}{n * width}d", raw, at)
        at += 8 * n * width
        for k in range(0, len(flat), width):
            p = flat[k : k + width]
            points.append((p[0], p[1], p[2] if z else None, p[2 + z] if m else None))

    def count() -> int:
        nonlocal at
        n, = struct.unpack_from(f"{e}I", raw, at)
        at += 4
        return n

    if base == 1:
        take(1)
    elif base == 2:
        take(count())
    elif base == 3:
        for _ in range(count()):
            take(count())
    elif 4 <= base <= 7:
        for _ in range(count()):
            _, more, at = _coordinates(raw, at)
            points += more
    else:
        raise ValueError(f"geometry type {base} is not known")
    return base + 1000 * z + 2000 * m, points, at


def summary(raw: bytes) -> tuple:
    """(type code, then min and max of x, y, z and m); axes without a number have None. Damaged input raises."""
    kind, points, _ = _coordinates(raw, 0)
    out: list = [kind]
    for axis in range(4):
        v = [p[axis] for p in points if p[axis] is not None and not math.isnan(p[axis])]
        out += [min(v), max(v)] if v else [None, None]
    return tuple(out)


def points(s: pd.Series) -> pd.DataFrame | None:
    """The summaries of a batch of little-endian points in the plane, all at once; None where a value is anything else."""
    if not len(s) or not all(v is not None and len(v) == 21 for v in s):
        return None
    raw = np.frombuffer(b"".join(s), np.dtype([("order", "u1"), ("code", "<u4"), ("x", "<f8"), ("y", "<f8")]))
    if (raw["order"] != 1).any() or (raw["code"] != 1).any():
        return None
    names = [x.strip().split()[0] for x in SCHEMA.split(",")]
    out = pd.DataFrame({n: np.full(len(s), np.nan) for n in names[1:]})
    for axis in "xy":
        out[f"{axis}min"] = out[f"{axis}max"] = raw[axis]
    out.insert(0, "type", pd.array(np.ones(len(s), np.int32), dtype="Int32"))
    return out


def summarise(c: Column) -> Column:
    """A struct of type code and bounds per value; null for null and for damaged values."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split()[0] for x in SCHEMA.split(",")]
        for s in batches:
            rows = []
            if (plain := points(s)) is not None:
                yield plain
                continue
            for v in s:
                try:
                    rows.append(summary(bytes(v)) if v is not None else (None,) * 9)
                except (ValueError, struct.error, IndexError):
                    rows.append((None,) * 9)
            f = pd.DataFrame(rows, columns=names)
            f["type"] = f["type"].astype("Int32")
            yield f.astype({n: "float64" for n in names[1:]})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, SCHEMA)(c)


def bounding_box(df: DataFrame, column: str) -> DataFrame:
    """One row: the bounds of all values and geometry_types, the sorted set of their codes. A damaged value voids the whole: valid is then false."""
    s = df.select(F.col(f"`{column}`").isNotNull().alias("there"), summarise(F.col(f"`{column}`")).alias("g"))
    ends = [F.expr(f"{end}(CASE WHEN NOT isnan(g.{a}{end}) THEN g.{a}{end} END)").alias(f"{a}{end}") for a in AXES for end in ("min", "max")]
    return s.agg(*ends, F.sort_array(F.collect_set("g.type")).alias("geometry_types"), (F.count_if(F.col("there") & F.col("g.type").isNull()) == 0).alias("valid"))


def merge_boxes(a: dict[str, float | None], b: dict[str, float | None]) -> dict[str, float | None]:
    """The box around two; where either crosses the antimeridian (xmin > xmax) X is not known: NaN."""
    out: dict[str, float | None] = {}
    for axis in AXES:
        for end, pick in (("min", min), ("max", max)):
            v = [x for x in (a.get(axis + end), b.get(axis + end)) if x is not None]
            out[axis + end] = pick(v) if v else None
    if any(x.get("xmin") is not None and x.get("xmax") is not None and x["xmin"] > x["xmax"] for x in (a, b)):
        out["xmin"] = out["xmax"] = math.nan
    return out
