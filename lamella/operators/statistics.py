"""Column statistics, size statistics and level histograms as aggregations with partial sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.FloatType, T.DoubleType)


def _bounds(c: Column, kind: T.DataType) -> tuple[Column, Column]:
    """min and max without NaN; zeros widened to -0.0 and 0.0 for floats."""
    if not isinstance(kind, _FLOATS):
        return F.min(c), F.max(c)
    real = F.when(~F.isnan(c), c)
    low, high = F.min(real), F.max(real)
    return F.when(low == 0, F.lit(-0.0)).otherwise(low), F.when(high == 0, F.lit(0.0)).otherwise(high)


def column_statistics(df: DataFrame, *names: str, skip: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """A row per primitive column (and per group of ``by``): column_name, n_values, null_count, nan_count, min_value and max_value as strings.

    One pass, one partial aggregate for all columns. Float bounds leave NaN out; a column in ``skip`` has no statistics.
    nan_count is null for columns that cannot hold NaN.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [n for n in (names or [n for n, k in kinds.items() if not isinstance(k, (T.StructType, T.ArrayType, T.MapType))]) if n not in by]
    aggs = []
    for n in names:
        c, kind = F.col(f"`{n}`"), kinds[n]
        low, high = _bounds(c, kind) if n not in skip else (F.lit(None), F.lit(None))
        nan = F.count_if(F.isnan(c)) if isinstance(kind, _FLOATS) else F.lit(None).cast("long")
        aggs.append(F.struct(F.lit(n).alias("column_name"), F.count("*").alias("n_values"), F.count_if(c.isNull()).alias("null_count"), nan.alias("nan_count"), low.cast("string").alias("min_value"), high.cast("string").alias("max_value")))
    return df.groupBy(*by).agg(F.array(*aggs).alias("s")).select(*by, F.explode("s").alias("s")).select(*by, "s.*")


def merge_statistics(parts: DataFrame, kind: str = "double") -> DataFrame:
    """One row per column from partial ones (column_name, n_values, null_count, nan_count, min_value, max_value): sums and extremes; a nan_count that one side lacks is unset."""
    low, high = F.col("min_value").cast(kind), F.col("max_value").cast(kind)
    nan = F.when(F.count_if(F.col("nan_count").isNull()) == 0, F.sum("nan_count"))
    return parts.groupBy("column_name").agg(F.sum("n_values").alias("n_values"), F.sum("null_count").alias("null_count"), nan.alias("nan_count"), F.min(low).alias("min_value"), F.max(high).alias("max_value"))


def unencoded_bytes(df: DataFrame, *names: str) -> DataFrame:
    """column_name and unencoded_bytes (of all values) for string and binary columns."""
    names = names or tuple(f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType)))
    sums = F.array(*(F.struct(F.lit(n).alias("column_name"), F.coalesce(F.sum(F.octet_length(f"`{n}`").cast("long")), F.lit(0)).alias("unencoded_bytes")) for n in names))
    return df.agg(sums.alias("s")).select(F.inline("s"))


def _levels(kind: T.DataType, c: Column, nullable: bool, depth: int) -> tuple[Column, int]:
    """(array of the definition levels below a value, greatest level)."""
    here = depth + (1 if nullable else 0)
    if isinstance(kind, T.ArrayType):
        inner, top = _levels(kind.elementType, F.lit(None), kind.containsNull, here + 1)
        some = F.flatten(F.transform(c, lambda v: _levels(kind.elementType, v, kind.containsNull, here + 1)[0]))
        return F.when(c.isNull(), F.array(F.lit(depth))).when(F.size(c) == 0, F.array(F.lit(here))).otherwise(some), top
    if isinstance(kind, T.StructType):
        raise TypeError("give the path of a primitive column")
    return F.array(F.when(c.isNull(), F.lit(depth)).otherwise(F.lit(here))), here


def level_histograms(df: DataFrame, path: str) -> DataFrame:
    """level_kind (definition or repetition), level and n for a column, which may be a list, a list of lists, or below structs.

    Definition levels count the optional and repeated steps that are there; a repetition level is 0 for the first
    value of a row and 1 for others of its list, one more per list around.
    """
    steps, kind, c, nullable, depth, missing = path.split("."), df.schema, None, False, 0, []
    for step in steps:
        f = kind[step]
        c = F.col(f"`{step}`") if c is None else c[step]
        kind, nullable = f.dataType, f.nullable
        if isinstance(kind, T.StructType):
            if nullable:
                missing.append((c, depth))
                depth += 1
    levels, top = _levels(kind, c, nullable, depth)
    levels = reduce(lambda inner, m: F.when(m[0].isNull(), F.array(F.lit(m[1]))).otherwise(inner), reversed(missing), levels)
    definition = df.select(F.explode(levels).alias("level")).groupBy("level").agg(F.count("*").alias("n")).select(F.lit("definition").alias("level_kind"), F.col("level").cast("int"), "n")
    reps, k = _repetition(kind, c)
    if not k:
        return definition
    reps = reduce(lambda inner, m: F.when(m[0].isNull(), F.array(F.lit(0))).otherwise(inner), reversed(missing), reps)
    repetition = df.select(F.explode(reps).alias("level")).groupBy("level").agg(F.count("*").alias("n")).select(F.lit("repetition").alias("level_kind"), F.col("level").cast("int"), "n")
    return definition.unionAll(repetition)


def _repetition(kind: T.DataType, c: Column, depth: int = 0) -> tuple[Column, int]:
    if not isinstance(kind, T.ArrayType):
        return F.array(F.lit(depth)), 0
    _, inner = _repetition(kind.elementType, F.lit(None))

    def element(v: Column, i: Column) -> Column:
        below = _repetition(kind.elementType, v, depth + 1)[0]
        return F.when(i == 0, F.concat(F.array(F.lit(depth)), F.slice(below, 2, F.greatest(F.size(below), F.lit(1))))).otherwise(F.concat(F.array(F.lit(depth + 1)), F.slice(below, 2, F.greatest(F.size(below), F.lit(1)))))

    return F.when(c.isNull() | (F.size(c) == 0), F.array(F.lit(depth))).otherwise(F.flatten(F.transform(c, element))), inner + 1


def page_statistics(df: DataFrame, column: str, order: str, rows: int) -> DataFrame:
    """Per page of ``rows`` rows in the order given: page, n, null_count, min_value, max_value; and boundary_order over the whole.

    order is a column that numbers rows from 0, such as the row index of the scan, so pages need no sort.
    """
    c = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    low, high = _bounds(c, kind)
    return df.groupBy(F.floor(F.col(order) / rows).alias("page")).agg(F.count("*").alias("n"), F.count_if(c.isNull()).alias("null_count"), low.alias("min_value"), high.alias("max_value"))


def boundary_order(pages: DataFrame) -> DataFrame:
    """boundary_order of page_statistics(): ascending, descending or unordered; pages of nulls alone do not count. Equal bounds are ascending."""
    b = pages.where("min_value IS NOT NULL").select("page", "min_value", "max_value")
    row = b.agg(F.sort_array(F.collect_list(F.struct("page", "min_value", "max_value"))).alias("p"))
    steps = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x, y: F.struct(((y["min_value"] >= x["min_value"]) & (y["max_value"] >= x["max_value"])).alias("up"), ((y["min_value"] <= x["min_value"]) & (y["max_value"] <= x["max_value"])).alias("down")))
    return row.select(F.when(F.forall(steps, lambda s: s["up"]), "ASCENDING").when(F.forall(steps, lambda s: s["down"]), "DESCENDING").otherwise("UNORDERED").alias("boundary_order"))


def _cut(c: Column, length: int) -> Column:
    """The longest prefix of whole characters with at most so many bytes of UTF-8, for texts with more."""
    raw = c.cast("binary")
    inner = lambda at: F.substring(raw, at, 1).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    keep = F.lit(max(0, length - 3))
    for back in range(min(2, length), -1, -1):  # a character ends where the next byte begins another
        keep = F.when(~inner(length - back + 1), F.lit(length - back)).otherwise(keep)
    return F.substr(raw, F.lit(1), keep).cast("string")


def truncate_min(c: Column, length: int = 64) -> Column:
    """A lower bound of up to so many bytes of UTF-8, in whole characters."""
    return F.when(F.octet_length(c) <= length, c).otherwise(_cut(c, length))


def truncate_max(c: Column, length: int = 64) -> Column:
    """An upper bound of up to so many bytes of UTF-8: the prefix with its last character that can grow grown by one, unless it would take
    more bytes; null if none can. Bounds that end in a plain ASCII character, the most, are made by built-in functions."""

    def grow(text: str | None) -> str | None:
        for k in range(len(text or "") - 1, -1, -1):
            code = ord(text[k]) + 1
            code = 0xE000 if 0xD800 <= code < 0xE000 else code
            if code <= 0x10FFFF and len(chr(code).encode()) == len(text[k].encode()):
                return text[:k] + chr(code)
        return None

    cut = _cut(c, length)
    last = F.right(cut, F.lit(1))
    simple = F.concat(F.left(cut, F.length(cut) - 1), F.chr(F.ascii(last) + 1))
    hard = F.when((F.octet_length(c) > length) & ((F.octet_length(last) != 1) | (last == "\x7f")), cut)
    return F.when(F.octet_length(c) <= length, c).when(hard.isNull(), simple).otherwise(F.pandas_udf(lambda s: s.map(grow), "string")(hard))


def truncate_bytes(raw: bytes | None, length: int, *, upper: bool) -> bytes | None:
    """truncate_min() and truncate_max() for binary bounds, which have no characters: the last byte that can grow is grown."""
    if raw is None or len(raw) <= length:
        return raw
    cut = raw[:length]
    if not upper:
        return cut
    kept = cut.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def merge_size_statistics(parts: DataFrame) -> DataFrame:
    """One row per path, kind and level from the size statistics of parts (path, level_kind, level, n): sums. A kind that some part of a path lacks is unset: it has no rows.

    parts has a column part that tells them apart."""
    here = parts.groupBy("path", "level_kind", "part").agg(F.lit(1).alias("there")).groupBy("path", "level_kind").agg(F.count("*").alias("k"))
    every = parts.groupBy("path").agg(F.countDistinct("part").alias("all_k"))
    whole = here.join(every, "path").where("k = all_k").select("path", "level_kind")
    return parts.join(whole, ["path", "level_kind"], "left_semi").groupBy("path", "level_kind", "level").agg(F.sum("n").alias("n"))


def size_statistics(df: DataFrame, path: str) -> DataFrame:
    """level_histograms() and, for strings and binaries, a row of kind unencoded_bytes with level null."""
    out = level_histograms(df, path)
    kind = df.schema[path].dataType if path in df.columns else None
    if isinstance(kind, (T.StringType, T.BinaryType)):
        out = out.unionAll(df.agg(F.coalesce(F.sum(F.octet_length(f"`{path}`").cast("long")), F.lit(0)).alias("n")).select(F.lit("unencoded_bytes").alias("level_kind"), F.lit(None).cast("int").alias("level"), "n"))
    return out
