"""Semi-structured values: parsing, typed access, construction, shredding and what brings shredded columns together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def allow_duplicate_keys(spark: SparkSession, on: bool = True) -> None:
    """Let parse() take objects that name a key twice: the last value wins. Without it they are an error."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", str(on).lower())


def parse(c: Column, *, lenient: bool = False) -> Column:
    """JSON text as a variant; lenient: null instead of an error. Keys that repeat are an error, see allow_duplicate_keys()."""
    return (F.try_parse_json if lenient else F.parse_json)(c)


def field(v: Column, path: str, kind: str = "variant", *, lenient: bool = True) -> Column:
    """The value at a path such as ``$.a.b`` or ``$[0].c`` as a type; null where there is none, and with lenient where it does not fit."""
    path = path if path.startswith("$") else f"$.{path}"
    return (F.try_variant_get if lenient else F.variant_get)(v, path, kind)


def element(v: Column, index: int, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$[{index}]", kind)


def type_name(v: Column) -> Column:
    """The type as schema_of_variant writes it: OBJECT<...>, ARRAY<...>, BIGINT, DECIMAL(p,s), STRING, BOOLEAN, DOUBLE, VOID."""
    return F.schema_of_variant(v)


def fields(v: Column) -> Column:
    """An object's members as a map of variants, sorted by key where written by parse(); null for others."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def size(v: Column) -> Column:
    """Members of an object or elements of an array; null for others."""
    return F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.size(fields(v)))


def build(c: Column) -> Column:
    """A struct, list or map as a variant object or array."""
    return F.to_variant_object(c)


def to_json(v: Column) -> Column:
    return F.to_json(v)


def explode_members(df: DataFrame, column: str) -> DataFrame:
    """A row per member or element: pos, key and value beside df's columns."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(f"`{column}`").outer()))


_EXACT = {T.BooleanType: "BOOLEAN", T.StringType: "STRING", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.LongType: "BIGINT", T.BinaryType: "BINARY", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP_NTZ"}


def kind_of(v: Column) -> Column:
    """The type of a value in one word: object, array, null, boolean, integer, decimal, double, float, string, date, timestamp, timestamp_ntz, binary."""
    told = F.schema_of_variant(v)
    plain = F.lower(F.regexp_extract(told, "^[A-Z_]+", 0))
    return F.when(plain == "bigint", "integer").when(plain == "void", "null").otherwise(plain)


def member(v: Column, index: int) -> Column:
    """The member of an object at a place in key order: a struct of key and value; null beyond the last."""
    entries = F.array_sort(F.map_keys(fields(v)))
    key = F.get(entries, F.lit(index))
    return F.when(key.isNotNull(), F.struct(key.alias("key"), F.try_element_at(fields(v), key).alias("value")))


def exactly(v: Column, kind: T.DataType) -> Column:
    """The value as a type if it is of that very type, else null. Integers fit any integer type that holds them."""
    got = F.try_variant_get(v, "$", kind.simpleString())
    told = F.schema_of_variant(v)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return F.when(told == "BIGINT", got)
    if isinstance(kind, T.DecimalType):
        return F.when(F.startswith(told, F.lit("DECIMAL(")) & F.endswith(told, F.lit(f",{kind.scale})")), got)
    if type(kind) not in _EXACT:
        raise TypeError(f"no shredding to {kind.simpleString()}")
    return F.when(told == _EXACT[type(kind)], got)


def _shredded(v: Column, kind: T.DataType) -> Column:
    """A struct of value (what does not fit, a variant) and typed_value; both null for a missing member."""
    if isinstance(kind, T.StructType):
        members, is_object = fields(v), F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
        parts = F.struct(*(_shredded(F.try_element_at(members, F.lit(f.name)), f.dataType).alias(f.name) for f in kind.fields))
        rest = F.map_filter(members, lambda k, _: ~k.isin([f.name for f in kind.fields]))
        left = F.when(is_object, F.when(F.size(rest) > 0, F.to_variant_object(rest))).otherwise(v)
        return F.struct(left.alias("value"), F.when(is_object, parts).alias("typed_value"))
    if isinstance(kind, T.ArrayType):
        is_array = F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: _shredded(F.coalesce(e, F.parse_json(F.lit("null"))), kind.elementType))
        return F.struct(F.when(~is_array, v).alias("value"), F.when(is_array, items).alias("typed_value"))
    typed = exactly(v, kind)
    return F.struct(F.when(typed.isNull(), v).alias("value"), typed.alias("typed_value"))


def _whole(s: Column, kind: T.DataType) -> Column:
    """The variant that _shredded() took apart; null for a missing member."""
    if isinstance(kind, T.StructType):
        parts = [F.struct(F.lit(f.name).alias("key"), _whole(s["typed_value"][f.name], f.dataType["typed_value"].dataType).alias("value")) for f in kind.fields]
        members = F.map_from_entries(F.filter(F.array(*parts), lambda e: e["value"].isNotNull()))
        rest = F.coalesce(fields(s["value"]), F.create_map().cast("map<string,variant>"))
        return F.when(s["typed_value"].isNull(), s["value"]).otherwise(F.to_variant_object(F.map_concat(members, rest)))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType["typed_value"].dataType
        return F.when(s["typed_value"].isNull(), s["value"]).otherwise(F.to_variant_object(F.transform(s["typed_value"], lambda e: _whole(e, inner))))
    return F.coalesce(s["typed_value"].cast("variant"), s["value"])


def shred(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """df with the variant column replaced by ``column`` as a struct: value (what is not shredded, a variant) and typed_value.

    typed_value has a struct (value, typed_value) per field of the schema, fields and elements of structs and lists alike: typed_value if the member has
    exactly that type, else value. Members outside the schema stay in the outer value; what is no object stays there whole.
    """
    v = F.col(f"`{column}`")
    return df.withColumn(column, F.when(v.isNotNull(), _shredded(v, schema)))


def unshred(df: DataFrame, column: str) -> DataFrame:
    """The variant column that shred() took apart, types and all. Missing members stay missing; a typed value wins over none."""
    s = F.col(f"`{column}`")
    return df.withColumn(column, F.when(s.isNotNull(), _whole(s, df.schema[column].dataType["typed_value"].dataType)))
