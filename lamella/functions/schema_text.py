"""The schema language of the file format: parsed to types, printed from types, and schemas merged.

    message order { required int64 id; optional binary name (STRING); optional group tags (LIST) { repeated group list { optional binary element (STRING); } } }
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


class SchemaError(ValueError):
    """Text or types that make no schema, or schemas that cannot be merged."""


PRIMITIVES = ("boolean", "int32", "int64", "int96", "float", "double", "binary", "fixed_len_byte_array")
REPETITIONS = ("required", "optional", "repeated")


@dataclass(frozen=True)
class Node:
    """A field: primitive if kind is one of PRIMITIVES, else a group with children. logical is the annotation, such as DECIMAL(9,2)."""

    name: str
    repetition: str = "required"
    kind: str = "group"
    length: int | None = None
    logical: str | None = None
    field_id: int | None = None
    children: tuple[Node, ...] = field(default_factory=tuple)

    @property
    def is_group(self) -> bool:
        return self.kind == "group"

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if c.name == name), None)


_TOKEN = re.compile(r"\s*(?:([{}();=,])|([^\s{}();=,]+))")


def parse(text: str) -> Node:
    """The message that a text describes; errors name the place."""
    tokens = [(m[1] or m[2], m.start()) for m in _TOKEN.finditer(text)]
    at = 0

    def peek() -> str:
        return tokens[at][0] if at < len(tokens) else ""

    def take(*wanted: str) -> str:
        nonlocal at
        got = peek()
        if wanted and got.lower() not in wanted:
            where = text.count("\n", 0, tokens[at][1]) + 1 if at < len(tokens) else text.count("\n") + 1
            raise SchemaError(f"line {where}: expected {' or '.join(wanted)}, found {got or 'the end'!r}")
        at += 1
        return got

    def annotation() -> str | None:
        if peek() != "(":
            return None
        take("(")
        out, depth = "", 1
        while depth:
            t = take()
            if not t:
                raise SchemaError("an annotation is not closed")
            depth += (t == "(") - (t == ")")
            out += t if depth else ""
        return out

    def ident() -> int | None:
        if peek() != "=":
            return None
        take("=")
        return int(take())

    def body() -> tuple[Node, ...]:
        take("{")
        out = []
        while peek() != "}":
            repetition = take(*REPETITIONS).lower()
            kind = take("group", *PRIMITIVES).lower()
            length = None
            if kind == "fixed_len_byte_array":
                take("(")
                length = int(take())
                take(")")
            name, logical, number = take(), annotation(), ident()
            children = ()
            if kind == "group":
                children = body()
            else:
                take(";")
            out.append(Node(name, repetition, kind, length, logical, number, children))
        take("}")
        return tuple(out)

    take("message")
    root = Node(take(), kind="group", children=body())
    if at != len(tokens):
        raise SchemaError(f"text after the end: {peek()!r}")
    return root


def render(node: Node) -> str:
    """The text of a message, two spaces deeper per group."""

    def lines(n: Node, pad: str) -> list[str]:
        kind = f"fixed_len_byte_array({n.length})" if n.kind == "fixed_len_byte_array" else n.kind
        head = f"{pad}{n.repetition} {kind} {n.name}" + (f" ({n.logical})" if n.logical else "") + (f" = {n.field_id}" if n.field_id is not None else "")
        return [head + ";"] if not n.is_group else [head + " {", *(x for c in n.children for x in lines(c, pad + "  ")), pad + "}"]

    return "\n".join([f"message {node.name} {{", *(x for c in node.children for x in lines(c, "  ")), "}"]) + "\n"


_INT = re.compile(r"^(U?)INT_?\(?(\d+)(?:,\s*(true|false))?\)?$", re.I)
_DECIMAL = re.compile(r"^DECIMAL\((\d+)(?:,\s*(\d+))?\)$", re.I)


def _primitive_type(n: Node) -> T.DataType:
    logical = (n.logical or "").upper().replace(" ", "")
    if m := _DECIMAL.match(logical):
        precision, scale = int(m[1]), int(m[2] or 0)
        if precision > 38:
            raise SchemaError(f"{n.name}: decimals beyond 38 digits have no type here")
        return T.DecimalType(precision, scale)
    if m := _INT.match(logical):
        bits, unsigned = int(m[2]), m[1].upper() == "U" or m[3] == "FALSE"
        signed = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}[bits]
        return {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}[bits] if unsigned else signed
    if n.kind == "binary":
        return T.StringType() if logical.startswith(("STRING", "UTF8", "ENUM", "JSON")) else T.BinaryType()
    if n.kind == "int32":
        return T.DateType() if logical == "DATE" else T.IntegerType()
    if n.kind == "int64":
        if logical.startswith("TIMESTAMP"):
            if "NANOS" in logical:
                return T.LongType()
            return T.TimestampNTZType() if "FALSE" in logical else T.TimestampType()
        return T.LongType()
    if n.kind == "fixed_len_byte_array":
        return T.FloatType() if logical == "FLOAT16" else T.BinaryType()
    return {"boolean": T.BooleanType(), "float": T.FloatType(), "double": T.DoubleType(), "int96": T.TimestampType()}[n.kind]


def _type(n: Node) -> T.DataType:
    if not n.is_group:
        return _primitive_type(n)
    logical = (n.logical or "").upper()
    if logical == "LIST" and len(n.children) == 1 and n.children[0].repetition == "repeated":
        r = n.children[0]
        wrapped = r.is_group and len(r.children) == 1 and r.name not in ("array", f"{n.name}_tuple")
        e = r.children[0] if wrapped else r
        return T.ArrayType(_type(replace(e, repetition="required")) if not wrapped else _type(e), wrapped and e.repetition == "optional")
    if logical in ("MAP", "MAP_KEY_VALUE") and len(n.children) == 1 and len(n.children[0].children) in (1, 2):
        key, *value = n.children[0].children
        return T.MapType(_type(key), _type(value[0]) if value else T.NullType(), not value or value[0].repetition == "optional")
    return T.StructType([to_field(c) for c in n.children])


def to_field(n: Node) -> T.StructField:
    kind = _type(n)
    if n.repetition == "repeated":
        return T.StructField(n.name, T.ArrayType(kind, False), False)
    meta = {"field_id": n.field_id} if n.field_id is not None else {}
    return T.StructField(n.name, kind, n.repetition == "optional", meta)


def to_struct(message: Node) -> T.StructType:
    """The Spark schema that reads files of this message."""
    return T.StructType([to_field(c) for c in message.children])


def from_struct(schema: T.StructType, name: str = "spark_schema") -> Node:
    """The message that a Spark schema is written as."""

    def node(n: str, kind: T.DataType, nullable: bool) -> Node:
        rep = "optional" if nullable else "required"
        if isinstance(kind, T.StructType):
            return Node(n, rep, children=tuple(node(f.name, f.dataType, f.nullable) for f in kind.fields))
        if isinstance(kind, T.ArrayType):
            return Node(n, rep, logical="LIST", children=(Node("list", "repeated", children=(node("element", kind.elementType, kind.containsNull),)),))
        if isinstance(kind, T.MapType):
            return Node(n, rep, logical="MAP", children=(Node("key_value", "repeated", children=(node("key", kind.keyType, False), node("value", kind.valueType, kind.valueContainsNull))),))
        if isinstance(kind, T.DecimalType):
            if kind.precision <= 9:
                p = ("int32", None)
            elif kind.precision <= 18:
                p = ("int64", None)
            else:
                p = ("fixed_len_byte_array", next(k for k in range(1, 17) if 2 ** (8 * k - 1) - 1 >= 10**kind.precision - 1))
            return Node(n, rep, p[0], p[1], f"DECIMAL({kind.precision},{kind.scale})")
        plain = {
            T.BooleanType: ("boolean", None), T.ByteType: ("int32", "INTEGER(8,true)"), T.ShortType: ("int32", "INTEGER(16,true)"), T.IntegerType: ("int32", None), T.LongType: ("int64", None), T.FloatType: ("float", None), T.DoubleType: ("double", None),
            T.StringType: ("binary", "STRING"), T.BinaryType: ("binary", None), T.DateType: ("int32", "DATE"), T.TimestampType: ("int64", "TIMESTAMP(MICROS,true)"), T.TimestampNTZType: ("int64", "TIMESTAMP(MICROS,false)"),
        }.get(type(kind))
        if plain is None:
            raise SchemaError(f"{n}: {kind.simpleString()} has no message type")
        return Node(n, rep, plain[0], None, plain[1])

    return Node(name, children=tuple(node(f.name, f.dataType, f.nullable) for f in schema.fields))


def merge(a: Node, b: Node, *, strict: bool = True) -> Node:
    """Fields of both by name, a's first. Equal names need equal kinds and annotations; primitives take the looser repetition, groups b's; below groups merging is always strict."""

    def one(x: Node, y: Node, strict: bool) -> Node:
        if x.logical != y.logical:
            raise SchemaError(f"{x.name}: annotation {x.logical} meets {y.logical}")
        if x.is_group != y.is_group:
            raise SchemaError(f"{x.name}: a group meets a primitive")
        if not x.is_group:
            if strict and (x.kind, x.length) != (y.kind, y.length):
                raise SchemaError(f"{x.name}: {x.kind} meets {y.kind}")
            return replace(y, repetition=max(x.repetition, y.repetition, key=REPETITIONS.index))
        return replace(y, children=both(x.children, y.children, True))

    def both(x: tuple[Node, ...], y: tuple[Node, ...], strict: bool) -> tuple[Node, ...]:
        other = {c.name: c for c in y}
        return tuple(one(c, other[c.name], strict) if c.name in other else c for c in x) + tuple(c for c in y if c.name not in {d.name for d in x})

    return replace(a, children=both(a.children, b.children, strict))


class Builder:
    """A message step by step: ``Builder().required("id", "int64").optional("name", "binary", "STRING").message("m")``."""

    def __init__(self):
        self._fields: list[Node] = []

    def _add(self, repetition: str, name: str, kind: str | Builder, logical: str | None, length: int | None, field_id: int | None) -> Builder:
        group = isinstance(kind, Builder)
        if not group and kind not in PRIMITIVES:
            raise SchemaError(f"unknown primitive {kind}")
        self._fields.append(Node(name, repetition, "group" if group else kind, length, logical, field_id, tuple(kind._fields) if group else ()))
        return self

    def required(self, name, kind, logical=None, *, length=None, field_id=None) -> Builder:
        return self._add("required", name, kind, logical, length, field_id)

    def optional(self, name, kind, logical=None, *, length=None, field_id=None) -> Builder:
        return self._add("optional", name, kind, logical, length, field_id)

    def repeated(self, name, kind, logical=None, *, length=None, field_id=None) -> Builder:
        return self._add("repeated", name, kind, logical, length, field_id)

    def list_of(self, name: str, kind: str | Builder, logical: str | None = None) -> Builder:
        element = Builder().optional("element", kind, logical)
        return self._add("optional", name, Builder()._add("repeated", "list", element, None, None, None), "LIST", None, None)

    def map_of(self, name: str, key: str, value: str | Builder, key_logical: str | None = None, value_logical: str | None = None) -> Builder:
        pair = Builder().required("key", key, key_logical).optional("value", value, value_logical)
        return self._add("optional", name, Builder()._add("repeated", "key_value", pair, None, None, None), "MAP", None, None)

    def message(self, name: str) -> Node:
        return Node(name, children=tuple(self._fields))
