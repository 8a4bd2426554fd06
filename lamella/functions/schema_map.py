"""Schemas of other object models to and from messages: Arrow, Avro, Thrift and Protobuf descriptions."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

from .schema_text import Node, SchemaError, to_struct


def to_arrow(message: Node) -> pa.Schema:
    return pa.schema([_arrow_field(c) for c in message.children])


def _arrow_field(n: Node) -> pa.Field:
    kind = _arrow_type(n)
    if n.repetition == "repeated":
        return pa.field(n.name, pa.list_(pa.field("element", kind, False)), False)
    return pa.field(n.name, kind, n.repetition == "optional")


def _arrow_type(n: Node) -> pa.DataType:
    logical = (n.logical or "").upper().replace(" ", "")
    if n.is_group:
        if logical == "LIST":
            r = n.children[0]
            return pa.list_(_arrow_field(r.children[0] if r.is_group else r).with_name("element"))
        if logical == "MAP":
            key, value = n.children[0].children
            return pa.map_(_arrow_type(key), _arrow_field(value))
        return pa.struct([_arrow_field(c) for c in n.children])
    if logical.startswith("DECIMAL"):
        precision, _, scale = logical[8:-1].partition(",")
        return pa.decimal128(int(precision), int(scale or 0))
    if logical.startswith(("INTEGER(", "INT(")):
        bits, _, signed = logical.partition("(")[2][:-1].partition(",")
        return getattr(pa, f"{'int' if signed != 'FALSE' else 'uint'}{bits}")()
    if logical.startswith(("INT_", "UINT_")):
        return getattr(pa, logical.replace("_", "").lower())()
    if logical.startswith("TIMESTAMP"):
        unit = {"MILLIS": "ms", "MICROS": "us", "NANOS": "ns"}[next(u for u in ("MILLIS", "MICROS", "NANOS") if u in logical)]
        return pa.timestamp(unit, None if "FALSE" in logical else "UTC")
    if logical.startswith("TIME"):
        unit = next(u for u in ("MILLIS", "MICROS", "NANOS") if u in logical)
        return pa.time32("ms") if unit == "MILLIS" else pa.time64("us" if unit == "MICROS" else "ns")
    if logical == "DATE":
        return pa.date32()
    if logical in ("STRING", "UTF8", "ENUM", "JSON"):
        return pa.string()
    if n.kind == "fixed_len_byte_array":
        return pa.float16() if logical == "FLOAT16" else pa.binary(n.length)
    return {"boolean": pa.bool_(), "int32": pa.int32(), "int64": pa.int64(), "int96": pa.timestamp("ns"), "float": pa.float32(), "double": pa.float64(), "binary": pa.binary()}[n.kind]


def from_arrow(schema: pa.Schema, name: str = "root") -> Node:
    """Decimals of up to 9 and 18 digits become 32- and 64-bit integers, wider ones binary; half floats floats; unions groups of optional members."""
    return Node(name, children=tuple(_of_arrow(f.name, f.type, f.nullable) for f in schema))


def _of_arrow(name: str, t: pa.DataType, nullable: bool) -> Node:
    rep = "optional" if nullable else "required"
    is_ = pa.types
    if is_.is_struct(t) or is_.is_union(t):
        return Node(name, rep, children=tuple(_of_arrow(f.name, f.type, True if is_.is_union(t) else f.nullable) for f in t))
    if is_.is_list(t) or is_.is_large_list(t) or is_.is_fixed_size_list(t):
        return Node(name, rep, logical="LIST", children=(Node("list", "repeated", children=(_of_arrow("element", t.value_type, t.value_field.nullable),)),))
    if is_.is_map(t):
        return Node(name, rep, logical="MAP", children=(Node("key_value", "repeated", children=(_of_arrow("key", t.key_type, False), _of_arrow("value", t.item_type, t.item_field.nullable))),))
    if is_.is_decimal(t):
        kind = "int32" if t.precision <= 9 else "int64" if t.precision <= 18 else "binary"
        return Node(name, rep, kind, None, f"DECIMAL({t.precision},{t.scale})")
    if is_.is_integer(t):
        signed = not str(t).startswith("u")
        return Node(name, rep, "int64" if t.bit_width == 64 else "int32", None, f"INTEGER({t.bit_width},{str(signed).lower()})")
    if is_.is_timestamp(t):
        unit = {"ms": "MILLIS", "us": "MICROS", "ns": "NANOS"}.get(t.unit)
        if unit is None:
            raise SchemaError(f"{name}: timestamps of seconds have no message type")
        return Node(name, rep, "int64", None, f"TIMESTAMP({unit},{str(t.tz is not None).lower()})")
    if is_.is_time(t):
        unit = {"ms": "MILLIS", "us": "MICROS", "ns": "NANOS"}[t.unit]
        return Node(name, rep, "int32" if unit == "MILLIS" else "int64", None, f"TIME({unit},false)")
    if is_.is_fixed_size_binary(t):
        return Node(name, rep, "fixed_len_byte_array", t.byte_width)
    plain = [(is_.is_boolean, "boolean", None), (is_.is_float16, "float", None), (is_.is_float32, "float", None), (is_.is_float64, "double", None), (is_.is_date, "int32", "DATE"), (is_.is_string, "binary", "STRING"), (is_.is_large_string, "binary", "STRING"), (is_.is_binary, "binary", None), (is_.is_large_binary, "binary", None)]
    for test, kind, logical in plain:
        if test(t):
            return Node(name, rep, kind, None, logical)
    raise SchemaError(f"{name}: {t} has no message type")


_AVRO = {"boolean": ("boolean", None), "int": ("int32", None), "long": ("int64", None), "float": ("float", None), "double": ("double", None), "bytes": ("binary", None), "string": ("binary", "STRING")}
_AVRO_LOGICAL = {"date": "DATE", "time-millis": "TIME(MILLIS,true)", "time-micros": "TIME(MICROS,true)", "timestamp-millis": "TIMESTAMP(MILLIS,true)", "timestamp-micros": "TIMESTAMP(MICROS,true)", "local-timestamp-millis": "TIMESTAMP(MILLIS,false)", "local-timestamp-micros": "TIMESTAMP(MICROS,false)", "uuid": "UUID"}


def from_avro(schema: str | dict) -> Node:
    """A record schema. A union with null is optional, other unions are groups of optional members member0, member1, ...; fields of type null are left out."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    if schema.get("type") != "record":
        raise SchemaError("the outermost schema has to be a record")
    named: dict[str, Any] = {}
    return Node(schema["name"], children=_avro_fields(schema, named))


def _avro_fields(record: dict, named: dict) -> tuple[Node, ...]:
    named[record["name"]] = record
    return tuple(_avro(f["name"], f["type"], "required", named) for f in record["fields"] if f["type"] != "null")


def _avro(name: str, t: Any, rep: str, named: dict) -> Node:
    if isinstance(t, list):
        rest = [x for x in t if x != "null"]
        rep = "optional" if len(rest) < len(t) else rep
        if len(rest) == 1:
            return _avro(name, rest[0], rep, named)
        return Node(name, rep, children=tuple(_avro(f"member{k}", x, "optional", named) for k, x in enumerate(rest)))
    if isinstance(t, str):
        if t in _AVRO:
            return Node(name, rep, _AVRO[t][0], None, _AVRO[t][1])
        if t not in named:
            raise SchemaError(f"{name}: unknown type {t}")
        t = named[t]
    match t["type"]:
        case "record":
            return Node(name, rep, children=_avro_fields(t, named))
        case "enum":
            named[t["name"]] = t
            return Node(name, rep, "binary", None, "ENUM")
        case "fixed":
            named[t["name"]] = t
            logical = f"DECIMAL({t['precision']},{t.get('scale', 0)})" if t.get("logicalType") == "decimal" else "INTERVAL" if t.get("logicalType") == "duration" else None
            return Node(name, rep, "fixed_len_byte_array", t["size"], logical)
        case "array":
            return Node(name, rep, logical="LIST", children=(Node("list", "repeated", children=(_avro("element", t["items"], "required", named),)),))
        case "map":
            return Node(name, rep, logical="MAP", children=(Node("key_value", "repeated", children=(Node("key", "required", "binary", None, "STRING"), _avro("value", t["values"], "required", named))),))
        case inner if isinstance(inner, (dict, list)):
            return _avro(name, inner, rep, named)
        case plain:
            kind, logical = _AVRO[plain]
            if t.get("logicalType") == "decimal":
                logical = f"DECIMAL({t['precision']},{t.get('scale', 0)})"
            return Node(name, rep, kind, None, _AVRO_LOGICAL.get(t.get("logicalType"), logical))


def to_avro(message: Node) -> dict:
    """The record schema of a message; optional fields are unions with null and default to it."""
    taken: set[str] = set()

    def of(n: Node) -> Any:
        logical = (n.logical or "").upper().replace(" ", "")
        if n.is_group:
            if logical == "LIST":
                r = n.children[0]
                return {"type": "array", "items": wrap(r.children[0] if r.is_group and len(r.children) == 1 else r)}
            if logical == "MAP":
                return {"type": "map", "values": wrap(n.children[0].children[1])}
            name = n.name
            while name in taken:
                name += "_"
            taken.add(name)
            return {"type": "record", "name": name, "fields": [entry(c) for c in n.children]}
        base: Any = {"boolean": "boolean", "int32": "int", "int64": "long", "float": "float", "double": "double", "binary": "bytes"}.get(n.kind)
        if n.kind == "int96":
            raise SchemaError(f"{n.name}: int96 has no counterpart")
        if n.kind == "fixed_len_byte_array":
            base = {"type": "fixed", "name": n.name, "size": n.length}
        if logical in ("STRING", "UTF8", "ENUM", "JSON"):
            return "string"
        if logical.startswith("DECIMAL"):
            p, _, s = logical[8:-1].partition(",")
            return (base if isinstance(base, dict) else {"type": base}) | {"logicalType": "decimal", "precision": int(p), "scale": int(s or 0)}
        back = {v: k for k, v in _AVRO_LOGICAL.items()}.get(n.logical or "")
        return {"type": base, "logicalType": back} if back else base

    def wrap(n: Node) -> Any:
        return ["null", of(n)] if n.repetition == "optional" else of(n)

    def entry(n: Node) -> dict:
        if n.repetition == "repeated":
            return {"name": n.name, "type": {"type": "array", "items": of(n)}}
        return {"name": n.name, "type": wrap(n)} | ({"default": None} if n.repetition == "optional" else {})

    return {"type": "record", "name": message.name, "fields": [entry(c) for c in message.children]}


def merge_avro(a: dict, b: dict) -> dict:
    """Two record schemas as one: shared fields promoted int to long and float to double, never integer to floating; fields of one side alone become optional."""
    wide = {("int", "long"): "long", ("float", "double"): "double"}

    def plain(t: Any) -> tuple[Any, bool]:
        rest = [x for x in t if x != "null"] if isinstance(t, list) else [t]
        return (rest[0] if len(rest) == 1 else rest), isinstance(t, list) and "null" in t

    def one(x: Any, y: Any) -> Any:
        (p, n1), (q, n2) = plain(x), plain(y)
        if p == q:
            t = p
        elif isinstance(p, str) and isinstance(q, str):
            t = wide.get((p, q)) or wide.get((q, p))
            if t is None:
                raise SchemaError(f"cannot merge {p} and {q}")
        elif isinstance(p, dict) and isinstance(q, dict) and p.get("type") == q.get("type") == "record":
            t = merge_avro(p, q)
        elif isinstance(p, dict) and isinstance(q, dict) and p.get("type") == q.get("type") == "array":
            t = {"type": "array", "items": one(p["items"], q["items"])}
        else:
            raise SchemaError(f"cannot merge {p} and {q}")
        return ["null", t] if n1 or n2 else t

    mine, other = {f["name"]: f for f in a["fields"]}, {f["name"]: f for f in b["fields"]}
    out = []
    for name in dict.fromkeys([*mine, *other]):
        if name in mine and name in other:
            t = one(mine[name]["type"], other[name]["type"])
        else:
            t, nullable = plain((mine.get(name) or other[name])["type"])
            t = ["null", t]
        out.append({"name": name, "type": t} | ({"default": None} if isinstance(t, list) and t[0] == "null" else {}))
    return {"type": "record", "name": a["name"], "fields": out}


_THRIFT = {"bool": ("boolean", None), "byte": ("int32", "INTEGER(8,true)"), "i16": ("int32", "INTEGER(16,true)"), "i32": ("int32", None), "i64": ("int64", None), "double": ("double", None), "string": ("binary", "STRING"), "binary": ("binary", None), "enum": ("binary", "ENUM")}


def from_thrift(struct: dict) -> Node:
    """A struct description: {"name", "fields": [{"id", "name", "type", "requirement"}]}; type is a name, {"list"|"set": t}, {"map": [k, v]} or a struct; requirement defaults to optional."""

    def of(name: str, t: Any, rep: str, number: int | None = None) -> Node:
        if isinstance(t, str):
            kind, logical = _THRIFT[t]
            return Node(name, rep, kind, None, logical, number)
        if "list" in t or "set" in t:
            inner = of(f"{name}_tuple", t.get("list", t.get("set")), "repeated")
            return Node(name, rep, logical="LIST", field_id=number, children=(inner,))
        if "map" in t:
            return Node(name, rep, logical="MAP", field_id=number, children=(Node("key_value", "repeated", children=(of("key", t["map"][0], "required"), of("value", t["map"][1], "optional"))),))
        return Node(name, rep, field_id=number, children=fields(t))

    def fields(s: dict) -> tuple[Node, ...]:
        return tuple(of(f["name"], f["type"], "required" if f.get("requirement") == "required" else "optional", f.get("id")) for f in s["fields"])

    return Node(struct["name"], children=fields(struct))


def check_thrift_evolution(old: dict, new: dict) -> list[str]:
    """What would break readers of old data: changed types, optional fields made required, new required fields, enum values gone. Empty: compatible."""
    out: list[str] = []

    def compare(a: Any, b: Any, path: str) -> None:
        if isinstance(a, dict) and isinstance(b, dict):
            if "fields" in a and "fields" in b:
                before, after = {f["id"]: f for f in a["fields"]}, {f["id"]: f for f in b["fields"]}
                for k, f in before.items():
                    if k not in after:
                        out.append(f"{path}: field {f['name']} is gone")
                        continue
                    g = after[k]
                    if g["name"] != f["name"]:
                        out.append(f"{path}: field {k} was {f['name']}, is {g['name']}")
                    if f.get("requirement") != "required" and g.get("requirement") == "required":
                        out.append(f"{path}: {f['name']} became required")
                    compare(f["type"], g["type"], f"{path}.{f['name']}")
                out.extend(f"{path}: new field {g['name']} is required" for k, g in after.items() if k not in before and g.get("requirement") == "required")
                return
            for k in ("list", "set"):
                if k in a and k in b:
                    return compare(a[k], b[k], f"{path}[]")
            if "map" in a and "map" in b:
                compare(a["map"][0], b["map"][0], f"{path}.key")
                return compare(a["map"][1], b["map"][1], f"{path}.value")
        if a != b:
            out.append(f"{path}: type {a} became {b}")

    compare(old, new, new["name"])
    return out


_PROTO = {"double": ("double", None), "float": ("float", None), "int32": ("int32", None), "int64": ("int64", None), "uint32": ("int32", None), "uint64": ("int64", None), "sint32": ("int32", None), "sint64": ("int64", None), "fixed32": ("int32", None), "fixed64": ("int64", None), "sfixed32": ("int32", None), "sfixed64": ("int64", None), "bool": ("boolean", None), "string": ("binary", "STRING"), "bytes": ("binary", None), "enum": ("binary", "ENUM")}
_WRAPPERS = {"DoubleValue": "double", "FloatValue": "float", "Int32Value": "int32", "Int64Value": "int64", "UInt32Value": "uint32", "UInt64Value": "uint64", "BoolValue": "bool", "StringValue": "string", "BytesValue": "bytes"}


def from_protobuf(message: dict, *, unwrap: bool = True, max_recursion: int = 5) -> Node:
    """A message description: {"name", "fields": [{"number", "name", "type", "label"}]}; type is a name, a message, {"ref": name} to one around, or {"map": [k, v]}.

    Wrapper types become their values; a message within itself is followed max_recursion times, what is deeper is bytes.
    """

    def of(f: dict, around: tuple[dict, ...]) -> Node:
        t, label = f["type"], f.get("label", "optional")
        if isinstance(t, str):
            t = _WRAPPERS.get(t, t) if unwrap else t
            kind, logical = _PROTO[t]
            n = Node(f["name"], label, kind, None, logical, f.get("number"))
        elif "map" in t:
            pair = (of({"name": "key", "type": t["map"][0], "label": "required"}, around), of({"name": "value", "type": t["map"][1]}, around))
            return Node(f["name"], "required", logical="MAP", field_id=f.get("number"), children=(Node("key_value", "repeated", children=pair),))
        else:
            inner = next(m for m in reversed(around) if m["name"] == t["ref"]) if "ref" in t else t
            if sum(m["name"] == inner["name"] for m in around) > max_recursion:
                n = Node(f["name"], label, "binary", None, None, f.get("number"))
            else:
                n = Node(f["name"], label, field_id=f.get("number"), children=tuple(of(x, (*around, inner)) for x in inner["fields"]))
        if label != "repeated":
            return n
        element = Node("element", "required", n.kind, n.length, n.logical, None, n.children)
        return Node(f["name"], "required", logical="LIST", field_id=f.get("number"), children=(Node("list", "repeated", children=(element,)),))

    return Node(message["name"], children=tuple(of(f, (message,)) for f in message["fields"]))


def spark_schema(message: Node) -> T.StructType:
    return to_struct(message)
