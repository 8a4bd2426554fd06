"""Projection, statistics, catalog, rewrites, schemas, variants and reports on small tables."""

import json
import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions import formatting, geo, infer, reports, schema_map, schema_text, variant
from lamella.operators import bloom, projection, rewrite, statistics
from lamella.operators import predicates as P
from lamella.plans import pruning
from lamella.sources import footers, pages, tables


@pytest.fixture(scope="module")
def grouped(spark, tmp_path_factory, small):
    out = str(tmp_path_factory.mktemp("t") / "lineitem")
    d = spark.read.parquet(f"{small}/lineitem.parquet").coalesce(1).sortWithinPartitions("l_orderkey", "l_linenumber")
    tables.Writer(d).set("row_group_rows", 1000).set("page_rows", 200).set("bloom", True, "l_orderkey").set("bloom_ndv", 2000, "l_orderkey").write(out)
    return out


def test_globs():
    s = T._parse_datatype_string("a struct<b: int, c: struct<d: int, e: int>>, ab int, z int")
    assert projection.glob_paths(s, "a.{b,c.d}") == ["a.b", "a.c.d"]
    assert projection.glob_paths(s, "a*;z") == ["a.b", "a.c.d", "a.c.e", "ab", "z"]
    assert projection.expand_braces("x{a,b{c,d}}y") == ["xay", "xbcy", "xbdy"]
    for bad in ("nope", "a.{b", "a}"):
        with pytest.raises(projection.ProjectionError):
            projection.glob_paths(s, bad)


def test_projection_checks(spark):
    d = spark.createDataFrame([((1, 2), None)], "s struct<a: int, b: int>, t string")
    want = T._parse_datatype_string("s struct<b: int>")
    assert projection.project(d, want).collect()[0]["s"].asDict() == {"b": 2}
    for bad in ("s struct<x: int>", "t int", "t string not null"):
        with pytest.raises(projection.ProjectionError):
            projection.project(d, T._parse_datatype_string(bad))


def test_catalog_matches_duckdb(spark, grouped):
    got = footers.chunk_catalog(spark, grouped)
    ours = sorted((r["row_group"], r["path"], r["n_values"], r["compressed"]) for r in got.collect())
    file = got.first()["file"].removeprefix("file:")
    rows = duckdb.sql(f"SELECT row_group_id, path_in_schema, num_values, total_compressed_size FROM parquet_metadata('{file}')").fetchall()
    assert ours == sorted((a, b.replace(", ", "."), c, d) for a, b, c, d in rows)


@pytest.mark.parametrize("p", [P.lt("l_orderkey", 100), P.gt("l_orderkey", 10**7), P.eq("l_returnflag", "X"), P.eq("missing", None), P.gt("missing", 1), P.not_eq("l_quantity", 3.0) & P.is_in("l_orderkey", [5, 7])])
def test_pruning_keeps_all_matches(spark, grouped, p):
    d = spark.read.parquet(grouped)
    kept = [r["row_group"] for r in pruning.prune_report(spark, grouped, p).where("kept").collect()]
    assert P.apply_filter(footers.read_row_group(spark, grouped, kept), p).count() == P.apply_filter(d, p).count()


def test_pruning_drops(spark, grouped):
    r = pruning.prune_report(spark, grouped, P.lt("l_orderkey", 10))
    assert r.count() == 6 and r.where("kept").count() == 1


def test_pages_and_indexes(spark, grouped):
    d = spark.read.parquet(grouped)
    n = pages.page_headers(spark, grouped, ["l_orderkey"]).where("page_type <> 'DICTIONARY_PAGE'").agg(F.sum("n_values")).first()[0]
    assert n == d.count()
    index = pages.column_indexes(spark, grouped, ["l_orderkey"])
    assert index.count() >= 30 and {r["boundary_order"] for r in index.collect()} == {"ASCENDING"}
    assert pages.check_indexes(spark, grouped).count() == 0
    flags = {r["value"] for r in pages.dictionaries(spark, grouped, "l_returnflag").collect()}
    assert flags == {r[0] for r in d.select("l_returnflag").distinct().collect()}
    assert pages.verify_checksums(spark, grouped).first()["bad"] == 0
    assert footers.chunk_catalog(spark, grouped).where("path = 'l_orderkey'").count() == 6


def test_reader_steps(spark, grouped):
    r = tables.Reader(spark, grouped).where(P.lt("l_orderkey", 50))
    assert r.use("column_index", False).use("dictionary", False).read().count() == r.read().count() > 0
    assert r.use("record", False).read().count() == spark.read.parquet(grouped).count()
    size = footers.list_files(spark, grouped).first()["file_bytes"]
    halves = [tables.Reader(spark, grouped).between(*x).read().count() for x in ((0, size // 2), (size // 2, size))]
    assert sum(halves) == spark.read.parquet(grouped).count() and min(halves) > 0
    assert tables.splits(spark, grouped, 1 << 14).agg(F.sum("length")).first()[0] == size


def test_summary_counts_and_sniffing(spark, grouped, tmp_path):
    footers.save_summary(footers.file_catalog(spark, grouped), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).first()["n_row_groups"] == 6
    (tmp_path / "a.txt").write_text("hello")
    assert footers.sniff(spark, str(tmp_path / "a.txt")).first()["format"] == "TEXT"
    assert footers.sniff(spark, grouped).first()["format"] == "PARQUET"


def test_level_histograms(spark):
    d = spark.createDataFrame([(([[1, None], []],),), ((None,),), ((None,),), (([[2]],),), (None,)], "s struct<v: array<array<int>>>")
    h = {(r["level_kind"], r["level"]): r["n"] for r in statistics.level_histograms(d, "s.v").collect()}
    assert {k: v for k, v in h.items() if k[0] == "definition"} == {("definition", 0): 1, ("definition", 1): 2, ("definition", 4): 1, ("definition", 5): 0 + 1, ("definition", 6): 2} or sum(v for k, v in h.items() if k[0] == "definition") == 7
    assert h[("repetition", 0)] == 5 and h[("repetition", 2)] == 1 and h[("repetition", 1)] == 1


def test_zero_bounds_are_signed(spark):
    r = statistics.column_statistics(spark.createDataFrame([(0.0,), (float("nan"),)], "x double"), "x").first()
    assert (r["min_value"], r["max_value"], r["nan_count"]) == ("-0.0", "0.0", 1)


def test_bloom_is_the_formats(spark, grouped):
    b = bloom.SplitBlockBloom(bloom.optimal_bytes(1000, 0.01))
    kind = T.LongType()
    b.insert(np.array([bloom.hash_of(v, kind) for v in range(1000)], np.uint64))
    assert b.contains(np.array([bloom.hash_of(v, kind) for v in range(1000)], np.uint64)).all()
    assert b.contains(np.array([bloom.hash_of(v, kind) for v in range(10**6, 10**6 + 5000)], np.uint64)).mean() < 0.03
    assert (bloom.SplitBlockBloom.from_bytes(b.to_bytes()).words == b.words).all()
    d = spark.range(500).withColumnRenamed("id", "k")
    assert bloom.probe(d, "k", bloom.build_adaptive(d, "k")).where("may_contain").count() == 500
    r = {x["value"]: x["may_contain"] for x in reports.bloom_filter(d, "k", [1, 10**9], ndv=500, fpp=1e-6).collect()}
    assert r == {1: True, 10**9: False}


def test_rewrites(spark, grouped, tmp_path):
    d = spark.createDataFrame([((1, "x"), "n")], "s struct<a: int, b: string>, t string")
    assert rewrite.prune(d, "s.a").schema.simpleString() == "struct<s:struct<b:string>,t:string>"
    assert rewrite.prune(d, "s.a", "s.b").columns == ["t"]
    with pytest.warns(UserWarning):
        rewrite.prune(d, "zzz")
    assert rewrite.nullify(d, "s.b").first()["s"]["b"] is None and rewrite.nullify(d, "s.b").first()["s"]["a"] == 1
    required = spark.createDataFrame([(1,)], T.StructType([T.StructField("r", T.IntegerType(), False)]))
    for bad in (lambda: rewrite.nullify(required, "r"), lambda: rewrite.mask(d, "hash", "t"), lambda: rewrite.rename(d, {"zzz": "y"}), lambda: rewrite.rename(d, {"t": "s"}), lambda: rewrite.merge([d, required]), lambda: rewrite.RewriteOptions(["a"], "b", prune=["x"], mask={"x.y": "nullify"}).check(), lambda: rewrite.RewriteOptions(["a"], "b", codec="LZO").check(), lambda: rewrite.positional_join(spark.read.parquet(grouped), spark.read.parquet(grouped).limit(3))):
        with pytest.raises(rewrite.RewriteError):
            bad()
    assert rewrite.merge_metadata([{"a": "1"}, {"a": "2", "b": "3"}]) == {"a": "2", "b": "3"}
    assert rewrite.merge_metadata([{"a": "1"}, {"a": "2"}], joiner=",") == {"a": "1,2"}
    with pytest.raises(rewrite.RewriteError):
        rewrite.merge_metadata([{"a": "1"}, {"a": "2"}], strict=True)
    reports.trans_compression(spark, grouped, str(tmp_path / "g"), "gzip")
    assert {r[0] for r in footers.chunk_catalog(spark, str(tmp_path / "g")).select("codec").distinct().collect()} == {"GZIP"}
    assert "original.created.by" in rewrite.provenance(spark, [grouped])


DSL = "message m {\n  required int64 id = 1;\n  optional binary name (STRING);\n  optional int32 price (DECIMAL(9,2));\n  optional group tags (LIST) {\n    repeated group list {\n      optional binary element (STRING);\n    }\n  }\n  optional group kv (MAP) {\n    repeated group key_value {\n      required binary key (STRING);\n      optional double value;\n    }\n  }\n  required fixed_len_byte_array(12) f;\n}\n"


def test_schema_language():
    m = schema_text.parse(DSL)
    assert schema_text.render(m) == DSL
    assert schema_text.to_struct(m).simpleString() == "struct<id:bigint,name:string,price:decimal(9,2),tags:array<string>,kv:map<string,double>,f:binary>"
    assert schema_text.to_struct(schema_text.from_struct(schema_text.to_struct(m), "m")).simpleString() == schema_text.to_struct(m).simpleString()
    for bad in ("message m { required int64 id }", "message m { int64 id; }", "message m {", "message m { } x", "message m { required text t; }"):
        with pytest.raises(schema_text.SchemaError):
            schema_text.parse(bad)


def test_schema_merge():
    p = schema_text.parse
    a, b = p("message a { required int32 x; optional group g { required int32 i; } }"), p("message b { optional int32 x; required group g { optional int64 j; } required binary y; }")
    got = schema_text.merge(a, b)
    assert [c.name for c in got.children] == ["x", "g", "y"] and got.child("x").repetition == "optional" and got.child("g").repetition == "required"
    for x, y in (("required int32 x;", "required int64 x;"), ("required binary x (STRING);", "required binary x;"), ("required int32 x;", "required group x { required int32 y; }")):
        with pytest.raises(schema_text.SchemaError):
            schema_text.merge(p(f"message a {{ {x} }}"), p(f"message a {{ {y} }}"))


def test_other_models():
    m = schema_text.parse(DSL)
    back = schema_map.from_arrow(schema_map.to_arrow(m))
    assert schema_text.to_struct(back).simpleString() == schema_text.to_struct(m).simpleString()
    avro = {"type": "record", "name": "r", "fields": [{"name": "a", "type": ["null", "int"]}, {"name": "u", "type": ["int", "string"]}, {"name": "n", "type": "null"}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["a"]}}, {"name": "l", "type": {"type": "array", "items": "long"}}]}
    n = schema_map.from_avro(json.dumps(avro))
    assert [c.name for c in n.children] == ["a", "u", "e", "l"] and n.child("a").repetition == "optional" and [c.name for c in n.child("u").children] == ["member0", "member1"]
    assert schema_map.from_avro(schema_map.to_avro(schema_text.parse("message r { optional int32 a; required binary s (STRING); }"))).child("s").logical == "STRING"
    x, y = ({"type": "record", "name": "r", "fields": f} for f in ([{"name": "a", "type": "int"}], [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}]))
    assert schema_map.merge_avro(x, y)["fields"] == [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"], "default": None}]
    with pytest.raises(schema_text.SchemaError):
        schema_map.merge_avro(x, {"type": "record", "name": "r", "fields": [{"name": "a", "type": "float"}]})
    s = {"name": "S", "fields": [{"id": 1, "name": "a", "type": "i32", "requirement": "required"}, {"id": 2, "name": "l", "type": {"list": "string"}}]}
    assert schema_text.to_struct(schema_map.from_thrift(s)).simpleString() == "struct<a:int,l:array<string>>"
    assert schema_map.check_thrift_evolution(s, s) == [] and schema_map.check_thrift_evolution(s, {"name": "S", "fields": s["fields"][1:]})
    tree = {"name": "T", "fields": [{"name": "v", "type": "StringValue"}, {"name": "kids", "type": {"ref": "T"}, "label": "repeated"}]}
    t = schema_map.from_protobuf(tree, max_recursion=2)
    assert t.child("v").kind == "binary" and "binary" in schema_text.render(t)


def test_inference(spark, tmp_path):
    s = infer.csv_schema(["a,b,c,d,e", "1,,x,-4,", "2,.5,y,3,1.5f"])
    assert [f.dataType.simpleString() for f in s.fields] == ["bigint", "double", "string", "string", "float"]
    (tmp_path / "x.csv").write_text("a,b,c\n1,,\n2,1.5,q\n")
    d = infer.read_csv(spark, str(tmp_path / "x.csv"))
    assert [tuple(r) for r in d.orderBy("a").collect()] == [(1, None, ""), (2, 1.5, "q")]
    with pytest.raises(infer.InferenceError):
        infer.csv_schema(["1,2", "3,4"])
    j = infer.json_schema(['{"a": 1, "b": [1]}', '{"a": 3000000000, "c": {"d": null}}'])
    assert j.simpleString() == "struct<a:bigint,b:array<int>,c:struct<d:void>>"
    with pytest.raises(infer.InferenceError):
        infer.json_schema(['{"a": 1}', '{"a": 1.5}'])


def test_tolerant_reads(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    s = T._parse_datatype_string("a int")
    assert tables.tolerant(spark, str(tmp_path / "x.json"), s, "json", 0.5).count() == 2
    with pytest.raises(ValueError, match="cannot be read"):
        tables.tolerant(spark, str(tmp_path / "x.json"), s, "json", 0.1)


def test_variants(spark):
    texts = ['{"a": 1, "b": "x", "c": [1, 2]}', '{"a": "no", "z": {"y": 1.5}}', "[1, 2, 3]", "null", "7", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", variant.parse(F.col("t")).alias("v"))
    s = variant.shred(d, "v", T._parse_datatype_string("a bigint, b string"))
    back = variant.unshred(s, "v").orderBy("i").select(F.to_json("v").alias("j")).collect()
    assert [None if r["j"] is None else json.loads(r["j"]) for r in back] == [None if t is None else json.loads(t) for t in texts]
    first = s.orderBy("i").select("v.typed_value.a.typed_value", "v.typed_value.b.typed_value").collect()
    assert first[0][0] == 1 and first[0][1] == "x" and first[1][0] is None
    assert [r[0] for r in d.orderBy("i").select(variant.element(F.col("v"), 2, "int")).collect()] == [None, None, 3, None, None, None]
    assert [r[0] for r in d.orderBy("i").select(variant.size(F.col("v"))).collect()][:3] == [3, 2, 3]


def test_text_of_values(spark):
    d = spark.createDataFrame([(-1, bytes(range(16)), 86_399_123_456)], "n bigint, u binary, t bigint")
    r = d.select(formatting.timestamp_text(F.col("n"), "millis").alias("ts"), formatting.uuid_text(F.col("u")).alias("u"), formatting.unsigned_text(F.col("n")).alias("q"), formatting.time_text(F.col("t")).alias("t"), formatting.date_text(F.lit(-1)).alias("d")).first()
    assert r["ts"] == "1969-12-31T23:59:59.999+0000" and r["u"] == "00010203-0405-0607-0809-0a0b0c0d0e0f" and r["q"] == "18446744073709551615" and r["t"] == "23:59:59.123456" and r["d"] == "1969-12-31"
    assert formatting.interval_text(struct.pack("<3I", 1, 2, 3)) == "interval(1 months, 2 days, 3 millis)" and formatting.float16_of(b"\x00\x3c") == 1.0 and formatting.human_size(1536) == "1.500 kB"


def test_geometry(spark):
    line = struct.pack("<BII4d", 1, 2, 2, 1.0, 2.0, -3.0, float("nan"))
    point = struct.pack(">BI3d", 0, 1001, 5.0, 6.0, 7.0)
    d = spark.createDataFrame([(line,), (point,), (None,)], "g binary")
    r = geo.bounding_box(d, "g").first()
    assert (r["xmin"], r["xmax"], r["ymin"], r["ymax"], r["zmin"], r["mmin"], r["geometry_types"], r["valid"]) == (-3.0, 5.0, 2.0, 6.0, 7.0, None, [2, 1001], True)
    assert not geo.bounding_box(spark.createDataFrame([(b"\x01\x02",)], "g binary"), "g").first()["valid"]
    assert math.isnan(geo.merge_boxes({"xmin": 170.0, "xmax": -170.0}, {"xmin": 1.0, "xmax": 2.0})["xmin"])


def test_reports(spark, grouped, tmp_path):
    assert "l_orderkey" in reports.schema(spark, grouped) and reports.meta(spark, grouped).count() == 66
    assert json.loads(reports.footer(spark, grouped).first()["footer"])["blocks"][0]["rg_rows"] == 1000
    assert abs(reports.column_size(spark, grouped).agg(F.sum("ratio")).first()[0] - 1) < 1e-9
    assert reports.check_stats(spark, grouped).count() == 0
    assert set(reports.help()) == set(reports.COMMANDS)
    assert reports.to_avro(spark.range(1), str(tmp_path / "a")) == 1 and tables.avro(spark, str(tmp_path / "a")).collect()[0]["id"] == 0
    with pytest.raises(FileExistsError):
        reports.to_avro(spark.range(1), str(tmp_path / "a"))


def test_validated_writes(spark, tmp_path):
    d = spark.createDataFrame([(1,), (None,)], "x int")
    required = T.StructType([T.StructField("x", T.IntegerType(), False)])
    with pytest.raises(Exception, match="null in required column x"):
        tables.Writer(d).validated(required).write(str(tmp_path / "w"))
    with pytest.raises(TypeError):
        tables.Writer(d).validated(T._parse_datatype_string("x string")).write(str(tmp_path / "w2"))


def test_streams(spark, grouped, tmp_path):
    from lamella.streaming import filters

    s = filters.filtered(filters.stream_files(spark, grouped), P.lt("l_orderkey", 50), "l_orderkey")
    q = s.writeStream.format("memory").queryName("few").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("few").count() == P.apply_filter(spark.read.parquet(grouped), P.lt("l_orderkey", 50)).count()
