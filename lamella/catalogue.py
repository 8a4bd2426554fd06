"""Registry of the library's own queries and of the DuckDB SQL each is held against."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import formatting, geo, infer, reports, schema_text, variant
from .operators import bloom, projection, rewrite, statistics
from .operators import predicates as P
from .plans import pruning
from .sources import footers, pages
from .sources.tables import Reader, Writer, in_order, ranged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register the decorated (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that stands for the engine as a whole."""
    return QUERIES["scan_multi_predicate"](spark, sf_dir)


_made: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, for queries that write and read back: under spark.checkpoint.dir, or where that is unset a temporary
    one of a local session, which goes with the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is not None:
        return f"{base.rstrip('/')}/lamella-{uuid.uuid4().hex[:12]}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _made.append(tempfile.mkdtemp(prefix="lamella-"))
    return _made[-1]


@atexit.register
def _forget() -> None:
    for folder in _made:
        shutil.rmtree(folder, ignore_errors=True)


# Predicates. Nulls are made by nullif on both sides, as the tables have none.

LINES = "l_orderkey, l_linenumber"
KEYS = ("l_orderkey", "l_linenumber")
WITH_NULLS = "SELECT *, nullif(l_returnflag, 'N') AS flag, nullif(l_quantity, 17) AS qty FROM lineitem"


def with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({"flag": F.expr("nullif(l_returnflag, 'N')"), "qty": F.expr("nullif(l_quantity, 17)")})


def filtered(name: str, predicate: P.Predicate, where: str) -> None:
    query(f"SELECT {LINES} FROM ({WITH_NULLS}) WHERE {where}", name)(lambda spark, sf: P.apply_filter(with_nulls(spark, sf), predicate).select(*KEYS))


filtered("flt_eq", P.eq("flag", "R"), "flag = 'R'")
filtered("flt_eq_null", P.eq("flag", None), "flag IS NULL")
filtered("flt_not_eq_keeps_nulls", P.not_eq("flag", "R"), "flag <> 'R' OR flag IS NULL")
filtered("flt_not_eq_null", P.not_eq("flag", None), "flag IS NOT NULL")
filtered("flt_lt", P.lt("qty", 10.0), "qty < 10")
filtered("flt_lt_eq", P.lt_eq("qty", 10.0), "qty <= 10")
filtered("flt_gt", P.gt("qty", 40.0), "qty > 40")
filtered("flt_gt_eq", P.gt_eq("qty", 40.0), "qty >= 40")
filtered("flt_not_lt_drops_nulls", ~P.lt("qty", 40.0), "qty >= 40")
filtered("flt_in", P.is_in("flag", ["A", "X"]), "flag IN ('A', 'X')")
filtered("flt_in_null", P.is_in("flag", ["A", None]), "flag = 'A' OR flag IS NULL")
filtered("flt_not_in_keeps_nulls", P.not_in("flag", ["A"]), "flag <> 'A' OR flag IS NULL")
filtered("flt_not_in_null", P.not_in("flag", ["A", None]), "flag <> 'A' AND flag IS NOT NULL")
filtered("flt_and_or_not", (P.eq("flag", "A") | P.gt("qty", 30.0)) & ~(P.lt("l_discount", 0.03) & P.not_eq("l_linestatus", "O")), "(flag = 'A' OR qty > 30) AND (l_discount >= 0.03 OR l_linestatus = 'O')")
filtered("flt_missing_column", P.not_eq("no_such", 1) & P.eq("other", None) & P.gt("qty", 45.0), "qty > 45")
filtered("flt_udp", P.user_defined("flag", lambda s: s == "A", accepts_null=True), "flag = 'A' OR flag IS NULL")
filtered("flt_not_udp", ~P.user_defined("flag", lambda s: s == "A", accepts_null=True), "flag <> 'A' AND flag IS NOT NULL")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05 AND l_returnflag = 'R'")
def scan_multi_predicate(spark, sf_dir):
    p = P.all_of(P.lt("l_quantity", 24.0), P.gt_eq("l_discount", 0.05), P.eq("l_returnflag", "R"))
    return Reader(spark, f"{sf_dir}/lineitem.parquet").where(p).paths("l_orderkey", "l_linenumber", "l_extendedprice").read()


@query("SELECT l_orderkey, l_linenumber, coalesce(qty > 30 AND flag = 'R', FALSE) AS matches FROM (" + WITH_NULLS + ")")
def flt_as_column(spark, sf_dir):
    from .sources.tables import filter_column

    return filter_column(with_nulls(spark, sf_dir), P.gt("qty", 30.0) & P.eq("flag", "R")).select(*KEYS, "matches")


@query("SELECT c_custkey, c_name FROM customer WHERE right(c_name, 1) IN ('1', '3', '5', '7', '9')")
def flt_udp_odd_name(spark, sf_dir):
    p = P.user_defined("c_name", lambda s: s.str[-1].isin(list("13579")))
    return P.apply_filter(table(spark, sf_dir, "customer"), p).select("c_custkey", "c_name")


ELEMENTS = "list_transform(embedding, lambda v: CASE WHEN v < 0 THEN NULL ELSE v END)"


def sparse(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings")
    return d.withColumn("e", F.when(F.col("label") != 1, F.transform("embedding", lambda v: F.when(v >= 0, v))))


SPARSE = f"SELECT *, CASE WHEN label <> 1 THEN {ELEMENTS} END AS e FROM embeddings"
HAS = "coalesce(len(list_filter(e, lambda v: v IS NOT NULL AND {0})), 0) > 0"


@query(f"SELECT vec_id FROM ({SPARSE}) WHERE {HAS.format('v > 0.25')}")
def flt_contains(spark, sf_dir):
    return P.apply_filter(sparse(spark, sf_dir), P.contains(P.gt("e", 0.25))).select("vec_id")


@query(f"SELECT vec_id FROM ({SPARSE}) WHERE NOT ({HAS.format('v > 0.25')})")
def flt_not_contains(spark, sf_dir):
    return P.apply_filter(sparse(spark, sf_dir), ~P.contains(P.gt("e", 0.25))).select("vec_id")


@query(f"SELECT vec_id FROM ({SPARSE}) WHERE {HAS.format('v > 0.2')} AND {HAS.format('v < 0.001')}")
def flt_contains_and(spark, sf_dir):
    return P.apply_filter(sparse(spark, sf_dir), P.contains(P.gt("e", 0.2)) & P.contains(P.lt("e", 0.001))).select("vec_id")


@query(f"SELECT vec_id FROM ({SPARSE}) WHERE {HAS.format('v > 0.3')} OR NOT ({HAS.format('v < 0.01')})")
def flt_contains_or_not(spark, sf_dir):
    return P.apply_filter(sparse(spark, sf_dir), P.contains(P.gt("e", 0.3)) | ~P.contains(P.lt("e", 0.01))).select("vec_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 200000")
def flt_nested_struct(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.struct(F.struct("o_totalprice").alias("price"))).alias("o"))
    return P.apply_filter(d, P.gt("o.price.o_totalprice", 200000.0)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#7' OR p_type = 'Brand#7' OR p_size = 3")
def flt_map_entries(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.map_from_arrays(F.array(F.lit("brand"), F.lit("type")), F.array("p_brand", "p_type")).alias("m"))
    return P.apply_filter(d, P.contains(P.eq("m.value", "Brand#7")) | (P.contains(P.eq("m.key", "brand")) & P.eq("p_size", 3))).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE (p_name LIKE 'red%' OR p_size = 7) AND NOT p_brand = 'Brand#3'")
def flt_column_functions(spark, sf_dir):
    d = table(spark, sf_dir, "part")
    rule = P.and_filter(P.or_filter(P.column_filter("p_name", lambda c: c.startswith("red")), P.column_filter("p_size", P.equal_to(7))), P.not_filter(P.column_filter("p_brand", P.equal_to("Brand#3"))))
    return d.where(rule(d)).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_1based(spark, sf_dir):
    return P.page(table(spark, sf_dir, "orders"), 101, 50, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 3")
def head_n(spark, sf_dir):
    return reports.head(table(spark, sf_dir, "region").orderBy("r_regionkey"), 3)


# Projection.


@query("SELECT vec_id, embedding[1] AS embedding_0, embedding[4] AS embedding_3 FROM embeddings")
def proj_list_element(spark, sf_dir):
    return projection.select_paths(table(spark, sf_dir, "embeddings"), "vec_id", "embedding[0]", "embedding[3]")


@query("SELECT o_orderkey AS o_key, o_orderstatus AS o_attrs_status FROM orders")
def proj_path(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.struct(F.col("o_orderkey").alias("key"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("attrs")).alias("o"))
    return projection.select_paths(d, "o.key", "o.attrs[status]")


@query("SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem")
def proj_glob(spark, sf_dir):
    return projection.select_globs(table(spark, sf_dir, "lineitem"), "l_{order,part}key", "l_*date")


@query("SELECT n_nationkey, NULL::VARCHAR AS n_comment FROM nation")
def proj_missing_column(spark, sf_dir):
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_comment", T.StringType())])
    return Reader(spark, f"{sf_dir}/nation.parquet").with_schema(schema).read()


@query("SELECT count(*) AS n FROM customer")
def proj_empty(spark, sf_dir):
    return projection.project(table(spark, sf_dir, "customer"), T.StructType([])).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, row_number() OVER () - 1 AS row_index FROM supplier")
def proj_row_index(spark, sf_dir):
    return projection.with_row_index(table(spark, sf_dir, "supplier")).select("s_suppkey", "row_index")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_by_name(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return projection.union_columns([n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), r.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("id"))])


# Statistics.

_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_values, count(*) - count({c}) AS null_count, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value FROM (SELECT * REPLACE (nullif(l_linenumber, 3) AS l_linenumber) FROM lineitem)" for c in _NUMERIC))
def stats_minmax_nulls(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.expr("nullif(l_linenumber, 3)"))
    return statistics.column_statistics(d, *_NUMERIC).drop("nan_count")


@query("SELECT 'x' AS column_name, count(*) AS n_values, count(*) FILTER (x IS NULL) AS null_count, count(*) FILTER (isnan(x)) AS nan_count, min(x) FILTER (NOT isnan(x)) AS low, max(x) FILTER (NOT isnan(x)) AS high FROM (SELECT CASE WHEN l_linenumber = 2 THEN NULL WHEN l_linenumber = 3 THEN 'NaN'::DOUBLE ELSE l_quantity END AS x FROM lineitem)")
def stats_nan(spark, sf_dir):
    x = F.when(F.col("l_linenumber") == 2, None).when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_quantity"))
    s = statistics.column_statistics(table(spark, sf_dir, "lineitem").select(x.alias("x")), "x")
    return s.select("column_name", "n_values", "null_count", "nan_count", F.col("min_value").cast("double").alias("low"), F.col("max_value").cast("double").alias("high"))


@query("SELECT 'l_orderkey' AS column_name, count(*) AS n_values, 0::BIGINT AS null_count, NULL::BIGINT AS nan_count, min(l_orderkey) AS min_value, max(l_orderkey) AS max_value FROM lineitem")
def stats_merge(spark, sf_dir):
    parts = statistics.column_statistics(table(spark, sf_dir, "lineitem"), "l_orderkey", by=("l_returnflag",))
    return statistics.merge_statistics(parts, "bigint")


@query("SELECT 'text' AS column_name, sum(octet_length(encode(text)))::BIGINT AS unencoded_bytes FROM documents UNION ALL SELECT 'lang', sum(octet_length(encode(lang)))::BIGINT FROM documents")
def stats_unencoded_bytes(spark, sf_dir):
    return statistics.unencoded_bytes(table(spark, sf_dir, "documents"), "text", "lang")


@query(f"SELECT 'definition' AS level_kind, level, count(*) AS n FROM (SELECT CASE WHEN v IS NULL THEN 2 ELSE 3 END AS level FROM (SELECT unnest(e) AS v FROM ({SPARSE}) WHERE e IS NOT NULL)) GROUP BY level UNION ALL SELECT 'definition', 0, count(*) FROM ({SPARSE}) WHERE e IS NULL")
def stats_def_hist(spark, sf_dir):
    return statistics.level_histograms(sparse(spark, sf_dir), "e").where("level_kind = 'definition'")


@query(f"SELECT 'repetition' AS level_kind, 0 AS level, count(*) AS n FROM ({SPARSE}) UNION ALL SELECT 'repetition', 1, sum(len(e) - 1)::BIGINT FROM ({SPARSE}) WHERE e IS NOT NULL")
def stats_rep_hist(spark, sf_dir):
    return statistics.level_histograms(sparse(spark, sf_dir), "e").where("level_kind = 'repetition'")


@query("SELECT o_row // 500 AS page, count(*) AS n, 0::BIGINT AS null_count, min(o_orderkey) AS min_value, max(o_orderkey) AS max_value FROM (SELECT o_orderkey, row_number() OVER () - 1 AS o_row FROM orders) GROUP BY 1")
def stats_pages(spark, sf_dir):
    d = projection.with_row_index(table(spark, sf_dir, "orders"), "o_row")
    return statistics.page_statistics(d, "o_orderkey", "o_row", 500)


@query("SELECT 'ASCENDING' AS boundary_order")
def stats_boundary_order(spark, sf_dir):
    d = projection.with_row_index(table(spark, sf_dir, "orders"), "o_row")
    return statistics.boundary_order(statistics.page_statistics(d, "o_orderkey", "o_row", 500))


@query("SELECT p_partkey, left(p_name, 5) AS low, CASE WHEN length(p_name) <= 5 THEN p_name ELSE left(p_name, 4) || chr((ascii(substr(p_name, 5, 1)) + 1)::INTEGER) END AS high FROM part")
def stats_truncate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", statistics.truncate_min(F.col("p_name"), 5).alias("low"), statistics.truncate_max(F.col("p_name"), 5).alias("high"))


# Metadata and reports.


@query("SELECT count(*) AS n_rows FROM orders")
def scan_count(spark, sf_dir):
    return reports.scan_counts(table(spark, sf_dir, "orders")).select("n_rows")


@query("SELECT count(*) AS n_rows FROM lineitem")
def meta_count(spark, sf_dir):
    return footers.metadata_count(spark, f"{sf_dir}/lineitem.parquet").agg(F.sum("n_rows").alias("n_rows"))


@query("SELECT 'l_orderkey' AS path, count(*) AS n_values, 0::BIGINT AS null_count, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem UNION ALL SELECT 'l_linenumber', count(*), 0, min(l_linenumber), max(l_linenumber) FROM lineitem")
def meta_chunks(spark, sf_dir):
    c = footers.chunk_catalog(spark, f"{sf_dir}/lineitem.parquet").where(F.col("path").isin("l_orderkey", "l_linenumber"))
    return c.groupBy("path").agg(F.sum("n_values").alias("n_values"), F.sum("null_count").alias("null_count"), F.min(F.col("min_value").cast("long")).alias("low"), F.max(F.col("max_value").cast("long")).alias("high"))


@query("SELECT column_name AS path, TRUE AS stored FROM (DESCRIBE lineitem)")
def meta_column_size(spark, sf_dir):
    s = reports.column_size(spark, f"{sf_dir}/lineitem.parquet")
    return s.select("path", ((F.col("bytes") > 0) & (F.col("ratio") <= 1)).alias("stored"))


@query("SELECT * FROM (VALUES ('r_regionkey', 1, 0), ('r_name', 1, 0)) t(path, definition_level, repetition_level)")
def meta_schema(spark, sf_dir):
    return reports.schema_table(spark, f"{sf_dir}/region.parquet").select("path", "definition_level", "repetition_level")


@query("SELECT count(*) AS n_rows, 3 AS n_columns FROM nation")
def meta_footer(spark, sf_dir):
    kind = "struct<n_rows:bigint,blocks:array<struct<columns:array<struct<path:string>>>>>"
    f = reports.footer(spark, f"{sf_dir}/nation.parquet").select(F.from_json("footer", kind).alias("f"))
    return f.select("f.n_rows", F.size(F.col("f.blocks")[0]["columns"]).alias("n_columns"))


@query("SELECT * FROM (SELECT '' AS column_name, '' AS what, '' AS stated, '' AS found) WHERE FALSE")
def meta_check_stats(spark, sf_dir):
    return reports.check_stats(spark, f"{sf_dir}/lineitem.parquet")


@query("SELECT 'l_orderkey' AS path, count(*) AS n_values FROM lineitem")
def meta_pages(spark, sf_dir):
    p = pages.page_headers(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey"]).where("page_type <> 'DICTIONARY_PAGE'")
    return p.groupBy("path").agg(F.sum("n_values").alias("n_values"))


@query("SELECT DISTINCT l_returnflag AS value FROM lineitem")
def meta_dictionary(spark, sf_dir):
    return pages.dictionaries(spark, f"{sf_dir}/lineitem.parquet", "l_returnflag").select("value").distinct()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 1100")
def prune_row_groups(spark, sf_dir):
    """Small row groups, pruned by the catalog, then read by ordinal and filtered."""
    p = P.gt_eq("l_orderkey", 1000) & P.lt_eq("l_orderkey", 1100)
    out = f"{work_dir(spark)}/rg"
    Writer(ranged(table(spark, sf_dir, "lineitem"), "l_orderkey")).set("row_group_rows", 1000).write(out)
    return pruning.read_pruned(spark, out, p, names=list(KEYS))


@query("SELECT page::INT AS page, page * 500 AS first_row, FALSE AS null_page, 0::BIGINT AS null_count, min(o_orderkey)::VARCHAR AS min_value, max(o_orderkey)::VARCHAR AS max_value, 'ASCENDING' AS boundary_order FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS page FROM orders) GROUP BY page")
def column_index_report(spark, sf_dir):
    out = f"{work_dir(spark)}/ci"
    ordered = in_order(table(spark, sf_dir, "orders"), f"{work_dir(spark)}/ordered", "o_orderkey")
    Writer(ordered()).set("page_rows", 500).set("row_group_rows", 100_000).write(out)
    return pages.through_files(pages.column_indexes(spark, out, ["o_orderkey"]), footers.row_groups(spark, out)).select("page", "first_row", "null_page", "null_count", "min_value", "max_value", "boundary_order")


@query("SELECT c_custkey AS value, c_custkey IN (SELECT o_custkey FROM orders) AS held FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def bloom_no_misses(spark, sf_dir):
    b = bloom.build(table(spark, sf_dir, "orders"), "o_custkey", ndv=20_000)
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    return bloom.probe(c.select(F.col("c_custkey").alias("value")), "value", b, "held")


# Rewrites.


@query("SELECT n_nationkey, n_regionkey FROM nation")
def rw_prune(spark, sf_dir):
    return rewrite.prune(table(spark, sf_dir, "nation"), "n_name")


@query("SELECT n_nationkey, NULL::VARCHAR AS n_name, n_regionkey FROM nation")
def rw_nullify(spark, sf_dir):
    return rewrite.nullify(table(spark, sf_dir, "nation"), "n_name")


@query("SELECT n_nationkey AS id, n_name, n_regionkey AS region FROM nation")
def rw_rename(spark, sf_dir):
    return rewrite.rename(table(spark, sf_dir, "nation"), {"n_nationkey": "id", "n_regionkey": "region"})


@query("SELECT * FROM region UNION ALL SELECT * FROM region")
def rw_merge(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return rewrite.merge([r, r])


@query("SELECT s_suppkey, s_name FROM supplier")
def rw_recompress(spark, sf_dir):
    out = f"{work_dir(spark)}/zstd"
    rewrite.rewrite(spark, rewrite.RewriteOptions([f"{sf_dir}/supplier.parquet"], out, codec="ZSTD", prune=["s_nationkey", "s_acctbal"]))
    return spark.read.parquet(out)


@query("SELECT * FROM supplier")
def rw_encrypt_roundtrip(spark, sf_dir):
    keys = {"s_name": "000102030405060708090A0B0C0D0E0F", "s_acctbal": "0F0E0D0C0B0A09080706050403020100"}
    return rewrite.decrypt_cells(rewrite.encrypt_cells(table(spark, sf_dir, "supplier"), keys), keys)


def _halves(spark, sf_dir):
    """orders in two tables, columns apart, rows in one order over their files; o_custkey in both, negative on the right."""
    out = work_dir(spark)
    d = in_order(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), f"{out}/ordered", "o_orderkey")()
    d.select("o_orderkey", "o_custkey").write.parquet(f"{out}/a")
    d.select((-F.col("o_custkey")).alias("o_custkey"), "o_totalprice").write.parquet(f"{out}/b")
    return f"{out}/a", f"{out}/b"


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def rw_positional_join(spark, sf_dir):
    return rewrite.positional_join_files(spark, *_halves(spark, sf_dir))


@query("SELECT o_orderkey, -o_custkey AS o_custkey, o_totalprice FROM orders")
def rw_positional_join_overwrite(spark, sf_dir):
    return rewrite.positional_join_files(spark, *_halves(spark, sf_dir), overwrite=True)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def rw_positional_join_frames(spark, sf_dir):
    """The same over scans that are frames already, by a shuffle on the position."""
    return rewrite.positional_join(*map(spark.read.parquet, _halves(spark, sf_dir)))


# Variants, text, geometry.


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def variant_get_int(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", variant.field(variant.parse(F.col("props")), "k", "bigint").alias("k"))


@query("SELECT DISTINCT 'OBJECT<k: BIGINT>' AS kind FROM events")
def variant_type(spark, sf_dir):
    return table(spark, sf_dir, "events").select(variant.type_name(variant.parse(F.col("props"))).alias("kind")).distinct()


@query("SELECT event_id, 1 AS n FROM events")
def variant_size(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", variant.size(variant.parse(F.col("props"))).alias("n"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type AS t, value AS v FROM events")
def variant_shred_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.parse_json(F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "t": "'), F.col("event_type"), F.lit('", "x": {"v": '), F.col("value").cast("string"), F.lit("}}"))).alias("p"))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.StringType())])
    back = variant.unshred(variant.shred(e, "p", schema), "p")
    return back.select("event_id", variant.field(F.col("p"), "k", "bigint").alias("k"), variant.field(F.col("p"), "t", "string").alias("t"), variant.field(F.col("p"), "x.v", "double").alias("v"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000000+0000') AS t FROM orders")
def fmt_timestamp(spark, sf_dir):
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", formatting.timestamp_text(micros, "micros").alias("t"))


@query("SELECT r_regionkey, r_name FROM region")
def csv_infer_roundtrip(spark, sf_dir):
    out = f"{work_dir(spark)}/csv"
    table(spark, sf_dir, "region").coalesce(1).write.option("header", "true").csv(out)
    d = infer.read_csv(spark, out)
    return d.select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_infer_roundtrip(spark, sf_dir):
    out = f"{work_dir(spark)}/json"
    table(spark, sf_dir, "nation").coalesce(1).write.json(out)
    return spark.read.schema(infer.infer_json(spark, out)).json(out).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT 'message spark_schema {' || chr(10) || '  optional int32 r_regionkey;' || chr(10) || '  optional binary r_name (STRING);' || chr(10) || '}' || chr(10) AS message")
def schema_message(spark, sf_dir):
    return spark.createDataFrame([(schema_text.render(schema_text.from_struct(table(spark, sf_dir, "region").schema)),)], "message string")


@query("SELECT min(c_custkey)::DOUBLE AS xmin, max(c_custkey)::DOUBLE AS xmax, min(c_acctbal) AS ymin, max(c_acctbal) AS ymax FROM customer")
def geo_bounding_box(spark, sf_dir):
    d = table(spark, sf_dir, "customer")
    point = F.pandas_udf(lambda x, y: __import__("pandas").Series([__import__("struct").pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y, strict=True)]), "binary")
    return geo.bounding_box(d.select(point(F.col("c_custkey").cast("double"), F.col("c_acctbal")).alias("g")), "g").select("xmin", "xmax", "ymin", "ymax")
