"""Queries whose tables are in files of bounded length agree with their SQL when these are many, and no task holds a table."""

import pytest
from test_queries import duck, rows  # noqa: F401

from lamella import catalogue, catalogue_files
from lamella.sources import footers, tables

#: Rows of a file in these tests; lineitem has 6,000 here, orders 1,500.
ROWS = 1000


@pytest.fixture(scope="module", autouse=True)
def short_files():
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tables, "FILE_ROWS", ROWS)
        m.setattr(catalogue_files, "_written", {})
        yield


def agrees(spark, small, duck, name):  # noqa: F811
    df = catalogue.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert rows(df.select(*[f"`{c}`" for c in columns]).collect()) == rows(want)


def test_files_of_whole_row_groups(spark, small):
    path = catalogue_files.grouped(spark, small)
    files = footers.file_catalog(spark, path).orderBy("file").collect()
    assert [(f["n_rows"], f["n_row_groups"]) for f in files] == [(ROWS, 1)] * 6
    first = [spark.read.parquet(f["file"]).selectExpr("min(l_shipdate) AS a", "max(l_shipdate) AS b").first() for f in files]
    assert all(x["b"] <= y["a"] for x, y in zip(first, first[1:], strict=False))


@pytest.mark.parametrize("name", ["row_group_ordinals", "column_index_bounds", "scan_metrics", "meta_report"])
def test_row_groups_count_on_through_files(spark, small, duck, name):  # noqa: F811
    agrees(spark, small, duck, name)


def test_a_footer_is_read_once_a_run(spark, small):
    """Row groups of one file that lie together are read together, with the ordinal of each."""
    path = catalogue_files.grouped(spark, small)
    one = footers.list_files(spark, path).orderBy("file").first()["file"]
    out = f"{catalogue.work_dir(spark)}/one"
    spark.read.parquet(one).write.option("parquet.block.row.count.limit", 100).parquet(out)
    groups = footers.row_groups(spark, out)
    assert groups.count() == 10
    d = footers.read_row_groups(spark, out, groups.where("row_group <> 4"), ordinal="g")
    told = d.groupBy("g").count().collect()
    assert sorted((r["g"], r["count"]) for r in told) == [(g, 100) for g in range(10) if g != 4]
    assert d.selectExpr("spark_partition_id() AS p").distinct().count() == 1


def test_byte_ranges_of_many_files(spark, small, duck):  # noqa: F811
    agrees(spark, small, duck, "scan_byte_ranges")


def test_byte_ranges_read_runs(spark, small):
    """A range of one file's row groups is read by one task."""
    path = catalogue_files.grouped(spark, small)
    out = f"{catalogue.work_dir(spark)}/range"
    spark.read.parquet(path).coalesce(1).write.option("parquet.block.row.count.limit", 100).parquet(out)
    d = tables.Reader(spark, out).between(0, 1 << 62).read()
    assert d.count() == 6000 and d.selectExpr("spark_partition_id() AS p").distinct().count() == 1


def test_pages_count_on_through_row_groups_and_files(spark, small, duck):  # noqa: F811
    from lamella.sources import pages

    agrees(spark, small, duck, "column_index_report")
    out = f"{catalogue.work_dir(spark)}/pages"
    cut = tables.in_order(spark.range(4321).withColumnRenamed("id", "k"), f"{out}/ordered", "k")
    tables.Writer(cut(2000)).set("page_rows", 100).set("row_group_rows", 500).write(f"{out}/t")
    groups = footers.row_groups(spark, f"{out}/t")
    assert sorted(r["n"] for r in groups.groupBy("file").agg({"row_group": "count"}).toDF("file", "n").collect()) == [1, 4, 4]
    got = pages.through_files(pages.column_indexes(spark, f"{out}/t", ["k"]), groups).orderBy("page").collect()
    assert [(r["page"], r["first_row"], r["min_value"]) for r in got] == [(n, 100 * n, str(100 * n)) for n in range(44)]


@pytest.mark.parametrize("name", ["prune_dictionary_eq", "prune_dictionary_in", "prune_dictionary_user_defined", "prune_dictionary_not_in", "prune_dictionary_none"])
def test_keys_have_dictionaries_whatever_their_number(spark, small, duck, tmp_path, name):  # noqa: F811
    """As many suppliers as rows: a dictionary of theirs saves no space, and the row groups that hold one are still told apart."""
    import duckdb

    spark.read.parquet(f"{small}/lineitem.parquet").selectExpr("* EXCEPT (l_suppkey)", "pmod(monotonically_increasing_id(), 3000) AS l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    agrees(spark, str(tmp_path), c, name)


def test_the_layout_has_a_dictionary(spark, small, duck, tmp_path):  # noqa: F811
    spark.read.parquet(f"{small}/lineitem.parquet").selectExpr("* EXCEPT (l_suppkey)", "monotonically_increasing_id() AS l_suppkey").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {r["fact"]: r["found"] for r in catalogue.QUERIES["page_layout"](spark, str(tmp_path)).collect()}["dictionary"] == "True"


def test_row_groups_of_arrow_files_are_whole(spark, tmp_path):
    """Whatever the batches: the rest of one waits for the next."""
    from lamella.sources import arrow_files

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        arrow_files.write_files(spark.range(2100).coalesce(1), str(tmp_path / "t"), arrow_files.FileOptions(row_group_rows=1000))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = footers.row_groups(spark, str(tmp_path / "t")).orderBy("row_group").collect()
    assert [r["rg_rows"] for r in groups] == [1000, 1000, 100]


def broken(spark, tmp_path, column, change):
    """The problems that check_indexes() tells of a file whose column index of a column is changed in place: change(raw) of the same length."""
    from lamella.sources import pages

    out = tmp_path / "t"
    d = spark.range(1000).selectExpr("id", "lpad(cast(id AS string), 4, '0') AS s", "cast(id AS decimal(30, 0)) AS d", "id >= 500 AS b", "array(id, id + 1) AS l", "IF(id < 100, NULL, lpad(cast(id AS string), 4, '0')) AS n").coalesce(1)
    tables.Writer(d).set("page_rows", 100).set("codec", "none").write(str(out))
    assert pages.check_indexes(spark, str(out)).count() == 0
    file = next(out.glob("*.parquet"))
    raw = bytearray(file.read_bytes())
    with footers.open_file(str(file)) as f:
        chunk = pages._footer(f)[4][0][1][["id", "s", "d", "b", "l", "n"].index(column)]
    at, size = chunk[6], chunk[7]
    new = change(bytes(raw[at : at + size]))
    assert len(new) == size and new != raw[at : at + size]
    raw[at : at + size] = new
    file.write_bytes(raw)
    next(out.glob(".*.parquet.crc")).unlink()
    return {(r["path"], r["page"], r["problem"]) for r in pages.check_indexes(spark, str(out)).collect()}


BROKEN = {
    "text out of order": ("s", lambda raw: raw.replace(b"\x040300", b"\x040050"), {("s", 3, "bounds are not ascending")}),
    "text above the values": ("s", lambda raw: raw.replace(b"\x040300", b"\x040301"), {("s", 3, "a value is below the least")}),
    "text below the values": ("s", lambda raw: raw.replace(b"\x040399", b"\x040398"), {("s", 3, "a value is above the greatest")}),
    "decimals": ("d", lambda raw: raw.replace((300).to_bytes(13, "big"), (299).to_bytes(13, "big")).replace((399).to_bytes(13, "big"), (298).to_bytes(13, "big")), {("d", 3, "the least value is above the greatest"), ("d", 3, "a value is above the greatest"), ("d", 3, "bounds are not ascending")}),
    "numbers": ("id", lambda raw: raw.replace((399).to_bytes(8, "little"), (398).to_bytes(8, "little")), {("id", 3, "a value is above the greatest")}),
    "elements of lists": ("l", lambda raw: raw.replace((300).to_bytes(8, "little"), (301).to_bytes(8, "little")), {("l.list.element", 3, "a value is below the least")}),
    "booleans": ("b", lambda raw: raw.replace(b"\x01\x00" * 5 + b"\x01\x01" * 5, b"\x01\x01" + b"\x01\x00" * 4 + b"\x01\x01" * 5, 1), {("b", 0, "the least value is above the greatest"), ("b", 0, "a value is below the least"), ("b", 1, "bounds are not ascending")}),
    "null counts": ("n", lambda raw: raw[::-1].replace(b"\xc8\x01"[::-1], b"\xc6\x01"[::-1], 1)[::-1], {("n", 0, "the null count is wrong")}),
}


@pytest.mark.parametrize("case", BROKEN)
def test_broken_indexes_of_all_types_are_told(spark, tmp_path, case):
    column, change, want = BROKEN[case]
    got = broken(spark, tmp_path, column, change)
    assert want <= got and {p for p, _, _ in got} == {p for p, _, _ in want}


@pytest.mark.parametrize("name", ["prune_bloom_others_keep", "prune_stats_eq_all_null", "footer_row_groups", "prune_stats_decimal", "prune_by_saved_summary", "read_two_row_groups", "prune_dictionary_not_eq", "prune_stats_eq_date", "prune_stats_nan", "prune_stats_not_in", "prune_stats_not_user_defined", "pages_range", "pages_nulls"])
def test_row_groups_of_many_files_are_judged(spark, small, duck, name):  # noqa: F811
    agrees(spark, small, duck, name)


def test_read_pruned_reads_runs(spark, small, duck):  # noqa: F811
    """What is left of one file is read by one task, which opens it once."""
    from lamella.operators import predicates as P
    from lamella.plans import pruning

    agrees(spark, small, duck, "read_pruned_rows")
    out = f"{catalogue.work_dir(spark)}/left"
    spark.range(3000).coalesce(1).write.option("parquet.block.row.count.limit", 100).parquet(out)
    d = pruning.read_pruned(spark, out, P.gt_eq("id", 1000))
    assert d.count() == 2000 and d.selectExpr("spark_partition_id() AS p").distinct().count() == 1


def made(monkeypatch, spark, *modules) -> str:
    """The folder that queries of these modules are made to write to."""
    folder = catalogue.work_dir(spark)
    for m in modules:
        monkeypatch.setattr(m, "work_dir", lambda _: folder)
    return folder


def lengths(spark, path) -> list[int]:
    return [r["n_rows"] for r in footers.file_catalog(spark, path).orderBy("file").collect()]


def test_sorted_rows_are_written_by_many_tasks(spark, small, duck, monkeypatch):  # noqa: F811
    out = made(monkeypatch, spark, catalogue)
    agrees(spark, small, duck, "prune_row_groups")
    n = lengths(spark, f"{out}/rg")
    assert sum(n) == 6000 and len(n) > 3 and max(n) < 2 * ROWS


@pytest.mark.parametrize("name", ["rw_positional_join", "rw_positional_join_overwrite"])
def test_halves_are_written_by_many_tasks(spark, small, duck, monkeypatch, name):  # noqa: F811
    out = made(monkeypatch, spark, catalogue)
    agrees(spark, small, duck, name)
    assert lengths(spark, f"{out}/a") == lengths(spark, f"{out}/b") == [1000, 500]


def test_positions_are_joined_by_bounded_tasks(spark, small, duck, monkeypatch):  # noqa: F811
    from lamella.operators import rewrite

    monkeypatch.setattr(rewrite, "STRETCH", 100)
    out = made(monkeypatch, spark, catalogue)
    agrees(spark, small, duck, "rw_positional_join_frames")
    d = rewrite.positional_join(spark.read.parquet(f"{out}/a"), spark.read.parquet(f"{out}/b"))
    assert d.rdd.getNumPartitions() == 15 and d.count() == 1500


def test_unlike_files_are_written_by_many_tasks(spark, small, duck, monkeypatch):  # noqa: F811
    out = made(monkeypatch, spark, catalogue_files)
    agrees(spark, small, duck, "rw_join_files_unlike_bounds")
    assert lengths(spark, f"{out}/a") == [500, 500, 500] and lengths(spark, f"{out}/b") == [1000, 500]
    assert sorted(r["rg_rows"] for r in footers.row_groups(spark, f"{out}/b").collect()) == [300, 500, 700]
