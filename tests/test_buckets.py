"""Grids are stored in buckets of sheets, so that work on sheets shuffles no cells."""

import pytest

from gridlens.functions.scalars import norm
from gridlens.operators import apply, bands, check, read, rows, survey
from gridlens.plans.apply_queries import _bands
from gridlens.plans.catalog import queries
from gridlens.plans.check_queries import _fields
from gridlens.plans.survey_queries import order_roles
from gridlens.sources import grids

SF = "/root/testdata/sf0.001"
WIDE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture
def planned(spark):
    """The text of a physical plan, where no table is small enough to be sent to all tasks."""
    held = {k: spark.conf.get(k) for k in WIDE}
    for k, v in WIDE.items():
        spark.conf.set(k, v)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in held.items():
        spark.conf.set(k, v)


def test_groups_and_windows_of_sheets_shuffle_nothing(spark, planned):
    for name in ("orders", "bands"):
        cells = grids.cells(spark, SF, name)
        for df in (read.sheets(cells), survey.date_columns(cells), survey.identity_columns(cells), survey.key_hits(cells)):
            assert "Exchange" not in planned(df)
    assert "Exchange" not in planned(check.header_rows(order_roles(spark, SF)))
    assert "Exchange" not in planned(rows.role_counts(order_roles(spark, SF)))


def test_joins_of_places_with_cells_shuffle_nothing(spark, planned):
    cells = grids.cells(spark, SF, "bands")
    assert "Exchange" not in planned(bands.probes(cells))


def test_roles_shuffle_only_what_has_a_row_a_sheet(spark, planned):
    text = planned(rows.row_roles(grids.cells(spark, SF, "orders"), grids.merges(spark, SF)))
    assert all("id_col" in line or "c1#" not in line for line in text.splitlines() if "Exchange" in line)
    assert text.count("Exchange hashpartitioning") <= 3


def test_buckets_grow_with_the_input(spark, monkeypatch):
    few = grids.buckets(spark, SF)
    monkeypatch.setattr(grids, "BUCKET", 1000)
    assert grids.buckets(spark, SF) > few


def test_texts_of_any_white_space_are_normed(spark):
    rows_ = spark.createDataFrame([(" IO  No\t",), ("P12",), ("ÉX fac",), (None,), ("",)], "t string")
    assert [r[0] for r in rows_.select(norm(rows_["t"])).collect()] == ["io no", "p12", "éx fac", None, ""]


def test_blank_runs_shuffle_no_rows(spark, planned):
    assert "Exchange" not in planned(survey.blank_gaps(grids.cells(spark, SF, "orders")))


def test_blank_runs_reach_to_the_end_of_the_extent(spark):
    cells = spark.createDataFrame([("w", "s", 2), ("w", "s", 5), ("w", "t", 1)], "workbook_id string, sheet string, r int")
    extents = spark.createDataFrame([("w", "s", 7), ("w", "t", 1), ("w", "u", 2)], "workbook_id string, sheet string, max_row int")
    found = lambda df: sorted(tuple(x) for x in df.select("sheet", "g_start", "g_end").collect())
    assert found(survey.blank_gaps(cells, extents)) == [("s", 1, 1), ("s", 3, 4), ("s", 6, 7), ("u", 1, 2)]
    assert found(survey.blank_gaps(cells)) == [("s", 1, 1), ("s", 3, 4)]


def test_fields_of_items_stay_in_their_buckets(spark, planned):
    fields, cells = _fields(spark, SF), grids.cells(spark, SF, "orders")
    assert "Exchange" not in planned(check.source_cells(fields, cells))
    assert "Exchange" not in planned(fields.groupBy("workbook_id", "sheet", "field").count())


def test_a_repeated_name_keeps_its_last_value(spark):
    kind = "k int, ord int, canonical string, is_field boolean, as_text string, as_int bigint, as_date date, sval string, dtype string, confidence double, addr string"
    values = [(1, 1, "io_number", True, "a", None, None, "a", "str", 0.9, "A1"), (1, 3, "io_number", True, "b", None, None, "b", "str", 0.8, "A3"), (1, 2, "note", False, "x", None, None, "x", "str", 0.5, "B1"), (1, 4, "note", False, "y", None, None, None, "str", 0.5, "B2"), (2, 1, "quantity", True, None, 7, None, "7", "int", 0.9, "C1"), (2, 2, "quantity", False, None, None, None, "?", "str", 0.5, "C2")]
    every = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    one, two, three = apply.fold(spark.createDataFrame(values, kind), ["k"], every).orderBy("k").collect()
    assert (one.io_number, one.metadata, one.cells) == ("b", {"note": None}, {"io_number": "A3", "note": "B2"})
    assert (two.quantity, two.metadata, two.metadata_kinds, two.cells) == (7, {"quantity": "?"}, {"quantity": "str"}, {"quantity": "C2"})
    assert (three.io_number, three.metadata, three.cells) == (None, {}, {})


def test_lines_of_bands_are_shuffled_once(spark, planned):
    cells = grids._query(spark, SF, "bands", grids._INLINE["bands"])
    assert planned(cells.repartition(grids.buckets(spark, SF), "workbook_id", "sheet")).count("Exchange") == 1


def test_grids_without_regions_are_not_looked_through(spark, planned):
    grids.release(spark)
    cells, none, _ = _bands(spark, SF)
    assert not [k for k in grids._KEPT if k[2] in ("merges", "order lines")]
    places = cells.select("workbook_id", "sheet", "r", "c")
    assert "Window" not in planned(read.look(cells, none, places))


def test_lateral_calls_shuffle_no_cells(spark, planned):
    assert "Exchange" not in planned(queries()["sql_merged_and_beside"](spark, SF))


def test_rows_with_faults_stay_in_their_buckets(spark, planned):
    for name in ("plan_findings", "chk_reference", "chk_unique", "chk_header"):
        assert "Exchange" not in planned(queries()[name](spark, SF))


def test_places_under_regions_are_shuffled_once(spark, planned):
    text = planned(queries()["merge_lookup"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1
    assert all("value" not in line or "ShuffledHashJoin" in line for line in text.splitlines() if "Join" in line and "r1#" in line)


def test_roles_shuffle_nothing(spark, planned):
    assert "Exchange" not in planned(rows.row_roles(grids.cells(spark, SF, "orders"), grids.merges(spark, SF), buckets=grids.buckets(spark, SF)))


def test_labels_sort_no_texts(spark, planned):
    assert "SortMergeJoin" not in planned(apply.header_labels(grids.cells(spark, SF, "orders"), order_roles(spark, SF)))


def test_places_asked_twice_are_answered_twice(spark):
    """Repeats keep what they carry, in a cell of their own and under a region."""
    place = "workbook_id string, sheet string, r int, c int"
    cells = spark.createDataFrame([("w", "s", 1, 1, "str", "x", None, None)], f"{place}, dtype string, sval string, nval double, dval timestamp")
    merges = spark.createDataFrame([("w", "s", 1, 1, 3, 1)], "workbook_id string, sheet string, r1 int, c1 int, r2 int, c2 int")
    asked = spark.createDataFrame([("w", "s", r, 1, k) for r in (1, 2, 4) for k in ("a", "a", "b")], f"{place}, _region string")
    got = read.look(cells, merges, asked).select("r", "_region", "sval", "addr").collect()
    assert sorted(map(tuple, got)) == [(r, k, "x", "A1") for r in (1, 2) for k in ("a", "a", "b")]
