"""The tools in SQL give what the DataFrame operators give."""

import pytest
from pyspark.sql import functions as F

from gridlens.functions import address
from gridlens.operators import read, registry, sql
from test_operators import grid, regions


@pytest.fixture(scope="module")
def tools(spark):
    cells = grid(spark, {"a": {(1, 1): "IO NO", (1, 3): "Colour", (2, 1): 7, (4, 3): "red 100%", (5, 28): "far"}, "b": {(1, 2): "io no", (3, 1): "x_y"}})
    merges = regions(spark, [("a", (2, 1, 3, 1)), ("b", (4, 1, 5, 30))])
    sql.register(spark, cells, merges, "t_")
    return cells, merges


def rows(df, columns=None):
    return sorted(map(repr, map(tuple, df.select(*(columns or df.columns)).collect())))


CALLS = {
    "list_sheets": ("t_list_sheets()", lambda c, m: read.sheets(c)),
    "workbook_summary": ("t_workbook_summary()", lambda c, m: read.workbooks(c)),
    "peek_sheet": ("t_peek_sheet(2, max_cols => 2)", lambda c, m: read.peek(c, 2, 2)),
    "sample_rows": ("t_sample_rows(array(4, 1, 9, 1))", lambda c, m: read.sample_rows(c, [4, 1, 9, 1])),
    "read_range": ("t_read_range(1, 4, 2, 3)", lambda c, m: read.read_range(c, (1, 4), (2, 3))),
    "read_row": ("t_read_row(1)", lambda c, m: read.read_row(c, 1)),
    "get_cell_at": ("t_get_cell_at('AB5')", lambda c, m: read.cell_at(c, "AB5")),
    "get_merged_regions": ("t_get_merged_regions()", lambda c, m: read.merged_regions(c, m)),
    "count_non_empty_rows_in_column": ("t_count_non_empty_rows_in_column(1, 2, 9)", lambda c, m: read.count_non_empty(c, 1, (2, 9))),
    "find_value": ("t_find_value('IO NO', max_hits => 1)", lambda c, m: read.find_value(c, "IO NO", 1)),
}


@pytest.mark.parametrize("name", list(CALLS))
def test_tools_are_the_operators(spark, tools, name):
    call, operator = CALLS[name]
    got = spark.sql(f"select * from {call}")
    want = rows(operator(*tools), got.columns)
    assert want and rows(got) == want


def test_every_tool_can_be_called(tools):
    assert {name for name, *_ in sql.TABLES} == {*CALLS, "read_relative"} == set(registry.TOOLS.names())


def test_needles_are_literal_and_case_can_count(spark, tools):
    assert spark.sql("select * from t_find_value('100%')").count() == 1 and spark.sql("select * from t_find_value('x_y')").count() == 1
    assert spark.sql("select sval from t_find_value('IO NO', ignore_case => false)").collect()[0]["sval"] == "IO NO"


def test_lateral_calls_go_with_each_anchor(spark, tools):
    cells, _ = tools
    anchors = cells.select("workbook_id", "sheet", address.address(F.col("r"), F.col("c")).alias("addr"))
    anchors.createOrReplaceTempView("t_anchors")
    got = spark.sql("select a.sheet, a.addr, v.sval from t_anchors a left join lateral t_read_relative(a.workbook_id, a.sheet, a.addr, 1, -2) v")
    assert rows(got) == rows(read.read_relative(cells, anchors, 1, -2), ["sheet", "addr", "sval"])


def test_addresses_in_sql(spark, tools):
    found = spark.sql("select t_cell_address(12, c) as addr, c from (select explode(sequence(1, 16384, 37)) as c)")
    assert found.select(F.col("addr") == address.address(F.lit(12), F.col("c")), F.expr("t_cell_column(addr) = c and t_cell_row(addr) = 12")).distinct().collect() == [(True, True)]


def test_filters_reach_the_stored_cells(spark, tools, tmp_path):
    tools[0].write.parquet(str(tmp_path / "cells"))
    sql.register(spark, spark.read.parquet(str(tmp_path / "cells")), tools[1], "p_")
    plan = spark.sql("select sval from p_read_range(2, 4, 1, 3) where sheet = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(r,2)" in plan and "Filter" in plan and "dval" not in plan.split("ReadSchema")[1]
