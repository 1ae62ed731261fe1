"""The read tools as SQL: table functions in the session's catalog, over the cells and regions of a grid.

`register` makes them under a prefix; a call is a subquery to the planner, so filters and columns reach the stored cells as
they do in the DataFrame operators, and LATERAL calls a tool for each row of a table:

    select * from grid_find_value('fabric', max_hits => 3)
    select a.*, v.sval from anchors a, lateral grid_read_relative(a.workbook_id, a.sheet, a.addr, 1, 0) v
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CELL = "workbook_id string, sheet string, r int, c int, dtype string, sval string, nval double, dval timestamp"
_CELL = ", ".join(f.split()[0] for f in CELL.split(", "))

#: Row and column of an address. Table functions hold them as expressions, not as calls: in a LATERAL call a scalar function makes the
#: planner gather the addresses of all sheets and join them with the cells of all sheets, by row and column alone.
_ROW_OF = "cast(regexp_extract({}, '[0-9]+$', 0) as int)"
_COLUMN_OF = "aggregate(filter(split(upper(regexp_extract({}, '^[A-Za-z]+', 0)), ''), x -> x <> ''), 0, (n, x) -> n * 26 + ascii(x) - 64)"

#: Scalar functions: name, parameters, type, expression.
SCALARS = [
    (
        "cell_address", "row int, col int", "string",
        "case when col <= 26 then chr(64 + col) when col <= 702 then chr(64 + (col - 1) div 26) || chr(65 + (col - 1) % 26)"
        " else chr(64 + ((col - 1) div 26 - 1) div 26) || chr(65 + ((col - 1) div 26 - 1) % 26) || chr(65 + (col - 1) % 26) end || cast(row as string)",
    ),
    ("cell_row", "addr string", "int", _ROW_OF.format("addr")),
    ("cell_column", "addr string", "int", _COLUMN_OF.format("addr")),
]

#: Table functions: name, parameters, columns, query over {cells} and {merges}, with {p} before the names of other functions.
TABLES = [
    ("list_sheets", "", "workbook_id string, sheet string, max_row int, max_col int, dimensions string", "select workbook_id, sheet, max(r), max(c), 'A1:' || {p}cell_address(max(r), max(c)) from {cells} group by workbook_id, sheet"),
    ("workbook_summary", "", "workbook_id string, sheet_count bigint, first_sheet string, last_sheet string, cell_count bigint", "select workbook_id, count(distinct sheet), min(sheet), max(sheet), count(*) from {cells} group by workbook_id"),
    ("peek_sheet", "max_rows int default 10, max_cols int default 15", CELL, f"select {_CELL} from {{cells}} where r <= max_rows and c <= max_cols"),
    ("read_range", "r1 int, r2 int, c1 int, c2 int", CELL, f"select {_CELL} from {{cells}} where r between r1 and r2 and c between c1 and c2"),
    ("read_row", "at_row int, c1 int default 1, c2 int default 16384", CELL, f"select {_CELL} from {{cells}} where r = at_row and c between c1 and c2"),
    ("get_cell_at", "at_addr string", CELL, f"select {_CELL} from {{cells}} where r = {_ROW_OF.format('at_addr')} and c = {_COLUMN_OF.format('at_addr')}"),
    (
        "sample_rows", "indices array<int>", "workbook_id string, sheet string, pos int, row int, values array<string>",
        "select s.workbook_id, s.sheet, i.pos, i.row, coalesce(v.held, array()) from (select distinct workbook_id, sheet from {cells}) s cross join (select posexplode(indices) as (pos, row)) i"
        " left join (select workbook_id, sheet, r, transform(array_sort(collect_list(struct(c, sval))), x -> concat_ws(':', cast(x.c as string), x.sval)) as held from {cells} where array_contains(indices, r) group by workbook_id, sheet, r) v"
        " on v.workbook_id = s.workbook_id and v.sheet = s.sheet and v.r = i.row",
    ),
    ("read_relative", "in_book string, in_sheet string, addr string, dy int, dx int", "r int, c int, dtype string, sval string", f"select r, c, dtype, sval from {{cells}} where workbook_id = in_book and sheet = in_sheet and r = {_ROW_OF.format('addr')} + dy and c = {_COLUMN_OF.format('addr')} + dx"),
    (
        "get_merged_regions", "", "workbook_id string, sheet string, range string, anchor string, anchor_value string",
        "select m.workbook_id, m.sheet, {p}cell_address(m.r1, m.c1) || ':' || {p}cell_address(m.r2, m.c2), {p}cell_address(m.r1, m.c1), a.sval from {merges} m"
        " left join {cells} a on a.workbook_id = m.workbook_id and a.sheet = m.sheet and a.r = m.r1 and a.c = m.c1",
    ),
    ("count_non_empty_rows_in_column", "in_column int, r1 int default 1, r2 int default 1048576", "workbook_id string, sheet string, n bigint", "select workbook_id, sheet, count_if(here) from (select workbook_id, sheet, c = in_column and r between r1 and r2 as here from {cells}) group by workbook_id, sheet"),
    (
        "find_value", "needle string, max_hits int default 10, ignore_case boolean default true", f"{CELL}, hit int",
        f"select {_CELL}, hit from (select *, row_number() over (partition by workbook_id, sheet order by r, c) as hit from {{cells}} where contains(if(ignore_case, lower(sval), sval), if(ignore_case, lower(needle), needle))) where hit <= max_hits",
    ),
]


def register(spark: SparkSession, cells: DataFrame, merges: DataFrame, prefix: str = "grid_") -> list[str]:
    """Registers the tools under a prefix for a grid, in this session only, in place of those of the same prefix; gives their names."""
    views = {"cells": f"{prefix}cells", "merges": f"{prefix}merges", "p": prefix}
    cells.select(*_CELL.split(", ")).createOrReplaceTempView(views["cells"])
    merges.createOrReplaceTempView(views["merges"])
    for name, parameters, kind, text in SCALARS:
        spark.sql(f"create or replace temporary function {prefix}{name}({parameters}) returns {kind} return {text}")
    for name, parameters, columns, text in TABLES:
        spark.sql(f"create or replace temporary function {prefix}{name}({parameters}) returns table({columns}) return {text.format(**views)}")
    return [prefix + name for name, *_ in [*SCALARS, *TABLES]]
