"""Queries over reads and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions import address, scalars
from gridlens.operators import read, sql
from gridlens.plans.registry import registry
from gridlens.session import table
from gridlens.sources import grids

QUERIES, query = registry()
GO = f"with {grids.cells_sql('orders')}"
GOM = f"{GO}, {grids.merges_sql()}"
GK = f"with {grids.cells_sql('customers')}"
GB = f"with {grids.cells_sql('bands')}"
GS = f"with {grids.cells_sql('blocks')}"
GX = f"with {grids.cells_sql('sections')}"
_A1 = "chr(cast(64 + c as int)) || cast(r as varchar)"


@query(f"{GO} select sheet, r, c, {_A1} as addr, dtype, sval, cast(nval as double) as nval from cells")
def grid_cells(spark, sf):
    return read.with_address(grids.cells(spark, sf, "orders")).select("sheet", "r", "c", "addr", "dtype", "sval", "nval")


@query(f"{GO} select sheet, max(r) as max_row, max(c) as max_col, 'A1:' || chr(cast(64 + max(c) as int)) || cast(max(r) as varchar) as dimensions from cells group by sheet")
def sheet_list(spark, sf):
    return read.sheets(grids.cells(spark, sf, "orders")).select("sheet", "max_row", "max_col", "dimensions")


@query(f"{GO} select workbook_id, count(distinct sheet) as sheet_count, min(sheet) as first_sheet, max(sheet) as last_sheet, count(*) as cell_count from cells group by workbook_id")
def workbook_summary(spark, sf):
    return read.workbooks(grids.cells(spark, sf, "orders"))


@query(f"{GO} select sheet, r, c, sval from cells where r <= 10 and c <= 3")
def peek(spark, sf):
    return read.peek(grids.cells(spark, sf, "orders"), 10, 3).select("sheet", "r", "c", "sval")


@query(f"{GO} select sheet, r, c, sval from cells where r between 3 and 8 and c between 2 and 4")
def read_range(spark, sf):
    return read.read_range(grids.cells(spark, sf, "orders"), (3, 8), (2, 4)).select("sheet", "r", "c", "sval")


@query(f"{GO} select sheet, c, sval from cells where r = 2 and c between 1 and 4")
def read_row(spark, sf):
    return read.read_row(grids.cells(spark, sf, "orders"), 2, (1, 4)).select("sheet", "c", "sval")


@query(f"{GO}, asked(pos, r) as (values (0, 3), (1, 1), (2, 3), (3, 90)), names as (select distinct sheet from cells) select n.sheet, a.pos, a.r as \"row\", coalesce(string_agg(cast(c.c as varchar) || ':' || c.sval, '|' order by c.c), '') as vals from names n cross join asked a left join cells c on c.sheet = n.sheet and c.r = a.r group by n.sheet, a.pos, a.r")
def sample_rows(spark, sf):
    found = read.sample_rows(grids.cells(spark, sf, "orders"), [3, 1, 3, 90])
    return found.select("sheet", "pos", "row", F.array_join("values", "|").alias("vals"))


@query(f"{GO} select a.sheet, a.addr, b.sval from (select sheet, r, {_A1} as addr from cells where c = 1) a left join (select sheet, r - 1 as r, sval from cells where c = 3) b on b.sheet = a.sheet and b.r = a.r")
def rel_cell(spark, sf):
    cells = grids.cells(spark, sf, "orders")
    anchors = read.with_address(cells.where("c = 1")).select("workbook_id", "sheet", "addr")
    return read.read_relative(cells, anchors, 1, 2).select("sheet", "addr", "sval")


@query(f"{GO} select sheet, dtype, sval from cells where r = 4 and c = 4")
def cell_at(spark, sf):
    return read.cell_at(grids.cells(spark, sf, "orders"), "D4").select("sheet", "dtype", "sval")


@query(f"{GOM} select m.sheet, 'A' || cast(r1 as varchar) || ':A' || cast(r2 as varchar) as \"range\", 'A' || cast(r1 as varchar) as anchor, c.sval as anchor_value from merges m left join cells c on c.sheet = m.sheet and c.r = m.r1 and c.c = 1")
def merged_regions(spark, sf):
    return read.merged_regions(grids.cells(spark, sf, "orders"), grids.merges(spark, sf)).select("sheet", "range", "anchor", "anchor_value")


@query(f"{GO} select sheet, cast(count(*) filter (c = 1 and r between 2 and 40) as bigint) as n from cells group by sheet")
def count_non_empty(spark, sf):
    return read.count_non_empty(grids.cells(spark, sf, "orders"), 1, (2, 40)).select("sheet", "n")


@query(f"{GO} select sheet, r, c, sval, hit from (select sheet, r, c, sval, row_number() over (partition by sheet order by r, c) as hit from cells where contains(lower(sval), 'p1')) x where hit <= 10")
def find_value(spark, sf):
    return read.find_value(grids.cells(spark, sf, "orders"), "P1").select("sheet", "r", "c", "sval", "hit")


@query(f"""{GOM}, seen as (
  select c.sheet, c.r, c.c, c.sval, {_A1.replace('r as', 'c.r as').replace('+ c', '+ c.c')} as addr from cells c
  union all select m.sheet, x.r, m.c1, a.sval, 'A' || cast(m.r1 as varchar) from merges m join (select distinct sheet, r from cells) x on x.sheet = m.sheet and x.r between m.r1 and m.r2
    join cells a on a.sheet = m.sheet and a.r = m.r1 and a.c = 1 where not exists (select 1 from cells o where o.sheet = m.sheet and o.r = x.r and o.c = 1)
) select sheet, r, c, sval, addr from seen where c = 1""")
def merge_lookup(spark, sf):
    cells = grids.cells(spark, sf, "orders")
    extents = grids.extents(spark, sf)
    places = extents.select(*grids.SHEET, F.explode(F.sequence(F.lit(1), "max_row")).alias("r"), F.lit(1).alias("c"))
    return read.look(cells, grids.merges(spark, sf), places, extents.select(*grids.SHEET, F.lit(1).alias("c"))).select("sheet", "r", "c", "sval", "addr")


@query("select p_partkey, p_name, trim(regexp_replace(lower('  ' || p_type || chr(9) || p_brand || ' '), '\\s+', ' ', 'g')) as norm from part")
def norm_text(spark, sf):
    raw = F.concat(F.lit("  "), F.col("p_type"), F.lit("\t"), F.col("p_brand"), F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", "p_name", scalars.norm(raw).alias("norm"))


_LETTERS = "case when n < 26 then chr(cast(65 + n as int)) when n < 702 then chr(cast(64 + n // 26 as int)) || chr(cast(65 + n % 26 as int)) else chr(cast(64 + (n // 26 - 1) // 26 as int)) || chr(cast(65 + (n // 26 - 1) % 26 as int)) || chr(cast(65 + n % 26 as int)) end"


@query(f"select p_partkey, {_LETTERS} || cast(p_partkey as varchar) as addr, p_partkey % 2000 + 1 as back_col, p_partkey as back_row from (select *, p_partkey % 2000 as n from part) p")
def a1_codec(spark, sf):
    addr = address.address(F.col("p_partkey"), F.col("p_partkey") % 2000 + 1)
    return table(spark, sf, "part").select("p_partkey", addr.alias("addr")).withColumns({"back_col": address.column_of(F.col("addr")).cast("long"), "back_row": address.row_of(F.col("addr")).cast("long")})


_SHAPES = ["dd-MMM-yyyy", "dd-MMM-yy", "dd MMM yyyy", "dd/MM/yyyy", "dd/MM/yy", "dd.MM.yyyy", "dd-MM-yyyy", "yyyy-MM-dd"]


@query("select l_orderkey, l_linenumber, l_partkey, case when l_orderkey % 9 = 8 then null else cast(l_shipdate as date) end as d from lineitem")
def flex_date(spark, sf):
    shown = F.lit("no date")
    for k, shape in enumerate(_SHAPES):
        shown = F.when(F.col("l_orderkey") % 9 == k, F.date_format("l_shipdate", shape)).otherwise(shown)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.flexible_date(F.concat(F.lit(" "), shown, F.lit(" "))).alias("d"))


@query(f"{GO} select sheet, r, c, case when dtype = 'float' then cast(cast(nval as bigint) as varchar) else sval end as as_text, case when dtype in ('int', 'float') then cast(trunc(nval) as bigint) end as as_int from cells")
def coerce_fields(spark, sf):
    kinds = F.col("dtype"), F.col("sval"), F.col("nval")
    return grids.cells(spark, sf, "orders").select("sheet", "r", "c", scalars.coerce_text(*kinds).alias("as_text"), scalars.coerce_int(*kinds).alias("as_int"))


@query("select l_orderkey, l_linenumber, l_partkey, l_orderkey % 3 <> 2 as same from lineitem")
def values_equal(spark, sf):
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    other = F.when(F.col("l_orderkey") % 3 == 0, F.concat(day, F.lit(" 00:00:00"))).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit(" "), day)).otherwise(F.lit("1900-01-01"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.values_equal(day, other).alias("same"))


def _tools(spark, sf):
    """The tools as SQL functions over the order grid."""
    sql.register(spark, grids.cells(spark, sf, "orders"), grids.merges(spark, sf), "orders_")


@query(f"{GO} select sheet, r, c, sval, cast(k as int) as hit from (select *, row_number() over (partition by sheet order by r, c) as k from cells where contains(lower(sval), 'p1')) x where k <= 3")
def sql_find_value(spark, sf):
    _tools(spark, sf)
    return spark.sql("select sheet, r, c, sval, hit from orders_find_value('P1', max_hits => 3)")


@query(f"{GOM} select m.sheet, 'A' || cast(m.r1 as varchar) || ':A' || cast(m.r2 as varchar) as range, a.sval as anchor_value, b.sval as beside from merges m left join cells a on a.sheet = m.sheet and a.r = m.r1 and a.c = m.c1 left join cells b on b.sheet = m.sheet and b.r = m.r1 and b.c = 2")
def sql_merged_and_beside(spark, sf):
    """Each region with its anchor's value and, by a lateral call, the cell right of the anchor."""
    _tools(spark, sf)
    return spark.sql("select m.sheet, m.range, m.anchor_value, v.sval as beside from orders_get_merged_regions() m left join lateral orders_read_relative(m.workbook_id, m.sheet, m.anchor, 0, 1) v")


@query(f"{GO} select sheet, count(*) filter (c = 4 and r between 2 and 40) as n from cells group by sheet")
def sql_count_column(spark, sf):
    _tools(spark, sf)
    return spark.sql("select sheet, n from orders_count_non_empty_rows_in_column(4, 2, 40)")


@query(f"{GO}, ids(p, \"row\") as (values (0, 3), (1, 1), (2, 3)), named as (select distinct sheet from cells) select n.sheet, cast(p as int) as pos, cast(i.\"row\" as int) as \"row\", coalesce(string_agg(cast(c.c as varchar) || ':' || c.sval, '|' order by c.c), '') as shown from named n cross join ids i left join cells c on c.sheet = n.sheet and c.r = i.\"row\" group by n.sheet, p, i.\"row\"")
def sql_sample_rows(spark, sf):
    _tools(spark, sf)
    return spark.sql("select sheet, pos, row, array_join(values, '|') as shown from orders_sample_rows(array(3, 1, 3))")
