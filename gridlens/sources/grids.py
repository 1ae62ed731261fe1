"""Grids derived from the star-schema tables, in the long form every operator reads.

cells: one row for each non-empty cell. Sheets are bounded by their key (a customer, a supplier, a part), so a sheet is
never large and the number of sheets and workbooks grows with the data. The SQL is plain enough for Spark and DuckDB alike; the
oracles use the same text, so both sides start from the same cells.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.session import SHEET, discard, stamp, stored, table

CELL_COLUMNS = "workbook_id, sheet, r, c, dtype, sval, nval, dval"

_ORDER_ROWS = """
go_lines as (
  select o_custkey as cust, o_orderkey as ord, 1 as kind, l_linenumber as ln, l_partkey as part, l_suppkey as supp, l_extendedprice as price,
    l_returnflag || l_linestatus as color, l_quantity as qty, cast(l_shipdate as date) as ship
  from orders join lineitem on l_orderkey = o_orderkey
), go_parts as (
  select * from go_lines
  union all select distinct cust, ord, 0, 0, cast(0 as bigint), cast(0 as bigint), cast(0 as double), cast(null as string), cast(null as double), cast(null as date) from go_lines where ord % 50 = 0
  union all select cust, ord, 2, 0, cast(0 as bigint), cast(0 as bigint), cast(0 as double), cast(null as string), sum(qty), cast(null as date) from go_lines group by cust, ord
  union all select cust, max(ord), 3, 0, cast(0 as bigint), cast(0 as bigint), cast(0 as double), cast(null as string), sum(qty), cast(null as date) from go_lines group by cust
), go_rows as (
  select *, cast(1 + row_number() over (partition by cust order by ord, kind, ln, part, supp, price, color, qty, ship) as int) as r,
    row_number() over (partition by cust, ord, kind order by ln, part, supp, price, color, qty, ship) as k from go_parts
), go_heads as (
  select cust, 1 as r from go_rows where r = 2 union all select cust, r from go_rows where kind = 0
)"""
#: A workbook of orders holds fifty customers.
ORDER_BOOK = "'orders ' || cast(cast(floor(cust / 50) as bigint) as string)"
_SHEET = f"{ORDER_BOOK} as workbook_id, 'C' || cast(cust as string) as sheet"


def _text(sheet: str, column: int, value: str, where: str, source: str = "go_rows") -> str:
    return f"select {sheet}, r, {column} as c, 'str' as dtype, {value} as sval, cast(null as double) as nval, cast(null as timestamp) as dval from {source} {where}"


def _number(sheet: str, column: int, value: str, where: str, source: str = "go_rows", kind: str = "int") -> str:
    tail = " || '.0'" if kind == "float" else ""
    return f"select {sheet}, r, {column} as c, '{kind}' as dtype, cast(cast({value} as bigint) as string){tail} as sval, cast({value} as double) as nval, cast(null as timestamp) as dval from {source} {where}"


def _date(sheet: str, column: int, value: str, where: str, source: str = "go_rows") -> str:
    return f"select {sheet}, r, {column} as c, 'date' as dtype, cast({value} as string) || ' 00:00:00' as sval, cast(null as double) as nval, cast({value} as timestamp) as dval from {source} {where}"


_GO_CELLS = "\n union all ".join(
    [_text(_SHEET, c, f"'{h}'", "", "go_heads") for c, h in enumerate(["IO NO", "STYLE", "COLOR", "ORDER QTY", "EX FAC DATE"], 1)]
    + [
        _number(_SHEET, 1, "ord", "where kind = 1 and k = 1"), _text(_SHEET, 2, "'P' || cast(part as string)", "where kind = 1"), _text(_SHEET, 3, "color", "where kind = 1"),
        _number(_SHEET, 4, "qty", "where kind > 0", kind="float"), _date(_SHEET, 5, "ship", "where kind = 1"),
    ]
)
#: The same rows for Spark, one for each line: where it stands, and what other rows come before (a header) and after it (totals).
#: `base` is the row before the line's own rows; lines of a sheet are brought together once, and all windows share that order.
_GO_LINES = f"""
lines as (
  select {_SHEET.replace("cust", "o_custkey")}, o_orderkey as ord, l_linenumber as ln, l_partkey as part, l_suppkey as supp, l_extendedprice as price,
    l_returnflag || l_linestatus as color, l_quantity as qty, cast(l_shipdate as date) as ship
  from orders join lineitem on l_orderkey = o_orderkey
), dealt as (
  select /*+ REPARTITION({{buckets}}, workbook_id, sheet) */ * from lines
), placed as (
  select *, row_number() over (partition by workbook_id, sheet, ord order by ln, part, supp, price, color, qty, ship) as k, count(*) over (partition by workbook_id, sheet, ord) as n,
    sum(qty) over (partition by workbook_id, sheet, ord) as order_qty, sum(qty) over (partition by workbook_id, sheet) as sheet_qty, max(ord) over (partition by workbook_id, sheet) as last_ord
  from dealt
), counted as (
  select *, k = 1 and ord % 50 = 0 as headed, k = n as closes, k = n and ord = last_ord as ends from placed
)
select workbook_id, sheet, ord, k, n, part, color, qty, ship, order_qty, sheet_qty, headed, closes, ends,
  cast(1 + sum(1 + int(headed) + int(closes) + int(ends)) over (partition by workbook_id, sheet order by ord, ln, part, supp, price, color, qty, ship rows between unbounded preceding and current row) - 1 - int(closes) - int(ends) as int) + 1 as r,
  row_number() over (partition by workbook_id, sheet order by ord, ln, part, supp, price, color, qty, ship) = 1 as first from counted"""


def _one(c: int, dtype: str, head: str, sval: str, nval: str = "null", dval: str = "null") -> str:
    is_head = "kind < 2"
    return f"""named_struct('c', {c}, 'dtype', if({is_head}, 'str', '{dtype}'), 'sval', if({is_head}, '{head}', {sval}), 'nval', if({is_head}, cast(null as double), cast({nval} as double)), 'dval', if({is_head}, cast(null as timestamp), cast({dval} as timestamp)))"""


#: The cells of each line with the rows around it: a first header (kind 0), another header (1), the line (2), the totals of its order (3) and sheet (4).
_GO_INLINE = f"""
select workbook_id, sheet, r, x.c, x.dtype, x.sval, x.nval, x.dval from (
  select workbook_id, sheet, case kind when 0 then 1 when 1 then r - 1 when 2 then r when 3 then r + 1 else r + 2 end as r, explode(array(
    {_one(1, "int", "IO NO", "if(kind = 2 and k = 1, cast(ord as string), null)", "ord")}, {_one(2, "str", "STYLE", "if(kind = 2, 'P' || cast(part as string), null)")}, {_one(3, "str", "COLOR", "if(kind = 2, color, null)")},
    {_one(4, "float", "ORDER QTY", "cast(cast(amount as bigint) as string) || '.0'", "amount")}, {_one(5, "date", "EX FAC DATE", "if(kind = 2, cast(ship as string) || ' 00:00:00', null)", dval="ship")}
  )) as x
  from (select *, case kind when 2 then qty when 3 then order_qty when 4 then sheet_qty end as amount from (
    select *, explode(concat(if(first, array(0), array()), if(headed, array(1), array()), array(2), if(closes, array(3), array()), if(ends, array(4), array()))) as kind from {{lines}}))
) where x.sval is not null"""
_KEY_SHEET = "'customers' as workbook_id, 'K' || cast(c_custkey as string) as sheet"
_GK_ROWS = ", ".join(["gk as (select * from customer join nation on n_nationkey = c_nationkey)"] + [f"gk{r} as (select *, {r} as r from gk)" for r in (2, 4, 5, 7, 8)])
_GK_CELLS = "\n union all ".join(
    [_text(_KEY_SHEET, 1, f"'{label}'", "", f"gk{r}") for r, label in ((2, "Job No"), (4, "Quantity"), (5, "Style"), (7, "Fabric"), (8, "Order Qty"))]
    + [
        _number(_KEY_SHEET, 2, "c_custkey", "", "gk2"), _number(_KEY_SHEET, 2, "floor(abs(c_acctbal))", "", "gk4"), _text(_KEY_SHEET, 2, "c_mktsegment", "", "gk5"),
        _text(_KEY_SHEET, 2, "n_name", "where c_custkey % 3 <> 0", "gk7"), _number(_KEY_SHEET, 1, "c_nationkey + 100", "where c_custkey % 4 = 0", "(select *, 9 as r from gk) x"),
    ]
)
_BAND_SHEET = "'bands' as workbook_id, 'B' || cast(b as string) as sheet"
_GB_ROWS = """
gb_lines as (
  select l_partkey as b, cast(l_shipdate as date) as d, row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) as k from lineitem
), gb as (select b, d, cast(3 + k as int) as r, k from gb_lines), gb1 as (select distinct b, 2 as r from gb), gb2 as (select distinct b, 3 as r from gb)"""
_STAGES = ("CUTTING", "SEWING", "PACKING")
_GB_CELLS = "\n union all ".join(
    [_text(_BAND_SHEET, 1, "'IO NO'", "", "gb1"), _text(_BAND_SHEET, 2, "'REMARK'", "", "gb1"), _number(_BAND_SHEET, 1, "b * 10 + k", "", "gb")]
    + [_text(_BAND_SHEET, 3 + 2 * i, f"'{s}'", "", "gb1") for i, s in enumerate(_STAGES)]
    + [_text(_BAND_SHEET, 3 + 2 * i + j, f"'{s}'", "", "gb2") for i in range(3) for j, s in enumerate(("Plan", "Actual"))]
    + [_date(_BAND_SHEET, 3 + 2 * i + j, f"date_add(d, {7 * i + 2 * j})", f"where (b + k + {i}) % 7 <> {j * 3}", "gb") for i in range(3) for j in (0, 1)]
)
_BAND_HEADS = {1: ("'IO NO'", "null"), 2: ("'REMARK'", "null")} | {3 + 2 * i + j: (f"'{s}'" if j == 0 else "null", f"'{n}'") for i, s in enumerate(_STAGES) for j, n in enumerate(("Plan", "Actual"))}


def _band_cell(c: int) -> str:
    (top, below), (i, j) = _BAND_HEADS[c], divmod(c - 3, 2)
    day = f"date_add(d, {7 * i + 2 * j})"
    text = "cast(b * 10 + k as string)" if c == 1 else "null" if c == 2 else f"if((b + k + {i}) % 7 <> {j * 3}, cast({day} as string) || ' 00:00:00', null)"
    number, time = "cast(b * 10 + k as double)" if c == 1 else "null", "null" if c < 3 else f"cast({day} as timestamp)"
    return f"""named_struct('c', {c}, 'dtype', case when kind < 2 then 'str' else '{"int" if c == 1 else "date"}' end, 'sval', cast(case kind when 0 then {top} when 1 then {below} else {text} end as string), 'nval', cast(if(kind = 2, {number}, null) as double), 'dval', cast(if(kind = 2, {time}, null) as timestamp))"""


#: The name of the one workbook as a column, not a constant: the planner would put the constant in its place and no longer see that lines lie by sheet.
_BAND_LINES = _BAND_SHEET.replace("cast(b ", "cast(l_partkey ").replace("'bands' as", "left(concat_ws('', 'bands', cast(l_partkey as string)), 5) as")
#: The same cells for Spark in one pass over the lines, brought together by sheet once; the two header rows (kinds 0 and 1) come with the first line.
_GB_INLINE = f"""
, dealt as (
  select /*+ REPARTITION({{buckets}}, workbook_id, sheet) */ * from (select {_BAND_LINES}, l_partkey as b, cast(l_shipdate as date) as d, l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity from lineitem)
), counted as (
  select workbook_id, sheet, b, d, row_number() over (partition by workbook_id, sheet order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) as k from dealt
)
select workbook_id, sheet, r, x.c, x.dtype, x.sval, x.nval, x.dval from (
  select workbook_id, sheet, case kind when 0 then 2 when 1 then 3 else cast(3 + k as int) end as r, explode(array({", ".join(_band_cell(c) for c in range(1, 9))})) as x
  from (select *, explode(if(k = 1, array(0, 1, 2), array(2))) as kind from counted)
) where x.sval is not null"""
#: A sheet of blocks holds twenty suppliers.
_BLOCK_SHEET = "'blocks' as workbook_id, 'N' || cast(n as string) as sheet"
_GS_ROWS = """
gs as (select cast(floor(s_suppkey / 20) as bigint) as n, s_suppkey as s, floor(abs(s_acctbal)) as bal, cast(1 + 5 * (row_number() over (partition by floor(s_suppkey / 20) order by s_suppkey) - 1) as int) as r0 from supplier),
gs0 as (select *, r0 + 1 as r from gs), gs1 as (select *, r0 + 2 as r from gs), gs2 as (select *, r0 + 3 as r from gs where s % 2 = 0)"""
_GS_CELLS = "\n union all ".join(
    [_number(_BLOCK_SHEET, 1, "s", "", "gs0"), _text(_BLOCK_SHEET, 2, "'Qty'", "", "gs1"), _number(_BLOCK_SHEET, 3, "bal", "", "gs1"), _text(_BLOCK_SHEET, 2, "'Style'", "", "gs2"), _text(_BLOCK_SHEET, 3, "'S' || cast(s as string)", "", "gs2")]
)

#: The same blocks under an identity header, which makes them items of their own; a workbook holds ten sheets.
_SECTION_SHEET = "'sections ' || cast(cast(floor(n / 10) as bigint) as string) as workbook_id, 'N' || cast(n as string) as sheet"
_SECTION_CELLS = _GS_CELLS.replace(_BLOCK_SHEET, _SECTION_SHEET) + "\n union all " + _text(_SECTION_SHEET, 1, "'IO NO'", "", "gs_heads")

_GRIDS = {"orders": (_ORDER_ROWS, _GO_CELLS, "orders lineitem"), "customers": (_GK_ROWS, _GK_CELLS, "customer nation"), "bands": (_GB_ROWS, _GB_CELLS, "lineitem"), "blocks": (_GS_ROWS, _GS_CELLS, "supplier"),
    "sections": (_GS_ROWS + ", gs_heads as (select distinct n, 1 as r from gs)", _SECTION_CELLS, "supplier")}
#: Merged regions of the order grid: the identity cell over all lines of an order with two lines or more.
_MERGES = f"select {_SHEET}, min(r) as r1, 1 as c1, max(r) as r2, 1 as c2 from go_rows where kind = 1 group by cust, ord having count(*) > 1"


def cells_sql(name: str) -> str:
    """Named queries (without `with`) up to `cells`, for DuckDB: date_add differs there and is written as a sum."""
    rows, cells, _ = _GRIDS[name]
    text = f"{rows.strip()}, cells as ({cells})"
    return re.sub(r"cast\(date_add\(d, (\d+)\) as", r"cast(d + \1 as", text)


def merges_sql() -> str:
    return f"merges as ({_MERGES})"


def _query(spark: SparkSession, sf_dir: str, name: str, last: str) -> DataFrame:
    """The text with its tables as arguments, so that nothing is registered in the session."""
    tables = {t: table(spark, sf_dir, t) for t in _GRIDS[name][2].split()}
    text = f"with {_GRIDS[name][0].strip()} {last}"
    for t in tables:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text.replace("{buckets}", str(buckets(spark, sf_dir))), **tables)


_KEPT: dict[tuple, DataFrame] = {}
_INLINE = {"bands": _GB_INLINE}
#: Input bytes for each bucket of sheets, as Parquet: some hundred thousands of cells.
BUCKET = 2 << 20
_ALL = "customer lineitem nation orders supplier"


def _stamps(spark: SparkSession, sf_dir: str, tables: str) -> tuple:
    return tuple(stamp(spark, f"{sf_dir}/{t}.parquet") for t in tables.split())


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """In how many buckets the sheets are stored: their number grows with the input, their size does not."""
    total = sum(size for files in _stamps(spark, sf_dir, "lineitem orders") for _, size, _ in files)
    return max(spark.sparkContext.defaultParallelism, -(-total // BUCKET))


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], tables: str = _ALL) -> DataFrame:
    """A grid or a plan over it as a stored table: written once in a session, and again if the files under it have changed. What has sheets is stored in buckets of them."""
    key = spark.sparkContext.applicationId, sf_dir, name, _stamps(spark, sf_dir, tables)
    if key not in _KEPT:
        _KEPT[key] = stored(make(), buckets(spark, sf_dir))
    return _KEPT[key]


def release(spark: SparkSession) -> None:
    """Forgets the stored grids and plans of a session and deletes them."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        del _KEPT[key]
    discard(spark)


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the order grid with their rows, from one join."""

    def make() -> DataFrame:
        text = _GO_LINES.strip().replace("{buckets}", str(buckets(spark, sf_dir)))
        return spark.sql("with " + re.sub(r"\b(from|join) (orders|lineitem)\b", r"\1 {\2}", text), orders=table(spark, sf_dir, "orders"), lineitem=table(spark, sf_dir, "lineitem"))

    return kept(spark, sf_dir, "order lines", make, "orders lineitem")


def cells(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The cells of one of the grids: orders, customers, bands, blocks or sections."""
    make = (lambda: spark.sql(_GO_INLINE, lines=_order_lines(spark, sf_dir))) if name == "orders" else (lambda: _query(spark, sf_dir, name, _INLINE.get(name, _GRIDS[name][1])))
    return kept(spark, sf_dir, f"cells {name}", make, _GRIDS[name][2])


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged regions of the order grid."""
    regions = lambda: _order_lines(spark, sf_dir).where("k = 1 and n > 1").selectExpr(*SHEET, "r as r1", "1 as c1", "cast(r + n - 1 as int) as r2", "1 as c2")
    return kept(spark, sf_dir, "merges", regions, _GRIDS["orders"][2])


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each sheet of the order grid."""
    return kept(spark, sf_dir, "extents", lambda: cells(spark, sf_dir, "orders").groupBy(*SHEET).agg(F.max("r").alias("max_row")), _GRIDS["orders"][2])


def no_merges(spark: SparkSession) -> DataFrame:
    """No regions, for grids without any: known to be empty when a query is planned, so what would look through regions goes."""
    return spark.sql("select '' as workbook_id, '' as sheet, 0 as r1, 0 as c1, 0 as r2, 0 as c2 where false")
