"""Queries over bands, names, items and stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions import vocab
from gridlens.operators import apply, bands, extract, kv, naming, rows, survey
from gridlens.operators import plan as planning
from gridlens.plans.read_queries import GB, GK, GO
from gridlens.plans.registry import registry
from gridlens.plans.survey_queries import BOUNDS, KEYS, ROLES, SECTION_BOUNDS, order_roles
from gridlens.session import stored, table
from gridlens.sources import grids

QUERIES, query = registry()
_SUBS = ", ".join(f"'{x}'" for x in vocab.SUB_LABELS)
_PROBE = f"""d as (select sheet, r, c from cells where dtype = 'date'), t as (select sheet, r, c, sval, lower(sval) in ({_SUBS}) as is_sub from cells where dtype = 'str'),
facts as (select d.sheet, d.r, list(d.c order by d.c) as cols, count(t1.c) as s1, count(t2.c) as s2, coalesce(bool_and(t1.is_sub), false) as only_sub
  from d left join t t1 on t1.sheet = d.sheet and t1.r = d.r - 1 and t1.c = d.c left join t t2 on t2.sheet = d.sheet and t2.r = d.r - 2 and t2.c = d.c group by d.sheet, d.r having count(*) >= 2),
probe as (select sheet, r, cols, case when s1 >= greatest(2, len(cols) // 2) then case when only_sub and s2 >= 1 then r - 2 else r - 1 end when s2 >= greatest(2, len(cols) // 2) then r - 2 end as sh from facts)"""
_BANDS = f"""{GB}, {_PROBE}, heads as (select p.sheet, p.r, p.sh, any_value(p.cols) as cols, min(case when not list_contains(p.cols, t.c) then t.c end) as beside, count(*) filter (list_contains(p.cols, t.c)) as n_stage
    from probe p join t on t.sheet = p.sheet and t.r = p.sh where p.sh is not null group by p.sheet, p.r, p.sh),
overs as (select sheet, r + 1 as sh, min(c) as over_c from t group by sheet, r),
cellnames as (select h.*, o.over_c, case when beside is not null then chr(cast(64 + beside as int)) || cast(h.sh as varchar) when over_c is not null then chr(cast(64 + over_c as int)) || cast(h.sh - 1 as varchar) else 'A' || cast(h.sh as varchar) end as name_cell,
    case when beside is not null then h.sh when over_c is not null then h.sh - 1 end as name_r, coalesce(beside, over_c) as name_c from heads h left join overs o on o.sheet = h.sheet and o.sh = h.sh where n_stage > 0),
found as (select * from (select *, row_number() over (partition by sheet, name_cell order by r) as k from cellnames) x where k = 1)"""
_STAGES = f"""{_BANDS}, stages as (select f.sheet, f.r, f.sh, t.sval as stage, max(t.c) as pc from found f join t on t.sheet = f.sheet and t.r = f.sh and list_contains(f.cols, t.c) group by f.sheet, f.r, f.sh, t.sval),
subs as (select s.sheet, s.r, s.stage, l.sval as sub_label, max(l.c) as sub_col from stages s join t l on l.sheet = s.sheet and l.r = s.sh + 1 and l.is_sub and l.c > s.pc
  where not exists (select 1 from stages o where o.sheet = s.sheet and o.r = s.r and (o.pc = l.c or (o.pc > s.pc and o.pc < l.c))) group by s.sheet, s.r, s.stage, l.sval),
kept as (select s.sheet, s.r, s.stage, s.pc, u.sub_label, u.sub_col from stages s left join subs u on u.sheet = s.sheet and u.r = s.r and u.stage = s.stage
  where u.sub_col is not null or not exists (select 1 from subs z where z.sheet = s.sheet and z.r = s.r))"""


def order_items(spark, sf):
    """The items of the order grid, made once."""
    return grids.kept(spark, sf, "order items", lambda: apply.items_by_row(grids.cells(spark, sf, "orders"), grids.merges(spark, sf), order_roles(spark, sf), apply.name_map(spark)))


def _bands(spark, sf):
    cells = grids.cells(spark, sf, "bands")
    none = grids.no_merges(spark)

    def make():
        found = stored(bands.bands(cells), grids.buckets(spark, sf))
        return bands.layouts(found, bands.sub_rows(cells, found))

    return cells, none, grids.kept(spark, sf, "bands laid out", make)


def _stage_columns(spark, sf):
    return grids.kept(spark, sf, "stage columns", lambda: bands.stage_columns(*_bands(spark, sf)))


@query(f"{GB}, {_PROBE} select sheet, r, sh as sub_header, len(cols) as n_dates from probe where sh is not null")
def sub_header_probe(spark, sf):
    return bands.probes(grids.cells(spark, sf, "bands")).select("sheet", "r", "sub_header", F.size("date_cols").cast("long").alias("n_dates"))


@query(f"{_BANDS} select f.sheet, f.r, f.sh as sub_header, f.name_cell, c.sval as title, 'wide_sub_columns' as layout from found f join cells c on c.sheet = f.sheet and c.r = f.name_r and c.c = f.name_c")
def stage_bands(spark, sf):
    return _bands(spark, sf)[2].select("sheet", "r", "sub_header", "name_cell", "title", "layout")


@query(f"{_STAGES} select sheet, r, stage, pc as primary_col, sub_label, sub_col from kept")
def sub_columns_asof(spark, sf):
    return _stage_columns(spark, sf).select("sheet", "r", "stage", "primary_col", "sub_label", "sub_col")


@query(f"""{_STAGES}, data as (select distinct sheet, r from cells where c = 1 and r > 3), stage_heads as (select distinct sheet, stage, pc from kept),
 prim as (select d.sheet, d.r, h.stage, max(case when c.dtype = 'date' then cast(c.dval as date) end) as planned_date from data d join stage_heads h on h.sheet = d.sheet join cells c on c.sheet = d.sheet and c.r = d.r and c.c = h.pc group by d.sheet, d.r, h.stage, h.pc),
 act as (select d.sheet, d.r, k.stage, max(case when c.dtype = 'date' then cast(cast(c.dval as date) as varchar) else c.sval end) as actual from data d join (select distinct sheet, stage, sub_label, sub_col from kept where sub_label = 'Actual') k on k.sheet = d.sheet join cells c on c.sheet = d.sheet and c.r = d.r and c.c = k.sub_col group by d.sheet, d.r, k.stage)
 select p.sheet, p.r, p.stage, p.planned_date, a.actual from prim p left join act a on a.sheet = p.sheet and a.r = p.r and a.stage = p.stage""")
def stages_wide(spark, sf):
    cells, none, _ = _bands(spark, sf)
    data = grids.kept(spark, sf, "band roles", lambda: rows.row_roles(cells, none, buckets=grids.buckets(spark, sf))).where("role in ('anchor', 'child')")
    return apply.stages_wide(cells, none, data, _stage_columns(spark, sf)).select("sheet", "r", "stage", "planned_date", F.try_element_at("metadata", F.lit("actual")).alias("actual"))


@query("select p_partkey, p_brand as raw, case when p_brand = 'Brand#11' then 'io_number' when p_brand = 'Brand#12' then 'style_code' else p_brand end as canonical from part where p_brand <> 'Brand#13'")
def name_map_join(spark, sf):
    names = apply.name_map(spark, {"Brand#11": "io_number", "Brand#12": "style_code", "Brand#13": "ignore"})
    return apply.named(table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("raw")), names).select("p_partkey", "raw", "canonical")


@query(f"""{GO} select 'C' || cast(cust as varchar) as sheet, r, cast(ord as varchar) as io_number, 'P' || cast(part as varchar) as style_code, color as color_code, cast(qty as bigint) as quantity, ship as delivery_date,
 'A' || cast(first_r as varchar) as io_cell from (select *, min(r) over (partition by cust, ord, kind) as first_r from go_rows) x where kind = 1""")
def items_row(spark, sf):
    items = order_items(spark, sf)
    return items.select("sheet", "r", "io_number", "style_code", "color_code", "quantity", "delivery_date", F.try_element_at("cells", F.lit("io_number")).alias("io_cell"))


@query(f"""{GO} select 'C' || cast(cust as varchar) as sheet, count(*) as n_items, cast(sum(qty) as bigint) as quantity from go_rows where kind = 1 group by cust""")
def items_per_sheet(spark, sf):
    items = order_items(spark, sf)
    return items.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_items"), F.sum("quantity").alias("quantity"))


@query(f"""{GK} select 'K' || cast(c_custkey as varchar) as sheet, cast(c_custkey as varchar) as io_number, c_mktsegment as style_code,
 'Order Qty' as fabric_code, case when c_custkey % 4 = 0 then cast(c_nationkey + 100 as bigint) else cast(floor(abs(c_acctbal)) as bigint) end as quantity from gk""")
def items_sheet(spark, sf):
    cells = grids.cells(spark, sf, "customers")
    items = apply.items_by_keys(cells, kv.key_values(cells), apply.name_map(spark), ["workbook_id", "sheet"])
    return items.select("sheet", "io_number", "style_code", "fabric_code", "quantity")


@query(f"""{GK} select 'K' || cast(c_custkey as varchar) as sheet, 'sheet' as mode, cast(c_custkey as varchar) as io_number, c_mktsegment as style_code,
 'Order Qty' as fabric_code, case when c_custkey % 4 = 0 then cast(c_nationkey + 100 as bigint) else cast(floor(abs(c_acctbal)) as bigint) end as quantity, 'B2' as io_cell from gk""")
def extract_key_sheets(spark, sf):
    """The whole flow where a sheet is an item."""

    def make():
        cells = grids.cells(spark, sf, "customers")
        return extract.extract(cells, grids.no_merges(spark), buckets=grids.buckets(spark, sf)).items

    items = grids.kept(spark, sf, "key sheet items", make, "customer nation")
    return items.select("sheet", "mode", "io_number", "style_code", "fabric_code", "quantity", F.try_element_at("cells", F.lit("io_number")).alias("io_cell"))


def _section_results(spark, sf, part):
    """Items or warnings of the whole flow where a block is an item, made once."""

    def make():
        return getattr(extract.extract(grids.cells(spark, sf, "sections"), grids.no_merges(spark), buckets=grids.buckets(spark, sf)), part)

    return grids.kept(spark, sf, f"section results {part}", make, "supplier")


@query(f"""{SECTION_BOUNDS}, {KEYS}, vals as (select b.sheet, b.block_id, k.raw, v.sval, v.nval from bounds b join keys k on k.sheet = b.sheet and k.r between b."start" and b."end" join cells v on v.sheet = k.sheet and v.r = k.r and v.c = 3)
 select b.sheet, 'section' as mode, b.block_id as item, max(case when raw = 'Qty' then cast(nval as bigint) end) as quantity, max(case when raw = 'Style' then sval end) as style_code, b."end" - b."start" + 1 as n_rows
 from bounds b left join vals v on v.sheet = b.sheet and v.block_id = b.block_id group by b.sheet, b.block_id, b."start", b."end" """)
def extract_sections(spark, sf):
    items = _section_results(spark, sf, "items")
    return items.select("sheet", "mode", "item", "quantity", F.coalesce("style_code", "style_name").alias("style_code"), F.size("rows").alias("n_rows"))


@query(f"""{BOUNDS}, {KEYS}, vals as (select b.sheet, b.block_id, k.raw, v.sval, v.nval from bounds b join keys k on k.sheet = b.sheet and k.r between b."start" and b."end" join cells v on v.sheet = k.sheet and v.r = k.r and v.c = 3)
 select sheet, block_id, max(case when raw = 'Qty' then cast(nval as bigint) end) as quantity, max(case when raw = 'Style' then sval end) as style_code from vals group by sheet, block_id""")
def items_section(spark, sf):
    cells = grids.cells(spark, sf, "blocks")
    found = kv.blocks(cells.where("c = 1").select("workbook_id", "sheet", "r"), survey.blank_gaps(cells))
    members = kv.block_members(found, kv.key_values(cells))
    items = apply.items_by_keys(cells, members, apply.name_map(spark), ["workbook_id", "sheet", "block_id"])
    return items.select("sheet", F.col("block_id").cast("long").alias("block_id"), "quantity", "style_code")


@query(f"""{GO}, tops as (select sheet, c, sval from cells where r = 1) select h.sheet, h.c, h.sval as raw, (select string_agg(sval, '|' order by k) from (select c.sval, row_number() over (order by c.r) as k from cells c join roles o on o.sheet = c.sheet and o.r = c.r and o.role in ('anchor', 'child') where c.sheet = h.sheet and c.c = h.c) x where k <= 3) as samples from tops h""".replace("tops as", f"{ROLES}, tops as", 1))
def label_samples(spark, sf):
    cells, roles = grids.cells(spark, sf, "orders"), order_roles(spark, sf)
    found = naming.samples(cells, roles, apply.header_labels(cells, roles))
    return found.select("sheet", "c", "raw", F.array_join("samples", "|").alias("samples"))


def order_results(spark, sf):
    """Items, warnings and workbooks of the whole flow over the order grid, made once."""
    made = {}

    def make(part):
        def run():
            if not made:
                made["r"] = extract.extract(grids.cells(spark, sf, "orders"), grids.merges(spark, sf), buckets=grids.buckets(spark, sf))
            return getattr(made["r"], part)

        return run

    return {part: grids.kept(spark, sf, f"order results {part}", make(part), "orders lineitem") for part in ("items", "warnings", "books")}


@query(f"""{GO} select 'C' || cast(cust as varchar) as sheet, r as item, cast(ord as varchar) as io_number, 'P' || cast(part as varchar) as style, color as color_code, cast(qty as bigint) as quantity, ship as delivery_date,
 'A' || cast(first_r as varchar) as io_cell, cast(r as varchar) as "rows", 0 as n_stages from (select *, min(r) over (partition by cust, ord, kind) as first_r from go_rows) x where kind = 1""")
def extract_items(spark, sf):
    items = order_results(spark, sf)["items"]
    return items.select("sheet", "item", "io_number", F.coalesce("style_code", "style_name").alias("style"), "color_code", "quantity", "delivery_date", F.try_element_at("cells", F.lit("io_number")).alias("io_cell"), F.array_join("rows", ",").alias("rows"), F.size("stages").alias("n_stages"))


@query(f"""{GO}, items as (select * from go_rows where kind = 1) select {grids.ORDER_BOOK} as workbook_id, 'row_per_pli' as format, round(0.7 * 0.85, 4) as confidence, count(*) as n_items from items group by floor(cust / 50)""")
def extract_books(spark, sf):
    """Every field is read from a header column, and the fabric is never given: all findings are warnings."""
    return order_results(spark, sf)["books"].select("workbook_id", "format", "confidence", "n_items")


@query(f"""{GO}, n as (select count(*) as n from go_rows where kind = 1 group by floor(cust / 50)) select 'field_dropout' as "check", 'fabric_code' as field, 'warning' as severity, chr(39) || 'fabric_code' || chr(39) || ' populated in 0/' || cast(n as varchar) || ' PLIs (ratio 0.00 < floor 0.5)' as message from n""")
def extract_warnings(spark, sf):
    """All warnings of the flow: only the fabric is never given."""
    return order_results(spark, sf)["warnings"].select("check", "field", "severity", "message")


@query(f"""{GO}, per as (select 'C' || cast(cust as varchar) as sheet, count(*) as n_rows from go_rows where kind = 1 group by cust) select sheet, 'row' as mode, 1 as id_col, 0.9 as confidence, n_rows, 5 as n_labels, 0 as n_keys, 0 as n_blocks, 0 as n_bands from per""")
def plan_sheets(spark, sf):
    return planning.summary(planning.plan_sheets(grids.cells(spark, sf, "orders"), grids.merges(spark, sf), buckets=grids.buckets(spark, sf))).drop("workbook_id")


@query(f"""{_STAGES}, data as (select distinct sheet, r from cells where c = 1 and r > 3), prim as (select d.sheet, d.r, k.stage, k.pc, max(case when k.sub_label = 'Actual' then k.sub_col end) as sub_col, any_value(case when c.dtype = 'date' then cast(c.dval as date) end) as planned_date
   from data d join kept k on k.sheet = d.sheet join cells c on c.sheet = d.sheet and c.r = d.r and c.c = k.pc group by d.sheet, d.r, k.r, k.stage, k.pc)
 select p.sheet, p.r as item, lower(p.stage) as stage, p.planned_date, cast(cast(a.dval as date) as varchar) as actual_date from prim p left join cells a on a.sheet = p.sheet and a.r = p.r and a.c = p.sub_col where p.stage not in ('Plan', 'Actual')""")
def plan_stages(spark, sf):
    """The stages of all items of the band grid, by its plan."""
    cells, none = grids.cells(spark, sf, "bands"), grids.no_merges(spark)
    n = grids.buckets(spark, sf)
    plan = planning.plan_sheets(cells, none, buckets=n).stored(n)
    items = apply.apply_plan(cells, none, plan, naming.stage_names(plan.columns).unionByName(naming.subfield_names(plan.columns)), n)
    each = items.select("sheet", "item", F.explode("stages").alias("s"))
    return each.select("sheet", "item", F.col("s.name").alias("stage"), F.col("s.planned_date").alias("planned_date"), F.try_element_at("s.metadata", F.lit("actual_date")).alias("actual_date"))
