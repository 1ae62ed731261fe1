"""Queries over checks of plans and items, and over reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions import scalars, vocab
from gridlens.operators import check, findings, survey
from gridlens.operators import plan as planning
from gridlens.operators.read import sheets
from gridlens.plans.apply_queries import _STAGES, _bands, _stage_columns, order_items
from gridlens.plans.read_queries import GO
from gridlens.plans.registry import registry
from gridlens.plans.survey_queries import ROLES, order_roles
from gridlens.session import table
from gridlens.sources import grids

QUERIES, query = registry()
#: Row specs of the order grid with faults put in by rule.
_FAULTY = """, specs as (select sheet, r, case when r % 31 = 0 and role = 'child' then 'header' else role end as role, case when role = 'child' and r % 11 = 0 then anchor_idx + 1000 when role = 'child' and r % 13 = 0 then null when role = 'anchor' and r % 17 = 0 then 5 else anchor_idx end as anchor_idx from roles
 union all select sheet, r, role, anchor_idx from roles where r % 19 = 0)"""


def _faulty(spark, sf):
    roles = order_roles(spark, sf).select("workbook_id", "sheet", "r", "role", "anchor_idx")
    child = F.col("role") == "child"
    broken = F.struct(F.when((F.col("r") % 31 == 0) & child, "header").otherwise(F.col("role")).alias("role"), F.when(child & (F.col("r") % 11 == 0), F.col("anchor_idx") + 1000).when(child & (F.col("r") % 13 == 0), F.lit(None)).when((F.col("role") == "anchor") & (F.col("r") % 17 == 0), 5).otherwise(F.col("anchor_idx")).alias("anchor_idx"))
    # Exploded, not a union: the rows stay in their buckets.
    specs = F.when(F.col("r") % 19 == 0, F.array(broken, F.struct("role", "anchor_idx"))).otherwise(F.array(broken))
    return roles.select("workbook_id", "sheet", "r", F.explode(specs).alias("x")).select("workbook_id", "sheet", "r", "x.*")


@query(f"""{GO}, {ROLES}{_FAULTY} select s.sheet, s.r, case when s.anchor_idx is null then 'child_without_anchor' else 'dangling_anchor' end as what from specs s where s.role = 'child' and not exists (select 1 from specs a where a.sheet = s.sheet and a.role = 'anchor' and a.r = s.anchor_idx)
 union all select sheet, r, 'anchor_with_anchor' from specs where role = 'anchor' and anchor_idx is not null""")
def chk_reference(spark, sf):
    return check.references(_faulty(spark, sf)).select("sheet", "r", "what")


@query(f"{GO}, {ROLES}{_FAULTY} select sheet, r, nth from (select sheet, r, row_number() over (partition by sheet, r order by role) as nth from specs) x where nth > 1")
def chk_unique(spark, sf):
    return check.repeated_rows(_faulty(spark, sf)).select("sheet", "r", F.col("nth").cast("long").alias("nth"))


@query(f"""{GO}, {ROLES}{_FAULTY}, facts as (select sheet, min(case when role = 'header' then r end) as low, max(case when role = 'header' then r end) as high, count(*) filter (role = 'header') as n, min(case when role in ('anchor', 'child') then r end) as first_data from specs group by sheet)
 select sheet, high - low + 1 <> n as apart, coalesce(first_data < high, false) as late from facts where n > 0 and (high - low + 1 <> n or first_data < high)""")
def chk_header(spark, sf):
    return check.header_rows(_faulty(spark, sf)).select("sheet", "apart", "late")


@query("""with b as (select o_custkey as k, o_orderkey % 1000 as s, o_orderkey % 1000 + o_orderkey % 7 as e from orders) select cast(k as varchar) as sheet, s as "start", e as "end", nxt as next_start from (select *, lead(s) over (partition by k order by s, e) as nxt from b) x where nxt <= e""")
def chk_overlap(spark, sf):
    place = F.col("o_orderkey") % 1000
    blocks = table(spark, sf, "orders").select(F.lit("o").alias("workbook_id"), F.col("o_custkey").cast("string").alias("sheet"), place.alias("start"), (place + F.col("o_orderkey") % 7).alias("end"))
    return check.overlaps(blocks).select("sheet", "start", "end", "next_start")


@query("with p as (select c_custkey, case when c_custkey % 3 = 0 then 'row' when c_custkey % 3 = 1 then 'section' else 'sheet' end as mode, c_custkey % 2 as a, c_nationkey % 2 as b, (c_custkey // 7) % 2 as k from customer) select c_custkey, a + b + k > 1 as several, case mode when 'row' then a when 'section' then b else k end = 0 and a + b + k > 0 as wrong from p where a + b + k > 1 or (case mode when 'row' then a when 'section' then b else k end = 0 and a + b + k > 0)")
def chk_channel(spark, sf):
    facts = table(spark, sf, "customer").select("c_custkey", F.element_at(F.array(F.lit("row"), F.lit("section"), F.lit("sheet")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("mode"), (F.col("c_custkey") % 2).alias("n_rows"), (F.col("c_nationkey") % 2).alias("n_blocks"), F.expr("(c_custkey div 7) % 2").alias("n_keys"))
    return check.channels(facts).select("c_custkey", "several", "wrong")


@query(f"""{GO}, {ROLES}, ids as (select sheet, r from cells where c = 1 and r % 7 = 1), data as (select o.sheet, o.anchor_idx is not null or i.r is not null as good from roles o left join ids i on i.sheet = o.sheet and i.r = o.r where o.role in ('anchor', 'child'))
 select sheet, avg(case when good then 1.0 else 0.0 end) as share from data group by sheet having avg(case when good then 1.0 else 0.0 end) < 0.8""")
def chk_identity(spark, sf):
    """Six of seven identity cells are taken away."""
    cells = grids.cells(spark, sf, "orders")
    return check.identity_coverage(order_roles(spark, sf), cells.where("c <> 1 or r % 7 = 1"), survey.identity_columns(cells)).select("sheet", "share")


@query(f"{GO} select sheet, max(r) as max_row from cells where sheet like '%3' group by sheet having max(r) >= 10")
def chk_count(spark, sf):
    """Sheets whose name ends in 3 lose their roles."""
    cells, roles = grids.cells(spark, sf, "orders"), order_roles(spark, sf)
    return check.item_counts(sheets(cells), roles.where("sheet not like '%3'"), survey.key_hits(cells).where("false")).select("sheet", "max_row")


@query(f"""{_STAGES}, places as (select distinct sheet, r, pc from kept), seen as (select sheet, r, c, case when c % 4 = 3 or cast(substr(sheet, 2) as bigint) % 2 = 0 then 'str' else dtype end as dtype from cells)
 select p.sheet, p.r, count(*) as filled, count(*) filter (c.dtype = 'date') as dates from places p join seen c on c.sheet = p.sheet and c.r = p.r and c.c = p.pc group by p.sheet, p.r having count(*) >= 2 and count(*) filter (c.dtype = 'date') < 0.5 * count(*)""")
def chk_density(spark, sf):
    """Dates turn to texts in two of three stages, and in all of every second sheet."""
    cells, _, laid = _bands(spark, sf)
    found, columns = planning.with_sub_rows(cells, laid), _stage_columns(spark, sf)
    texts = cells.withColumn("dtype", F.when((F.col("c") % 4 == 3) | (F.substring("sheet", 2, 20).cast("bigint") % 2 == 0), "str").otherwise(F.col("dtype")))
    return check.date_density(texts, found, columns).select("sheet", "r", "filled", "dates")


@query(f"""{GO}, {ROLES}, n as (select sheet, cast(substr(sheet, 2) as bigint) as cust, count(*) as n from roles where role = 'anchor' group by sheet) select sheet, n + 1 as largest, n from n where cust % 4 = 0""")
def chk_sequence(spark, sf):
    """A column of running numbers is put beside the order grid; in every fourth sheet it starts at 2."""
    roles = order_roles(spark, sf)
    number = F.col("group_id") + F.when(F.substring("sheet", 2, 20).cast("bigint") % 4 == 0, 2).otherwise(1)
    kept = ["workbook_id", "sheet", "r", F.lit(9).alias("c")]
    numbers = roles.where("role = 'anchor'").select(*kept, F.lit("int").alias("dtype"), number.cast("string").alias("sval"), number.cast("double").alias("nval"))
    heads = roles.where("role = 'header'").select(*kept, F.lit("str").alias("dtype"), F.lit(" S.No ").alias("sval"), F.lit(None).cast("double").alias("nval"))
    return check.running_numbers(roles, numbers.unionByName(heads)).select("sheet", "largest", "n")


_PLAIN = "select sheet, 'reference_integrity' as \"check\", 'error' as severity"


@query(f"""{GO}, {ROLES}{_FAULTY}, anchors as (select distinct sheet, r from specs where role = 'anchor'), heads as (select sheet, min(r) as low, max(r) as high, count(*) as n from specs where role = 'header' group by sheet)
 {_PLAIN}, 'CHILD row ' || cast(r as varchar) || ' has no anchor_idx' as message from specs where role = 'child' and anchor_idx is null
 union all {_PLAIN}, 'CHILD row ' || cast(r as varchar) || ' anchor_idx=' || cast(anchor_idx as varchar) || ' not in ANCHOR rows' from specs s where role = 'child' and anchor_idx is not null and not exists (select 1 from anchors a where a.sheet = s.sheet and a.r = s.anchor_idx)
 union all {_PLAIN}, 'ANCHOR row ' || cast(r as varchar) || ' has non-null anchor_idx=' || cast(anchor_idx as varchar) from specs where role = 'anchor' and anchor_idx is not null
 union all select sheet, 'row_uniqueness', 'error', 'row idx ' || cast(r as varchar) || ' appears more than once' from (select sheet, r, row_number() over (partition by sheet, r order by role) as k from specs) x where k > 1
 union all select sheet, 'header_contiguity', 'warn', 'header rows are not contiguous' from heads where high - low + 1 <> n
 union all select s.sheet, 'header_contiguity', 'warn', 'data row ' || cast(min(s.r) as varchar) || ' precedes max header row ' || cast(any_value(h.high) as varchar) from specs s join heads h on h.sheet = s.sheet and s.r < h.high where s.role in ('anchor', 'child') group by s.sheet
 union all select distinct sheet, 'exactly_one_identity_channel', 'error', 'multiple identity channels populated: header_labels, kv_anchors' from specs where sheet like '%5'""")
def plan_findings(spark, sf):
    """All invariants at once, on rows with faults; sheets whose name ends in 5 have a key beside their labels."""
    cells, rows = grids.cells(spark, sf, "orders"), _faulty(spark, sf).withColumns({"group_id": F.lit(None).cast("int"), "sub_row_role": F.lit(None).cast("string")})
    one = order_roles(spark, sf).select("workbook_id", "sheet").distinct()
    about = one.select("*", F.lit("row").alias("mode"))
    blocks = one.where("false").select("*", *[F.lit(0).alias(c) for c in ("block_id", "start", "end")])
    plan = planning.Plan(about, rows, one, one.where("sheet like '%5'"), cells, cells, blocks, blocks)
    return findings.plan_invariants(plan).select("sheet", "check", "severity", "message")


def _fields(spark, sf):
    """The order items' fields in long form; every 23rd row's colour is changed."""
    items = order_items(spark, sf)
    names = ["io_number", "style_code", "color_code", "quantity", "delivery_date"]
    texts = items.withColumns({n: F.col(n).cast("string") for n in names}).withColumn("color_code", F.when(F.col("r") % 23 == 0, "XX").otherwise(F.col("color_code")))
    # Exploded, not unpivoted: the rows stay in their buckets, and no map is copied for each field.
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), F.try_element_at("cells", F.lit(n)).alias("addr")) for n in names])
    return texts.select("workbook_id", "sheet", F.col("r").alias("item"), F.explode(each).alias("x")).select("workbook_id", "sheet", "item", "x.*")


@query(f"{GO} select 'C' || cast(cust as varchar) as sheet, r as item, 'color_code' as field, 'XX' as value, color as actual from go_rows where kind = 1 and r % 23 = 0")
def chk_source_cell(spark, sf):
    return check.source_cells(_fields(spark, sf), grids.cells(spark, sf, "orders")).select("sheet", "item", "field", "value", "actual")


@query(f"{GO} select 'C' || cast(cust as varchar) as sheet, 3 as c, 'style_code' as field, min(r) as item from go_rows where kind = 1 group by cust")
def chk_header_match(spark, sf):
    fields = _fields(spark, sf).withColumn("field", F.when(F.col("field") == "color_code", "style_code").when(F.col("field") == "style_code", "none").otherwise(F.col("field")))
    return check.header_matches(fields, grids.cells(spark, sf, "orders")).select("sheet", "c", "field", "item")


@query("with n as (select o_custkey, count(*) as candidates, count(*) filter (o_orderkey % 3 <> 0) as items from orders group by o_custkey) select cast(o_custkey as varchar) as sheet, items, candidates, items / candidates as share from n where items / candidates < 0.8")
def chk_coverage(spark, sf):
    orders = table(spark, sf, "orders").select(F.lit("o").alias("workbook_id"), F.col("o_custkey").cast("string").alias("sheet"), "o_orderkey")
    counted = lambda df, name: df.groupBy("workbook_id", "sheet").agg(F.count(F.lit(1)).alias(name))
    return check.coverage(counted(orders.where("o_orderkey % 3 <> 0"), "items"), counted(orders, "candidates")).select("sheet", "items", "candidates", "share")


@query("with x as (select d.lang, l.quality, l.toxic, nullif(d.source, 'src0') as source from documents d left join labels l using (doc_id)), f as (select 'lang' as field, count(*) filter (lang is not null and lang <> '') as filled, count(*) as total from x union all select 'quality', count(quality), count(*) from x union all select 'toxic', count(toxic), count(*) from x union all select 'source', count(*) filter (source <> ''), count(*) from x) select field, filled, total, filled / total as ratio from f where filled / total < 0.5")
def chk_dropout(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("lang", "quality", "toxic", F.expr("nullif(source, 'src0')").alias("source"))
    return check.dropout(both.select(*[F.col(c).cast("string").alias(c) for c in both.columns]), ["lang", "quality", "toxic", "source"])


def _findings(spark, sf):
    severity = F.element_at(F.array(F.lit("info"), F.lit("warn"), F.lit("error"), F.lit("info")), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("book"), severity.alias("severity"), (F.col("l_quantity") / 50).alias("confidence"))


_FINDINGS = "with f as (select l_suppkey as book, case l_orderkey % 4 when 0 then 'info' when 1 then 'warn' when 2 then 'error' else 'info' end as severity, l_quantity / 50 as confidence from lineitem)"


@query(f"{_FINDINGS} select book, avg(case when severity in ('warn', 'error') then 1.0 else 0.0 end) as warn_rate from f group by book")
def warn_rate(spark, sf):
    return check.warn_rate(_findings(spark, sf), "book")


@query(f"{_FINDINGS} select book, round(0.7 * avg(confidence) + 0.3 * (1 - avg(case when severity in ('warn', 'error') then 1.0 else 0.0 end)), 4) as confidence from f group by book")
def confidence(spark, sf):
    found = _findings(spark, sf)
    return check.confidence(found, check.warn_rate(found, "book"), "book")


@query(f"{_FINDINGS} select case severity when 'warn' then 'warning' else severity end as severity, count(*) as n from f group by 1")
def severity_map(spark, sf):
    return _findings(spark, sf).select(scalars.severity(F.col("severity")).alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_FINDINGS}, g as (select book, bool_or(severity = 'warn') as warned, avg(confidence) as c from f group by book) select book, warned or c < 0.85 or book % 3 <> 0 as review from g")
def review_gate(spark, sf):
    per = _findings(spark, sf).groupBy("book").agg(F.max(F.col("severity") == "warn").alias("warned"), F.avg("confidence").alias("c"))
    mode = F.when(F.col("book") % 3 == 0, "row").otherwise("sheet")
    return per.select("book", check.review_gate(F.col("warned"), F.col("c"), mode).alias("review"))


@query(f"""{GO}, {ROLES} select sheet, r, case when r % 14 = 0 then 'blank' when r % 7 = 0 then 'title' else role end as role, case when r % 7 = 0 then 1 else anchor_idx end as anchor_idx from roles""")
def row_corrections(spark, sf):
    roles = order_roles(spark, sf).select("workbook_id", "sheet", "r", "role", "anchor_idx")
    some = roles.where("r % 7 = 0").select("workbook_id", "sheet", "r", F.lit("title").alias("role"), F.lit(1).alias("anchor_idx"), F.lit(0).alias("ord"))
    more = some.where("r % 14 = 0").withColumns({"role": F.lit("blank"), "anchor_idx": F.lit(None).cast("int"), "ord": F.lit(1)})
    wrong = some.withColumns({"role": F.lit("nonsense"), "anchor_idx": F.lit(None).cast("int"), "ord": F.lit(2)})
    return check.corrected(roles, some.unionByName(more).unionByName(wrong)).select("sheet", "r", "role", "anchor_idx")
