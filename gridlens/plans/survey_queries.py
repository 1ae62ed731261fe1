"""Queries over sheet signals, row roles, keys and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.functions import vocab
from gridlens.operators import kv, rows, survey
from gridlens.operators import plan as planning
from gridlens.plans.read_queries import GB, GK, GO, GOM, GS, GX
from gridlens.plans.registry import registry
from gridlens.sources import grids

QUERIES, query = registry()
_NORM = "trim(regexp_replace(lower(sval), '\\s+', ' ', 'g'))"
_ID = " or ".join(f"contains({_NORM}, '{t}')" for t in vocab.IDENTITY)
_KEY = " or ".join(f"starts_with({_NORM}, '{t}') or ends_with({_NORM}, '{t}')" for t in vocab.KEY_LABELS)
HITS = f"hits as (select sheet, r, c, sval as raw, {_NORM} as text from cells where r <= 15 and dtype = 'str' and ({_ID}))"
KEYS = f"keys as (select sheet, r, c, sval as raw from cells where r <= 15 and dtype = 'str' and ({_KEY}))"
GAPS = "occupied as (select distinct sheet, r from cells), gaps as (select sheet, prev + 1 as g_start, r - 1 as g_end from (select sheet, r, coalesce(lag(r) over (partition by sheet order by r), 0) as prev from occupied) x where r - prev > 1)"


@query(f"{GO}, {HITS} select sheet, r, c, raw, text from hits")
def vocab_hits(spark, sf):
    return survey.vocab_hits(grids.cells(spark, sf, "orders")).select("sheet", "r", "c", "raw", "text")


@query(f"{GK}, {KEYS} select sheet, r, c, raw from keys")
def kv_hits(spark, sf):
    return survey.key_hits(grids.cells(spark, sf, "customers")).select("sheet", "r", "c", "raw")


@query(f"{GB} select sheet, c, count(*) as seen, count(*) filter (dtype = 'date') as dates from cells group by sheet, c having count(*) >= 2 and count(*) filter (dtype = 'date') * 2 >= count(*)")
def date_cols(spark, sf):
    return survey.date_columns(grids.cells(spark, sf, "bands")).select("sheet", "c", "seen", "dates")


@query(f"{GS}, {GAPS} select sheet, g_start, g_end from gaps")
def blank_gaps(spark, sf):
    return survey.blank_gaps(grids.cells(spark, sf, "blocks")).select("sheet", "g_start", "g_end")


def _modes(prefix: str, hits: str = HITS, keys: str = KEYS) -> str:
    return f"""{prefix}, {hits}, {keys}, {GAPS}, per_col as (select sheet, c, count(distinct r) as nr, count(distinct raw) as nl from keys k where exists (select 1 from hits h where h.sheet = k.sheet and h.c = k.c) group by sheet, c),
    facts as (select s.sheet, (select count(*) from per_col p where p.sheet = s.sheet and (nr = 1 or nl = 1)) as n_real, (select count(*) from keys k where k.sheet = s.sheet) as n_hits,
      (select count(distinct r) from keys k where k.sheet = s.sheet) as n_hit_rows, (select count(*) from gaps g where g.sheet = s.sheet) as n_gaps from (select distinct sheet from cells) s)
    select sheet, n_real, n_hits, n_hit_rows, n_gaps, case when n_real > 0 and n_gaps >= 2 and n_hits >= 3 and n_hit_rows >= 2 then 'section' when n_real > 0 then 'row' when n_hits >= 2 then 'sheet' else 'row' end as mode from facts"""


@query(f"""{GB}, {HITS}, {KEYS}, {GAPS}, extent as (select sheet, max(r) as max_row, max(c) as max_col from cells group by sheet),
    cand as (select sheet, c, min(r) as r from hits group by sheet, c), dated as (select sheet, c from cells group by sheet, c having count(*) >= 2 and count(*) filter (dtype = 'date') * 2 >= count(*)),
    a as (select sheet, string_agg(cast(c as varchar), ',' order by r, c) as candidates from cand group by sheet), b as (select sheet, string_agg(cast(c as varchar), ',' order by c) as date_cols from dated group by sheet),
    g as (select sheet, count(*) as n_gaps from gaps group by sheet), k as (select sheet, string_agg(raw, ',' order by r, c) as key_labels from keys group by sheet)
    select sheet, max_row, max_col, candidates, date_cols, coalesce(n_gaps, 0) as n_gaps, key_labels from extent left join a using (sheet) left join b using (sheet) left join g using (sheet) left join k using (sheet)""")
def sheet_signals(spark, sf):
    """What is known of each sheet before its mode is chosen, in one row a sheet."""
    joined = lambda name: F.array_join(F.transform(name, lambda x: x.cast("string")), ",")
    keys = F.array_join(F.transform("key_hits", lambda x: x["raw"]), ",")
    found = survey.signals(grids.cells(spark, sf, "bands"))
    return found.select("sheet", "max_row", "max_col", joined("identity_candidates").alias("candidates"), joined("date_cols").alias("date_cols"), F.coalesce(F.size("gaps"), F.lit(0)).cast("long").alias("n_gaps"), keys.alias("key_labels"))


_MODE_COLUMNS = ["sheet", "n_real", "n_hits", "n_hit_rows", "n_gaps", "mode"]


@query(_modes(GO, *[x.replace("r <= 15 and ", "") for x in (HITS, KEYS)]))
def mode_decision(spark, sf):
    """By the texts of whole sheets, not of their header rows alone."""
    return survey.modes(grids.cells(spark, sf, "orders"), rows=None).select(*_MODE_COLUMNS)


@query(_modes(GK))
def mode_of_key_sheets(spark, sf):
    return survey.modes(grids.cells(spark, sf, "customers")).select(*_MODE_COLUMNS)


@query(_modes(GS))
def mode_of_block_sheets(spark, sf):
    return survey.modes(grids.cells(spark, sf, "blocks")).select(*_MODE_COLUMNS)


_FIRST = " or ".join(f"contains(lower(raw), '{t}')" for t in vocab.IDENTITY_FIRST)


@query(f"{GO}, {HITS}, cols as (select sheet, c, min(r * 1000 + c) as at_cell, bool_or({_FIRST}) as good from hits group by sheet, c) select sheet, c as id_col from (select *, row_number() over (partition by sheet order by good desc, at_cell) as k from cols) x where k = 1")
def identity_col(spark, sf):
    return survey.identity_columns(grids.cells(spark, sf, "orders")).select("sheet", "id_col")


@query(f"{GO} select sheet, min(c) as qty_col from cells where r <= 10 and dtype = 'str' and ({_NORM} like '%qty%' or {_NORM} like '%quantity%') group by sheet")
def quantity_col(spark, sf):
    return survey.quantity_columns(grids.cells(spark, sf, "orders")).select("sheet", "qty_col")


#: The order grid's roles from its own layout: what kind each row was made as. Sums decide between totals.
ROLES = """roles as (
  select sheet, r, case when kind is null then 'header' when kind = 0 then case when seen = 0 then 'header' else 'repeat_header' end when kind = 1 and k = 1 then 'anchor' when kind = 1 then 'child'
    when seen > 0 and abs(group_sum - qty) < 0.5 then 'total' when abs(grand_sum - qty) < 0.5 then 'grand_total' else 'blank' end as role,
    case when kind = 1 then seen_all - 1 end as group_id, case when kind = 1 and k > 1 then last_anchor end as anchor_idx
  from (
    select *, sum(case when kind = 1 and k = 1 then 1 else 0 end) over (partition by sheet order by r rows between unbounded preceding and 1 preceding) as seen,
      sum(case when kind = 1 and k = 1 then 1 else 0 end) over (partition by sheet order by r) as seen_all,
      max(case when kind = 1 and k = 1 then r end) over (partition by sheet order by r) as last_anchor,
      coalesce(sum(case when kind = 1 then qty end) over (partition by sheet order by r rows between unbounded preceding and 1 preceding), 0) as grand_sum,
      coalesce(sum(case when kind = 1 then qty end) over (partition by sheet, ord2 order by r rows between unbounded preceding and 1 preceding), 0) as group_sum
    from (select 'C' || cast(cust as varchar) as sheet, r, kind, k, qty, ord as ord2 from go_rows union all select 'C' || cast(cust as varchar), 1, null, 1, null, -1 from go_rows where r = 2) y
  ) x
)"""


def order_roles(spark, sf):
    """The roles of the order grid, made once."""
    return grids.kept(spark, sf, "order roles", lambda: rows.row_roles(grids.cells(spark, sf, "orders"), grids.merges(spark, sf), buckets=grids.buckets(spark, sf)))


@query(f"{GO}, {ROLES} select sheet, r, role, cast(group_id as bigint) as group_id, anchor_idx from roles")
def row_roles(spark, sf):
    return order_roles(spark, sf).select("sheet", "r", "role", F.col("group_id").cast("long").alias("group_id"), "anchor_idx")


_NAMES = ["header", "repeat_header", "anchor", "child", "total", "grand_total", "blank"]


@query(f"{GO}, {ROLES} select sheet, {', '.join(f'''count(*) filter (role = '{n}') as n_{n}''' for n in _NAMES)} from roles group by sheet")
def role_counts(spark, sf):
    return rows.role_counts(order_roles(spark, sf)).drop("workbook_id")


@query(f"""{GO} select 'C' || cast(cust as varchar) as sheet, r, cast(coalesce(sum(case when kind = 1 then qty end) over (partition by cust order by r rows between unbounded preceding and 1 preceding), 0) as double) as grand_sum
 from (select * from go_rows) x where kind > 0""")
def running_totals(spark, sf):
    roles = order_roles(spark, sf)
    return roles.where("role in ('anchor', 'child', 'total', 'grand_total', 'blank')").select("sheet", "r", "grand_sum")


@query(f"""{GK}, {KEYS}, both_sides as (select k.sheet, k.raw, k.r, k.c, a.dtype as rt, b.dtype as bt from keys k left join cells a on a.sheet = k.sheet and a.r = k.r and a.c = k.c + 1 left join cells b on b.sheet = k.sheet and b.r = k.r + 1 and b.c = k.c)
 select sheet, raw as label, r as label_row, case when rt <> 'str' or (rt = 'str' and bt is null) then 'B' || cast(r as varchar) else 'A' || cast(r + 1 as varchar) end as value_cell from both_sides where rt is not null or bt is not null""")
def kv_pairs(spark, sf):
    return kv.key_values(grids.cells(spark, sf, "customers")).select("sheet", "label", "label_row", "value_cell")


@query(f"""{GK}, {KEYS}, both_sides as (select k.sheet, a.dtype as rt, b.dtype as bt from keys k left join cells a on a.sheet = k.sheet and a.r = k.r and a.c = k.c + 1 left join cells b on b.sheet = k.sheet and b.r = k.r + 1 and b.c = k.c),
 pairs as (select sheet, count(*) as n from both_sides where rt is not null or bt is not null group by sheet)
 select sheet, 'sheet' as mode, case when n >= 3 then 0.92 else 0.85 end as confidence, n as n_keys, 0 as n_rows, 0 as n_blocks from pairs""")
def plan_key_sheets(spark, sf):
    """Plans of sheets that are items."""
    cells = grids.cells(spark, sf, "customers")
    return planning.summary(planning.plan_sheets(cells, grids.no_merges(spark), buckets=grids.buckets(spark, sf))).select("sheet", "mode", "confidence", "n_keys", "n_rows", "n_blocks")


#: Anchors of the block grid: cells of column A.
_ANCHORS = "anchors as (select sheet, r, lead(r) over (partition by sheet order by r) as nxt, row_number() over (partition by sheet order by r) - 1 as block_id from cells where c = 1 {})"
_BOUNDS = """bounds as (select a.sheet, a.block_id, a.r as "start", coalesce(min(g.g_start) - 1, any_value(a.nxt) - 1, a.r) as "end" from anchors a left join gaps g on g.sheet = a.sheet and g.g_start >= a.r and (a.nxt is null or g.g_start <= a.nxt - 1) group by a.sheet, a.block_id, a.r)"""
BOUNDS = f"{GS}, {GAPS}, {_ANCHORS.format('')}, {_BOUNDS}"
#: Under the header of a section sheet all of column A is anchors.
SECTION_BOUNDS = f"{GX}, {GAPS}, {_ANCHORS.format('and r > 1')}, {_BOUNDS}"


def _blocks(spark, sf):
    cells = grids.cells(spark, sf, "blocks")
    return cells, kv.blocks(cells.where("c = 1").select("workbook_id", "sheet", "r"), survey.blank_gaps(cells))


@query(f'{BOUNDS} select sheet, block_id, "start", "end" from bounds')
def block_bounds(spark, sf):
    return _blocks(spark, sf)[1].select("sheet", F.col("block_id").cast("long").alias("block_id"), "start", "end")


@query(f"""{BOUNDS}, {KEYS} select b.sheet, b.block_id, k.raw as label, 'C' || cast(k.r as varchar) as value_cell from bounds b join keys k on k.sheet = b.sheet and k.r between b."start" and b."end" join cells v on v.sheet = k.sheet and v.r = k.r and v.c = 3""")
def block_members(spark, sf):
    cells, found = _blocks(spark, sf)
    return kv.block_members(found, kv.key_values(cells)).select("sheet", F.col("block_id").cast("long").alias("block_id"), "label", "value_cell")


@query(_modes(GX))
def mode_of_section_sheets(spark, sf):
    return survey.modes(grids.cells(spark, sf, "sections")).select(*_MODE_COLUMNS)


@query(f"{SECTION_BOUNDS} select sheet, 'section' as mode, 1 as id_col, 0.9 as confidence, count(*) as n_rows, 0 as n_labels, 0 as n_keys, count(*) as n_blocks, 0 as n_bands from bounds group by sheet")
def plan_sections(spark, sf):
    """Plans of sheets whose blocks are items."""
    cells = grids.cells(spark, sf, "sections")
    return planning.summary(planning.plan_sheets(cells, grids.no_merges(spark), buckets=grids.buckets(spark, sf))).drop("workbook_id")
