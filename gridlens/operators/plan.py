"""The plan of every sheet at once: mode, rows, labels, keys, bands, blocks.

A plan is a set of tables keyed by workbook and sheet; nothing in it is held for one sheet alone. Modes: row (an item a
data row), section (an item a block), sheet (an item a sheet).
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.address import row_of
from gridlens.operators import apply, bands, kv, rows, survey
from gridlens.operators.read import sheets as extents_of
from gridlens.session import stored
from gridlens.sources.grids import SHEET


@dataclass
class Plan:
    """Tables of a plan.

    sheets: mode, id_col, max_row, max_col, confidence. rows: r, role, anchor_idx, group_id, sub_row_role. labels: c, row, raw.
    keys: label, label_row, label_cell, value_row, value_col, value_cell. bands: r, sub_header, title, name_cell, layout, plan_row,
    sub_rows (role to row), block_id. columns: r (of the band), stage, primary_col, first_col, sub_label, sub_col.
    blocks: block_id, start, end. members: block_id and the columns of keys.
    """

    sheets: DataFrame
    rows: DataFrame
    labels: DataFrame
    keys: DataFrame
    bands: DataFrame
    columns: DataFrame
    blocks: DataFrame
    members: DataFrame

    def stored(self, buckets: int | None = None) -> Plan:
        """The plan with each table written once."""
        return Plan(**{f.name: stored(getattr(self, f.name), buckets) for f in fields(self)})


def claimed_columns(columns: DataFrame) -> DataFrame:
    """(c): the columns that bands have taken, of stages and their sub-columns."""
    one = lambda name: columns.select(*SHEET, F.col(name).alias("c"))
    return one("primary_col").unionByName(one("sub_col")).where("c is not null").distinct()


def band_plan(cells: DataFrame, merges: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Bands with layout and sub-rows, and their stage columns."""
    found = stored(bands.bands(cells), buckets)
    laid = stored(bands.layouts(found, bands.sub_rows(cells, found)), buckets)
    return with_sub_rows(cells, laid), bands.stage_columns(cells, merges, laid)


def with_sub_rows(cells: DataFrame, laid: DataFrame) -> DataFrame:
    """Adds sub_rows (role to row) to bands with their layout."""
    by_role = bands.sub_rows(cells, laid).groupBy(*SHEET, "r").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "row")))).alias("found_rows"))
    plan = F.create_map(F.lit("plan"), F.col("plan_row"))
    return laid.join(by_role, [*SHEET, "r"], "left").withColumn("sub_rows", F.when(F.col("found_rows").isNull(), plan).otherwise(F.map_concat(plan, F.map_filter("found_rows", lambda k, _: k != "plan")))).drop("found_rows")


def plan_sheets(cells: DataFrame, merges: DataFrame, extents: DataFrame | None = None, buckets: int | None = None) -> Plan:
    """Survey, mode, identity column, bands, keys, rows, blocks, title rows and labels of every sheet; `buckets` tells in how many buckets of sheets the cells are stored, if they are."""
    keep = lambda df: stored(df, buckets)
    extents = extents_of(cells) if extents is None else extents
    modes = keep(survey.modes(cells, extents).select(*SHEET, "mode"))
    of_mode = lambda df, *wanted: df.join(modes.where(F.col("mode").isin(*wanted)).select(*SHEET), SHEET, "left_semi")
    keys = keep(kv.key_values(cells))
    roles = keep(of_mode(rows.row_roles(cells, merges, extents, buckets), "row", "section"))
    found, columns = (keep(x) for x in band_plan(cells, merges, buckets))
    anchors = of_mode(roles.where("role = 'anchor'"), "section")
    blocks = keep(kv.blocks(anchors.select(*SHEET, "r"), of_mode(survey.blank_gaps(cells, extents), "section")))
    inside = kv.placed(blocks, found, row_of(F.col("name_cell"))).drop("start", "end")
    placed = of_mode(found, "row", "sheet").withColumn("block_id", F.lit(None).cast("int")).unionByName(inside)
    taken = claimed_columns(of_mode(columns, "row"))
    own = of_mode(roles, "row")
    extra = keep(apply.title_rows(cells, own, taken))
    fixed = apply.with_title_rows(roles, extra).withColumn("sub_row_role", F.lit(None).cast("string"))
    under_title = own.join(extra.select(*SHEET, "extra_row"), SHEET, "left").withColumn("role", F.when(F.col("extra_row").isNull(), F.col("role")).when(F.col("r") == F.col("extra_row"), "header").otherwise("blank"))
    many = keys.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_keys"))
    sure = F.when(F.col("mode") != "sheet", 0.9).when(F.coalesce("n_keys", F.lit(0)) >= 3, 0.92).otherwise(0.85)
    identity = survey.identity_columns(cells)
    about = extents.join(modes, SHEET).join(identity, SHEET, "left").join(many, SHEET, "left").withColumns({"id_col": F.when(F.col("mode") != "sheet", F.col("id_col")), "confidence": sure}).drop("n_keys")
    return Plan(about, fixed, apply.header_labels(cells, under_title, taken), of_mode(keys, "sheet"), placed, columns, blocks, kv.block_members(blocks, keys))


def summary(plan: Plan) -> DataFrame:
    """One row a sheet: mode, identity column, confidence, and how much of each channel the plan holds."""
    count = lambda df, name: df.groupBy(*SHEET).agg(F.count(F.lit(1)).alias(name))
    out = plan.sheets.select(*SHEET, "mode", "id_col", "confidence")
    parts = [count(plan.rows.where("role in ('anchor', 'child')"), "n_rows"), count(plan.labels, "n_labels"), count(plan.keys, "n_keys"), count(plan.blocks, "n_blocks"), count(plan.bands, "n_bands")]
    for part in parts:
        out = out.join(part, SHEET, "left")
    return out.na.fill(0, ["n_rows", "n_labels", "n_keys", "n_blocks", "n_bands"])
