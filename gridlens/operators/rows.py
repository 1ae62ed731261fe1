"""Roles of rows. The ordered scan over a sheet is written as windows: what the scan would remember is a running
aggregate over the rows before, so every sheet is one window partition and all sheets go at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.functions.scalars import norm
from gridlens.operators import survey
from gridlens.session import stored
from gridlens.sources.grids import SHEET

TOLERANCE = 0.5


def row_facts(cells: DataFrame, merges: DataFrame, extents: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """One row for each row of a sheet, empty ones too: its identity and quantity cells, and its region over the identity column.

    The rows of the extent are joined with their cells and with the regions over them, all in order of rows, which is
    the order of the windows that follow. Of regions that overlap in the identity column, the one that starts last counts.
    """
    held = cells.groupBy(*SHEET).agg(F.max("r").alias("max_row"))
    held = stored(held, buckets) if buckets else held  # a row a sheet, in the buckets of its cells
    extents = held if extents is None else extents.select(*SHEET, "max_row")
    full = held if extents is held else extents.unionByName(held).groupBy(*SHEET).agg(F.max("max_row").alias("max_row"))
    columns = stored(survey.head_columns(cells).where("id_col is not null"), buckets).hint("shuffle_hash")  # a row a sheet
    is_id = F.col("c") == F.col("id_col")
    number = (F.col("c") == F.col("qty_col")) & F.col("dtype").isin("int", "float", "bool")
    term = (F.col("dtype") == "str") & F.array_contains("terms", norm(F.col("sval")))
    # Plain numbers and booleans, of which a hash aggregate keeps the largest in place: `id` tells whether the identity cell is a term.
    seen = cells.join(columns, SHEET, "left").select(*SHEET, "r", F.when(is_id, F.coalesce(term, F.lit(False))).alias("id"), F.when(number, F.col("nval")).alias("qty"), F.col("id_col").isNotNull().alias("known"))
    own = seen.groupBy(*SHEET, "r").agg(F.max("id").alias("id"), F.max("qty").alias("qty"), F.max("known").alias("known"), F.lit(True).alias("occupied"))
    # Only cells up to the identity column can be the anchor of a region over it.
    anchor = cells.join(columns.select(*SHEET, "id_col").hint("shuffle_hash"), SHEET).where("c <= id_col").select(*SHEET, F.col("r").alias("r1"), F.col("c").alias("c1"), F.lit(True).alias("top"))
    over = (
        merges.join(columns.select(*SHEET, "id_col").hint("shuffle_hash"), SHEET).where("c1 <= id_col and id_col <= c2").join(extents.hint("shuffle_hash"), SHEET).where("r1 <= max_row").join(anchor, [*SHEET, "r1", "c1"], "left")
        .select(*SHEET, F.explode(F.sequence(F.col("r1"), F.least("r2", "max_row"))).alias("r"), (F.col("r1").cast("long") * 2 + F.coalesce("top", F.lit(False)).cast("int")).alias("region"))
        .groupBy(*SHEET, "r").agg(F.max("region").alias("region"), F.lit(True).alias("covered"))
    )
    every = full.where("max_row > 0").select(*SHEET, F.explode(F.sequence(F.lit(1), F.col("max_row"))).alias("r"))
    region = F.when(F.col("region").isNotNull(), F.struct(F.shiftright("region", 1).cast("int").alias("r1"), (F.col("region") % 2 == 1).alias("filled")))
    return every.join(own, [*SHEET, "r"], "left").join(over, [*SHEET, "r"], "left").select(
        *SHEET, "r", F.when(F.col("id").isNotNull(), F.struct(F.col("id").alias("term"))).alias("id"), "qty", region.alias("region"), F.coalesce(F.col("known") | F.col("covered"), "covered", "known", F.lit(False)).alias("known"), F.coalesce("occupied", F.lit(False)).alias("occupied")
    )


def row_roles(cells: DataFrame, merges: DataFrame, extents: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """(r, role, group_id, anchor_idx) for every row from 1 to the last.

    header: a vocabulary text in the identity column before the first anchor; repeat_header: later; anchor: a value that
    no region covers from above; child: covered, under an anchor; total, grand_total: no identity and a quantity that
    is the sum of the group's, or of all, before it; else blank, as are empty rows and all of a sheet without an identity
    column.
    """
    run = Window.partitionBy(*SHEET).orderBy("r")
    so_far, before = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, -1)
    has_id, is_term = F.col("id").isNotNull(), F.coalesce(F.col("id.term"), F.lit(False))
    own_top = F.col("region").isNull() | (F.col("region.r1") == F.col("r"))
    facts = row_facts(cells, merges, extents, buckets).withColumn("is_anchor", has_id & own_top & ~is_term)
    facts = facts.withColumns({
        "late": F.coalesce(F.max("is_anchor").over(before), F.lit(False)),
        "group_no": F.sum(F.col("is_anchor").cast("int")).over(so_far) - 1,
        "last_anchor": F.last(F.when(F.col("is_anchor"), F.col("r")), ignorenulls=True).over(so_far),
    })
    is_child = F.col("occupied") & ~has_id & F.coalesce(F.col("region.filled"), F.lit(False)) & F.col("last_anchor").isNotNull()
    facts = facts.withColumn("is_child", is_child)
    counted = F.when(F.col("is_anchor") | F.col("is_child"), F.col("qty"))
    # Sums of a group before a row: the running sum of all, less what it was when the group began.
    facts = facts.withColumn("grand_sum", F.coalesce(F.sum(counted).over(before), F.lit(0.0)))
    start = F.max(F.when(F.col("is_anchor"), F.struct("r", "grand_sum"))).over(so_far)
    facts = facts.withColumn("group_sum", F.when(F.col("is_anchor"), 0.0).otherwise(F.col("grand_sum") - F.coalesce(start["grand_sum"], F.lit(0.0))))
    near = lambda total: F.coalesce(F.abs(F.col(total) - F.col("qty")) < TOLERANCE, F.lit(False))
    role = (
        F.when(~F.col("occupied") | ~F.col("known"), "blank").when(F.col("is_anchor"), "anchor").when(is_term & ~F.col("late"), "header").when(is_term, "repeat_header")
        .when(F.col("is_child"), "child").when(~has_id & F.col("last_anchor").isNotNull() & near("group_sum"), "total").when(~has_id & near("grand_sum"), "grand_total").otherwise("blank")
    )
    facts = facts.withColumn("role", role)
    inside = F.col("role").isin("anchor", "child")
    return facts.select(*SHEET, "r", "role", F.when(inside, F.col("group_no")).alias("group_id"), F.when(F.col("role") == "child", F.col("last_anchor")).alias("anchor_idx"), "qty", "group_sum", "grand_sum")


def role_counts(roles: DataFrame) -> DataFrame:
    """How many rows of each role a sheet has."""
    names = ["header", "repeat_header", "anchor", "child", "total", "grand_total", "blank"]
    return roles.groupBy(*SHEET).agg(*[F.count_if(F.col("role") == n).alias(f"n_{n}") for n in names])
