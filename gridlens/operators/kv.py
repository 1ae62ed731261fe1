"""Keys and values side by side, and blocks of rows that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.functions.address import address
from gridlens.operators import survey
from gridlens.sources.grids import SHEET


def key_values(cells: DataFrame) -> DataFrame:
    """(label, label_row, label_cell, value_row, value_col, value_cell) for each key label with a value.

    The right cell if it is no text; a text on the right if nothing is below; else the cell below, if any.
    """
    beside = lambda name, dr, dc: cells.select(*SHEET, (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("dtype").alias(name))
    both = survey.key_hits(cells).join(beside("right", 0, 1), [*SHEET, "r", "c"], "left").join(beside("below", 1, 0), [*SHEET, "r", "c"], "left")
    goes = F.when(F.col("right") != "str", "right").when(F.col("right").isNotNull() & F.col("below").isNull(), "right").when(F.col("below").isNotNull(), "below")
    found = both.withColumn("goes", goes).where("goes is not null").withColumns({"value_row": F.col("r") + (F.col("goes") == "below").cast("int"), "value_col": F.col("c") + (F.col("goes") == "right").cast("int")})
    return found.select(*SHEET, F.col("raw").alias("label"), F.col("r").alias("label_row"), address(F.col("r"), F.col("c")).alias("label_cell"), "value_row", "value_col", address(F.col("value_row"), F.col("value_col")).alias("value_cell"))


def blocks(anchors: DataFrame, gaps: DataFrame) -> DataFrame:
    """(block_id, start, end) for anchors (sheet, r): up to the first gap or the row before the next anchor; else one row.

    The first gap at or after an anchor comes from a forward fill over anchors and gaps in one order, not from a range join.
    """
    points = anchors.select(*SHEET, "r", F.lit(True).alias("is_anchor")).unionByName(gaps.select(*SHEET, F.col("g_start").alias("r"), F.lit(False).alias("is_anchor")))
    run = Window.partitionBy(*SHEET).orderBy("r", F.col("is_anchor").desc())
    ahead = run.rowsBetween(1, Window.unboundedFollowing)
    marked = points.withColumns({
        "gap": F.first(F.when(~F.col("is_anchor"), F.col("r")), ignorenulls=True).over(ahead),
        "next": F.first(F.when(F.col("is_anchor"), F.col("r")), ignorenulls=True).over(ahead),
    }).where("is_anchor")
    end = F.when(F.col("gap").isNotNull() & (F.col("next").isNull() | (F.col("gap") < F.col("next"))), F.col("gap") - 1).when(F.col("next").isNotNull(), F.col("next") - 1).otherwise(F.col("r"))
    number = F.row_number().over(Window.partitionBy(*SHEET).orderBy("r")) - 1
    return marked.select(*SHEET, number.alias("block_id"), F.col("r").alias("start"), end.alias("end"))


def placed(found: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """Rows that lie in a block at row `at`, with its block_id, start and end.

    Blocks of a sheet do not overlap, so a row can lie in none but the last that starts at or before it: one forward fill
    over starts and rows in order, in time that grows with their number, not with blocks times rows.
    """
    starts = found.select(*SHEET, F.col("start").alias("_at"), F.struct("block_id", "start", "end").alias("_block"))
    points = rows.withColumns({"_at": at, "_row": F.lit(True)}).unionByName(starts, allowMissingColumns=True)
    run = Window.partitionBy(*SHEET).orderBy("_at", F.col("_row").asc_nulls_first(), "_block.block_id").rowsBetween(Window.unboundedPreceding, 0)
    filled = points.withColumn("_in", F.last("_block", ignorenulls=True).over(run)).where("_row and _at <= _in.end")
    return filled.select(*rows.columns, "_in.block_id", "_in.start", "_in.end")


def block_members(found: DataFrame, keyed: DataFrame) -> DataFrame:
    """Key-value pairs whose label lies in a block."""
    return placed(found, keyed, F.col("label_row"))
