"""Reads over cells: windows, rows, points, neighbours, searches. A cell that is not stored is empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.functions import address
from gridlens.sources.grids import SHEET


def sheets(cells: DataFrame) -> DataFrame:
    """Extent of each sheet."""
    return cells.groupBy(*SHEET).agg(F.max("r").alias("max_row"), F.max("c").alias("max_col")).withColumn("dimensions", F.concat(F.lit("A1:"), address.address(F.col("max_row"), F.col("max_col"))))


def workbooks(cells: DataFrame) -> DataFrame:
    """Number of sheets and the first and last sheet name of each workbook."""
    return cells.groupBy("workbook_id").agg(F.count_distinct("sheet").alias("sheet_count"), F.min("sheet").alias("first_sheet"), F.max("sheet").alias("last_sheet"), F.count(F.lit(1)).alias("cell_count"))


def with_address(cells: DataFrame) -> DataFrame:
    return cells.withColumn("addr", address.address(F.col("r"), F.col("c")))


def peek(cells: DataFrame, rows: int = 10, cols: int = 15) -> DataFrame:
    """The top left window of every sheet."""
    return cells.where((F.col("r") <= rows) & (F.col("c") <= cols))


def read_range(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """An inclusive rectangle of every sheet."""
    return cells.where(F.col("r").between(*rows) & F.col("c").between(*cols))


def read_row(cells: DataFrame, row: int, cols: tuple[int, int] | None = None) -> DataFrame:
    found = cells.where(F.col("r") == row)
    return found.where(F.col("c").between(*cols)) if cols else found


def sample_rows(cells: DataFrame, indices: list[int]) -> DataFrame:
    """(sheet, pos, row, values): the listed rows of every sheet in the order given, repeats kept, empty rows with no values.

    The rows are few, so only they are read and grouped; each value is `column:text`, by column.
    """
    wanted = [(p, r) for p, r in enumerate(indices)]
    listed = cells.sparkSession.createDataFrame(wanted, "pos int, row int")
    rows = cells.where(F.col("r").isin(*{r for _, r in wanted})).groupBy(*SHEET, F.col("r").alias("row")).agg(F.array_sort(F.collect_list(F.struct("c", "sval"))).alias("held"))
    asked = cells.select(*SHEET).distinct().crossJoin(F.broadcast(listed))  # at most as many rows a sheet as are listed
    values = F.coalesce(F.transform("held", lambda x: F.concat_ws(":", x["c"].cast("string"), x["sval"])), F.array().cast("array<string>"))
    return asked.join(rows, [*SHEET, "row"], "left").select(*SHEET, "pos", "row", values.alias("values"))


def read_relative(cells: DataFrame, anchors: DataFrame, dy: int, dx: int) -> DataFrame:
    """For each anchor (sheet, addr) the cell dy rows below and dx columns right of it; null if empty."""
    at = anchors.withColumns({"r": address.row_of(F.col("addr")) + dy, "c": address.column_of(F.col("addr")) + dx})
    return at.join(cells.select(*SHEET, "r", "c", "dtype", "sval"), [*SHEET, "r", "c"], "left")


def cell_at(cells: DataFrame, addr: str) -> DataFrame:
    """The cell with an address in every sheet."""
    import re

    letters, row = re.fullmatch(r"([A-Za-z]+)(\d+)", addr).groups()
    column = 0
    for x in letters.upper():
        column = column * 26 + ord(x) - 64
    return cells.where((F.col("r") == int(row)) & (F.col("c") == column))


def merged_regions(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Each region's range, its anchor and the anchor's value."""
    anchor = cells.select(*SHEET, F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("sval").alias("anchor_value"))
    name = F.concat_ws(":", address.address(F.col("r1"), F.col("c1")), address.address(F.col("r2"), F.col("c2")))
    return merges.join(anchor, [*SHEET, "r1", "c1"], "left").withColumns({"range": name, "anchor": address.address(F.col("r1"), F.col("c1"))})


def count_non_empty(cells: DataFrame, column: int, rows: tuple[int, int] | None = None) -> DataFrame:
    """How many cells of a column are not empty, in every sheet."""
    here = F.col("c") == column
    if rows:
        here = here & F.col("r").between(*rows)
    return cells.groupBy(*SHEET).agg(F.count_if(here).alias("n"))


def find_value(cells: DataFrame, needle: str, max_hits: int = 10, ignore_case: bool = True) -> DataFrame:
    """The first hits in row-major order of each sheet whose text contains the needle literally: a top-k report."""
    text: Column = F.lower("sval") if ignore_case else F.col("sval")
    hits = cells.where(F.contains(text, F.lit(needle.lower() if ignore_case else needle)))
    return hits.withColumn("hit", F.row_number().over(Window.partitionBy(*SHEET).orderBy("r", "c"))).where(F.col("hit") <= max_hits)


VALUE = ["dtype", "sval", "nval", "dval"]


def region_starts(cells: DataFrame, merges: DataFrame, columns: DataFrame) -> DataFrame:
    """(r, c, _region): where the regions that have a value begin in the asked columns (c), with their last row and anchor.

    A region is cut to the columns up to the last that its sheet asks for, so it makes a row for each of these at most,
    whatever number of rows and columns it spans.
    """
    last = columns.groupBy(*SHEET).agg(F.max("c").alias("_last"))
    anchor = cells.select(*SHEET, F.col("r").alias("r1"), F.col("c").alias("c1"), F.struct(*VALUE).alias("value"))
    # Sheets, columns and regions are fewer than cells: they are held, and no cells are sorted to meet them.
    held = merges.join(last.hint("shuffle_hash"), SHEET).where("c1 <= _last").hint("shuffle_hash")
    wide = anchor.join(held, [*SHEET, "r1", "c1"])
    own = wide.withColumn("c", F.explode(F.sequence("c1", F.least("c2", "_last")))).join(columns.select(*SHEET, "c").distinct().hint("shuffle_hash"), [*SHEET, "c"], "left_semi")
    return own.select(*SHEET, F.col("r1").alias("r"), "c", F.struct("r1", "c1", "r2", "value").alias("_region"))


def look(cells: DataFrame, merges: DataFrame, asked: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """The asked places (sheet, r, c and what else they carry) at which a reader sees a value, with dtype, sval, nval, dval and addr.

    That is the cell itself or else the anchor of the region it lies in. The regions of a column are an index of
    intervals: each place without a cell of its own takes the last that starts at or before it, by one forward fill over
    starts and places in order of rows, and looks through it if it reaches so far; places with a cell, or in a column
    without regions, do not go there, and those that do take along what they ask with. Regions that a program wrote do not overlap; if some do, the
    one that starts last counts, the one further right among those. `columns` holds the asked columns (sheet, c), if it
    is known without going through `asked`.
    """
    columns = asked.select(*SHEET, "c").distinct() if columns is None else columns
    place = [*SHEET, "r", "c"]
    under = asked.join(spanned(merges, columns).hint("shuffle_hash"), [*SHEET, "c"], "left_semi")
    through = look_through(cells, merges, under, columns)
    own = asked.join(cells.select(*place, F.struct(*VALUE).alias("_own")), place).select(*asked.columns, "_own.*", address.address(F.col("r"), F.col("c")).alias("addr"))
    return own.unionByName(through)


def spanned(merges: DataFrame, columns: DataFrame) -> DataFrame:
    """Those of the columns (sheet, c) that a region spans."""
    return merges.select(*SHEET, "c1", "c2").distinct().join(columns.select(*SHEET, "c").distinct().hint("shuffle_hash"), SHEET).where("c between c1 and c2").select(*SHEET, "c").distinct()


def look_through(cells: DataFrame, merges: DataFrame, under: DataFrame, columns: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The part of `look` that regions answer: the places asked without a cell of their own, all in columns that regions span.

    `held` are the cells of those columns, if they have been told from others."""
    place = [*SHEET, "r", "c"]
    empty = under.join((cells if held is None else held).select(*place), place, "left_anti").select(*place, F.lit(True).alias("_asked"), F.struct(*under.columns).alias("_place"))
    events = empty.unionByName(region_starts(cells, merges, columns), allowMissingColumns=True)
    run = Window.partitionBy(*SHEET, "c").orderBy("r", F.col("_asked").asc_nulls_first(), "_region.c1").rowsBetween(Window.unboundedPreceding, 0)
    over = events.withColumn("_over", F.last("_region", ignorenulls=True).over(run)).where("_asked and _over.r2 >= r")
    return over.select("_place.*", "_over.value.*", address.address(F.col("_over.r1"), F.col("_over.c1")).alias("addr"))


def look_rows(cells: DataFrame, merges: DataFrame, data: DataFrame, columns: DataFrame, made: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[DataFrame]:
    """What `look` says of all places of rows (sheet, r) and columns (sheet, c and what else they carry): the cells themselves, and what is seen through regions.

    Cells meet their columns and rows where they lie, so that no place is made for a cell to be found, and none is sorted;
    places are made in columns that regions span alone. A union of both would lose the buckets of the first.
    What is to be `made` of each value (keeping sheet and r) is made before it meets its row: an aggregate right above would
    take in the expressions and evaluate them uncompiled.
    """
    own = cells.select(*SHEET, "r", "c", *VALUE).join(columns.hint("shuffle_hash"), [*SHEET, "c"]).withColumn("addr", address.address(F.col("r"), F.col("c")))
    wide = spanned(merges, columns).hint("shuffle_hash")
    asked = data.select(*SHEET, "r").join(columns.join(wide, [*SHEET, "c"], "left_semi").hint("shuffle_hash"), SHEET)
    through = look_through(cells, merges, asked, columns, cells.join(wide, [*SHEET, "c"], "left_semi"))
    return [made(own).join(data.select(*SHEET, "r").hint("shuffle_hash"), [*SHEET, "r"]), made(through)]
