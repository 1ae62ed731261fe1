"""Signals of each sheet: vocabulary hits, date columns, blank runs, layout mode, identity and quantity columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.functions import vocab
from gridlens.functions.scalars import norm
from gridlens.operators.read import sheets
from gridlens.sources.grids import SHEET

HEADER_ROWS, QUANTITY_ROWS = 15, 10


def _head_text(cells: DataFrame, rows: int | None) -> DataFrame:
    """The texts of the first rows, of all rows without a number."""
    text = F.col("dtype") == "str"
    return cells.where(text if rows is None else (F.col("r") <= rows) & text).select(*SHEET, "r", "c", F.col("sval").alias("raw"), norm(F.col("sval")).alias("text"))


def _holds(text: F.Column, words: list[str]) -> F.Column:
    """Whether a text contains one of the words; one pattern, so that the text is made once and not for each word."""
    return text.rlike("|".join(map(re.escape, words)))


def vocab_hits(cells: DataFrame, rows: int | None = HEADER_ROWS) -> DataFrame:
    """Texts of the header rows (None: of all rows) that contain an identity term."""
    return _head_text(cells, rows).where(_holds(F.col("text"), vocab.IDENTITY))


def key_hits(cells: DataFrame, rows: int | None = HEADER_ROWS) -> DataFrame:
    """Texts of the header rows (None: of all rows) that begin or end with a key label."""
    labels = "|".join(map(re.escape, vocab.KEY_LABELS))
    return _head_text(cells, rows).where(F.col("text").rlike(rf"^(?:{labels})|(?:{labels})\z"))


def date_columns(cells: DataFrame) -> DataFrame:
    """Columns with two cells or more, half of them native dates at least."""
    counts = cells.groupBy(*SHEET, "c").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("dtype") == "date").alias("dates"))
    return counts.where((F.col("seen") >= 2) & (F.col("dates") * 2 >= F.col("seen")))


def blank_gaps(cells: DataFrame, extents: DataFrame | None = None) -> DataFrame:
    """(g_start, g_end): maximal runs of empty rows of a sheet, at its start and end too; gaps between neighbours among the
    occupied rows, and what the extent holds after the last of them. Without extents a sheet ends at its last cell."""
    before = F.lag("r", 1, 0).over(Window.partitionBy(*SHEET).orderBy("r"))
    rows = cells.select(*SHEET, "r").distinct().withColumn("prev", before).where("r - prev > 1")
    inside = rows.select(*SHEET, (F.col("prev") + 1).alias("g_start"), (F.col("r") - 1).alias("g_end"))
    if extents is None:
        return inside
    last = cells.groupBy(*SHEET).agg(F.max("r").alias("last"))
    after = extents.select(*SHEET, "max_row").join(last, SHEET, "left").withColumn("last", F.coalesce("last", F.lit(0))).where("max_row > last")
    return inside.unionByName(after.select(*SHEET, (F.col("last") + 1).alias("g_start"), F.col("max_row").alias("g_end")))


def signals(cells: DataFrame, extents: DataFrame | None = None) -> DataFrame:
    """One row a sheet: extent, identity candidates in order of first hit, vocabulary hits by column, date columns, blank runs, key hits."""
    gaps = blank_gaps(cells, extents).groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("g_start", "g_end"))).alias("gaps"))
    extents = sheets(cells) if extents is None else extents
    place = F.struct("r", "c")
    hit = vocab_hits(cells).groupBy(*SHEET, "c").agg(F.min(place).alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("r", "raw"))), lambda x: x["raw"]).alias("raws"))
    hits = hit.groupBy(*SHEET).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("identity_candidates"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "raws")))).alias("vocab_hits"))
    dates = date_columns(cells).groupBy(*SHEET).agg(F.array_sort(F.collect_list("c")).alias("date_cols"))
    keys = key_hits(cells).groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("r", "c", "raw"))).alias("key_hits"))
    out = extents.select(*SHEET, "max_row", "max_col")
    for part in (hits, dates, gaps, keys):
        out = out.join(part, SHEET, "left")
    return out


def modes(cells: DataFrame, extents: DataFrame | None = None, rows: int | None = HEADER_ROWS) -> DataFrame:
    """(mode, n_real, n_hits, n_hit_rows, n_gaps) of each sheet: row, section or sheet, by the texts of its first rows (None: of all)."""
    hits = key_hits(cells, rows)
    candidates = vocab_hits(cells, rows).select(*SHEET, "c").distinct()
    per_column = hits.join(candidates, [*SHEET, "c"], "left_semi").groupBy(*SHEET, "c").agg(F.count_distinct("r").alias("rows"), F.count_distinct("raw").alias("labels"))
    real = per_column.groupBy(*SHEET).agg(F.count_if((F.col("rows") == 1) | (F.col("labels") == 1)).alias("n_real"))
    counts = hits.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct("r").alias("n_hit_rows"))
    gaps = blank_gaps(cells, extents).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_gaps"))
    extents = sheets(cells) if extents is None else extents
    joined = extents.select(*SHEET).join(real, SHEET, "left").join(counts, SHEET, "left").join(gaps, SHEET, "left").na.fill(0, ["n_real", "n_hits", "n_hit_rows", "n_gaps"])
    mode = F.when(F.expr("n_real > 0 and n_gaps >= 2 and n_hits >= 3 and n_hit_rows >= 2"), "section").when(F.col("n_real") > 0, "row").when(F.col("n_hits") >= 2, "sheet").otherwise("row")
    return joined.withColumn("mode", mode)


def identity_columns(cells: DataFrame) -> DataFrame:
    """(c): the first column, in order of first hit, with a hit of the first choice; else the first with any."""
    hits = vocab_hits(cells)
    first = _holds(F.lower("raw"), vocab.IDENTITY_FIRST)
    columns = hits.groupBy(*SHEET, "c").agg(F.min(F.struct("r", "c")).alias("at"), F.max(first).alias("first"))
    return columns.groupBy(*SHEET).agg(F.min_by("c", F.struct(F.when(F.col("first"), 0).otherwise(1), "at")).alias("id_col"))


def head_columns(cells: DataFrame) -> DataFrame:
    """(id_col, qty_col, terms): the identity and quantity columns of each sheet and its vocabulary texts, in one pass over the
    header rows. Sheets with neither have no row."""
    head = _head_text(cells, HEADER_ROWS)
    hit = _holds(F.col("text"), vocab.IDENTITY)
    first = _holds(F.lower("raw"), vocab.IDENTITY_FIRST)
    amount = (F.col("r") <= QUANTITY_ROWS) & (F.contains("text", F.lit("qty")) | F.contains("text", F.lit("quantity")))
    told = head.withColumns({"hit": hit, "amount": amount}).where("hit or amount")
    columns = told.groupBy(*SHEET, "c").agg(
        F.min(F.when(F.col("hit"), F.struct("r", "c"))).alias("at"), F.coalesce(F.max(F.when(F.col("hit"), first)), F.lit(False)).alias("first"), F.max("amount").alias("amount"), F.collect_set(F.when(F.col("hit"), F.col("text"))).alias("texts")
    )
    order = F.when(F.col("at").isNotNull(), F.struct((~F.col("first")).alias("later"), "at"))
    return columns.groupBy(*SHEET).agg(F.min(order)["at"]["c"].alias("id_col"), F.min(F.when(F.col("amount"), F.col("c"))).alias("qty_col"), F.array_distinct(F.flatten(F.collect_list("texts"))).alias("terms"))


def quantity_columns(cells: DataFrame) -> DataFrame:
    """(qty_col): the leftmost column with a quantity header in the first rows."""
    found = _head_text(cells, QUANTITY_ROWS).where(F.contains("text", F.lit("qty")) | F.contains("text", F.lit("quantity")))
    return found.groupBy(*SHEET).agg(F.min("c").alias("qty_col"))
