"""Checks of plans and items: each returns what it found, with the parts of a message as columns; `findings` makes one table of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.functions import scalars, vocab
from gridlens.functions.address import column_of, row_of
from gridlens.sources.grids import SHEET

MIN_COVERAGE, MIN_DENSITY, MIN_FILLED, MIN_ROWS, GATE = 0.8, 0.5, 0.5, 10, 0.85


def references(specs: DataFrame) -> DataFrame:
    """Children without an anchor row of their index, and anchors that point at another row."""
    anchors = specs.where("role = 'anchor'").select(*SHEET, F.col("r").alias("anchor_idx")).distinct()
    lost = specs.where("role = 'child'").join(anchors, [*SHEET, "anchor_idx"], "left_anti").select(*SHEET, "r", "anchor_idx", F.when(F.col("anchor_idx").isNull(), "child_without_anchor").otherwise("dangling_anchor").alias("what"))
    return lost.unionByName(specs.where("role = 'anchor' and anchor_idx is not null").select(*SHEET, "r", "anchor_idx", F.lit("anchor_with_anchor").alias("what")))


def repeated_rows(specs: DataFrame) -> DataFrame:
    """Each repeat of a row index after the first."""
    counted = specs.groupBy(*SHEET, "r").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.select(*SHEET, "r", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("nth"))


def header_rows(specs: DataFrame) -> DataFrame:
    """Sheets whose header rows are not consecutive, or come after the first data row."""
    facts = specs.groupBy(*SHEET).agg(F.min(F.when(F.col("role") == "header", F.col("r"))).alias("low"), F.max(F.when(F.col("role") == "header", F.col("r"))).alias("high"), F.count_if(F.col("role") == "header").alias("n"), F.min(F.when(F.col("role").isin("anchor", "child"), F.col("r"))).alias("data"))
    return facts.where("n > 0 and (high - low + 1 <> n or data < high)").select(*SHEET, (F.col("high") - F.col("low") + 1 != F.col("n")).alias("apart"), F.coalesce(F.col("data") < F.col("high"), F.lit(False)).alias("late"))


def overlaps(blocks: DataFrame) -> DataFrame:
    """Blocks that end at or after the start of the next one."""
    after = F.lead("start").over(Window.partitionBy(*SHEET).orderBy("start", "end"))
    return blocks.withColumn("next_start", after).where("next_start <= end")


def channels(facts: DataFrame) -> DataFrame:
    """Plans (mode, n_rows, n_blocks, n_keys) with several identity channels, or with the wrong one for their mode."""
    filled = (F.col("n_rows") > 0).cast("int") + (F.col("n_blocks") > 0).cast("int") + (F.col("n_keys") > 0).cast("int")
    own = F.when(F.col("mode") == "row", F.col("n_rows")).when(F.col("mode") == "section", F.col("n_blocks")).otherwise(F.col("n_keys"))
    return facts.withColumns({"several": filled > 1, "wrong": (own == 0) & (filled > 0)}).where("several or wrong")


def identity_coverage(specs: DataFrame, cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(share) of sheets where under 0.8 of the data rows have an identity or an anchor."""
    ids = cells.join(columns, SHEET).where("c = id_col").select(*SHEET, "r", F.lit(True).alias("has_id"))
    data = specs.where("role in ('anchor', 'child')").join(columns.select(*SHEET), SHEET, "left_semi").join(ids, [*SHEET, "r"], "left")
    share = data.groupBy(*SHEET).agg(F.avg((F.col("has_id").isNotNull() | F.col("anchor_idx").isNotNull()).cast("double")).alias("share"))
    return share.where(F.col("share") < MIN_COVERAGE)


def item_counts(sheets: DataFrame, specs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Sheets of ten rows or more with neither anchors nor key-value pairs."""
    some = specs.where("role = 'anchor'").select(*SHEET).unionByName(keyed.select(*SHEET)).distinct()
    return sheets.where(F.col("max_row") >= MIN_ROWS).join(some, SHEET, "left_anti").select(*SHEET, "max_row")


def date_density(cells: DataFrame, bands: DataFrame, columns: DataFrame) -> DataFrame:
    """(r, title, filled, dates): bands with two filled places or more under their stages in all their sub-rows, under half of them native dates."""
    rows = bands.select(*SHEET, "r", "title", F.explode(F.array_distinct(F.map_values("sub_rows"))).alias("at"))
    places = rows.join(columns.select(*SHEET, "r", F.col("primary_col").alias("c")).distinct(), [*SHEET, "r"])
    there = places.join(cells.select(*SHEET, F.col("r").alias("at"), "c", "dtype"), [*SHEET, "at", "c"])
    counts = there.groupBy(*SHEET, "r", "title").agg(F.count(F.lit(1)).alias("filled"), F.count_if(F.col("dtype") == "date").alias("dates"))
    return counts.where((F.col("filled") >= 2) & (F.col("dates") < MIN_DENSITY * F.col("filled")))


def running_numbers(specs: DataFrame, cells: DataFrame) -> DataFrame:
    """(largest, n): sheets whose running number, in the first column headed so, does not end at their count of anchors."""
    heads = specs.where("role = 'header'").select(*SHEET, "r")
    spelt = cells.where((F.col("dtype") == "str") & F.lower(F.trim("sval")).isin(vocab.NUMBER_LABELS)).join(heads, [*SHEET, "r"], "left_semi")
    column = spelt.groupBy(*SHEET).agg(F.min("c").alias("c"))
    anchors = specs.where("role = 'anchor'").select(*SHEET, "r")
    counts = anchors.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n"))
    numbers = cells.where(F.col("dtype").isin("int", "float", "bool")).join(column, [*SHEET, "c"], "left_semi").join(anchors, [*SHEET, "r"], "left_semi")
    return numbers.groupBy(*SHEET).agg(F.max(F.col("nval").cast("bigint")).alias("largest")).join(counts, SHEET).where("largest <> n")


def source_cells(items: DataFrame, cells: DataFrame, strict: bool = False) -> DataFrame:
    """Item fields (sheet, item, field, value, addr) whose cell shows something else; `strict` compares the bare texts."""
    at = items.where("value is not null and value <> ''").withColumns({"_r": row_of(F.col("addr")), "_c": column_of(F.col("addr"))})
    seen = at.join(cells.select(*SHEET, F.col("r").alias("_r"), F.col("c").alias("_c"), "sval", "dtype", "nval"), [*SHEET, "_r", "_c"], "left")
    shown = F.col("sval") if strict else scalars.coerce_text(F.col("dtype"), F.col("sval"), F.col("nval"))
    same = shown.eqNullSafe(F.col("value")) if strict else scalars.values_equal(shown, F.col("value"))
    return seen.where(~same).select(*SHEET, "item", "field", "addr", "value", F.col("sval").alias("actual"))


def header_terms(items: DataFrame, cells: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """(c, field, item, told): each column that a field with terms was read from, and whether its first five rows hold one; the first item stands for all."""
    at = items.withColumn("c", column_of(F.col("addr"))).groupBy(*SHEET, "c", "field").agg(F.min("item").alias("item"))
    heads = cells.where((F.col("r") <= 5) & (F.col("dtype") == "str")).groupBy(*SHEET, "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.lower("sval").alias("t")))), lambda x: x["t"]), " ").alias("head"))
    terms = F.create_map(*[x for name, own in words.items() for x in (F.lit(name), F.array(*[F.lit(w) for w in own]))])
    known = at.where(F.col("field").isin(*words)).join(heads, [*SHEET, "c"], "left")
    return known.withColumn("told", F.exists(F.try_element_at(terms, F.col("field")), lambda t: F.contains(F.coalesce("head", F.lit("")), t))).drop("head")


def header_matches(items: DataFrame, cells: DataFrame) -> DataFrame:
    """(c, field, item) of columns without a term of their field in the first five rows."""
    return header_terms(items, cells, vocab.HEADER_TERMS).where("not told").select(*SHEET, "c", "field", "item")


def coverage(n_items: DataFrame, n_rows: DataFrame) -> DataFrame:
    """Sheets with fewer items than 0.8 of their candidate rows."""
    both = n_rows.join(n_items, SHEET, "left").withColumn("items", F.coalesce("items", F.lit(0)))
    return both.withColumn("share", F.col("items") / F.col("candidates")).where(F.col("share") < MIN_COVERAGE)


def dropout(items: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, total, ratio): fields filled in under half of the items."""
    filled = [F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f) for f in fields]
    wide = items.agg(*filled, F.count(F.lit(1)).alias("_n"))
    long = wide.unpivot(["_n"], fields, "field", "filled").withColumn("total", F.greatest("_n", F.lit(1)))
    return long.withColumn("ratio", F.col("filled") / F.col("total")).where(F.col("ratio") < MIN_FILLED).select("field", "filled", "total", "ratio")


def corrected(specs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Row specs with corrections (r, role, anchor_idx, ord) merged in; the last known role and anchor of a row win, others stay."""
    roles = ("anchor", "child", "header", "repeat_header", "total", "grand_total", "blank", "title", "separator")
    valid = F.col("new_role").isin(*roles)
    fixes = corrections.withColumnsRenamed({"role": "new_role", "anchor_idx": "new_anchor"}).groupBy(*SHEET, "r").agg(F.max_by(F.when(valid, F.col("new_role")), F.when(valid, F.col("ord"))).alias("new_role"), F.max_by("new_anchor", F.when(F.col("new_anchor").isNotNull(), F.col("ord"))).alias("new_anchor"))
    return specs.join(fixes, [*SHEET, "r"], "left").withColumns({"role": F.coalesce("new_role", "role"), "anchor_idx": F.coalesce("new_anchor", "anchor_idx")}).drop("new_role", "new_anchor")


def review_gate(warned: Column, confidence: Column, mode: Column) -> Column:
    """Whether a plan is to be reviewed: it has a warning, little confidence, or is not in row mode."""
    return F.coalesce(warned, F.lit(False)) | (confidence < GATE) | (mode != "row")


def warn_rate(findings: DataFrame, key: str) -> DataFrame:
    """The share of warnings and errors among a workbook's findings."""
    return findings.groupBy(key).agg(F.avg(F.col("severity").isin("warn", "error").cast("double")).alias("warn_rate"))


def confidence(field_confidence: DataFrame, rates: DataFrame, key: str) -> DataFrame:
    """0.7 of the mean field confidence and 0.3 of the share without warnings, to four places."""
    mean = field_confidence.groupBy(key).agg(F.avg("confidence").alias("mean"))
    both = mean.join(rates, key, "left")
    return both.select(key, F.round(0.7 * F.coalesce("mean", F.lit(0.0)) + 0.3 * (1 - F.coalesce("warn_rate", F.lit(0.0))), 4).alias("confidence"))
