"""Stage bands: a row of stage names over columns of dates, with sub-columns or sub-rows.

Neighbour rows are reached by equi-joins at row offsets, the owner of a sub-column by an as-of window, and what comes
first or last by min_by and max_by, so all bands of all sheets are found at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlens.functions import vocab
from gridlens.functions.address import address
from gridlens.functions.scalars import is_date_cell
from gridlens.sources.grids import SHEET

LOOK_AHEAD = 5


def _role(text: F.Column) -> F.Column:
    """The role that a sub-label stands for, null for any other text."""
    words = F.create_map(*[F.lit(x) for pair in vocab.SUB_LABELS.items() for x in pair])
    return F.try_element_at(words, F.lower(F.trim(text)))


def probes(cells: DataFrame) -> DataFrame:
    """(r, sub_header, date_cols) of each row with two date cells or more and a row of names above it."""
    flagged = cells.withColumn("is_date", is_date_cell(F.col("dtype"), F.col("sval")))
    # Only rows with a name one or two rows above can have a row of names there; most rows of dates have none.
    below = flagged.where((F.col("dtype") == "str") & ~F.col("is_date")).select(*SHEET, F.explode(F.array(F.col("r") + 1, F.col("r") + 2)).alias("r")).distinct()
    dates = flagged.where("is_date").select(*SHEET, "r", "c").join(below.hint("shuffle_hash"), [*SHEET, "r"], "left_semi")

    def above(k: int) -> DataFrame:
        text = flagged.where(F.col("dtype") == "str").select(*SHEET, (F.col("r") + k).alias("r"), "c", (~F.col("is_date")).alias(f"name{k}"), F.coalesce(_role(F.col("sval")).isNotNull(), F.lit(False)).alias(f"sub{k}"))
        return text

    facts = (
        dates.join(above(1), [*SHEET, "r", "c"], "left").join(above(2), [*SHEET, "r", "c"], "left")
        .groupBy(*SHEET, "r")
        .agg(F.array_sort(F.collect_set("c")).alias("date_cols"), F.count_if("name1").alias("s1"), F.count_if("name2").alias("s2"), F.coalesce(F.min("sub1"), F.lit(False)).alias("only_sub"))
        .where(F.size("date_cols") >= 2)
    )
    enough = F.greatest(F.lit(2), F.floor(F.size("date_cols") / 2))
    header = (
        F.when((F.col("r") > 1) & (F.col("s1") >= enough), F.when(F.col("only_sub") & (F.col("r") > 2) & (F.col("s2") >= 1), F.col("r") - 2).otherwise(F.col("r") - 1))
        .when((F.col("r") > 2) & (F.col("s2") >= enough), F.col("r") - 2)
    )
    return facts.withColumn("sub_header", header).where("sub_header is not null").select(*SHEET, "r", "sub_header", "date_cols")


def bands(cells: DataFrame) -> DataFrame:
    """(r, sub_header, title, name_cell, date_cols): one band for each cell that names one, the first row that leads to it."""
    found = probes(cells)
    named = cells.where((F.col("dtype") == "str") & (F.trim("sval") != "")).select(*SHEET, F.col("r").alias("at"), "c", F.trim("sval").alias("name"))
    own = found.join(named.withColumnRenamed("at", "sub_header"), [*SHEET, "sub_header"], "left")
    outside = F.when(~F.array_contains("date_cols", F.col("c")), F.struct("c", "name"))
    heads = own.groupBy(*SHEET, "r", "sub_header", "date_cols").agg(F.min(outside).alias("beside"), F.coalesce(F.max(F.array_contains("date_cols", F.col("c"))), F.lit(False)).alias("has_stage")).where("has_stage")
    over = named.groupBy(*SHEET, (F.col("at") + 1).alias("sub_header")).agg(F.min(F.struct("c", "name")).alias("over"))
    titled = heads.join(over, [*SHEET, "sub_header"], "left")
    title = F.coalesce(F.col("beside.name"), F.col("over.name"), F.lit("stage_band"))
    cell = F.when(F.col("beside").isNotNull(), address(F.col("sub_header"), F.col("beside.c"))).when(F.col("over").isNotNull(), address(F.col("sub_header") - 1, F.col("over.c"))).otherwise(address(F.col("sub_header"), F.lit(1)))
    first = Window.partitionBy(*SHEET, "name_cell").orderBy("r")
    return titled.select(*SHEET, "r", "sub_header", title.alias("title"), cell.alias("name_cell"), "date_cols").withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def sub_rows(cells: DataFrame, found: DataFrame) -> DataFrame:
    """(r, role, row): the first row of each role among a band's first row and the five after it."""
    labels = cells.where(F.col("c").isin(1, 2) & (F.col("dtype") == "str")).groupBy(*SHEET, F.col("r").alias("row")).agg(F.max_by("sval", "c").alias("label")).withColumn("role", _role(F.col("label"))).where("role is not null")
    ahead = found.select(*SHEET, "r", F.explode(F.sequence(F.col("r"), F.col("r") + LOOK_AHEAD)).alias("row"))
    return ahead.join(labels, [*SHEET, "row"]).groupBy(*SHEET, "r", "role").agg(F.min("row").alias("row"))


def layouts(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds layout (tall_sub_rows if a band has sub-rows, else wide_sub_columns) and plan_row."""
    plan = rows.groupBy(*SHEET, "r").agg(F.min(F.when(F.col("role") == "plan", F.col("row"))).alias("plan"), F.count(F.lit(1)).alias("n"))
    return found.join(plan, [*SHEET, "r"], "left").withColumns({"layout": F.when(F.col("n") > 0, "tall_sub_rows").otherwise("wide_sub_columns"), "plan_row": F.coalesce("plan", "r")}).drop("plan", "n")


def stage_columns(cells: DataFrame, merges: DataFrame, laid: DataFrame) -> DataFrame:
    """(r, stage, primary_col, first_col, sub_label, sub_col): a row for each sub-column of a stage, one with nulls if it has none.

    A stage named twice stands in its last column and at the place of its first."""
    text = cells.where((F.col("dtype") == "str") & (F.trim("sval") != "")).select(*SHEET, F.col("r").alias("at"), "c", F.trim("sval").alias("name"))
    dates = laid.select(*SHEET, "r", "sub_header", "layout", F.explode("date_cols").alias("c"))
    stages = dates.join(text.withColumnRenamed("at", "sub_header"), [*SHEET, "sub_header", "c"]).groupBy(*SHEET, "r", "sub_header", "layout", F.col("name").alias("stage")).agg(F.max("c").alias("primary_col"), F.min("c").alias("first_col"))
    labels = laid.where("layout = 'wide_sub_columns'").select(*SHEET, "r", (F.col("sub_header") + 1).alias("at")).join(text.where(_role(F.col("name")).isNotNull()), [*SHEET, "at"]).select(*SHEET, "r", "c", F.col("name").alias("sub_label"), F.lit(None).cast("string").alias("stage"))
    points = labels.unionByName(stages.select(*SHEET, "r", F.col("primary_col").alias("c"), F.lit(None).cast("string").alias("sub_label"), "stage"))
    run = Window.partitionBy(*SHEET, "r").orderBy("c", F.col("stage").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*SHEET, "r", "c")
    owned = points.withColumns({"owner": F.last("stage", ignorenulls=True).over(run), "taken": F.max("stage").over(here).isNotNull()}).where("sub_label is not null and owner is not null and not taken")
    subs = owned.groupBy(*SHEET, "r", F.col("owner").alias("stage"), "sub_label").agg(F.max("c").alias("sub_col"))
    joined = stages.join(subs, [*SHEET, "r", "stage"], "left")
    starts = merges.where("r1 = r2 and c2 > c1").select(*SHEET, F.col("r1").alias("sub_header"), F.col("c1").alias("primary_col"), F.lit(True).alias("merged")).distinct()
    band = Window.partitionBy(*SHEET, "r")
    kept = joined.join(starts, [*SHEET, "sub_header", "primary_col"], "left").withColumn("any_sub", F.max(F.col("sub_col").isNotNull()).over(band))
    return kept.where("not any_sub or sub_col is not null or merged").select(*SHEET, "r", "stage", "primary_col", "first_col", "sub_label", "sub_col")
