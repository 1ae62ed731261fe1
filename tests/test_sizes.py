"""What is sent to all executors is judged by its size as rows, not by its Parquet bytes."""

from pyspark.sql import functions as F

from gridlens.operators import apply, read
from gridlens.plans.catalog import queries
from gridlens.plans.survey_queries import order_roles
from gridlens.session import SHEET, clustered
from gridlens.sources import grids

SF = "/root/testdata/sf0.001"


def test_tables_that_pack_well_are_not_broadcast(spark):
    """400,000 rows take some 35 MB in memory, over three times the threshold, and under 1 MB as Parquet."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        rows = spark.range(400_000).select(F.lit("orders").alias("workbook_id"), F.concat(F.lit("C"), F.floor(F.col("id") / 40)).alias("sheet"), (F.col("id") % 40).cast("int").alias("r"), F.lit("child").alias("role"), (F.abs(F.hash("id")) % 50).cast("int").alias("qty"))
        big = clustered(rows, SHEET, 4)
        other = clustered(rows.where("r = 1"), SHEET, 4).select(*SHEET, F.col("role").alias("first"))
        plan = big.join(big.withColumnsRenamed({"role": "again", "qty": "amount"}), [*SHEET, "r"])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "Exchange" not in plan
        # A row a sheet, under the threshold: the planner may still send it.
        assert other.join(big, SHEET).count() == 400_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_settings_hold_for_queries_on_bands(spark):
    queries()["stage_bands"](spark, SF)
    assert int(spark.conf.get("spark.sql.sources.fileCompressionFactor").split(".")[0]) > 1
    assert grids.cells(spark, SF, "bands").count() > 0


def test_values_of_items_stay_in_their_buckets(spark):
    """What cells of their own hold is gathered where it lies; regions' values alone are shuffled, and no place is sorted to meet its cell."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cells, merges, roles = grids.cells(spark, SF, "orders"), grids.merges(spark, SF), order_roles(spark, SF)
        data = apply.item_rows(roles).select(*SHEET, "r")
        labels = apply.named(apply.header_labels(cells, roles), apply.name_map(spark)).select(*SHEET, "c", "canonical")
        own, through = apply.row_parts(cells, merges, data, labels)
        plan = own.groupBy(*SHEET, "r").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
        asked = data.join(labels, SHEET)
        key = lambda df: sorted((x["sheet"], x["r"], x["canonical"], x["sval"], x["addr"]) for x in df.collect())
        assert key(apply.row_values(cells, merges, data, labels)) == key(read.look(cells, merges, asked))
        assert through.count() > 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
