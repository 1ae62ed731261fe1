"""The mode of a sheet by all its rows, not by its header rows alone."""

from pyspark.sql import functions as F

from gridlens.operators import survey
from gridlens.plans.catalog import oracle_sql, queries
from gridlens.sources import grids
from test_operators import grid

SF = "/root/testdata/sf0.001"


def test_labels_below_the_header_rows_decide_the_mode(spark):
    cells = grid(spark, {"s": {(1, 1): "x", (16, 1): "Fabric", (40, 1): "Style"}})
    one = survey.modes(cells, rows=None).first()
    assert (one.mode, one.n_hits, one.n_hit_rows, one.n_gaps) == ("sheet", 2, 2, 2)
    assert survey.modes(cells).first().n_hits == 0


def test_mode_decision_reads_all_rows(spark):
    cells = grids.cells(spark, SF, "orders")
    heads = cells.where("sval in ('STYLE', 'COLOR', 'ORDER QTY', 'IO NO', 'EX FAC DATE') and dtype = 'str'")
    rows = {x["sheet"]: x["n"] for x in heads.groupBy("sheet").agg(F.count_distinct("r").alias("n")).collect()}
    got = {x["sheet"]: x["n_hit_rows"] for x in queries()["mode_decision"](spark, SF).collect()}
    assert max(rows.values()) > 1 and got == rows
    assert "r <= 15" not in oracle_sql()["mode_decision"]
