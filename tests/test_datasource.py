"""Workbooks as a data source: the rows of the loader, a partition a sheet, pruned sheets, streams."""

import datetime
import zipfile

import pytest

from gridlens.sources import datasource, xlsx
from test_extract import write_book

DAY = datetime.datetime(2024, 3, 1)
ONE = {"first": {(1, 1): "IO NO", (2, 1): 1063, (2, 2): DAY, (3, 27): 1.5}, "second": {(1, 1): "x"}, "a & b": {(4, 2): "y"}}


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    datasource.register(spark)
    path = tmp_path_factory.mktemp("some books")
    write_book(path / "one.xlsx", ONE)
    (path / "sub").mkdir()
    write_book(path / "sub" / "two é.XLSX", {"first": {(1, 1): "z"}})
    (path / "broken.xlsx").write_bytes(b"no zip")
    (path / "other.txt").write_bytes(b"text")
    return path


def all_of(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def load(spark, path):
    return spark.read.format(datasource.FORMAT).load(str(path))


def test_rows_are_those_of_the_loader(spark, books):
    found = load(spark, books)
    assert all_of(found) == all_of(xlsx.load(spark, f"file://{books}").union(xlsx.load(spark, f"file://{books}/sub")))
    assert found.schema.simpleString() == xlsx.load(spark, f"file://{books}").schema.simpleString()
    assert found.rdd.getNumPartitions() == 5  # four sheets, and the workbook that is broken
    assert all_of(load(spark, books / "one.xlsx")) == all_of(found.where("workbook_id like '%one.xlsx'"))
    cells = {(r["sheet"], r["r"], r["c"]): (r["dtype"], r["sval"], r["nval"], r["dval"]) for r in xlsx.cells(found).where("workbook_id like '%one.xlsx'").collect()}
    assert cells["first", 2, 1] == ("int", "1063", 1063.0, None) and cells["first", 2, 2] == ("date", str(DAY), None, DAY) and cells["first", 1, 1] == ("str", "IO NO", None, None)


def test_sheets_that_cannot_match_are_not_parsed(spark, books, tmp_path):
    write_book(tmp_path / "half.xlsx", {"good": {(1, 1): 1}, "bad": {(1, 1): 2}})
    with zipfile.ZipFile(tmp_path / "half.xlsx") as old, zipfile.ZipFile(tmp_path / "new.xlsx", "w") as new:
        for name in old.namelist():
            new.writestr(name, b"<broken" if name.endswith("sheet2.xml") else old.read(name))
    (tmp_path / "half.xlsx").unlink()
    whole = load(spark, tmp_path)
    assert {r["kind"] for r in whole.collect()} == {"cell", "sheet", "error"}
    for good in ("sheet = 'good'", "sheet in ('good', 'other')", "sheet_ord = 0"):
        found = whole.where(good)
        assert found.rdd.getNumPartitions() == 1 and {r["kind"] for r in found.collect()} == {"cell", "sheet"}
    name = whole.where("kind = 'sheet'").first()["workbook_id"]
    assert all_of(load(spark, tmp_path).where(f"workbook_id = '{name}' and sheet = 'good' and r = 1")) == all_of(whole.where("sheet = 'good' and r = 1"))
    assert load(spark, books).where("workbook_id = 'nowhere'").count() == 0


def test_filters_are_pushed_but_those_that_cannot_be(spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = datasource.CellReader("/nowhere")
    kept = list(reader.pushFilters([EqualTo(("workbook_id",), "w"), In(("sheet",), ("a", "b")), EqualTo(("sheet",), "b"), GreaterThan(("r",), 3)]))
    assert reader.sheets.wanted == {"workbook_id": {"w"}, "sheet": {"b"}} and [f.attribute for f in kept] == [("sheet",), ("sheet",), ("r",)]
    assert reader.sheets.good(workbook_id="w", sheet="b") and not reader.sheets.good(sheet="a") and reader.sheets.good(kind="cell")


def test_a_stream_reads_each_workbook_once(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in").mkdir()
    arrive = lambda name: write_book(tmp_path / "in" / name, {"s": {(1, 1): name}})

    def run():
        stream = spark.readStream.format(datasource.FORMAT).load(str(tmp_path / "in"))
        query = stream.where("kind = 'cell'").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        assert query.awaitTermination(120)
        return sorted(r["sval"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive("a.xlsx")
    assert run() == ["a.xlsx"]
    arrive("b.xlsx")
    arrive("c.xlsx")
    assert run() == ["a.xlsx", "b.xlsx", "c.xlsx"]
    assert run() == ["a.xlsx", "b.xlsx", "c.xlsx"]
