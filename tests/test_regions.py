"""Lookup through merged regions against brute force, and its cost on regions of any size."""

import random

from pyspark.sql import functions as F

from gridlens.operators import apply, read
from test_operators import grid, regions


def names(r, c):
    return chr(64 + c) + str(r)


def seen(spark, cells, merges, places):
    asked = spark.createDataFrame([("w", s, r, c) for s, r, c in places], "workbook_id string, sheet string, r int, c int")
    return {(x["sheet"], x["r"], x["c"]): (x["sval"], x["addr"]) for x in read.look(cells, merges, asked).collect()}


def brute(sheets, merges, places):
    out = {}
    for s, r, c in places:
        own = sheets[s].get((r, c))
        if own is not None:
            out[s, r, c] = str(own), names(r, c)
            continue
        over = [m for t, m in merges if t == s and m[0] <= r <= m[2] and m[1] <= c <= m[3] and sheets[s].get((m[0], m[1])) is not None]
        if over:
            out[s, r, c] = str(sheets[s][over[0][0], over[0][1]]), names(*over[0][:2])
    return out


def test_lookup_is_brute_force_s(spark):
    draw = random.Random(5)
    sheets, merges = {}, []
    for k in range(25):
        name, held, taken = f"s{k}", {}, set()
        for _ in range(draw.randint(0, 6)):
            r1, c1 = draw.randint(1, 12), draw.randint(1, 6)
            r2, c2 = r1 + draw.randint(0, 5), c1 + draw.randint(0, 3)
            area = {(r, c) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)}
            if not area & taken:
                taken |= area
                merges.append((name, (r1, c1, r2, c2)))
                if draw.random() < 0.8:
                    held[r1, c1] = draw.choice([7, "text"])
        for _ in range(12):
            spot = draw.randint(1, 18), draw.randint(1, 9)
            if spot not in taken:
                held[spot] = draw.randint(1, 99)
        held.setdefault((20, 1), 1)
        sheets[name] = held
    places = sorted({(f"s{draw.randrange(25)}", draw.randint(1, 20), draw.randint(1, 10)) for _ in range(1200)})
    assert seen(spark, grid(spark, sheets), regions(spark, merges), places) == brute(sheets, merges, places)


def test_whole_columns_and_whole_sheets(spark):
    sheets = {"column": {(1, 2): "B", (4, 2): "own"}, "sheet": {(1, 1): "all"}, "both": {(1, 1): "A", (1, 3): "C"}}
    merges = [("column", (1, 2, 1_048_576, 2)), ("sheet", (1, 1, 1_048_576, 16_384)), ("both", (1, 1, 1_048_576, 2)), ("both", (1, 3, 1_048_576, 16_384))]
    cells, found = grid(spark, sheets), regions(spark, merges)
    places = [(s, r, c) for s in sheets for r in (1, 4, 5, 1_000_000) for c in (1, 2, 3, 5)]
    assert seen(spark, cells, found, places) == brute(sheets, merges, places)
    columns = spark.createDataFrame([("w", s, c) for s in sheets for c in (1, 3, 5)], "workbook_id string, sheet string, c int")
    # A row for each asked column that a region spans, however many rows and columns it has.
    assert read.region_starts(cells, found, columns).count() == 3 + 3


def test_of_regions_that_overlap_the_last_start_counts(spark):
    sheets = {"s": {(1, 1): "first", (3, 1): "second"}}
    got = seen(spark, grid(spark, sheets), regions(spark, [("s", (1, 1, 9, 1)), ("s", (3, 1, 5, 1))]), [("s", r, 1) for r in (2, 4, 5, 8)])
    assert got == {("s", 2, 1): ("first", "A1"), ("s", 4, 1): ("second", "A3"), ("s", 5, 1): ("second", "A3")}


def test_places_carry_what_they_ask_with(spark):
    cells = grid(spark, {"s": {(1, 1): "x"}})
    asked = spark.createDataFrame([("w", "s", 1, 1, "a", {"k": 1}), ("w", "s", 1, 1, "b", {}), ("w", "t", 1, 1, "c", {})], "workbook_id string, sheet string, r int, c int, what string, held map<string,int>")
    got = read.look(cells, regions(spark, []), asked)
    assert sorted((x["what"], x["sval"]) for x in got.collect()) == [("a", "x"), ("b", "x")]
    assert got.columns == [*asked.columns, *read.VALUE, "addr"]


def test_items_under_regions_over_columns_and_rows(spark):
    """A value merged over two columns and all rows below it fills both fields of every item."""
    sheets = {"s": {(1, 1): "IO NO", (1, 2): "STYLE", (1, 3): "COLOR", (2, 1): 1063, (2, 2): "DW", (3, 1): 1064, (5, 1): 1065}}
    cells, merges = grid(spark, sheets), regions(spark, [("s", (2, 2, 1_048_576, 3))])
    labels = spark.createDataFrame([("w", "s", 2, "style_code"), ("w", "s", 3, "color_code")], "workbook_id string, sheet string, c int, canonical string")
    data = cells.where("c = 1 and r > 1").select("workbook_id", "sheet", "r")
    got = apply.row_values(cells, merges, data, labels).select("r", "canonical", "sval", "addr", F.col("ord.c").alias("k")).collect()
    assert sorted(map(tuple, got)) == [(r, name, "DW", "B2", c) for r in (2, 3, 5) for name, c in (("color_code", 3), ("style_code", 2))]
