"""Roles over a feed: those of the finished sheet, in whatever order rows come, also after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from gridlens.operators import rows
from gridlens.streaming import roles
from test_operators import grid, regions


def sheets(seed, count=12):
    draw = random.Random(seed)
    out, merges = {}, []
    for k in range(count):
        held, own = {(1, 1): "IO NO", (1, 2): "COLOR", (1, 3): "ORDER QTY"}, []
        for r in range(2, draw.randint(5, 25)):
            if draw.random() < 0.45:
                held[r, 1] = draw.choice([100 + r, f"A{r}", "IO no"])
            if draw.random() < 0.8:
                held[r, 3] = draw.choice([1, 2, 3, 5, 1.5, "x"])
            if draw.random() < 0.15 and not any(m[2] >= r for m in own):
                own.append((r, 1, r + draw.randint(1, 3), 1))
        for m in own:
            for r in range(m[0] + 1, m[2] + 1):
                held.pop((r, 1), None)
        out[f"s{k}"] = held
        merges += [(f"s{k}", m) for m in own]
    return out, merges


def run(spark, stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(300)


@pytest.fixture(scope="module")
def finished(spark):
    held, merges = sheets(11)
    facts = rows.row_facts(grid(spark, held), regions(spark, merges)).withColumn("at", F.lit("2024-05-01 10:00:00").cast("timestamp")).cache()
    want = {(r["sheet"], r["r"]): (r["role"], r["group_id"], r["anchor_idx"]) for r in rows.row_roles(grid(spark, held), regions(spark, merges)).collect()}
    assert {v[0] for v in want.values()} >= {"header", "repeat_header", "anchor", "child", "total", "blank"}
    return facts, want


def read(spark, out):
    got = {}
    for r in spark.read.parquet(out).collect():
        assert (r["sheet"], r["r"]) not in got
        got[r["sheet"], r["r"]] = (r["role"], r["group_id"], r["anchor_idx"])
    return got


def test_roles_of_a_feed_are_those_of_the_sheets_also_after_a_restart(spark, finished, tmp_path):
    facts, want = finished
    feed, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    dealt = facts.withColumn("part", F.pmod(F.xxhash64("sheet", "r"), F.lit(4))).cache()
    take = lambda: spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    for part in (2, 0):
        dealt.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(feed)
    run(spark, roles.roles_of_feed(take()), out, state)
    early = read(spark, out)
    assert early and len(early) < len(want) and all(want[k] == v for k, v in early.items())
    # The rest, and rows that were there before, come to a query that is started anew.
    for part in (3, 2, 1):
        dealt.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(feed)
    run(spark, roles.roles_of_feed(take()), out, state)
    assert read(spark, out) == want


def test_an_idle_sheet_is_over(spark, finished, tmp_path):
    facts, want = finished
    feed, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    take = lambda: spark.readStream.schema(facts.schema).parquet(feed)
    blank = {k for k, v in want.items() if v[0] == "blank" and k[1] > 1}
    facts.where(~F.concat_ws(":", "sheet", "r").isin([f"{s}:{r}" for s, r in blank])).coalesce(1).write.parquet(feed)
    run(spark, roles.roles_of_feed(take(), 60), out, state)
    waiting = read(spark, out)
    assert waiting and len(waiting) < len(want) - len(blank)
    # Another sheet moves the watermark on.
    facts.limit(1).withColumns({"sheet": F.lit("other"), "r": F.lit(2), "at": F.lit("2024-05-01 10:03:00").cast("timestamp")}).write.mode("append").parquet(feed)
    run(spark, roles.roles_of_feed(take(), 60), out, state)
    # Rows that wait for those that never come get their roles in the end.
    assert read(spark, out) == {k: v for k, v in want.items() if k not in blank}


def test_steps_of_the_scan():
    scan, found = roles._BEGIN, []
    ident = lambda qty, top=None: (True, False, qty, top, top is not None, True, True)
    other = lambda qty, top=None: (False, False, qty, top, top is not None, True, True)
    for r, facts in enumerate([(True, True, None, None, False, True, True), ident(2.0, 2), other(3.0, 2), other(5.0), ident(1.0), other(6.0), (False, False, None, None, False, True, False)], 1):
        scan, role = roles.step(scan, r, facts)
        found.append(role)
    assert found == [("header", None, None), ("anchor", 0, None), ("child", 0, 2), ("total", None, None), ("anchor", 1, None), ("grand_total", None, None), ("blank", None, None)]
