"""Operators against sequential restatements and small fixtures."""

import ast
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridlens import matching
from gridlens.functions import address, scalars, vocab
from gridlens.operators import apply, bands, check, evaluate, kv, read, rows, survey
from gridlens.sources import xlsx
from gridlens.streaming import windows

CELLS = "workbook_id string, sheet string, r int, c int, dtype string, sval string, nval double, dval timestamp"


def grid(spark, sheets):
    """cells of {sheet: {(r, c): value}}."""
    data = []
    for sheet, held in sheets.items():
        for (r, c), v in held.items():
            kind = "str" if isinstance(v, str) and not v.startswith("@") else "date" if isinstance(v, str) else "int" if isinstance(v, int) else "float"
            import datetime

            day = datetime.datetime.fromisoformat(v[1:]) if kind == "date" else None
            data.append(("w", sheet, r, c, kind, str(day or v), float(v) if kind in ("int", "float") else None, day))
    return spark.createDataFrame(data, CELLS)


def regions(spark, found):
    return spark.createDataFrame([("w", s, *m) for s, m in found], "workbook_id string, sheet string, r1 int, c1 int, r2 int, c2 int")


def scan_roles(held, merges, id_col, qty_col, terms):
    """The ordered scan, row by row."""
    norm = lambda v: " ".join(str(v).lower().split()) if v is not None else ""
    top = {r: m[0] for m in merges if m[1] <= id_col <= m[3] for r in range(m[0], m[2] + 1)}
    out, first, anchor, group, seen = {}, None, None, -1, []
    for r in range(1, max(r for r, _ in held) + 1):
        if not any(k[0] == r for k in held):
            out[r] = ("blank", None, None)
            continue
        v, q = held.get((r, id_col)), held.get((r, qty_col))
        q = float(q) if isinstance(q, (int, float)) else None
        if first is None and norm(v) and norm(v) in terms:
            role = "header"
        elif isinstance(v, str) and norm(v) in terms:
            role = "repeat_header"
        elif v is not None and top.get(r, r) == r:
            role, first, anchor, group = "anchor", first or r, r, group + 1
        elif v is None and r in top and (top[r], id_col) in held and anchor:
            role = "child"
        elif v is None and q is not None and anchor and abs(sum(x for g, x in seen if g == group) - q) < 0.5:
            role = "total"
        elif v is None and q is not None and abs(sum(x for _, x in seen) - q) < 0.5:
            role = "grand_total"
        else:
            role = "blank"
        if role in ("anchor", "child") and q is not None:
            seen.append((group, q))
        out[r] = (role, group if role in ("anchor", "child") else None, anchor if role == "child" else None)
    return out


def test_row_roles_are_those_of_the_scan(spark):
    draw = random.Random(2)
    sheets, merges, want = {}, [], {}
    for k in range(60):
        held, own = {(1, 1): "IO NO", (1, 2): "COLOR", (1, 3): "ORDER QTY"}, []
        for r in range(2, draw.randint(4, 22)):
            kind = draw.random()
            if kind < 0.4:
                held[r, 1] = draw.choice([100 + r, f"A{r}"])
            elif kind < 0.46:
                held[r, 1] = "IO  no "
            if draw.random() < 0.8:
                held[r, 2] = "red"
            if draw.random() < 0.8:
                held[r, 3] = draw.choice([1, 2, 3, 5, 1.0, "x"])
            if draw.random() < 0.15 and not any(m[2] >= r for m in own):
                own.append((r, 1, r + draw.randint(1, 3), 1))
        for m in own:
            for r in range(m[0] + 1, m[2] + 1):
                held.pop((r, 1), None)
        sheets[f"s{k}"] = held
        merges += [(f"s{k}", m) for m in own]
        want[f"s{k}"] = scan_roles(held, own, 1, 3, {"io no"})
    got = {}
    for x in rows.row_roles(grid(spark, sheets), regions(spark, merges)).collect():
        got.setdefault(x["sheet"], {})[x["r"]] = (x["role"], x["group_id"], x["anchor_idx"])
    assert got == want


def test_modes(spark):
    cells = grid(spark, {
        "row": {(1, 1): "IO NO", (1, 2): "STYLE", (2, 1): 1, (2, 2): "a"},
        "sheet": {(4, 1): "Job No", (4, 2): 63315, (5, 1): "Quantity", (5, 2): 100},
        "section": {(1, 1): "IO NO", (4, 1): "IO NO", (4, 2): "Qty", (7, 1): "IO NO"},
        "title": {(1, 1): "JUST A TITLE, NO DATA"},
    })
    assert {r["sheet"]: r["mode"] for r in survey.modes(cells).collect()} == {"row": "row", "sheet": "sheet", "section": "section", "title": "row"}


def test_key_values_right_below_none(spark):
    cells = grid(spark, {"a": {(1, 1): "Job No", (1, 2): 7}, "b": {(1, 1): "Job No", (2, 1): 8, (2, 2): 1}, "c": {(1, 1): "Job No", (1, 2): "text", (2, 1): "under"}, "d": {(1, 1): "Job No", (1, 2): "text"}, "e": {(1, 1): "Job No"}})
    assert {r["sheet"]: r["value_cell"] for r in kv.key_values(cells).collect()} == {"a": "B1", "b": "A2", "c": "A2", "d": "B1"}


def test_tall_and_wide_bands(spark):
    day = "@2024-01-0"
    cells = grid(spark, {
        "tall": {(8, 1): "Band", (8, 3): "cut", (8, 4): "sew", (8, 5): "pack", **{(9, c): f"{day}{c}" for c in (3, 4, 5)}, (9, 2): "Plan", (10, 2): "Action", (11, 2): "Deviation"},
        "wide": {(2, 1): "Name", (2, 18): "wash", (3, 18): "Plan", (3, 19): "Actual", **{(r, c): f"{day}{c - 15}" for r in (4, 5) for c in (18, 19)}},
    })
    found = bands.bands(cells)
    subs = bands.sub_rows(cells, found)
    laid = {r["sheet"]: r for r in bands.layouts(found, subs).collect()}
    assert laid["tall"]["layout"] == "tall_sub_rows" and laid["tall"]["name_cell"] == "A8" and laid["wide"]["layout"] == "wide_sub_columns"
    assert {(r["role"], r["row"]) for r in subs.collect()} == {("plan", 9), ("action", 10), ("deviation", 11)}
    columns = bands.stage_columns(cells, regions(spark, []), bands.layouts(found, subs)).collect()
    assert {(r["stage"], r["sub_label"], r["sub_col"]) for r in columns if r["sheet"] == "wide"} == {("wash", "Actual", 19)}


def test_block_bounds(spark):
    anchors = spark.createDataFrame([("w", "s", 4), ("w", "s", 9), ("w", "t", 3)], "workbook_id string, sheet string, r int")
    gaps = spark.createDataFrame([("w", "s", 7, 8), ("w", "s", 12, 12)], "workbook_id string, sheet string, g_start int, g_end int")
    assert {(r["sheet"], r["start"], r["end"]) for r in kv.blocks(anchors, gaps).collect()} == {("s", 4, 6), ("s", 9, 11), ("t", 3, 3)}


def test_placement_in_blocks_is_an_interval_join_and_grows_with_its_rows(spark):
    draw = random.Random(3)
    blocks, points = [], []
    for k in range(20):
        at = 1
        for b in range(draw.randint(0, 6)):
            start = at + draw.randint(0, 3)
            at = start + draw.randint(0, 4)
            blocks.append(("w", f"s{k}", b, start, at))
            at += 1
        points += [("w", f"s{k}", draw.randint(1, 30), n) for n in range(15)]
    found = spark.createDataFrame(blocks, "workbook_id string, sheet string, block_id int, start int, end int")
    rows_ = spark.createDataFrame(points, "workbook_id string, sheet string, r int, n int")
    got = sorted((x["sheet"], x["r"], x["n"], x["block_id"]) for x in kv.placed(found, rows_, F.col("r")).collect())
    assert got == sorted((s, r, n, b) for _, s, r, n in points for _, t, b, lo, hi in blocks if s == t and lo <= r <= hi)
    many = spark.range(100_000).selectExpr("'w' as workbook_id", "'s' as sheet", "cast(id as int) as block_id", "cast(3 * id as int) as start", "cast(3 * id + 1 as int) as end")
    placed = kv.placed(many, many.selectExpr("workbook_id", "sheet", "start + block_id % 3 as r"), F.col("r"))
    assert placed.count() == 66_667 and "Join" not in placed._jdf.queryExecution().executedPlan().toString()


def test_items_promote_and_route(spark):
    cells = grid(spark, {"s": {(1, 1): "buyer_po_no", (1, 2): "ORDER QTY", (1, 3): "STYLE", (1, 4): "EX FAC DATE", (2, 1): 131673, (2, 2): "PO", (2, 3): 1078.0, (2, 4): "5-Jan-24", (3, 1): 1, (3, 2): "1,420", (3, 3): 1078.5, (3, 4): "soon"}})
    roles = spark.createDataFrame([("w", "s", 1, "header"), ("w", "s", 2, "anchor"), ("w", "s", 3, "anchor")], "workbook_id string, sheet string, r int, role string")
    first, second = apply.items_by_row(cells, regions(spark, []), roles, apply.name_map(spark)).orderBy("r").collect()
    assert (first["io_number"], first["style_code"], first["quantity"], str(first["delivery_date"]), first["metadata"]) == ("131673", "1078", None, "2024-01-05", {"quantity": "PO"})
    assert (second["style_code"], second["quantity"], second["delivery_date"], second["metadata"]) == ("1078.5", 1420, None, {"delivery_date": "soon"})


def test_flexible_dates(spark):
    texts = ["05-Jan-2024", "5-jan-75", "05 Feb 2024", "1/2/2024", "01/02/70", "1.2.2024", "1-2-2024", "2024-02-01", "no", "", None, "31/31/2024"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", scalars.flexible_date(F.col("t")).alias("d")).orderBy("k").collect()
    assert [str(r["d"]) for r in got] == ["2024-01-05", "1975-01-05", "2024-02-05", "2024-02-01", "1970-02-01", "2024-02-01", "2024-02-01", "2024-02-01", "None", "None", "None", "None"]


def test_addresses(spark):
    got = spark.range(1, 2000).select("id", address.address(F.col("id"), F.col("id")).alias("a")).select("id", "a", address.column_of(F.col("a")).alias("c"), address.row_of(F.col("a")).alias("r")).collect()
    assert all(r["id"] == r["c"] == r["r"] for r in got) and {r["id"]: r["a"] for r in got}[703] == "AAA703"


@pytest.mark.parametrize("block", [matching.BLOCK, 2])
def test_greedy_matching(spark, block):
    draw = random.Random(4)
    one = lambda f, k: (f, k, draw.choice([None, "", "1", "2"]), draw.choice(["a", "b"]), draw.choice(["x", "y", None]))
    labels = [one(f, k) for f in range(40) for k in range(draw.randint(1, 6))]
    items = [one(f, k) for f in range(38) for k in range(draw.randint(0, 6))]
    want = {}
    for f in range(40):
        own, used = [i for i in items if i[0] == f], set()
        for e in (x for x in labels if x[0] == f):
            for n in (3, 2, 1):
                hit = next((k for k, a in enumerate(own) if k not in used and all(e[2 + j] and a[2 + j] == e[2 + j] for j in range(n))), None)
                if hit is not None:
                    used.add(hit)
                    break
            want[f, e[1]] = own[hit][1] if hit is not None else None
    schema = "file int, ord int, io_number string, style_code string, color_code string"
    pairs = evaluate.matched(spark.createDataFrame(labels, schema), spark.createDataFrame(items, schema), "file", "ord", ["io_number", "style_code", "color_code"], block)
    assert {(r["file"], r["exp"]["ord"]): r["act"]["ord"] if r["act"] else None for r in pairs.collect()} == want


def test_matching_of_a_file_with_equal_keys_goes_by_blocks(spark):
    """Blocks of one large group take what one scan over the whole of it takes."""
    draw = random.Random(8)
    one = lambda k: (1, k, "io", draw.choice([None, "s", "t"]), draw.choice(["x", "y", None]))
    labels, items = [one(k) for k in range(900)], [one(k) for k in range(700)]
    want = dict(matching.scan([(e[1], *e[3:]) for e in labels], [(i[1], *i[3:]) for i in items]))
    assert len(want) == 700
    schema = "file int, ord int, io_number string, style_code string, color_code string"
    got = evaluate.matched(spark.createDataFrame(labels, schema), spark.createDataFrame(items, schema), "file", "ord", ["io_number", "style_code", "color_code"], 300)
    assert {r["exp"]["ord"]: r["act"]["ord"] for r in got.collect() if r["act"]} == want


def test_confidence(spark):
    fields = spark.createDataFrame([("w", 0.8), ("w", 0.6)], "book string, confidence double")
    none = spark.createDataFrame([], "book string, severity string")
    assert check.confidence(fields, check.warn_rate(none, "book"), "book").first()["confidence"] == 0.79


def workbook(path, cells, merges=(), date1904=False):
    """A small workbook: {A1: value} with shared strings, a date style and merges."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{r}">' + "".join(x for rr, x in cells if rr == r) + "</row>" for r in sorted({r for r, _ in cells}))
    merged = f"<mergeCells>{''.join(f'<mergeCell ref={chr(34)}{m}{chr(34)}/>' for m in merges)}</mergeCells>" if merges else ""
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>IO NO</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData>{merged}</worksheet>")


def test_xlsx(spark, tmp_path):
    cells = [(1, '<c r="A1" t="s"><v>0</v></c>'), (1, '<c r="B1" t="s"><v>1</v></c>'), (2, '<c r="A2"><v>1063</v></c>'), (2, '<c r="B2" s="1"><v>45292</v></c>'), (2, '<c r="C2" s="2"><v>45292.5</v></c>'), (2, '<c r="D2" s="3"><v>1.5</v></c>'), (3, '<c r="A3" t="b"><v>1</v></c>'), (3, '<c r="B3" t="inlineStr"><is><t>in</t></is></c>'), (3, '<c r="C3" t="e"><v>#REF!</v></c>'), (3, '<c r="D3" t="str"><f>A1</f><v>cached</v></c>'), (4, '<c r="A4" s="1"/>')]
    workbook(tmp_path / "a.xlsx", cells, ["A2:A3", "B1:C1"])
    workbook(tmp_path / "b.XLSX", [(1, '<c r="AA1" s="1"><v>1</v></c>')], date1904=True)
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_bytes(b"no")
    found = xlsx.load(spark, f"file://{tmp_path}").cache()
    got = {(r["workbook_id"].rsplit("/")[-1], r["r"], r["c"]): (r["dtype"], r["sval"]) for r in xlsx.cells(found).collect()}
    assert got == {
        ("a.xlsx", 1, 1): ("str", "IO NO"), ("a.xlsx", 1, 2): ("str", "two runs"), ("a.xlsx", 2, 1): ("int", "1063"), ("a.xlsx", 2, 2): ("date", "2024-01-01 00:00:00"), ("a.xlsx", 2, 3): ("date", "2024-01-01 12:00:00"),
        ("a.xlsx", 2, 4): ("float", "1.5"), ("a.xlsx", 3, 1): ("bool", "True"), ("a.xlsx", 3, 2): ("str", "in"), ("a.xlsx", 3, 3): ("error", "#REF!"), ("a.xlsx", 3, 4): ("str", "cached"), ("b.XLSX", 1, 27): ("date", "1904-01-02 00:00:00"),
    }
    assert {(r["r1"], r["c1"], r["r2"], r["c2"]) for r in xlsx.merges(found).collect()} == {(2, 1, 3, 1), (1, 2, 1, 3)}
    assert [r["sval"][:10] for r in found.where("kind = 'error'").collect()] == ["BadZipFile"]


def test_windows_on_a_stream_are_those_of_the_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for make in (lambda e: windows.tumbling(e, "60 seconds", ["event_type"]), lambda e: windows.sessions(e, "30 minutes", ["user_id"]), lambda e: windows.sliding_durations(e, "1 hour", "20 minutes", "event_type")):
        name = f"t{abs(hash(make))}"
        run = make(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, make(events).collect()))


def test_each_file_is_taken_once(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [(1, '<c r="A1"><v>1</v></c>')])
    seen = []
    stream = lambda: spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.xlsx").load(str(tmp_path)).select("path", "modificationTime")
    for _ in range(2):
        windows.each_batch(windows.first_of_each(stream()), lambda batch, _: seen.extend(r["path"] for r in batch.collect()), f"{tmp_path}/check").awaitTermination(120)
    assert len(seen) == 1


def test_operators_hold_no_python_functions():
    for file in (Path(__file__).parent.parent / "gridlens").glob("operators/*.py"):
        names = {n.attr for n in ast.walk(ast.parse(file.read_text())) if isinstance(n, ast.Attribute)}
        assert not names & {"udf", "pandas_udf", "mapInPandas", "applyInPandas", "rdd", "collect", "toPandas"}, file


def test_nothing_else_imports_the_training_data_subpackage():
    for file in (Path(__file__).parent.parent / "gridlens").rglob("*.py"):
        if "llm" not in file.parts:
            assert "gridlens.llm" not in file.read_text(), file


@pytest.mark.parametrize("name", ["IDENTITY", "KEY_LABELS"])
def test_vocabularies_are_normalised(name):
    assert all(t == " ".join(t.lower().split()) for t in getattr(vocab, name))


def test_reads_on_an_empty_grid(spark):
    empty = grid(spark, {"s": {(1, 1): "x"}}).where("false")
    assert read.sheets(empty).count() == 0 and survey.modes(empty).count() == 0


def test_title_row_over_the_real_header(spark):
    held = {(1, 1): "IO NO list", **{(2, c): f"label {c}" for c in range(1, 6)}, **{(r, c): r * c for r in (3, 4) for c in range(1, 6)}}
    roles = spark.createDataFrame([("w", "s", 1, "header", None, None), ("w", "s", 2, "anchor", None, 0), ("w", "s", 3, "anchor", None, 1), ("w", "s", 4, "child", 2, 1)], "workbook_id string, sheet string, r int, role string, anchor_idx int, group_id int")
    cells = grid(spark, {"s": held})
    extra = apply.title_rows(cells, roles)
    assert [(r["extra_row"], r["labels"], r["populated"]) for r in extra.collect()] == [(2, 1, 5)]
    assert [r["role"] for r in apply.with_title_rows(roles, extra).orderBy("r").collect()] == ["header", "header", "anchor", "header"]


def test_labels_and_stored_outputs(spark, tmp_path):
    import json

    from gridlens.sources import labels

    (tmp_path / "in").mkdir()
    one = {"total_plis": 2, "plis": [{"io_number": "1", "style_code": "", "quantity": 5, "delivery_date": "2024-01-05", "confidence": {"quantity": 0.5, "io_number": None}, "new": 1, "stages": [{"name": "cut", "planned_date": "2024-01-01"}]}, {"io_number": "2"}], "warnings": []}
    (tmp_path / "in" / "a file.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "in" / "b.json").write_text('{"plis": []}')
    files = labels.load(spark, f"file://{tmp_path}/in")
    got = labels.items(files).orderBy("ord").collect()
    assert [(r["stem"], r["io_number"], r["style_code"], r["quantity"], str(r["delivery_date"])) for r in got] == [("a file", "1", None, 5, "2024-01-05"), ("a file", "2", None, None, "None")]
    assert got[0]["confidence"] == {"quantity": 0.5} and got[0]["stages"][0]["name"] == "cut"
    labels.save(files, f"file://{tmp_path}/out")
    again = labels.items(labels.stored(spark, f"file://{tmp_path}/out")).orderBy("ord").collect()
    assert [r.asDict(True) for r in again] == [r.asDict(True) for r in got]


def test_metadata_keeps_its_types_in_stored_outputs(spark, tmp_path):
    from gridlens.sources import labels

    texts = {"count": "7", "code": "7", "share": "7.0", "big": "1e+16", "done": "True", "day": "2024-03-01 00:00:00", "odd": "not 7", "none": None}
    kinds = {"count": "int", "code": "str", "share": "float", "big": "float", "done": "bool", "day": "date", "odd": "int"}
    held = spark.createDataFrame([(texts, kinds)], "metadata map<string,string>, metadata_kinds map<string,string>")
    empty = F.from_json(F.lit("{}"), labels.ITEM.replace("map<string,variant>", "map<string,string>"))
    item = held.select(F.array(empty.withField("metadata", scalars.typed_values(F.col("metadata"), F.col("metadata_kinds")))).alias("plis"), F.lit("a").alias("stem"))
    labels.save(item, f"file://{tmp_path}/out")
    text = next((tmp_path / "out" / "stem=a").glob("*.json")).read_text()
    assert '"count":7,' in text and '"code":"7"' in text and '"share":7.0' in text and '"done":true' in text
    got = labels.items(labels.stored(spark, f"file://{tmp_path}/out")).first()
    shown = {k: v for k, v in texts.items() if v is not None} | {"big": "1.0E16"}
    assert got["metadata"] == shown and got["metadata_kinds"] == {**kinds, "odd": "str"}


def test_tools_by_name():
    from gridlens.operators.registry import TOOLS

    assert len(TOOLS.names()) == 11 and TOOLS.get("peek_sheet") is read.peek
    with pytest.raises(ValueError):
        TOOLS.add("peek_sheet", read.peek)
    with pytest.raises(KeyError):
        TOOLS.get("none")
