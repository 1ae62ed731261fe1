"""The whole flow over small workbooks of every layout, and its parts: plans, findings, names, items, stages, scores."""

import datetime
import json
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from gridlens import evaluation
from gridlens.functions import vocab
from gridlens.operators import apply, check, evaluate, extract, findings, naming
from gridlens.operators import plan as planning
from gridlens.sources import labels, xlsx
from gridlens.streaming import windows

CELLS = "workbook_id string, sheet string, r int, c int, dtype string, sval string, nval double, dval timestamp"
MERGES = "workbook_id string, sheet string, r1 int, c1 int, r2 int, c2 int"
DAY = datetime.datetime(2024, 3, 1)


def place(address):
    letters = address.rstrip("0123456789")
    column = 0
    for x in letters:
        column = column * 26 + ord(x) - 64
    return int(address[len(letters) :]), column


def table(rows, first="A1"):
    """{(r, c): value} of rows of values, None for empty cells."""
    r0, c0 = place(first)
    return {(r0 + i, c0 + j): v for i, row in enumerate(rows) for j, v in enumerate(row) if v is not None}


def at(**cells):
    return {place(a): v for a, v in cells.items()}


NUMBERED = at(A1="S NO", B1="IO NO", K1="COLOR", L1="ORDER QTY", A2=1, B2="1063", K2="MAGENTA", L2=1000)
BOOKS = {
    "simple": {"S": table([["IO NO", "STYLE", "ORDER QTY"], ["1063", "DWJE", 2000], ["1064", "DWJF", 1500], ["1065", "DWJG", 3000]])},
    "totals": {"S": NUMBERED | at(K3="NAVY", L3=1000, L4=2000, A5=2, B5="1064", K5="PINE", L5=1500, L6=1500)},
    "merges": {"S": NUMBERED | at(K3="NAVY", L3=1000, K4="WHITE", L4=1000, A5=2, B5="1064", K5="PINE", L5=1500, K6="GRAY", L6=1500)},
    "repeat": {"S": table([["IO NO", "COLOR"], ["1063", "RED"], ["1064", "BLUE"], ["IO NO", "COLOR"], ["1065", "GREEN"]])},
    "keys": {s: at(A4="Job No", B4=int(s), A5="Quantity", B5=100000, A8="Pre-Prod TNA", C8="L/D send", D8="Fit send", C9=DAY, D9=DAY + datetime.timedelta(5)) for s in ("63315", "63306", "63305")},
    "strip": {"S": at(A3="S NO", B3="IO NO", D3="EX FAC DATE", F3="STYLE", K3="COLOR", L3="ORDER QTY", N3="FABRIC", U3="CUTTING", V3="Actual", AE3="SEWING") | {k: v for r in (4, 5) for k, v in at(**{f"A{r}": r - 3, f"B{r}": f"10{r}", f"D{r}": DAY, f"F{r}": "DWJE_1", f"K{r}": "RED", f"L{r}": 10 * r, f"N{r}": "100% COTTON", f"U{r}": DAY, f"V{r}": DAY, f"AE{r}": DAY}).items()}},
    "strip2": {"S": at(B1="Buyer Po No", C1="Color", D1="Order Qty", E1="Etd Ex factory as per P.O", H1="CUTTING", J1="SEWING", H2="Plan", I2="Actual", J2="Plan", K2="Actual", B3="131673", C3="RED", D3="1,420", E3=DAY, H3=DAY, I3=DAY + datetime.timedelta(2), J3=DAY + datetime.timedelta(7), K3="open")},
    "title": {"S": at(A1="JUST A TITLE, NO DATA")},
    "corrupt": {"S": table([["NAME", "DESCRIPTION", "NOTES"]] + [[f"n{k}", f"d{k}", f"x{k}"] for k in range(10)])},
    "thin": {"S": at(A1="IO NO", B1="STYLE", A2="1", B2="a1_9", A3="2", B3="a2_9", C5="Pre-Prod", D5="Cut", E5="Sew", D6=DAY, E6=DAY, B7="Plan", B8="Action", B9="Actual", D7="x", E7="y", D8="z", E8="w", D9="v", E9="u")},
    "noise": {"log": at(A1="IO NO", A2=1)},
    "copies": {"first": at(A1="IO NO", A2="7"), "second": at(A1="IO NO", A2="7"), "Summary": at(A1="IO NO", A2="8")},
}
REGIONS = {"totals": ["A2:A3", "B2:B3"], "merges": ["A2:A4", "B2:B4", "A5:A6", "B5:B6"], "strip2": ["H1:I1", "J1:K1"]}


def cells_of(spark, books):
    rows = []
    for book, sheets in books.items():
        for sheet, held in sheets.items():
            for (r, c), v in held.items():
                kind = "date" if isinstance(v, datetime.datetime) else {str: "str", int: "int", float: "float"}[type(v)]
                rows.append((book, sheet, r, c, kind, str(v), float(v) if kind in ("int", "float") else None, v if kind == "date" else None))
    return spark.createDataFrame(rows, CELLS)


def merges_of(spark, regions):
    rows = [(book, sheet, *place(m.split(":")[0]), *place(m.split(":")[1])) for book, found in regions.items() for sheet in ("S",) for m in found]
    return spark.createDataFrame(rows, MERGES)


@pytest.fixture(scope="module")
def grid(spark):
    return cells_of(spark, BOOKS).cache(), merges_of(spark, REGIONS).cache()


@pytest.fixture(scope="module")
def results(grid):
    order = grid[0].groupBy("workbook_id", "sheet").agg(F.max("r").alias("max_row"), F.max("c").alias("max_col")).withColumn("sheet_ord", F.when(F.col("sheet") == "63315", 0).when(F.col("sheet") == "63306", 1).otherwise(2))
    return extract.extract(*grid, order)


def test_modes_identity_and_channels(results):
    got = {(r["workbook_id"], r["sheet"]): r for r in planning.summary(results.plan).collect()}
    assert {k: r["mode"] for k, r in got.items()} == {(b, s): "sheet" if b == "keys" else "row" for b, sheets in BOOKS.items() for s in sheets if b not in ("noise", "title") and s not in ("Summary", "second")}
    one = lambda b, what, s="S": got[b, s][what]
    assert [one(b, "id_col") for b in ("simple", "totals", "merges", "repeat", "strip")] == [1, 2, 2, 1, 2]
    assert [one(b, "n_rows") for b in ("simple", "totals", "merges", "repeat", "strip")] == [3, 3, 5, 3, 2]
    assert [one(b, "n_bands") for b in ("strip", "strip2", "thin")] == [1, 1, 1]
    assert one("simple", "n_labels") >= 3 and one("strip", "n_labels") >= 5 and one("strip2", "n_labels") >= 3
    assert (one("keys", "n_keys", "63315"), one("keys", "n_bands", "63315"), one("keys", "n_rows", "63315"), one("keys", "confidence", "63315"), one("simple", "confidence")) == (2, 1, 0, 0.85, 0.9)


def test_rows_of_plans(results):
    roles = {}
    for r in results.plan.rows.orderBy("r").collect():
        roles.setdefault(r["workbook_id"], []).append(r["role"])
    assert roles["totals"] == ["header", "anchor", "child", "total", "anchor", "total"]
    assert roles["merges"] == ["header", "anchor", "child", "child", "anchor", "child"]
    assert roles["repeat"] == ["header", "anchor", "anchor", "repeat_header", "anchor"]
    assert roles["thin"] == ["header", "anchor", "anchor"] + ["blank"] * 6


def test_items_of_every_mode(results):
    got = {}
    for r in results.items.orderBy("number").collect():
        got.setdefault(r["workbook_id"], []).append(r)
    ids = {b: [r["io_number"] for r in rows] for b, rows in got.items()}
    assert ids["simple"] == ["1063", "1064", "1065"] and ids["totals"] == ["1063", "1063", "1064"] and ids["merges"] == ["1063"] * 3 + ["1064"] * 2
    assert ids["repeat"] == ["1063", "1064", "1065"] and ids["keys"] == ["63315", "63306", "63305"] and ids["strip2"] == ["131673"] and ids["copies"] == ["7"]
    assert "title" not in got and "noise" not in got
    assert [r["color_code"] for r in got["merges"]] == ["MAGENTA", "NAVY", "WHITE", "PINE", "GRAY"] and got["merges"][1]["cells"]["io_number"] == "B2"
    assert [(r["quantity"], r["rows"]) for r in got["keys"]] == [(100000, [])] * 3
    first = got["strip2"][0]
    assert (first["quantity"], first["delivery_date"], first["rows"]) == (1420, DAY.date(), [3])
    assert got["strip"][0]["fabric_code"] == "100% COTTON" and got["strip"][0]["style_code"] == "DWJE_1"


def test_stages_wide_and_tall(results):
    stages = {(r["workbook_id"], r["item"]): r["stages"] for r in results.items.where("sheet in ('S', '63315')").collect()}
    cut, sew = stages["strip2", 3]
    assert (cut["name"], cut["planned_date"], cut["metadata"], cut["section"]) == ("cutting", DAY.date(), {"actual_date": "2024-03-03"}, "Buyer Po No")
    assert (sew["name"], sew["metadata"], sew["cells"]) == ("sewing", {"actual_date": "open"}, {"planned_date": "J3", "actual_date": "K3"})
    assert [s["name"] for s in stages["keys", 0]] == ["lab_dip_send", "fit_send"] and stages["keys", 0][1]["planned_date"] == datetime.date(2024, 3, 6)
    tall = stages["thin", 2]
    assert [(s["name"], s["planned_date"], s["metadata"], s["rows"]) for s in tall] == [("cutting", None, {"action": "z", "actual": "v"}, [7, 8, 9]), ("sewing", None, {"action": "w", "actual": "u"}, [7, 8, 9])]
    assert len(stages["strip", 4]) >= 2


def test_warnings_and_results(results):
    found = results.warnings.collect()
    books = {r["workbook_id"]: r for r in results.books.collect()}
    assert {(r["workbook_id"], r["message"]) for r in found if r["check"] is None} == {("title", "No relevant sheets identified"), ("noise", "No relevant sheets identified")}
    assert {r["severity"] for r in found} == {"warning"}
    assert ("simple", "field_dropout", "color_code") in {(r["workbook_id"], r["check"], r["field"]) for r in found}
    assert books["simple"]["format"] == "row_per_pli" and books["keys"]["format"] == "sheet_is_pli" and books["simple"]["confidence"] == round(0.7 * 0.85, 4)
    assert (books["title"]["format"], books["title"]["n_items"], books["title"]["confidence"]) == (None, 0, None)
    whole = {r["workbook_id"]: r for r in extract.envelopes(results).collect()}
    assert [p["io_number"] for p in whole["merges"]["plis"]] == ["1063"] * 3 + ["1064"] * 2 and whole["title"]["plis"] == []
    dropped = [m.split("'")[1] for m in whole["simple"]["warnings"] if "populated in" in m]
    assert len(dropped) >= 2 and dropped == [f for f in vocab.TRACKED if f in dropped]


def test_warnings_stand_in_order(spark):
    """Sheets in their order, then check by check; after them items, check by check through all sheets."""
    schema = "workbook_id string, sheet string, check string, severity string, message string, item int, field string, at long, part int"
    one = lambda sheet, message, at, part, field=None: ("w", sheet, None, "warn", message, None, field, at, part)
    plans = spark.createDataFrame([one("a", "5", 9, 0), one("b", "2", 7, 1), one("a", "6", 1, 100), one("b", "1", 30, 0), one("a", "4", 8, 0), one("b", "3", None, 100)], schema)
    tests = spark.createDataFrame([one("b", "8", 1, 200, "x"), one("a", "9", 12, 200, "x"), one("a", "7", 1, 200, "c"), one("a", "10", 0, 201)], schema)
    sheets = spark.createDataFrame([("w", "b", 0), ("w", "a", 1)], "workbook_id string, sheet string, sheet_ord int")
    told = findings.as_warnings(plans, sheets).unionByName(findings.as_warnings(tests))
    assert [r["message"] for r in told.orderBy("place").collect()] == [str(k) for k in range(1, 11)]


def test_findings_of_plans(spark, grid, results):
    got = {(r["workbook_id"], r["check"], r["severity"]) for r in extract.plan_findings(results.plan, grid[0]).collect()}
    assert ("corrupt", "pli_count_sanity", "warn") not in got  # DESCRIPTION holds io: its column has anchors
    assert ("thin", "date_band_density", "warn") in got and not any(s == "error" for *_, s in got)
    review = {r["workbook_id"]: r["review"] for r in extract.needs_review(results.plan, extract.plan_findings(results.plan, grid[0])).collect()}
    assert review["thin"] and review["keys"] and not review["simple"]


def explicit(spark, rows=(), blocks=(), keys=(), members=(), labels_=(), bands=(), columns=(), mode="row"):
    make = lambda data, schema: spark.createDataFrame([("w", "S", *x) for x in data], "workbook_id string, sheet string, " + schema)
    keyed = "label string, label_row int, label_cell string, value_row int, value_col int, value_cell string"
    return planning.Plan(
        make([(mode, 1, 30, 10, 0.9)], "mode string, id_col int, max_row int, max_col int, confidence double"),
        make(rows, "r int, role string, anchor_idx int, group_id int, sub_row_role string"), make(labels_, "c int, row int, raw string"), make(keys, keyed),
        make(bands, "r int, sub_header int, title string, name_cell string, layout string, plan_row int, sub_rows map<string,int>, block_id int"),
        make(columns, "r int, stage string, primary_col int, first_col int, sub_label string, sub_col int"), make(blocks, "block_id int, start int, end int"), make(members, "block_id int, " + keyed),
    )


def test_each_invariant_and_statistic(spark):
    rows = [(1, "header", None, None, None), (2, "anchor", 7, 0, None), (3, "child", 99, 0, "plan"), (4, "child", None, 0, None), (4, "child", None, 0, None), (6, "header", None, None, None)]
    plan = explicit(spark, rows, [(0, 2, 5), (1, 5, 9)], [("Qty", 1, "A1", 1, 2, "B1")], (), [(1, 1, "IO NO")], mode="section")
    got = {(r["check"], r["severity"], r["message"]) for r in findings.plan_invariants(plan).collect()}
    assert got == {
        ("reference_integrity", "error", "ANCHOR row 2 has non-null anchor_idx=7"), ("reference_integrity", "error", "CHILD row 3 anchor_idx=99 not in ANCHOR rows"), ("reference_integrity", "error", "CHILD row 4 has no anchor_idx"),
        ("row_uniqueness", "error", "row idx 4 appears more than once"), ("header_contiguity", "warn", "header rows are not contiguous"), ("header_contiguity", "warn", "data row 2 precedes max header row 6"),
        ("pli_block_non_overlap", "error", "blocks 0 (2, 5) and 1 (5, 9) overlap"), ("sub_row_consistency", "warn", "group 0 mixes sub_row_role set + unset"),
        ("exactly_one_identity_channel", "error", "multiple identity channels populated: header_labels, kv_anchors, pli_blocks"),
    }
    wrong = findings.plan_invariants(explicit(spark, keys=[("Qty", 1, "A1", 1, 2, "B1")])).collect()
    assert [(r["check"], r["message"]) for r in wrong] == [("mode_channel_consistency", "pli_mode=row_per_pli but its expected channel is empty")]
    cells = cells_of(spark, {"w": {"S": at(B1="S.No", A1="IO NO", A2="x", B2=1, B3=2, B4=9)}})
    rows = [(1, "header", None, None, None), *[(r, "anchor", None, r, None) for r in (2, 3, 4)]]
    got = {(r["check"], r["message"]) for r in findings.plan_statistics(explicit(spark, rows), cells).collect()}
    assert got == {("sequence_match", "S.NO max=9 vs ANCHOR count=3"), ("identity_column_coverage", "identity coverage 0.33 < 0.80")}
    got = {(r["check"], r["message"]) for r in findings.plan_statistics(explicit(spark), cells).collect()}
    assert got == {("pli_count_sanity", "sheet has 30 rows but plan emits 0 PLIs")}


def test_sections_and_rows_of_many_lines(spark):
    cells = cells_of(spark, {"w": {"S": at(A4="IO", B4="1063", C8="Cut", C9=DAY, A14="IO", B14="1064", C18="Cut", C19=DAY)}})
    none, names = merges_of(spark, {}), spark.createDataFrame([("field", "IO", "io_number", 0.7), ("stage", "Cut", "cutting", None)], "kind string, raw string, canonical string, confidence double")
    keyed = lambda b, r: (b, "IO", r, f"A{r}", r, 2, f"B{r}")
    band = lambda b, r: (r, r - 1, "band", f"A{r - 1}", "wide_sub_columns", r, {"plan": r}, b)
    plan = explicit(spark, blocks=[(0, 4, 9), (1, 14, 19), (2, 25, 26)], members=[keyed(0, 4), keyed(1, 14)], bands=[band(0, 9), band(1, 19)], columns=[(9, "Cut", 3, 3, None, None), (19, "Cut", 3, 3, None, None)], mode="section")
    got = apply.apply_plan(cells, none, plan, names).orderBy("item").collect()
    assert [(r["io_number"], r["rows"][:2], [s["name"] for s in r["stages"]], r["confidence"]) for r in got] == [("1063", [4, 5], ["cutting"], {"io_number": 0.7}), ("1064", [14, 15], ["cutting"], {"io_number": 0.7}), (None, [25, 26], [], {})]
    cells = cells_of(spark, {"w": {"S": at(A1="IO", A2="7", B2=1, A3="x", B3=2, A4="y", C9="k")}})
    rows = [(1, "header", None, None, None), (2, "anchor", None, 0, "plan"), (3, "child", 2, 0, "actual"), (4, "anchor", None, 1, None)]
    plan = explicit(spark, rows, keys=[("IO", 9, "B9", 9, 3, "C9")], labels_=[(1, 1, "IO"), (2, 1, "ignore")])
    got = apply.apply_plan(cells, none, plan, names.where("kind = 'stage'")).orderBy("item").collect()
    assert [(r["item"], r["metadata"].get("multi_row_sub_rows"), r["metadata"]["IO"]) for r in got] == [(2, '[{"row":3,"sub_row_role":"actual"}]', "k"), (4, None, "k")]


def test_corrections_and_hints(spark, grid, results):
    plan = results.plan
    fixes = spark.createDataFrame([("thin", "S", 3, "total", None, 0), ("simple", "S", 3, "total", None, 0)], "workbook_id string, sheet string, r int, role string, anchor_idx int, ord int")
    rows = {(r["workbook_id"], r["r"]): r["role"] for r in extract.reviewed(plan, extract.plan_findings(plan, grid[0]), fixes).rows.collect()}
    assert rows["thin", 3] == "total" and rows["simple", 3] == "anchor"  # only a sheet that needs a review is corrected
    wrong = spark.createDataFrame([("simple", "S", "error")], "workbook_id string, sheet string, severity string")
    hints = spark.createDataFrame([("simple", "S", 9), ("repeat", "S", 9)], "workbook_id string, sheet string, hint_col int")
    columns = {r["workbook_id"]: r["id_col"] for r in extract.hinted(plan, wrong, hints).sheets.where("sheet = 'S'").collect()}
    assert (columns["simple"], columns["repeat"]) == (9, 1)
    assert {r["workbook_id"]: r["hint_col"] for r in naming.identity_hint(grid[0]).collect()}["totals"] == 2


def test_names_by_rule(spark):
    labels_ = [("a", "Buyer PO No.", ["131673"]), ("a", "STYLE", ["D-T-SHIRT 3/4"]), ("a", "Plan Qty", None), ("b", "Buyer PO", None), ("b", "IO-NO", None), ("b", "Style", ["Shirt"]), ("b", "Etd", None), ("b", "Wash", None)]
    found = naming.field_names(spark.createDataFrame([("w", s, raw, x) for s, raw, x in labels_], "workbook_id string, sheet string, raw string, samples array<string>"))
    assert {(r["sheet"], r["raw"]): r["canonical"] for r in found.collect()} == {("a", "Buyer PO No."): "io_number", ("a", "STYLE"): "style_code", ("a", "Plan Qty"): "quantity", ("b", "Buyer PO"): "buyer_po_no", ("b", "IO-NO"): "io_number", ("b", "Style"): "style_name", ("b", "Etd"): "delivery_date"}
    stages = [("w", "a", x, y) for x, y in (("Ex-Factory Shipment", "Plan"), ("Size Set", "Actl"), ("FI", None), ("Delivery Date", "odd"), ("Unknown", None))]
    columns = spark.createDataFrame(stages, "workbook_id string, sheet string, stage string, sub_label string")
    assert {r["raw"]: r["canonical"] for r in naming.stage_names(columns).collect()} == {"Ex-Factory Shipment": "ex_factory", "Size Set": "size_set", "FI": "final_inspection", "Delivery Date": "ignore", "Unknown": "ignore"}
    assert {r["raw"]: r["canonical"] for r in naming.subfield_names(columns).collect()} == {"Plan": "planned_date", "Actl": "actual_date"}


def test_items_without_sheets(spark):
    none = cells_of(spark, {"x": {"S": at(A1="a")}}).where("false")
    got = extract.extract(none, merges_of(spark, {}))
    assert got.items.count() == 0 and got.warnings.count() == 0 and got.books.count() == 0


def write_book(path, sheets):
    """A workbook of {sheet: {(r, c): value}} with inline texts."""
    from gridlens.sources.xlsx import _MAIN

    letters = lambda c: (letters((c - 1) // 26) if c > 26 else "") + chr(65 + (c - 1) % 26)
    main = f'xmlns="{_MAIN[1:-1]}"'

    def cell(r, c, v):
        if isinstance(v, datetime.datetime):
            return f'<c r="{letters(c)}{r}" s="1"><v>{(v - datetime.datetime(1899, 12, 30)).days}</v></c>'
        return f'<c r="{letters(c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c r="{letters(c)}{r}"><v>{v}</v></c>'

    with zipfile.ZipFile(path, "w") as book:
        names = "".join(f'<sheet name="{escape(s)}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        book.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for k, held in enumerate(sheets.values(), 1):
            rows = "".join(f'<row r="{r}">' + "".join(cell(r, c, held[r, c]) for rr, c in sorted(held) if rr == r) + "</row>" for r in sorted({r for r, _ in held}))
            book.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    for name in ("books", "labels"):
        (path / name).mkdir()
    for name in ("simple", "keys", "strip2"):
        write_book(path / "books" / f"{name} x.xlsx", BOOKS[name])
    (path / "books" / "broken x.xlsx").write_bytes(b"no zip")
    write_book(path / "books" / "unlabelled.xlsx", BOOKS["simple"])
    item = lambda io, **more: {"io_number": io, **more}
    found = {
        "simple x": [item("1063", quantity=2000), item("1064", quantity=1), item("9")], "keys x": [item("63315", quantity=100000, stages=[{"name": "Fit Send"}, {"name": "other stage"}])],
        "strip2 x": [item("131673", delivery_date="2024-03-01")], "broken x": [item("1")], "absent x": [item("1")],
    }
    for stem, plis in found.items():
        (path / "labels" / f"{stem}.json").write_text(json.dumps({"plis": plis, "warnings": []}))
    return path


def test_a_corpus_is_run_and_replayed(spark, corpus):
    got = {r["stem"]: r for r in evaluation.run(spark, f"file://{corpus}/labels", f"file://{corpus}/books", f"file://{corpus}/runs").collect()}
    assert set(got) == {"simple x", "keys x", "strip2 x", "broken x"}
    assert (got["simple x"]["item_recall"], got["simple x"]["field_recall"], got["simple x"]["source_cell_match"], got["simple x"]["header_match"]) == (0.6667, 0.6, 1.0, 1.0)
    assert got["keys x"]["stage_recall"] == 0.5 and got["keys x"]["item_recall"] == 1.0 and got["strip2 x"]["source_cell_match"] == 0.75  # 1,420 as text is not 1420
    assert all(got["broken x"][m] == 0 for m in evaluate.METRICS) and got["broken x"]["error"].startswith("BadZipFile")
    outputs = next((corpus / "runs").glob("*/outputs"))
    again = {r["stem"]: r for r in evaluation.replay(spark, f"file://{outputs}", f"file://{corpus}/labels", f"file://{corpus}/books", f"file://{corpus}/runs").collect()}
    assert {s: [r[m] for m in evaluate.METRICS] for s, r in again.items()} == {s: [r[m] for m in evaluate.METRICS] for s, r in got.items()}
    some = evaluation.replay(spark, f"file://{outputs}", f"file://{corpus}/labels", f"file://{corpus}/books", f"file://{corpus}/runs2", ["simple x"])
    assert [r["stem"] for r in some.collect()] == ["simple x"]
    lines = [r["line"] for r in evaluate.rendered(some).orderBy("place").collect()]
    assert lines[0].startswith("file") and lines[2].startswith("simple x" + " " * 52) and lines[-1].startswith("AVERAGE") and len(set(map(len, lines))) == 1
    assert [r["line"] for r in evaluate.rendered(some.where("false")).collect()] == ["(no eval rows)"]


def test_extents_summaries_and_warnings_of_files(spark, corpus, tmp_path):
    rows = xlsx.load(spark, f"file://{corpus}/books").cache()
    got = {r["workbook_id"].rsplit("/")[-1].replace("%20", " "): r for r in xlsx.summaries(rows).collect()}
    assert got["keys x.xlsx"]["sheets"] == ["63315", "63306", "63305"] and got["keys x.xlsx"]["sheet_count"] == 3 and got["keys x.xlsx"]["size_kb"] >= 1
    assert {r["max_row"] for r in xlsx.extents(rows).where("sheet = '63315'").collect()} == {9} and xlsx.errors(rows).count() == 1
    (tmp_path / "a.json").write_text(json.dumps({"plis": [], "warnings": ["plain", '{"message": "m", "severity": "error"}']}))
    assert {(r["message"], r["severity"]) for r in labels.parsed_warnings(labels.load(spark, f"file://{tmp_path}")).collect()} == {("plain", "warning"), ("m", "error")}


def test_workbooks_that_arrive_are_extracted_exactly_once(spark, corpus, tmp_path):
    windows.extract_arrivals(spark, f"file://{corpus}/books", f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination(300)
    want = {"simple x": 3, "keys x": 3, "strip2 x": 1, "unlabelled": 3, "broken x": 0}
    count = lambda: sorted((r["stem"], len(r["plis"])) for r in labels.stored(spark, f"file://{tmp_path}/out").collect())
    assert count() == sorted(want.items())
    # The query failed after it wrote its batch, before it said so: the batch comes again.
    commits = tmp_path / "check" / "commits"
    assert [f for f in commits.iterdir() if f.name == "0"]
    for f in commits.iterdir():
        f.unlink()
    windows.extract_arrivals(spark, f"file://{corpus}/books", f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination(300)
    assert [f for f in commits.iterdir() if f.name == "0"] and count() == sorted(want.items())


def test_source_and_header_scores(spark, grid):
    fields = spark.createDataFrame([("simple", "S", 0, "io_number", "A2", "1063", "f", "row_per_pli"), ("simple", "S", 0, "quantity", "C2", "2000", "f", "row_per_pli"), ("simple", "S", 1, "style_code", "A3", "x", "f", "row_per_pli"), ("simple", "S", 1, "gone", "A3", None, "f", "row_per_pli"), ("keys", "63315", 0, "io_number", "B4", "63315", "g", "sheet_is_pli")], "workbook_id string, sheet string, number int, field string, addr string, value string, file string, format string")
    assert {r["file"]: r["source_cell_match"] for r in evaluate.source_match(fields, grid[0], "file").collect()} == {"f": 0.5, "g": 1.0}
    assert {r["file"]: r["source_cell_match"] for r in evaluate.source_match(fields, grid[0], "file", strict=True).collect()} == {"f": 0.5, "g": 0.0}
    assert {r["file"]: r["header_match"] for r in evaluate.header_match(fields, grid[0], "file").collect()} == {"f": pytest.approx(2 / 3)}
    assert set(vocab.SCORED_TERMS) == set(vocab.HEADER_TERMS) and check.MIN_FILLED == 0.5
