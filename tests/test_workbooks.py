"""A workbook written here, read back, profiled and turned into documents; plain versions of what SQL cannot express."""

import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from gridlake.functions import formulas
from gridlake.functions import scalar as S
from gridlake.operators import cells, graph, profile
from gridlake.sources import workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path):
    strings = ["Data in ($M)", "Period Ended", "Revenue", "LTM", "Estimates"]
    sheet = f"""<worksheet {MAIN}><cols><col min="6" max="6" hidden="1"/></cols><sheetData>
        <row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row>
        <row r="2"><c r="D2" t="s"><v>3</v></c><c r="E2" t="s"><v>4</v></c></row>
        <row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>45291</v></c><c r="C3" t="str"><v>FY2024</v></c><c r="D3" s="1"><v>45657</v></c><c r="E3" s="1"><v>46022</v></c></row>
        <row r="4"><c r="A4" t="s"><v>2</v></c><c r="B4"><v>100.5</v></c><c r="C4"><f>B4*2</f><v>201</v></c><c r="D4" t="e"><v>#DIV/0!</v></c><c r="E4" t="b"><v>1</v></c><c r="F4"><v>7</v></c></row>
        <row r="5" hidden="1"><c r="B5"><v>9</v></c></row><row r="6"><c r="B6"><f>B5</f></c><c r="C6"/></row>
        </sheetData><mergeCells><mergeCell ref="C1:D1"/></mergeCells></worksheet>"""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} {REL}><sheets><sheet name="IS" sheetId="1" r:id="r1"/><sheet name="Old" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" s="2"><v>1.5</v></c></row></sheetData></worksheet>')


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    book(folder / "one.xlsx")
    return workbooks.read_workbooks(spark, str(folder)).cache()


def test_cells_of_a_workbook(read):
    got = {(r["sheet"], r["coord"]): (r["value"], r["formula"], r["value_type"], r["visible"]) for r in read.collect()}
    assert got["IS", "A1"] == ("Data in ($M)", None, "text", True) and got["IS", "B3"] == ("2023-12-31", None, "date", True)
    assert got["IS", "C4"] == ("201", "=B4*2", "number", True) and got["IS", "D4"][2] == "error" and got["IS", "E4"][:3] == ("TRUE", None, "boolean")
    assert got["IS", "B6"] == (None, "=B5", "formula", True) and ("IS", "C6") not in got and got["IS", "C1"][0] == "x"
    assert not got["IS", "F4"][3] and not got["IS", "B5"][3] and got["Old", "A1"] == ("1900-01-01 12:00:00", None, "date", False)
    assert workbooks.visible(read).where("sheet = 'Old'").count() == 0 and workbooks.populated(read).where("coord = 'B6'").count() == 0
    catalog = workbooks.workbook_catalog(read).collect()
    assert [(r["file_name"], list(r["sheets"]), len(r["workbook_hash"])) for r in catalog] == [("one.xlsx", ["IS"], 64)]


def test_profile_of_a_workbook(read):
    c = workbooks.visible(read).withColumnRenamed("file_name", "workbook")
    axes = {(r["col"], r["label"], r["kind"]) for r in profile.period_axes(c).collect()}
    assert axes == {(2, "2023-12-31", "fy"), (3, "FY2024", "fy"), (4, "2024-12-31", "ltm")}
    p = profile.workbook_profile(c).first()
    assert (p["currency"], p["scale"], list(p["fiscal_years"]), list(p["ltm_years"]), p["status"]) == ("USD", "millions", [2023, 2024], [2024], "complete")
    p = profile.workbook_profile(c.where("coord <> 'A1'")).first()
    assert p["status"] == "partial" and list(p["issues"]) == ["currency_missing", "amount_scale_missing"]


def test_documents_of_a_cell(spark):
    one = spark.createDataFrame([("co", "IS", "C2", ["Assets", "Current Assets", "Cash"], ["Fiscal Year", "2024-12-31"], "120")], "company string, sheet string, coord string, row_path array<string>, column_path array<string>, value string")
    got = {(tuple(r["row_headers"]), tuple(r["column_headers"]), r["variant"]): r["text"] for r in workbooks.cell_documents(one).collect()}
    assert got[("Cash",), ("2024-12-31",), "header_with_value"] == "Company: co | Sheet: IS | Row Header: Cash | Column Header: 2024-12-31 | Cell Value: 120"
    assert (("Current Assets", "Cash"), ("Fiscal Year",), "header_only") in got and len(got) == len(set(got.values()))


def test_uuids_are_those_of_python(spark):
    space = uuid.NAMESPACE_DNS
    rows = spark.range(50).select("id", S.name_uuid(str(space), F.col("id").cast("string")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(space, str(r["id"]))) for r in rows)


@pytest.mark.parametrize("x", ["7 // 2", "-7 // 2", "-7 % 3", "7 % -3", "2 ** 3", "round(2.5)", "round(1.2345, 2)", "abs(-3) + min(1, 2) - max(4, 3)", "sum(1, 2, 3)"])
def test_arithmetic_is_that_of_python(spark, x):
    assert spark.range(1).select(formulas.compiled(x, answers=True)).first()[0] == float(eval(x.replace("sum(1, 2, 3)", "6")))


@pytest.mark.parametrize("bad", ["pow(2, 3)", "abs(1, 2)", "x.y(1)", "min()", "round(1, x)", "sum(*[1])"])
def test_arithmetic_rejects(spark, bad):
    with pytest.raises(formulas.FormulaError):
        formulas.compiled(bad, {}, answers=True)


def test_levels_and_descendants_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)], "source long, target long")
    nodes = spark.range(13).withColumnRenamed("id", "node")
    assert {r["node"]: r["level"] for r in graph.generations(nodes, edges).collect()} == {k: k for k in range(13)}
    assert graph.descendants(nodes.where("node = 0"), edges).count() == 13


def test_merged_boxes_by_brute_force(spark):
    rng = random.Random(6)
    boxes = []
    for _ in range(40):
        r, c = rng.randrange(60), rng.randrange(60)
        boxes.append(["s", r, r + rng.randrange(6), c, c + rng.randrange(6), 1])
    want = [b[1:] for b in boxes]
    again = True
    while again:
        again = False
        for i, a in enumerate(want):
            for b in want[:i]:
                if a[0] <= b[1] + 1 and b[0] <= a[1] + 1 and a[2] <= b[3] + 1 and b[2] <= a[3] + 1:
                    want.remove(a)
                    want.remove(b)
                    want.append([min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]])
                    again = True
                    break
            if again:
                break
    df = spark.createDataFrame(boxes, "sheet string, min_row int, max_row int, min_col int, max_col int, n_cells long")
    assert sorted(map(list, (tuple(r)[1:] for r in cells.merged_boxes(df, gap=0).collect()))) == sorted(want)
