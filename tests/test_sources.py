"""Odd workbooks, races and deaths while publishing, and what a change of a stored collection touches."""

from __future__ import annotations

import os
import random
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from gridlake.sources import collections, publishing, workbooks
from gridlake.sources.xlsx import Book, column_letters, column_number, moved, serial_date, write_book

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def made(path, rows: str, strings: str = "", merged: str = "", date1904: str = "", columns: str = ""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} {REL}>{date1904}<sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{strings}</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}>{columns}<sheetData>{rows}</sheetData>{merged}</worksheet>")
    return path


def cells(book):
    return {c.coord: c for s in book.sheets for c in book.cells(s)}


def test_cells_and_rows_without_a_place(tmp_path):
    got = cells(Book(str(made(tmp_path / "a.xlsx", '<row><c><v>1</v></c><c r="D1"><v>2</v></c><c><v>3</v></c></row><row r="5"><c><v>4</v></c></row><row><c/><c><v>5</v></c></row>'))))
    assert {k: c.value for k, c in got.items()} == {"A1": "1", "D1": "2", "E1": "3", "A5": "4", "B6": "5"}


def test_readings_are_no_text(tmp_path):
    strings = "<si><t>東京</t><rPh sb='0' eb='2'><t>トウキョウ</t></rPh></si><si><r><t>rich </t></r><r><rPr/><t>text</t></r><rPh><t>x</t></rPh></si>"
    got = cells(Book(str(made(tmp_path / "a.xlsx", '<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="inlineStr"><is><t> in </t><rPh><t>y</t></rPh></is></c><c t="str"><v> </v></c></row>', strings))))
    assert [c.value for c in got.values()] == ["東京", "rich text", " in "]


def test_shared_formulas_move_to_their_cells(tmp_path):
    rows = '<row r="1"><c r="B1"><f t="shared" si="0" ref="B1:B3">A1*$C$1+SUM(A$1:A1)+LOG10(A1)</f><v>1</v></c></row><row r="2"><c r="B2"><f t="shared" si="0"/><v>2</v></c></row><row r="3"><c r="C3"><f t="shared" si="0"/></c></row>'
    got = cells(Book(str(made(tmp_path / "a.xlsx", rows))))
    assert got["B2"].formula == "=A2*$C$1+SUM(A$1:A2)+LOG10(A2)" and got["C3"].formula == "=B3*$C$1+SUM(B$1:B3)+LOG10(B3)"
    assert got["C3"].value_type == "formula" and got["C3"].value is None


@pytest.mark.parametrize(
    "formula,rows,cols,want",
    [
        ("A1", -1, 0, "#REF!"), ("XFD1", 0, 1, "#REF!"), ("'A1 x'!A1&\"A1\"", 1, 1, "'A1 x'!B2&\"A1\""), ("Sheet1!$A1:B$2", 1, 1, "Sheet1!$A2:C$2"), ("SUM(A:C,1:$3,$A:B)", 2, 1, "SUM(B:D,3:$3,$A:C)"),
        ("TAXES2024+Rate_A1+A1.5", 1, 1, "TAXES2024+Rate_A1+A1.5"), ("[1]Data!A1+Table1[A1]", 1, 0, "[1]Data!A2+Table1[A1]"), ("A1()+ATAN2(B2,1)", 1, 0, "A1()+ATAN2(B3,1)"), ("1+2.5E3", 4, 4, "1+2.5E3"),
    ],
)
def test_moved(formula, rows, cols, want):
    assert moved(formula, rows, cols) == want


def test_dates(tmp_path):
    assert [serial_date(x, False) for x in (1, 59, 61, 0.5, 45291.25, 1.5)] == ["1900-01-01", "1900-02-28", "1900-03-01", "12:00:00", "2023-12-31 06:00:00", "1900-01-01 12:00:00"]
    assert serial_date(0, True) == "1904-01-01" and serial_date(43829, True) == "2023-12-31"
    rows = '<row><c s="1"><v>43829</v></c><c s="1"><v>99999999</v></c><c t="d"><v>2024-01-02</v></c></row>'
    got = cells(Book(str(made(tmp_path / "a.xlsx", rows, date1904='<workbookPr date1904="1"/>'))))
    assert [(c.value, c.value_type) for c in got.values()] == [("2023-12-31", "date"), ("#VALUE!", "error"), ("2024-01-02", "date")]


def test_merged_ranges_of_any_size(tmp_path):
    rows = "".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c><c r="C{r}"><v>{r}</v></c><c r="F{r}"><v>0</v></c></row>' for r in range(1, 6))
    merged = '<mergeCells><mergeCell ref="C2:XFD1048576"/><mergeCell ref="A1:B2"/><mergeCell ref="A4"/></mergeCells>'
    got = cells(Book(str(made(tmp_path / "a.xlsx", rows, merged=merged, columns='<cols><col min="2" max="3" hidden="1"/></cols>'))))
    assert sorted(got) == ["A1", "A3", "A4", "A5", "C1", "C2", "F1"]
    assert got["A1"].merged_range == "A1:B2" and got["C2"].merged_range == "C2:XFD1048576" and not got["C2"].visible and got["F1"].visible


def test_memory_is_flat_in_the_sheet(tmp_path):
    import tracemalloc

    peaks = []
    for n in (2_000, 20_000):
        path = tmp_path / f"{n}.xlsx"
        with open(path, "wb") as f:
            write_book(f, (("S", r, c, str(r * c), None, "number", True) for r in range(1, n) for c in range(1, 6)))
        book = Book(str(path))
        tracemalloc.start()
        assert sum(1 for _ in book.cells(book.sheets[0])) == 5 * (n - 1)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + 100_000


def test_letters():
    assert all(column_number(column_letters(n)) == n for n in range(1, 16_385)) and column_letters(16_384) == "XFD"


def test_random_books_come_back(spark, tmp_path):
    rng = random.Random(4)
    want, seen = [], set()
    for book in range(6):
        for sheet in ("A & B", "Zwei"):
            for _ in range(40):
                place = (f"{book}.xlsx", sheet, rng.randrange(1, 30), rng.randrange(1, 30))
                if place in seen:
                    continue
                seen.add(place)
                kind = rng.choice(["number", "text", "boolean", "error", "date"])
                value = {"number": str(rng.random()), "text": rng.choice(["<x> & y", "  lead", "日本\nzwei"]), "boolean": rng.choice(["TRUE", "FALSE"]), "error": "#N/A", "date": "2024-05-06"}[kind]
                formula = rng.choice([None, None, '=IF(A1<3,"x","y")'])
                want.append((*place, value, formula, kind, place[2] % 3 > 0))
    names = "file_name string, sheet string, row int, col int, value string, formula string, value_type string, visible boolean"
    folder = f"file://{tmp_path}/books"
    workbooks.write_workbooks(spark.createDataFrame(want, names).repartition(7), folder)
    got = workbooks.read_workbooks(spark, folder)
    assert sorted(tuple(r) for r in got.select([n.split()[0] for n in names.split(", ")]).collect()) == sorted(want, key=lambda r: r[:4])
    assert got.rdd.getNumPartitions() == 12 and got.where("error IS NOT NULL").count() == 0
    same = workbooks.workbook_bytes_cells(spark.read.format("binaryFile").load(folder))
    assert sorted(map(str, same.collect())) == sorted(map(str, got.collect()))
    assert {n for n in os.listdir(tmp_path / "books")} == {f"{k}.xlsx" for k in range(6)}
    one = workbooks.read_workbooks(spark, f"{tmp_path}/books/3.xlsx", sheet="Zwei")
    assert {(r["file_name"], r["sheet"]) for r in one.collect()} == {("3.xlsx", "Zwei")}


def test_bad_files_are_rows_with_an_error(spark, tmp_path):
    made(tmp_path / "good.xlsx", "<row><c><v>1</v></c></row>")
    made(tmp_path / "broken.xlsx", "<row><c><v>1</v></c></row><row><c t='s'><v>7</v></c></row>")
    (tmp_path / "no.xlsx").write_bytes(b"no workbook")
    (tmp_path / "~$good.xlsx").write_bytes(b"a lock")
    (tmp_path / "notes.txt").write_bytes(b"text")
    got = {(r["file_name"], r["coord"], r["error"] is not None) for r in workbooks.read_workbooks(spark, str(tmp_path)).collect()}
    assert got == {("good.xlsx", "A1", False), ("broken.xlsx", "A1", False), ("broken.xlsx", None, True), ("no.xlsx", None, True)}
    assert workbooks.read_workbooks(spark, str(tmp_path / "nothing")).count() == 0


def test_resolve(spark):
    catalog = spark.createDataFrame([("a.xlsx", "1" * 64), ("b.xlsx", "2" * 64)], "file_name string, workbook_hash string")
    assert workbooks.resolve(catalog, " a.xlsx ").first()["workbook_hash"] == "1" * 64
    assert workbooks.resolve(catalog, workbook_hash="2" * 64).first()["file_name"] == "b.xlsx"
    assert workbooks.resolve(catalog.where("file_name = 'b.xlsx'")).count() == 1
    for name, digest in (("", None), ("c.xlsx", None), ("a.xlsx", "2" * 64)):
        with pytest.raises(ValueError):
            workbooks.resolve(catalog, name, digest)


# -- publishing ------------------------------------------------------------------------------------------------------


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_publish_that_dies_leaves_the_head(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    with pytest.raises(LookupError):
        publishing.current(spark, folder)
    publishing.publish(spark.range(3), folder, "1", 1)
    broken = spark.range(5).withColumn("id", F.when(F.col("id") == 4, F.raise_error(F.lit("dies"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="dies"):
        publishing.publish(broken, folder, "2", 2)
    assert ids(publishing.current(spark, folder)) == [0, 1, 2]
    put = publishing._Store.put_if_absent
    monkeypatch.setattr(publishing._Store, "put_if_absent", lambda self, name, record: (_ for _ in ()).throw(OSError("gone")) if name.startswith("heads") else put(self, name, record))
    with pytest.raises(OSError):
        publishing.publish(spark.range(7), folder, "2", 2)
    assert ids(publishing.current(spark, folder)) == [0, 1, 2]  # version 2 is there, but not the head
    monkeypatch.undo()
    assert publishing.publish(spark.range(99), folder, "2", 2).rows == 7  # goes on with what was written
    assert publishing.current(spark, folder).count() == 7 and publishing.vacuum(spark, folder) == 1
    assert publishing.current(spark, folder, "1").count() == 3


def test_a_late_version_never_moves_the_head(spark, tmp_path):
    folder = str(tmp_path / "t")
    for version, at in (("b", 20), ("a", 10), ("c", 20)):
        publishing.publish(spark.range(at), folder, version, at)
    assert publishing.head(spark, folder).version == "c"  # equal places: by name
    assert {r["version"]: (r["rows"], r["is_head"]) for r in publishing.versions(spark, folder).collect()} == {"a": (10, False), "b": (20, False), "c": (20, True)}


def test_publishers_that_race(spark, tmp_path):
    folder, out, failed = str(tmp_path / "t"), {}, []
    start = threading.Barrier(6)

    def work(k):
        try:
            start.wait()
            out[k] = publishing.publish(spark.range(k + 1), folder, "same" if k < 3 else f"v{k}", 5 if k < 3 else k)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and len({out[k].data for k in range(3)}) == 1  # one attempt at a version won, the others took it
    now = publishing.head(spark, folder)
    assert now.version == "v5" and publishing.current(spark, folder).count() == 6
    store = publishing._Store(spark, folder)
    heads = [store.read(f"heads/{n}") for n in store.names("heads") if n.isdigit()]
    assert [h["at"] for h in heads] == sorted(h["at"] for h in heads)
    publishing.vacuum(spark, folder)
    assert publishing.current(spark, folder, "same").count() == out[0].rows


# -- stored collections ----------------------------------------------------------------------------------------------


@pytest.fixture
def stored(spark, tmp_path):
    folder = str(tmp_path / "c")
    rows = [(f"c{k % 3}", k, f"Company: Old | n {k}", f'{{"company_name":"Old","k":{k}}}') for k in range(9)] + [("a/b=ü", 100, "x", "{}")]
    collections.store(spark.createDataFrame(rows, "collection string, k long, text string, meta string"), folder)
    return folder


def stamps(folder):
    return {d: {f: os.stat(f"{folder}/{d}/{f}").st_mtime_ns for f in os.listdir(f"{folder}/{d}") if f.endswith(".parquet")} for d in os.listdir(folder) if "=" in d}


def changed(before, after):
    return {d for d in before.keys() | after.keys() if before.get(d) != after.get(d)}


def test_a_scoped_scan_reads_its_partitions_only(spark, stored):
    plan = collections.scan(spark, stored, ["c1", "c2"])._jdf.queryExecution().executedPlan().toString()
    assert "collection#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    df = collections.scan(spark, stored, ["c1"])
    assert {os.path.basename(os.path.dirname(f)) for f in df.select(F.input_file_name().alias("f")).toPandas()["f"]} == {"collection=c1"}
    assert collections.scan(spark, stored, []).count() == 0


def test_changes_write_what_they_touch(spark, stored):
    before = stamps(stored)
    new = spark.createDataFrame([("c1", 1, "new", "{}"), ("c1", 50, "new", "{}"), ("c9", 1, "new", "{}")], "collection string, k long, text string, meta string")
    assert collections.upsert(spark, stored, new, ["k"]) == 2
    after = stamps(stored)
    assert changed(before, after) == {"collection=c1", "collection=c9"}
    assert sorted((r["collection"], r["k"]) for r in collections.scan(spark, stored).where("text = 'new'").collect()) == [("c1", 1), ("c1", 50), ("c9", 1)]
    assert collections.scan(spark, stored).count() == 12
    assert collections.rename_company(spark, stored, ["c2"], "company_name", "New") == 1
    again = stamps(stored)
    assert changed(after, again) == {"collection=c2"}
    got = {(r["text"], r["meta"]) for r in collections.scan(spark, stored, ["c2"]).collect()}
    assert got == {(f"Company: New | n {k}", f'{{"k":{k},"company_name":"New"}}') for k in (2, 5, 8)}
    assert collections.rewrite(spark, stored, new.where("collection = 'c9'"), lambda rows: rows.where("false")) == 0
    assert changed(again, stamps(stored)) == {"collection=c9"}


def test_deletes_of_odd_names(spark, stored):
    before = stamps(stored)
    collections.delete(spark, [stored], ["a/b=ü", "none"])
    assert len(changed(before, stamps(stored))) == 1
    assert {r[0] for r in collections.scan(spark, stored).select("collection").distinct().collect()} == {"c0", "c1", "c2"}
