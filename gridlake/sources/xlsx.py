"""The workbook format (.xlsx): sheets read by pull parsing, written line by line."""

from __future__ import annotations

import datetime
import functools
import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import IO, NamedTuple
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

# Number formats of the workbook format that show dates.
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)
#: Day 0 of the two date systems.  The first counts 29 February 1900, a day that never was, as day 60.
_EPOCHS = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}
LAST_ROW, LAST_COLUMN = 1_048_576, 16_384


class Cell(NamedTuple):
    row: int
    col: int
    coord: str
    value: str | None
    formula: str | None
    value_type: str
    visible: bool
    merged_range: str | None


class Sheet(NamedTuple):
    name: str
    part: str
    visible: bool


def column_number(letters: str) -> int:
    return functools.reduce(lambda n, c: n * 26 + ord(c) - 64, letters, 0)


def column_letters(number: int) -> str:
    out = ""
    while number:
        number, k = divmod(number - 1, 26)
        out = chr(65 + k) + out
    return out


def _place(coord: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", coord).groups()
    return int(digits), column_number(letters)


def _box(ref: str) -> tuple[int, int, int, int]:
    """First row, first column, last row, last column."""
    first, _, last = ref.partition(":")
    return *_place(first), *_place(last or first)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.items() if _local(k) == name), None)


def _on(value: str | None) -> bool:
    return value in ("1", "true")


def _plain_text(element: ElementTree.Element) -> str:
    """The text of a string item: of its runs, without the readings (phonetic runs) of any."""
    out = []
    for child in element:
        if _local(child.tag) == "t":
            out.append(child.text or "")
        elif _local(child.tag) == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(out)


def shows_date(number: int, code: str) -> bool:
    """Whether a number format shows dates: letters of dates outside quotes, brackets and escapes."""
    return number in DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code.lower())))


def serial_date(serial: float, from_1904: bool) -> str:
    """A date serial as text; a serial below 1 is a time of day.  Raises OverflowError beyond the calendar."""
    day, rest = divmod(serial, 1)
    after = datetime.timedelta(milliseconds=round(rest * 86_400_000))
    if day == 0 and not from_1904:
        return (datetime.datetime.min + after).time().isoformat()
    if not from_1904 and 0 < day < 60:
        day += 1
    at = _EPOCHS[from_1904] + datetime.timedelta(days=day) + after
    return at.date().isoformat() if at.time() == datetime.time() else at.isoformat(" ")


#: What a formula is made of as far as moving it goes: strings, quoted names and brackets stay; cells, columns, rows move.
_PARTS = re.compile(
    r"""("(?:[^"]|"")*"|'(?:[^']|'')*'|\[[^\]]*\])"""
    r"""|(?<![\w.$])(\$?)([A-Z]{1,3})(\$?)(\d{1,7})(?![\w(.!])"""
    r"""|(?<![\w.$])(\$?[A-Z]{1,3}):(\$?[A-Z]{1,3})(?![\w(.!$])"""
    r"""|(?<![\w.$:])(\$?\d{1,7}):(\$?\d{1,7})(?![\w.])"""
)


def moved(formula: str, rows: int, cols: int) -> str:
    """A formula as it stands in a cell so many rows down and columns right: references without $ move along."""

    def column(text: str) -> str | None:
        if text.startswith("$"):
            return text
        n = column_number(text) + cols
        return column_letters(n) if 1 <= n <= LAST_COLUMN else None

    def row(text: str) -> str | None:
        if text.startswith("$"):
            return text
        n = int(text) + rows
        return str(n) if 1 <= n <= LAST_ROW else None

    def one(m: re.Match) -> str:
        if m[1] is not None:
            return m[1]
        if m[5] is not None:
            both = column(m[2] + m[3]), row(m[4] + m[5])
        elif m[6] is not None:
            both = column(m[6]), column(m[7])
        else:
            both = row(m[8]), row(m[9])
        if None in both:
            return "#REF!"
        return ("" if m[5] is not None else ":").join(both)

    return _PARTS.sub(one, formula)


class Book:
    """A workbook; nothing is read but what is asked for, and of a sheet one row at a time."""

    def __init__(self, file: IO[bytes] | str):
        self.zip = zipfile.ZipFile(file)
        self.parts = set(self.zip.namelist())

    @functools.cached_property
    def _book(self) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read("xl/workbook.xml"))

    @functools.cached_property
    def from_1904(self) -> bool:
        return any(_on(x.get("date1904")) for x in self._book if _local(x.tag) == "workbookPr")

    @functools.cached_property
    def sheets(self) -> list[Sheet]:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        found = []
        for x in self._book.iter():
            if _local(x.tag) == "sheet":
                target = targets[_attribute(x, "id")]
                part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                if "chartsheet" not in part:
                    found.append(Sheet(x.get("name"), part, x.get("state", "visible") == "visible"))
        return found

    @functools.cached_property
    def _strings(self) -> list[str]:
        out = []
        if "xl/sharedStrings.xml" in self.parts:
            with self.zip.open("xl/sharedStrings.xml") as f:
                for _, x in ElementTree.iterparse(f):
                    if _local(x.tag) == "si":
                        out.append(_plain_text(x))
                        x.clear()
        return out

    @functools.cached_property
    def _dates(self) -> list[bool]:
        """Whether each cell style shows dates."""
        if "xl/styles.xml" not in self.parts:
            return []
        styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        codes = {int(x.get("numFmtId")): x.get("formatCode", "") for x in styles.iter() if _local(x.tag) == "numFmt"}
        own = next((x for x in styles if _local(x.tag) == "cellXfs"), ())
        return [shows_date(n, codes.get(n, "")) for n in (int(x.get("numFmtId", 0)) for x in own)]

    def _layout(self, sheet: Sheet) -> tuple[list[tuple[int, int]], list[str]]:
        """Hidden ranges of columns, and merged ranges, which stand behind the cells: a pass that keeps nothing else."""
        hidden, merged = [], []

        def start(tag: str, given: dict[str, str]) -> None:
            tag = tag.rpartition(":")[2]
            if tag == "col" and _on(given.get("hidden")):
                hidden.append((int(given["min"]), int(given["max"])))
            elif tag == "mergeCell":
                merged.append(given["ref"])

        parser = expat.ParserCreate()
        parser.StartElementHandler = start
        with self.zip.open(sheet.part) as f:
            parser.ParseFile(f)
        return hidden, merged

    def cells(self, sheet: Sheet) -> Iterator[Cell]:
        """The filled cells of a sheet in order.  The value is the one last worked out; a cell that a merged range covers is
        left out but for the first, whose value it has.  Cells and rows without a place follow the one before.
        """
        hidden, merged = self._layout(sheet)
        boxes = sorted(_box(ref) for ref in merged)
        names = {_box(ref)[:2]: ref for ref in merged}
        masters: dict[str, tuple[int, int, str]] = {}
        row, col, row_shown, shut = 0, 0, True, []
        waiting = iter(boxes)
        coming = next(waiting, None)
        with self.zip.open(sheet.part) as f:
            data = None
            for event, x in ElementTree.iterparse(f, ("start", "end")):
                tag = _local(x.tag)
                if tag == "sheetData" and event == "start":
                    data = x
                elif tag == "row" and event == "start":
                    row, col = int(x.get("r") or row + 1), 0
                    row_shown = not _on(x.get("hidden"))
                    shut = [b for b in shut if b[2] >= row]  # merged ranges that reach this row
                    while coming and coming[0] <= row:
                        shut += [coming] if coming[2] >= row else []
                        coming = next(waiting, None)
                elif tag == "row":
                    if data is not None:
                        data.clear()
                elif tag == "c" and event == "end":
                    if x.get("r"):
                        row, col = _place(x.get("r"))
                    else:
                        col += 1
                    if any(b[1] <= col <= b[3] and b[0] <= row <= b[2] and (row, col) != b[:2] for b in shut):
                        continue
                    value, formula, kind = self._content(x, row, col, masters)
                    if kind is not None:
                        shown = sheet.visible and row_shown and not any(a <= col <= b for a, b in hidden)
                        yield Cell(row, col, f"{column_letters(col)}{row}", value, formula, kind, shown, names.get((row, col)))

    def _content(self, x: ElementTree.Element, row: int, col: int, masters: dict) -> tuple[str | None, str | None, str | None]:
        """(value, formula, value_type) of a cell; a type of None is an empty cell."""
        parts = {_local(child.tag): child for child in x}
        kind, raw, own = x.get("t", "n"), parts.get("v"), parts.get("f")
        text = _plain_text(parts["is"]) if kind == "inlineStr" and "is" in parts else raw.text if raw is not None else None
        formula = None
        if own is not None:
            written, group = own.text or "", own.get("si") if own.get("t") == "shared" else None
            if group is not None and written:
                masters[group] = (row, col, written)
            elif group is not None and group in masters:
                top, left, written = masters[group]
                written = moved(written, row - top, col - left)
            formula = f"={written}"
        if kind == "s" and text is not None:
            text = self._strings[int(text)]
        if text is None or not text.strip():
            return (None, formula, "formula") if formula is not None else (None, None, None)
        if kind == "e":
            return text, formula, "error"
        if kind == "b":
            return "TRUE" if _on(text) else "FALSE", formula, "boolean"
        if kind in ("s", "str", "inlineStr"):
            return text, formula, "text"
        style = int(x.get("s", 0))
        if kind == "d":
            return text, formula, "date"
        if style < len(self._dates) and self._dates[style]:
            try:
                return serial_date(float(text), self.from_1904), formula, "date"
            except (OverflowError, ValueError):
                return "#VALUE!", formula, "error"
        return text, formula, "number"


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def write_book(file: IO[bytes], cells: Iterable[tuple[str, int, int, str | None, str | None, str, bool]]) -> None:
    """A workbook of cells (sheet, row, col, value, formula, value_type, visible), which come in order of sheet, row and col.

    value_type is number, text, boolean, error or date (an ISO date, kept as one); a row of which every cell is invisible is
    hidden.  Texts are written in place, so nothing is held but a row.
    """
    names = []
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        out, at, line = None, None, []

        def end_row():
            if line:
                hidden = "" if any(shown for _, shown in line) else ' hidden="1"'
                out.write(f'<row r="{at}"{hidden}>{"".join(x for x, _ in line)}</row>'.encode())
                line.clear()

        def end_sheet():
            if out:
                end_row()
                out.write(b"</sheetData></worksheet>")
                out.close()

        for sheet, row, col, value, formula, kind, shown in cells:
            if not names or names[-1] != sheet:
                end_sheet()
                names.append(sheet)
                out, at = z.open(f"xl/worksheets/sheet{len(names)}.xml", "w"), None
                out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            if row != at:
                end_row()
                at = row
            line.append((_cell_xml(row, col, value, formula, kind), shown))
        end_sheet()
        book = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1))
        rels = "".join(f'<Relationship Id="r{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{book}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{rels}</Relationships>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>{types}</Types>')


def _cell_xml(row: int, col: int, value: str | None, formula: str | None, kind: str) -> str:
    code = {"text": "str" if formula else "inlineStr", "boolean": "b", "error": "e", "date": "d"}.get(kind, "n")
    f = f"<f>{escape(formula.removeprefix('='))}</f>" if formula else ""
    if kind == "boolean" and value is not None:
        value = "1" if value == "TRUE" else "0"
    if value is None:
        v = ""
    elif code == "inlineStr":
        v = f'<is><t xml:space="preserve">{escape(value)}</t></is>'
    else:
        v = f"<v>{escape(value)}</v>"
    return f'<c r="{column_letters(col)}{row}" t="{code}">{f}{v}</c>'
