"""Workbooks as a data source and sink, their catalog, and cells as documents."""

from __future__ import annotations

import concurrent.futures
import hashlib
import io
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import scalar as S
from ..operators.retrieval import header_variants
from .xlsx import Book, Sheet, write_book

CELLS = "file_name string, workbook_hash string, sheet string, row int, col int, coord string, value string, formula string, value_type string, visible boolean, merged_range string, error string"
_NAMES = [x.split(" ")[0] for x in CELLS.split(", ")]
_SCHEMA = pa.schema([(n, {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (x.split(" ") for x in CELLS.split(", "))])
# Endings of workbooks, and beginnings of names of sheets that a catalog leaves out.
SUFFIXES = (".xlsx", ".xlsm")
SKIPPED_SHEETS = ("__snloffice", "___snloffice")
#: Cells of one batch; workbooks whose lists of sheets are read at once.
_BATCH, _LISTING = 4096, 32


def _is_workbook(name: str) -> bool:
    return name.lower().endswith(SUFFIXES) and not name.startswith("~$")


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file system of a path and the workbooks under it (or the workbook itself), by name."""
    store, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if info.type == fs.FileType.Directory else []
    return store, sorted((f for f in found if f.type == fs.FileType.File and _is_workbook(f.base_name)), key=lambda f: f.path)


def _digest(file) -> str:
    digest = hashlib.sha256()
    while chunk := file.read(1 << 20):
        digest.update(chunk)
    return digest.hexdigest()


def _record(file_name: str, digest: str | None, sheet: str | None, cell=None, error: str | None = None) -> tuple:
    row = (None,) * 8 if cell is None else tuple(cell)
    return file_name, digest, sheet, *row, error


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while chunk := list(itertools.islice(rows, _BATCH)):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*chunk, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _problem(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _sheet_rows(file_name: str, digest: str, book: Book, sheet: Sheet) -> Iterator[tuple]:
    """The cells of a sheet; where it breaks off, a row that says why."""
    try:
        for cell in book.cells(sheet):
            yield _record(file_name, digest, sheet.name, cell)
    except Exception as e:
        yield _record(file_name, digest, sheet.name, error=_problem(e))


@dataclass
class _SheetPartition(InputPartition):
    path: str
    sheet: Sheet | None
    error: str | None = None


class _CellReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("load() needs the path of workbooks")
        self.path, self.only = options["path"], options.get("sheet")

    def partitions(self) -> list[InputPartition]:
        """One for each sheet: of each workbook only its directory and its list of sheets are read here."""
        store, files = _files(self.path)

        def of(info: fs.FileInfo) -> list[_SheetPartition]:
            try:
                with store.open_input_file(info.path) as f:
                    return [_SheetPartition(info.path, sheet) for sheet in Book(f).sheets if self.only in (None, sheet.name)]
            except Exception as e:
                return [_SheetPartition(info.path, None, _problem(e))]

        with concurrent.futures.ThreadPoolExecutor(_LISTING) as pool:
            return [p for ps in pool.map(of, files) for p in ps] or [_SheetPartition("", None)]

    def read(self, partition: _SheetPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        name = partition.path.rsplit("/", 1)[-1]
        if partition.sheet is None:
            yield from _batches(iter([_record(name, None, None, error=partition.error)]))
            return
        store = _files(self.path)[0]
        with store.open_input_file(partition.path) as f:
            digest = _digest(f)
            f.seek(0)
            yield from _batches(_sheet_rows(name, digest, Book(f), partition.sheet))


@dataclass
class _Written(WriterCommitMessage):
    paths: list[tuple[str, str]]


class _BookWriter(DataSourceWriter):
    """Workbooks are written beside their places under names of their own, and moved there when all tasks have succeeded."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], schema.names, overwrite

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        store.create_dir(base, recursive=True)
        task, done = TaskContext.get(), []
        fields = ("sheet", "row", "col", "value", "formula", "value_type", "visible")
        for name, own in itertools.groupby(rows, lambda r: r["file_name"]):
            draft = f"{base}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(draft) as f:
                write_book(f, (tuple(r[c] if c in self.names else True for c in fields) for r in own))
            done.append((draft, f"{base}/{name}"))
        return _Written(done)

    def commit(self, messages) -> None:
        store, base = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        drafts = [p for m in messages if m for p in m.paths]
        if self.overwrite:
            keep = {name for _, name in drafts}
            for old in _files(self.path)[1]:
                if old.path not in keep:
                    store.delete_file(old.path)
        for draft, name in drafts:
            store.move(draft, name)

    def abort(self, messages) -> None:
        for m in messages:
            for draft, _ in m.paths if m else ():
                _files(self.path)[0].delete_file(draft)


class WorkbookSource(DataSource):
    """spark.read.format("workbook_cells").load(folder or file), option sheet: one row for each filled cell, see CELLS.

    A sheet is a partition, read by pull parsing: memory holds one row of it and the workbook's list of shared texts.
    value_type is error, date, boolean, number, text, or formula (one without a value); visible is false in hidden rows,
    columns and sheets.  A file or sheet that cannot be read gives a row with error (and what was read before it).

    write.format("workbook_cells").save(folder) takes file_name, sheet, row, col, value, formula, value_type, visible; rows of
    a workbook must be in one partition, in order, as workbook_rows() puts them.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook_cells"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _CellReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BookWriter(self.options, schema, overwrite)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The cells of the workbooks under path (see WorkbookSource), in a store that pyarrow reads."""
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook_cells")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def workbook_rows(cells: DataFrame) -> DataFrame:
    """Cells dealt out and put in order to be written as workbooks."""
    return cells.repartition("file_name").sortWithinPartitions("file_name", "sheet", "row", "col")


def write_workbooks(cells: DataFrame, path: str) -> None:
    """Cells (file_name, sheet, row, col, value, formula, value_type, visible) as workbooks in a folder."""
    cells.sparkSession.dataSource.register(WorkbookSource)
    workbook_rows(cells).write.format("workbook_cells").mode("append").save(path)


def workbook_bytes_cells(files: DataFrame) -> DataFrame:
    """The same cells from (path, content), as Spark's binaryFile reads them, for stores that only Spark reads: a workbook is
    one task's work, held as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name, raw = path.rsplit("/", 1)[-1], content.as_py()
                digest = hashlib.sha256(raw).hexdigest()
                try:
                    book = Book(io.BytesIO(raw))
                    sheets = book.sheets
                except Exception as e:
                    yield from _batches(iter([_record(name, digest, None, error=_problem(e))]))
                    continue
                for sheet in sheets:
                    yield from _batches(_sheet_rows(name, digest, book, sheet))

    return files.select("path", "content").mapInArrow(run, CELLS)


def visible(cells: DataFrame) -> DataFrame:
    """Cells that neither a hidden row nor column nor sheet hides."""
    return cells.where("visible")


def populated(cells: DataFrame) -> DataFrame:
    """Cells with a value."""
    return cells.where("value IS NOT NULL AND value <> ''")


def workbook_catalog(cells: DataFrame) -> DataFrame:
    """Each workbook with its digest, the names of its sheets that have cells to be seen, and the number of its cells."""
    listed = F.col("visible") & ~F.lower("sheet").rlike("^(" + "|".join(SKIPPED_SHEETS) + ")")
    return cells.where("coord IS NOT NULL").groupBy("file_name", "workbook_hash").agg(F.array_sort(F.collect_set(F.when(listed, F.col("sheet")))).alias("sheets"), F.count("*").alias("n_cells"))


def resolve(catalog: DataFrame, file_name: str | None = None, workbook_hash: str | None = None) -> DataFrame:
    """The catalog's row of a workbook, by name (white space around it does not count), by digest, or by both; without
    either the only workbook.  Raises ValueError if there is none, or no single one."""
    name, found = (file_name or "").strip(), catalog
    if name:
        found = found.where(F.col("file_name") == name)
    if workbook_hash:
        found = found.where(F.col("workbook_hash") == workbook_hash)
    names = sorted({r["file_name"] for r in found.select("file_name").limit(2).collect()})
    if len(names) != 1:
        raise ValueError(f"{'no' if not names else 'more than one'} workbook for name {name!r} and digest {workbook_hash!r}")
    return found


def cell_documents(cells: DataFrame) -> DataFrame:
    """The documents of each data cell: its header paths in all variants, with a question mark and with its value.

    cells: company, sheet, coord, row_path and column_path (arrays), value.  Returns company, sheet, coord, variant
    (header_only, header_with_value), row_headers, column_headers, text; equal texts of a cell are one document.
    """
    pairs = cells.withColumn("row_headers", F.explode(header_variants(F.col("row_path")))).withColumn("column_headers", F.explode(header_variants(F.col("column_path"))))
    both = pairs.withColumn("variant", F.explode(F.array(F.lit("header_only"), F.lit("header_with_value"))))
    value = F.when(F.col("variant") == "header_with_value", F.col("value"))
    text = S.serialized_cell(F.col("company"), F.col("sheet"), F.col("row_headers"), F.col("column_headers"), value)
    return both.select("company", "sheet", "coord", "variant", "row_headers", "column_headers", text.alias("text")).dropDuplicates(["company", "sheet", "coord", "text"])
