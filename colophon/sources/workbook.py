"""Sheets of xlsx workbooks as tables of cells, read from the zipped XML where the file is."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..errors import FormatError, MissingInput

CELL = "path string, sheet string, row int, col int, value string, error string"
#: Fixed: rows a sheet can have, its headings apart, and what XML can't hold.
SHEET_ROWS = 1_048_575
_UNSAFE = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(reference: str) -> int:
    """1 for A1, 27 for AA1."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n


def cells_of(content: bytes):
    """(sheet, row, column, text) of each cell that has a value."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(_MAIN + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
            for cell in ElementTree.fromstring(z.read("xl/" + targets[sheet.get(_REL + "id")])).iter(_MAIN + "c"):
                value = cell.find(_MAIN + "v")
                if cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
                elif value is None:
                    continue
                else:
                    text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                reference = cell.get("r")
                yield sheet.get("name"), int(re.search(r"\d+", reference)[0]), column_number(reference), text


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of the workbooks at ``path``; a file that is no workbook is one row with its error."""
    try:
        files = spark.read.format("binaryFile").load(path)
    except Exception as e:
        raise MissingInput(f"no workbook {path}") from e

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = [(name, *c, None) for c in cells_of(content)]
                except Exception as e:  # a fault of one file
                    rows = [(name, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "value", "error"]).astype({"row": "Int32", "col": "Int32"})

    return files.select("path", "content").mapInPandas(run, CELL)


def read_sheet(spark: SparkSession, path: str, sheet: str = "Analysis", columns: list[str] | None = None) -> DataFrame:
    """One sheet as a table: row_number (from 2) and a string column for each heading of row 1, or for ``columns`` only.

    Filters on the columns are pushed to where the workbook is read (see ``data_sources``).
    """
    from .data_sources import files_of, register

    register(spark)
    files_of(path)  # MissingInput where there is nothing
    source = spark.read.format("colophon_sheet").option("sheet", sheet)
    try:
        found = source.load(path)
    except AnalysisException as e:
        if "FormatError" in str(e):
            raise FormatError(f"{path} is no workbook, or has no sheet {sheet}: {e}") from e
        raise
    if columns is None:
        return found
    if lacking := [c for c in columns if c not in found.columns]:
        raise FormatError(f"{path} has no column {lacking[0]}")
    return source.schema(StructType([found.schema["row_number"], *[found.schema[c] for c in columns if c != "row_number"]])).load(path)


def sheet_xml(heads: list[str], rows) -> bytes:
    """A sheet whose cells are texts written in place."""
    out = io.StringIO()
    out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>')
    for number, row in enumerate([heads, *rows], 1):
        cells = (f'<c r="{column_letters(n)}{number}" t="inlineStr"><is><t xml:space="preserve">{escape(_UNSAFE.sub("", str(x)), {"\r": "&#13;"})}</t></is></c>' for n, x in enumerate(row, 1) if x is not None)
        out.write(f'<row r="{number}">{"".join(cells)}</row>')
    out.write("</sheetData></worksheet>")
    return out.getvalue().encode()


def column_letters(n: int) -> str:
    """A for 1, AA for 27."""
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def workbook_of(sheet: str, heads: list[str], rows) -> bytes:
    """An xlsx file with one sheet."""
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    package = "http://schemas.openxmlformats.org/package/2006"
    office = _REL[1:-1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet_xml(heads, rows))
    return out.getvalue()


def write_sheet(df: DataFrame, path: str, sheet: str = "Analysis", rows: int = SHEET_ROWS) -> None:
    """The rows as workbooks below ``path``, each written by the task that has them, ``rows`` at most in one.

    Nulls are empty cells; characters that XML can't hold are left out.  Workbooks of an earlier call go first; a task
    that runs again writes the same names.
    """
    from pyspark import TaskContext

    from .data_sources import located

    if not 0 < rows <= SHEET_ROWS:
        raise FormatError(f"a sheet has 1 to {SHEET_ROWS} rows")
    heads = df.columns
    system, at = located(path)
    for old in system.get_file_info(FileSelector(at, allow_not_found=True)):
        if re.fullmatch(r"part-\d+-\d+\.xlsx", old.base_name):
            system.delete_file(old.path)

    def run(batches):
        system, at = located(path)
        system.create_dir(at, recursive=True)
        part, held, done = TaskContext.get().partitionId(), [], 0

        def flush():
            with system.open_output_stream(f"{at}/part-{part:05d}-{done:05d}.xlsx") as f:
                f.write(workbook_of(sheet, heads, held))
            held.clear()

        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                held.append(row)
                if len(held) == rows:
                    flush()
                    done += 1
        if held:
            flush()
            done += 1
        yield pd.DataFrame({"part": [part], "files": [done]})

    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in heads])
    if not texts.mapInPandas(run, "part int, files int").agg(F.sum("files")).first()[0]:  # an empty table has its headings
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/part-00000-00000.xlsx") as f:
            f.write(workbook_of(sheet, heads, []))
