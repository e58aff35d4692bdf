"""Sheets of workbooks and batch result files as formats of ``spark.read``.

``register`` makes them known to a session: ``colophon_sheet`` (one partition a workbook that has the sheet) and
``colophon_batch`` (one partition a range of bytes of a file of JSON lines).  Both take comparisons of a column with
constants as pushed filters, so that rows that fail are never handed to Spark; a sheet is read no further than the
greatest row that a filter allows.  Spark asks such sources for all columns of their schema: give ``schema`` (or
``columns`` of ``read_sheet``) where a few will do, then only these are made.

Files are opened where the tasks run, on any file system that pyarrow knows by its address.
"""

from __future__ import annotations

import json
import operator
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import IntegerType, StringType, StructType

from ..errors import BatchError, FormatError, MissingInput

BATCH = "custom_id string, content string, finish_reason string, prompt bigint, completion bigint, cached bigint, error string"
#: Rows handed to Spark at once, and bytes of a batch file a task reads.
ROWS, RANGE_BYTES = 1_000, 64 << 20
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, among: x in among, StringStartsWith: str.startswith}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address (``file:/x`` included) or of a local path, and the path there."""
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") or ":" not in path else fs.FileSystem.from_uri(path)


def files_of(path: str) -> list[tuple[str, int]]:
    """Address and size of the file, or of the files in the folder by name; hidden ones are left out."""
    system, at = located(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise MissingInput(f"no file {path}")
    found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(at)) if x.is_file and x.base_name[0] not in "._"]
    return sorted((path if info.is_file else f"{path.rstrip('/')}/{x.base_name}", x.size) for x in found)


class Pushed:
    """Filters that rows must pass; what it can't judge stays with Spark."""

    def __init__(self) -> None:
        self.tests: list[tuple[str, type, object]] = []

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = isinstance(f, (*_COMPARED, IsNull, IsNotNull)) and len(f.attribute) == 1
            if not known or getattr(f, "value", "") is None:
                yield f
                continue
            self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))

    def passes(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            x = row.get(name)
            if kind is IsNull or x is None:
                if (kind is IsNull) != (x is None):
                    return False
            elif kind is not IsNotNull and not _COMPARED[kind](x, value):
                return False
        return True

    def greatest(self, name: str) -> float:
        """No row above this value of an integer column passes."""
        bounds = [max(v, default=-1) if kind is In else v for n, kind, v in self.tests if n == name and kind in (EqualTo, In, LessThan, LessThanOrEqual)]
        return min(bounds, default=float("inf"))


def _batches(rows: Iterator[dict], schema: StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind, some = to_arrow_schema(schema), []
    for row in rows:
        some.append(row)
        if len(some) == ROWS:
            yield pa.RecordBatch.from_pylist(some, kind)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, kind)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.pushed = schema, options, Pushed()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.pushed.take(filters)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read from no partitions
            return iter(())
        names = self.schema.fieldNames()
        rows = (row for row in self.rows(partition) if self.pushed.passes(row))
        return _batches(({n: row.get(n) for n in names} for row in rows), self.schema)


# --- batch result files -----------------------------------------------------------------------------------------


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def lines_of(part: ByteRange) -> Iterator[bytes]:
    """Lines that begin in the range; the last one may end behind it."""
    system, at = located(part.path)
    with system.open_input_file(at) as f:
        f.seek(max(part.start - 1, 0))
        rest, where = b"", max(part.start - 1, 0)
        skip = part.start > 0  # up to the end of the line that begins before
        while block := f.read(1 << 20):
            lines = (rest + block).split(b"\n")
            rest = lines.pop()
            for line in lines:
                begins, where = where, where + len(line) + 1
                if skip:
                    skip = False
                elif begins >= part.end:
                    return
                else:
                    yield line
            if where >= part.end and not skip:
                return
        if rest and not skip and where < part.end:
            yield rest


def _compact(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def outcome_of(line: bytes) -> dict:
    """Answer or error of one line, as ``completions.outcomes`` has them."""
    told = json.loads(line)
    told = told if isinstance(told, dict) else {}
    response = told.get("response") if isinstance(told.get("response"), dict) else {}
    body, status = response.get("body"), response.get("status_code")
    fields = body if isinstance(body, dict) else {}
    choices, status = fields.get("choices"), 200 if status is None else int(status)
    out = {"custom_id": told.get("custom_id"), "content": None, "finish_reason": None, "prompt": 0, "completion": 0, "cached": 0, "error": None}
    choice = choices[0] if isinstance(choices, list) and choices else None
    if isinstance(choice, dict):
        out["finish_reason"] = choice.get("finish_reason")
    if status != 200 or choice is None:
        why = told.get("error") if told.get("error") is not None else body
        out["error"] = f"status {status}: " + ("no response" if why is None else why if isinstance(why, str) else _compact(why))[:500]
        return out
    message = (choice.get("message") if isinstance(choice, dict) else None) or {}
    usage = fields.get("usage") or {}
    out["content"] = message.get("content") or ""
    out |= {"prompt": usage.get("prompt_tokens") or 0, "completion": usage.get("completion_tokens") or 0, "cached": (usage.get("prompt_tokens_details") or {}).get("cached_tokens") or 0}
    return out


class BatchReader(_Reader):
    def partitions(self) -> list[ByteRange]:
        size = int(self.options.get("rangeBytes", RANGE_BYTES))
        return [ByteRange(path, a, min(a + size, length)) for path, length in files_of(self.options["path"]) for a in range(0, length, size)]

    def rows(self, part: ByteRange) -> Iterator[dict]:
        for line in lines_of(part):
            if line.strip():
                try:
                    yield outcome_of(line)
                except json.JSONDecodeError as e:
                    raise BatchError(f"{part.path} has a line that is no JSON") from e


class BatchSource(DataSource):
    """Outcomes of batch result files; options ``path`` and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "colophon_batch"

    def schema(self) -> str:
        return BATCH

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(schema, self.options)


# --- sheets -----------------------------------------------------------------------------------------------------


@dataclass
class Workbook(InputPartition):
    path: str


def sheet_rows(content, sheet: str) -> Iterator[tuple[int, dict[int, str]]] | None:
    """Number and cells (by column number) of each row of a sheet, row by row; None if there is no such sheet."""
    from .workbook import column_number

    z = zipfile.ZipFile(content)
    targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    member = {s.get("name"): targets[s.get(_REL + "id")] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet")}.get(sheet)
    if member is None:
        return None
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(_MAIN + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]

    def run():
        with z.open("xl/" + member) as f:
            parsed = ElementTree.iterparse(f, ("start", "end"))
            table = None
            for event, element in parsed:
                if event == "start":
                    table = element if element.tag == _MAIN + "sheetData" else table
                elif element.tag == _MAIN + "row":
                    cells, number = {}, None
                    for cell in element:
                        value = cell.find(_MAIN + "v")
                        if cell.get("t") == "inlineStr":
                            text = "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
                        elif value is None:
                            continue
                        else:
                            text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                        cells[column_number(cell.get("r"))] = text
                        number = int(re.search(r"\d+", cell.get("r"))[0])
                    if cells:
                        yield number, cells
                    table.clear()  # rows that are done don't stay in memory

    return run()


class SheetReader(_Reader):
    def partitions(self) -> list[Workbook]:
        return [Workbook(path) for path, _ in files_of(self.options["path"])]

    def rows(self, part: Workbook) -> Iterator[dict]:
        system, at = located(part.path)
        last = self.pushed.greatest("row_number")
        wanted = {*self.schema.fieldNames(), *(name for name, _, _ in self.pushed.tests)}
        with system.open_input_file(at) as f:
            heads: dict[int, str] = {}
            for number, cells in sheet_rows(f, self.options.get("sheet", "Analysis")) or ():
                if number == 1:
                    heads = {c: text for c, text in cells.items() if text in wanted}
                elif number > last:
                    return
                else:
                    yield {heads[c]: text for c, text in cells.items() if c in heads} | {"row_number": number}


class SheetSource(DataSource):
    """``row_number`` and a string column for each heading of row 1 of the first workbook; options ``path`` and ``sheet``.

    Workbooks without the sheet have no rows; where none has it, that is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "colophon_sheet"

    def schema(self) -> StructType:
        path, sheet = self.options["path"], self.options.get("sheet", "Analysis")
        for name, _ in files_of(path):
            system, at = located(name)
            with system.open_input_file(at) as f:
                try:
                    rows = sheet_rows(f, sheet)
                    heads = None if rows is None else next(rows, (1, {}))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    raise FormatError(f"{name} is no workbook: {e}") from e
            if heads and heads[0] == 1 and heads[1]:
                kind = StructType().add("row_number", IntegerType())
                for _, head in sorted(heads[1].items()):
                    kind.add(head, StringType())
                return kind
        raise FormatError(f"{path} has no sheet {sheet}")

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Both formats for this session, filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SheetSource)
    spark.dataSource.register(BatchSource)
