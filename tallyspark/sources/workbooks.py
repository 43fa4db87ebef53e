"""Workbooks as a Python data source: written by the tasks themselves, read by tasks that share the files by their size.

`register(spark)`, then `df.write.format("workbook").save(path)` and `spark.read.format("workbook").load(path)`. A write makes a folder
of workbooks, as Spark's own file formats do: each task streams its rows into files of at most `rows_per_file` rows (a sheet holds no
more than 1,048,576), which take their names only at the commit, so that lost and repeated tasks leave nothing behind. Nothing of the
rows passes through the driver, and a task holds one row at a time. Options: `path`, `rows_per_file`, `split_bytes` (reading).

Texts that a spreadsheet would take for a formula are guarded with an apostrophe, which reading takes off again; decimals and whole
numbers are number cells with all their digits; null is no cell and "" an empty text. Characters that XML can't hold are written as
_xHHHH_, as the format says. An existing path is an error unless the mode is append or overwrite. Reading gives text columns named by
the first file's header (or the schema's own types, cast where they can be read, else null).
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

#: Rows that one sheet can hold, its header among them (fixed value).
SHEET_ROWS = 1_048_576
SPLIT_BYTES = 64 << 20
_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: The parts of a workbook of one sheet beside the sheet (fixed format).
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_NS}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_FORMULA = re.compile(r"[=+\-@\t\r]")
_UNSAFE = re.compile(r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f\ud800-\udfff￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _files(path: str):
    """The file system of a path (file, hdfs, s3 and what else pyarrow knows) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", path) if path.startswith("file:") else "file://" + path)


def _cell(value, at: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, Decimal)):
        return f'<c r="{at}"><v>{value if isinstance(value, int) else format(value, "f")}</v></c>'
    if isinstance(value, float) and value == value and abs(value) != float("inf"):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    text = str(value)
    text = "'" + text if text.startswith("'") or _FORMULA.match(text) else text
    coded = escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{coded}</t></is></c>'


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


class _Sheet:
    """One workbook being written, row by row."""

    def __init__(self, sink, names: list[str]):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
        for name, text in _PARTS.items():
            self.zip.writestr(name, _HEAD + text)
        self.part = io.BufferedWriter(self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True), 1 << 16)
        self.part.write(f'{_HEAD}<worksheet xmlns="{_NS}"><sheetData>'.encode())
        self.letters, self.rows = [_letters(k) for k in range(len(names))], 0
        self.add(names)

    def add(self, row) -> None:
        self.rows += 1
        self.part.write(f'<row r="{self.rows}">{"".join(_cell(v, f"{a}{self.rows}") for a, v in zip(self.letters, row, strict=True))}</row>'.encode())

    def close(self) -> None:
        self.part.write(b"</sheetData></worksheet>")
        self.part.close()
        self.zip.close()


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], schema.fieldNames(), overwrite
        self.most = int(options.get("rows_per_file", SHEET_ROWS - 1))
        if not 0 < self.most < SHEET_ROWS:
            raise ValueError(f"a sheet holds 1 to {SHEET_ROWS - 1} rows below its header")
        self.run = uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        files, root = _files(self.path)
        task = TaskContext.get()
        waiting = f"{root}/_temporary-{self.run}"
        files.create_dir(waiting, recursive=True)
        done, sheet, sink = [], None, None
        for row in rows:
            if sheet is None:
                name = f"part-{task.partitionId():05d}-{len(done):04d}-{self.run}.xlsx"
                done.append((f"{waiting}/{task.taskAttemptId()}-{name}", f"{root}/{name}"))
                sink = files.open_output_stream(done[-1][0])
                sheet = _Sheet(sink, self.names)
            sheet.add(row)
            if sheet.rows > self.most:
                sheet.close(), sink.close()
                sheet = None
        if sheet is not None:
            sheet.close(), sink.close()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow.fs import FileSelector

        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for old in files.get_file_info(FileSelector(root)):
                if old.base_name.endswith(".xlsx"):
                    files.delete_file(old.path)
        for message in messages:
            for waiting, final in message.files if message else ():
                files.move(waiting, final)
        self._clear(files, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_files(self.path))

    def _clear(self, files, root: str) -> None:
        from pyarrow.fs import FileType

        waiting = f"{root}/_temporary-{self.run}"
        if files.get_file_info(waiting).type == FileType.Directory:
            files.delete_dir(waiting)


def sheet_rows(source) -> Iterator[list[str | None]]:
    """The first sheet's rows as texts, one at a time; a cell that is left out is null."""
    tag = lambda e: e.tag.rpartition("}")[2]
    decoded = lambda text: _CODED.sub(lambda m: chr(int(m[1], 16)), text)
    with zipfile.ZipFile(source) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                shared = [decoded("".join(t.text or "" for t in e.iter() if tag(t) == "t")) for _, e in ElementTree.iterparse(_plain(part)) if tag(e) == "si"]
        first = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        with z.open(first) as part:
            parsed = ElementTree.iterparse(_plain(part), events=("start", "end"))
            sheet = None
            for event, e in parsed:
                if event == "start":
                    sheet = e if tag(e) == "sheetData" else sheet
                elif tag(e) == "row":
                    cells: list[str | None] = []
                    for c in (x for x in e if tag(x) == "c"):
                        at = _column(c.get("r", "")) if c.get("r") else len(cells)
                        kind, value = c.get("t"), next((v.text for v in c if tag(v) == "v"), None)
                        if kind == "s" and value is not None:
                            value = shared[int(value)]
                        elif kind == "inlineStr":
                            value = decoded("".join(t.text or "" for t in c.iter() if tag(t) == "t"))
                        if kind in ("s", "inlineStr") and value is not None and re.match(r"'['=+\-@\t\r]", value):
                            value = value[1:]
                        cells += [None] * (at - len(cells)) + [value]
                    yield cells
                    if sheet is not None:
                        sheet.clear()


class _plain:  # noqa: N801
    """A part's bytes, refused at a document type declaration, wherever it stands."""

    def __init__(self, part):
        self.part, self.tail = part, b""

    def read(self, n: int = -1) -> bytes:
        data = self.part.read(n)
        seen = self.tail + data
        if b"<!DOCTYPE" in seen or b"<!ENTITY" in seen:
            raise ValueError("document type declarations are refused")
        self.tail = seen[-9:]
        return data


@dataclass
class _Share(InputPartition):
    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.schema, self.split = options["path"], schema, int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[_Share]:
        """Files put together up to `split_bytes`; only names and sizes are looked at here."""
        shares, held = [], 0
        for name, size in _workbooks(self.path):
            if not shares or held + size > self.split:
                shares.append(_Share([]))
                held = 0
            shares[-1].files.append(name)
            held += size
        return shares or [_Share([])]

    def read(self, share: _Share) -> Iterator[tuple]:
        files, _ = _files(self.path)
        casts = [_cast(f.dataType.typeName(), f.dataType) for f in self.schema.fields]
        for name in share.files:
            with files.open_input_file(name) as source:
                rows = sheet_rows(source)
                names = next(rows, [])
                at = [names.index(f) if f in names else None for f in self.schema.fieldNames()]
                for row in rows:
                    yield tuple(None if k is None or k >= len(row) or row[k] is None else cast(row[k]) for k, cast in zip(at, casts, strict=True))


def _cast(name: str, kind):
    """From a cell's text to a column's value; what can't be read is null."""
    from datetime import date, datetime

    exact = lambda x: int(x) if re.fullmatch(r"[+-]?\d+", x) else int(Decimal(x))
    to = {"long": exact, "integer": exact, "short": exact, "byte": exact, "double": float, "float": float, "boolean": lambda x: {"1": True, "0": False, "true": True, "false": False}[x.lower()], "date": date.fromisoformat, "timestamp": datetime.fromisoformat}.get(name, str)
    if name == "decimal":
        step = Decimal(1).scaleb(-kind.scale)
        to = lambda x: Decimal(x).quantize(step)

    def one(x):
        try:
            return to(x)
        except (ValueError, ArithmeticError, KeyError):
            return None

    return one


def _workbooks(path: str) -> list[tuple[str, int]]:
    from pyarrow.fs import FileSelector, FileType

    files, root = _files(path)
    here = files.get_file_info(root)
    if here.type == FileType.NotFound:
        raise FileNotFoundError(path)
    found = [here] if here.type == FileType.File else files.get_file_info(FileSelector(root))
    return sorted((f.path, f.size) for f in found if f.type == FileType.File and f.base_name.endswith(".xlsx") and not f.base_name.startswith(("_", ".", "~")))


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        """Text columns by the header of the first file."""
        for name, _ in _workbooks(self.options["path"])[:1]:
            with _files(self.options["path"])[0].open_input_file(name) as source:
                names = next(sheet_rows(source), [])
            return StructType([StructField(n or f"column {k}", StringType()) for k, n in enumerate(names)])
        raise ValueError("there is no workbook to take the columns from: give a schema")

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbooks)


def write(df, path: str, mode: str = "append", rows_per_file: int = SHEET_ROWS - 1) -> None:
    """df as a folder of workbooks; days and times are texts."""
    from pyspark.sql import functions as F

    register(df.sparkSession)
    simple = ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    shown = df.select(*[F.col(f"`{n}`") if kind in simple or kind.startswith("decimal") else F.col(f"`{n}`").cast("string").alias(n) for n, kind in df.dtypes])
    shown.write.format("workbook").mode(mode).option("rows_per_file", rows_per_file).save(path)


def read(spark: SparkSession, path: str, schema: str | StructType | None = None):
    register(spark)
    reader = spark.read.format("workbook")
    return (reader.schema(schema) if schema is not None else reader).load(path)
