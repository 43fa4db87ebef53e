"""Tables in files: CSV of unknown encoding and separator, XLSX and SpreadsheetML workbooks, split into blocks and ledgers.

Files are read whole by one task each (`binaryFile`), within limits on rows and cells that refuse a file rather than cut it.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROWS, MAX_CELLS, MAX_BYTES = 200_000, 2_000_000, 256 << 20
#: Rows that a file of ours has at most, so that its readers take it.
FILE_ROWS = 50_000
ROWS = "path string, sheet string, row_no int, cells array<string>, problem string"


class TooLarge(ValueError):
    pass


def csv_rows(data: bytes) -> Iterator[tuple[str, list[str]]]:
    """UTF-8 (with or without mark), else the Central European code page, else the file is refused; the separator that the first line
    has more of, a comma if it has as many."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp1250")
    head = text.split("\n", 1)[0]
    yield from (("", row) for row in csv.reader(io.StringIO(text), delimiter=";" if head.count(";") > head.count(",") else ","))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _safe_xml(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ValueError("document type declarations are refused")
    return ElementTree.fromstring(data)


#: Number formats that are built in and show a day (fixed values).
_DAY_FORMATS = {14, 15, 16, 17, 22, 27, 28, 29, 30, 31, 36, 50, 51, 52, 53, 54, 55, 56, 57, 58}


def _day_styles(xml: bytes) -> set[int]:
    """The cell styles of a workbook whose number format shows a day."""
    tag = lambda e: e.tag.rpartition("}")[2]
    root, custom, out = _safe_xml(xml), {}, set()
    for e in root.iter():
        if tag(e) == "numFmt":
            bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", e.get("formatCode", "")).lower()
            custom[int(e.get("numFmtId", "0"))] = "y" in bare or "d" in bare
    for styles in (e for e in root.iter() if tag(e) == "cellXfs"):
        for n, e in enumerate(x for x in styles if tag(x) == "xf"):
            number = int(e.get("numFmtId", "0"))
            if custom.get(number, number in _DAY_FORMATS):
                out.add(n)
    return out


def _shown_day(value: str) -> str:
    """A workbook's day number as an ISO day, with the time if there is any; what is no such number stays."""
    try:
        days = float(value)
        moment = datetime(1899, 12, 30) + timedelta(days=int(days), seconds=round(days % 1 * 86400))
    except (ValueError, OverflowError):
        return value
    return moment.date().isoformat() if days == int(days) else moment.isoformat(sep=" ")


def xlsx_rows(data: bytes) -> Iterator[tuple[str, list[str]]]:
    """Rows of all sheets as text. Formulas give their stored value; numbers whose format shows a day give the day."""
    tag = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MAX_BYTES:
            raise TooLarge("the workbook unpacks to too many bytes")
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in _safe_xml(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        days = _day_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0])):
            for row in (e for e in _safe_xml(z.read(name)).iter() if tag(e) == "row"):
                cells: list[str] = []
                for c in (e for e in row if tag(e) == "c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    kind, value = c.get("t"), next((v.text for v in c if tag(v) == "v"), None)
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if tag(t) == "t")
                    elif kind in (None, "n") and value is not None and int(c.get("s", "0")) in days:
                        value = _shown_day(value)
                    elif kind == "d" and value is not None:
                        value = value[:10] if value[10:] in ("", "T00:00:00", "T00:00:00Z") else value.replace("T", " ")
                    cells += [""] * (at - len(cells)) + [value or ""]
                yield name.rpartition("/")[2], cells


def spreadsheetml_rows(data: bytes) -> Iterator[tuple[str, list[str]]]:
    """Rows of a 2003 XML workbook; an index attribute leaves cells out."""
    tag, attr = (lambda e: e.tag.rpartition("}")[2]), (lambda e, n: next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == n), None))
    for sheet in (e for e in _safe_xml(data).iter() if tag(e) == "Worksheet"):
        for row in (e for e in sheet.iter() if tag(e) == "Row"):
            cells: list[str] = []
            for c in (e for e in row if tag(e) == "Cell"):
                if index := attr(c, "Index"):
                    cells += [""] * (int(index) - 1 - len(cells))
                texts = [("".join(d.itertext()), attr(d, "Type")) for d in c if tag(d) == "Data"]
                cells.append("".join(t[:10] if kind == "DateTime" and re.fullmatch(r"\d{4}-\d\d-\d\d(T00:00:00(\.0*)?)?", t) else t for t, kind in texts))
            yield attr(sheet, "Name") or "", cells


def reader_of(path: str, data: bytes):
    """What reads a file, by its content first."""
    if data[:2] == b"PK":
        return xlsx_rows
    if b"urn:schemas-microsoft-com:office:spreadsheet" in data[:4096]:
        return spreadsheetml_rows
    return csv_rows


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_no, cells, problem) of every table file under path; a file that is refused is one row with its problem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                out, cells, numbers = [], 0, {}
                try:
                    for sheet, row in reader_of(name, data)(data):
                        numbers[sheet] = numbers.get(sheet, -1) + 1
                        cells += len(row)
                        if len(out) >= MAX_ROWS or cells > MAX_CELLS:
                            raise TooLarge("too many rows or cells")
                        out.append((name, sheet, numbers[sheet], row, None))
                except Exception as problem:  # noqa: BLE001 - a file's own fault is data
                    out = [(name, None, None, None, f"{type(problem).__name__}: {problem}"[:200])]
                yield pd.DataFrame(out, columns=["path", "sheet", "row_no", "cells", "problem"])

    return files.mapInPandas(run, ROWS)


def accepted(rows: DataFrame) -> DataFrame:
    """rows (of read_tables), all files of which must have been read: one that was refused is an error, not a gap."""
    refused = F.raise_error(F.concat_ws(": ", "path", "problem")).cast("boolean")
    return rows.where(F.when(F.col("problem").isNotNull(), refused).otherwise(F.lit(True)))


def rejoined(rows: DataFrame) -> DataFrame:
    """Rows of a CSV that was opened as a workbook (one cell holds a whole line) taken apart again."""
    whole = F.array_join("cells", "")
    broken = (F.size(F.filter("cells", lambda c: c != "")) == 1) & (F.length(F.regexp_replace(whole, "[^;]", "")) >= 2)
    return rows.withColumn("cells", F.when(broken, F.split(whole, ";")).otherwise(F.col("cells")))


#: What bytes 80 to 9F are in the Western code page, where it has them.
_WESTERN = {c: chr(n) for n in range(0x80, 0xA0) for c in [bytes([n]).decode("cp1252", "ignore")] if c}


def unmangled(text):
    """UTF-8 that was read as a Western code page, read right; other text as it is."""
    raw = F.translate(text, "".join(_WESTERN), "".join(_WESTERN.values()))
    looks = raw.rlike("[\u00c2-\u00f4][\u0080-\u00bf]") & ~raw.rlike("[^\u0000-\u00ff]")
    return F.when(looks, F.decode(F.encode(raw, "iso-8859-1"), "utf-8")).otherwise(text)


def blocks(rows: DataFrame, header: list[str]) -> DataFrame:
    """rows with block (from 1 at each header row of a sheet, 0 before the first) and is_header. header: the cells that make one."""
    is_header = F.size(F.array_intersect(F.transform("cells", lambda c: F.lower(F.trim(c))), F.array(*[F.lit(h.lower()) for h in header]))) == len(header)
    order = Window.partitionBy("path", "sheet").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("is_header", is_header).withColumn("block", F.sum(F.col("is_header").cast("int")).over(order))


def records(blocked: DataFrame) -> DataFrame:
    """(path, sheet, block, row_no, fields): each row of a block as a map from its header's cells."""
    heads = blocked.where("is_header").select("path", "sheet", "block", F.transform("cells", lambda c: F.lower(F.trim(c))).alias("names"))
    rows = blocked.where("not is_header and block > 0").join(heads, ["path", "sheet", "block"])
    n = F.least(F.size("names"), F.size("cells"))
    return rows.select("path", "sheet", "block", "row_no", F.map_filter(F.map_from_arrays(F.transform(F.slice("names", F.lit(1), n), lambda x, i: F.when(x == "", F.concat(F.lit("column "), i.cast("string"))).otherwise(x)), F.slice("cells", F.lit(1), n)), lambda k, v: v != "").alias("fields"))


def ledgers(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each statement of an export that mixes them, with its lines in order."""
    rest = [c for c in lines.columns if c not in keys]
    return lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("lines"))


def merge_companion(lines: DataFrame, printed: DataFrame, keys: list[str], order: str, printed_order: str) -> DataFrame:
    """Each export line with the first unused printed line of the same keys (day and amount)."""
    from ..operators.relations import nth_join

    return nth_join(lines, printed, keys, [F.col(order)], [F.col(printed_order)], "left")


def write_csv(df: DataFrame, path: str, decimal_comma: bool = True) -> None:
    """Semicolons, CR LF, a UTF-8 mark in front of the header, decimal commas; text cells guarded against formulas. As many files as their
    readers' limits ask for, each with the header."""
    from ..functions.text import guarded

    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("decimal") or kind in ("double", "float"):
            out.append((F.replace(c.cast("string"), F.lit("."), F.lit(",")) if decimal_comma else c.cast("string")).alias(name))
        else:
            out.append((guarded(c) if kind == "string" else c.cast("string")).alias(name))
    named = df.select(*out)
    first = named.columns[0]
    most = max(1, min(FILE_ROWS, MAX_ROWS - 1, MAX_CELLS // len(out) - 1))
    named.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("maxRecordsPerFile", most).option("sep", ";").option("header", "true").option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def xlsx_bytes(names: list[str], rows: Iterator[list]) -> bytes:
    """A small workbook of one sheet with inline text and numbers; for pages and reports, not for tables of any size."""
    from xml.sax.saxutils import escape

    def cell(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
        return f"<c><v>{v}</v></c>"

    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [names, *rows])
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()
