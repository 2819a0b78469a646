"""Raw files as rows: the cells of each data row by header, with its file and number.

Files of all headers, formats and encodings are read by one plan.  A large CSV file is cut
into pieces at line ends.  Whether a piece begins inside a quoted value depends on all before
it, so a first pass parses each piece both ways and tells, for either, how many rows begin in
it and whether it ends inside quotes.  From these, windows over a file's pieces tell each
piece's beginning and the number of its first row; then all pieces are read independently.
The line end, comma and quote of ASCII are no part of a longer character in any of the
encodings, so that bytes may be cut and counted before the encoding is known; it is the first
that reads all pieces of the file.

A workbook is one piece: a zip file whose shared strings are read once, and whose largest
sheet is streamed row by row.  Tasks read ranges of files, so a lost executor costs its pieces
only.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "latin1")
PIECE = 32 << 20
_CHUNK = 1 << 20
_BATCH = 4096
#: Put behind a piece's text: a row of its own if the piece ends outside of quotes.
_END = "\x1eend of piece\x1e"


# ------------------------------------------------------------------- files


def opened(path: str) -> pa.NativeFile:
    """A file to be read at any place: a local or mounted path, or a URI that Arrow's file systems know."""
    if "://" in path and not path.startswith("file:"):
        system, inner = pafs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return pa.OSFile(re.sub("^file:(//)?", "", path), "rb")


def fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, sha256, size`` of files, digested piece by piece: a file is never held, and may be of any size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                digest, size = hashlib.sha256(), 0
                with opened(path) as f:
                    while data := f.read(_CHUNK):
                        digest.update(data)
                        size += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()]), pa.array([size], pa.int64())], names=["path", "sha256", "size"])

    return _one_a_task(spark, [(p,) for p in paths], "path string").mapInArrow(run, "path string, sha256 string, size long")


def _one_a_task(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows dealt to tasks, a few each at most."""
    tasks = max(1, min(len(rows), 64 * spark.sparkContext.defaultParallelism))
    numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, n long")
    return numbered.repartitionByRange(tasks, "n").drop("n") if rows else numbered.drop("n")


# ----------------------------------------------------------------- headers


def normal_header(name: object) -> str:
    text = "" if name is None else str(name).strip()
    for wide, narrow in (("（", "("), ("）", ")"), ("：", ":")):
        text = text.replace(wide, narrow)
    return re.sub(r"\s+", "", text).lower().removeprefix("\ufeff") or "column"


def normal_headers(names: Iterable[object]) -> list[str]:
    """Headers trimmed, narrowed and in lower case; repeated ones numbered from .1 on."""
    out: list[str] = []
    counts: dict[str, int] = {}
    for name in map(normal_header, names):
        n = counts.get(name, 0)
        counts[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


# --------------------------------------------------------------------- CSV


def _reads(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def encoding_of(data: bytes) -> str:
    """The first of the encodings that reads the bytes."""
    return next(e for e in ("utf-8", *ENCODINGS[2:]) if _reads(data, e))


def counted(text: str, inside: bool) -> tuple[int, bool]:
    """How many rows begin in a text that begins at a line's beginning, inside of quotes or not, and whether it ends inside."""
    last: list[str] = []
    n = 0
    for row in csv.reader(io.StringIO(('"' if inside else "") + text + _END + "\n", newline="")):
        n += bool(row)
        last = row
    outside = last == [_END]
    return n - outside - inside, not outside


def lines(f: BinaryIO, begin: int) -> Iterator[bytes]:
    """Lines of a file from a place on, with their ends."""
    f.seek(begin)
    rest = b""
    while chunk := f.read(_CHUNK):
        parts = (rest + chunk).splitlines(keepends=True)
        rest = b"" if parts[-1].endswith(b"\n") else parts.pop()  # what ends with a carriage return may go on
        yield from parts
    yield from rest.splitlines(keepends=True)


def records(f: BinaryIO, begin: int, end: int, inside: bool, encoding: str) -> Iterator[list[str]]:
    """The rows that begin in a range of a file; the last is read to its end, wherever that is."""
    csv.field_size_limit((1 << 31) - 1)
    read = begin

    def feed() -> Iterator[str]:
        nonlocal read
        quote = '"' if inside else ""
        for line in lines(f, begin):
            read += len(line)
            text = line.decode(encoding)
            yield quote + (text.removeprefix("\ufeff") if read == len(line) else text)
            quote = ""

    rows = csv.reader(feed())
    if inside:
        next(rows, None)  # began in an earlier range
    while read < end:
        row = next(rows, None)
        if row is None:
            return
        if row:
            yield row


def _next_line(f: BinaryIO, at: int, end: int) -> int:
    """Where the first line after a place begins; -1 if none does before ``end``."""
    f.seek(at)
    while at < end:
        chunk = f.read(min(_CHUNK, end - at))
        if not chunk:
            return -1
        place = chunk.find(b"\n")
        if place >= 0:
            return at + place + 1
        at += len(chunk)
    return -1


def _piece(f: BinaryIO, size: int, number: int, step: int) -> tuple[int, int]:
    """The range of the lines that begin in a piece."""
    first, last = number * step, min(size, (number + 1) * step)
    begin = 0 if not number else _next_line(f, first - 1, last)
    if begin < 0 or begin >= last and number:
        return first, first
    end = size if last >= size else _next_line(f, last - 1, size)
    return begin, size if end < 0 else end


_SURVEY = "kind string, path string, piece long, begin long, end long, rows_out long, rows_in long, ends_in_out boolean, ends_in_in boolean, utf8 boolean, gbk boolean, sheet string, error string"


def _surveyed(path: str, piece: int, size: int, step: int) -> tuple:
    with opened(path) as f:
        begin, end = _piece(f, size, piece, step)
        f.seek(begin)
        data = f.read(end - begin)
    text = data.decode("latin1")  # a character a byte: only signs of ASCII are looked at
    csv.field_size_limit((1 << 31) - 1)
    plain = counted(text, False)
    quoted = counted(text, True) if b'"' in data else (0, True)
    utf8 = _reads(data, "utf-8")
    gbk = data.isascii() or _reads(data, "gbk")
    error = "the file has no header" if not piece and not plain[0] else None
    return begin, end, plain[0], quoted[0], plain[1], quoted[1], utf8, gbk, None, error


def survey(spark: SparkSession, files: list[tuple[str, str, int]], step: int = PIECE) -> DataFrame:
    """The pieces of files (kind, path, size), as :func:`rows` reads them: ``kind, path, piece, begin, end, inside, before, encoding, sheet, error``.

    ``before`` is the number of rows before the piece.  A file that cannot be read has its ``error``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    if is_workbook(r["path"]):
                        with opened(r["path"]) as f:
                            out = (0, 0, 0, 0, False, False, True, True, Workbook(f).largest(), None)
                    else:
                        out = _surveyed(r["path"], r["piece"], r["size"], step)
                except Exception as e:  # noqa: BLE001  one bad file is told and the others go on
                    out = (0, 0, 0, 0, False, False, True, True, None, f"{type(e).__name__}: {e}"[:500])
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (r["kind"], r["path"], r["piece"], *out), strict=True))], schema)

    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in _SURVEY.split(", "))])
    todo = [(k, p, n, i) for k, p, n in files for i in range(1 if is_workbook(p) else max(1, -(-n // step)))]
    found = _one_a_task(spark, todo, "kind string, path string, size long, piece long").mapInArrow(run, _SURVEY)
    # a piece maps what it begins in to what it ends in: to one of both, to the same, or to the other; the last piece
    # that maps to one of both decides, and those that change it since
    file = Window.partitionBy("path").orderBy("piece")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("ends_in_out") == F.col("ends_in_in")
    turns = F.sum((~fixed & F.col("ends_in_out")).cast("int"))
    turned = found.withColumn("turned", turns.over(file) % 2)
    told = turned.withColumn("told", F.when(fixed, (F.col("ends_in_out").cast("int") + F.col("turned")) % 2))
    started = told.withColumn("inside", (F.coalesce(F.last("told", ignorenulls=True).over(before), F.lit(0)) + F.coalesce(F.max("turned").over(file.rowsBetween(-1, -1)), F.lit(0))) % 2 == 1)
    whole = Window.partitionBy("path")
    encoding = F.when(F.min("utf8").over(whole), "utf-8").when(F.min("gbk").over(whole), "gbk").otherwise("latin1")
    own = F.when(F.col("inside"), F.col("rows_in")).otherwise(F.col("rows_out"))
    return started.withColumns({
        "before": F.coalesce(F.sum(own).over(before), F.lit(0)), "encoding": encoding, "error": F.first("error", ignorenulls=True).over(whole),
    }).select("kind", "path", "piece", "begin", "end", "inside", "before", "encoding", "sheet", "error")


# --------------------------------------------------------------- workbooks

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# fixed values: the built-in number formats that are dates or times
_DATE_FORMATS = frozenset((*range(14, 23), 45, 46, 47))


def is_workbook(path: str) -> bool:
    return path.lower().endswith((".xlsx", ".xls"))


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


class Workbook:
    """The sheets of a workbook file: a zip file of XML parts."""

    def __init__(self, f: BinaryIO):
        self.zip = zipfile.ZipFile(f)
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        parts = [targets[s.get(_REL)] for s in book.iter(f"{_MAIN}sheet")]
        self.sheets = [p.lstrip("/") if p.startswith("/") else f"xl/{p}" for p in parts]
        about = book.find(f"{_MAIN}workbookPr")
        later = about is not None and about.get("date1904") in ("1", "true")
        self.epoch = datetime(1904, 1, 1) if later else datetime(1899, 12, 30)

    def largest(self) -> str:
        """The sheet of most rows, then columns."""
        if not self.sheets:
            raise ValueError("the workbook has no sheet")

        def extent(part: str) -> tuple[int, int]:
            rows = columns = 0
            for number, cells in self.cells(part):
                rows, columns = max(rows, number), max(columns, 1 + max((c for c, _, _, _ in cells), default=-1))
            return rows, columns

        sizes = [extent(p) for p in self.sheets]  # also tells damaged parts before rows are read
        if not max(sizes)[0]:
            raise ValueError("the file has no header")
        return self.sheets[sizes.index(max(sizes))]

    def _part(self, name: str) -> bytes | None:
        return self.zip.read(name) if name in self.zip.namelist() else None

    def _shared(self) -> list[str]:
        out: list[str] = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            with self.zip.open("xl/sharedStrings.xml") as f:
                for _, e in ET.iterparse(f):
                    if e.tag == f"{_MAIN}si":
                        out.append(_text(e))
                        e.clear()
        return out

    def _dates(self) -> list[bool]:
        """Of each cell style, whether its numbers are dates or times."""
        data = self._part("xl/styles.xml")
        if data is None:
            return []
        styles = ET.fromstring(data)
        own = {f.get("numFmtId"): re.sub(r'"[^"]*"|\\.|\[[^\]hms]*\]', "", f.get("formatCode") or "") for f in styles.iter(f"{_MAIN}numFmt")}
        cells = styles.find(f"{_MAIN}cellXfs")
        ids = [x.get("numFmtId", "0") for x in cells] if cells is not None else []
        return [int(i) in _DATE_FORMATS or bool(re.search("[ymdhs]", own.get(i, ""), re.I)) for i in ids]

    def cells(self, part: str) -> Iterator[tuple[int, list[tuple[int, str, str, str]]]]:
        """Number and cells (column, kind, style, text) of each row of a sheet; only one row is held."""
        with self.zip.open(part) as f:
            number, data = 0, None
            for event, e in ET.iterparse(f, ("start", "end")):
                if e.tag == f"{_MAIN}sheetData" and event == "start":
                    data = e
                elif e.tag == f"{_MAIN}row" and event == "end":
                    number = int(e.get("r") or number + 1)
                    found, at = [], -1
                    for c in e.iter(f"{_MAIN}c"):
                        at = _column(c.get("r") or "") if c.get("r") else at + 1
                        kind, value = c.get("t", "n"), c.find(f"{_MAIN}v")
                        text = _text(c) if kind == "inlineStr" else value.text if value is not None and value.text else ""
                        if text:
                            found.append((at, kind, c.get("s", ""), text))
                    yield number, found
                    data.clear()

    def rows(self, part: str) -> Iterator[tuple[int, dict[int, str]]]:
        """Number and values by column of each row that has any; numbers and times as text."""
        shared, dates = self._shared(), self._dates()
        for number, cells in self.cells(part):
            out = {}
            for at, kind, style, text in cells:
                if kind == "s":
                    text = shared[int(text)]
                elif kind == "b":
                    text = "True" if text == "1" else "False"
                elif kind == "e":
                    text = ""  # an error is no value
                elif kind == "n":
                    text = self._number(text, style.isdigit() and int(style) < len(dates) and dates[int(style)])
                if text.strip():
                    out[at] = text
            if out:
                yield number, out

    def _number(self, text: str, is_date: bool) -> str:
        value = float(text)
        if not is_date:
            return text if re.fullmatch(r"-?\d+", text) else str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
        base = self.epoch + timedelta(days=1) if self.epoch.year == 1899 and 1 <= value < 60 else self.epoch  # a leap day that never was
        moment = base + timedelta(seconds=round(value * 86400))
        return moment.strftime("%H:%M:%S") if 0 <= value < 1 else moment.strftime("%Y-%m-%d %H:%M:%S")


def _text(e: ET.Element) -> str:
    """The text of a string's runs, without readings."""
    skip = {id(t) for r in e.iter(f"{_MAIN}rPh") for t in r.iter(f"{_MAIN}t")}
    return "".join(t.text or "" for t in e.iter(f"{_MAIN}t") if id(t) not in skip)


# -------------------------------------------------------------------- rows


def _csv_rows(path: str, piece: dict) -> Iterator[tuple[int, dict[str, str]]]:
    with opened(path) as f:
        header = normal_headers(next(records(f, 0, 1, False, piece["encoding"])))
    with opened(path) as f:
        for i, row in enumerate(records(f, piece["begin"], piece["end"], piece["inside"], piece["encoding"]), piece["before"] + 1):
            if i > 1:  # the first is the header
                yield i, {h: v for h, v in zip(header, row, strict=False) if v.strip()}


def _sheet_rows(path: str, sheet: str) -> Iterator[tuple[int, dict[str, str]]]:
    with opened(path) as f:
        rows = Workbook(f).rows(sheet)
        _, first = next(rows)
        header = normal_headers([first.get(i) for i in range(max(first) + 1)])
        for number, row in rows:
            yield number, {header[i]: v for i, v in row.items() if i < len(header)}


def headers(path: str, piece: Row) -> list[str]:
    """A file's normalised headers."""
    with opened(path) as f:
        if is_workbook(path):
            _, first = next(Workbook(f).rows(piece.sheet))
            return normal_headers([first.get(i) for i in range(max(first) + 1)])
        return normal_headers(next(records(f, 0, 1, False, piece.encoding)))


def rows(pieces: DataFrame) -> DataFrame:
    """``kind, path, source_row_number, cells`` of all rows of a survey's pieces, which should be a table by now; files with an error are left out.

    ``cells`` maps normalised headers to the texts that are not blank.  The header is row 1 and blank lines of a CSV
    file are no rows; rows of a sheet have the sheet's numbers.  Cells beyond the header are left out.
    """
    kinds = [pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())]
    names = ["kind", "path", "source_row_number", "cells"]

    def batch_of(piece: dict, held: list[tuple[int, dict[str, str]]]) -> pa.RecordBatch:
        columns = [[piece["kind"]] * len(held), [piece["path"]] * len(held), [n for n, _ in held], [list(c.items()) for _, c in held]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                held: list[tuple[int, dict[str, str]]] = []
                path = piece["path"]
                for row in _sheet_rows(path, piece["sheet"]) if is_workbook(path) else _csv_rows(path, piece):
                    held.append(row)
                    if len(held) == _BATCH:
                        yield batch_of(piece, held)
                        held = []
                if held:
                    yield batch_of(piece, held)

    todo = pieces.filter("error IS NULL").select("kind", "path", "piece", "begin", "end", "inside", "before", "encoding", "sheet")
    # a piece a task, or a few: they are as large as a task's share should be
    tasks = max(1, min(pieces.count(), 64 * pieces.sparkSession.sparkContext.defaultParallelism))
    return todo.repartitionByRange(tasks, "path", "piece").mapInArrow(run, "kind string, path string, source_row_number long, cells map<string,string>")
