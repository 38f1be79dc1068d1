"""Workbooks and archives: files that Spark has no reader for.

An archive's directory is at its end and says where each member is, so that a member
is one partition that reads its own bytes as a stream; the others are never read. Rows
are parsed one by one. Paths are opened through Arrow's file systems (local, HDFS, S3,
GCS, Azure); a file in another store is sent to the executors by Spark."""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import chain, islice
from pathlib import PurePosixPath
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = (".csv", ".xls", ".xlsx", ".xlsm", ".json", ".parquet")
#: Rows of one Arrow batch.
ROWS = 5000
#: Bytes of a member that are decoded at once.
CHUNK = 1 << 20
SENT = "sent:"


# -- opening -------------------------------------------------------------------


def reachable(spark: SparkSession, path: str) -> str:
    """The path, or where the executors find a copy of it if Arrow has no file system for it."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        return path
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        spark.sparkContext.addFile(path)
        return SENT + PurePosixPath(path).name


def opened(path: str):
    """A seekable file; only what is asked for is read."""
    if path.startswith(SENT):
        return open(SparkFiles.get(path.removeprefix(SENT)), "rb")
    from pyarrow import fs

    path = re.sub(r"^file:/+", "file:///", path)
    store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store.open_input_file(name)


def members(path: str, suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """Supported files of an archive; hidden ones and system folders are skipped."""
    with opened(path) as file, zipfile.ZipFile(file) as z:
        found = [(x.filename, PurePosixPath(x.filename)) for x in z.infolist() if not x.is_dir()]
    return [n for n, p in found if p.suffix.lower() in suffixes and "__MACOSX" not in p.parts and not any(x.startswith(".") for x in p.parts)]


# -- workbooks -------------------------------------------------------------------

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: The same as the parser below writes it.
_NAME = _MAIN.removeprefix("{")
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats that the file format defines as dates or times (fixed values).
DATE_FORMATS = frozenset({14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47})
#: Days are counted from here, or from 1904-01-01 if the workbook says so.
EPOCH = datetime(1899, 12, 30)


def _first_sheet(z: zipfile.ZipFile) -> tuple[str, bool]:
    """Its part's name, by the workbook's order, and whether days count from 1904."""
    names = z.namelist()
    if "xl/workbook.xml" not in names:
        return min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), False
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    properties = book.find(f"{_MAIN}workbookPr")
    wanted = book.find(f"{_MAIN}sheets/{_MAIN}sheet").get(f"{_REL}id")
    links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links if x.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", properties is not None and properties.get("date1904") in ("1", "true")


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format is a date or a time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    styles = ElementTree.fromstring(z.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for f in styles.iter(f"{_MAIN}numFmt"):
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", ""))
        if re.search("[dmyhs]", bare, re.IGNORECASE) and not re.search("general", bare, re.IGNORECASE):
            dates.add(int(f.get("numFmtId")))
    cells = styles.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate([] if cells is None else cells) if int(x.get("numFmtId", 0)) in dates}


def _shared(z: zipfile.ZipFile) -> list[str]:
    """Texts that cells name by number; phonetic hints are no text."""
    out: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{_MAIN}rPh":
                    e.clear()
                if e.tag == f"{_MAIN}si":
                    out.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
                    e.clear()
    return out


def sheet_rows(file) -> Iterator[list[tuple[str | None, str]]]:
    """Rows of a workbook's first sheet, one at a time: each cell's text and kind (n number, d date, b truth, s text, or
    blank for an empty cell)."""
    with zipfile.ZipFile(file) as z:
        sheet, late = _first_sheet(z)
        shared, dates = _shared(z), _date_styles(z)
        epoch = datetime(1904, 1, 1) if late else EPOCH
        with z.open(sheet) as f:
            for cells in _raw_rows(f):
                yield [_cell(*c, shared, dates, epoch) if c is not None else (None, "") for c in _placed(cells)]


#: A cell's attributes, its value, and its text in place.
Raw = tuple[dict[str, str], str | None, str]


def _raw_rows(file) -> Iterator[list[Raw]]:
    """Cells of each row of a sheet. Callbacks of the parser, as a tree of each cell would take most of the time."""
    done: list[list[Raw]] = []
    row: list[Raw] | None = None
    attributes: dict[str, str] | None = None
    texts: dict[str, list[str]] = {}
    into: list[str] | None = None

    def start(tag: str, found: dict[str, str]) -> None:
        nonlocal row, attributes, into
        if tag == f"{_NAME}row":
            row = []
        elif row is not None and tag == f"{_NAME}c":
            attributes, texts["v"], texts["t"] = found, [], []
            texts.pop("value", None)
        elif attributes is not None and tag in (f"{_NAME}v", f"{_NAME}t"):
            into = texts[tag[-1]]

    def end(tag: str) -> None:
        nonlocal row, attributes, into
        if tag == f"{_NAME}row":
            done.append(row or [])
            row = None
        elif attributes is not None and tag == f"{_NAME}c":
            row.append((attributes, "".join(texts["value"]) if "value" in texts else None, "".join(texts["t"])))
            attributes = None
        elif into is not None and tag in (f"{_NAME}v", f"{_NAME}t"):
            if tag[-1] == "v":
                texts.setdefault("value", into)
            into = None

    def data(text: str) -> None:
        if into is not None:
            into.append(text)

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    while part := file.read(CHUNK):
        parser.Parse(part)
        yield from done
        done.clear()
    parser.Parse(b"", True)


def _placed(cells: list[Raw]) -> list[Raw | None]:
    """Cells by column; left out ones are None."""
    out: list[Raw | None] = []
    for c in cells:
        at = 0
        for ch in c[0].get("r", ""):
            if not "A" <= ch <= "Z":
                break
            at = at * 26 + ord(ch) - 64
        out += [None] * (at - 1 - len(out))
        out.append(c)
    return out


def _cell(found: dict[str, str], value: str | None, text: str, shared: list[str], dates: set[int], epoch: datetime) -> tuple[str | None, str]:
    kind = found.get("t", "n")
    if kind == "inlineStr":
        return text, "s"
    if value is None or kind == "e":
        return None, ""
    if kind == "s":
        return shared[int(value)], "s"
    if kind == "b":
        return ("true" if value == "1" else "false"), "b"
    if kind == "d":
        return value, "d"
    if kind == "n" and int(found.get("s", 0)) in dates:
        return (epoch + timedelta(milliseconds=round(float(value) * 86_400_000))).isoformat(" "), "d"
    return value, "n" if kind == "n" else "s"


def headed(row: list[tuple[str | None, str]]) -> list[str]:
    return [v if v not in (None, "") else f"col_{i}" for i, (v, _) in enumerate(row)]


# -- records ---------------------------------------------------------------------


def member_encoding(file) -> str:
    """The first encoding that decodes a member to its end, read as a stream."""
    from tablesmith.sources.files import ENCODINGS

    live = {n: codecs.getincrementaldecoder(n)() for n in ENCODINGS}
    while part := file.read(CHUNK):
        live = {n: d for n, d in live.items() if _takes(d, part)}
    live = {n: d for n, d in live.items() if _takes(d, b"", True)}
    return "utf-8-sig" if "utf-8" in live else next(n for n in ENCODINGS if n in live)


def _takes(decoder, part: bytes, final: bool = False) -> bool:
    try:
        decoder.decode(part, final)
    except UnicodeDecodeError:
        return False
    return True


def csv_rows(file, encoding: str) -> Iterator[str]:
    """Rows of a CSV member, header first, as records with commas; blank rows go."""
    from tablesmith.sources.files import sniff_separator

    text = io.TextIOWrapper(file, encoding=encoding, newline="")
    first = text.readline()
    separator = sniff_separator(first)
    csv.field_size_limit(1 << 30)
    out = io.StringIO()
    write = csv.writer(out, lineterminator="")
    rest = iter(lambda: text.readline(), "")
    for row in csv.reader(chain([first] * bool(first), rest), delimiter=separator):
        if any(row):
            out.seek(0)
            out.truncate()
            write.writerow(row)
            yield out.getvalue()


def json_rows(file, encoding: str) -> tuple[list[str], bool]:
    """Rows of a JSON member, and whether they came from an object with one list."""
    found, wrapped = json.load(io.TextIOWrapper(file, encoding=encoding)), False
    if isinstance(found, dict) and len(found) == 1 and isinstance(one := next(iter(found.values())), list) and all(isinstance(x, dict) for x in one):
        found, wrapped = one, True
    rows = found if isinstance(found, list) else [found]
    if not all(isinstance(x, dict) for x in rows):
        raise ValueError("no objects")
    return [json.dumps(x, ensure_ascii=False) for x in rows], wrapped


class _Member(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


_CELLS = pa.schema([("member", pa.string()), ("number", pa.int64()), ("record", pa.string()), ("names", pa.list_(pa.string())), ("kinds", pa.list_(pa.string())), ("cells", pa.list_(pa.string())), ("wrapped", pa.bool_()), ("error", pa.string())])


class ZipSource(DataSource):
    """spark.read.format("zip_members"), options path, and member for a Parquet one, which keeps its own types. Without
    member: the rows of all others as records (CSV, JSON) or cells (workbooks), one partition a member."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self):
        if "member" not in self.options:
            return "member string, number long, record string, names array<string>, kinds array<string>, cells array<string>, wrapped boolean, error string"
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        with opened(self.options["path"]) as file, zipfile.ZipFile(file) as z, z.open(self.options["member"]) as f:
            return from_arrow_schema(pq.read_schema(f))

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(dict(self.options), schema)


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.path, self.member, self.kinds = options["path"], options.get("member"), schema

    def partitions(self) -> list[InputPartition]:
        names = [self.member] if self.member else [n for n in members(self.path) if not n.lower().endswith(".parquet")]
        return [_Member(self.path, n) for n in names] or [_Member(self.path, "")]

    def read(self, partition):
        if not partition.name:
            return
        with opened(partition.path) as file, zipfile.ZipFile(file) as z:
            yield from self._typed(z, partition.name) if self.member else self._untyped(z, partition.name)

    def _typed(self, z: zipfile.ZipFile, name: str) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.kinds)
        with z.open(name) as f:
            # a stored member is read where it is; a compressed one can't be read backwards
            source = f if z.getinfo(name).compress_type == zipfile.ZIP_STORED else io.BytesIO(f.read())
            for batch in pq.ParquetFile(source).iter_batches(ROWS):
                yield batch.cast(kinds)

    def _untyped(self, z: zipfile.ZipFile, name: str) -> Iterator[pa.RecordBatch]:
        """Rows with their numbers from 0; one row with an error if the member can't be read to its end."""
        number, suffix = 0, PurePosixPath(name).suffix.lower()
        try:
            encoding = ""
            if suffix in (".csv", ".json"):
                with z.open(name) as f:
                    encoding = member_encoding(f)
            with z.open(name) as f:
                if suffix == ".csv":
                    for texts in _batches(csv_rows(f, encoding)):
                        yield self._batch(name, number, record=texts)
                        number += len(texts)
                elif suffix == ".json":
                    texts, wrapped = json_rows(f, encoding)
                    for part in _batches(iter(texts)):
                        yield self._batch(name, number, record=part, wrapped=wrapped)
                        number += len(part)
                elif suffix in (".xlsx", ".xlsm"):
                    for part in workbook_batches(io.BytesIO(f.read())):
                        n = len(part["cells"])
                        yield self._batch(name, number, **part)
                        number += n
                else:
                    raise ValueError("no reader")
        except Exception as e:
            yield self._batch(name, number, error=[f"{name}: {e}"])

    @staticmethod
    def _batch(name: str, number: int, wrapped: bool = False, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        every = {"member": [name] * n, "number": list(range(number, number + n)), "wrapped": [wrapped] * n} | columns
        return pa.RecordBatch.from_arrays([pa.array(every.get(f.name, [None] * n), f.type) for f in _CELLS], schema=_CELLS)


def _batches(rows: Iterator) -> Iterator[list]:
    while part := list(islice(rows, ROWS)):
        yield part


def workbook_batches(file) -> Iterator[dict[str, list]]:
    """Names, kinds and cells of the rows below the header; blank rows go."""
    rows = sheet_rows(file)
    first = next(rows, None)
    if first is None:
        return
    names = headed(first)
    blank = (None, "")
    # a header alone is a row without cells
    yield {"names": [names], "kinds": [None], "cells": [None]}
    for part in _batches(r for r in rows if any(v not in (None, "") for v, _ in r)):
        padded = [(r + [blank] * len(names))[: len(names)] for r in part]
        yield {"names": [names] * len(part), "kinds": [[k for _, k in r] for r in padded], "cells": [[v for v, _ in r] for r in padded]}
