"""Files that registered queries write from the given tables and read back: formats
that Spark has no writer for. Tables are folders with a file for each partition; a JSON
list, an archive and a database are one file, made by one task as a stream."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from datetime import date
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from tablesmith.session import package_on_workers

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def output(path: str):
    """A new file of a store that Arrow knows, with its folder."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0])
    return store.open_output_stream(name)


def _in_one_task(df: DataFrame, write) -> None:
    """Calls write(batches) where the rows are."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        write(batches)
        yield pa.RecordBatch.from_arrays([pa.array([True])], ["done"])

    package_on_workers(df.sparkSession)
    df.coalesce(1).mapInArrow(run, "done boolean").collect()


def _in_each_task(df: DataFrame, write) -> None:
    """Calls write(partition's number, batches) for each partition where its rows are; only the first may be without rows."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        from itertools import chain

        from pyspark import TaskContext

        number, first = TaskContext.get().partitionId(), next(batches, None)
        if first is not None or number == 0:
            write(number, chain([first] if first is not None else [], batches))
        yield pa.RecordBatch.from_arrays([pa.array([True])], ["done"])

    package_on_workers(df.sparkSession)
    df.mapInArrow(run, "done boolean").agg({"done": "count"}).collect()


def json_list(df: DataFrame, path: str) -> None:
    """One list of objects; df: a column of objects as text."""

    def write(batches: Iterator) -> None:
        with output(path) as f:
            f.write(b"[")
            first = True
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    f.write(("" if first else ",\n").encode() + text.encode())
                    first = False
            f.write(b"]\n")

    _in_one_task(df, write)


def csv_files(df: DataFrame, path: str, stem: str = "part") -> None:
    """A folder of <number>/<stem>.csv, one for each partition: a header and rows, quoted where they must be."""
    import csv
    import io

    names = df.columns

    def write(number: int, batches: Iterator) -> None:
        with output(f"{path}/{number:05d}/{stem}.csv") as f:
            text = io.TextIOWrapper(f, encoding="utf-8", newline="")
            rows = csv.writer(text)
            rows.writerow(names)
            for batch in batches:
                rows.writerows(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            text.flush()

    _in_each_task(df, write)


#: Rows of one workbook, about; a sheet has room for 1,048,576.
BOOK_ROWS = 25_000


def workbooks(df: DataFrame, path: str) -> None:
    """A folder of workbooks with about BOOK_ROWS rows each, one task a workbook: two sheets, the rows in the second part, which
    comes first by the workbook's order. Dates are numbers with a date format."""
    names = df.columns

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, date):
            return f'<c s="1"><v>{(date(v.year, v.month, v.day) - date(1899, 12, 30)).days}</v></c>'
        if isinstance(v, int | float):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    def write(number: int, batches: Iterator) -> None:
        row = lambda values: f"<row>{''.join(map(cell, values))}</row>".encode()
        with output(f"{path}/{number:05d}.xlsx") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="{_LINKS}"><sheets><sheet name="rows" sheetId="2" r:id="b"/><sheet name="other" sheetId="1" r:id="a"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>')
            z.writestr("xl/styles.xml", f'<styleSheet {_MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {_MAIN}><sheetData>{row(["other"]).decode()}</sheetData></worksheet>')
            with z.open("xl/worksheets/sheet2.xml", "w") as sheet:
                sheet.write(f"<worksheet {_MAIN}><sheetData>".encode() + row(names))
                for batch in batches:
                    for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        sheet.write(row(values))
                sheet.write(b"</sheetData></worksheet>")

    _in_each_task(df.repartition(max(1, -(-df.count() // BOOK_ROWS))), write)


def archive(spark: SparkSession, members: dict[str, str], path: str) -> None:
    """Files as members of an archive; members: name -> file."""

    def write(batches: Iterator) -> None:
        import shutil

        from tablesmith.sources.archives import opened

        for _ in batches:
            pass
        with output(path) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for name, source in members.items():
                with opened(source) as a, z.open(name, "w") as b:
                    shutil.copyfileobj(a, b)

    _in_one_task(spark.range(1), write)


def sqlite_table(df: DataFrame, path: str, table: str) -> None:
    """A table of a new SQLite file; path: a local one."""
    names = df.columns

    def write(batches: Iterator) -> None:
        import sqlite3
        from pathlib import Path

        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with sqlite3.connect(path) as db:
            db.execute(f"CREATE TABLE {table} ({', '.join(names)})")
            for batch in batches:
                db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(names))})", zip(*(c.to_pylist() for c in batch.columns), strict=True))

    _in_one_task(df, write)
