"""File scans: CSV with encoding and separator sniffing, JSON and JSON lines,
Parquet, Excel, zipped folders, Markdown trees. The readers are Spark's; the
driver looks at the first bytes of a file only, through Hadoop's file systems, so
any store that Spark reads will do."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.scalars import null_nans
from tablesmith.operators.cleaning import ORDER
from tablesmith.session import java_charsets, package_on_workers, shared_dir, written
from tablesmith.sources import archives, records
from tablesmith.sources.shaping import fuzzy_union

ENCODINGS = ("utf-8", "gbk", "gb2312", "gb18030", "latin1")
SEPARATORS = (",", "\t", ";")
#: Bytes of a file in which its first line is looked for.
HEAD_BYTES = 1 << 16


def first_file(spark: SparkSession, path: str) -> str | None:
    """The first data file of a path, which may be a folder or a pattern."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(fs.globStatus(root) or [], key=lambda x: x.getPath().toString())
    while found:
        status = found.pop(0)
        if not status.isDirectory():
            return status.getPath().toString()
        inside = [x for x in fs.listStatus(status.getPath()) if not x.getPath().getName().startswith(("_", "."))]
        found = sorted(inside, key=lambda x: x.getPath().toString()) + found
    return None


def head_bytes(spark: SparkSession, path: str, most: int = HEAD_BYTES) -> bytes:
    """The first bytes of the first file, read as a range."""
    name = first_file(spark, path)
    if name is None:
        return b""
    file = spark._jvm.org.apache.hadoop.fs.Path(name)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def _decodes(data: bytes, name: str) -> bool:
    try:
        data.decode(name)
    except UnicodeDecodeError:
        return False
    return True


def sniff_encoding(head: bytes) -> str:
    """The first encoding that decodes the bytes; the last few may be cut off."""
    return next((name for name in ENCODINGS for cut in range(4) if _decodes(head[: len(head) - cut], name)), "utf-8")


def find_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding that decodes every line of the whole input. Valid UTF-8 is found by one scan in the JVM; only
    other files are decoded line by line for the rest."""
    lines = spark.read.option("lineSep", "\n").text(path)
    if lines.where(~F.is_valid_utf8("value")).isEmpty():
        return "utf-8"
    others = ENCODINGS[1:]

    def run(batches: Iterator):
        import pyarrow as pa

        failed: set[str] = set()
        for batch in batches:
            for data in batch.column(0).to_pylist():
                failed |= {n for n in others if n not in failed and not _decodes(data, n)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(failed), pa.string())], ["name"])

    package_on_workers(spark)
    failed = {r.name for r in lines.select(F.col("value").cast("binary")).mapInArrow(run, "name string").distinct().collect()}
    return next(n for n in others if n not in failed)  # the last one decodes anything


def sniff_separator(line: str) -> str:
    counts = {s: line.count(s) for s in SEPARATORS}
    return next((s for s in SEPARATORS if counts[s] == max(counts.values()) > 0), ",")


def _order(file, block=0, row=0, place=0) -> Column:
    """The rows' input order: files by path, then the split's first byte, the row and its place in it."""
    number = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")
    return F.struct(file.alias("file"), number(block).alias("block"), number(row).alias("row"), number(place).alias("place")).alias(ORDER)


def _scan_order(place=0) -> Column:
    """Order of a scan of lines: however splits are dealt to tasks, a split's rows are in order within its task."""
    return _order(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id(), place)


def inferred_schema(texts: DataFrame, kind: str, **options) -> T.StructType:
    """The schema that a reader (csv, json) finds in a table with one column of records."""
    spark = texts.sparkSession
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    found = getattr(spark.read.options(**options)._jreader, kind)(strings)
    return T.StructType.fromJson(json.loads(found.schema().json()))


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, separator: str | None = None, schema: T.StructType | str | None = None, ordered: bool = False) -> DataFrame:
    """With a schema the file is read once more than it takes to look for open quotes; without, Spark infers one. An encoding
    that is not given is looked for in the whole input. Cells may hold line breaks, separators and doubled quotes; where
    they hold line breaks, splits are cut at the borders of records. ordered: adds the input order."""
    encoding = encoding or find_encoding(spark, path)
    if encoding != "utf-8":
        java_charsets(spark)
    if separator is None:
        separator = sniff_separator(head_bytes(spark, path).decode(encoding, "replace").split("\n")[0])
    options = {"sep": separator, "escape": '"'}
    if records.any_open_line(spark, path, separator):
        return _csv_records(spark, path, encoding, options, schema, ordered)
    reader = spark.read.options(header=True, encoding=encoding, **options)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df.select("*", _scan_order()) if ordered else df


def _csv_header(spark: SparkSession, path: str, encoding: str, separator: str) -> list[str]:
    """Column names by the first record, under the rules of Spark's reader: blank ones get their number, so do repeated ones."""
    size = HEAD_BYTES
    while True:
        head = head_bytes(spark, path, size)
        text = head.decode(encoding, "ignore").removeprefix("\ufeff")
        rows = csv.reader(io.StringIO(text, newline=""), delimiter=separator)
        first = next(rows, [])
        if len(head) < size or next(rows, None) is not None:
            break
        size *= 4
    low = [n.lower() for n in first]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(first)]


def _parsed_csv(texts: DataFrame, keep: list[str], names: list[str], options: dict[str, str], schema: T.StructType | str | None) -> DataFrame:
    """Records (column text) as typed columns, beside the columns to keep."""
    if schema is None:
        found = inferred_schema(texts.select("text"), "csv", header="false", inferSchema="true", multiLine="true", **options).fields
        kinds = [found[i].dataType if i < len(found) else T.StringType() for i in range(len(names))]
    else:
        given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        names, kinds = given.names, [f.dataType for f in given.fields]
    shape = ", ".join(f"c{i} {k.simpleString()}" for i, k in enumerate(kinds))
    row = F.from_csv("text", shape, options | {"multiLine": "true"}).alias("r")
    parsed = texts.select(*keep, row)
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], *keep)


def _csv_records(spark: SparkSession, path: str, encoding: str, options: dict[str, str], schema: T.StructType | str | None, ordered: bool) -> DataFrame:
    scan = records.CsvScan(options["sep"].encode())
    found = records.records(spark, path, scan, records.split_states(spark, path, scan))
    text = F.col("value").cast("string") if encoding == "utf-8" else F.decode("value", encoding)
    found = found.where("number > 0").select(F.regexp_replace(text, "\r$", "").alias("text"), _order(F.col("file"), 0, F.col("number"))).where("trim(text) <> ''")
    return _parsed_csv(found, [ORDER] if ordered else [], _csv_header(spark, path, encoding, options["sep"]), options, schema)


#: What stands before a file's first row and after its last.
_JSON_HEAD = r'^\x{FEFF}?\s*(\{\s*"(?:[^"\\]|\\.)*"\s*:\s*)?\['
_JSON_TAIL = r"\]\s*\}?\s*$"


def read_json(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """A list of objects, or one object: `{"k": [...]}` with a single list gives the list's rows and their numbers
    (_jsonl_row_idx). Lists are read by as many tasks as the file has splits; another object is one row."""
    scan = records.JsonScan()
    states = records.split_states(spark, path, scan)
    if not states:
        df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
        lists = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        whole = df.select("*", _scan_order()) if ordered else df
        if len(df.schema.fields) == 1 and lists:  # next to scalars in other files
            return whole.select(F.posexplode(lists[0].name).alias("_jsonl_row_idx", "e"), *[ORDER] * ordered).select("e.*", "_jsonl_row_idx", *[F.col(ORDER).withField("place", F.col("_jsonl_row_idx").cast("long")).alias(ORDER)] * ordered)
        return whole
    value = F.col("value").cast("string")
    value = F.when(F.col("number") == 0, F.regexp_replace(value, _JSON_HEAD, "")).otherwise(value)
    value = F.when(~F.col("ended"), F.regexp_replace(value, _JSON_TAIL, "")).otherwise(value)
    blank = F.trim(value) == ""
    value = F.when(blank, F.raise_error(F.lit("not JSON: an element is missing")).cast("string")).otherwise(value)
    found = records.records(spark, path, scan, states).where(~(blank & (F.col("number") == 0) & ~F.col("ended")))
    found = found.select(value.alias("text"), F.col("number").cast("int").alias("_jsonl_row_idx"), _order(F.col("file"), 0, F.col("number")))
    schema = inferred_schema(found.select("text"), "json", mode="FAILFAST")
    rows = found.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("e"), "_jsonl_row_idx", ORDER)
    wrapped = any(border == 2 for *_, border in states)
    return rows.select("e.*", *["_jsonl_row_idx"] * wrapped, *[ORDER] * ordered)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, ordered: bool = False) -> DataFrame:
    """One object for each line, or a list of objects; blank lines are skipped, a bad line is an error that shows it
    (bad_lines has its number). Without a schema Spark infers one."""
    if schema is None:
        found = spark.read.json(path).schema
        schema = T.StructType([f for f in found.fields if f.name != "_corrupt_record"])
    lines = spark.read.text(path).where(F.trim("value") != "")
    shape = schema if isinstance(schema, str) else schema.simpleString()
    shape = shape if shape.startswith("struct<") else f"struct<{shape}>"
    one, many = F.from_json("value", shape), F.from_json("value", f"array<{shape}>")
    read = F.when(F.ltrim("value").startswith("["), many).otherwise(F.when(one.isNotNull(), F.array(one)))
    valid = F.try_parse_json("value").isNotNull()
    checked = F.when(valid, read).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), F.substring("value", 1, 200))).cast(f"array<{shape}>"))
    if not ordered:
        return lines.select(F.inline(checked))
    each = lines.select(_scan_order(), F.posexplode(checked).alias("place", "e"))
    return each.select("e.*", F.col(ORDER).withField("place", F.col("place").cast("long")).alias(ORDER))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of all lines that are no JSON. Lines are counted by split first, so that only bad ones move."""
    numbered = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("id"), "value")
    bad = (F.trim("value") != "") & F.try_parse_json("value").isNull()
    first = numbered.groupBy("file", "part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = first.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    met = numbered.where(bad).join(before, ["file", "part"])
    return met.select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), F.col("value").alias("text")).orderBy("file", "line")


def read_text_head(spark: SparkSession, path: str, lines: int = 100) -> list[str]:
    """The first lines of the first file, whatever their length."""
    name = first_file(spark, path)
    found = [] if name is None else [bytes(r.v).removesuffix(b"\r") for r in spark.read.option("lineSep", "\n").text(name).select(F.col("value").cast("binary").alias("v")).limit(lines).collect()]
    encoding = sniff_encoding(b"\n".join(found))
    return [x.decode(encoding, "replace") for x in found]


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all .md files below path."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Data files of a path, which may be a folder or a pattern, by name."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out: list[str] = []
    waiting = [x for x in fs.globStatus(root) or []]
    while waiting:
        status = waiting.pop()
        if status.isDirectory():
            waiting += [x for x in fs.listStatus(status.getPath()) if not x.getPath().getName().startswith(("_", "."))]
        else:
            out.append(status.getPath().toString())
    return sorted(out)


def read_excel(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """The first sheet (in the workbook's order) of each workbook, its first row as header. Numbers, dates and truths keep
    their types where a column has nothing else; other columns are text. Workbooks with other headers add their columns. A
    workbook is read once, row by row in one task, as its parts are compressed; its cells are kept in the shared folder."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name in batch.column("file").to_pylist():
                number = 0
                with archives.opened(name) as f:
                    for part in archives.workbook_batches(f):
                        n = len(part["cells"])
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(number, number + n), pa.int64()), *[pa.array(part[c], pa.list_(pa.string())) for c in ("names", "kinds", "cells")]], ["file", "number", "names", "kinds", "cells"])
                        number += n

    package_on_workers(spark)
    paths = [archives.reachable(spark, x) for x in list_files(spark, path)]
    if not paths:
        raise FileNotFoundError(path)
    each = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, file string").repartition(len(paths), "i")
    found = each.select("file").mapInArrow(run, "file string, number long, names array<string>, kinds array<string>, cells array<string>")
    df = _typed_cells(written(found, "cells").withColumn(ORDER, _order(F.col("file"), 0, F.col("number"))))
    return df if ordered else df.drop(ORDER)


def _typed_cells(rows: DataFrame) -> DataFrame:
    """Cells under their names, as the type that all of a column have; rows: names, kinds, cells, _ord."""
    names = list(dict.fromkeys(n for r in rows.where("number = 0").select("names").distinct().orderBy("names").collect() for n in r.names))
    at = lambda n: (F.array_position("names", F.lit(n)) - 1).cast("int")
    pick = lambda c, n: F.when(F.array_contains("names", F.lit(n)), F.get(c, at(n)))
    rows = rows.where("cells is not null")
    flat = rows.select(ORDER, *[pick("cells", n).alias(f"c{i}") for i, n in enumerate(names)], *[F.nullif(pick("kinds", n), F.lit("")).alias(f"k{i}") for i, n in enumerate(names)])
    held = flat.agg(*[F.collect_set(f"k{i}").alias(f"k{i}") for i in range(len(names))], *[F.bool_and(F.col(f"c{i}").rlike(r"^-?\d{1,18}(\.0*)?$")).alias(f"w{i}") for i in range(len(names))]).first() if names else None
    columns = []
    for i, n in enumerate(names):
        kind = {("n",): "bigint" if held[f"w{i}"] else "double", ("d",): "timestamp", ("b",): "boolean"}.get(tuple(held[f"k{i}"]), "string")
        value = F.col(f"c{i}").cast("decimal(38,6)").cast("bigint") if kind == "bigint" else F.col(f"c{i}").cast(kind)
        columns.append(value.alias(n))
    return flat.select(*columns, ORDER)


def zipped_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = archives.SUFFIXES) -> list[str]:
    """Names of the supported files in an archive, by its directory."""
    return archives.members(archives.reachable(spark, path), suffixes)


def read_zip_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an archive, the one with most rows first: CSV, Excel and Parquet members as one fuzzy union, each JSON
    member by itself. Cells keep their line breaks, Parquet members their types. Members that can't be read are left out,
    unless all fail. Each member is parsed once, in a task of its own; what is no Parquet is kept in the shared folder."""
    package_on_workers(spark)
    spark.dataSource.register(archives.ZipSource)
    place = archives.reachable(spark, path)
    source = spark.read.format("zip_members").option("path", place)
    names = archives.members(place)
    kept = f"{shared_dir(spark)}/zip-{uuid.uuid4().hex}"
    source.load().write.partitionBy("member").parquet(kept)
    errors, tabular, tables = [], {}, {}
    if any(not n.lower().endswith(".parquet") for n in names):
        all_rows = spark.read.parquet(kept)
        failed = {r.member: r.error for r in all_rows.where("error is not null").select("member", "error").collect()}
    for i, n in enumerate(names):
        stem, suffix = PurePosixPath(n).stem, PurePosixPath(n).suffix.lower()
        try:
            if suffix == ".parquet":
                df = source.option("member", n).load()
            elif n in failed:
                raise ValueError(failed[n])
            else:
                df = _member_table(all_rows.where(F.col("member") == n), suffix)
        except Exception as e:
            errors.append(f"{n}: {str(e).splitlines()[0]}")
            continue
        into = tables if suffix == ".json" else tabular
        into[stem if stem not in into else f"{stem}_{i}"] = df
    if not tables and not tabular:
        raise ValueError("no member could be read: " + "; ".join(errors[:5]))
    if len(tabular) > 1:
        tables = {"union": fuzzy_union(tabular), **tables}
    else:
        tables = {**tabular, **tables}
    size = {n: df.count() for n, df in tables.items()}
    return dict(sorted(tables.items(), key=lambda x: -size[x[0]]))


def _member_table(rows: DataFrame, suffix: str) -> DataFrame:
    """A member's rows, with their order."""
    rows = rows.withColumn(ORDER, _order(F.lit(""), 0, F.col("number")))
    if suffix in (".xlsx", ".xlsm"):
        return _typed_cells(rows)
    texts = rows.select(F.col("record").alias("text"), ORDER, "number", "wrapped")
    if suffix == ".csv":
        head = texts.where("number = 0").first()
        if head is None:
            raise ValueError("no rows")
        first = next(csv.reader([head.text]))
        names = [n if n else f"_c{i}" for i, n in enumerate(first)]
        return _parsed_csv(texts.where("number > 0"), [ORDER], names, {"sep": ",", "escape": '"'}, None)
    schema = inferred_schema(texts.select("text"), "json", mode="FAILFAST")
    out = texts.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("e"), F.col("number").cast("int").alias("_jsonl_row_idx"), ORDER)
    wrapped = not rows.where("wrapped").isEmpty()
    return out.select("e.*", *["_jsonl_row_idx"] * wrapped, ORDER)


def header_row(rows: list[list[str | None]]) -> tuple[list[str], list[list[str | None]]]:
    """Tables found in pages: the first row names the columns (col_i where it is
    blank), short rows are padded; blank rows go. Fewer than two rows are no table."""
    rows = [r for r in rows if any(c not in (None, "") for c in r)]
    if len(rows) < 2:
        return [], []
    width = max(map(len, rows))
    names = [str(c).strip() if c not in (None, "") else f"col_{i}" for i, c in enumerate(rows[0] + [None] * (width - len(rows[0])))]
    return names, [r + [None] * (width - len(r)) for r in rows[1:]]


def read(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """By suffix; an unknown one is an error. NaN becomes NULL, and the hidden input order is added unless it is not wanted."""
    return null_nans(_read(spark, path, ordered))


def _read(spark: SparkSession, path: str, ordered: bool) -> DataFrame:
    match PurePosixPath(path.rstrip("/")).suffix.lower():
        case ".csv" | ".txt" | ".tsv":
            return read_csv(spark, path, ordered=ordered)
        case ".json":
            return read_json(spark, path, ordered)
        case ".jsonl":
            return read_jsonl(spark, path, ordered=ordered)
        case ".parquet":
            df = spark.read.parquet(path)
            return df.select("*", _order(F.col("_metadata.file_path"), 0, F.col("_metadata.row_index"))) if ordered else df
        case ".xlsx" | ".xlsm":
            return read_excel(spark, path, ordered)
        case ".zip":
            df = next(iter(read_zip_tables(spark, path).values()))
            return df if ordered else df.drop(ORDER)
        case ".pdf" | ".xls" as suffix:
            raise ValueError(f"{suffix} files need a library that is not there: {path}")
        case suffix:
            raise ValueError(f"no reader for {suffix or 'files without suffix'}: {path}")
