"""Profiles and quality rules. All measures of all columns come from one
aggregate, the number of different rows from a second one, and samples from the
first rows; only a column with hardly a value there is scanned for some. Exact counts
have a job of their own: beside them, Spark would keep all other measures (sketches
among them) once for each distinct value.

Distinct values are counted approximately (each column on its own would copy the
table) unless `exact` is asked for; columns that are named as ids are counted
exactly, as their role depends on it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.scalars import to_float
from tablesmith.operators.cleaning import named, order_keys, visible

MOST_NULLS, MOST_DUPLICATES = 0.05, 0.01
SAMPLES = 5

#: Names of time columns (anywhere in the name) and of ids (the whole name).
TIME_NAME = re.compile("date|time|timestamp|datetime|year|month|day|quarter|季度|日期|时间|年|月|日", re.IGNORECASE)
ID_NAME = re.compile("^(id|_id|pk|primary_key|key|uuid|序号|编号)$", re.IGNORECASE)


def logical_type(kind: T.DataType) -> str:
    match kind:
        case T.BooleanType():
            return "bool"
        case T.IntegralType():
            return "int"
        case T.FractionalType():
            return "float"
        case T.DateType() | T.TimestampType() | T.TimestampNTZType() | T.DayTimeIntervalType():
            return "datetime"
    return "string"


@dataclass
class ColumnProfile:
    name: str
    kind: str
    nulls: int
    null_rate: float
    distinct: int
    least: float | None
    most: float | None
    mean: float | None
    samples: list[str]
    kinds: list[str]


@dataclass
class Profile:
    rows: int
    columns: list[ColumnProfile]
    duplicate_rate: float
    null_rate: float
    empty_rows: bool
    first_rows: list[dict] = field(default_factory=list)


def value_kind(c: Column) -> Column:
    """What a text holds: int, float, date or text; null for null."""
    return (
        F.when(c.isNull(), None)
        .when(F.rlike(c, F.lit(r"^\s*[+-]?\d+\s*$")), "int")
        .when(to_float(c).isNotNull(), "float")
        .when(F.rlike(c, F.lit(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T].*)?$")), "date")
        .otherwise("text")
    )


def _hashable(df: DataFrame, c: str) -> Column:
    return F.to_json(named(c)) if isinstance(df.schema[c].dataType, T.MapType | T.VariantType) else named(c)


def duplicate_rate(df: DataFrame) -> float:
    """(rows - different rows) / rows; 0 for an empty table. Rows are told apart by 128 bits of hash, so that no row moves whole."""
    values = [F.struct(F.isnull(named(c)), _hashable(df, c)) for c in visible(df)]
    groups = df.groupBy(*[F.xxhash64(F.lit(seed), *values).alias(f"h{seed}") for seed in (1, 2)]).agg(F.count("*").alias("n"))
    found = groups.agg(F.sum("n").alias("rows"), F.count("*").alias("different")).first()
    return (found.rows - found.different) / found.rows if found.rows else 0.0


def first_values(df: DataFrame, columns: list[str], n: int = SAMPLES) -> dict[str, list]:
    """The first n values that are not null of each column: a top-n for each."""
    if not columns:
        return {}
    found: dict[str, list] = {c: [] for c in columns}
    keys, parts = order_keys(df), []
    for i, c in enumerate(columns):
        some = df.where(named(c).isNotNull())
        parts.append((some.orderBy(*keys) if keys else some).limit(n).select(F.lit(i).alias("i"), named(c).cast("string").alias("v")))
    for r in reduce(DataFrame.unionAll, parts).collect():
        found[columns[r.i]].append(r.v)
    return found


def profile(df: DataFrame, samples: int = SAMPLES, exact: bool = False) -> Profile:
    columns = visible(df)
    kinds = {c: logical_type(df.schema[c].dataType) for c in columns}
    counted = [c for c in columns if exact or ID_NAME.match(c)]
    made = [F.count("*").alias("rows")]
    if columns:
        made.append(F.count_if(_all_null(columns)).alias("empty"))
    for i, c in enumerate(columns):
        made.append(F.count(named(c)).alias(f"n{i}"))
        if c not in counted:
            made.append(F.approx_count_distinct(_hashable(df, c), 0.01).alias(f"d{i}"))
        if kinds[c] in ("int", "float"):
            made += [F.min(named(c)).cast("double").alias(f"lo{i}"), F.max(named(c)).cast("double").alias(f"hi{i}"), F.avg(named(c)).alias(f"m{i}")]
        if isinstance(df.schema[c].dataType, T.StringType):
            made.append(F.collect_set(value_kind(named(c))).alias(f"k{i}"))
    got = df.agg(*made).first().asDict() | {f"d{columns.index(c)}": n for c, n in exact_distinct(df, counted).items()}
    keys = order_keys(df)
    head = (df.orderBy(*keys) if keys else df).limit(10 * samples).select(*map(named, columns)).collect() if columns else []
    some = {c: [str(r[c]) for r in head if r[c] is not None][:samples] for c in columns}
    some |= first_values(df, [c for i, c in enumerate(columns) if len(some[c]) < min(samples, got[f"n{i}"])], samples)
    out = []
    for i, c in enumerate(columns):
        nulls = got["rows"] - got[f"n{i}"]
        out.append(ColumnProfile(c, kinds[c], nulls, nulls / got["rows"] if got["rows"] else 0.0, got[f"d{i}"], got.get(f"lo{i}"), got.get(f"hi{i}"), got.get(f"m{i}"), some[c], sorted(got.get(f"k{i}", [])) or _nested(df, c)))
    cells = got["rows"] * len(columns)
    return Profile(got["rows"], out, duplicate_rate(df) if columns else 0.0, sum(x.nulls for x in out) / cells if cells else 0.0, bool(got.get("empty")), [r.asDict() for r in head[:samples]])


def exact_distinct(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """How many different values, without nulls, each column has: one job, in which only the column itself is shuffled."""
    parts = [df.select(_hashable(df, c).alias("v")).where("v is not null").distinct().agg(F.lit(c).alias("c"), F.count("*").alias("n")) for c in columns]
    return {r.c: r.n for r in reduce(DataFrame.unionAll, parts).collect()} if parts else {}


def _nested(df: DataFrame, c: str) -> list[str]:
    """Lists and objects count as mixed, as their cells are no plain values."""
    return ["list", "object"] if isinstance(df.schema[c].dataType, T.ArrayType | T.MapType | T.StructType) else []


def _all_null(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & named(c).isNull()
    return out


def mixed(kinds: list[str]) -> bool:
    """Numbers of two kinds are one kind; anything else together is mixed."""
    return len({"number" if k in ("int", "float") else k for k in kinds}) > 1


def issues(p: Profile) -> list[dict]:
    """Rows of issue, level, column, value; none means clean."""
    found = [{"issue": "nulls", "level": "warning", "column": c.name, "value": round(c.null_rate, 6)} for c in p.columns if c.null_rate > MOST_NULLS]
    if p.duplicate_rate > MOST_DUPLICATES:
        found.append({"issue": "duplicates", "level": "warning", "column": "", "value": round(p.duplicate_rate, 6)})
    found += [{"issue": "cjk_name", "level": "error", "column": c.name, "value": 1.0} for c in p.columns if re.search("[一-鿿]", c.name)]
    found += [{"issue": "mixed", "level": "error", "column": c.name, "value": float(len(c.kinds))} for c in p.columns if mixed(c.kinds)]
    if p.empty_rows:
        found.append({"issue": "empty_rows", "level": "warning", "column": "", "value": 1.0})
    return found


def semantic_role(c: ColumnProfile, rows: int) -> str:
    """time, id, measure or dimension."""
    if c.kind == "datetime" or TIME_NAME.search(c.name):
        return "time"
    if ID_NAME.match(c.name) and c.distinct == rows:
        return "id"
    return "measure" if c.kind in ("int", "float") else "dimension"


def semantic_hints(p: Profile) -> dict:
    """Time column, dimensions, measures, up to 3 x 3 groupings and the patterns they make."""
    roles = {c.name: semantic_role(c, p.rows) for c in p.columns}
    of = lambda r: [n for n, x in roles.items() if x == r]
    times, dimensions, measures = of("time"), of("dimension"), of("measure")
    patterns = []
    if times and measures:
        patterns.append("time_series")
    if dimensions and measures:
        patterns.append("categorical_comparison")
    if len(measures) > 1:
        patterns.append("multi_measure")
    return {"roles": roles, "time": times[0] if times else None, "dimensions": dimensions, "measures": measures, "groupings": [(d, m) for d in dimensions[:3] for m in measures[:3]], "patterns": patterns or ["generic_tabular"]}


def preview_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows as text, nulls as empty text."""
    keys = order_keys(df)
    return (df.orderBy(*keys) if keys else df).limit(n).select(*[F.coalesce(named(c).cast("string"), F.lit("")).alias(c) for c in visible(df)])


# -- texts -------------------------------------------------------------------


def row_total(tables: dict[str, DataFrame]) -> int:
    """Rows of all tables together."""
    counts = [df.agg(F.count("*").alias("n")) for df in tables.values()]
    return reduce(DataFrame.unionAll, counts).agg(F.sum("n")).first()[0] if counts else 0


def profile_text(p: Profile, name: str = "table") -> str:
    """A profile in words: size, columns with samples, first rows, quality."""
    has = lambda kind: "yes" if any(x["issue"] == kind for x in issues(p)) else "no"
    lines = [f"table: {name}", f"rows: {p.rows}", f"columns: {len(p.columns)}", "", "columns:"]
    lines += [f"  - {c.name} (type: {c.kind}, null rate: {c.null_rate:.1%}, distinct: {c.distinct}, samples: {c.samples[:3]})" for c in p.columns]
    lines += ["", "first rows:", *[f"  row {i}: {r}" for i, r in enumerate(p.first_rows[:SAMPLES], 1)], "", "quality:"]
    lines += [f"  null rate: {p.null_rate:.1%}", f"  duplicate rate: {p.duplicate_rate:.1%}", f"  names in CJK letters: {has('cjk_name')}", f"  mixed types: {has('mixed')}", f"  empty rows: {'yes' if p.empty_rows else 'no'}"]
    return "\n".join(lines)


def table_text(df: DataFrame, name: str = "table", rows: int = 10) -> str:
    """Shape, column names and first rows."""
    head = preview_rows(df, rows).collect()
    return "\n".join([f"table: {name}", f"shape: {df.count()} rows, {len(visible(df))} columns", f"columns: {visible(df)}", "", f"first {rows} rows:", *["  " + " | ".join(r) for r in head]])


def schema_text(tables: list[dict], most: int = 20) -> str:
    """What `introspect` found, table by table."""
    lines = ["tables:"]
    for t in tables[:most]:
        lines.append(f"- {t['table']} ({t['rows']} rows)")
        lines += [f"    {c['name']} {c['type'].upper()}{' PK' if c['primary_key'] else ''}{' FK->' + c['foreign_key'] if c['foreign_key'] else ''}{'' if c['nullable'] else ' NOT NULL'}" for c in t["columns"]]
        lines += [f"    {r}" for r in t["samples"]]
    return "\n".join(lines)
