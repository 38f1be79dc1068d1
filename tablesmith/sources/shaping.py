"""Shaping of what was read: nested objects, arrays, numbers in text, unions of
tables with similar column names."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.exprs import to_float
from tablesmith.functions.scalars import comma_float
from tablesmith.operators.cleaning import ORDER, named, visible

LEAST_SIMILARITY = 0.65
LEAST_NUMERIC, LEAST_NUMERIC_COMMAS = 0.5, 0.8


def _leaves(kind: T.StructType, value: Column | None, prefix: str) -> list[tuple[str, Column, T.DataType]]:
    out = []
    for f in kind.fields:
        c = named(f.name) if value is None else value.getField(f.name)
        name = f"{prefix}_{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType):
            out += _leaves(f.dataType, c, name) if f.dataType.fields else [(name, F.lit(None).cast("string"), T.StringType())]
        else:
            out.append((name, c, f.dataType))
    return out


def flatten(df: DataFrame, lists_as_text: bool = True) -> DataFrame:
    """Nested objects as columns a_b_c; lists as JSON text unless they are to be expanded."""
    return df.select(*[(F.to_json(c) if lists_as_text and isinstance(t, T.ArrayType) else c).alias(n) for n, c, t in _leaves(df.schema, None, "")])


def expand_arrays(df: DataFrame) -> DataFrame:
    """One row for each combination of the elements of all list columns, in their
    order. Objects become item_<column>_<field>, values item_<column>; an empty
    list leaves one row with nulls."""
    df = flatten(df, lists_as_text=False)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            rest = [named(c) for c in df.columns if c != f.name]
            df = df.select(*rest, F.explode_outer(named(f.name)).alias(f"item_{f.name}"))
    return flatten(df, lists_as_text=True)


def promote_numeric(df: DataFrame, least: float = LEAST_NUMERIC, commas: bool = False) -> DataFrame:
    """Text columns of which at least that share of all rows reads as a number become doubles."""
    parse = comma_float if commas else to_float
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    share = df.agg(*[F.avg(parse(named(c)).isNotNull().cast("int")).alias(f"s{i}") for i, c in enumerate(texts)]).first()
    numeric = {c for i, c in enumerate(texts) if share[f"s{i}"] is not None and share[f"s{i}"] >= least}
    return df.select(*[(parse(named(c)) if c in numeric else named(c)).alias(c) for c in df.columns])


def similarity(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def match_columns(tables: list[list[str]], least: float = LEAST_SIMILARITY) -> tuple[list[str], list[dict[str, str]]]:
    """Standard names, and each table's names -> standard ones. The first table
    sets the standard; what is like none of it is added to it."""
    standard, maps = list(tables[0]) if tables else [], []
    for names in tables:
        mine: dict[str, str] = {}
        for n in names:
            best = max(standard, key=lambda s, n=n: similarity(n, s), default=None)
            if best is None or similarity(n, best) < least:
                standard.append(n)
                best = n
            mine[n] = best
        maps.append(mine)
    return standard, maps


def fuzzy_union(tables: dict[str, DataFrame], least: float = LEAST_SIMILARITY, promote: bool = True) -> DataFrame:
    """All rows under the standard columns, with source_file; columns of one table
    that meet in one name are coalesced from left to right. Types widen to text
    where they differ. If all tables have an input order, so has the union: the tables
    one after the other."""
    ordered = all(ORDER in df.columns for df in tables.values()) and len({df.schema[ORDER].dataType.simpleString() for df in tables.values()}) == 1
    orders = [F.struct(F.lit(i).alias("table"), F.col(ORDER).alias("row")).alias(ORDER) for i in range(len(tables))] if ordered else [None] * len(tables)
    standard, maps = match_columns([visible(df) for df in tables.values()], least)
    kinds: dict[str, set[str]] = {}
    for df, mine in zip(tables.values(), maps, strict=True):
        for c, s in mine.items():
            kinds.setdefault(s, set()).add(df.schema[c].dataType.simpleString())
    parts = []
    for (source, df), mine, order in zip(tables.items(), maps, orders, strict=True):
        columns = []
        for s in standard:
            from_ = [named(c) if len(kinds[s]) == 1 else named(c).cast("string") for c in visible(df) if mine[c] == s]
            kind = next(iter(kinds[s])) if len(kinds.get(s, ())) == 1 else "string"
            columns.append((F.coalesce(*from_) if from_ else F.lit(None).cast(kind)).alias(s))
        parts.append(df.select(*columns, F.lit(source).alias("source_file"), *[order] * ordered))
    out = reduce(DataFrame.unionByName, parts)
    return promote_numeric(out) if promote else out
