"""Table-cleaning operators. Each is built from keyword arguments (unknown ones
are ignored, as rule files may carry notes) and has run(df, inputs) -> (df, logs).
A chain of operators is one Catalyst plan, and missing columns are found on the schema.
Nothing runs before an action, but for medians and deep pages, which need ranks first.

Where the order of rows matters (the first of equal rows, limits, first rows of a
list) it is given by ORDER, a column that `files.read` adds, and by the last Sort
before; without either such operators take any row."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.exprs import ExpressionError, compile_condition, compile_expression
from tablesmith.functions.scalars import MAP_FUNCTIONS
from tablesmith.operators import ranks

#: Hidden column with the rows' input order.
ORDER = "_ord"

Inputs = dict[str, DataFrame] | None
Outcome = tuple[DataFrame, list[str]]


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ORDER]


def as_list(x: str | list[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def order_keys(df: DataFrame) -> list[Column]:
    """Keys of the rows' current order: those of the last Sort, if they are still there, then the input order."""
    if ORDER not in df.columns:
        return []
    last = _sorted(df)
    keys = [_direction(c, up) for c, up in last] if all(c in df.columns for c, _ in last) else []
    return [*keys, F.col(ORDER)]


def _sorted(df: DataFrame) -> list[tuple[str, bool]]:
    """What Sort has noted in ORDER's metadata."""
    noted = df.schema[ORDER].metadata
    return list(zip(noted.get("sorted", []), noted.get("ascending", []), strict=True))


def _direction(name: str, ascending: bool) -> Column:
    return named(name).asc_nulls_last() if ascending else named(name).desc_nulls_last()


class Operator:
    """Base of all operators; a subclass may be given to the rule engine under a name of its own."""

    def __init__(self, **ignored):
        pass

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        raise NotImplementedError

    @property
    def name(self) -> str:
        return type(self).__name__

    def split(self, df: DataFrame, wanted: list[str], logs: list[str]) -> list[str]:
        """The wanted columns that exist; the others are logged."""
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            logs.append(f"WARNING {self.name}: no column {', '.join(missing)}")
        return [c for c in wanted if c in df.columns]


def _comparable(df: DataFrame, name: str) -> Column:
    """Maps can't be compared; their JSON can."""
    return F.to_json(named(name)) if isinstance(df.schema[name].dataType, T.MapType | T.VariantType) else named(name)


class Dedup(Operator):
    """Keeps the first of rows that are equal in `by` (or in all columns). Nulls are equal."""

    def __init__(self, by: str | list[str] | None = None, **ignored):
        self.by = as_list(by)

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        logs: list[str] = []
        keys = self.split(df, self.by, logs) or visible(df)
        logs.append(f"Dedup: by {', '.join(keys)}")
        if not keys:
            return df, logs
        order = order_keys(df)
        if not order:
            if all(not isinstance(df.schema[k].dataType, T.MapType) for k in keys):
                return df.dropDuplicates(keys), logs
            order = [F.lit(0)]
        first = Window.partitionBy(*[_comparable(df, k) for k in keys]).orderBy(*order)
        return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth"), logs


class Filter(Operator):
    """Drops rows with only nulls, then rows with any null, then those that fail the condition."""

    def __init__(self, condition: str | None = None, drop_null: bool = False, drop_empty: bool = False, **ignored):
        self.condition, self.drop_null, self.drop_empty = condition, drop_null, drop_empty

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        columns = visible(df)
        if self.drop_empty and columns:
            df = df.na.drop("all", subset=columns)
        if self.drop_null and columns:
            df = df.na.drop("any", subset=columns)
        if self.condition:
            df = df.where(compile_condition(self.condition, df))
        return df, [f"Filter: condition={self.condition} drop_null={self.drop_null} drop_empty={self.drop_empty}"]


class RenameFields(Operator):
    """mapping old -> new; further keyword arguments with text values count as mapping too."""

    def __init__(self, mapping: dict[str, str] | None = None, **more):
        self.mapping = {**(mapping or {}), **{k: v for k, v in more.items() if isinstance(v, str)}}

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        logs: list[str] = []
        have = self.split(df, list(self.mapping), logs)
        names = [self.mapping.get(c, c) if c in have else c for c in df.columns]
        if len(set(names)) < len(names):
            raise ValueError(f"RenameFields: two columns would be named {sorted({n for n in names if names.count(n) > 1})}")
        return df.toDF(*names), [*logs, f"RenameFields: {len(have)} renamed"]


class Map(Operator):
    """Applies a function by name to a field, then an expression."""

    def __init__(self, field: str | None = None, func: str | None = None, expr: str | None = None, **ignored):
        self.field, self.func, self.expr = field, func, expr

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        logs: list[str] = []
        if self.func:
            if self.func not in MAP_FUNCTIONS:
                logs.append(f"WARNING Map: unknown function {self.func}")
            elif self.split(df, [self.field], logs):
                df = df.withColumn(self.field, MAP_FUNCTIONS[self.func](named(self.field)))
                logs.append(f"Map: {self.func}({self.field})")
        if self.expr and self.field:
            try:
                df = df.withColumn(self.field, compile_expression(self.expr, df))
                logs.append(f"Map: {self.field} = {self.expr}")
            except ExpressionError as e:
                logs.append(f"ERROR Map: {self.field}: {e}")
        return df, logs


class Select(Operator):
    def __init__(self, columns: list[str] | None = None, **ignored):
        self.columns = as_list(columns)

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        logs: list[str] = []
        have = list(dict.fromkeys(self.split(df, self.columns, logs)))
        hidden = [ORDER] if ORDER in df.columns else []
        return df.select(*map(named, have + hidden)), [*logs, f"Select: {len(have)} columns"]


class AddFields(Operator):
    """Fields by expression, in order: later ones may use earlier ones. A field with an error is left out."""

    def __init__(self, fields: dict[str, str] | None = None, **ignored):
        self.fields = fields or {}

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        logs = []
        for name, expr in self.fields.items():
            try:
                df = df.withColumn(name, compile_expression(str(expr), df))
                logs.append(f"AddFields: {name} = {expr}")
            except ExpressionError as e:
                logs.append(f"ERROR AddFields: {name}: {e}")
        return df, logs


class Flat(Operator):
    """One row for each element of a list; text that begins with `[` is read as a
    JSON list. Empty lists and nulls leave one row with null, other values stay."""

    def __init__(self, key: str | None = None, target_key: str | None = None, **ignored):
        self.key, self.target = key, target_key or key

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        logs: list[str] = []
        if not self.key or not self.split(df, [self.key], logs):
            return df, logs or ["WARNING Flat: no key"]
        kind, value = df.schema[self.key].dataType, named(self.key)
        if isinstance(kind, T.StringType):
            read = F.when(F.trim(value).startswith("["), F.from_json(value, "array<string>"))
            value = F.coalesce(read, F.array(value))
        elif not isinstance(kind, T.ArrayType):
            return self._rename(df), [*logs, f"Flat: {self.key} holds no lists"]
        others = [named(c) for c in df.columns if c != self.key]
        at = df.columns.index(self.key)
        out = df.select(*others[:at], F.explode_outer(value).alias(self.key), *others[at:])
        return self._rename(out), [*logs, f"Flat: {self.key} -> {self.target}"]

    def _rename(self, df: DataFrame) -> DataFrame:
        return df.withColumnRenamed(self.key, self.target) if self.target != self.key else df


HOWS = {"left": "left", "right": "right", "inner": "inner", "outer": "full", "full": "full"}


def join_tables(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", suffixes: tuple[str, str] = ("", "_right")) -> DataFrame:
    """Equal keys, of which null equals null; the keys once, other clashing names with a suffix."""
    clash = (set(visible(left)) & set(visible(right))) - set(on)
    a = left.select(*[named(c).alias(f"_k{on.index(c)}" if c in on else c + (suffixes[0] if c in clash else "")) for c in left.columns])
    b = right.drop(ORDER).select(*[named(c).alias(f"_r{on.index(c)}" if c in on else c + (suffixes[1] if c in clash else "")) for c in visible(right)])
    out = a.join(b, reduce(lambda x, y: x & y, [F.col(f"_k{i}").eqNullSafe(F.col(f"_r{i}")) for i in range(len(on))]), HOWS[how])
    key = {"right": lambda i: F.col(f"_r{i}"), "full": lambda i: F.coalesce(F.col(f"_k{i}"), F.col(f"_r{i}"))}.get(HOWS[how], lambda i: F.col(f"_k{i}"))
    first = [key(on.index(c)).alias(c) if c in on else named(c + (suffixes[0] if c in clash else "")) for c in left.columns]
    rest = [named(c + (suffixes[1] if c in clash else "")) for c in visible(right) if c not in on]
    return out.select(*first, *rest)


class Join(Operator):
    """Joins two named inputs; the chain's own table is not used."""

    def __init__(self, left: str | None = None, right: str | None = None, on: str | list[str] | None = None, how: str = "left", **ignored):
        self.left, self.right, self.on, self.how = left, right, as_list(on), how

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        known = inputs or {}
        absent = [n for n in (self.left, self.right) if n not in known]
        if absent:
            return df, [f"WARNING Join: no input {', '.join(map(str, absent))}"]
        a, b = known[self.left], known[self.right]
        lost = [c for c in self.on if c not in a.columns or c not in b.columns]
        if lost or not self.on or self.how not in HOWS:
            return df, [f"ERROR Join: {'how=' + self.how if self.how not in HOWS else 'no common column ' + ', '.join(lost)}"]
        return join_tables(a, b, self.on, self.how), [f"Join: {self.how} {self.left} and {self.right} on {', '.join(self.on)}"]


class Sort(Operator):
    """One direction for all keys; nulls come last either way."""

    def __init__(self, by: str | list[str] = (), ascending: bool = True, **ignored):
        self.by, self.ascending = as_list(by), ascending

    def keys(self, df: DataFrame) -> list[Column]:
        return [_direction(c, self.ascending) for c in self.by if c in df.columns]

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        logs: list[str] = []
        if self.split(df, self.by, logs):
            by = [(c, self.ascending) for c in self.by if c in df.columns]
            # equal rows stay in the order they had
            df = df.orderBy(*self.keys(df), *order_keys(df))
            if ORDER in df.columns:
                by += _sorted(df)
                df = df.withMetadata(ORDER, {"sorted": [c for c, _ in by], "ascending": [up for _, up in by]})
            logs.append(f"Sort: {', '.join(self.by)} {'ascending' if self.ascending else 'descending'}")
        return df, logs


def _leaves(c: Column, kind: T.DataType) -> list[tuple[Column, bool]]:
    """A column as ascending keys: the parts of a struct, in order."""
    return [x for f in kind.fields for x in _leaves(c.getField(f.name), f.dataType)] if isinstance(kind, T.StructType) else [(c, True)]


class Limit(Operator):
    """Rows skip to skip + n of the current order. After a Sort it is one top-k plan; far down, the page's rows are found
    by rank first."""

    def __init__(self, n: int = 0, skip: int = 0, **ignored):
        self.n, self.skip = int(n), max(int(skip), 0)

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        logs = [f"Limit: {self.n} after {self.skip}"]
        keys = order_keys(df)
        if self.skip > ranks.SHALLOW and keys:
            last = _sorted(df)
            by = [(named(c), up) for c, up in last] if all(c in df.columns for c, _ in last) else []
            return ranks.page(df, [*by, *_leaves(named(ORDER), df.schema[ORDER].dataType)], self.skip, self.n), logs
        df = df.orderBy(*keys) if keys else df
        return (df.offset(self.skip) if self.skip else df).limit(self.n), logs


class RemoveFields(Operator):
    def __init__(self, columns: list[str] | None = None, **ignored):
        self.columns = as_list(columns)

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        logs: list[str] = []
        gone = self.split(df, self.columns, logs)
        return df.select(*[named(c) for c in df.columns if c not in gone]), [*logs, f"RemoveFields: {len(gone)} removed"]


def _widened(kind: T.DataType, value) -> T.DataType:
    """The type that holds a column's values and the constant: its own, a wider number, else text."""
    match kind:
        case T.NullType():
            return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(type(value), T.StringType())
        case T.BooleanType():
            return kind if isinstance(value, bool) else T.StringType()
        case T.IntegralType() if isinstance(value, int):
            bits = {"byte": 7, "short": 15, "integer": 31, "long": 63}[kind.typeName() if kind.typeName() in ("byte", "short", "integer") else "long"]
            return kind if -(1 << bits) <= value < 1 << bits else T.LongType() if -(1 << 63) <= value < 1 << 63 else T.DoubleType()
        case T.IntegralType() if isinstance(value, float):
            return kind if value.is_integer() and abs(value) < 1 << 31 else T.DoubleType()
        case T.DecimalType() if isinstance(value, int | float):
            exact = Decimal(str(value))
            whole = len(str(abs(int(exact))))
            return kind if -exact.as_tuple().exponent <= kind.scale and whole <= kind.precision - kind.scale else T.DoubleType()
        case T.FractionalType() if isinstance(value, int | float):
            return kind
        case T.DateType() | T.TimestampType() | T.TimestampNTZType() if isinstance(value, str | datetime.date):
            try:
                datetime.datetime.fromisoformat(str(value))
            except ValueError:
                return T.StringType()
            return kind
    return T.StringType()


def _filled(df: DataFrame, name: str, value) -> Column:
    """The column with a constant for its nulls, wider where its type can't hold the constant; lists and objects stay."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType | T.VariantType | T.BinaryType):
        return named(name)
    if isinstance(value, str) and isinstance(kind, T.NumericType):
        try:  # a number in text
            value = int(value) if value.strip().lstrip("+-").isdigit() else float(value)
        except ValueError:
            pass
    wide = _widened(kind, value)
    constant = F.lit(str(value)) if isinstance(wide, T.StringType) else F.lit(value).cast(wide)
    return F.coalesce(named(name).cast(wide), constant)


class FillNull(Operator):
    """fill_map (column -> value) wins over value (for all columns). A column turns
    wider where it has to: 0.5 makes whole numbers doubles, text makes numbers text."""

    def __init__(self, value=None, fill_map: dict | None = None, **ignored):
        self.value, self.fill_map = value, fill_map or {}

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        logs: list[str] = []
        if self.fill_map:
            plan = {c: self.fill_map[c] for c in self.split(df, list(self.fill_map), logs)}
        elif self.value is not None:
            plan = dict.fromkeys(visible(df), self.value)
        else:
            return df, ["FillNull: nothing to fill with"]
        return df.withColumns({c: _filled(df, c, v) for c, v in plan.items()}), [*logs, f"FillNull: {', '.join(plan)}"]


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "median": F.median,  # Group finds it by rank
}


class Group(Operator):
    """One aggregate for each named column, under the column's name, sorted by the
    keys. Rows with a null key are left out; the sum of nothing is 0. A median is found
    by rank, for which jobs run when the operator does; no group is held in one place."""

    def __init__(self, by: str | list[str] = (), aggs: dict[str, str] | None = None, **ignored):
        self.by, self.aggs = as_list(by), aggs or {}

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        logs: list[str] = []
        keys = self.split(df, self.by, logs)
        unknown = sorted({f for f in self.aggs.values() if f not in AGGREGATES})
        if unknown:
            return df, [*logs, f"ERROR Group: unknown function {', '.join(unknown)}"]
        columns = self.split(df, list(self.aggs), logs)
        texts = [c for c in columns if self.aggs[c] in ("sum", "mean", "std", "var", "median") and isinstance(df.schema[c].dataType, T.StringType)]
        if texts:
            return df, [*logs, f"ERROR Group: {', '.join(texts)} holds text"]
        if not keys or not columns:
            return df, [*logs, "WARNING Group: nothing to group"]
        # aggregates under other names first, as a key may be aggregated too
        rows, places = df.na.drop("any", subset=keys), list(enumerate(columns))
        medians = [(f"_agg_{i}", c) for i, c in places if self.aggs[c] == "median"]
        made = [AGGREGATES[self.aggs[c]](named(c)).alias(f"_agg_{i}") for i, c in places if self.aggs[c] != "median"]
        out = rows.groupBy(*map(named, keys)).agg(*made) if made else None
        if medians:
            names, values = zip(*medians, strict=True)
            found = ranks.percentiles(rows, keys, values, [0.5], names)
            found = found.select(*map(named, keys), *[F.get(n, F.lit(0)).alias(n) for n in names])
            out = found if out is None else out.join(found, keys)
        kept = [named(k) for k in keys if k not in columns]
        done = out.select(*kept, *[F.col(f"_agg_{i}").alias(c) for i, c in places])
        return (done.orderBy(*kept) if kept else done), [*logs, f"Group: by {', '.join(keys)}"]


class DropNull(Operator):
    """how any or all, over subset or all columns. A subset of which no column
    exists keeps all rows with any, none with all."""

    def __init__(self, how: str = "any", subset: list[str] | None = None, **ignored):
        self.how, self.subset = how, subset

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        logs: list[str] = []
        columns = visible(df) if self.subset is None else self.split(df, as_list(self.subset), logs)
        logs.append(f"DropNull: {self.how} of {', '.join(columns)}")
        if not columns:
            return (df if self.how == "any" else df.limit(0)), logs
        return df.na.drop(self.how, subset=columns), logs


class DropDuplicateColumns(Operator):
    """Drops the columns whose names end with a suffix, as joins make them."""

    def __init__(self, suffix: str = "_right", **ignored):
        self.suffix = suffix

    def run(self, df: DataFrame, inputs: Inputs = None) -> Outcome:
        gone = [c for c in df.columns if c.endswith(self.suffix)]
        return df.select(*[named(c) for c in df.columns if c not in gone]), [f"DropDuplicateColumns: {len(gone)} removed"]


REGISTRY: dict[str, type[Operator]] = {
    c.__name__: c for c in (Dedup, Filter, RenameFields, Map, Select, AddFields, Flat, Join, Sort, Limit, RemoveFields, FillNull, Group, DropNull, DropDuplicateColumns)
}


def operator(name: str) -> type[Operator] | None:
    return REGISTRY.get(name)


def operator_names() -> list[str]:
    return sorted(REGISTRY)
