"""Chart series: axes, units, shapes for charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.scalars import scale_of, unit_of
from tablesmith.operators import ranks
from tablesmith.operators.cleaning import named
from tablesmith.operators.joins import align_series

#: Chart types, names of the x axis in order, of the values, and of parts of a year.
CHARTS = ("Line", "Bar", "Scatter", "Pie", "Area", "Histogram", "Boxplot", "Heatmap", "Candlestick", "Radar", "Funnel", "Gauge", "Treemap", "WordCloud", "Graph", "Parallel", "Sankey", "ThemeRiver")
X_NAMES = ("年份", "时间", "year", "date")
Y_NAMES = ("数值", "value")
PARTS_OF_TIME = ("季度", "月份", "quarter", "month")


def chart_type(name: str) -> str:
    """A chart type in its own spelling; an unknown one is an error."""
    found = next((c for c in CHARTS if c.lower() == name.strip().lower()), None)
    if found is None:
        raise ValueError(f"no chart type {name!r}; there are {', '.join(CHARTS)}")
    return found


def pick_axes(df: DataFrame, x_names: Sequence[str] = X_NAMES, y_names: Sequence[str] = Y_NAMES) -> tuple[str, str] | None:
    """x: the first known name, else the first column; y: the value column, else the first other number that is no part of a year."""
    if not df.columns:
        return None
    x = next((n for n in x_names if n in df.columns), df.columns[0])
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != x and f.name not in PARTS_OF_TIME]
    y = next((n for n in y_names if n in df.columns and n != x), next(iter(numbers), None))
    return (x, y) if y else None


def xy_series(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, unit), sorted by x, y scaled to the unit of the largest value."""
    top = df.agg(F.max(named(y))).scalar()
    return df.select(named(x).alias("x"), (named(y) / scale_of(top)).alias("y"), unit_of(top).alias("unit")).orderBy(F.asc_nulls_last("x"))


def by_indicator(df: DataFrame, codes: Sequence[str], column: str = "indicator_code") -> dict[str, DataFrame]:
    """The rows of each indicator, in the order asked for; one without rows has an empty table."""
    return {c: df.where(named(column) == c) for c in codes}


def compared_series(series: dict[str, DataFrame], x: str, y: str) -> DataFrame:
    """All series under one unit, aligned on x."""
    wide = align_series(series, x, y)
    top = wide.agg(F.max(F.greatest(*[F.coalesce(named(s), F.lit(float("-inf"))) for s in series], F.lit(float("-inf"))))).scalar()
    return wide.select("x", *[(named(s) / scale_of(top)).alias(s) for s in series], unit_of(top).alias("unit")).orderBy("x")


def pairs(df: DataFrame, name: str, value: str) -> DataFrame:
    """Name and value sums, the largest first."""
    return df.groupBy(named(name).alias("name")).agg(F.sum(named(value)).alias("value")).orderBy(F.desc("value"), "name")


def radar(df: DataFrame, by: str, measures: Sequence[str]) -> DataFrame:
    """Means of several measures for each group, as one array."""
    return df.groupBy(named(by).alias("name")).agg(F.array(*[F.avg(named(m)) for m in measures]).alias("values")).orderBy("name")


def box_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Minimum, quartiles and maximum of each group, found by rank (jobs run when this is called)."""
    names = ("low", "q1", "median", "q3", "high")
    five = ranks.percentiles(df, [by], [value], [0.0, 0.25, 0.5, 0.75, 1.0], ["_five"])
    return five.select(named(by), *[F.get("_five", F.lit(i)).alias(n) for i, n in enumerate(names)])
