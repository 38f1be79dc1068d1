"""Rows by their rank, where one task could not hold a group or all rows before a page:
exact percentiles, moving averages, pages far down.

All of them sort by ranges, so that a key with most of the rows is in many partitions,
and number the rows: a row's place in its partition and the rows of the partitions
before (one count for each, prefix sums) give its rank. The sorted columns are written
once, as ranks must not change between the steps; so these operators run jobs when they
are called."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.session import written

RANK, BLOCK = "_rank_", "_block_"
#: Rows of one window of a moving average, besides those of the frame before.
BLOCK_ROWS = 1 << 16
#: Up to here a page is one top-k plan, which keeps all rows before the page in one task.
SHALLOW = 10_000


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """df sorted by keys, written, with RANK from 0 over all rows."""
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    rows = written(sorted_.select("*", F.shiftright(at, 33).cast("int").alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(parts, "_part").select(*map(named, df.columns), (F.col("_before") + F.col("_at")).alias(RANK))


def percentiles(df: DataFrame, by: Sequence[str], values: Sequence[str], shares: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """by, and for each value column (under `names`) a list with the exact percentile at each share (0 to 1), between two
    values by interpolation; nulls do not count, a column without values gives nulls. Null keys match each other. A group's
    values are never in one place: only those at the wanted ranks are picked."""
    keys = [f"_k{i}" for i in range(len(by))]
    held = [named(b).alias(k) for b, k in zip(by, keys, strict=True)]
    # one row for each value, so that all columns share the sort
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_column"), named(v).cast("double").alias("_value")) for i, v in enumerate(values)]))
    each = df.select(*held, cells.alias("_cell")).select(*keys, "_cell.*")
    ranked = numbered(each.where("_value is not null"), [*map(F.col, keys), F.col("_column"), F.col("_value")])
    groups = ranked.groupBy(*keys, "_column").agg(F.min(RANK).alias("_first"), F.count("*").alias("_n"))
    wanted = groups.select(*keys, "_column", "_first", F.posexplode(F.array(*[F.lit(float(s)) * (F.col("_n") - 1) for s in shares])).alias("_share", "_place"))
    wanted = wanted.withColumn(RANK, F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place"))))).withColumn(RANK, F.col("_first") + F.col(RANK))
    picked = ranked.select(RANK, "_value").join(wanted, RANK)
    low, high, place = F.min("_value"), F.max("_value"), F.first("_place")
    found = picked.groupBy(*keys, "_column", "_share").agg((low + (high - low) * (place - F.floor(place))).alias("_found"))
    lists = found.groupBy(*keys, "_column").agg(F.transform(F.array_sort(F.collect_list(F.struct("_share", "_found"))), lambda x: x["_found"]).alias("_list"))
    nothing = F.array_repeat(F.lit(None).cast("double"), len(shares))
    made = [F.any_value(F.when(F.col("_column") == i, F.col("_list")), True).alias(f"_v{i}") for i in range(len(values))]
    result = [F.coalesce(f"_v{i}", nothing).alias(v) for i, v in enumerate(names or values)]
    if not by:
        return lists.groupBy().agg(*made).select(*result)
    wide = lists.groupBy(*keys).agg(*made).withColumnsRenamed({k: f"_of{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys])
    return df.select(*held).distinct().join(wide, same, "left").select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], *result)


def moving_average(df: DataFrame, value: str, order: Sequence[str], rows: int, by: Sequence[str] = ()) -> DataFrame:
    """The mean of the last `rows` values in `order`, for each key of `by`. Windows are blocks of consecutive rows; each
    block also gets the rows - 1 rows before it, so that no task needs all rows of a key."""
    ranked = numbered(df, [named(c) for c in (*by, *order)])
    width = max(BLOCK_ROWS, rows)
    block = F.expr(f"{RANK} div {width}")
    halo = F.col(RANK) % width > width - rows
    copies = ranked.withColumn(BLOCK, F.explode(F.when(halo, F.array(block, block + 1)).otherwise(F.array(block))))
    window = Window.partitionBy(BLOCK, *map(named, by)).orderBy(RANK).rowsBetween(1 - rows, 0)
    done = copies.withColumn("moving_average", F.avg(named(value)).over(window))
    return done.where(F.col(BLOCK) == block).drop(BLOCK, RANK)


Key = tuple[Column, bool]


def _ordered(keys: list[Key]) -> list[Column]:
    return [c.asc_nulls_last() if up else c.desc_nulls_last() for c, up in keys]


def _after(keys: list[Key], values: Sequence, strict: bool) -> Column:
    """Rows that come after (or, unless strict, with) the row that has the values; nulls come last in both directions."""
    if not keys:
        return F.lit(not strict)
    (c, up), value = keys[0], values[0]
    rest = _after(keys[1:], values[1:], strict)
    if value is None:
        return c.isNull() & rest
    further = (c > F.lit(value)) if up else (c < F.lit(value))
    return c.isNull() | further | ((c == F.lit(value)) & rest)


def page(df: DataFrame, keys: list[Key], skip: int, n: int) -> DataFrame:
    """Rows skip to skip + n of df by keys (column, ascending). Far down, only the keys are sorted, by ranges: the keys at
    the page's first and last rank say which rows the page is made of, and only those are sorted."""
    if skip <= SHALLOW or n <= 0:
        return df.orderBy(*_ordered(keys)).offset(skip).limit(n)
    inner = [(F.col(f"_k{i}"), up) for i, (_, up) in enumerate(keys)]
    ranked = numbered(df.select(*[c.alias(f"_k{i}") for i, (c, _) in enumerate(keys)]), _ordered(inner))
    at = {r[RANK]: tuple(r)[:-1] for r in ranked.where(F.col(RANK).isin(skip, skip + n - 1)).collect()}
    if skip not in at:
        return df.limit(0)
    some = df.where(_after(keys, at[skip], strict=False))
    if skip + n - 1 in at:
        some = some.where(~_after(keys, at[skip + n - 1], strict=True))
    before = ranked.where(~_after(inner, at[skip], strict=False)).count()
    return some.orderBy(*_ordered(keys)).offset(skip - before).limit(n)
