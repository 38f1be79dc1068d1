"""Joins across sources: different key names, chains, aligned series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.operators.cleaning import HOWS, as_list, join_tables, named


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Without columns that hold only nulls, found in one aggregate."""
    if not df.columns:
        return df
    counts = df.agg(*[F.count(named(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[named(c) for i, c in enumerate(df.columns) if counts[f"c{i}"]])


def join_sources(left: DataFrame, right: DataFrame, left_on: str | list[str], right_on: str | list[str] | None = None, how: str = "inner", drop_empty: bool = True) -> DataFrame:
    """The right keys take the left ones' names; other clashing names get _left and _right."""
    a, b = as_list(left_on), as_list(right_on) or as_list(left_on)
    if how not in HOWS or len(a) != len(b):
        raise ValueError(f"can't join how={how} on {a} and {b}")
    missing = [c for c in a if c not in left.columns] + [c for c in b if c not in right.columns]
    if missing:
        raise ValueError(f"no key column {', '.join(missing)}")
    taken = {n: f"{n}_right" for n in a if n in right.columns and n not in b}
    out = join_tables(left, right.withColumnsRenamed(taken).withColumnsRenamed(dict(zip(b, a, strict=True))), a, how, ("_left", "_right"))
    return drop_all_null_columns(out) if drop_empty else out


def join_by_config(sources: list[DataFrame], config: dict) -> DataFrame:
    """config: left and right (indices, default 0 and 1), keys "l,r" or one name, how."""
    a, b = int(config.get("left", 0)), int(config.get("right", 1))
    if not (0 <= a < len(sources) and 0 <= b < len(sources)):
        raise ValueError(f"there are {len(sources)} sources, not {a} and {b}")
    keys = [k.strip() for k in str(config["keys"]).split(",")]
    return join_sources(sources[a], sources[b], keys[0], keys[-1], config.get("how", "inner"))


def join_chain(sources: list[DataFrame], keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """From left to right; keys has one pair (left, right) fewer than there are sources."""
    if len(keys) != len(sources) - 1:
        raise ValueError(f"{len(sources)} sources need {len(sources) - 1} key pairs")
    return reduce(lambda df, x: join_sources(df, x[0], *x[1], how=how, drop_empty=False), zip(sources[1:], keys, strict=True), sources[0])


def detect_join(left: DataFrame, right: DataFrame) -> tuple[str, str] | None:
    """The shared column with the largest share of its distinct left values found on the right."""
    shared = [c for c in left.columns if c in right.columns and left.schema[c].dataType == right.schema[c].dataType]
    if not shared:
        return None

    def values(df: DataFrame) -> DataFrame:
        """The distinct values of all shared columns, as (column number, text): one job for all."""
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), named(c).cast("string").alias("v")) for i, c in enumerate(shared)]))
        return df.select(each.alias("x")).select("x.*").where("v is not null").distinct()

    met = values(left).join(values(right).withColumn("met", F.lit(1)), ["i", "v"], "left")
    shares = {r.i: r.share for r in met.groupBy("i").agg(F.avg(F.coalesce("met", F.lit(0))).alias("share")).collect() if r.share}
    if not shares:
        return None
    best = shared[max(shares, key=lambda i: (shares[i], -i))]
    return best, best


def align_series(series: dict[str, DataFrame], x: str, y: str) -> DataFrame:
    """One row for each x of any series, one column for each series; null where it has none."""
    labelled = reduce(DataFrame.unionByName, [df.select(named(x).alias("x"), named(y).alias("y"), F.lit(n).alias("s")) for n, df in series.items()])
    return labelled.groupBy("x").pivot("s", list(series)).agg(F.first("y", ignorenulls=True))
