"""Series of statistics: records of a service as rows, small literal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions.scalars import period_label

RECORD = "struct<countryiso3code:string,country:struct<id:string,value:string>,indicator:struct<id:string,value:string>,date:string,value:double>"


def year_range(df: DataFrame, year: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of the years from first to last, both inclusive and optional."""
    df = df if first is None else df.where(F.col(year) >= first)
    return df if last is None else df.where(F.col(year) <= last)


def unit_of_code(code: Column) -> Column:
    """The unit of an indicator by its code; GDP comes first, even in codes of growth rates."""
    return F.when(F.contains(code, F.lit("GDP")), "USD").when(F.contains(code, F.lit("ZG")) | F.contains(code, F.lit("ZS")), "%").when(F.contains(code, F.lit("POP")), "people").otherwise("")


def macro_table(spark: SparkSession, rows: list[tuple], schema: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """A small literal table with a period label, within years (inclusive, each bound optional)."""
    df = spark.createDataFrame(rows, schema)
    df = year_range(df, "year", first, last)
    part = {c: F.col(c) for c in ("quarter", "month") if c in df.columns}
    return df.withColumn("period", period_label(F.col("year"), **part))


def indicator_rows(responses: DataFrame, body: str, source: str = "") -> DataFrame:
    """Rows of JSON lists of records, those without a value left out, by year: year, country_code, country, indicator_code,
    indicator_name, value, unit, source."""
    each = responses.select(F.inline(F.from_json(body, f"array<{RECORD}>")))
    found = each.where("value is not null").select(
        F.col("date").try_cast("int").alias("year"), F.col("countryiso3code").alias("country_code"), F.col("country.value").alias("country"), F.col("indicator.id").alias("indicator_code"),
        F.col("indicator.value").alias("indicator_name"), "value", unit_of_code(F.coalesce("indicator.id", F.lit(""))).alias("unit"), F.lit(source).alias("source"),
    )
    return found.orderBy("year", "country_code", "indicator_code")
