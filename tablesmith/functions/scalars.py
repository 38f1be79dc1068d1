"""Scalar functions of the cleaning rules and small helpers, all JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.exprs import nan_to_null, to_float

#: Tried in order by to_datetime.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "dd/MM/yyyy", "yyyy-MM", "yyyy")
#: The keys that the rule format's users know to be masked.
SENSITIVE = ("password", "passwd", "pwd", "secret", "api_key", "apikey", "token", "authorization", "access_token", "refresh_token", "private_key", "model_api_key")


def strip(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def to_int(c: Column) -> Column:
    """A long; NULL for what is no number. A fraction is an error, as it would lose digits."""
    value = to_float(c)
    return F.when(value == F.floor(value), value.cast("long")).when(value.isNotNull(), F.raise_error(F.concat(F.lit("not a whole number: "), value.cast("string"))).cast("long"))


def to_datetime(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Texts by the formats in turn, whole numbers as nanoseconds since 1970; NULL for what is neither. A bigint ends with the
    year 2262, a decimal without places goes further."""
    micros = lambda n: F.timestamp_micros(F.call_function("div", n, F.lit(1000).cast("bigint")))
    kind = F.typeof(c)
    whole = F.when(kind.isin("tinyint", "smallint", "int", "bigint"), micros(c.try_cast("bigint")))
    return whole.when(kind.rlike(r"^decimal\(\d+,0\)$"), micros(c.cast("string").try_cast("decimal(38,0)"))).otherwise(_parsed(c, formats))


def _parsed(c: Column, formats: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in formats])


MAP_FUNCTIONS = {
    "to_float": to_float,
    "to_int": to_int,
    "to_str": lambda c: c.cast("string"),
    "to_datetime": to_datetime,
    "strip": strip,
    "lower": lambda c: F.lower(c.cast("string")),
    "upper": lambda c: F.upper(c.cast("string")),
}


def comma_float(c: Column) -> Column:
    """A number with thousands separators and blanks."""
    return to_float(F.regexp_replace(c.cast("string"), r"[,\s]", ""))


def contains_cjk(c: Column) -> Column:
    return F.rlike(c, F.lit("[\\u4e00-\\u9fff]"))


def safe_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def identifier(c: Column, default: str = "column") -> Column:
    """Letters, digits and underscores; others become underscores, outer ones go."""
    name = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_"), "^_+|_+$", "")
    return F.when(F.length(name) > 0, name).otherwise(F.lit(default))


def period_label(year: Column, quarter: Column | None = None, month: Column | None = None) -> Column:
    if quarter is not None:
        return F.concat(year.cast("string"), F.lit("Q"), quarter.cast("string"))
    if month is not None:
        return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))
    return year.cast("string")


#: Divisor and name of the unit from each size on.
UNITS = ((1e12, "trillion"), (1e8, "hundred million"), (1e4, "ten thousand"))


def scale_of(largest: Column) -> Column:
    out = F.lit(1.0)
    for size, _ in reversed(UNITS):
        out = F.when(largest >= size, F.lit(size)).otherwise(out)
    return out


def unit_of(largest: Column) -> Column:
    out = F.lit("")
    for size, name in reversed(UNITS):
        out = F.when(largest >= size, F.lit(name)).otherwise(out)
    return out


def scaled(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds scaled_value and unit, by the largest value of the whole table or of each group."""
    if by:
        df, top = df.join(df.groupBy(*by).agg(F.max(value).alias("_top")), list(by)), F.col("_top")
        names = [c for c in df.columns if c != "_top"]
    else:
        names, top = df.columns, df.agg(F.max(value)).scalar()
    return df.select(*names, (F.col(value) / scale_of(top)).alias("scaled_value"), unit_of(top).alias("unit"))


def token_estimate(c: Column) -> Column:
    """Tokens of a text without a tokenizer: a third of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 3)).cast("long")


def fenced(c: Column, language: str = "") -> Column:
    """The first fenced block of a text (of a language, if given), else the text itself."""
    block = F.regexp_extract(c, r"(?s)```" + (language or r"[A-Za-z]*") + r"\s*\n(.*?)```", 1)
    return strip(F.when(F.length(block) > 0, block).otherwise(c))


def json_object(c: Column) -> Column:
    """The JSON of a text as text: that of a fenced block, of the part between the outer braces, or the whole; NULL for none."""
    block = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*\n(.*?)```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), strip(x))
    return F.coalesce(valid(block), valid(braces), valid(c))


def yaml_block(c: Column) -> Column:
    """The YAML of a text: that of a block fenced as YAML, of a fenced block, or the whole."""
    block = F.regexp_extract(c, r"(?si)```ya?ml\s*\n(.*?)```", 1)
    return F.when(F.length(block) > 0, strip(block)).otherwise(fenced(c))


def redacted(c: Column, kind: T.DataType | None = None, keys: Sequence[str] = SENSITIVE) -> Column:
    """The values of sensitive keys masked, at any depth of maps, objects and lists; kind: the column's type (a map of
    texts if not given)."""
    hidden = lambda k: F.lower(k).isin(list(keys))
    match kind:
        case None:
            return F.transform_values(c, lambda k, v: F.when(hidden(k), F.lit("***")).otherwise(v))
        case T.MapType(keyType=T.StringType(), valueType=T.StringType()):
            return redacted(c, None, keys)
        case T.MapType(keyType=T.StringType(), valueType=inner):
            # a masked value that is no text is left out, as a map has one type of values
            return F.transform_values(c, lambda k, v: F.when(~hidden(k), redacted(v, inner, keys)))
        case T.ArrayType(elementType=inner) if isinstance(inner, T.MapType | T.StructType | T.ArrayType):
            return F.transform(c, lambda v: redacted(v, inner, keys))
        case T.StructType(fields=fields):
            parts = [(F.lit("***") if f.name.lower() in keys else redacted(c.getField(f.name), f.dataType, keys)).alias(f.name) for f in fields]
            return F.when(c.isNotNull(), F.struct(*parts))
    return c


def redacted_table(df: DataFrame, keys: Sequence[str] = SENSITIVE) -> DataFrame:
    """The table with sensitive columns masked, and sensitive keys inside of the others."""
    return df.select(*[(F.lit("***") if f.name.lower() in keys else redacted(F.col(f"`{f.name}`"), f.dataType, keys)).alias(f.name) for f in df.schema.fields])


def null_nans(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in all floating columns: Spark compares NaN as a large number."""
    return df.withColumns({f.name: nan_to_null(F.col(f"`{f.name}`")) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})


def page_range(text: str, last: int) -> list[int]:
    """Pages of `all` or `1,3,5-10`, within 1 to last."""
    if text.strip().lower() == "all":
        return list(range(1, last + 1))
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, _, b = part.partition("-")
        found.update(range(int(a), int(b or a) + 1))
    return sorted(p for p in found if 1 <= p <= last)
