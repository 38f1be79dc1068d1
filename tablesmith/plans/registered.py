"""One registered query for each operator, with DuckDB SQL of the same meaning.

Tables without nulls get some in both (nullif, case), so that the rules about
nulls are put to the test. Doubles are rounded where the order of a sum shows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions import scalars as S
from tablesmith.functions.exprs import compile_condition, compile_expression
from tablesmith.operators import cleaning as C
from tablesmith.operators import conversations as L
from tablesmith.operators import joins as J
from tablesmith.operators import profile as P
from tablesmith.operators import ranks
from tablesmith.operators import retrieval as R
from tablesmith.operators import series as V
from tablesmith.operators.cleaning import ORDER
from tablesmith.plans import written as W
from tablesmith.plans.rules import RuleEngine
from tablesmith.session import java_charsets, package_on_workers, shared_dir
from tablesmith.sources import databases as D
from tablesmith.sources import files as I
from tablesmith.sources import macro as M
from tablesmith.sources import sinks as K
from tablesmith.sources import shaping as H
from tablesmith.sources.registry import Request, default_registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by name; get.orders reads orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        package_on_workers(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def run(op: C.Operator, df: DataFrame, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    return op.run(df, inputs)[0].drop(ORDER)


def money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


MONEY = "cast(sum(cast({} as decimal(18,2))) as double)"

# -- rule chains -------------------------------------------------------------

FLAGSHIP = """
inputs: {o: orders, c: customer, n: nation, r: region}
nodes:
  customers: {operator: Join, left: o, right: c, on: o_custkey, how: inner}
  year: {operator: AddFields, fields: {year: "str(row['o_orderdate'])[:4]"}}
  keep: {operator: Filter, condition: "row['o_totalprice'] > 1000 and row['r_name'] != 'NOWHERE'"}
  names: {operator: Select, columns: [r_name, year, o_totalprice]}
  total: {operator: Group, by: [r_name, year], aggs: {o_totalprice: sum}}
  order: {operator: Sort, by: [r_name, year]}
processor: {chain: [customers, year, keep, names, total, order]}
"""


@query(
    "sales_by_region",
    f"select r_name, substr(cast(o_orderdate as varchar), 1, 4) as year, {MONEY.format('o_totalprice')} as o_totalprice from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where o_totalprice > 1000 group by 1, 2",
)
def sales_by_region(t: Tables) -> DataFrame:
    places = J.join_chain([t.customer, t.nation, t.region], [("c_nationkey", "n_nationkey"), ("n_regionkey", "r_regionkey")])
    done = RuleEngine().execute(FLAGSHIP, t.orders, {"orders": t.orders, "customer": places.withColumnRenamed("c_custkey", "o_custkey"), "nation": t.nation, "region": t.region})
    if not done.success:
        raise ValueError(done.error)
    return done.df.withColumn("o_totalprice", F.round("o_totalprice", 2))


# -- cleaning ----------------------------------------------------------------


@query("dedup_full", "select distinct lang, source, text from documents")
def _(t):
    return run(C.Dedup(), t.documents.select("lang", "source", "text"))


@query("dedup_by", "select doc_id, text, lang from (select *, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1")
def _(t):
    return run(C.Dedup(by=["text"]), t.documents.select("doc_id", "text", "lang").withColumn(ORDER, F.col("doc_id")))


@query("filter_condition", "select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem where l_quantity > 20 and not l_discount = 0.05 and l_returnflag in ('A', 'R')")
def _(t):
    return run(C.Filter(condition="row['l_quantity'] > 20 and not row['l_discount'] == 0.05 and row['l_returnflag'] in ['A', 'R']"), t.lineitem).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def _holes(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), F.expr("case when o_orderkey % 3 = 0 then null else o_totalprice end").alias("price"))


HOLES = "(select o_orderkey, nullif(o_orderstatus, 'F') as status, case when o_orderkey % 3 = 0 then null else o_totalprice end as price from orders)"


@query("filter_drop_empty", f"select status, price from {HOLES} where not (status is null and price is null)")
def _(t):
    return run(C.Filter(drop_empty=True), _holes(t).select("status", "price"))


@query("filter_drop_null", f"select * from {HOLES} where status is not null and price is not null")
def _(t):
    return run(C.Filter(drop_null=True), _holes(t))


@query("rename_fields", "select n_nationkey as id, n_name as name, n_regionkey from nation")
def _(t):
    return run(C.RenameFields({"n_nationkey": "id", "missing": "x"}, n_name="name"), t.nation)


@query("map_to_float", "select event_id, try_cast(json_extract_string(props, '$.k') as double) as k from events")
def _(t):
    return run(C.Map("k", "to_float"), t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")))


@query("map_to_int", "select part.p_partkey, cast(p_size as bigint) as p_size from part")
def _(t):
    return run(C.Map("p_size", "to_int"), t.part.select("p_partkey", F.col("p_size").cast("string").alias("p_size")))


@query("map_to_str", "select o_orderkey, cast(o_orderkey as varchar) as key from orders")
def _(t):
    return run(C.Map("key", "to_str"), t.orders.select("o_orderkey", F.col("o_orderkey").alias("key")))


@query("map_to_datetime", "select o_orderkey, cast(o_orderdate as timestamp) as day from orders")
def _(t):
    return run(C.Map("day", "to_datetime"), t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("map_to_datetime_numbers", "select event_id, event_id * 86400000000 + 5 as micros from events")
def _(t):
    """A day for each id: past 106,751 days the nanoseconds are more than a long holds."""
    nanos = t.events.select("event_id", (F.col("event_id").cast("decimal(20,0)") * 86_400_000_000_000 + 5_999).alias("ts"))
    return run(C.Map("ts", "to_datetime"), nanos).select("event_id", F.unix_micros("ts").alias("micros"))


@query("map_int_and_round", "select event_id, cast(trunc((event_id - 500) / 2.0) as bigint) as cut, cast(round_even((event_id - 500) / 2.0, 0) as bigint) as near from events")
def _(t):
    half = t.events.select("event_id", ((F.col("event_id") - 500) / 2).alias("half"))
    return run(C.AddFields({"cut": "int(row['half'])", "near": "round(row['half'])"}), half).drop("half")


@query("sort_then_limit", "select o_orderkey, o_orderstatus from orders order by o_orderstatus desc, o_orderkey limit 30")
def _(t):
    ordered = t.orders.select("o_orderkey", "o_orderstatus").withColumn(ORDER, F.col("o_orderkey"))
    return run(C.Limit(30), C.Sort("o_orderstatus", ascending=False).run(ordered)[0])


@query("dedup_after_sort", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders) where rn = 1")
def _(t):
    ordered = t.orders.select("o_custkey", "o_orderkey", "o_orderdate").withColumn(ORDER, F.col("o_orderkey"))
    return run(C.Dedup("o_custkey"), C.Sort("o_orderdate", ascending=False).run(ordered)[0]).drop("o_orderdate")


@query("map_strip", "select c_custkey, c_name as name from customer")
def _(t):
    return run(C.Map("name", "strip"), t.customer.select("c_custkey", F.concat(F.lit(" \t"), "c_name", F.lit("\n ")).alias("name")))


@query("map_lower", "select c_custkey, lower(c_mktsegment) as seg from customer")
def _(t):
    return run(C.Map("seg", "lower"), t.customer.select("c_custkey", F.col("c_mktsegment").alias("seg")))


@query("map_upper", "select p_partkey, upper(p_name) as p_name from part")
def _(t):
    return run(C.Map("p_name", "upper"), t.part.select("p_partkey", "p_name"))


@query("map_expr", "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", F.lit(0.0).alias("net"))
    return run(C.Map("net", expr="round(row['l_extendedprice'] * (1 - row['l_discount']), 4)"), df).select("l_orderkey", "l_linenumber", "net")


@query("select_columns", "select s_name, s_suppkey from supplier")
def _(t):
    return run(C.Select(["s_name", "none", "s_suppkey"]), t.supplier)


@query("add_fields", "select o_orderkey, substr(cast(o_orderdate as varchar), 1, 4) as year, substr(cast(o_orderdate as varchar), 6, 2) as month, round(o_totalprice / 1000, 6) as thousands, case when o_totalprice > 100000 then 'big' else 'small' end as size from orders")
def _(t):
    fields = {"year": "str(row['o_orderdate'])[:4]", "month": "str(row['o_orderdate'])[5:7]", "thousands": "round(row['o_totalprice'] / 1000, 6)", "size": "'big' if row['thousands'] > 100 else 'small'", "bad": "__import__('os')"}
    return run(C.AddFields(fields), t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")).select("o_orderkey", "year", "month", "thousands", "size")


@query("flat_array", "select p_partkey, word from part left join lateral (select unnest(case when p_partkey % 7 = 0 then null else string_split(p_name, ' ') end) as word) on true")
def _(t):
    words = F.when(F.col("p_partkey") % 7 != 0, F.split("p_name", " "))
    return run(C.Flat("words", "word"), t.part.select("p_partkey", words.alias("words")))


@query("flat_json", "select event_id, v from events left join lateral (select unnest(case when event_id % 2 = 0 then [event_type, cast(user_id as varchar)] else [event_type] end) as v) on true")
def _(t):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["'), "event_type", F.lit('", "'), "user_id", F.lit('"]'))).otherwise(F.col("event_type"))
    return run(C.Flat("v"), t.events.select("event_id", text.alias("v")))


@query("remove_fields", "select s_suppkey, s_acctbal from supplier")
def _(t):
    return run(C.RemoveFields(["s_name", "s_nationkey", "none"]), t.supplier)


@query("fill_null", f"select o_orderkey, coalesce(status, '0') as status, coalesce(price, 0) as price from {HOLES}")
def _(t):
    return run(C.FillNull(value=0), _holes(t))


@query("fill_null_map", f"select o_orderkey, coalesce(status, 'none') as status, price from {HOLES}")
def _(t):
    return run(C.FillNull(value=0, fill_map={"status": "none", "missing": 1}), _holes(t))


_WIDE = "(select o_orderkey, case when o_orderkey % 3 = 0 then null else o_custkey end as whole, case when o_orderkey % 5 = 0 then null else o_custkey end as again from orders)"


@query("fill_null_wider", f"select o_orderkey, coalesce(cast(whole as double), 0.5) as whole, coalesce(cast(again as varchar), 'none') as again from {_WIDE}")
def _(t):
    holes = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("whole"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("again"))
    return run(C.FillNull(fill_map={"whole": 0.5, "again": "none"}), holes)


@query("drop_null_any", f"select * from {HOLES} where status is not null and price is not null")
def _(t):
    return run(C.DropNull(), _holes(t))


@query("drop_null_all", f"select status, price from {HOLES} where status is not null or price is not null")
def _(t):
    return run(C.DropNull("all"), _holes(t).select("status", "price"))


@query("drop_null_subset", f"select * from {HOLES} where price is not null")
def _(t):
    return run(C.DropNull(subset=["price", "missing"]), _holes(t))


@query("drop_dup_columns", "select a.n_nationkey, a.n_name, a.n_regionkey from nation a")
def _(t):
    return run(C.DropDuplicateColumns(), C.join_tables(t.nation, t.nation, ["n_nationkey"]))


@query("drop_all_null_columns", "select r_regionkey, r_name from region")
def _(t):
    return J.drop_all_null_columns(t.region.withColumn("nothing", F.lit(None).cast("string")))


@query("range_filter", "select o_orderkey, cast(year(o_orderdate) as bigint) as year from orders where year(o_orderdate) between 1994 and 1996")
def _(t):
    return t.orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("year")).transform(M.year_range, "year", 1994, 1996)


@query("redact_map", "select event_id, '***' as token, '***' as pwd, event_type as kind from events")
def _(t):
    masked = S.redacted(F.create_map(F.lit("Token"), F.lit("abc"), F.lit("kind"), F.col("event_type"), F.lit("PWD"), F.lit("x")))
    return t.events.select("event_id", masked.alias("m")).select("event_id", F.col("m")["Token"].alias("token"), F.col("m")["PWD"].alias("pwd"), F.col("m")["kind"].alias("kind"))


@query("redact_nested", "select event_id, '***' as access_token, '***' as refresh_token, event_type as kind, '***' as model_api_key, user_id as id from events")
def _(t):
    deep = F.struct(F.col("event_type").alias("access_token"), F.array(F.struct(F.lit("r").alias("refresh_token"), F.col("event_type").alias("kind"))).alias("list"), F.struct(F.lit("k").alias("model_api_key"), F.col("user_id").alias("id")).alias("inner"))
    masked = S.redacted_table(t.events.select("event_id", deep.alias("d")))
    return masked.select("event_id", "d.access_token", F.col("d.list")[0]["refresh_token"].alias("refresh_token"), F.col("d.list")[0]["kind"].alias("kind"), "d.inner.model_api_key", "d.inner.id")


# -- joins -------------------------------------------------------------------

_LEFT = "(select l_orderkey, nullif(l_linenumber, 1) as k, l_quantity as v from lineitem)"
_RIGHT = "(select nullif(r_regionkey, 1) as k, r_name as v from region)"


def _sides(t: Tables) -> dict[str, DataFrame]:
    left = t.lineitem.select("l_orderkey", F.nullif("l_linenumber", F.lit(1)).alias("k"), F.col("l_quantity").alias("v"))
    return {"a": left, "b": t.region.select(F.nullif("r_regionkey", F.lit(1)).alias("k"), F.col("r_name").alias("v"))}


def _join_query(how: str, sql_how: str, key: str):
    @query(f"join_{how}", f"select l_orderkey, {key} as k, a.v as v, b.v as v_right from {_LEFT} a {sql_how} join {_RIGHT} b on a.k is not distinct from b.k")
    def _(t):
        return run(C.Join("a", "b", "k", how), t.region, _sides(t))


for _how, _sql, _key in (("inner", "inner", "a.k"), ("left", "left", "a.k"), ("right", "right", "b.k"), ("outer", "full", "coalesce(a.k, b.k)")):
    _join_query(_how, _sql, _key)


@query("join_multi_key", "select a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_quantity as l_quantity_right from lineitem a join (select * from lineitem where l_quantity > 25) b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber")
def _(t):
    cols = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return run(C.Join("a", "b", ["l_orderkey", "l_linenumber"], "inner"), cols, {"a": cols, "b": cols.where("l_quantity > 25")})


@query("join_diff_keys", "select n_nationkey, n_name, n_regionkey, r_name from nation join region on n_regionkey = r_regionkey")
def _(t):
    return J.join_sources(t.nation, t.region.withColumn("note", F.lit(None).cast("string")), "n_regionkey", "r_regionkey")


@query("join_by_config", "select s_suppkey, s_name, s_nationkey, s_acctbal, n_name, n_regionkey from supplier left join nation on s_nationkey = n_nationkey")
def _(t):
    return J.join_by_config([t.supplier, t.nation], {"left": 0, "right": 1, "keys": "s_nationkey,n_nationkey", "how": "left"})


@query("join_chain", "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def _(t):
    return J.join_chain([t.customer, t.nation, t.region], [("c_nationkey", "n_nationkey"), ("n_regionkey", "r_regionkey")]).select("c_custkey", "n_name", "r_name")


@query("series_align", "select x, max(case when s = 'F' then y end) as \"F\", max(case when s = 'O' then y end) as \"O\" from (select cast(day(o_orderdate) as bigint) as x, o_orderstatus as s, count(*) as y from orders where o_orderstatus in ('F', 'O') and (o_orderstatus = 'F' or day(o_orderdate) < 20) group by 1, 2) group by x")
def _(t):
    days = t.orders.groupBy(F.day("o_orderdate").cast("long").alias("x"), "o_orderstatus").agg(F.count("*").alias("y"))
    return J.align_series({"F": days.where("o_orderstatus = 'F'"), "O": days.where("o_orderstatus = 'O' and x < 20")}, "x", "y")


# -- aggregates --------------------------------------------------------------

_G = "(select nullif(l_linenumber, 3) as g, l_returnflag as f, case when l_linenumber = 2 then null else l_quantity end as q, l_quantity as w from lineitem)"


def _grouped(t: Tables) -> DataFrame:
    return t.lineitem.select(F.nullif("l_linenumber", F.lit(3)).alias("g"), F.col("l_returnflag").alias("f"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("q"), F.col("l_quantity").alias("w"))


for _func, _sql in {"sum": "coalesce(sum(q), 0)", "mean": "round(avg(q), 4)", "min": "min(q)", "max": "max(q)", "count": "count(q)", "std": "round(stddev_samp(q), 6)", "var": "round(var_samp(q), 5)", "median": "median(q)"}.items():

    def _group_query(func: str, sql: str):
        digits = {"mean": 4, "std": 6, "var": 5}.get(func)

        @query(f"group_{func}", f"select g, {sql} as q from {_G} where g is not null group by g")
        def _(t):
            out = run(C.Group("g", {"q": func}), _grouped(t))
            return out.withColumn("q", F.round("q", digits)) if digits else out

    _group_query(_func, _sql)


@query("group_multi", f"select g, f, sum(w) as w, count(q) as q from {_G} where g is not null group by g, f")
def _(t):
    return run(C.Group(["g", "f", "none"], {"w": "sum", "q": "count"}), _grouped(t))


@query("column_stats", "select 'l_quantity' as name, min(l_quantity) as low, max(l_quantity) as high, round(avg(l_quantity), 4) as mean from lineitem union all select 'l_tax', min(l_tax), max(l_tax), round(avg(l_tax), 4) from lineitem")
def _(t):
    p = P.profile(t.lineitem.select("l_quantity", "l_tax"))
    return t.spark.createDataFrame([(c.name, c.least, c.most, c.mean) for c in p.columns], "name string, low double, high double, mean double").withColumn("mean", F.round("mean", 4))


@query("profile", f"select 'status' as name, 'string' as kind, count(*) - count(status) as nulls, count(distinct status) as distinct_values from {HOLES} union all select 'price', 'float', count(*) - count(price), count(distinct price) from {HOLES}")
def _(t):
    p = P.profile(_holes(t).select("status", "price"), exact=True)
    return t.spark.createDataFrame([(c.name, c.kind, c.nulls, c.distinct) for c in p.columns], "name string, kind string, nulls long, distinct_values long")


@query("distinct_counts", "select count(distinct lang) as lang, count(distinct source) as source, count(distinct text) as text from documents")
def _(t):
    found = {c.name: c.distinct for c in P.profile(t.documents.select("lang", "source", "text"), exact=True).columns}
    return t.spark.createDataFrame([tuple(found.values())], ", ".join(f"{c} long" for c in found))


@query("null_profile", f"select round(avg(case when status is null then 1.0 else 0.0 end), 6) as status, round(avg(case when price is null then 1.0 else 0.0 end), 6) as price from {HOLES}")
def _(t):
    p = {c.name: c.null_rate for c in P.profile(_holes(t)).columns}
    return t.spark.createDataFrame([(round(p["status"], 6), round(p["price"], 6))], "status double, price double")


@query("dup_rate", "select round(1 - (select count(*) from (select distinct lang, text from documents)) / count(*), 6) as rate from documents")
def _(t):
    return t.spark.createDataFrame([(round(P.duplicate_rate(t.documents.select("lang", "text")), 6),)], "rate double")


@query("mixed_types", "select kind, count(*) as n from (select case when event_id % 3 = 0 then 'int' when event_id % 3 = 1 then 'text' else 'float' end as kind from events) group by kind")
def _(t):
    text = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".5")))
    return t.events.select(P.value_kind(text).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("has_empty_rows", f"select bool_or(status is null and price is null) as has_empty from {HOLES}")
def _(t):
    return t.spark.createDataFrame([(P.profile(_holes(t).select("status", "price")).empty_rows,)], "has_empty boolean")


@query("quality_gate", f"select 'nulls' as issue, 'price' as \"column\" from {HOLES} having avg(case when price is null then 1.0 else 0.0 end) > 0.05 union all select 'nulls', 'status' from {HOLES} having avg(case when status is null then 1.0 else 0.0 end) > 0.05 union all select 'duplicates', '' union all select 'empty_rows', ''")
def _(t):
    found = P.issues(P.profile(_holes(t).select("status", F.floor("price").alias("price"))))
    return t.spark.createDataFrame([(x["issue"], x["column"]) for x in found], "issue string, `column` string")


_ROLES = {"id": "o_orderkey", "uuid": "o_custkey", "update_count": "o_custkey", "birthday": "o_orderstatus", "seen": "o_orderdate", "price": "o_totalprice", "status": "o_orderstatus"}


@query(
    "semantic_roles",
    " union all ".join(
        f"select '{name}' as name, case when any_value(typeof({c})) like 'TIMESTAMP%' or regexp_matches('{name}', 'date|time|year|month|day|quarter') then 'time' when '{name}' in ('id', '_id', 'pk', 'primary_key', 'key', 'uuid') and count(distinct {c}) = count(*) then 'id' when any_value(typeof({c})) in ('BIGINT', 'DOUBLE') then 'measure' else 'dimension' end as role from orders"
        for name, c in _ROLES.items()
    ),
)
def _(t):
    named = t.orders.select(*[F.col(c).alias(n) for n, c in _ROLES.items()])
    return t.spark.createDataFrame(list(P.semantic_hints(P.profile(named))["roles"].items()), "name string, role string")


@query("semantic_patterns", "select unnest(['time_series', 'categorical_comparison', 'multi_measure']) as pattern")
def _(t):
    hints = P.semantic_hints(P.profile(t.orders))
    return t.spark.createDataFrame([(x,) for x in hints["patterns"]], "pattern string")


@query("mixed_columns", "select unnest(['v', 'tags']) as name")
def _(t):
    text = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    p = P.profile(t.events.select("event_id", text.alias("v"), F.col("user_id").cast("string").alias("n"), F.array("event_type").alias("tags")))
    return t.spark.createDataFrame([(c.name,) for c in p.columns if P.mixed(c.kinds)], "name string")


@query("row_total", "select (select count(*) from orders) + (select count(*) from part) + (select count(*) from nation) as n")
def _(t):
    return t.spark.createDataFrame([(P.row_total({"a": t.orders, "b": t.part, "c": t.nation}),)], "n long")


@query("profile_text", "select 'rows: ' || cast(count(*) as varchar) as line from nation union all select 'columns: 3' union all select '  duplicate rate: 0.0%'")
def _(t):
    lines = P.profile_text(P.profile(t.nation), "nation").split("\n")
    return t.spark.createDataFrame([(x,) for x in lines if x.startswith(("rows:", "columns: ", "  duplicate"))], "line string")


@query("sample_values", "with e as (select event_id, case when event_id % 97 = 96 then event_type end as rare, user_id from events) select 'rare' as name, string_agg(rare, ',' order by event_id) as firsts from (select * from e where rare is not null order by event_id limit 5) union all select 'user_id', string_agg(cast(user_id as varchar), ',' order by event_id) from (select * from e where user_id is not null order by event_id limit 5)")
def _(t):
    rows = t.events.select(F.col("event_id").alias(ORDER), F.when(F.col("event_id") % 97 == 96, F.col("event_type")).alias("rare"), "user_id")
    return t.spark.createDataFrame([(c.name, ",".join(c.samples)) for c in P.profile(rows).columns], "name string, firsts string")


@query("box_summary", "select o_orderstatus, quantile_cont(o_totalprice, 0.0) as low, round(quantile_cont(o_totalprice, 0.25), 4) as q1, round(quantile_cont(o_totalprice, 0.5), 4) as median, round(quantile_cont(o_totalprice, 0.75), 4) as q3, quantile_cont(o_totalprice, 1.0) as high from orders group by o_orderstatus")
def _(t):
    five = V.box_summary(t.orders, "o_orderstatus", "o_totalprice")
    return five.select("o_orderstatus", "low", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "high")


@query("moving_average", "select event_id, round(avg(value) over (partition by event_type order by ts, event_id rows between 4 preceding and current row), 4) as moving_average from events")
def _(t):
    return ranks.moving_average(t.events, "value", ["ts", "event_id"], 5, ["event_type"]).select("event_id", F.round("moving_average", 4).alias("moving_average"))


@query("moving_average_all", "select event_id, round(avg(value) over (order by ts, event_id rows between 9 preceding and current row), 4) as moving_average from events")
def _(t):
    return ranks.moving_average(t.events, "value", ["ts", "event_id"], 10).select("event_id", F.round("moving_average", 4).alias("moving_average"))


@query("hot_group_median", "select case when l_orderkey % 10 < 9 then 0 else l_linenumber end as k, round(quantile_cont(l_extendedprice, 0.5), 4) as l_extendedprice, count(l_quantity) as l_quantity, round(quantile_cont(nullif(l_discount, 0.05), 0.5), 4) as discount from lineitem group by 1")
def _(t):
    """Most rows in one group."""
    rows = t.lineitem.select(F.when(F.col("l_orderkey") % 10 < 9, 0).otherwise(F.col("l_linenumber")).alias("k"), "l_extendedprice", "l_quantity", F.nullif("l_discount", F.lit(0.05)).alias("discount"))
    done = run(C.Group(by=["k"], aggs={"l_extendedprice": "median", "l_quantity": "count", "discount": "median"}), rows)
    return done.select("k", F.round("l_extendedprice", 4).alias("l_extendedprice"), "l_quantity", F.round("discount", 4).alias("discount"))


@query("percentiles_all", "select round(quantile_cont(l_extendedprice, 0.01), 4) as low, round(quantile_cont(l_extendedprice, 0.99), 4) as high from lineitem")
def _(t):
    found = ranks.percentiles(t.lineitem, [], ["l_extendedprice"], [0.01, 0.99])
    return found.select(*[F.round(F.get("l_extendedprice", F.lit(i)), 4).alias(n) for i, n in enumerate(("low", "high"))])


@query("cost_rollup", "select 'm-' || role as model, cast(sum(greatest(1, length(text) // 3)) as bigint) as tokens, round(sum(greatest(1, length(text) // 3)) * case role when 'user' then 3.0 else 1.5 end / 1e6, 9) as cost from conversations group by role")
def _(t):
    prices = t.spark.createDataFrame([("m-", 1.5), ("m-us", 3.0), ("m-user-long", 9.0)], "name string, price double")
    used = t.conversations.select(F.concat(F.lit("m-"), "role").alias("model"), S.token_estimate(F.col("text")).alias("tokens"))
    return L.cost_rollup(used, prices, 2.0).withColumn("cost", F.round("cost", 9))


# -- order, limits, unions ---------------------------------------------------


@query("sort_asc", f"select * from {HOLES} order by price asc nulls last, o_orderkey")
def _(t):
    return run(C.Sort(["price", "o_orderkey"]), _holes(t))


@query("sort_desc", f"select * from {HOLES} order by status desc nulls last")
def _(t):
    return run(C.Sort("status", ascending=False), _holes(t))


@query("limit_skip", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 25 offset 10")
def _(t):
    return run(C.Limit(25, 10), run(C.Sort("o_orderkey"), t.orders.select("o_orderkey", "o_totalprice")))


@query("top_k", f"select * from {HOLES} order by price desc nulls last, o_orderkey desc limit 10")
def _(t):
    return run(C.Limit(10), run(C.Sort(["price", "o_orderkey"], ascending=False), _holes(t)))


@query("paged_listing", "select conv_id, turn, length(text) as size from conversations order by conv_id * 1000 + turn desc limit 20 offset 40")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("size"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"))
    return L.paged(rows, "o", 20, 40).drop("o")


@query("deep_page", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey desc, l_linenumber desc limit 300 offset 40000")
def _(t):
    """Rows past half the table at sf 0.01."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    keys = [(F.col(c), False) for c in ("l_extendedprice", "l_orderkey", "l_linenumber")]
    return ranks.page(rows, keys, 40_000, 300)


@query("union_fuzzy", "select c_custkey as id, c_name as name, c_acctbal as balance, 'customer' as source_file from customer union all select s_suppkey, s_name, s_acctbal, 'supplier' from supplier")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.col("s_acctbal").alias("Balances"), F.col("s_suppkey").alias("ID"), F.col("s_name").alias("Name"))
    return H.fuzzy_union({"customer": a, "supplier": b})


# -- scans and shaping -------------------------------------------------------


@query("scan_parquet", "select * from region")
def _(t):
    return t.region


def _scratch(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_csv", "select n_nationkey, n_name, n_regionkey from nation")
def _(t):
    path = _scratch(t, "csv")
    t.nation.write.option("header", True).option("sep", ";").csv(path)
    return I.read_csv(t.spark, path)


@query("scan_json", "select r_regionkey as key, r_name as names_name from region")
def _(t):
    path = _scratch(t, "json")
    rows = t.region.select(F.struct(F.col("r_regionkey").alias("key"), F.struct(F.col("r_name").alias("name")).alias("names")).alias("e"))
    rows.agg(F.to_json(F.struct(F.collect_list("e").alias("rows"))).alias("value")).coalesce(1).write.text(path)
    return H.flatten(I.read_json(t.spark, path)).drop("_jsonl_row_idx").withColumn("key", F.col("key").cast("int"))


@query("scan_jsonl", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(t):
    path = _scratch(t, "jsonl")
    t.events.select(F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "p": '), "props", F.lit("}\n"))).write.text(path)
    return I.read_jsonl(t.spark, path).select("event_id", "p.k")


@query("bad_json_lines", "select event_id + 1 as line from events where event_id % 100 = 7")
def _(t):
    path = _scratch(t, "bad")
    text = F.when(F.col("event_id") % 100 == 7, F.lit("{bad")).otherwise(F.col("props"))
    t.events.coalesce(1).sortWithinPartitions("event_id").select(text).write.text(path)
    return I.bad_lines(t.spark, path).select("line")


@query("scan_csv_separators", "select n_nationkey, n_name, 1 as kind from nation union all select n_nationkey, n_name, 2 from nation union all select n_nationkey, n_name, 3 from nation")
def _(t):
    parts = []
    for i, sep in enumerate((",", "\t", ";"), 1):
        path = _scratch(t, "csv")
        t.nation.select("n_nationkey", "n_name").write.option("header", True).option("sep", sep).csv(path)
        parts.append(I.read_csv(t.spark, path).withColumn("kind", F.lit(i)))
    return parts[0].union(parts[1]).union(parts[2])


CELL = "chr(34) || source || chr(34) || ',;' || chr(13) || chr(10) || text || chr(10) || chr(34) || lang"


@query("scan_csv_line_breaks", f"select doc_id, {CELL} as cell, 'a ' || chr(34) || 'b' || chr(34) as other from documents")
def _(t):
    """Cells with line breaks, quotes and separators: the whole texts of `documents` among them. A file for each partition,
    which is read in as many splits as it has."""
    path = _scratch(t, "csv")
    cell = F.concat(F.lit('"'), "source", F.lit('",;\r\n'), "text", F.lit('\n"'), "lang")
    W.csv_files(t.documents.select("doc_id", cell.alias("cell"), F.lit('a "b"').alias("other")), path)
    return I.read_csv(t.spark, f"{path}/*").withColumn("doc_id", F.col("doc_id").cast("long"))


def _unlike_files(t: Tables) -> DataFrame:
    """A folder of few rows before one of many, both out of the order of keys; each is sorted by ranges, its files by name."""
    root, small = _scratch(t, "unlike"), F.col("o_orderkey") % 40 == 0
    rows = t.orders.select("o_orderkey", "o_custkey")
    rows.where(small).orderBy(F.desc("o_orderkey")).write.option("header", True).csv(f"{root}/a")
    rows.where(~small).orderBy("o_orderkey").write.option("header", True).csv(f"{root}/b")
    return I.read_csv(t.spark, f"{root}/*", ordered=True)


UNLIKE = "(select o_orderkey, o_custkey, row_number() over (order by o_orderkey % 40 <> 0, case when o_orderkey % 40 = 0 then -o_orderkey else o_orderkey end) as nth from orders)"


@query("keep_first_of_files", f"select arg_min(o_orderkey, nth) as o_orderkey, o_custkey from {UNLIKE} group by o_custkey")
def _(t):
    return run(C.Dedup(by=["o_custkey"]), _unlike_files(t)).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"))


@query("limit_of_files", f"select o_orderkey, o_custkey from {UNLIKE} where nth > 7 and nth <= 507")
def _(t):
    return run(C.Limit(500, 7), _unlike_files(t)).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"))


@query("scan_json_list", "select event_id, event_type, user_id, value, cast(json_extract_string(props, '$.k') as bigint) as k, row_number() over (order by event_id) - 1 as nth from events")
def _(t):
    """One list in one file, its elements with strings that hold JSON."""
    path = f"{_scratch(t, 'list')}/events.json"
    rows = t.events.orderBy("event_id").select(F.to_json(F.struct("event_id", "event_type", "user_id", "value", "props")))
    W.json_list(rows, path)
    df = I.read_json(t.spark, path, ordered=True)
    return df.select("event_id", "event_type", "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col(ORDER)["row"].alias("nth"))


@query("scan_zip", f"select doc_id, {CELL} as cell, 'cells' as source_file from documents union all select n_nationkey, n_name, 'nations' from nation")
def _(t):
    """An archive of tables, one for each partition of `documents` and one of nations; line breaks in cells stay. Members of
    one name are told apart by a number behind it."""
    root = _scratch(t, "zip")
    cell = F.concat(F.lit('"'), "source", F.lit('",;\r\n'), "text", F.lit('\n"'), "lang")
    W.csv_files(t.documents.select("doc_id", cell.alias("cell")), f"{root}/in", "cells")
    W.csv_files(t.nation.select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("cell")).coalesce(1), f"{root}/in/n", "nations")
    files = {x.partition("/in/")[2]: x for x in I.list_files(t.spark, f"{root}/in")}
    nations = files["n/00000/nations.csv"]
    W.archive(t.spark, {**{f"in/{n}": x for n, x in files.items()}, "__MACOSX/x.csv": nations, "in/.y.csv": nations}, f"{root}/all.zip")
    union = I.read_zip_tables(t.spark, f"{root}/all.zip")["union"].drop(ORDER)
    return union.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("source_file", F.regexp_replace("source_file", r"_\d+$", ""))


@query("scan_zip_parquet", "select o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def _(t):
    """Types of a Parquet member are its own."""
    root = _scratch(t, "zip")
    t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day")).coalesce(1).write.parquet(f"{root}/p")
    W.archive(t.spark, {"orders.parquet": next(x for x in I.list_files(t.spark, f"{root}/p"))}, f"{root}/all.zip")
    df = I.read(t.spark, f"{root}/all.zip", ordered=False)
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))  # fails unless it is a date


@query("scan_excel", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as day, o_totalprice > 100000 as large from orders")
def _(t):
    """A folder of workbooks: a sheet has room for a million rows only."""
    path = _scratch(t, "book")
    W.workbooks(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") > 100000).alias("large")), path)
    return I.read(t.spark, f"{path}/*.xlsx", ordered=False).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("scan_csv_encoding", "select p_partkey, p_name || '月份' as name from part")
def _(t):
    path = _scratch(t, "gbk")
    java_charsets(t.spark)
    t.part.select("p_partkey", F.concat("p_name", F.lit("月份")).alias("name")).write.option("header", True).option("encoding", "gbk").csv(path)
    return I.read_csv(t.spark, path).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("scan_markdown", "select n_name || chr(10) as text from nation")
def _(t):
    path = _scratch(t, "md")
    fs = t.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(t.spark._jsc.hadoopConfiguration())
    for r in t.nation.collect():  # 25 small files
        out = fs.create(t.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/a/{r.n_nationkey}.md"))
        out.write(bytearray((r.n_name + "\n").encode()))
        out.close()
    return I.read_markdown(t.spark, path).select("text")


@query("scan_files", "select n_nationkey as id, n_name as name, 'nations' as source_file from nation union all select r_regionkey, r_name, 'regions' from region")
def _(t):
    root = _scratch(t, "files")
    t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).write.option("header", True).csv(f"{root}/nations.csv")
    t.region.select(F.col("r_name").alias("Name"), F.col("r_regionkey").alias("ID")).write.option("header", True).csv(f"{root}/regions.csv")
    return default_registry().read(t.spark, Request(paths=(f"{root}/nations.csv", f"{root}/regions.csv")))["union"].drop(ORDER)


@query("event_log", "select event_id, '***' as token, event_type as kind from events")
def _(t):
    path = _scratch(t, "log")
    half = F.col("event_id") % 2 == 0
    rows = t.events.select("event_id", F.lit("abc").alias("token"), F.struct(F.col("event_type").alias("kind"), F.lit("p").alias("password")).alias("detail"))
    K.append_events(rows.where(half), path)
    K.append_events(rows.where(~half), path)
    return t.spark.read.json(path).where("detail.password = '***'").select("event_id", "token", "detail.kind")


@query("save_and_replace", "select r_regionkey, upper(r_name) as r_name from region where r_regionkey > 0")
def _(t):
    path = _scratch(t, "table")
    K.save(t.region, path)
    K.replace(t.spark.read.parquet(path).where("r_regionkey > 0").withColumn("r_name", F.upper("r_name")), path)
    return t.spark.read.parquet(path)


@query("latest_rows", "select conv_id, max(turn) as turn from conversations group by conv_id")
def _(t):
    return K.latest(t.conversations, "conv_id", "turn").select("conv_id", "turn")


@query("preview_rows", "select cast(o_orderkey as varchar) as o_orderkey, coalesce(status, '') as status from (select o_orderkey, nullif(o_orderstatus, 'F') as status from orders) where o_orderkey < 10")
def _(t):
    return P.preview_rows(_holes(t).select("o_orderkey", "status").withColumn(ORDER, F.col("o_orderkey")))


@query("macro_table", "select y as year, q as quarter, y * 10 + q as value, cast(y as varchar) || 'Q' || cast(q as varchar) as period from (select unnest([2021, 2022]) as y) cross join (select unnest([1, 2, 3, 4]) as q)")
def _(t):
    rows = [(y, q, y * 10 + q) for y in (2019, 2020, 2021, 2022, 2023) for q in (1, 2, 3, 4)]
    return M.macro_table(t.spark, rows, "year int, quarter int, value int", 2021, 2022)


@query("indicator_rows", "select year(o_orderdate)::int as year, 'C' || cast(o_custkey as varchar) as country_code, 'N' as country, case o_orderstatus when 'F' then 'NY.GDP.ZG' when 'O' then 'SP.POP' else 'SE.ZS' end as indicator_code, 'name' as indicator_name, o_totalprice as value, case o_orderstatus when 'F' then 'USD' when 'O' then 'people' else '%' end as unit, 'test' as source from orders where o_orderkey % 3 <> 0")
def _(t):
    code = F.when(F.col("o_orderstatus") == "F", "NY.GDP.ZG").when(F.col("o_orderstatus") == "O", "SP.POP").otherwise("SE.ZS")
    value = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    record = F.struct(F.concat(F.lit("C"), "o_custkey").alias("countryiso3code"), F.struct(F.lit("x").alias("id"), F.lit("N").alias("value")).alias("country"), F.struct(code.alias("id"), F.lit("name").alias("value")).alias("indicator"), F.year("o_orderdate").cast("string").alias("date"), value.alias("value"))
    bodies = t.orders.groupBy("o_custkey").agg(F.to_json(F.collect_list(record)).alias("body"))
    return M.indicator_rows(bodies, "body", "test")


@query("by_indicator", "select o_orderstatus as code, count(*) as n from orders where o_orderstatus in ('F', 'O') group by 1")
def _(t):
    parts = V.by_indicator(t.orders, ["F", "O"], "o_orderstatus")
    each = [df.agg(F.lit(c).alias("code"), F.count("*").alias("n")) for c, df in parts.items()]
    return each[0].union(each[1])


@query("json_flatten", "select event_id, event_type as e_kind, value as e_detail_value from events")
def _(t):
    nested = t.events.select("event_id", F.struct(F.col("event_type").alias("kind"), F.struct("value").alias("detail")).alias("e"))
    return H.flatten(nested)


@query("json_expand_arrays", "select event_id, v as item_xs, w as item_ys_w from events left join lateral (select unnest(case when event_id % 5 = 0 then null else [event_id, user_id] end) as v) on true left join lateral (select unnest([1, 2]) as w) on true")
def _(t):
    xs = F.when(F.col("event_id") % 5 != 0, F.array("event_id", "user_id"))
    ys = F.array(F.struct(F.lit(1).alias("w")), F.struct(F.lit(2).alias("w")))
    return H.expand_arrays(t.events.select("event_id", xs.alias("xs"), ys.alias("ys")))


@query("promote_numeric", "select event_id, try_cast(case when event_id % 4 = 0 then 'x' else cast(value as varchar) end as double) as v, event_type from events")
def _(t):
    return H.promote_numeric(t.events.select("event_id", F.when(F.col("event_id") % 4 == 0, "x").otherwise(F.col("value").cast("string")).alias("v"), "event_type"))


@query("promote_numeric_commas", "select o_orderkey, cast(floor(o_totalprice) as double) as price from orders")
def _(t):
    return H.promote_numeric(t.orders.select("o_orderkey", F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit(" ")).alias("price")), 0.8, commas=True)


@query("keyword_search", "select p_partkey, p_name from part where contains(lower(p_name), 'e') order by p_name, p_partkey limit 20")
def _(t):
    return D.search(t.part.select("p_partkey", "p_name"), "p_name", "E", 20)


@query("introspect", "select 'nation' as table_name, n as rows, unnest(['n_nationkey', 'n_name', 'n_regionkey']) as name, unnest(['int', 'string', 'int']) as type, unnest([true, false, false]) as primary_key, unnest([null, null, 'region.r_regionkey']) as foreign_key, unnest([false, true, true]) as nullable from (select count(*) as n from nation)")
def _(t):
    keys = {"nation": {"primary": ["n_nationkey"], "required": ["n_nationkey"], "foreign": {"n_regionkey": "region.r_regionkey"}}}
    found = D.introspect({"nation": t.nation}, keys)
    rows = [(x["table"], x["rows"], c["name"], c["type"], c["primary_key"], c["foreign_key"], c["nullable"]) for x in found for c in x["columns"]]
    return t.spark.createDataFrame(rows, "table_name string, rows long, name string, type string, primary_key boolean, foreign_key string, nullable boolean")


@query("scan_sqlite", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey > 500 and o_orderstatus in ('F', 'P') and o_totalprice <= 200000.5")
def _(t):
    """A database written from `orders`; the conditions are part of its statements."""
    path = f"{_scratch(t, 'db')}/orders.db".removeprefix("file://")
    W.sqlite_table(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey"), path, "orders")
    return D.read_sqlite(t.spark, path, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"], [("o_orderkey", ">", 500), ("o_orderstatus", "in", ["F", "P"]), ("o_totalprice", "<=", 200000.5)])


KEYED = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus"]}


def _keys_sql() -> str:
    """Each pair of columns: no value of the first is missing in the second, and the second has each value once."""
    columns = [(t, c, "n" if c.endswith("key") else "t") for t, cs in KEYED.items() for c in cs]
    return " union all ".join(
        f"select '{t}' as table_name, '{c}' as column_name, '{u}' as ref_table, '{d}' as ref_column where (select count({c}) from {t}) > 0 and (select count({d}) = count(distinct {d}) from {u}) and not exists (select 1 from {t} where {c} is not null and {c} not in (select {d} from {u} where {d} is not null))"
        for t, c, k in columns for u, d, m in columns if k == m and (t, c) != (u, d)
    )


@query("find_keys", _keys_sql())
def _(t):
    found = D.find_keys({n: getattr(t, n).select(*cs) for n, cs in KEYED.items()})
    return t.spark.createDataFrame(found, "table_name string, column_name string, ref_table string, ref_column string")


@query("schema_text", "select '- ' || name || ' (' || cast(n as varchar) || ' rows)' as line from (select 'region' as name, count(*) as n from region union all select 'part', count(*) from part)")
def _(t):
    text = P.schema_text(D.introspect({"region": t.region, "part": t.part}))
    return t.spark.createDataFrame([(x,) for x in text.split("\n") if x.startswith("-")], "line string")


@query("join_detect", "select key from (select 'n_name' as key, avg(case when n_name in ('FRANCE', 'none') then 1.0 else 0 end) as share from nation union all select 'n_nationkey', avg(case when n_nationkey in (select s_nationkey from supplier) then 1.0 else 0 end) from nation) where share > 0 order by share desc, key desc limit 1")
def _(t):
    right = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), F.lit("none").alias("n_name")).union(t.nation.where("n_name = 'FRANCE'").select("n_nationkey", "n_name"))
    return t.spark.createDataFrame([(J.detect_join(t.nation, right)[0],)], "key string")


@query("head_sample", "select o_orderkey, o_totalprice * 2 as twice from orders order by o_totalprice, o_orderkey limit 10")
def _(t):
    """The first rows by the table's order."""
    rows = t.orders.select("o_orderkey", "o_totalprice", F.struct("o_totalprice", "o_orderkey").alias(ORDER))
    return RuleEngine().dry_run("nodes: {a: {operator: AddFields, fields: {twice: \"row['o_totalprice'] * 2\"}}}", rows).df.select("o_orderkey", "twice")


# -- functions ---------------------------------------------------------------


@query("contains_cjk", "select doc_id, doc_id % 2 = 0 as cjk from documents")
def _(t):
    return t.documents.select("doc_id", S.contains_cjk(F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("中文"))).otherwise(F.col("lang"))).alias("cjk"))


@query("sanitize_id", "select doc_id, trim(regexp_replace(source || '-a b.' || lang || '!', '[^a-zA-Z0-9_]', '_', 'g'), '_') as id from documents")
def _(t):
    return t.documents.select("doc_id", S.identifier(F.concat("source", F.lit("-a b."), "lang", F.lit("!"))).alias("id"))


@query("period_label", "select o_orderkey, cast(year(o_orderdate) as varchar) || 'Q' || cast(quarter(o_orderdate) as varchar) as q, strftime(o_orderdate, '%Y-%m') as m from orders")
def _(t):
    year = F.year("o_orderdate")
    return t.orders.select("o_orderkey", S.period_label(year, quarter=F.quarter("o_orderdate")).alias("q"), S.period_label(year, month=F.month("o_orderdate")).alias("m"))


@query("unit_scale", "select o_orderkey, round(o_totalprice / 1e4, 8) as scaled_value, 'ten thousand' as unit from orders")
def _(t):
    return S.scaled(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", F.round("scaled_value", 8).alias("scaled_value"), "unit")


@query("token_estimate", "select conv_id, turn, cast(greatest(1, length(text) // 3) as bigint) as tokens from conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", S.token_estimate(F.col("text")).alias("tokens"))


@query("extract_fenced", "select doc_id, 'x = ' || lang as code from documents")
def _(t):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see\n```python\nx = "), "lang", F.lit("\n```\nend"))).otherwise(F.concat(F.lit("x = "), "lang"))
    return t.documents.select("doc_id", S.fenced(text).alias("code"))


@query("extract_json", "select doc_id, '{\"lang\": \"' || lang || '\"}' as j, 'a: ' || lang as y from documents")
def _(t):
    body = F.concat(F.lit('{"lang": "'), "lang", F.lit('"}'))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("so:\n```json\n"), body, F.lit("\n```\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("well, "), body, F.lit(" it is"))).otherwise(body)
    yaml = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x\n```yml\na: "), "lang", F.lit("\n```"))).otherwise(F.concat(F.lit("a: "), "lang"))
    return t.documents.select("doc_id", S.json_object(text).alias("j"), S.yaml_block(yaml).alias("y"))


@query("comma_float", "select o_orderkey, floor(o_totalprice) as price from orders")
def _(t):
    text = t.orders.select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("text"))
    return run(C.AddFields({"price": "float(str(row['text']).replace(',', ''))"}), text).drop("text")


@query("safe_text", f"select o_orderkey, coalesce(status, 'null') as status from {HOLES}")
def _(t):
    return _holes(t).select("o_orderkey", S.safe_text(F.col("status")).alias("status"))


@query("page_range", "select unnest([1, 3, 5, 6, 7]) as page")
def _(t):
    return t.spark.createDataFrame([(x,) for x in S.page_range("1,3,5-9", 7)], "page int")


@query("floor_modulo", "select l_linenumber, cast(floor((l_linenumber - 4) / 3.0) as bigint) as d, (((l_linenumber - 4) % 3) + 3) % 3 as m from lineitem")
def _(t):
    rows = t.lineitem.select("l_linenumber")
    return rows.select("l_linenumber", compile_expression("(row['l_linenumber'] - 4) // 3", rows).alias("d"), compile_expression("(row['l_linenumber'] - 4) % 3", rows).alias("m"))


@query("row_condition", "select c_custkey from customer where (c_name like '%7' or c_acctbal < 0) and c_mktsegment is not null")
def _(t):
    rows = t.customer
    return rows.where(compile_condition("(row['c_name'].endswith('7') or row['c_acctbal'] < 0) and row['c_mktsegment'] is not None", rows)).select("c_custkey")


# -- SQL, retrieval, charts, conversations -----------------------------------


def _views(t: Tables, *names: str) -> SparkSession:
    for n in names:
        getattr(t, n).createOrReplaceTempView(n)
    return t.spark


@query("guarded_sql", "select n_name, 'drop' as note from nation where n_regionkey = 1")
def _(t):
    return D.guarded_sql(_views(t, "nation"), "WITH a AS (SELECT * FROM nation) SELECT n_name, 'drop' AS note FROM a WHERE n_regionkey = 1")


@query("query_set", "select n_nationkey, n_name, n_regionkey from nation")
def _(t):
    got = D.query_set(_views(t, "nation"), planner=lambda q, names: [D.NamedQuery("DROP TABLE nation", "bad"), D.NamedQuery("SELECT * FROM nation", "good")])
    return got["good"]


@query("per_table_sample", "select least(1000, count(*)) as n, least(1000, count(distinct o_orderkey)) as different, least(1000, count(*)) as found from orders")
def _(t):
    """Any 1000 rows: no row twice, all of them rows of the table."""
    some = D.query_set(_views(t, "orders"), mode="per_table", planner=None, query=D.per_table(t.spark, ["orders"])[0].body)["query"]
    marked = some.join(t.orders.withColumn("_found", F.lit(1)), some.columns, "left")
    return marked.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("different"), F.count("_found").alias("found"))


@query("sales_by_month", f"select strftime(o_orderdate, '%Y-%m') as month, {MONEY.format('o_totalprice')} as total from orders group by 1")
def _(t):
    return D.guarded_sql(_views(t, "orders"), "SELECT date_format(o_orderdate, 'yyyy-MM') AS month, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS total FROM orders GROUP BY 1")


@query("top_n", f"select o_custkey, {MONEY.format('o_totalprice')} as total from orders group by 1 order by total desc, o_custkey limit 10")
def _(t):
    return D.guarded_sql(_views(t, "orders"), "SELECT o_custkey, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 10")


def _sql_query(name: str, sql: str, *tables: str, asked: str | None = None):
    """asked: what Spark is asked, if that is not the SQL itself."""

    @query(name, sql)
    def _(t):
        return D.guarded_sql(_views(t, *tables), asked or sql)


# not among the reference's operators, but within reach of its SQL
_sql_query("sql_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)", "customer", "orders")
_sql_query("sql_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)", "customer", "orders")
_sql_query("sql_rollup", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)", "orders")
_sql_query("sql_window", "select o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as nth from orders", "orders")
# Spark joins both sides of a set operation before it removes copies: with few different values a task would sort and hold a large part of a table
_sql_query("sql_intersect", "select l_returnflag as f from lineitem intersect select o_orderstatus from orders", "lineitem", "orders", asked="select distinct l_returnflag as f from lineitem intersect select distinct o_orderstatus from orders")
_sql_query("sql_except", "select o_orderstatus as f from orders except select l_returnflag from lineitem", "orders", "lineitem", asked="select distinct o_orderstatus as f from orders except select distinct l_returnflag from lineitem")


@query("share_of_total", "select o_orderpriority, round(count(*) * 1.0 / (select count(*) from orders), 6) as share from orders group by 1")
def _(t):
    return D.guarded_sql(_views(t, "orders"), "SELECT o_orderpriority, round(cast(count(*) AS double) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")


@query("chunk_fixed", "select doc_id, i as chunk, substr(text, cast(i * 1300 + 1 as bigint), 1500) as content from documents, lateral (select unnest(range(0, cast(greatest(1, ceil((length(text) - 200) / 1300.0)) as bigint))) as i)")
def _(t):
    return R.fixed_chunks(t.documents, "doc_id", "text")


@query("chunk_recursive")
def _(t):
    return R.recursive_chunks(t.documents, "doc_id", "text")


@query("knn_topk", "with q as (select vec_id as query_vec_id, cast(embedding as double[]) as e from embeddings where vec_id % 50 = 0), s as (select query_vec_id, vec_id, list_cosine_similarity(cast(embedding as double[]), e) as s from embeddings, q), r as (select *, row_number() over (partition by query_vec_id order by s desc nulls last, vec_id) as rn from s) select query_vec_id, vec_id, round(s, 6) as similarity from r where rn <= 5")
def _(t):
    return R.nearest(t.embeddings, "vec_id", "embedding", t.embeddings.where("vec_id % 50 = 0"), 5).withColumn("similarity", F.round("similarity", 6))


@query("series_compare", "with y as (select cast(year(o_orderdate) as bigint) as x, sum(o_totalprice) filter (where o_orderstatus = 'F') as f, sum(o_totalprice) filter (where o_orderstatus = 'O') as o from orders group by 1), m as (select max(greatest(coalesce(f, 0), coalesce(o, 0))) as top from y), u as (select case when top >= 1e12 then 1e12 when top >= 1e8 then 1e8 when top >= 1e4 then 1e4 else 1.0 end as size, case when top >= 1e12 then 'trillion' when top >= 1e8 then 'hundred million' when top >= 1e4 then 'ten thousand' else '' end as unit from m) select x, round(f / size, 4) as \"F\", round(o / size, 4) as \"O\", unit from y, u where f is not null or o is not null")
def _(t):
    years = t.orders.groupBy(F.year("o_orderdate").cast("long").alias("x"), "o_orderstatus").agg(F.sum("o_totalprice").alias("y"))
    out = V.compared_series({s: years.where(F.col("o_orderstatus") == s) for s in ("F", "O")}, "x", "y")
    return out.select("x", F.round("F", 4).alias("F"), F.round("O", 4).alias("O"), "unit")


@query("chart_types", "select unnest(['Line', 'Sankey']) as name")
def _(t):
    return t.spark.createDataFrame([(V.chart_type(x),) for x in ("line", " SANKEY ")], "name string")


@query("pie_pairs", "select c_mktsegment as name, count(*) as value from customer group by 1")
def _(t):
    return V.pairs(t.customer.withColumn("n", F.lit(1).cast("long")), "c_mktsegment", "n")


@query("xy_series", "with y as (select cast(year(o_orderdate) as bigint) as x, count(*) as n from orders group by 1), m as (select max(n) as top from y) select x, round(n / case when top >= 1e12 then 1e12 when top >= 1e8 then 1e8 when top >= 1e4 then 1e4 else 1.0 end, 6) as y, case when top >= 1e12 then 'trillion' when top >= 1e8 then 'hundred million' when top >= 1e4 then 'ten thousand' else '' end as unit from y, m")
def _(t):
    years = t.orders.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("value"))
    return V.xy_series(years, *V.pick_axes(years)).withColumn("y", F.round("y", 6))


@query("history_text", "select conv_id, coalesce(string_agg('[' || role || '] ' || text, chr(10) || chr(10) order by turn) filter (where role <> 'system'), '') as history from conversations group by conv_id")
def _(t):
    return L.history(t.conversations)


@query("microcompact", "select conv_id, turn, case when greatest(1, length(text) // 3) > 40 then '[compacted: ' || cast(greatest(1, length(text) // 3) as varchar) || ' tokens]' else text end as text from conversations")
def _(t):
    return L.microcompact(t.conversations, 40).select("conv_id", "turn", "text")


@query(
    "snip_history",
    "with r as (select *, count(*) over (partition by conv_id) as c, count(*) filter (where role <> 'system') over (partition by conv_id) as n, row_number() over (partition by conv_id, role <> 'system' order by turn desc) as rn from conversations), k as (select *, greatest(1, floor(n * 0.5)) as keep from r) select conv_id, turn, role, text from k where c <= 2 or role = 'system' or rn <= keep union all select conv_id, turn, 'system', '[snipped] ' || cast(cast(n - keep as bigint) as varchar) || ' earlier turns left out' from k where c > 2 and role <> 'system' and rn = keep + 1",
)
def _(t):
    return L.snip(t.conversations).select("conv_id", "turn", "role", "text")


@query("budget_flag", "select conv_id, turn, used, case when used >= 180 then 'budget_exceeded' when rn >= 3 and mx < 60 then 'diminishing' else 'ok' end as flag from (select *, cast(sum(tokens) over (partition by conv_id order by turn) as bigint) as used, max(tokens) over (partition by conv_id order by turn rows between 2 preceding and current row) as mx, row_number() over (partition by conv_id order by turn) as rn from (select conv_id, turn, greatest(1, length(text) // 3) + 4 as tokens from conversations))")
def _(t):
    return L.budget(t.conversations, 200, gain=60, gains=3).select("conv_id", "turn", "used", "flag")
