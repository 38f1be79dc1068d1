"""Cleaning operators and rule chains on small tables of our own."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablesmith.operators import cleaning as C
from tablesmith.operators import joins as J
from tablesmith.operators.cleaning import ORDER
from tablesmith.plans.cleaning import clean, clean_all
from tablesmith.plans.rules import RuleEngine


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, {ORDER} long")


def values(df):
    return [tuple(r) for r in df.drop(ORDER).collect()]


def test_dedup_keeps_the_first(spark):
    df = frame(spark, [(1, "b"), (1, "a"), (None, "x"), (None, "y"), (2, "a")], "k int, v string")
    assert sorted(values(C.Dedup(by=["k"]).run(df)[0]), key=str) == sorted([(1, "b"), (None, "x"), (2, "a")], key=str)
    assert C.Dedup(by=["none"]).run(df)[0].count() == 5


def test_dedup_of_lists_and_maps(spark):
    df = spark.sql("select * from values (array('a'), map('k', 1)), (array('a'), map('k', 1)), (array('b'), map('k', 1)) as t(l, m)")
    assert C.Dedup().run(df)[0].count() == 2
    assert C.Dedup(by="m").run(df)[0].count() == 1


def test_filter_order(spark):
    df = frame(spark, [(1, None), (None, None), (5, "x")], "a int, b string")
    assert C.Filter(drop_empty=True).run(df)[0].count() == 2
    assert values(C.Filter(drop_null=True, condition="row['a'] > 1").run(df)[0]) == [(5, "x")]


def test_rename_collision_is_an_error(spark):
    df = spark.sql("select 1 a, 2 b")
    with pytest.raises(ValueError, match="two columns"):
        C.RenameFields({"a": "b"}).run(df)
    out, logs = C.RenameFields({"a": "b", "b": "a", "c": "d"}).run(df)
    assert out.columns == ["b", "a"]
    assert "WARNING" in logs[0]


def test_map_functions(spark):
    df = spark.sql("select * from values ('1.5'), ('nan'), ('abc'), (null) as t(v)")
    assert [r.v for r in C.Map("v", "to_float").run(df)[0].collect()] == [1.5, None, None, None]
    assert "WARNING" in C.Map("v", "nope").run(df)[1][0]
    with pytest.raises(Exception, match="not a whole number"):
        C.Map("v", "to_int").run(df)[0].collect()


def test_add_fields_goes_on_after_an_error(spark):
    out, logs = C.AddFields({"x": "row['a'] * 2", "bad": "eval('1')", "y": "row['x'] + 1"}).run(spark.sql("select 3 a"))
    assert values(out) == [(3, 6, 7)]
    assert any("ERROR" in x for x in logs)


def test_flat(spark):
    df = spark.sql("select * from values (1, array('a', 'b')), (2, array()), (3, null) as t(k, v)")
    assert sorted(values(C.Flat("v", "w").run(df)[0]), key=str) == sorted([(1, "a"), (1, "b"), (2, None), (3, None)], key=str)
    text = spark.sql("""select * from values (1, '["a", "b"]'), (2, '[bad'), (3, 'x'), (4, null) as t(k, v)""")
    assert sorted(values(C.Flat("v").run(text)[0]), key=str) == sorted([(1, "a"), (1, "b"), (2, "[bad"), (3, "x"), (4, None)], key=str)


def test_join_null_keys_and_suffix(spark):
    a, b = spark.sql("select * from values (1, 'x'), (null, 'y') as t(k, v)"), spark.sql("select * from values (null, 'n'), (2, 'z') as t(k, v)")
    out = C.Join("a", "b", "k", "outer").run(a, {"a": a, "b": b})[0]
    assert out.columns == ["k", "v", "v_right"]
    assert sorted(values(out), key=str) == sorted([(1, "x", None), (None, "y", "n"), (2, None, "z")], key=str)
    same, logs = C.Join("a", "none", "k").run(a, {"a": a})
    assert same is a
    assert "WARNING" in logs[0]


def test_group(spark):
    df = spark.sql("select * from values ('A', 1, 'x'), ('A', null, 'y'), ('B', null, null), (null, 5, 'z') as t(g, n, s)")
    assert values(C.Group("g", {"n": "sum", "s": "count"}).run(df)[0]) == [("A", 1, 2), ("B", 0, 0)]
    assert "ERROR" in C.Group("g", {"n": "mode"}).run(df)[1][-1]
    assert "ERROR" in C.Group("g", {"s": "sum"}).run(df)[1][-1]


def test_fill_and_drop_null(spark):
    df = spark.sql("select * from values (1, null), (null, 'a'), (null, null) as t(n, s)")
    assert values(C.FillNull(value=0).run(df)[0]) == [(1, "0"), (0, "a"), (0, "0")]
    assert values(C.FillNull(value=0, fill_map={"s": "z"}).run(df)[0]) == [(1, "z"), (None, "a"), (None, "z")]
    assert C.DropNull("all").run(df)[0].count() == 2
    assert C.DropNull("any", subset=["none"]).run(df)[0].count() == 3
    assert C.DropNull("all", subset=["none"]).run(df)[0].count() == 0


def test_sort_nulls_last_and_limit(spark):
    df = spark.sql("select * from values (2), (null), (1), (3) as t(n)")
    for up, want in ((True, [1, 2, 3, None]), (False, [3, 2, 1, None])):
        assert [r.n for r in C.Sort("n", up).run(df)[0].collect()] == want
    assert [r.n for r in C.Limit(2, 1).run(C.Sort("n").run(df)[0])[0].collect()] == [2, 3]


def test_registry():
    assert len(C.operator_names()) == 15
    assert C.operator("Nope") is None


RULES = "nodes:\n  a: {operator: DropNull}\n  b: {operator: Dedup}\nprocessor: {chain: %s}"


@pytest.mark.parametrize(
    ("rules", "part"),
    [("a: [", "not YAML"), ("- 1", "mapping"), ("x: 1", "no nodes"), ("nodes: {a: 1}", "must be a mapping"), ("nodes: {a: {by: x}}", "names no operator"), ("nodes: {a: {operator: Nope}}", "unknown operator")],
)
def test_rule_failures_return_the_table(spark, rules, part):
    df = spark.sql("select 1 a")
    done = RuleEngine().execute(rules, df)
    assert not done.success
    assert part in done.error
    assert done.df is df


def test_rule_chain(spark):
    df = spark.sql("select * from values (1), (1), (null), (2) as t(a)")
    assert RuleEngine().execute(RULES % "[a, b]", df).df.count() == 2
    assert RuleEngine().execute(RULES % "b", df).df.count() == 3
    done = RuleEngine().execute(RULES % "[a, nope]", df)
    assert done.success
    assert done.df.count() == 3
    assert any("WARNING" in x for x in done.logs)


def test_yaml_on_key_and_extra_operators(spark):
    class One(C.Operator):
        def run(self, df, inputs=None):
            return df.limit(1), ["One"]

    a = spark.sql("select 1 k, 2 v")
    rules = "inputs: {l: x, r: y}\nnodes:\n  j: {operator: Join, left: l, right: r, on: k}\n  o: {operator: One}"
    done = RuleEngine({"One": One}).execute(rules, a, {"x": a, "y": a})
    assert done.success
    assert done.df.columns == ["k", "v", "v_right"]
    assert RuleEngine().dry_run("nodes: {s: {operator: Filter, condition: \"row['nope'] > 1\"}}", a).success is False


def test_clean_pipeline(spark):
    good = spark.range(5).toDF("a")
    assert clean(good).quality == "clean"
    dirty = good.union(good)
    done = clean(dirty)
    assert done.quality == "cleaned"
    assert done.df.count() == 5
    tries = []
    bad = clean(dirty, rules=lambda df, found, logs: tries.append(1) or "nodes: {a: {operator: Nope}}")
    assert bad.quality == "low"
    assert len(tries) == 3
    assert bad.df is dirty
    both = clean_all({"l": dirty.select("a", F.lit("x").alias("b")), "r": good.select("a", F.lit(1).alias("c"))})
    assert list(both) == ["l_r"]


def test_detect_join(spark):
    a, b = spark.sql("select 1 id, 'x' s"), spark.sql("select 2 id, 'x' s")
    assert J.detect_join(a, b) == ("s", "s")
    assert J.detect_join(a, spark.sql("select 1 q")) is None


@pytest.mark.parametrize(
    ("kind", "value", "wide", "filled"),
    [
        ("int", 0, "int", 0), ("int", 0.5, "double", 0.5), ("int", 3_000_000_000, "bigint", 3_000_000_000), ("int", "7", "int", 7), ("int", "none", "string", "none"),
        ("double", 1, "double", 1.0), ("string", 0, "string", "0"), ("boolean", True, "boolean", True), ("boolean", "?", "string", "?"), ("date", "2024-02-03", "date", datetime.date(2024, 2, 3)),
        ("date", "soon", "string", "soon"), ("decimal(6,2)", 1.25, "decimal(6,2)", Decimal("1.25")), ("decimal(6,2)", 0.125, "double", 0.125), ("array<int>", 0, "array<int>", None),
    ],
)
def test_fill_null_widens(spark, kind, value, wide, filled):
    df = C.FillNull(value=value).run(spark.sql(f"select cast(null as {kind}) a"))[0]
    assert (df.dtypes, df.first().a) == ([("a", wide)], filled)


def test_whole_numbers_beyond_a_long_are_datetimes(spark):
    """Decimals without places are nanoseconds as longs are; other decimals are no whole numbers."""
    df = spark.sql("select cast('86400000000000005999' as decimal(20,0)) a, 86400000005999L b, cast(1.5 as decimal(6,2)) c, cast(null as decimal(20,0)) d")
    for c in df.columns:
        df = C.Map(c, "to_datetime").run(df)[0]
    got = df.selectExpr("unix_micros(a) a", "unix_micros(b) b", "c", "d").first()
    assert (got.a, got.b, got.c, got.d) == (86_400_000_000_000_005, 86_400_000_005, None, None)
