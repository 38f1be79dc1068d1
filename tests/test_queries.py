"""Each registered query against its SQL in DuckDB."""

import pytest
from pyspark.sql import functions as F

from tablesmith import plans
from tests import oracle


@pytest.fixture(scope="module")
def db():
    return oracle.connect()


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, db, name):
    run, sql = plans.queries()[name], plans.oracle_sql().get(name)
    if sql:
        assert oracle.compare(spark, db, name, run, sql) == ""
    else:
        assert run(spark, oracle.DATA).count() > 0


def test_joins_and_series_cover_all_rows(spark, db):
    """Every row of lineitem is joined, and every order counted."""
    rows, orders, years = (db.execute(f"select {x}").fetchone()[0] for x in ("count(*) from lineitem", "count(*) from orders", "count(distinct year(o_orderdate)) from orders"))
    known = plans.queries()
    assert known["join_left"](spark, oracle.DATA).count() == rows
    assert known["join_outer"](spark, oracle.DATA).where("l_orderkey is not null").count() == rows
    series = known["xy_series"](spark, oracle.DATA).collect()
    assert len(series) == years
    assert round(sum(r.y for r in series)) == orders


def test_nearest_answers_each_query(spark, monkeypatch):
    """Ties by key over block limits; a vector without direction comes last."""
    from tablesmith.operators import retrieval

    monkeypatch.setattr(retrieval, "ROW_BLOCK", 3)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    rows = [(i, [1.0, 2.0] if i < 6 else [2.0, -1.0]) for i in range(9)] + [(9, [0.0, 0.0]), (10, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(2)
    got = retrieval.nearest(df, "id", "v", df.where("id in (0, 8)"), 4).orderBy("query_id", F.desc("similarity"), "id").collect()
    assert [(r.query_id, r.id) for r in got] == [(0, 0), (0, 1), (0, 2), (0, 3), (8, 6), (8, 7), (8, 8), (8, 0)]
    last = retrieval.nearest(df, "id", "v", df.where("id = 0"), 11).where("similarity is null").collect()
    assert sorted(r.id for r in last) == [9, 10]


def test_recursive_chunks_cover_the_text(spark):
    from tablesmith.operators.retrieval import split_text

    text = "".join(f"Sentence {i}. Another {i}! " for i in range(40)) + "\n" + "".join(f"{i:04d}" for i in range(125))
    parts = split_text(text, 100, 20)
    assert all(len(p) <= 100 for p in parts)
    at = 0
    for p in parts:
        found = text.find(p, max(0, at - 120))
        assert 0 <= found <= at
        at = max(at, found + len(p))
    assert at == len(text)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["sql_intersect", "sql_except"])
def test_set_operations_join_different_values(spark, name):
    """Copies are gone before the join, on both sides."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.queries()[name](spark, oracle.DATA)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan[plan.index("Join ") :].count("Aggregate ") == 2


def test_unlike_files_are_sorted_by_ranges(spark):
    """No task sorts a whole folder, and the files' names keep its order."""
    from tablesmith.operators.cleaning import ORDER
    from tablesmith.plans import registered

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = registered._unlike_files(registered.Tables(spark, oracle.DATA)).orderBy(ORDER).select("o_orderkey", F.col(ORDER)["file"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = [int(r[0]) for r in rows]
    small = [k for k in keys if k % 40 == 0]
    assert len({r[1] for r in rows}) > 2
    assert keys == sorted(small, reverse=True) + sorted(set(keys) - set(small))


def test_blocks_are_dealt_to_small_partitions(spark, monkeypatch):
    """However many rows a table has, a task gets the pairs of a few blocks."""
    from tablesmith.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCKS", 2)
    df = spark.range(100).selectExpr("id", "array(cast(id as double), 1D) v").coalesce(1)
    dealt = retrieval._dealt(retrieval._blocks(df, "id", "v", 10, "row_"))
    assert dealt.count() == 10
    assert dealt.rdd.getNumPartitions() == 5
