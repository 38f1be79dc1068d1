"""Percentiles, moving averages and pages by rank, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tablesmith.operators import cleaning as C
from tablesmith.operators import conversations as L
from tablesmith.operators import ranks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([None, *map(float, range(-5, 6)), 2.5]), rng.random() * 1e9) for i in range(900)] + [("c", 1000, None, 1.0), ("d", 1001, 4.0, 2.0)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k string, id long, v double, w double").repartition(7)


def interpolated(values, share):
    values = sorted(values)
    place = share * (len(values) - 1)
    low = values[int(place)]
    return low + (values[min(int(place) + 1, len(values) - 1)] - low) * (place - int(place))


def test_percentiles(rows, table):
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r.k: r for r in ranks.percentiles(table, ["k"], ["v", "w"], shares).collect()}
    assert set(got) == {"hot", "a", "b", "c", "d", None}
    for k, r in got.items():
        for name, at in (("v", 2), ("w", 3)):
            values = [x[at] for x in rows if x[0] == k and x[at] is not None]
            assert r[name] == ([pytest.approx(interpolated(values, s)) for s in shares] if values else [None] * 6)
    whole = ranks.percentiles(table, [], ["w"], [0.5]).collect()
    assert [r.w[0] for r in whole] == [pytest.approx(statistics.median(x[3] for x in rows))]


def test_percentiles_of_nothing(table):
    assert ranks.percentiles(table.where("id < 0"), ["k"], ["v"], [0.5]).count() == 0
    assert [r.v for r in ranks.percentiles(table.where("id < 0"), [], ["v"], [0.5]).collect()] == [[None]]


def test_group_median_beside_other_aggregates(rows, table):
    """A key can be aggregated too; null keys go; a group without values has no median."""
    done = C.Group(by=["k"], aggs={"v": "median", "w": "median", "id": "max"}).run(table)[0]
    assert done.columns == ["k", "v", "w", "id"]
    for r in done.collect():
        mine = [x for x in rows if x[0] == r.k]
        v = [x[2] for x in mine if x[2] is not None]
        assert (r.v, r.id) == (pytest.approx(statistics.median(v)) if v else None, max(x[1] for x in mine))
        assert r.w == pytest.approx(statistics.median(x[3] for x in mine))
    only = C.Group(by=["id"], aggs={"id": "median"}).run(table.select("id"))[0]
    assert sorted(r.id for r in only.collect()) == [float(x[1]) for x in sorted(rows, key=lambda x: x[1])]


def test_no_task_holds_a_hot_group(table, monkeypatch):
    """The sorted rows of the key that most rows have lie in many partitions."""
    written = []
    monkeypatch.setattr(ranks, "written", lambda df, name, old=ranks.written: written.append(old(df, name)) or written[-1])
    hot = table.where("k = 'hot'").count()
    conf = "spark.sql.adaptive.coalescePartitions.enabled"  # it would put small partitions together
    table.sparkSession.conf.set(conf, False)
    try:
        ranked = ranks.numbered(table, [F.col("k"), F.col("w")])
    finally:
        table.sparkSession.conf.unset(conf)
    sizes = [r.n for r in written[0].where("k = 'hot'").groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 2 and max(sizes) < 0.6 * hot
    assert [r[ranks.RANK] for r in ranked.orderBy("k", "w").collect()] == list(range(902))


@pytest.mark.parametrize("block", [3, 64, 1 << 16])
@pytest.mark.parametrize("width", [1, 4, 50])
def test_moving_average(rows, table, monkeypatch, block, width):
    monkeypatch.setattr(ranks, "BLOCK_ROWS", block)
    got = {r.id: r.moving_average for r in ranks.moving_average(table, "w", ["id"], width, ["k"]).collect()}
    assert len(got) == len(rows)
    for k in {x[0] for x in rows}:
        mine = sorted((x[1], x[3]) for x in rows if x[0] == k)
        for i, (at, _) in enumerate(mine):
            assert got[at] == pytest.approx(statistics.fmean(w for _, w in mine[max(0, i - width + 1) : i + 1]))
    every = {r.id: r.moving_average for r in ranks.moving_average(table, "w", ["id"], width).collect()}
    mine = sorted((x[1], x[3]) for x in rows)
    assert all(every[at] == pytest.approx(statistics.fmean(w for _, w in mine[max(0, i - width + 1) : i + 1])) for i, (at, _) in enumerate(mine))


def test_windows_have_a_bound(table, monkeypatch):
    """Blocks and the rows before them, whatever the keys."""
    monkeypatch.setattr(ranks, "BLOCK_ROWS", 100)
    plan = ranks.moving_average(table, "w", ["id"], 10, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert f"{ranks.BLOCK}" in plan.split("Window")[1].split("\n")[0]


@pytest.mark.parametrize("up", [True, False])
@pytest.mark.parametrize(("skip", "n"), [(0, 5), (450, 7), (899, 50), (901, 1), (902, 3), (5000, 2), (3, 0)])
def test_pages(rows, table, monkeypatch, up, skip, n):
    """Nulls last both ways, ties in the first key, pages past the end."""
    monkeypatch.setattr(ranks, "SHALLOW", 2)
    keys = [(F.col("v"), up), (F.col("id"), True)]
    sign = 1 if up else -1
    want = [x[1] for x in sorted(rows, key=lambda x: (x[2] is None, sign * (x[2] or 0), x[1]))][skip : skip + n]
    assert [r.id for r in ranks.page(table, keys, skip, n).collect()] == want


def test_pages_of_ties(spark, monkeypatch):
    """Rows with equal keys fill pages that do not overlap in number, though which of them come first is open."""
    monkeypatch.setattr(ranks, "SHALLOW", 0)
    df = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    pages = [ranks.page(df, [(F.col("k"), True)], at, 70).collect() for at in range(1, 300, 70)]
    assert [r.k for p in pages for r in p] == sorted(i % 3 for i in range(300))[1:]


def test_limit_far_down(spark, tmp_path, monkeypatch):
    """The input order of files, and a Sort before."""
    from tablesmith.sources import files

    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f"{i},{i % 7}\n" for i in range(40)))
    (tmp_path / "b.csv").write_text("k,v\n" + "".join(f"{i},{i % 7}\n" for i in range(40, 900)))
    df = files.read_csv(spark, str(tmp_path), ordered=True)
    monkeypatch.setattr(ranks, "SHALLOW", 10)
    assert [r.k for r in C.Limit(5, 600).run(df)[0].collect()] == list(range(600, 605))
    sorted_, _ = C.Sort(["v"], ascending=False).run(df)
    assert [r.k for r in C.Limit(4, 300).run(sorted_)[0].collect()] == sorted(range(900), key=lambda i: (-(i % 7), i))[300:304]


def test_paged_listing_far_down(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SHALLOW", 10)
    assert [r.o for r in L.paged(spark.range(500).toDF("o"), "o", 5, 400).collect()] == list(range(99, 94, -1))
