"""Readers, shaping, guarded SQL, profiles."""

import sqlite3
import zipfile

import pytest

from tablesmith.functions.scalars import page_range
from tablesmith.operators import profile as P
from tablesmith.operators import series as V
from tablesmith.operators.cleaning import ORDER
from tablesmith.sources import databases as D
from tablesmith.sources import files, shaping, sinks
from tablesmith.sources.registry import Request, default_registry, table_names


@pytest.mark.parametrize(("encoding", "sep"), [("utf-8", ","), ("gbk", ","), ("utf-8", ";"), ("utf-8", "\t")])
def test_csv(spark, tmp_path, encoding, sep):
    path = tmp_path / "t.csv"
    path.write_bytes(f"月份{sep}sales\n一月{sep}10\n二月{sep}20\n".encode(encoding))
    df = files.read_csv(spark, str(path))
    assert df.columns == ["月份", "sales"]
    assert [tuple(r) for r in df.collect()] == [("一月", 10), ("二月", 20)]


def test_json(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"rows": [{"a": 1, "b": {"c": "x"}}, {"a": 2, "b": {"c": "y"}}]}')
    df = shaping.flatten(files.read_json(spark, str(path)))
    assert sorted((r.a, r.b_c) for r in df.collect()) == [(1, "x"), (2, "y")]
    lines = tmp_path / "t.jsonl"
    lines.write_text('{"a": 1}\n\n[{"a": 2}, {"a": 3}]\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(lines), "a long").collect()) == [1, 2, 3]
    lines.write_text('{"a": 1}\nbad\n')
    with pytest.raises(Exception, match="not JSON: bad"):
        files.read_jsonl(spark, str(lines), "a long").collect()


def test_excel_zip_markdown(spark, tmp_path):
    book = tmp_path / "t.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>n</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>5</v></c></row><row><c r="B3"><v>6</v></c></row></sheetData></worksheet>')
    df = shaping.promote_numeric(files.read(spark, str(book), ordered=False))
    assert [tuple(r) for r in df.collect()] == [("x", 5.0), (None, 6.0)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("d/a.csv", "__MACOSX/a.csv", ".b.csv", "c.exe"):
            z.writestr(n, "x")
    assert files.zipped_members(spark, str(tmp_path / "a.zip")) == ["d/a.csv"]
    (tmp_path / "m" / "n").mkdir(parents=True)
    (tmp_path / "m" / "n" / "x.md").write_text("# T")
    assert [r.text for r in files.read_markdown(spark, str(tmp_path / "m")).collect()] == ["# T"]
    with pytest.raises(ValueError, match="no reader"):
        files.read(spark, "x.npz")


def test_header_row_and_pages():
    assert files.header_row([["a", None], ["", ""], ["1"]]) == (["a", "col_1"], [["1", None]])
    assert files.header_row([["a"]]) == ([], [])
    assert page_range("1,3,5-7", 6) == [1, 3, 5, 6]
    assert page_range("all", 2) == [1, 2]


def test_sqlite(spark, tmp_path):
    path = tmp_path / "t.db"
    with sqlite3.connect(path) as db:
        db.execute("create table s (id integer, v real, name text)")
        db.executemany("insert into s values (?, ?, ?)", [(1, 1.5, "a"), (2, None, None)])
    D.register_sqlite(spark)
    df = spark.read.format("sqlite").option("path", str(path)).option("query", "select * from s").load()
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, "a"), (2, None, None)]


def test_sqlite_types_and_ranges_of_all_rows(spark, tmp_path, monkeypatch):
    path = tmp_path / "t.db"
    with sqlite3.connect(path) as db:
        db.execute("create table s (n, m)")
        db.executemany("insert into s values (?, ?)", [(i, i) for i in range(300)] + [(2.5, "x")])
    monkeypatch.setattr(D, "PARTITION_ROWS", 100)
    D.register_sqlite(spark)
    for query, parts in (("select * from s", 4), ("s", 4), ("select * from s where n >= 0", 1)):
        source = D.SqliteSource({"path": str(path), "query": query})
        assert source.schema() == "`n` double, `m` string"
        reader = D._SqliteReader(source, ["double", "string"])
        assert len(reader.partitions()) == parts
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert len(rows) == 301
        assert rows[-1] == (2.5, "x")
    assert spark.read.format("sqlite").option("path", str(path)).option("query", "s").load().agg({"n": "sum"}).first()[0] == sum(range(300)) + 2.5


def test_zip_members_are_read(spark, tmp_path):
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("d/x.csv", f"{name}1\n5\n")
            z.writestr("__MACOSX/x.csv", "no")
    assert files.zipped_members(spark, str(tmp_path / "b.zip")) == ["d/x.csv"]
    assert [r.a1 for r in files.read(spark, str(tmp_path / "a.zip")).collect()] == [5]


def test_zip_tables(spark, tmp_path):
    """Tabular members as one union, JSON by itself, the largest first; a broken member is left out."""
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("a.csv", "Name;Total\nx;1\n".encode())
        z.writestr("b.csv", "name,totals\n一月,2\n".encode("gbk"))
        z.writestr("c.json", '{"rows": [{"k": 1}, {"k": 2}, {"k": 3}]}')
        z.writestr("bad.json", "{")
    got = files.read_zip_tables(spark, str(tmp_path / "t.zip"))
    assert list(got) == ["c", "union"]
    assert sorted(tuple(r) for r in got["union"].drop(ORDER).collect()) == [("x", 1, "a"), ("一月", 2, "b")]
    assert got["c"].count() == 3
    assert list(default_registry().read(spark, Request(paths=(str(tmp_path / "t.zip"),)))) == ["c", "union"]
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("bad.json", "{")
    with pytest.raises(ValueError, match="no member could be read"):
        files.read_zip_tables(spark, str(tmp_path / "u.zip"))


def test_encoding_of_the_whole_file(spark, tmp_path):
    """Bytes that are no UTF-8 after more than the first 64 KB decide the encoding; only a range is read for the head."""
    path = tmp_path / "late.csv"
    path.write_bytes(b"k,v\n" + b"1,plain\n" * 12_000 + "2,月份\n".encode("gbk"))
    assert files.find_encoding(spark, str(path)) == "gbk"
    assert files.read_csv(spark, str(path)).where("k = 2").first().v == "月份"
    assert files.head_bytes(spark, str(path), 5) == b"k,v\n1"
    assert files.read_text_head(spark, str(path), 2) == ["k,v", "1,plain"]
    big = tmp_path / "big.csv"
    with big.open("wb") as f:  # a hole of 3 GB, which takes no space
        f.write(b"a;b\n1;2\n")
        f.truncate(3 << 30)
    assert files.head_bytes(spark, str(big), 3) == b"a;b"


def test_read_adds_order_and_no_nans(spark, tmp_path):
    from tablesmith.operators import cleaning as C

    spark.sql("select id, if(id = 2, double('NaN'), double(id)) v from range(5)").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    df = files.read(spark, str(tmp_path / "t.parquet"))
    assert df.columns == ["id", "v", C.ORDER]
    assert [r.id for r in C.Limit(2, 1).run(df.repartition(3))[0].collect()] == [1, 2]
    assert df.where("v is null").count() == 1
    plan = C.Filter(condition="row['id'] > 1 and row['id'] < 4").run(df)[0]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,1)" in plan
    (tmp_path / "t.jsonl").write_text('{"a": 2}\n{"a": 1}\n')
    assert [r.a for r in C.Limit(1).run(files.read(spark, str(tmp_path / "t.jsonl")))[0].collect()] == [2]
    for name in ("x.xls", "x.pdf"):
        with pytest.raises(ValueError, match="library"):
            files.read(spark, name)


def test_excel_with_different_headers(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    for name, head in (("a", ("x", "y")), ("b", ("y", "z"))):
        with zipfile.ZipFile(tmp_path / f"{name}.xlsx", "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData><row>{cell('A1', head[0])}{cell('B1', head[1])}</row><row>{cell('A2', name + '1')}{cell('B2', name + '2')}</row></sheetData></worksheet>")
    df = files.read_excel(spark, str(tmp_path / "*.xlsx"))
    assert df.columns == ["x", "y", "z"]
    assert sorted(tuple(r) for r in df.fillna("").collect()) == [("", "b1", "b2"), ("a1", "a2", "")]


def test_sqlite_keys(spark, tmp_path):
    path = tmp_path / "k.db"
    with sqlite3.connect(path) as db:
        db.execute("create table p (id integer primary key, name text not null)")
        db.execute("create table c (id integer primary key, p_id integer references p(id))")
    keys = D.sqlite_keys(str(path))
    assert keys["p"] == {"primary": ["id"], "required": ["name"], "foreign": {}}
    assert keys["c"]["foreign"] == {"p_id": "p.id"}
    found = D.introspect({"c": spark.sql("select 1 id, 2 p_id")}, keys)[0]
    assert P.schema_text([found]).split("\n")[1:4] == ["- c (1 rows)", "    id INT PK NOT NULL", "    p_id INT FK->p.id NOT NULL"]


def test_arrays_and_texts(spark, tmp_path):
    import numpy as np

    arrays = {"s": np.arange(6.0).reshape(2, 3), "t": np.array([1, 2])}
    sinks.save_arrays(spark, arrays, str(tmp_path / "arrays"))
    got = sinks.read_arrays(spark, str(tmp_path / "arrays"))
    assert all((got[n] == a).all() for n, a in arrays.items())
    text = P.profile_text(P.profile(spark.sql("select 1 a, 'x' b")), "t")
    assert "rows: 1" in text
    assert "  row 1: {'a': 1, 'b': 'x'}" in text
    assert P.table_text(spark.sql("select 1 a, null b"), "t").endswith("  1 | ")


@pytest.mark.parametrize("sql", ["DROP TABLE t", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1", "WITH a AS (SELECT 1 x) INSERT INTO t SELECT * FROM a", "SET x=1", "SELECT * FROM parquet.`/tmp/x`", "SELECT reflect('java.lang.System', 'exit', 1)", "EXPLAIN DROP TABLE t", "SELECT (SELECT count(*) FROM csv.`/etc/passwd`)", "CACHE TABLE t", "TRUNCATE TABLE t"])
def test_sql_refused(spark, sql):
    with pytest.raises(D.RefusedQuery):
        D.check_query(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT 'drop' AS x", "WITH a AS (SELECT 1 x) SELECT * FROM a", "SHOW TABLES", "SELECT x, row_number() OVER (ORDER BY x) FROM VALUES (1), (2) AS t(x)", "SELECT 1 UNION ALL SELECT 2", "EXPLAIN SELECT 1", "SELECT sum(x) FROM VALUES (1) AS t(x) HAVING sum(x) > 0"])
def test_sql_allowed(spark, sql):
    assert D.guarded_sql(spark, sql, 5).count() <= 5


def test_guarded_sql_returns_all_rows(spark):
    many = D.MOST_ROWS + 7
    spark.range(many).createOrReplaceTempView("many_rows")
    assert D.guarded_sql(spark, "SELECT id FROM many_rows").count() == many
    assert D.query_set(spark, query="SELECT id FROM many_rows")["query"].count() == many
    assert D.guarded_sql(spark, "SELECT id FROM many_rows", D.MOST_ROWS).count() == D.MOST_ROWS


def test_query_set_names_and_failures(spark):
    plan = [D.NamedQuery("SELECT 1 a", "q"), D.NamedQuery("SELECT 2 a", "q"), D.NamedQuery("SELECT * FROM nope", "bad")]
    assert list(D.query_set(spark, planner=lambda q, t: plan)) == ["q", "q_1"]
    with pytest.raises(ValueError, match="no query worked"):
        D.query_set(spark, planner=lambda q, t: plan[2:])


def test_jdbc_and_keywords():
    assert D.jdbc_url("postgres", "h", "d b") == "jdbc:postgresql://h:5432/d+b"
    assert D.resolve_keyword("the GDP", {"gdp": "A", "cpi": "B"}) == "A"
    assert D.resolve_keyword("x", {"gdp": "A"}) is None


def test_registry(spark, tmp_path):
    registry = default_registry()
    assert registry.names() == ["database", "files"]
    registry.register("broken", lambda r: 1 / 0, 99)(lambda s, r: {})
    for n in ("a", "b"):
        (tmp_path / f"{n}.csv").write_text("Name,Total\nx,1\n" if n == "a" else "name,Totals\ny,2\n")
    got = registry.read(spark, Request(paths=(str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))))
    assert sorted(tuple(r) for r in got["union"].drop(ORDER).collect()) == [("x", 1, "a"), ("y", 2, "b")]
    assert table_names(["x/a.csv", "y/a.csv"]) == ["a", "a_1"]
    with pytest.raises(LookupError):
        registry.find(Request())


def test_profile_of_an_empty_table(spark):
    p = P.profile(spark.sql("select 1 a where false"))
    assert (p.rows, p.duplicate_rate, p.null_rate) == (0, 0.0, 0.0)
    assert P.issues(p) == []


def test_issues(spark):
    df = spark.sql("select * from values ('1', 'a'), ('1', 'a'), ('x', 'b'), (null, null) as t(m, `名`)")
    assert {x["issue"] for x in P.issues(P.profile(df))} == {"nulls", "duplicates", "cjk_name", "mixed", "empty_rows"}


def test_axes_and_compare(spark):
    df = spark.sql("select * from values (2020, 1, 5.0d), (2021, 2, 7.0d) as t(year, quarter, amount)")
    assert V.pick_axes(df) == ("year", "amount")
    assert V.pick_axes(spark.sql("select 'a' x")) is None
    rows = V.compared_series({"a": df, "b": df.where("year = 2021").withColumn("amount", df.amount * 10000)}, "year", "amount").collect()
    assert [(r.x, r.b, r.unit) for r in rows] == [(2020, None, "ten thousand"), (2021, 7.0, "ten thousand")]


def test_replace_and_latest(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.save(spark.range(3).toDF("a"), path)
    sinks.replace(spark.read.parquet(path).where("a > 0"), path)
    assert spark.read.parquet(path).count() == 2
    log = spark.sql("select * from values (1, 1, 'a'), (1, 2, 'b'), (2, 1, 'c') as t(k, u, v)")
    assert sorted(r.v for r in sinks.latest(log, "k", "u").collect()) == ["b", "c"]


def test_stateless_operators_stream(spark, tmp_path):
    """Projections and filters take a streaming table as it is."""
    from tablesmith.streaming import run_available

    from tablesmith.operators import cleaning as C

    sinks.save(spark.range(10).selectExpr("id", "cast(id as string) s"), str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, s string").parquet(str(tmp_path / "in"))
    for op in (C.Filter(condition="row['id'] > 3"), C.AddFields({"d": "row['id'] * 2"}), C.Select(["d"])):
        stream = op.run(stream)[0]
    run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r.d for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [8, 10, 12, 14, 16, 18]


CELLS = ['plain', 'a "quoted" one', 'two\nlines', 'three\r\n"x,y"\nlines', ',', '', '5" disk', '"', '\n', 'x;y', '一\n月']


def _csv_text(rows, quoted=False):
    import csv
    import io

    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL if quoted else csv.QUOTE_MINIMAL).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("encoding", ["utf-8", "gbk"])
def test_csv_cells_with_line_breaks(spark, tmp_path, encoding):
    """Rows as Python's reader has them, from one split and from splits of a few bytes."""
    rows = [(i, CELLS[i % len(CELLS)], CELLS[(i * 7) % len(CELLS)]) for i in range(150)]
    path = tmp_path / "t.csv"
    path.write_bytes(_csv_text([("id", "first\nname", "v"), *rows]).encode(encoding))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "300b", "37b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            df = files.read(spark, str(path))
            assert df.columns == ["id", "first\nname", "v", ORDER]
            got = [tuple(r)[:3] for r in df.orderBy(ORDER).collect()]
            assert got == [(i, a or None, b or None) for i, a, b in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_splits_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    from tablesmith.sources import records

    rows = [(i, CELLS[i % len(CELLS)]) for i in range(60)]
    (tmp_path / "t.csv").write_text(_csv_text([("id", "v"), *rows]), newline="")
    monkeypatch.setattr(records, "MOST_BROADCAST", 0)
    scan = records.CsvScan(b",")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        states = records.split_states(spark, str(tmp_path), scan)
        assert len(states) > 10
        got = records.records(spark, str(tmp_path), scan, states)
        assert got.count() == 61
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_quotes_within_cells(spark, tmp_path):
    """A quote that does not begin a cell opens nothing; columns, blank lines and schemas are as without line breaks."""
    (tmp_path / "t.csv").write_text('id,v,w\n1,5" disk,x\n\n2,"a\nb"\n3,,"c"\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv"), ordered=True).orderBy(ORDER).drop(ORDER).collect()] == [(1, '5" disk', "x"), (2, "a\nb", None), (3, None, "c")]
    df = files.read_csv(spark, str(tmp_path / "t.csv"), schema="k string, v string, w string")
    assert {r.k for r in df.collect()} == {"1", "2", "3"}
    (tmp_path / "u.csv").write_text('a,a,\n1,"x ""y"" z",2.5\n')
    df = files.read_csv(spark, str(tmp_path / "u.csv"))
    assert (df.columns, tuple(df.first())) == (["a0", "a1", "_c2"], (1, 'x "y" z', 2.5))


def test_input_order_of_files_of_unlike_sizes(spark, tmp_path):
    """A small first file and a large second one: Spark reads the large one first, the rows' order is that of the files."""
    from tablesmith.operators import cleaning as C

    for kind, small, large in (("csv", "k,src\n7,a\n", "k,src\n" + "".join(f"{i % 50},b{i}\n" for i in range(3000))), ("jsonl", '{"k": 7, "src": "a"}\n', "".join(f'{{"k": {i % 50}, "src": "b{i}"}}\n' for i in range(3000)))):
        folder = tmp_path / f"in.{kind}"
        folder.mkdir()
        (folder / f"a.{kind}").write_text(small)
        (folder / f"b.{kind}").write_text(large)
        df = files.read(spark, str(folder))
        first = {r.k: r.src for r in C.Dedup(by=["k"]).run(df)[0].collect()}
        assert first == {7: "a"} | {i: f"b{i}" for i in range(50) if i != 7}
        assert [r.src for r in C.Limit(3, 0).run(df)[0].collect()] == ["a", "b0", "b1"]


ODD = ["plain", 'quote " one', "back\\", '\\"', "[1, 2", "}],{", "a,b", "", "月\n"]


def test_json_list_in_many_tasks(spark, tmp_path):
    """Elements of one list, however splits fall; also as the only value of an object."""
    import json

    rows = [{"id": i, "s": ODD[i % len(ODD)], "deep": {"xs": [i, [i, ODD[(i * 5) % len(ODD)]][0]], "t": ODD[(i * 3) % len(ODD)]}} for i in range(120)]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "object.json").write_text(json.dumps({"the \"rows\"": rows}, indent=2, ensure_ascii=False))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1000b", "41b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            for name in ("list", "object"):
                df = files.read_json(spark, str(tmp_path / f"{name}.json"), ordered=True)
                assert ("_jsonl_row_idx" in df.columns) == (name == "object")
                got = df.orderBy(ORDER).collect()
                assert [{"id": r.id, "s": r.s, "deep": r.deep.asDict()} for r in got] == rows
                assert name == "list" or [r._jsonl_row_idx for r in got] == list(range(120))
            assert size == "128m" or df.rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("text", "want"), [("[]", []), (" [ ] ", []), ('[{"a": 1}]', [1]), ('{"k": [{"a": 1}, {"a": 2}]}\n', [1, 2]), ('{"a": 1}', [1]), ('{"a": 1, "b": [{"a": 2}, {"a": 3}]}', [1]), ('{"b": [{"a": 2}, {"a": 3}], "a": 5}', [5])])
def test_json_roots(spark, tmp_path, text, want):
    (tmp_path / "t.json").write_text(text)
    df = files.read_json(spark, str(tmp_path / "t.json"))
    assert [r.a for r in df.collect()] == want if want else df.count() == 0


@pytest.mark.parametrize("text", ["[1, 2]", '[{"a": 1}', '{"a": ', '[{"a": 1},, {"a": 2}]'])
def test_bad_json_is_an_error(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(Exception):
        files.read_json(spark, str(tmp_path / "t.json")).collect()


def test_zip_members_are_kept_as_they_are(spark, tmp_path):
    """Line breaks in cells, types of Parquet members, order, and encodings that show late; only the members' own bytes are read."""
    from tablesmith.sources import archives

    spark.sql("select id, timestamp'2024-01-02 03:04:05' t, date'2024-02-03' d, cast(id as decimal(10,2)) m, array(id) xs from range(3)").coalesce(1).write.parquet(str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("part-*")).read_bytes()
    rows = [(i, CELLS[i % len(CELLS)]) for i in range(40)]
    for name, how in (("stored", zipfile.ZIP_STORED), ("packed", zipfile.ZIP_DEFLATED)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", how) as z:
            z.writestr("cells.csv", _csv_text([("id", "v"), *rows]))
        with zipfile.ZipFile(tmp_path / f"{name}-p.zip", "w", how) as z:
            z.writestr("typed.parquet", part)
        got = files.read(spark, str(tmp_path / f"{name}.zip"))
        assert [tuple(r)[:2] for r in got.orderBy(ORDER).collect()] == [(i, v or None) for i, v in rows]
        got = files.read(spark, str(tmp_path / f"{name}-p.zip"), ordered=False)
        assert got.dtypes == spark.read.parquet(str(tmp_path / "p")).dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, spark.read.parquet(str(tmp_path / "p")).collect()))
    with zipfile.ZipFile(tmp_path / "late.zip", "w") as z:
        z.writestr("late.csv", b"k,v\n" + b"1,plain\n" * 200_000 + "2,月份\n".encode("gbk"))
        z.writestr("x.txt", "no")
    assert files.read(spark, str(tmp_path / "late.zip")).where("k = 2").first().v == "月份"
    assert archives.members(str(tmp_path / "late.zip")) == ["late.csv"]


def workbook(path, sheets, order, styles="", book="", links=True):
    """A workbook of sheets (part number -> rows of XML cells), listed in `order`."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{book}<sheets>{"".join(f"""<sheet name="s{n}" sheetId="{n}" r:id="rId{n}"/>""" for n in order)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>""" for n in sheets)}</Relationships>')
        z.writestr("xl/styles.xml", f"<styleSheet {ns}>{styles}</styleSheet>")
        for n, rows in sheets.items():
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {ns}><sheetData>{''.join(f'<row>{r}</row>' for r in rows)}</sheetData></worksheet>")


def test_workbook_types_dates_and_sheets(spark, tmp_path):
    """The first sheet by the workbook's order; dates by number format; columns of one kind keep it."""
    import datetime

    text = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    head = text("A1", "n") + text("B1", "day") + text("C1", "x") + text("D1", "ok") + text("E1", "mixed") + text("F1", "code")
    one = '<c r="A2"><v>5</v></c><c r="B2" s="1"><v>45000</v></c><c r="C2"><v>1.5</v></c><c r="D2" t="b"><v>1</v></c><c r="E2"><v>7</v></c>' + text("F2", "007")
    two = '<c r="A3"><v>6</v></c><c r="B3" s="2"><v>45000.5</v></c><c r="D3" t="b"><v>0</v></c>' + text("E3", "seven")
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd\\ hh:mm"/><numFmt numFmtId="171" formatCode="&quot;days&quot; 0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    workbook(tmp_path / "t.xlsx", {1: [text("A1", "wrong")], 2: [head, one, "", two]}, [2, 1], styles)
    df = files.read_excel(spark, str(tmp_path / "t.xlsx"), ordered=True)
    assert [t for _, t in df.drop(ORDER).dtypes] == ["bigint", "timestamp", "double", "boolean", "string", "string"]
    got = [tuple(r)[:6] for r in df.orderBy(ORDER).collect()]
    assert got == [(5, datetime.datetime(2023, 3, 15), 1.5, True, "7", "007"), (6, datetime.datetime(2023, 3, 15, 12), None, False, "seven", None)]
    workbook(tmp_path / "u.xlsx", {1: [text("A1", "d"), '<c r="A2" s="3"><v>2</v></c>']}, [1], styles, '<workbookPr date1904="1"/>')
    assert files.read_excel(spark, str(tmp_path / "u.xlsx")).dtypes == [("d", "bigint")]
    workbook(tmp_path / "v.xlsx", {1: [text("A1", "d"), '<c r="A2" s="1"><v>2</v></c>']}, [1], styles, '<workbookPr date1904="1"/>')
    assert files.read_excel(spark, str(tmp_path / "v.xlsx")).first().d == datetime.datetime(1904, 1, 3)


def test_line_numbers_of_bad_lines_over_splits(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("".join("bad\n" if i % 97 == 5 else f'{{"a": {i}}}\n' for i in range(1000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "777b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert [r.line for r in files.bad_lines(spark, str(tmp_path / "t.jsonl")).collect()] == [i + 1 for i in range(1000) if i % 97 == 5]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sqlite_filters_become_conditions(spark, tmp_path):
    path = tmp_path / "f.db"
    with sqlite3.connect(path) as db:
        db.execute("create table s (n, x, name collate nocase, odd)")
        db.executemany("insert into s values (?, ?, ?, ?)", [(i, i / 2 if i % 3 else i, ["a", "B", "b", None][i % 4], [i, "text", None][i % 3]) for i in range(200)])
    rows = D.read_sqlite(spark, str(path), "s")
    plain = spark.createDataFrame(rows.collect(), rows.schema)
    cases = [([("n", ">", 50)], "n > 50"), ([("n", "in", [3, 4, 500])], "n in (3, 4, 500)"), ([("x", "<=", 20.5), ("name", "=", "b")], "x <= 20.5 and name = 'b'"), ([("x", ">", 20)], "x > 20"), ([("name", ">", "B")], "name > 'B'"), ([("name", "null", None)], "name is null"), ([("name", "not null", None), ("n", "<>", 4)], "name is not null and n <> 4"), ([("odd", "=", "text")], "odd = 'text'"), ([("odd", "=", "3")], "odd = '3'"), ([("odd", ">=", "2")], "odd >= '2'")]
    for conditions, where in cases:
        got = D.read_sqlite(spark, str(path), "s", None, conditions)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.where(where).collect())), where
    assert rows.count() == 200
    with pytest.raises(ValueError, match="no such condition"):
        D.read_sqlite(spark, str(path), "s", None, [("n", "like", 1)])
    source = D.SqliteSource({"path": str(path), "query": "select n, name from s", "conditions": '[["n", ">", 50], ["name", "=", "b"], ["n", "in", [60, 62]]]'})
    reader = D._SqliteReader(source, ["bigint", "string"], ["n", "name"])
    (part,) = reader.partitions()
    text, values = reader.statement(part)
    assert text.startswith('SELECT n, name FROM "s" WHERE rowid BETWEEN ? AND ? AND "n" > ? AND')
    assert values == [1, 200, 50, "b", 60, 62]
    assert list(reader.read(part)) == [(62, "b")]


def test_jdbc_by_ranges_and_its_keys(spark):
    url = "jdbc:derby:memory:keys;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    for text in ("create table p (id int primary key, name varchar(9) not null)", "create table c (id int primary key, p_id int references p(id), v double)"):
        connection.createStatement().execute(text)
    connection.close()
    spark.range(40).selectExpr("cast(id as int) id", "concat('n', id) name").write.jdbc(url, "p", "append")
    spark.range(90).selectExpr("cast(id as int) id", "cast(id % 40 as int) p_id", "id / 4 v").write.jdbc(url, "c", "append")
    df = D.read_jdbc(spark, url, "select id, v from c", column="id", parts=3)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in df.collect()) == [(i, i / 4) for i in range(90)]
    assert D.read_jdbc(spark, url, "select id from c where v > 99", column="id").count() == 0
    assert D.read_jdbc(spark, url, "select count(*) as n from p").first()[0] == 40
    keys = D.jdbc_keys(spark, url, ["P", "C"])
    assert keys["P"] == {"primary": ["ID"], "required": ["ID", "NAME"], "foreign": {}}
    assert keys["C"] == {"primary": ["ID"], "required": ["ID"], "foreign": {"P_ID": "P.ID"}}


def test_find_keys(spark):
    """Large sets that differ by one value, nulls, values that repeat, other types, columns without values."""
    a = spark.range(30_000).selectExpr("id", "if(id % 7 = 0, null, id) some", "id + 1 shifted", "cast(id as string) t", "cast(null as int) nothing")
    b = spark.range(60_000).selectExpr("id k", "id % 30000 twice", "cast(id as string) u")
    got = D.find_keys({"a": a, "b": b})
    assert got == [("a", "id", "b", "k"), ("a", "shifted", "b", "k"), ("a", "some", "a", "id"), ("a", "some", "a", "shifted"), ("a", "some", "b", "k"), ("a", "t", "b", "u"), ("b", "twice", "a", "id"), ("b", "twice", "b", "k")]
    assert D.find_keys({"x": spark.range(3).selectExpr("array(id) l")}) == []


def test_workbooks_are_written_by_many_tasks_and_parsed_once(spark, tmp_path, monkeypatch):
    """No task has all rows, and no later step parses a workbook again."""
    from pathlib import Path

    from tablesmith.plans import written as W

    monkeypatch.setattr(W, "BOOK_ROWS", 40)
    rows = spark.range(200).selectExpr("id", "if(id % 3 = 0, null, concat('<', id)) t", "date_add(date'2020-01-01', cast(id as int)) d")
    W.workbooks(rows, f"file://{tmp_path}")
    books = sorted(Path(tmp_path).glob("*.xlsx"))
    assert len(books) == 5
    df = files.read(spark, f"file://{tmp_path}/*.xlsx", ordered=False)
    for book in books:
        book.unlink()
    got = df.selectExpr("id", "t", "cast(d as date) d").exceptAll(rows)
    assert df.count() == 200 and got.isEmpty()


def test_ids_are_counted_apart_from_sketches(spark):
    """Beside an exact count Spark would keep a sketch of each column for every different id."""
    df = spark.range(50_000).selectExpr("id", "if(id % 2 = 0, id, null) uuid", "cast(id % 7 as string) s")
    found = {c.name: c.distinct for c in P.profile(df).columns}
    assert (found["id"], found["uuid"], found["s"]) == (50_000, 25_000, 7)
    assert P.exact_distinct(df, ["uuid", "s"]) == {"uuid": 25_000, "s": 7}
    assert P.exact_distinct(df, []) == {}


def test_find_keys_of_few_values_in_many(spark):
    """A handful of values among very many, of which a sketch would keep hardly one."""
    few = spark.range(5).selectExpr("id * 9973 k", "concat('n', id * 9973) t")
    many = spark.range(60_000).selectExpr("id", "concat('n', id) name", "if(id = 7, 8, id) other")
    assert D.find_keys({"few": few, "many": many}) == [("few", "k", "many", "id"), ("few", "t", "many", "name"), ("many", "other", "many", "id")]


def test_csv_files_are_written_by_each_partition(spark, tmp_path):
    from tablesmith.plans import written as W

    rows = spark.range(90).selectExpr("concat('\"', id, ',\r\n\"') a", "cast(id as string) b")
    W.csv_files(rows.repartition(3), f"file://{tmp_path}", "rows")
    assert len(list(tmp_path.glob("*/rows.csv"))) == 3
    got = files.read_csv(spark, f"file://{tmp_path}/*", schema="a string, b string")
    assert got.count() == 90 and got.exceptAll(rows).isEmpty()
    W.csv_files(rows.where("b = 'x'").repartition(3), f"file://{tmp_path}/none")
    assert len(list(tmp_path.glob("none/*/part.csv"))) == 1


def test_archive_has_a_member_for_each_partition(spark, monkeypatch):
    from tests import oracle
    from tablesmith.plans import registered

    found = []
    write, pack = registered.W.csv_files, registered.W.archive
    monkeypatch.setattr(registered.W, "csv_files", lambda df, path, stem: write(df.repartition(3) if stem == "cells" else df, path, stem))
    monkeypatch.setattr(registered.W, "archive", lambda spark, members, path: (found.extend(members), pack(spark, members, path)))
    got = registered.QUERIES["scan_zip"](spark, oracle.DATA)
    assert sum(n.endswith("cells.csv") for n in found) == 3
    assert {r[0]: r[1] for r in got.groupBy("source_file").count().collect()} == {"cells": 1000, "nations": 25}
