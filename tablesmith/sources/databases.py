"""Databases: guarded read-only SQL over registered views, query sets, schema
introspection, a SQLite reader and JDBC options."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tablesmith.session import package_on_workers

MOST_ROWS = 100_000
MOST_QUERIES = 5
TABLE_ROWS = 1000
#: Rowids of one partition of a SQLite table, and partitions at most (they get wider then).
PARTITION_ROWS, MOST_PARTITIONS = 50_000, 1000
PORTS = {"mysql": 3306, "postgresql": 5432, "postgres": 5432, "sqlserver": 1433, "mssql": 1433, "oracle": 1521}

#: Nodes of Spark's parsed plans that only read. A statement of any other kind is refused.
READING = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Join LateralJoin Union Intersect Except SubqueryAlias "
    "UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedWith UnresolvedHaving "
    "WithWindowDefinition Generate Pivot Unpivot UnresolvedHint ResolvedHint Window Expand Sample "
    "ShowTables ShowColumns DescribeRelation ExplainCommand ShowTablesCommand UnresolvedTableOrView UnresolvedNamespace CurrentNamespace".split()
)
_CODE = re.compile(r"\b(java_method|reflect|try_reflect)\s*\(", re.IGNORECASE)
_PATHS = {"parquet", "csv", "json", "orc", "text", "binaryfile", "avro", "xml"}


class RefusedQuery(ValueError):
    pass


def _nodes(plan) -> Iterator:
    """All nodes of a parsed plan: children, subqueries, and the parts of WITH and EXPLAIN."""
    stack = [plan]
    while stack:
        p = stack.pop()
        yield p
        for seq in (p.children(), p.innerChildren(), p.subqueries()):
            it = seq.iterator()
            while it.hasNext():
                x = it.next()
                if hasattr(x, "nodeName") and hasattr(x, "subqueries"):
                    stack.append(x)
        if p.nodeName() == "ExplainCommand":
            stack.append(p.logicalPlan())


def check_query(spark: SparkSession, sql: str) -> None:
    """Raises RefusedQuery for all but single reading statements over registered tables."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise RefusedQuery(f"not one statement: {str(e).splitlines()[0][:200]}") from None
    for node in _nodes(plan):
        name = node.nodeName().rstrip("$")
        if name not in READING and not name.startswith("CTE"):
            raise RefusedQuery(f"{name} is not allowed")
        if name == "UnresolvedRelation":
            parts = node.multipartIdentifier().mkString("\x00").split("\x00")
            if len(parts) > 1 and parts[0].lower() in _PATHS:
                raise RefusedQuery(f"files are not read by path: {'.'.join(parts)}")
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql)
    if _CODE.search(bare):
        raise RefusedQuery("calls into the JVM are not allowed")


def guarded_sql(spark: SparkSession, sql: str, most: int | None = None) -> DataFrame:
    """All rows of a checked statement; `most` (MOST_ROWS is the reference's row guard) cuts them off where a caller asks for it."""
    check_query(spark, sql)
    return spark.sql(sql) if most is None else spark.sql(sql).limit(most)


@dataclass(frozen=True)
class NamedQuery:
    body: str
    name: str = "query"
    explanation: str = ""


Planner = Callable[[str, list[str]], list[NamedQuery]]


def per_table(spark: SparkSession, tables: list[str] | None = None, rows: int = TABLE_ROWS, most: int = MOST_QUERIES) -> list[NamedQuery]:
    names = tables or [t.name for t in spark.catalog.listTables() if t.isTemporary or t.tableType != "VIEW"]
    return [NamedQuery(f"SELECT * FROM `{t}` LIMIT {rows}", t) for t in names[:most]]


def query_set(spark: SparkSession, mode: str = "auto", query: str | None = None, question: str = "", planner: Planner | None = None, most: int = MOST_QUERIES) -> dict[str, DataFrame]:
    """An explicit query wins; auto asks the planner and falls back to one sample
    for each table. Names are made unique; failures are left out, unless all fail."""
    if query:
        plan = [NamedQuery(query)]
    elif mode == "auto" and planner:
        plan = planner(question, [t.name for t in spark.catalog.listTables()])[:most] or per_table(spark, most=most)
    else:
        plan = per_table(spark, most=1 if mode == "single" else most)
    out, errors = {}, []
    for q in plan:
        name, n = q.name, 0
        while name in out:
            n += 1
            name = f"{q.name}_{n}"
        try:
            out[name] = guarded_sql(spark, q.body)
        except Exception as e:
            errors.append(f"{q.name}: {str(e).splitlines()[0]}")
    if plan and not out:
        raise ValueError("no query worked: " + "; ".join(errors))
    return out


def introspect(tables: dict[str, DataFrame], keys: dict[str, dict] | None = None, samples: int = 3) -> list[dict]:
    """Columns (name, type, nullable, primary_key, foreign_key), rows and sample rows of each table. keys has what Spark
    does not know: table -> {"primary": [columns], "foreign": {column: "table.column"}, "required": [columns]}."""
    out = []
    for name, df in tables.items():
        known = (keys or {}).get(name, {})
        columns = [
            {"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable and f.name not in known.get("required", ()), "primary_key": f.name in known.get("primary", ()), "foreign_key": known.get("foreign", {}).get(f.name)}
            for f in df.schema.fields
        ]
        out.append({"table": name, "columns": columns, "rows": df.count(), "samples": [r.asDict() for r in df.limit(samples).collect()]})
    return out


def sqlite_keys(path: str) -> dict[str, dict]:
    """Primary and foreign keys and required columns of all tables of a SQLite file, as `introspect` takes them."""
    import sqlite3

    out = {}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
            quoted = table.replace('"', '""')
            info = db.execute(f'PRAGMA table_info("{quoted}")').fetchall()
            links = db.execute(f'PRAGMA foreign_key_list("{quoted}")').fetchall()
            out[table] = {"primary": [r[1] for r in sorted(info, key=lambda r: r[5]) if r[5]], "required": [r[1] for r in info if r[3]], "foreign": {r[3]: f"{r[2]}.{r[4] or 'rowid'}" for r in links}}
    return out


def jdbc_url(kind: str, host: str, database: str, port: int | None = None) -> str:
    kind = {"postgres": "postgresql", "mssql": "sqlserver"}.get(kind, kind)
    if kind not in PORTS:
        raise ValueError(f"no database of kind {kind}")
    port = port or PORTS[kind]
    if kind == "sqlserver":
        return f"jdbc:sqlserver://{host}:{port};databaseName={database}"
    return f"jdbc:oracle:thin:@//{host}:{port}/{database}" if kind == "oracle" else f"jdbc:{kind}://{host}:{port}/{quote_plus(database)}"


def read_jdbc(spark: SparkSession, url: str, query: str, user: str = "", password: str = "", column: str | None = None, parts: int = 0, **options: str) -> DataFrame:
    """A query's rows. With column (a number, a date or a time) they are read by ranges of it: its least and greatest value
    are asked for first, and `parts` tasks (by default as many as the session has cores) read a range each; rows without
    a value come with the first. Filters and columns reach the database either way."""
    connect = lambda **what: spark.read.format("jdbc").options(url=url, user=user, password=password, **options, **what)
    if column is None:
        return connect(query=query).load()
    low, high = connect(query=f"SELECT min({column}) AS low, max({column}) AS high FROM ({query}) q").load().first()
    reader = connect(dbtable=f"({query}) q")
    if low is None:
        return reader.load()
    return reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts or spark.sparkContext.defaultParallelism)).load()


def jdbc_keys(spark: SparkSession, url: str, tables: list[str], user: str = "", password: str = "", schema: str | None = None) -> dict[str, dict]:
    """Primary and foreign keys and required columns of tables, from the database's own metadata, as `introspect` takes them."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, user, password)
    try:
        about = connection.getMetaData()

        def rows(found, *names: str) -> list[tuple]:
            out = []
            while found.next():
                out.append(tuple(found.getString(n) for n in names))
            found.close()
            return out

        out = {}
        for t in tables:
            primary = sorted((int(n), c) for c, n in rows(about.getPrimaryKeys(None, schema, t), "COLUMN_NAME", "KEY_SEQ"))
            links = rows(about.getImportedKeys(None, schema, t), "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME")
            columns = rows(about.getColumns(None, schema, t, "%"), "COLUMN_NAME", "IS_NULLABLE")
            out[t] = {"primary": [c for _, c in primary], "required": [c for c, nullable in columns if nullable == "NO"], "foreign": {c: f"{ref}.{of}" for c, ref, of in links}}
        return out
    finally:
        connection.close()


def find_keys(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """(table, column, other table, its column) where all values of a column are values of the other, which has each of its
    own once: what a foreign key would be. Columns of whole numbers, text or dates are taken, one kind against itself. Each
    different value of a column is met once with those of all others; the columns that hold a value make pairs, and a
    pair with as many common values as the first column has is included. A column without values is none."""
    families = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "string": "string", "date": "date"}
    columns, parts = [], []
    for name, df in tables.items():
        mine = [(c, families[k]) for c, k in df.dtypes if k in families]
        cells = [F.struct(F.lit(len(columns) + i).alias("column"), F.lit(family).alias("family"), F.col(f"`{c}`").cast("string").alias("value")) for i, (c, family) in enumerate(mine)]
        columns += [(name, c) for c, _ in mine]
        if cells:
            parts.append(df.select(F.inline(F.array(*cells))).where("value is not null"))
    if not parts:
        return []
    each = reduce(DataFrame.union, parts).groupBy("column", "family", "value").agg((F.count("*") > 1).alias("twice"))
    held = each.groupBy("family", "value").agg(F.sort_array(F.collect_list(F.struct("column", "twice"))).alias("held"))
    alike = held.groupBy("held").agg(F.count("*").alias("n")).withColumn("a", F.explode("held")).withColumn("b", F.explode("held"))
    common = {(r.a, r.b): r for r in alike.groupBy("a.column", F.col("b.column").alias("b")).agg(F.sum("n").alias("n"), F.bool_or("b.twice").alias("twice")).toDF("a", "b", "n", "twice").collect()}
    included = [(a, b) for (a, b), r in common.items() if a != b and r.n == common[a, a].n and not common[b, b].twice]
    return sorted((*columns[a], *columns[b]) for a, b in included)


class SqliteSource(DataSource):
    """spark.read.format("sqlite").option("path", ...).option("query", ...): one
    partition for each range of rowid where the query is a table's name or takes
    columns of all its rows; another query is read in one task. Option conditions:
    a JSON list of what else rows must meet (read_sqlite makes it)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def _table(self) -> str | None:
        """The table that the query names or selects as a whole, if it has rowids; quoted."""
        m = re.fullmatch(r"""\s*(?:select\s+(?P<columns>\*|\w+(?:\s*,\s*\w+)*)\s+from\s+)?("?)(\w+)\2\s*;?\s*""", self.options["query"], re.IGNORECASE)
        if not m:
            return None
        self.columns = m.group("columns") or "*"
        import sqlite3

        with self._connect() as db:
            try:
                if not db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND lower(name) = lower(?)", [m.group(3)]).fetchone():
                    return None
                names = [d[0].lower() for d in db.execute(f'SELECT * FROM "{m.group(3)}" LIMIT 0').description]
                db.execute(f'SELECT rowid FROM "{m.group(3)}" LIMIT 0')
            except sqlite3.Error:
                return None
        if "rowid" in names:  # a column of that name hides the real one
            return None
        return f'"{m.group(3)}"'

    def statement(self) -> str:
        table = self._table()
        return f"SELECT {self.columns} FROM {table}" if table else self.options["query"].strip().rstrip(";")

    def schema(self) -> str:
        """Types of all rows: whole numbers among others with a fraction make a double, other mixtures text."""
        kinds = {"integer": "bigint", "real": "double", "blob": "binary"}
        with self._connect() as db:
            names = [d[0] for d in db.execute(f"SELECT * FROM ({self.statement()}) LIMIT 0").description]
            places = [f"c{i}" for i in range(len(names))]
            parts = [f"max(typeof({c}) = '{k}')" for c in places for k in ("integer", "real", "blob", "text")]
            found = db.execute(f"WITH q({', '.join(places)}) AS ({self.statement()}) SELECT {', '.join(parts)} FROM q").fetchone()
        sets = [{k for k, x in zip(("integer", "real", "blob", "text"), found[4 * i : 4 * i + 4], strict=True) if x} for i in range(len(names))]
        kind = lambda s: "double" if s == {"integer", "real"} else kinds.get(next(iter(s)), "string") if len(s) == 1 else "string"
        return ", ".join(f"`{n}` {kind(s)}" for n, s in zip(names, sets, strict=True))

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self, [f.dataType.simpleString() for f in schema.fields], schema.names)


class _Rows(InputPartition):
    """Rowids from first to last; None for a query that is read as one."""

    def __init__(self, first: int | None = None, last: int | None = None):
        self.first, self.last = first, last


def _as_kind(v, kind: str):
    """A value as the column's type; a number is never cut."""
    if kind == "bigint" and not isinstance(v, int):
        raise ValueError(f"{v!r} in a column of whole numbers")
    return {"double": float, "string": str, "bigint": int, "binary": bytes}[kind](v)


SIGNS = ("=", "<>", ">", ">=", "<", "<=", "in", "null", "not null")
Condition = tuple[str, str, object]


def _condition(name: str, sign: str, value, kinds: dict[str, str]) -> tuple[str, list] | None:
    """SQL that holds for at least the rows for which the condition does; None if that can't be said of the column."""
    if sign in ("null", "not null"):
        return f'"{name}" IS {sign.upper()}', []
    return _compared(name, sign.upper(), list(value) if sign == "in" else [value], kinds)


def _compared(name: str, sign: str, values: list, kinds: dict[str, str]) -> tuple[str, list] | None:
    kind = kinds.get(name)
    if kind not in ("bigint", "double", "string") or not all(isinstance(v, {"bigint": int, "double": int | float, "string": str}[kind]) for v in values):
        return None
    name = '"' + name.replace('"', '""') + '"'
    places = f"({', '.join('?' * len(values))})" if sign == "IN" else "?"
    if kind == "string":  # a column of text may have other values, which Spark sees as text
        return f"(typeof({name}) <> 'text' OR {name} COLLATE BINARY {sign} {places})", values
    return f"{f'CAST({name} AS REAL)' if kind == 'double' else name} {sign} {places}", values


class _SqliteReader(DataSourceReader):
    def __init__(self, source: SqliteSource, kinds: list[str], names: list[str] | None = None):
        self.source, self.kinds = source, kinds
        known = dict(zip(names or [], kinds, strict=False))
        made = [_condition(*c, known) for c in json.loads(source.options.get("conditions", "[]"))]
        self.conditions = [c for c in made if c]

    def partitions(self) -> list[_Rows]:
        table = self.source._table()
        if not table:
            return [_Rows()]
        with self.source._connect() as db:
            first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
        if first is None:
            return [_Rows()]
        width = max(PARTITION_ROWS, -(-(last - first + 1) // MOST_PARTITIONS))
        return [_Rows(i, min(i + width - 1, last)) for i in range(first, last + 1, width)]

    def statement(self, partition: _Rows) -> tuple[str, list]:
        """What a partition's task asks, and its values."""
        ranged = partition.first is not None
        conditions = [("rowid BETWEEN ? AND ?", [partition.first, partition.last])] * ranged + self.conditions
        query = self.source.statement() if ranged or not conditions else f"SELECT * FROM ({self.source.statement()})"
        where = " WHERE " + " AND ".join(c for c, _ in conditions) if conditions else ""
        return query + where, [v for _, values in conditions for v in values]

    def read(self, partition):
        with self.source._connect() as db:
            for row in db.execute(*self.statement(partition)):
                yield tuple(None if v is None else _as_kind(v, k) for v, k in zip(row, self.kinds, strict=True))


def register_sqlite(spark: SparkSession) -> None:
    package_on_workers(spark)
    spark.dataSource.register(SqliteSource)


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, conditions: list[Condition] = ()) -> DataFrame:
    """Columns of a table's rows that meet all conditions (column, one of SIGNS, value), which SQLite checks; Spark checks
    them again, as a column of text may hold other values. They are given here and not taken from `where`: Spark 4.1
    keeps filters that it has pushed into a Python source for later queries over the same DataFrame."""
    if bad := [c for c in conditions if c[1] not in SIGNS]:
        raise ValueError(f"no such condition: {bad[0]}")
    register_sqlite(spark)
    query = f"select {', '.join(columns)} from {table}" if columns else table
    df = spark.read.format("sqlite").options(path=path, query=query, conditions=json.dumps(list(conditions))).load()
    for name, sign, value in conditions:
        c = F.col(f"`{name}`")
        other = None if sign in ("in", "null", "not null") else F.lit(value)
        df = df.where({"=": lambda: c == other, "<>": lambda: c != other, ">": lambda: c > other, ">=": lambda: c >= other, "<": lambda: c < other, "<=": lambda: c <= other, "in": lambda: c.isin(list(value)), "null": c.isNull, "not null": c.isNotNull}[sign]())  # noqa: B023
    return df


# -- keywords --------------------------------------------------------------


def search(df: DataFrame, column: str, keyword: str, most: int = 20) -> DataFrame:
    """Rows whose column holds the keyword, whatever the letter case: the first by that column, then by all others."""
    return df.where(F.contains(F.lower(column), F.lit(keyword.lower()))).orderBy(column, *[c for c in df.columns if c != column]).limit(most)


def resolve_keyword(keyword: str, aliases: dict[str, str]) -> str | None:
    """Exact alias, else one that holds the keyword or is held by it."""
    low = {k.lower(): v for k, v in aliases.items()}
    k = keyword.strip().lower()
    return low.get(k) or next((v for a, v in low.items() if k and (k in a or a in k)), None)
