"""Row expressions: meaning, and what is refused."""

import pytest
from pyspark.sql import functions as F

from tablesmith.functions.exprs import ExpressionError, compile_condition, compile_expression


@pytest.fixture(scope="module")
def one(spark):
    return spark.sql("select 7 a, -7 n, 2.5d x, ' Text ' s, '1,200' m, '2024-06-01' d, cast(null as int) z, 0 zero, 'a-b-c' p, true t")


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("row['a'] / 2", 3.5), ("row['a'] / row['zero']", None), ("row['n'] // 2", -4), ("row['n'] % 3", 2), ("row['a'] ** 2", 49.0),
        ("str(row['d'])[:4]", "2024"), ("str(row['d'])[5:7]", "06"), ("row['d'][-2:]", "01"), ("row['s'].strip().lower()", "text"),
        ("float(str(row['m']).replace(',', ''))", 1200.0), ("float(row['s'])", None), ("int(row['x'])", 2), ("len(row['p'])", 5),
        ("row['p'].split('-')[1]", "b"), ("row['p'].split('-')[-1]", "c"), ("row['s'] + '!'", " Text !"), ("abs(row['n'])", 7),
        ("'big' if row['a'] > 5 else 'small'", "big"), ("min(row['a'], row['n'])", -7), ("row['a'] is not None", True), ("pd.isna(row['z'])", True),
        ("1 < row['a'] < 10", True), ("row['a'] in [1, 7]", True), ("row['a'] not in (1, 7)", False), ("not row['zero']", True), ("round(row['x'] * 1.11, 1)", 2.8),
        ("row.get('none', 3)", 3), ("-row['a'] + +row['a']", 0), ("row['z'] == 1 or row['a'] == 7", True),
    ],
)
def test_value(one, text, value):
    got = one.select(compile_expression(text, one).alias("v")).first().v
    assert got == value or abs(got - value) < 1e-9


@pytest.mark.parametrize(
    "text",
    ["__import__('os')", "row.__class__", "(lambda: 1)()", "open('x')", "[x for x in row]", "row['none']", "row['a'] @ 2", "f'{row}'", "row", "row['p'].split('-').sort()", "1 +", "row['a'] is 7", "pd.read_csv('x')"],
)
def test_refused(one, text):
    with pytest.raises(ExpressionError):
        compile_expression(text, one)


def test_null_is_false(one):
    assert one.where(compile_condition("row['z'] > 1", one)).count() == 0
    assert one.where(compile_condition("row['z']", one)).count() == 0
    assert one.where(compile_condition("row['t']", one)).count() == 1
    assert one.where(~F.lit(True) | compile_condition("row['s']", one)).count() == 1
