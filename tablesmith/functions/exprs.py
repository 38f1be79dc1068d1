"""Row expressions in Python syntax, compiled to Spark columns.

`row['amount'] * 2`, `str(row['day'])[:4]`, `row['a'] > 1 and not pd.isna(row['b'])`.
The text is parsed by Python and each allowed node becomes a column, so that the
whole expression runs inside generated code; anything else is an error that
names the node. Nothing is ever evaluated as Python.

Division is true division and gives NULL by zero, `//` floors, `%` takes the
divisor's sign, `int` cuts off towards zero, `round` takes halves to the even
neighbour, `int` and `float` give NULL for what they can't read."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExpressionError(ValueError):
    pass


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_float(c: Column) -> Column:
    """A double, or NULL for what is none (and for NaN)."""
    return nan_to_null(c.try_cast("double"))


def to_text(c: Column) -> Column:
    return c.cast("string")


def floor_mod(a: Column, b: Column) -> Column:
    return F.when(b != 0, ((a % F.nullif(b, F.lit(0))) + b) % F.nullif(b, F.lit(0)))


_COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
_FUNCTIONS = {
    "str": to_text,
    "float": to_float,
    "int": lambda c: to_float(c).try_cast("long"),
    "abs": F.abs,
    "len": F.length,
    "round": lambda c, n=None: F.bround(c, 0).try_cast("long") if n is None else F.bround(c, n),
    "min": lambda *c: F.least(*c),
    "max": lambda *c: F.greatest(*c),
}
_METHODS = {
    "strip": lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""),
    "lower": F.lower,
    "upper": F.upper,
    "startswith": lambda c, p: c.startswith(p),
    "endswith": lambda c, p: c.endswith(p),
    "replace": lambda c, a, b: F.replace(c, F.lit(a), F.lit(b)),
    "split": lambda c, s=None: F.split(c, r"\s+" if s is None else "\\Q" + s + "\\E"),
}
#: Methods whose arguments are plain values.
_PLAIN = {"startswith", "endswith", "replace", "split"}


class _Compiler:
    def __init__(self, df: DataFrame | None):
        self.types = {f.name: f.dataType for f in df.schema.fields} if df is not None else None

    def fail(self, node: ast.AST, why: str = "is not allowed") -> ExpressionError:
        return ExpressionError(f"{type(node).__name__} {ast.unparse(node)!r} {why}")

    def text(self, node: ast.AST) -> bool:
        """Whether the node is surely a string: `+` joins then."""
        match node:
            case ast.Constant(value=str()) | ast.JoinedStr():
                return True
            case ast.Call(func=ast.Name(id="str")):
                return True
            case ast.Call(func=ast.Attribute(attr=a)) if a in ("strip", "lower", "upper", "replace"):
                return True
            case ast.Subscript(value=ast.Name(id="row"), slice=ast.Constant(value=str(name))):
                return bool(self.types) and isinstance(self.types.get(name), T.StringType)
            case ast.Subscript(value=v, slice=ast.Slice()):
                return self.text(v)
            case ast.Subscript(value=ast.Call(func=ast.Attribute(attr="split"))):
                return True
            case ast.BinOp(op=ast.Add(), left=a, right=b):
                return self.text(a) or self.text(b)
            case ast.IfExp(body=a):
                return self.text(a)
        return False

    def truth(self, node: ast.AST) -> Column:
        """A condition: comparisons as they are, other values by Python's truth; NULL is false."""
        if isinstance(node, ast.Compare | ast.BoolOp) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return F.coalesce(self.column(node), F.lit(False))
        if isinstance(node, ast.Call) and (isinstance(node.func, ast.Attribute) and node.func.attr in ("isna", "notna", "startswith", "endswith")):
            return F.coalesce(self.column(node), F.lit(False))
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return F.lit(node.value)
        value = self.column(node)
        if self.text(node):
            return F.coalesce(F.length(value) > 0, F.lit(False))
        if isinstance(node, ast.Subscript) and self.types and isinstance(self.types.get(getattr(node.slice, "value", None)), T.BooleanType):
            return F.coalesce(value, F.lit(False))
        return F.coalesce(value != 0, F.lit(False))

    def predicate(self, node: ast.AST) -> Column:
        """truth() for a filter, which drops NULL as it drops false: comparisons stay bare, so that they reach the scan."""
        match node:
            case ast.BoolOp(op=op, values=values):
                out = self.predicate(values[0])
                for v in values[1:]:
                    out = out & self.predicate(v) if isinstance(op, ast.And) else out | self.predicate(v)
                return out
            case ast.Compare(ops=ops) if not any(isinstance(x, ast.In | ast.NotIn) for x in ops):
                return self.column(node)
            case ast.Compare(left=a, ops=[ast.In()], comparators=[ast.List() | ast.Tuple() | ast.Set() as b]):
                return self.column(a).isin(list(self.plain(b)))
        return self.truth(node)

    def plain(self, node: ast.AST):
        try:
            value = ast.literal_eval(node)
        except ValueError:
            raise self.fail(node, "must be a constant here") from None
        return value

    def column(self, node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=None | bool() | int() | float() | str() as v):
                return F.lit(v)
            case ast.Subscript(value=ast.Name(id="row"), slice=ast.Constant(value=str(name))):
                return self.field(node, name)
            case ast.Call(func=ast.Attribute(value=ast.Name(id="row"), attr="get"), args=[ast.Constant(value=str(name)), *rest]) if len(rest) < 2:
                if self.types is not None and name not in self.types:
                    return self.column(rest[0]) if rest else F.lit(None)
                return self.field(node, name)
            case ast.Subscript(value=v, slice=ast.Slice(lower=a, upper=b, step=None)):
                return self.sliced(self.column(v), a, b)
            case ast.Subscript(value=ast.Call(func=ast.Attribute(attr="split")) as v, slice=i):
                return self.item(self.column(v), self.plain(i))
            case ast.Subscript(value=v, slice=i):
                at = self.plain(i)
                if not isinstance(at, int):
                    raise self.fail(node)
                return F.substring(self.column(v), at + 1 if at >= 0 else at, 1)
            case ast.BinOp(left=a, op=op, right=b):
                return self.arithmetic(node, op, a, b)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~self.truth(x)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -self.column(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return self.column(x)
            case ast.BoolOp(op=op, values=values):
                out = self.truth(values[0])
                for v in values[1:]:
                    out = out & self.truth(v) if isinstance(op, ast.And) else out | self.truth(v)
                return out
            case ast.Compare(left=left, ops=ops, comparators=rights):
                out = None
                for op, right in zip(ops, rights, strict=True):
                    one = self.compare(node, left, op, right)
                    out, left = one if out is None else out & one, right
                return out
            case ast.IfExp(test=t, body=a, orelse=b):
                return F.when(self.truth(t), self.column(a)).otherwise(self.column(b))
            case ast.Call(func=ast.Attribute(value=ast.Name(id="pd"), attr="isna" | "isnull" | "notna" | "notnull" as f), args=[x], keywords=[]):
                null = self.column(x).isNull()
                return null if f.startswith("is") else ~null
            case ast.Call(func=ast.Name(id=f), args=args, keywords=[]) if f in _FUNCTIONS and args:
                if f == "round":
                    return _FUNCTIONS[f](self.column(args[0]), *[self.plain(x) for x in args[1:]])
                return _FUNCTIONS[f](*map(self.column, args))
            case ast.Call(func=ast.Attribute(value=v, attr=f), args=args, keywords=[]) if f in _METHODS:
                return _METHODS[f](self.column(v), *[self.plain(x) for x in args])
        raise self.fail(node)

    def field(self, node: ast.AST, name: str) -> Column:
        if self.types is not None and name not in self.types:
            raise self.fail(node, "names no column")
        return F.col("`" + name.replace("`", "``") + "`")

    def sliced(self, value: Column, lower: ast.AST | None, upper: ast.AST | None) -> Column:
        a, b = (None if x is None else self.plain(x) for x in (lower, upper))
        size = F.length(value)
        place = lambda x: F.lit(x) if x >= 0 else F.greatest(size + x, F.lit(0))
        start = place(a or 0)
        stop = size if b is None else place(b)
        return F.substring(value, start + 1, F.greatest(stop - start, F.lit(0)))

    def item(self, values: Column, at: int) -> Column:
        return F.get(values, F.lit(at) if at >= 0 else F.size(values) + at)

    def arithmetic(self, node: ast.AST, op: ast.AST, a: ast.AST, b: ast.AST) -> Column:
        if isinstance(op, ast.Add) and (self.text(a) or self.text(b)):
            return F.concat(self.column(a).cast("string"), self.column(b).cast("string"))
        x, y = self.column(a), self.column(b)
        match op:
            case ast.Add():
                return x + y
            case ast.Sub():
                return x - y
            case ast.Mult():
                return x * y
            case ast.Div():
                return F.try_divide(x.cast("double"), y.cast("double"))
            case ast.FloorDiv():
                return F.floor(F.try_divide(x.cast("double"), y.cast("double")))
            case ast.Mod():
                return floor_mod(x, y)
            case ast.Pow():
                return F.pow(x, y)
        raise self.fail(node)

    def compare(self, node: ast.AST, a: ast.AST, op: ast.AST, b: ast.AST) -> Column:
        if isinstance(op, ast.Is | ast.IsNot):
            if not (isinstance(b, ast.Constant) and b.value is None):
                raise self.fail(node, "compares identity with more than None")
            null = self.column(a).isNull()
            return null if isinstance(op, ast.Is) else ~null
        if isinstance(op, ast.In | ast.NotIn):
            if self.text(b) and not isinstance(b, ast.List | ast.Tuple | ast.Set):
                found = F.contains(self.column(b), self.column(a))
            else:
                found = self.column(a).isin(list(self.plain(b)))
            return F.coalesce(found if isinstance(op, ast.In) else ~found, F.lit(isinstance(op, ast.NotIn)))
        x, y = self.column(a), self.column(b)
        if isinstance(op, ast.NotEq):
            return ~x.eqNullSafe(y)
        return getattr(x, _COMPARE[type(op)])(y)


def compile_expression(text: str, df: DataFrame | None = None) -> Column:
    """The column of a row expression. With df, unknown columns are an error and
    string columns are known as such."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text!r} ({e.msg})") from None
    return _Compiler(df).column(tree.body)


def compile_condition(text: str, df: DataFrame | None = None) -> Column:
    """As compile_expression, for a filter: by Python's truth, NULL is false."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text!r} ({e.msg})") from None
    return _Compiler(df).predicate(tree.body)
