"""Column expressions with floating-point semantics: division and logarithms give inf or NaN, never an error or NULL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def num(c) -> Column:
    return col(c).cast("double")


def div(a, b) -> Column:
    a, b = num(a), num(b)
    zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def ln(x) -> Column:
    x = num(x)
    return F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(F.ln(x))


def truth(c: Column) -> Column:
    """A comparison as 1.0 or 0.0."""
    return F.when(c, 1.0).otherwise(0.0)


def compare(op: str, a, b) -> Column:
    """IEEE comparisons: NaN is unequal to all and neither less nor greater."""
    a, b = num(a), num(b)
    odd = F.isnan(a) | F.isnan(b)
    plain = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b, "==": a == b, "!=": a != b}[op]
    return truth(F.when(odd, F.lit(op == "!=")).otherwise(plain))


def where(cond, a, b) -> Column:
    c = num(cond)
    return F.when((c != 0) | F.isnan(c), num(a)).otherwise(num(b))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


_LEX = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|(<=|>=|==|!=|&&|\|\||[-+*/%<>!?:(),]))")
_CALLS = {
    "exp": lambda x: F.exp(x), "log": lambda x: ln(x), "sqrt": lambda x: F.sqrt(x), "abs": lambda x: F.abs(x), "fabs": lambda x: F.abs(x),
    "fmin": lambda x, y: F.least(x, y), "fmax": lambda x, y: F.greatest(x, y), "pow": lambda x, y: F.pow(x, y), "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"), "sin": lambda x: F.sin(x), "cos": lambda x: F.cos(x), "tan": lambda x: F.tan(x), "tanh": lambda x: F.tanh(x),
}
#: Binary operators from the loosest to the tightest.
_LEVELS = [("||",), ("&&",), ("==", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%")]


class _Formula:
    """A formula's parser. Values are pairs: a column, and whether it is a truth."""

    def __init__(self, text: str, columns: dict):
        self.columns, self.tokens, at = columns, [], 0
        while at < len(text.rstrip()):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at : at + 10]!r} in a formula")
            self.tokens.append(m[0].strip())
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or wanted is not None and token != wanted:
            raise ValueError(f"expected {wanted or 'more'}, found {token or 'the end'} in a formula")
        self.at += 1
        return token

    @staticmethod
    def number(v: tuple[Column, bool]) -> Column:
        return truth(v[0]) if v[1] else v[0]

    @staticmethod
    def truth(v: tuple[Column, bool]) -> Column:
        return v[0] if v[1] else (v[0] != 0) | F.isnan(v[0])

    def ternary(self) -> tuple[Column, bool]:
        c = self.binary(0)
        if self.peek() != "?":
            return c
        self.take("?")
        yes = self.ternary()
        self.take(":")
        no = self.ternary()
        if yes[1] and no[1]:
            return F.when(self.truth(c), yes[0]).otherwise(no[0]), True
        return F.when(self.truth(c), self.number(yes)).otherwise(self.number(no)), False

    def binary(self, level: int) -> tuple[Column, bool]:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in _LEVELS[level]:
            op = self.take()
            right = self.binary(level + 1)
            if op in ("&&", "||"):
                a, b = self.truth(left), self.truth(right)
                left = (a & b if op == "&&" else a | b), True
                continue
            a, b = self.number(left), self.number(right)
            if level in (2, 3):
                left = compare(op, a, b) == 1.0, True
            else:
                left = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": div, "%": BINARY["mod"]}[op](a, b), False
        return left

    def unary(self) -> tuple[Column, bool]:
        if self.peek() in ("-", "!", "+"):
            op, v = self.take(), self.unary()
            return (~self.truth(v), True) if op == "!" else (-self.number(v) if op == "-" else self.number(v), False)
        token = self.take()
        if token == "(":
            v = self.ternary()
            self.take(")")
            return v
        if token[0].isdigit() or token[0] == ".":
            return F.lit(float(token)), False
        if self.peek() == "(" and token in _CALLS:
            self.take("(")
            args = [self.number(self.ternary())]
            while self.peek() == ",":
                self.take(",")
                args.append(self.number(self.ternary()))
            self.take(")")
            return _CALLS[token](*args), False
        if not token[0].isalpha() and token[0] != "_":
            raise ValueError(f"unexpected {token!r} in a formula")
        return num(self.columns.get(token, token)), False


def phi(text: str, **columns) -> Column:
    """A per-row formula of floating-point numbers: + - * / %, comparisons, && || !, ternaries, exp log sqrt abs fabs fmin
    fmax pow and more, over names of columns. Division and logarithms follow IEEE rules; a comparison alone is a truth."""
    parser = _Formula(text, columns)
    value = parser.ternary()[0]
    if parser.peek():
        raise ValueError(f"unexpected {parser.peek()!r} in a formula")
    return value


#: Unary and binary nodes of the expression tree.
UNARY = {
    "neg": lambda x: -x, "abs": F.abs, "recip": lambda x: div(1.0, x), "sq": lambda x: x * x, "sqrt": F.sqrt, "ln": ln,
    "exp": F.exp, "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "sign": F.signum,
    "isfinite": lambda x: truth(~F.isnan(x) & (F.abs(x) != INF)), "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin,
    "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "round": F.rint,
    "trunc": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"),
}
BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": div, "pow": F.pow,
    "min": F.least, "max": F.greatest, "atan2": F.atan2, "mod": lambda a, b: F.when(b == 0, F.lit(NAN)).otherwise(F.try_mod(a, b)),
    "gt": lambda a, b: F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(truth(a > b)),
    "lt": lambda a, b: F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(truth(a < b)),
    "eq": lambda a, b: F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(truth(a == b)),
}


def tree(node) -> Column:
    """A nested tuple such as ("add", ("col", "x"), 2.0) as a column."""
    if isinstance(node, int | float):
        return F.lit(float(node))
    if isinstance(node, str):
        return num(node)
    op, *args = node
    if op == "col":
        return num(args[0])
    if op == "clamp":
        x, lo, hi = map(tree, args)
        return F.least(F.greatest(x, lo), hi)
    if op == "if":
        c, a, b = map(tree, args)
        return F.when(~F.isnan(c) & (c > 0), a).otherwise(b)
    return UNARY[op](tree(args[0])) if op in UNARY else BINARY[op](*map(tree, args))


class Expr:
    """A lazy expression with operators of floating-point semantics; ``.column`` is the Spark column."""

    def __init__(self, column):
        self.column = column.column if isinstance(column, Expr) else num(column)

    def _with(self, other, f) -> Expr:
        return Expr(f(self.column, Expr(other).column))

    def __add__(self, o): return self._with(o, lambda a, b: a + b)  # noqa: E704
    def __radd__(self, o): return Expr(o) + self  # noqa: E704
    def __sub__(self, o): return self._with(o, lambda a, b: a - b)  # noqa: E704
    def __rsub__(self, o): return Expr(o) - self  # noqa: E704
    def __mul__(self, o): return self._with(o, lambda a, b: a * b)  # noqa: E704
    def __rmul__(self, o): return Expr(o) * self  # noqa: E704
    def __truediv__(self, o): return self._with(o, div)  # noqa: E704
    def __rtruediv__(self, o): return Expr(o) / self  # noqa: E704
    def __pow__(self, o): return self._with(o, F.pow)  # noqa: E704
    def __neg__(self): return Expr(-self.column)  # noqa: E704
    def __abs__(self): return Expr(F.abs(self.column))  # noqa: E704
    def __gt__(self, o): return self._with(o, lambda a, b: compare(">", a, b))  # noqa: E704
    def __lt__(self, o): return self._with(o, lambda a, b: compare("<", a, b))  # noqa: E704
    def __ge__(self, o): return self._with(o, lambda a, b: compare(">=", a, b))  # noqa: E704
    def __le__(self, o): return self._with(o, lambda a, b: compare("<=", a, b))  # noqa: E704
    def __eq__(self, o): return self._with(o, lambda a, b: compare("==", a, b))  # noqa: E704
    def __ne__(self, o): return self._with(o, lambda a, b: compare("!=", a, b))  # noqa: E704
    def __and__(self, o): return self._with(o, lambda a, b: a * b)  # noqa: E704
    def __or__(self, o): return self._with(o, lambda a, b: truth((a != 0) | (b != 0)))  # noqa: E704
    def __invert__(self): return Expr(truth(self.column == 0))  # noqa: E704
    __hash__ = None

    def sqrt(self): return Expr(F.sqrt(self.column))  # noqa: E704
    def log(self): return Expr(ln(self.column))  # noqa: E704
    def exp(self): return Expr(F.exp(self.column))  # noqa: E704
    def abs(self): return abs(self)  # noqa: E704
