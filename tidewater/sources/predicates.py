"""Predicates written as strings, as data-frame users write them, turned into columns.

``label == 'dog' and size in [1, 2]``, ``x != 3``, ``not (a > b)``, ``1 < x <= 5``, ``a & b | ~c`` (as and, or, not),
``@name`` for bound values, backquotes around odd column names, arithmetic, ``abs(x)``, ``x.isnull()``, ``x.notnull()``.
As in such frames, no comparison is null: with a null (or NaN) it is false, and ``!=`` and ``not in`` are true. Python's
own tokeniser and grammar read the text; only what is listed here is let through.
"""

from __future__ import annotations

import ast
import io
import keyword
import tokenize
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = {"&": "and", "|": "or", "~": "not"}
_SIGNS = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Div: "__truediv__", ast.Mod: "__mod__", ast.Pow: "__pow__"}
_TESTS = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__"}


def _tokens(text: str) -> tuple[str, dict[str, str]]:
    """The text in Python's grammar, and what column each stand-in for a backquoted name is."""
    names: dict[str, str] = {}
    out, at = [], 0
    while at < len(text):  # backquotes outside of strings
        if text[at] in "'\"":
            end = at + 1
            while end < len(text) and text[end] != text[at]:
                end += 2 if text[end] == "\\" else 1
            out.append(text[at : end + 1])
            at = end + 1
        elif text[at] == "`":
            end = text.index("`", at + 1)
            names[stand := f"__quoted_{len(names)}"] = text[at + 1 : end]
            out.append(f" {stand} ")
            at = end + 1
        else:
            out.append(text[at])
            at += 1
    words, bound = [], False
    for t in tokenize.generate_tokens(io.StringIO("".join(out).strip().replace("\n", " ")).readline):
        if t.type in (tokenize.NEWLINE, tokenize.NL, tokenize.ENDMARKER):
            continue
        if t.string == "@":
            bound = True
            continue
        words.append(f"__bound_{t.string}" if bound else _WORDS.get(t.string, t.string) if t.type == tokenize.OP else t.string)
        bound = False
    return " ".join(words), names


class _Reader:
    def __init__(self, df: DataFrame, names: dict[str, str], bound: dict[str, object]):
        self.types = {f.name: f.dataType.typeName() for f in df.schema.fields}
        self.names, self.bound = names, bound

    def value(self, node: ast.expr) -> Column | list | None:
        """A column, or what ``in`` takes: a list of constants; None for null."""
        match node:
            case ast.Constant(value=None):
                return None
            case ast.Constant(value=v) if isinstance(v, (bool, int, float, str)):
                return F.lit(v)
            case ast.Name(id=name) if name.startswith("__bound_"):
                v = self.bound[name.removeprefix("__bound_")]
                return list(v) if isinstance(v, (list, tuple, set, frozenset)) else None if v is None else F.lit(v)
            case ast.Name(id=name):
                return self.column(self.names.get(name, name))
            case ast.List(elts=items) | ast.Tuple(elts=items) | ast.Set(elts=items):
                return [ast.literal_eval(x) for x in items]
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -self.value(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _SIGNS:
                return getattr(self.value(a), _SIGNS[type(op)])(self.value(b))
            case ast.BinOp(left=a, op=ast.FloorDiv(), right=b):
                return F.floor(self.value(a) / self.value(b))
            case ast.Call(func=ast.Name(id="abs"), args=[x], keywords=[]):
                return F.abs(self.value(x))
            case ast.Compare() | ast.BoolOp() | ast.UnaryOp(op=ast.Not()) | ast.Call():
                return self.test(node)
        raise ValueError(f"not understood in a predicate: {ast.unparse(node)}")

    def column(self, name: str) -> Column:
        if name not in self.types:
            raise KeyError(f"no column {name!r}; there are {sorted(self.types)}")
        c = F.col(f"`{name}`")
        return F.nanvl(c, F.lit(None)) if self.types[name] in ("double", "float") else c

    def pair(self, a: ast.expr, op: ast.cmpop, b: ast.expr) -> Column:
        x, y = self.value(a), self.value(b)
        negative = isinstance(op, (ast.NotIn, ast.NotEq))
        if isinstance(op, (ast.In, ast.NotIn)) or isinstance(op, (ast.Eq, ast.NotEq)) and isinstance(y, list):
            if not isinstance(y, list):
                raise ValueError("in takes a list")
            some = [v for v in y if v is not None]
            hit = x.isin(some) if some else F.lit(False)
            hit = F.coalesce(hit, F.lit(False)) | (x.isNull() if None in y else F.lit(False))
            return ~hit if negative else hit
        if x is None or y is None:  # nothing equals null
            return F.lit(negative)
        if negative:
            return ~F.coalesce(x == y, F.lit(False))
        return F.coalesce(getattr(x, _TESTS[type(op)])(y), F.lit(False))

    def test(self, node: ast.expr) -> Column:
        match node:
            case ast.BoolOp(op=op, values=parts):
                return reduce(lambda a, b: a & b if isinstance(op, ast.And) else a | b, map(self.test, parts))
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~self.test(x)
            case ast.Compare(left=a, ops=ops, comparators=others):
                return reduce(lambda p, q: p & q, [self.pair(x, op, y) for x, op, y in zip([a, *others], ops, others, strict=False)])
            case ast.Call(func=ast.Attribute(value=x, attr="isnull" | "isna"), args=[], keywords=[]):
                return self.value(x).isNull()
            case ast.Call(func=ast.Attribute(value=x, attr="notnull" | "notna"), args=[], keywords=[]):
                return self.value(x).isNotNull()
            case ast.Name() | ast.Constant(value=True | False):
                return F.coalesce(self.value(node).cast("boolean"), F.lit(False))
        raise ValueError(f"no condition: {ast.unparse(node)}")


def predicate(df: DataFrame, text: str, **bound: object) -> Column:
    """The condition that ``text`` says over the columns of ``df``. KeyError for a column or bound name that is not there,
    ValueError for what is not understood."""
    words, names = _tokens(text)
    try:
        tree = ast.parse(words, mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not a predicate: {text}") from e
    odd = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and keyword.iskeyword(n.id)}
    if odd:
        raise ValueError(f"not a predicate: {text}")
    return _Reader(df, names, bound).test(tree.body)
