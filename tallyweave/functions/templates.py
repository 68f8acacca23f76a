"""Templates with logic, compiled to a column: one expression in the plan, no Python on the rows.

A template is text with ``{{ value }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for x in list %} {% else %}
{% endfor %}`` and ``{# comments #}``; a dash inside a mark strips blanks on its side. Values are fields of the table,
parts of them (``a.b``, ``a[0]``), variables of loops, ``loop.index``, ``loop.first``, ``loop.last``, ``loop.length``,
constants, comparisons, ``in``, ``and``, ``or``, ``not``, ``x if c else y``, ``is defined``, ``is none``, and filters after
bars. A field that the table lacks is refused when the template is compiled. A null is a missing value: it renders as
nothing and counts as false, as do an empty text, an empty list and zero. The result is tidied.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

MARK = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
STRING, LONG, BOOLEAN = T.StringType(), T.LongType(), T.BooleanType()


@dataclass(frozen=True)
class Value:
    """A column and its type."""

    column: Column
    kind: T.DataType

    def text(self) -> Column:
        if isinstance(self.kind, T.ArrayType | T.MapType | T.StructType):
            raise ValueError("a list or a record can't be rendered as it is; name a part of it, or join it")
        shown = F.when(self.column, "True").otherwise("False") if isinstance(self.kind, T.BooleanType) else self.column.cast("string")
        return F.when(self.column.isNull(), "").otherwise(shown)

    def true(self) -> Column:
        if isinstance(self.kind, T.BooleanType):
            told = self.column
        elif isinstance(self.kind, T.StringType):
            told = self.column != ""
        elif isinstance(self.kind, T.ArrayType | T.MapType):
            told = F.size(self.column) > 0
        elif isinstance(self.kind, T.NumericType):
            told = self.column != 0
        else:
            told = self.column.isNotNull()
        return F.coalesce(told, F.lit(False))


def as_text(v: Value) -> Column:
    return v.text()


#: Filters: of a value and constant arguments.
FILTERS: dict[str, Callable[..., Value]] = {
    "upper": lambda v: Value(F.upper(as_text(v)), STRING), "lower": lambda v: Value(F.lower(as_text(v)), STRING), "trim": lambda v: Value(F.trim(as_text(v)), STRING),
    "title": lambda v: Value(F.initcap(as_text(v)), STRING), "string": lambda v: Value(as_text(v), STRING),
    "replace": lambda v, old, new: Value(F.replace(as_text(v), F.lit(old), F.lit(new)), STRING),
    "truncate": lambda v, n: Value(F.substring(as_text(v), 1, n), STRING),
    "default": lambda v, other: Value(F.coalesce(v.column, F.lit(other).cast(v.kind)), v.kind),
    "length": lambda v: Value(F.coalesce(F.size(v.column) if isinstance(v.kind, T.ArrayType | T.MapType) else F.length(as_text(v)), F.lit(0)).cast("long"), LONG),
    "join": lambda v, by="": Value(F.array_join(F.transform(items(v), lambda x: Value(x, v.kind.elementType).text()), by), STRING),
    "first": lambda v: Value(F.get(v.column, F.lit(0)), v.kind.elementType), "last": lambda v: Value(F.try_element_at(v.column, F.lit(-1)), v.kind.elementType),
    "sort": lambda v: Value(F.sort_array(v.column), v.kind), "unique": lambda v: Value(F.array_distinct(v.column), v.kind), "reverse": lambda v: Value(F.reverse(v.column), v.kind),
    "round": lambda v, n=0: Value(F.round(v.column, n), v.kind), "int": lambda v: Value(v.column.cast("long"), LONG),
}
COMPARED = {ast.Eq: lambda a, b: a.eqNullSafe(b), ast.NotEq: lambda a, b: ~a.eqNullSafe(b), ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
COUNTED = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b}


def items(v: Value) -> Column:
    if not isinstance(v.kind, T.ArrayType):
        raise ValueError("only a list can be gone through or joined")
    return F.coalesce(v.column, F.array().cast(v.kind))


class Scope:
    """Names that an expression may use: fields of the table, and variables of the loops around it."""

    def __init__(self, schema: T.StructType, names: dict[str, Value] | None = None) -> None:
        self.schema, self.names = schema, names or {}

    def with_names(self, more: dict[str, Value]) -> Scope:
        return Scope(self.schema, self.names | more)

    def named(self, name: str) -> Value:
        if name in self.names:
            return self.names[name]
        if name not in self.schema.names:
            raise ValueError(f"no field {name!r}")
        return Value(F.col("`" + name.replace("`", "``") + "`"), self.schema[name].dataType)

    def read(self, text: str) -> Value:
        try:
            return self.of(ast.parse(text.strip(), mode="eval").body)
        except SyntaxError as e:
            raise ValueError(f"can't read {text.strip()!r}") from e

    def of(self, node: ast.expr) -> Value:
        match node:
            case ast.Constant(value=None):
                return Value(F.lit(None).cast("string"), STRING)
            case ast.Constant(value=bool() | int() | float() | str() as v):
                return Value(F.lit(v), BOOLEAN if isinstance(v, bool) else LONG if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else STRING)
            case ast.Name(id=name):
                return {"true": Value(F.lit(True), BOOLEAN), "false": Value(F.lit(False), BOOLEAN)}.get(name) or self.named(name)
            case ast.Attribute(value=ast.Name(id="loop"), attr=name) if "loop" in self.names:
                return self.named(f"loop.{name}")
            case ast.Attribute(value=inner, attr=name):
                return self.part(self.of(inner), name)
            case ast.Subscript(value=inner, slice=ast.Constant(value=str() as name)):
                return self.part(self.of(inner), name)
            case ast.Subscript(value=inner, slice=ast.Constant(value=int() as k)):
                v = self.of(inner)
                return Value(F.get(items(v), F.lit(k)), v.kind.elementType)
            case ast.BinOp(left=left, op=ast.BitOr(), right=ast.Name(id=name)) if name in FILTERS:
                return FILTERS[name](self.of(left))
            case ast.BinOp(left=left, op=ast.BitOr(), right=ast.Call(func=ast.Name(id=name), args=args)) if name in FILTERS:
                return FILTERS[name](self.of(left), *map(ast.literal_eval, args))
            case ast.BinOp(left=left, op=op, right=right) if type(op) in COUNTED:
                a, b = self.of(left), self.of(right)
                if isinstance(a.kind, T.StringType) and isinstance(op, ast.Add):
                    return Value(F.concat(a.text(), b.text()), STRING)
                return Value(COUNTED[type(op)](a.column, b.column), T.DoubleType() if any(isinstance(x.kind, T.FractionalType) for x in (a, b)) else LONG)
            case ast.UnaryOp(op=ast.Not(), operand=inner):
                return Value(~self.of(inner).true(), BOOLEAN)
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                v = self.of(inner)
                return Value(-v.column, v.kind)
            case ast.BoolOp(op=op, values=values):
                told = [self.of(v).true() for v in values]
                out = told[0]
                for t in told[1:]:
                    out = out & t if isinstance(op, ast.And) else out | t
                return Value(out, BOOLEAN)
            case ast.IfExp(test=test, body=body, orelse=other):
                a, b = self.of(body), self.of(other)
                return Value(F.when(self.of(test).true(), a.text()).otherwise(b.text()), STRING)
            case ast.Compare(left=left, ops=[ast.Is() | ast.IsNot() as op], comparators=[ast.Name(id="defined" | "none") | ast.Constant(value=None) as right]):
                missing = self.of(left).column.isNull()
                wanted = (isinstance(right, ast.Name) and right.id == "defined") == isinstance(op, ast.IsNot)
                return Value(missing if wanted else ~missing, BOOLEAN)
            case ast.Compare(left=left, ops=[ast.In() | ast.NotIn() as op], comparators=[right]):
                a, b = self.of(left), self.of(right)
                held = F.array_contains(items(b), a.column) if isinstance(b.kind, T.ArrayType) else F.contains(b.text(), a.text())
                held = F.coalesce(held, F.lit(False))
                return Value(~held if isinstance(op, ast.NotIn) else held, BOOLEAN)
            case ast.Compare(left=left, ops=[op], comparators=[right]) if type(op) in COMPARED:
                return Value(F.coalesce(COMPARED[type(op)](self.of(left).column, self.of(right).column), F.lit(False)), BOOLEAN)
        raise ValueError(f"a template can't use {ast.unparse(node)!r}")

    def part(self, v: Value, name: str) -> Value:
        if isinstance(v.kind, T.StructType):
            if name not in v.kind.names:
                raise ValueError(f"no field {name!r}")
            return Value(v.column[name], v.kind[name].dataType)
        if isinstance(v.kind, T.MapType):
            return Value(F.try_element_at(v.column, F.lit(name)), v.kind.valueType)
        raise ValueError(f"no part {name!r} in a value of {v.kind.simpleString()}")


def pieces(template: str) -> list[tuple[str, str]]:
    """(kind, text) of a template's parts: text, value or tag; comments and blanks stripped by dashes are left out."""
    out: list[tuple[str, str]] = []
    strip = False
    for k, part in enumerate(MARK.split(template)):
        if k % 2:
            body, kind = part[2:-2], {"{{": "value", "{%": "tag", "{#": "comment"}[part[:2]]
            if body.startswith("-") and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1].rstrip())
            strip, body = body.endswith("-"), body.removeprefix("-").removesuffix("-")
            if kind != "comment":
                out.append((kind, body.strip()))
        else:
            out.append(("text", part.lstrip() if strip else part))
            strip = False
    return out


class Reader:
    """Goes through the pieces of a template and gives columns."""

    def __init__(self, template: str) -> None:
        self.pieces, self.at = pieces(template), 0

    def tag(self) -> str:
        """The first word of the tag that comes next, or nothing."""
        return self.pieces[self.at][1].split(None, 1)[0] if self.at < len(self.pieces) and self.pieces[self.at][0] == "tag" and self.pieces[self.at][1] else ""

    def take(self) -> str:
        """What follows the first word of the tag that comes next; goes on behind it."""
        self.at += 1
        return self.pieces[self.at - 1][1].partition(" ")[2]

    def until(self, scope: Scope, *ends: str) -> Column:
        parts: list[Column] = []
        while self.at < len(self.pieces):
            kind, text = self.pieces[self.at]
            if kind == "tag":
                word = self.tag()
                if word in ends:
                    return F.concat(*parts) if parts else F.lit("")
                parts.append({"if": self.choice, "for": self.loop}.get(word, self.unknown)(scope))
                continue
            parts.append(F.lit(text) if kind == "text" else scope.read(text).text())
            self.at += 1
        if ends:
            raise ValueError(f"no {ends[-1]!r} before the end")
        return F.concat(*parts) if parts else F.lit("")

    def unknown(self, scope: Scope) -> Column:
        raise ValueError(f"unknown tag {self.pieces[self.at][1]!r}")

    def choice(self, scope: Scope) -> Column:
        told = scope.read(self.take()).true()
        body = self.until(scope, "elif", "else", "endif")
        if self.tag() == "elif":
            return F.when(told, body).otherwise(self.choice(scope))
        other = F.lit("")
        if self.tag() == "else":
            self.take()
            other = self.until(scope, "endif")
        self.take()
        return F.when(told, body).otherwise(other)

    def loop(self, scope: Scope) -> Column:
        name, _, source = self.take().partition(" in ")
        if not name.strip().isidentifier():
            raise ValueError("a loop is over 'name in list'")
        listed = scope.read(source)
        held, begin, ends = items(listed), self.at, []

        def body(x: Column, k: Column) -> Column:
            n = F.size(held)
            told = {"loop": Value(F.lit(None), STRING), "loop.index": Value(k + 1, LONG), "loop.index0": Value(k, LONG), "loop.first": Value(k == 0, BOOLEAN), "loop.last": Value(k == n - 1, BOOLEAN), "loop.length": Value(n, LONG)}
            self.at = begin
            out = self.until(scope.with_names(told | {name.strip(): Value(x, listed.kind.elementType)}), "else", "endfor")
            ends.append(self.at)
            return out

        each = F.array_join(F.transform(held, body), "")
        self.at = ends[-1]
        none = F.lit("")
        if self.tag() == "else":
            self.take()
            none = self.until(scope, "endfor")
        self.take()
        return F.when(F.size(held) > 0, each).otherwise(none)


def compiled(template: str, schema: T.StructType) -> Column:
    """The tidied text of a template over rows of this schema."""
    return tx.tidy(Reader(template).until(Scope(schema)))


def fields_of(template: str, schema: T.StructType) -> list[str]:
    """Fields of the table that a template names; those it lacks are refused."""
    seen: list[str] = []

    class Noted(Scope):
        def with_names(self, more):
            return Noted(self.schema, self.names | more)

        def named(self, name):
            if name not in self.names and name not in seen:
                seen.append(name)
            return super().named(name)

    Reader(template).until(Noted(schema))
    return seen
