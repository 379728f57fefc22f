"""Field expressions: a small typed language over row fields, compiled to columns.

A row for which an arithmetic operand is missing or not finite has no value (null); a comparison with a missing
operand is 0; has(f) and if(c, a, b) never skip.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:([0-9.])|([A-Za-z_][A-Za-z0-9_]*)|(")|(==|!=|<=|>=|[-+*/%()<>,])|(\S))')
_NUMBER = re.compile(r"[0-9]*\.?[0-9]*")
_TEXT = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
# The kinds of errors and what they say.
ERRORS = {
    "invalidNumber": "invalid number at position {position}",
    "unterminatedString": "unterminated string",
    "unexpectedCharacter": "unexpected character {character!r} at position {position}",
    "expectedSymbol": "expected {symbol!r}",
    "chainedComparison": "chained comparison",
    "unexpectedEnd": "unexpected end of expression",
    "missingLeftOperand": "missing left operand",
    "hasTakesFieldName": "has() takes a field name",
    "unknownFunction": "unknown function {name!r}",
    "wrongArgCount": "{name}() takes {expected} arguments",
    "unexpectedToken": "unexpected {token!r}",
    "trailingToken": "unexpected {token!r} after expression",
    "textOutsideComparison": "a text is only for comparison",
}
_COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")
_SIZES = {"abs": 1, "floor": 1, "round": 1, "mod": 2, "min": 2, "max": 2, "clamp": 3, "if": 3}


class ExpressionError(ValueError):
    """kind is a key of ERRORS, at the place in the text, details what the message names."""

    def __init__(self, kind: str, at: int, **details):
        super().__init__(ERRORS[kind].format(**details, position=at))
        self.kind, self.at, self.details = kind, at, details


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while m := _TOKEN.match(text, at):
        start, sign = m.start(m.lastindex), m[m.lastindex]
        if m[1]:
            found = _NUMBER.match(text, start)
            if not found[0][-1].isdigit():
                raise ExpressionError("invalidNumber", start)
            out.append(("number", found[0], start))
            at = found.end()
        elif m[3]:
            found = _TEXT.match(text, start)
            if not found:
                raise ExpressionError("unterminatedString", start)
            out.append(("string", re.sub(r"(?s)\\(.)", r"\1", found[1]), start))
            at = found.end()
        elif m[5]:
            raise ExpressionError("unexpectedCharacter", start, character=sign)
        else:
            out.append(("name" if m[2] else "sign", sign, start))
            at = m.end()
    return [*out, ("end", "", len(text))]


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def number(c: Column, kind: str) -> Column:
    """A field as a number: booleans 0 or 1, lists their length, strings if they are plain numbers without blanks or suffixes (inf, infinity and nan are spelled in any case)."""
    if kind.startswith("array"):
        return F.size(c).cast("double")
    if kind == "string":
        return F.when(c.rlike(r"^(?i:[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?))\z"), c.try_cast("double"))
    return c.cast("double")


class _Parser:
    def __init__(self, text: str, fields: Callable[[str], tuple[Column, str]]):
        self.toks, self.at, self.fields = _tokens(text), 0, fields

    def peek(self) -> str:
        return self.toks[self.at][1] if self.toks[self.at][0] == "sign" else ""

    def take(self, want: str | None = None) -> tuple[str, str, int]:
        t = self.toks[self.at]
        if want is not None and not (t[0] == "sign" and t[1] == want):
            raise ExpressionError("expectedSymbol", t[2], symbol=want)
        self.at += 1
        return t

    def compare(self) -> Column:
        start, left = self.at, self.sum()
        op = self.peek()
        if op not in _COMPARISONS:
            if self.toks[start][0] == "string" and self.at == start + 1:
                raise ExpressionError("textOutsideComparison", self.toks[start][2])
            return left
        self.take()
        mark, right = self.at, self.sum()
        if self.peek() in _COMPARISONS:
            raise ExpressionError("chainedComparison", self.toks[self.at][2])
        if "string" in (self.toks[start][0], self.toks[mark][0]):
            left, right = self.text(start, left), self.text(mark, right)
        hit = {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
        return F.coalesce(hit, F.lit(False)).cast("double")

    def text(self, at: int, made: Column) -> Column:
        kind, value, _ = self.toks[at]
        return F.lit(value) if kind == "string" else self.fields(value)[0].cast("string") if kind == "name" else made.cast("string")

    def sum(self) -> Column:
        left = self.product()
        while self.peek() in ("+", "-"):
            op, right = self.take()[1], self.product()
            left = finite(left + right if op == "+" else left - right)
        return left

    def product(self) -> Column:
        left = self.unary()
        while self.peek() in ("*", "/", "%"):
            op, right = self.take()[1], self.unary()
            left = finite(left * right if op == "*" else F.try_divide(left, right) if op == "/" else F.try_mod(left, right))
        return left

    def unary(self) -> Column:
        if self.peek() == "-":
            self.take()
            return -self.unary()
        kind, value, at = self.take()
        if kind == "number":
            return F.lit(float(value))
        if kind == "string":
            return F.lit(None).cast("double")
        if kind == "sign" and value == "(":
            inner = self.compare()
            self.take(")")
            return inner
        if kind == "end":
            raise ExpressionError("unexpectedEnd", at)
        if kind != "name":
            raise ExpressionError("missingLeftOperand", at) if value in _COMPARISONS else ExpressionError("unexpectedToken", at, token=value)
        if self.peek() != "(":
            return F.lit(float(value == "true")) if value in ("true", "false") else finite(number(*self.fields(value)))
        self.take()
        if value == "has":
            name = self.take()
            if name[0] != "name":
                raise ExpressionError("hasTakesFieldName", name[2])
            self.take(")")
            c, kind = self.fields(name[1])
            return ((F.size(c) > 0) if kind.startswith("array") else c.isNotNull() & (c.cast("string") != "")).cast("double")
        if value not in _SIZES:
            raise ExpressionError("unknownFunction", at, name=value)
        args = []
        if self.peek() != ")":
            args.append(self.compare())
            while self.peek() == ",":
                self.take()
                args.append(self.compare())
        self.take(")")
        if len(args) != _SIZES[value]:
            raise ExpressionError("wrongArgCount", at, name=value, expected=_SIZES[value])
        return self.call(value, args)

    def call(self, name: str, a: list[Column]) -> Column:
        if name == "if":
            return F.when(a[0] != 0, a[1]).when(a[0] == 0, a[2])
        whole = a[0].isNotNull()
        for x in a[1:]:
            whole = whole & x.isNotNull()
        make = {
            "abs": lambda: F.abs(a[0]),
            "floor": lambda: F.floor(a[0]).cast("double"),
            "round": lambda: F.floor(a[0] + 0.5).cast("double"),
            "mod": lambda: F.try_mod(F.try_mod(a[0], a[1]) + a[1], a[1]),
            "clamp": lambda: F.least(F.greatest(a[0], a[1]), a[2]),
            "min": lambda: F.least(*a),
            "max": lambda: F.greatest(*a),
        }[name]()
        return F.when(whole, finite(make))


def compile_expression(text: str, fields: Callable[[str], tuple[Column, str]]) -> Column:
    """The column of an expression; fields gives a name's column and type."""
    p = _Parser(text, fields)
    out = p.compare()
    if p.toks[p.at][0] != "end":
        raise ExpressionError("trailingToken", p.toks[p.at][2], token=p.toks[p.at][1])
    return out
