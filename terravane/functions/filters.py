"""The second expression language, of sampling definitions: text to a Column.

    SpeedLimit gte 50 and (Country eq 'FI' or Month in [5, 6]) and Heading modulo 90 lt 10

``or`` binds least, then ``and``, comparisons, + and -, * / and modulo, and signs. Two absent values are equal, ordered comparisons with
one are false; whole numbers wrap as 64 bits do, their division drops the rest. ``current:`` names the centre row of a neighbour filter.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|'((?:[^'\\]|\\.)*)'|([A-Za-z_][\w:]*)|([\[\](),+\-*/]))")
_COMPARE = ("eq", "neq", "lt", "lte", "gt", "gte", "in")


class FilterError(ValueError):
    """An expression that isn't one; ``at`` is where the word at fault begins, ``length`` how long it is."""

    def __init__(self, message: str, at: int, length: int = 1):
        super().__init__(f"{message} (at {at})")
        self.at, self.length = at, max(1, length)


_WHOLE = {"int": 32, "long": 64}


def _wrapped(value: Column, bits: int) -> Column:
    """A whole number held in so many bits; value is wide enough not to overflow itself."""
    two, half = (F.lit(str(2**k)).cast("decimal(38,0)") for k in (bits, bits - 1))
    low = F.pmod(value.cast("decimal(38,0)"), two)
    return F.when(low >= half, low - two).otherwise(low).cast("int" if bits == 32 else "long")


def expanded(text: str, named: dict[str, str], most: int = 10_000) -> str:
    """Named expressions ($$name) written out until none is left."""
    for _ in range(most):
        m = re.search(r"\$\$(\w+)", text)
        if m is None:
            return text
        if m[1] not in named:
            raise FilterError(f"no expression is called {m[1]}", m.start())
        text = f"{text[: m.start()]}({named[m[1]]}){text[m.end() :]}"
    raise FilterError("named expressions go round in circles", 0)


class _Parser:
    def __init__(self, text: str, resolve: Callable[[str], tuple[str, Column] | None], known: list[str]):
        self.resolve, self.known, self.tokens, self.k, at = resolve, known, [], 0, 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if m is None:
                at += len(text[at:]) - len(text[at:].lstrip())
                raise FilterError(f"unexpected {text[at]!r}", at)
            kind = "number" if m[1] else "text" if m[2] is not None else "name" if m[3] else "sign"
            self.tokens.append((kind, m[m.lastindex], m.start(m.lastindex)))
            at = m.end()
        self.end = len(text)

    def peek(self, *values: str) -> bool:
        return self.k < len(self.tokens) and self.tokens[self.k][0] in ("name", "sign") and self.tokens[self.k][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.k += 1
            return self.tokens[self.k - 1][1]
        return None

    def wrong(self, what: str, op: tuple) -> FilterError:
        """An operator whose operands are of the wrong kinds."""
        return FilterError(what, op[2], len(op[1]))

    def need(self, value: str) -> None:
        if not self.take(value):
            raise FilterError(f"{value!r} expected", self.place())

    def place(self) -> int:
        return self.tokens[self.k][2] if self.k < len(self.tokens) else self.end

    def either(self):
        left = self.both()
        while self.take("or"):
            left = "bool", self.truth(left) | self.truth(self.both())
        return left

    def both(self):
        left = self.compare()
        while self.take("and"):
            left = "bool", self.truth(left) & self.truth(self.compare())
        return left

    def truth(self, v) -> Column:
        if v[0] != "bool":
            raise FilterError("a condition expected", self.place())
        return F.coalesce(v[1], F.lit(False))

    def compare(self):
        left = self.add()
        op = self.take(*_COMPARE)
        if not op:
            return left
        token = self.tokens[self.k - 1]
        if op == "in":
            self.need("[")
            items = [self.add()]
            while self.take(","):
                items.append(self.add())
            self.need("]")
            out = F.lit(False)
            for item in items:
                out = out | self.same(left, item, token)
            return "bool", out
        right = self.add()
        if op in ("eq", "neq"):
            return "bool", self.same(left, right, token) if op == "eq" else ~self.same(left, right, token)
        a, b = self.alike(left, right, token)
        if "flags" in (left[0], right[0]) or {"text", "null"} == {left[0], right[0]}:
            raise self.wrong(f"{left[0]} and {right[0]} have no order", token)
        return "bool", F.coalesce({"lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b}[op], F.lit(False))

    def alike(self, a, b, token) -> tuple[Column, Column]:
        kinds = {a[0], b[0]} - {"null"}
        if len(kinds) == 2 and not kinds <= {"int", "long", "double"}:
            raise self.wrong(f"{a[0]} and {b[0]} don't compare", token)
        return a[1], b[1]

    def same(self, a, b, token) -> Column:
        if a[0] == "flags" and b[0] == "text":
            return a[1](b[2]) if len(b) > 2 else F.lit(False)
        if "flags" in (a[0], b[0]):
            raise self.wrong(f"{a[0]} and {b[0]} don't compare", token)
        x, y = self.alike(a, b, token)
        return x.eqNullSafe(y)

    def add(self):
        left = self.multiply()
        while op := self.take("+", "-"):
            token = self.tokens[self.k - 1]
            right = self.multiply()
            if op == "+" and "text" in (left[0], right[0]):
                if "flags" in (left[0], right[0]):
                    raise self.wrong("flags aren't text", token)
                left = "text", F.concat(F.coalesce(left[1].cast("string"), F.lit("")), F.coalesce(right[1].cast("string"), F.lit("")))
            else:
                left = self.number(left, right, (lambda a, b: a + b) if op == "+" else (lambda a, b: a - b), token)
        return left

    def multiply(self):
        left = self.sign()
        while op := self.take("*", "/", "modulo"):
            token = self.tokens[self.k - 1]
            right = self.sign()
            if op == "*":
                left = self.number(left, right, lambda a, b: a * b, token)
                continue
            zero = F.lit(0).cast("double" if right[0] == "double" else "long")
            safe = (right[0], F.nullif(right[1], zero)) if right[0] in ("int", "long", "double") else right
            if op == "modulo":
                left = self.number(left, safe, lambda a, b: a % b, token)
            else:
                whole = left[0] in _WHOLE and right[0] in _WHOLE
                left = self.number(left, safe, (lambda a, b: (a - a % b) / b) if whole else (lambda a, b: a / b), token)
        return left

    def number(self, a, b, f, token):
        if not {a[0], b[0]} <= {"int", "long", "double", "null"} or {a[0], b[0]} == {"null"}:
            raise self.wrong(f"numbers expected, not {a[0]} and {b[0]}", token)
        if a[0] in _WHOLE and b[0] in _WHOLE:  # in a wider type, then wrapped
            kind = "int" if (a[0], b[0]) == ("int", "int") else "long"
            return kind, _wrapped(f(a[1].cast("decimal(38,0)"), b[1].cast("decimal(38,0)")), _WHOLE[kind])
        return "double", f(a[1].cast("double"), b[1].cast("double"))

    def sign(self):
        if self.take("-"):
            token = self.tokens[self.k - 1]
            if self.k < len(self.tokens) and self.tokens[self.k][0] == "number":
                return self.literal("-")
            return self.number(("int", F.lit(0)), self.sign(), lambda a, b: a - b, token)
        return self.atom()

    def literal(self, sign: str = ""):
        _, value, at = self.tokens[self.k]
        self.k += 1
        if "." in value:
            return "double", F.lit(float(sign + value))
        whole = int(sign + value)
        if -(2**31) <= whole < 2**31:
            return "int", F.lit(whole).cast("int")
        if sign and -whole < 2**32:  # a magnitude of 32 bits wraps
            return "int", F.lit((whole + 2**31) % 2**32 - 2**31).cast("int")
        if not -(2**63) <= whole < 2**63:
            raise FilterError(f"{sign}{value} is no whole number of 64 bits", at, len(value))
        return "long", F.lit(str(whole)).cast("long")

    def atom(self):
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        if self.take("*"):
            return "bool", F.lit(True)
        if self.k >= len(self.tokens):
            raise FilterError("an expression expected", self.end)
        kind, value, at = self.tokens[self.k]
        if kind == "number":
            return self.literal()
        self.k += 1
        if kind == "text":
            plain = re.sub(r"\\(.)", r"\1", value)
            return "text", F.lit(plain), plain
        if kind == "name":
            if value in ("true", "false"):
                return "bool", F.lit(value == "true")
            if value == "null":
                return "null", F.lit(None)
            found = self.resolve(value)
            if found is None:
                near = min(self.known, key=lambda n: edits(n.lower(), value.lower()), default=None)
                raise FilterError(f"no property is called {value}" + (f"; {near} is" if near else ""), at, len(value))
            return found
        raise FilterError(f"unexpected {value!r}", at)


def edits(a: str, b: str) -> int:
    """How many letters to put in, take out or change between two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def conjuncts(text: str) -> list[tuple[str, bool]]:
    """The parts that ``and`` joins at the top of a condition, and whether each asks of the centre row (``current:``) too.

    A condition with ``or`` at its top is one part. Brackets round the whole are taken off, others stay.
    """
    tokens = _Parser(text, lambda n: None, []).tokens
    first, last = 0, len(tokens)

    def depths(lo: int, hi: int) -> list[int]:
        out, depth = [], 0
        for kind, value, _ in tokens[lo:hi]:
            depth -= kind == "sign" and value in ")]"
            out.append(depth)
            depth += kind == "sign" and value in "(["
        return out

    while last - first > 2 and tokens[first][:2] == ("sign", "(") and tokens[last - 1][:2] == ("sign", ")") and min(depths(first, last)[1:-1]) > 0:
        first, last = first + 1, last - 1
    begin = lambda k: tokens[k][2] - (tokens[k][0] == "text")  # noqa: E731  a text begins before its quote
    end = lambda k: tokens[k][2] + len(tokens[k][1]) + (tokens[k][0] == "text")
    level = depths(first, last)
    words = [(k, tokens[k][1]) for k in range(first, last) if tokens[k][0] == "name" and level[k - first] == 0]
    cuts = [] if any(w == "or" for _, w in words) else [k for k, w in words if w == "and"]
    parts, at = [], first
    for cut in [*cuts, last]:
        if cut > at:
            both = any(kind == "name" and value.lower().startswith("current:") for kind, value, _ in tokens[at:cut])
            parts.append((text[begin(at) : end(cut - 1)], both))
        at = cut + 1
    return parts


def compile_filter(text: str, properties: dict[str, tuple[str, Column]], current: dict[str, tuple[str, Column]] | None = None) -> Column:
    """The condition of a text. properties: name -> (kind, column); of kind flags, a function from names
    to a condition (see ``flags_any``). current: those of the centre row."""
    names = {k.lower(): v for k, v in properties.items()} | {f"current:{k.lower()}": v for k, v in (current or {}).items()}
    parser = _Parser(text, lambda n: names.get(n.lower()), [*properties])
    out = parser.either()
    if parser.k < len(parser.tokens):
        raise FilterError("the expression goes on", parser.place())
    return parser.truth(out)


def compile_number(text: str, properties: dict[str, tuple[str, Column]]) -> Column:
    """The whole number of a text, of 32 bits, such as ``Heading + 180``; other kinds are errors."""
    names = {k.lower(): v for k, v in properties.items()}
    parser = _Parser(text, lambda n: names.get(n.lower()), [*properties])
    out = parser.either()
    if parser.k < len(parser.tokens):
        raise FilterError("the expression goes on", parser.place())
    if out[0] != "int":
        raise FilterError(f"a whole number expected, not {out[0]}", 0, len(text))
    return out[1]


def flags_any(value: Column, names: str, bits: dict[str, int]) -> Column:
    """Whether value has all bits of any of the comma-separated names, whatever their case; an unknown name has no bits, so it always holds."""
    table = {k.lower(): v for k, v in bits.items()}
    out = F.lit(False)
    for n in names.split(","):
        bit = table.get(n.strip().lower(), 0)
        out = out | (value.bitwiseAND(F.lit(bit).cast("long")) == bit)
    return out
