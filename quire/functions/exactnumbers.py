"""Decimals as form calculations keep them: a whole number of at most 96 bits over a power of ten of at most 28.

A number is a pair (n, places) for n / 10**places. Every step works on whole numbers and is rounded once, half to even, to as
many places as fit; None stands for a result that does not fit at all, or for a division by zero.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# ---- fixed values
LIMIT, PLACES, MAX_DEPTH = 1 << 96, 28, 64
# -----------------

Number = tuple[int, int]
ZERO: Number = (0, 0)


def _divided(n: int, d: int) -> int:
    """n / d to the nearest whole number, halves to the even one."""
    sign = -1 if (n < 0) != (d < 0) else 1
    whole, rest = divmod(abs(n), abs(d))
    twice = 2 * rest
    return sign * (whole + (twice > abs(d) or twice == abs(d) and whole % 2 == 1))


def fitted(n: int, places: int) -> Number | None:
    """The number with as few places dropped as it takes."""
    if places <= PLACES and -LIMIT < n < LIMIT:
        return n, places
    for drop in range(max(places - PLACES, 0), places + 1):
        kept = _divided(n, 10**drop)
        if abs(kept) < LIMIT:
            return kept, places - drop
    return None


def read(text: str | Decimal | None) -> Number | None:
    if text is None:
        return None
    sign, digits, exponent = Decimal(text).as_tuple()
    n = int("".join(map(str, digits)) or "0") * (-1 if sign else 1)
    return fitted(n * 10**exponent, 0) if exponent > 0 else fitted(n, -exponent)


def plain(text: str) -> Number | None:
    """A number written as digits, with a sign and a point perhaps."""
    whole, _, rest = text.partition(".")
    n, places = int(whole + rest), len(rest)
    return (n, places) if places <= PLACES and -LIMIT < n < LIMIT else fitted(n, places)


def joined(a: Number, b: Number) -> Number:
    """The sum as it is, not yet fitted."""
    if a[1] == b[1]:
        return a[0] + b[0], a[1]
    places = max(a[1], b[1])
    return a[0] * 10 ** (places - a[1]) + b[0] * 10 ** (places - b[1]), places


def whole_and_rest(whole: str, rest: str, more: Number = ZERO) -> Number:
    """The sum of what stands before the point, what stands after it and a third number, not yet fitted."""
    return joined(joined((int(whole), 0), plain_parts(rest)), more)


def plain_parts(text: str) -> Number:
    """Digits as they are, not yet fitted; small ones may come with an exponent."""
    sign, digits, exponent = Decimal(text).as_tuple()
    n = int("".join(map(str, digits)) or "0") * (-1 if sign else 1)
    return (n * 10**exponent, 0) if exponent > 0 else (n, -exponent)


def compared(number: Number) -> int:
    """A whole number that orders numbers."""
    return number[0] * 10 ** (PLACES - number[1])


def shown(number: Number | None) -> str | None:
    """Without closing zeros."""
    if number is None:
        return None
    n, places = number
    text = str(abs(n)).rjust(places + 1, "0")
    whole, rest = text[: len(text) - places], text[len(text) - places :].rstrip("0")
    return ("-" if n < 0 and (whole.strip("0") or rest) else "") + whole + ("." + rest if rest else "")


def add(a: Number, b: Number) -> Number | None:
    return fitted(*joined(a, b))


def multiply(a: Number, b: Number) -> Number | None:
    return fitted(a[0] * b[0], a[1] + b[1])


def divide(a: Number, b: Number) -> Number | None:
    if b[0] == 0:
        return None
    shift = PLACES + b[1] - a[1]
    up, down = abs(a[0]) * 10 ** max(shift, 0), abs(b[0]) * 10 ** max(-shift, 0)
    n, rest = divmod(up, down)
    sign = -1 if (a[0] < 0) != (b[0] < 0) else 1
    drop = 0
    while n >= LIMIT * _POWERS[drop]:  # a quotient of 29 digits before the point never fits
        drop += 1
        if drop > PLACES:
            return None
    while drop <= PLACES:
        kept, cut = divmod(n, _POWERS[drop])
        # What is cut off is cut / 10**drop and a little more where the division left a rest.
        twice, one = (2 * cut, _POWERS[drop]) if drop else (2 * rest, down)
        kept += twice > one or twice == one and (drop and rest != 0 or kept % 2 == 1)
        if kept < LIMIT:
            return sign * kept, PLACES - drop
        drop += 1
    return None


_POWERS = [10**i for i in range(PLACES + 2)]


@dataclass(frozen=True)
class Vector:
    """Numbers of the same few places as 64-bit whole numbers, none of which has to be rounded; steps that might need more give None."""

    n: np.ndarray
    places: int

    @staticmethod
    def of(n: np.ndarray, places: int) -> Vector:
        """With no more places than are used."""
        while places and not (n % 10).any():
            n, places = n // 10, places - 1
        return Vector(n, places)

    def most(self) -> int:
        return max(int(self.n.max(initial=0)), -int(self.n.min(initial=0)))

    def plus(self, other: Vector) -> Vector | None:
        places = max(self.places, other.places)
        up = [10 ** (places - v.places) for v in (self, other)]
        if self.most() * up[0] >= 1 << 61 or other.most() * up[1] >= 1 << 61:
            return None
        return Vector(self.n * up[0] + other.n * up[1], places)

    def minus(self, other: Vector) -> Vector | None:
        return self.plus(Vector(-other.n, other.places))

    def times(self, other: Vector) -> Vector | None:
        if self.most() * other.most() >= 1 << 61 or self.places + other.places > PLACES:
            return None
        return Vector(self.n * other.n, self.places + other.places)

    @staticmethod
    def added(vectors: Sequence[Vector]) -> Vector | None:
        return reduce(lambda a, b: a and a.plus(b), vectors)

    def numbers(self) -> list[Number]:
        return [(n, self.places) for n in self.n.tolist()]

    def shown(self) -> pa.Array:
        """Without closing zeros, as `shown`."""
        v = Vector.of(self.n, self.places)
        if v.places > 18:
            return pa.array(map(shown, v.numbers()), pa.string())
        whole, rest = np.divmod(np.abs(v.n), 10**v.places)
        text = pc.cast(pa.array(whole), pa.string())
        if v.places:
            rest = pc.utf8_lpad(pc.cast(pa.array(rest), pa.string()), v.places, "0")
            text = pc.utf8_rtrim(pc.utf8_rtrim(pc.binary_join_element_wise(text, rest, "."), "0"), ".")
        return pc.if_else(pa.array(v.n < 0), pc.binary_join_element_wise("-", text, ""), text)


_TOKEN = re.compile(r"\s*(?:(?P<num>[\d.]+)|(?P<name>(?:\\.|[^\W]|[.])+)|(?P<op>[-+*/()]))")
_BINDS = {"(": 0, "+": 1, "-": 1, "*": 2, "/": 2, "neg": 3}


def postfix(expression: str) -> list[tuple[str, str]]:
    """The steps of an expression, operands before operators: ('number', text), ('field', name), ('do', operator).

    Raises ValueError where it is not an expression of numbers, names, + - * / and parentheses, or nests too deep.
    """
    out: list[tuple[str, str]] = []
    waiting: list[str] = []
    text, at, operand, depth = expression.rstrip(), 0, False, 0
    bad = ValueError(f"not a calculation: {expression!r}")

    def release(binds: int) -> None:
        while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= binds:
            out.append(("do", waiting.pop()))

    while at < len(text):
        token = _TOKEN.match(text, at)
        if token is None:
            raise bad
        at = token.end()
        op = token["op"]
        if op is None or op == "(":
            if operand:
                raise bad
            if op == "(":
                depth += 1
                waiting.append("(")
            else:
                if token["num"] is not None and not re.fullmatch(r"\d+\.?\d*|\.\d+", token["num"]):
                    raise bad
                out.append(("number", token["num"]) if token["num"] else ("field", re.sub(r"\\(.)", r"\1", token["name"])))
                operand = True
        elif op == ")":
            if not operand:
                raise bad
            release(1)
            if not waiting:
                raise bad
            waiting.pop()
            depth -= 1
        elif operand:
            release(_BINDS[op])
            waiting.append(op)
            operand = False
        elif op == "-":
            waiting.append("neg")  # a sign binds closest
        elif op != "+":
            raise bad
        if depth + waiting.count("neg") > MAX_DEPTH:
            raise ValueError("too deep")
    if not operand or "(" in waiting:
        raise bad
    release(1)
    return out


class compiled:
    """An expression read once: its field names, and its values for rows of their numbers."""

    def __init__(self, expression: str):
        self.steps = [(kind, read(value) if kind == "number" else value) for kind, value in postfix(expression)]
        self.names = list(dict.fromkeys(value for kind, value in self.steps if kind == "field"))

    def __call__(self, fields: dict[str, Vector | list[Number | None]], rows: int) -> Vector | list[Number | None]:
        """Step by step over all rows, as vectors as long as they do; a row with a step that does not fit has no value."""
        stack: list[Vector | list[Number | None]] = []
        for kind, value in self.steps:
            if kind == "number":
                small = value is not None and abs(value[0]) < 1 << 61
                stack.append(Vector(np.full(rows, value[0], np.int64), value[1]) if small else [value] * rows)
            elif kind == "field":
                stack.append(fields[value])
            elif value == "neg":
                a = stack.pop()
                stack.append(Vector(-a.n, a.places) if isinstance(a, Vector) else [n and (-n[0], n[1]) for n in a])
            else:
                b, a = stack.pop(), stack.pop()
                vectors, step = _STEPS[value]
                found = vectors(a, b) if vectors and isinstance(a, Vector) and isinstance(b, Vector) else None
                if found is None:
                    a, b = [v.numbers() if isinstance(v, Vector) else v for v in (a, b)]
                    found = [None if x is None or y is None else step(x, y) for x, y in zip(a, b)]
                stack.append(found)
        return stack[0]


_STEPS = {"+": (Vector.plus, add), "-": (Vector.minus, lambda a, b: add(a, (-b[0], b[1]))), "*": (Vector.times, multiply), "/": (None, divide)}
