"""Exact numbers: a normal form of a number's literal that orders as numbers do, and exact remainders.

A literal is a sign, digits without zeros at either end, and the power of ten of the first digit. Written one behind the other, the power shifted
to be positive and everything complemented for negative numbers, two forms compare as texts exactly as their numbers do, whatever their
size: ``1e2``, ``100`` and ``100.00`` have one form. No floating point is involved.
"""

from __future__ import annotations

import operator as op
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a power of ten is shifted by; JSON literals of over a million digits are not expected.
SHIFT = 1_000_000
LITERAL = r"^-?(\d+)(?:\.(\d*))?(?:[eE]([+-]?\d+))?$"
LONG = 1 << 63
#: Digits up to which a remainder's divisor may go.
MOST_DIGITS = 36
COMPARE = {"<": op.lt, "<=": op.le, ">": op.gt, ">=": op.ge}


def exact(value: Any) -> Decimal:
    """A number of a schema as its literal says it."""
    return value if isinstance(value, Decimal) else Decimal(value) if isinstance(value, int) else Decimal(repr(value))


def parts_of(value: Any) -> tuple[bool, str, int]:
    """Whether a number is negative, its digits without zeros at the ends (none for zero), and the place of the decimal point before them."""
    sign, digits, exponent = exact(value).as_tuple()
    text = "".join(map(str, digits))
    short = text.lstrip("0")
    return bool(sign), short.rstrip("0"), len(short) + exponent


def form_of(value: Any) -> str:
    """The normal form of a number that is known when the query is built."""
    negative, digits, place = parts_of(value)
    if not digits:
        return "O"
    if negative:
        return f"N{SHIFT - place:07d}{digits.translate(str.maketrans('0123456789', '9876543210'))}~"
    return f"P{SHIFT + place:07d}{digits}"


def let(value: Column, form: Callable[[Column], Column]) -> Column:
    """``form(value)`` with the value worked out once, however often the form names it."""
    return F.get(F.transform(F.array(value), form), 0)


def _read(text: Column, form: Callable[[Column, Column], Column]) -> Column:
    """``form(digits, place)``: digits without zeros at the ends, and the place of the decimal point before them."""

    def cut(x: Column) -> Column:
        digits = F.concat(x["whole"], x["rest"])
        short = F.ltrim(digits, F.lit("0"))
        place = F.length(x["whole"]) - (F.length(digits) - F.length(short)) + F.coalesce(F.when(x["power"] != "", x["power"]).try_cast("int"), F.lit(0))
        return let(F.struct(F.rtrim(short, F.lit("0")).alias("digits"), place.alias("place")), lambda y: form(y["digits"], y["place"]))

    return let(F.struct(*[F.regexp_extract(text, LITERAL, i).alias(n) for i, n in ((1, "whole"), (2, "rest"), (3, "power"))]), cut)


def normal_form(text: Column) -> Column:
    """The normal form of a literal; null for a text that is none."""
    shifted = lambda n: F.lpad(n.cast("string"), 7, "0")

    def form(t: Column) -> Column:
        def said(digits: Column, place: Column) -> Column:
            negative = F.concat(F.lit("N"), shifted(SHIFT - place), F.translate(digits, "0123456789", "9876543210"), F.lit("~"))
            return F.when(digits == "", F.lit("O")).when(t.startswith("-"), negative).otherwise(F.concat(F.lit("P"), shifted(SHIFT + place), digits))

        return F.when(t.rlike(LITERAL), _read(t, said))

    return let(text, form)


def literal_parts(text: Column) -> Column:
    """``digits, place`` of a literal, as :func:`is_multiple` asks for them."""
    return _read(text, lambda digits, place: F.struct(digits.alias("digits"), place.alias("place")))


def is_multiple(parts: Column, step: Any) -> Column:
    """Whether a literal, given by its parts, is a whole multiple of a positive number: the remainder is taken piece by piece, of as many digits as the type holds."""
    _, divisor, point = parts_of(step)
    if len(divisor) > MOST_DIGITS:
        raise ValueError(f"multipleOf has more than {MOST_DIGITS} digits")
    kind = "bigint" if len(divisor) < 18 else "decimal(38,0)"
    number = lambda c: c.cast(kind)
    m = number(F.lit(divisor))
    most = 18 - len(divisor) if kind == "bigint" else 1
    tens = F.array(*[F.lit(10**n) for n in range(1, most + 1)])

    def said(digits: Column, place: Column) -> Column:
        zeros = (place - F.length(digits)) - (point - len(divisor))  # what the powers of ten differ by
        pieces = F.regexp_extract_all(digits, F.lit(f".{{1,{most}}}"), F.lit(0))
        rest = F.aggregate(pieces, number(F.lit(0)), lambda r, c: number((r * (F.get(tens, F.length(c) - 1) if most > 1 else 10) + number(c)) % m))
        rest = F.aggregate(F.array_repeat(F.lit(0), F.greatest(zeros, F.lit(0))), rest, lambda r, _: number(r * 10 % m))
        return (digits == "") | F.when(zeros >= 0, rest == 0).otherwise(F.lit(False))  # digits that end in no zero are no multiple of a ten

    return let(parts, lambda y: said(y["digits"], y["place"]))


def against_long(value: Column, operator: str, limit: Any) -> Column:
    """``value operator limit`` for a column of longs; the limit is any number."""
    d = exact(limit)
    bound = {"<": _ceil(d), ">=": _ceil(d), "<=": _floor(d), ">": _floor(d)}[operator]
    if not -LONG <= bound < LONG:
        return F.lit((bound > 0) == (operator in ("<", "<=")))
    return COMPARE[operator](value, F.lit(bound).cast("bigint"))


def _floor(d: Decimal) -> int:
    n = int(d)
    return n - 1 if d < n else n


def _ceil(d: Decimal) -> int:
    n = int(d)
    return n + 1 if d > n else n


def against_form(form: Column, operator: str, limit: Any) -> Column:
    """``literal operator limit``, exactly, from the literal's normal form."""
    return COMPARE[operator](form, F.lit(form_of(limit)))


def same_as_double(limit: Any) -> bool:
    """Whether a number is what the nearest double is written as, so that doubles can be compared with it as they are."""
    d = exact(limit)
    return abs(d) < Decimal(10) ** 300 and Decimal(repr(float(d))) == d
