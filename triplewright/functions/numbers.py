"""Natural numbers as names: arithmetic over digit strings.

Operands are strings of decimal digits; anything else, and a null, gives null,
as does an operation without a natural result.  Up to 18 digits (36 for sums)
everything stays a decimal expression in the plan; ``big=True`` takes any
length through one Arrow batch of Python integers instead.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def _value(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{1,37}$"), c).try_cast("decimal(38,0)")


def _text(c: Column) -> Column:
    return c.cast("decimal(38,0)").cast("string")


def _big(op: str):
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None or not (x.isascii() and x.isdigit() and y.isascii() and y.isdigit()):
                return None
            m, n = int(x), int(y)
            if op == "+":
                return str(m + n)
            if op == "*":
                return str(m * n)
            if op == "-":
                return str(m - n) if m >= n else None
            if n == 0:
                return None
            return str(m // n if op == "/" else m % n)

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)

    return run


def add(a: Column, b: Column, big: bool = False) -> Column:
    return _big("+")(a, b) if big else _text(_value(a) + _value(b))


def subtract(a: Column, b: Column, big: bool = False) -> Column:
    """Null where ``b`` is greater."""
    return _big("-")(a, b) if big else F.when(_value(a) >= _value(b), _text(_value(a) - _value(b)))


def multiply(a: Column, b: Column, big: bool = False) -> Column:
    fits = (F.length(a) <= 18) & (F.length(b) <= 18)
    return _big("*")(a, b) if big else F.when(fits, _text(_value(a).cast("decimal(18,0)") * _value(b).cast("decimal(18,0)")))


def divide(a: Column, b: Column, big: bool = False) -> Column:
    """The whole part; null for the divisor 0."""
    return _big("/")(a, b) if big else F.when(_value(b) != 0, _text(F.floor((_value(a) - _value(a) % F.nullif(_value(b), F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)") / F.nullif(_value(b), F.lit(0).cast("decimal(38,0)")))))


def modulo(a: Column, b: Column, big: bool = False) -> Column:
    return _big("%")(a, b) if big else F.when(_value(b) != 0, _text(_value(a) % F.nullif(_value(b), F.lit(0).cast("decimal(38,0)"))))


def compare(a: Column, b: Column) -> Column:
    """``<``, ``>`` or ``==`` by value, whatever the length; null where an operand is no number."""
    x, y = canonical(a), canonical(b)
    longer = F.length(x) - F.length(y)
    return F.when(x.isNotNull() & y.isNotNull(), F.when(x == y, "==").when((longer < 0) | ((longer == 0) & (x < y)), "<").otherwise(">"))


def canonical(c: Column) -> Column:
    """Without leading zeros."""
    return F.when(c.rlike("^[0-9]+$"), F.regexp_replace(c, "^0+(?=.)", ""))


def to_base(c: Column, base: int) -> Column:
    """The digits in another base, 2 to 36, for numbers below 2^63."""
    return F.when(c.rlike("^[0-9]{1,18}$"), F.lower(F.conv(c, 10, base)))


def smallest_divisor(n: Column) -> Column:
    """The least divisor above 1 of a whole number column that has one below itself; null for primes, 0 and 1."""
    value = n.cast("long")
    root = F.floor(F.sqrt(value.cast("double"))).cast("long") + 1
    tried = F.when(value >= 4, F.sequence(F.lit(2).cast("long"), F.greatest(root, F.lit(2).cast("long"))))
    return F.get(F.filter(tried, lambda d: (value % d == 0) & (d < value)), F.lit(0))


def primality(n: Column) -> Column:
    """``prime`` or ``composite``; null for 0 and 1."""
    return F.when(n.cast("long") >= 2, F.when(smallest_divisor(n).isNull(), "prime").otherwise("composite"))


def successor(c: Column) -> Column:
    return add(c, F.lit("1"))


def compact_list(c: Column) -> Column:
    """The characters, last first."""
    return F.reverse(F.split(c, ""))
