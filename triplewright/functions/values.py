"""Comparing node names: as numbers where both are, else as strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = r"^-?[0-9]+([.][0-9]+)?$"


def is_number(c: Column) -> Column:
    return F.coalesce(c.rlike(NUMBER), F.lit(False))


def number(c: Column) -> Column:
    """The value of a name that is a number, else null."""
    return F.when(is_number(c), c.try_cast("double"))


def compare(left: Column, op: str, right: Column) -> Column:
    """``left op right``; an unbound side is the empty string."""
    a, b = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    return F.when(is_number(a) & is_number(b), ops[op](number(a), number(b))).otherwise(ops[op](a, b))


def sort_keys(c: Column, descending: bool = False) -> list[Column]:
    """A total order of names: numbers by value, before all other strings; unbound as the empty string."""
    value = F.coalesce(c, F.lit(""))
    keys = [(~is_number(value)).cast("int"), number(value), F.when(~is_number(value), value)]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]
