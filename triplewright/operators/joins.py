"""Joins of solutions: DataFrames with one nullable string column for each variable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


class Solutions:
    """A DataFrame of bindings; ``loose`` names the variables that may be unbound (null)."""

    def __init__(self, df: DataFrame | None, loose: frozenset[str] = frozenset()):
        self.df, self.loose = df, loose

    @property
    def names(self) -> list[str]:
        return self.df.columns if self.df is not None else []


def _equi(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return left.join(right, on, how) if on else left.crossJoin(right)


def _compatible(left: DataFrame, right: DataFrame, strict: list[str], open_: list[str]) -> DataFrame:
    """Join on ``strict``, and on ``open_`` where both sides bind it."""
    renamed = right.select(*(F.col(c).alias(f"__{c}") for c in right.columns))
    on: list[Column] = [F.col(c) == F.col(f"__{c}") for c in strict]
    on += [(F.col(c) == F.col(f"__{c}")) | F.col(c).isNull() | F.col(f"__{c}").isNull() for c in open_]
    joined = left.join(renamed, reduce(Column.__and__, on), "inner") if on else left.crossJoin(renamed)
    shared = [F.coalesce(c, f"__{c}").alias(c) if c in open_ else F.col(c) for c in left.columns]
    return joined.select(*shared, *(F.col(f"__{c}").alias(c) for c in right.columns if c not in left.columns))


def natural(a: Solutions, b: Solutions) -> Solutions:
    """The natural join; an unbound side agrees with anything.

    Where a shared variable may be unbound, rows that bind all of them still
    meet in an equi-join; only rows that don't are compared one by one.
    """
    if a.df is None:
        return b
    if b.df is None:
        return a
    shared = [c for c in a.names if c in b.names]
    open_ = [c for c in shared if c in a.loose or c in b.loose]
    strict = [c for c in shared if c not in open_]
    names = [*a.names, *(c for c in b.names if c not in a.names)]
    if not open_:
        return Solutions(_equi(a.df, b.df, shared).select(*names), (a.loose | b.loose))
    bound = reduce(Column.__and__, [F.col(c).isNotNull() for c in open_])
    parts = [_equi(a.df.where(bound), b.df.where(bound), shared).select(*names)]
    if any(c in b.loose for c in open_):
        parts.append(_compatible(a.df.where(bound), b.df.where(~bound), strict, open_).select(*names))
    if any(c in a.loose for c in open_):
        parts.append(_compatible(a.df.where(~bound), b.df, strict, open_).select(*names))
    both = {c for c in open_ if c in a.loose and c in b.loose}
    return Solutions(reduce(DataFrame.unionAll, parts), frozenset((a.loose | b.loose) - (set(open_) - both)))


def left_outer(a: Solutions, b: Solutions) -> Solutions:
    """All rows of ``a``, extended where ``b`` agrees.  ``k`` equal rows of ``a`` each meet every match."""
    shared = [c for c in a.names if c in b.names]
    names = [*a.names, *(c for c in b.names if c not in a.names)]
    new = frozenset(c for c in b.names if c not in a.names)
    open_ = [c for c in shared if c in a.loose or c in b.loose]
    if not shared:
        out = a.df.join(b.df, F.lit(True), "left")
    elif not open_:
        out = a.df.join(b.df, shared, "left")
    else:
        renamed = b.df.select(*(F.col(c).alias(f"__{c}") for c in b.names))
        on = [(F.col(c) == F.col(f"__{c}")) if c not in open_ else ((F.col(c) == F.col(f"__{c}")) | F.col(c).isNull() | F.col(f"__{c}").isNull()) for c in shared]
        joined = a.df.join(renamed, reduce(Column.__and__, on), "left")
        out = joined.select(*(F.coalesce(c, f"__{c}").alias(c) if c in open_ else F.col(c) for c in a.names), *(F.col(f"__{c}").alias(c) for c in b.names if c not in a.names))
    return Solutions(out.select(*names), frozenset(a.loose | new))


def anti(a: Solutions, b: Solutions) -> Solutions:
    """Rows of ``a`` that no row of ``b`` agrees with.  Without a shared variable, all or none."""
    shared = [c for c in a.names if c in b.names]
    renamed = b.df.select(*(F.col(c).alias(f"__{c}") for c in shared)).distinct() if shared else b.df.limit(1).select(F.lit(1).alias("__any"))
    on = [(F.col(c) == F.col(f"__{c}")) | (F.lit(c in a.loose) & F.col(c).isNull()) | (F.lit(c in b.loose) & F.col(f"__{c}").isNull()) if c in a.loose or c in b.loose else F.col(c) == F.col(f"__{c}") for c in shared]
    return Solutions(a.df.join(renamed, reduce(Column.__and__, on) if on else F.lit(True), "left_anti"), a.loose)


def semi(a: Solutions, b: DataFrame, on: list[str]) -> Solutions:
    return Solutions(a.df.join(b, on, "left_semi"), a.loose)


def union(parts: list[Solutions]) -> Solutions:
    """All rows of all parts; a variable that a part lacks is unbound there."""
    names = list(dict.fromkeys(c for p in parts for c in p.names))
    loose = frozenset(c for c in names if any(c in p.loose or c not in p.names for p in parts))
    return Solutions(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [p.df for p in parts]).select(*names), loose)
