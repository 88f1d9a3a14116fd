"""Patterns and condition bodies over facts, compiled to joins.

``triples`` is (``fact_id``, ``s``, ``p``, ``o``), one row for each object of a
fact.  A pattern with several objects needs as many different objects of one
fact; a fact may have more.  A term inside a pattern is a join on its key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from triplewright.operators import joins
from triplewright.operators.joins import Solutions
from triplewright.plans.native import Condition, Differs, Near, Not, Pattern
from triplewright.terms import Atom, Fact, SetTerm, Term, Var, key, variables


@dataclass
class Matcher:
    """Compiles conditions.  ``networks`` holds (``s``, ``o``, ``score``) tables by name; ``members`` set contents."""

    triples: DataFrame
    networks: dict[str, DataFrame] = field(default_factory=dict)
    fresh: int = 0

    def new(self, kind: str) -> str:
        self.fresh += 1
        return f"__{kind}{self.fresh}"

    def match(self, fact: Fact, id_name: str | None = None, triples: DataFrame | None = None) -> Solutions:
        """Bindings of a pattern's variables, and the matched fact under ``id_name``."""
        source = self.triples if triples is None else triples
        nested: list[tuple[str, Fact]] = []

        def slot(term: Term) -> tuple[str, str | None]:
            """(variable, None) or ("", constant)."""
            if isinstance(term, Var):
                return term.name, None
            if not variables(term):
                return "", key(term)
            if isinstance(term, SetTerm):
                raise ValueError("a set with variables can't be matched; match its members with `in`")
            name = self.new("t")
            nested.append((name, term))
            return name, None

        own = id_name or self.new("id")
        parts = [("s", slot(fact.s)), ("p", slot(fact.p))]
        objects = [slot(o) for o in fact.objects]
        df = None
        for k, (name, constant) in enumerate(objects):
            t = source
            if k == 0:
                for column, (_, value) in parts:
                    if value is not None:
                        t = t.where(F.col(column) == value)
            if constant is not None:
                t = t.where(F.col("o") == constant)
            if k == 0:
                df = t.select(F.col("fact_id").alias(own), F.col("s").alias("__s"), F.col("p").alias("__p"), F.col("o").alias("__o0"))
            else:
                t = t.select(F.col("fact_id").alias(own), F.col("o").alias(f"__o{k}"))
                df = df.join(t, own)
                for j in range(k):
                    df = df.where(F.col(f"__o{j}") != F.col(f"__o{k}"))
        at: dict[str, str] = {}
        named = [(n, c) for c, (n, v) in (("__s", parts[0][1]), ("__p", parts[1][1]), *((f"__o{k}", o) for k, o in enumerate(objects))) if v is None]
        for name, column in named:
            if name in at:
                df = df.where(F.col(at[name]) == F.col(column))
            else:
                at[name] = column
        out = Solutions(df.select(F.col(own), *(F.col(c).alias(n) for n, c in at.items())))
        for name, term in nested:
            inner = self.match(term, name)
            out = joins.natural(out, inner)
        return Solutions(out.df.drop(*[n for n, _ in nested]) if nested else out.df)

    def size(self, c: Condition, bound: set[str]) -> tuple:
        """Order of the positive conditions: connected ones first, then those with most constants, then those whose subject is bound: an object that many subjects share would multiply rows that the others still remove."""
        terms = (c.fact.s, c.fact.p, *c.fact.objects)
        names = set(variables(c.fact))
        fans_out = bool(bound) and not set(variables(c.fact.s)) <= bound
        return (bool(bound) and not names & bound, isinstance(c, Near), -sum(isinstance(t, Atom) or not variables(t) for t in terms), fans_out, isinstance(c.fact.p, Var))

    def body(self, conditions: tuple[Condition, ...], seed: tuple[int, DataFrame] | None = None, proof: bool = False) -> Solutions:
        """Bindings of a whole body: positive conditions, inequalities when both sides are bound, negations last.

        ``seed`` gives one condition, by number, a table of its own (the newest
        facts); ``proof`` keeps the matched facts as ``__because0`` and so on.
        """
        now = Solutions(None)
        bound: set[str] = set()
        rest = [k for k, c in enumerate(conditions) if isinstance(c, (Pattern, Near))]
        differs = [c for c in conditions if isinstance(c, Differs)]
        first = [seed[0]] if seed else []
        while rest:
            k = first.pop() if first else min(rest, key=lambda k: self.size(conditions[k], bound))
            rest.remove(k)
            c = conditions[k]
            if isinstance(c, Pattern):
                found = self.match(c.fact, f"__because{k}", seed[1] if seed and seed[0] == k else None)
                if not proof:
                    found = Solutions(found.df.drop(f"__because{k}").distinct() if len(found.names) > 1 else found.df.limit(1).withColumnRenamed(f"__because{k}", self.new("holds")))
                now = joins.natural(now, found)
            else:
                now = self.near(c, now)
            bound |= set(variables(c.fact))
            for d in [d for d in differs if set(variables(d.left)) | set(variables(d.right)) <= bound]:
                differs.remove(d)
                now = Solutions(now.df.where(self.value(d.left) != self.value(d.right)), now.loose)
        for c in conditions:
            if isinstance(c, Not):
                now = self.without(c.fact, now)
        for d in differs:
            names = set(variables(d.left)) | set(variables(d.right))
            if names <= set(now.names):
                now = Solutions(now.df.where(self.value(d.left) != self.value(d.right)), now.loose)
            else:
                raise ValueError(f"{d} has a variable that nothing binds")
        return now

    @staticmethod
    def value(term: Term):
        return F.col(term.name) if isinstance(term, Var) else F.lit(key(term))

    def without(self, fact: Fact, now: Solutions) -> Solutions:
        """Rows for which the fact has no match.

        An unbound object stands for anything.  An unbound subject ranges over
        the subjects of that predicate and is bound by them; objects must be
        bound then.
        """
        if now.df is None:
            now = Solutions(self.triples.sparkSession.range(1).select(F.lit(True).alias(self.new("holds"))))
        if isinstance(fact.s, Var) and fact.s.name not in now.names:
            free = [v for o in fact.objects for v in variables(o) if v not in now.names and v != fact.s.name]
            if free:
                return Solutions(now.df.where(F.lit(False)).withColumn(fact.s.name, F.lit(None).cast("string")))
            every = self.match(Fact(fact.s, fact.p, (Var("_any_object"),))).df
            keep = [c for c in every.columns if c == fact.s.name or c in now.names]
            now = joins.natural(now, Solutions(every.select(*keep).distinct()))
        found = self.match(fact)
        shared = [c for c in found.names if c in now.names]
        return joins.anti(now, Solutions(found.df.select(*shared) if shared else found.df))

    def near(self, c: Near, now: Solutions) -> Solutions:
        """Rows where a network's score is above a half, at most one counted; it multiplies the row's confidence."""
        fact = c.fact
        if c.network not in self.networks:
            raise ValueError(f"there is no network {c.network}")
        table = self.networks[c.network].where(F.col("score") > 0.5)
        names = {}
        for column, term in (("s", fact.s), ("o", fact.objects[0])):
            if isinstance(term, Var):
                names[column] = term.name
            else:
                table = table.where(F.col(column) == key(term))
        score = self.new("score")
        df = table.select(*(F.col(k).alias(v) for k, v in names.items()), F.least(F.col("score"), F.lit(1.0)).alias(score))
        return joins.natural(now, Solutions(df))

    def query(self, conditions: tuple[Condition, ...]) -> DataFrame:
        """The distinct bindings of a body's variables, one column each."""
        found = self.body(conditions).df
        names = [c for c in found.columns if not c.startswith("__")]
        return found.select(*names).distinct()
