"""SELECT queries over a table of triples, as one lazy DataFrame plan.

Group elements take effect in the order of the text.  Triples that follow each
other are joined as one block, cheapest and connected first; transitive steps
come after their block, those with a bound end first.  Only closures run while
the plan is made, since their depth depends on the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from triplewright.functions.values import compare, sort_keys
from triplewright.operators import joins, paths
from triplewright.operators.joins import Solutions
from triplewright.plans.sparql_ast import Call, Closure, Compare, Const, Count, Group, Minus, Optional_, QueryError, Ref, Select, Triple, Union_, parse
from triplewright.storage import small_rows


class SparqlPlan:
    """Compiles queries over ``triples`` (``s``, ``p``, ``o``; strings).

    ``counts`` may hold the number of triples by predicate; it only orders
    joins.  ``kept`` holds adjacency tables by predicate and takes those that
    queries make.
    """

    def __init__(self, triples: DataFrame, counts: dict[str, int] | None = None, kept: dict[str, DataFrame] | None = None):
        self.triples = triples.select("s", "p", "o")
        self.counts = counts or {}
        self.closures: dict[tuple, DataFrame] = {}
        self.kept = {} if kept is None else kept

    def run(self, text: str) -> DataFrame:
        return self.select(parse(text))

    # -- blocks of triples

    def scan(self, t: Triple) -> Solutions:
        """One triple pattern; a variable that stands twice must be equal."""
        df, at = self.triples, {}
        for column, node in (("s", t.s), ("p", t.p), ("o", t.o)):
            if isinstance(node, Const):
                df = df.where(F.col(column) == node.key)
            elif node.name in at:
                df = df.where(F.col(column) == F.col(at[node.name]))
            else:
                at[node.name] = column
        if not at:  # a fully bound pattern holds or doesn't
            return Solutions(df.select(F.lit(True).alias("__holds")).limit(1))
        return Solutions(df.select(*(F.col(c).alias(v) for v, c in at.items())))

    def cost(self, t: Triple, bound: set[str]) -> tuple:
        """Order of a block's triples.  One whose subject is bound comes before one of which only the object is: an object that many subjects share would multiply rows that the others still remove."""
        names = [n.name for n in (t.s, t.p, t.o) if isinstance(n, Ref)]
        constants = sum(isinstance(n, Const) for n in (t.s, t.o))
        rows = self.counts.get(t.p.key, 1 << 40) if isinstance(t.p, Const) else 1 << 50
        fans_out = bool(bound) and isinstance(t.s, Ref) and t.s.name not in bound
        return (bool(bound) and not any(n in bound for n in names), -constants, fans_out, rows)

    def block(self, triples: list[Triple], now: Solutions) -> Solutions:
        rest = list(triples)
        while rest:
            t = min(rest, key=lambda t: self.cost(t, set(now.names)))
            rest.remove(t)
            found = self.scan(t)
            if found.names == ["__holds"]:
                now = Solutions(found.df.drop("__holds").limit(1) if now.df is None else now.df.join(F.broadcast(found.df), F.lit(True), "left_semi"), now.loose)
                if not now.df.columns:
                    now = Solutions(found.df, frozenset())
            else:
                now = joins.natural(now, found)
        return now

    # -- transitive steps

    def edges(self, predicate: str) -> DataFrame:
        return self.triples.where(F.col("p") == predicate).select("s", "o")

    def closure(self, predicate: str, start: str, backward: bool, reflexive: bool) -> DataFrame:
        """A closure from one node, made once for a query."""
        k = (predicate, start, backward, reflexive)
        if k not in self.closures:
            starts = small_rows(self.triples.sparkSession, [(start,)], "node string")
            self.closures[k] = paths.reach(self.kept_edges(predicate), starts, reflexive, backward, kept=True)
        return self.closures[k]

    def kept_edges(self, predicate: str) -> DataFrame:
        """A predicate's adjacency, written once for all closures of a query, or for the graph that keeps it."""
        if predicate not in self.kept:
            self.kept[predicate] = paths.kept_edges(self.edges(predicate))
        return self.kept[predicate]

    def together(self, closures: list[Closure]) -> None:
        """Closures of one predicate and direction from several constants, in one loop over all of them."""
        groups: dict[tuple, list[str]] = {}
        for c in closures:
            backward = isinstance(c.o, Const)
            k = (c.predicate, (c.o if backward else c.s).key, backward, c.modifier == "*")
            if k not in self.closures:
                groups.setdefault((k[0], *k[2:]), []).append(k[1])
        for (predicate, backward, reflexive), starts in groups.items():
            if len(set(starts)) > 1:
                table = small_rows(self.triples.sparkSession, [(s,) for s in sorted(set(starts))], "node string")
                pairs = paths.reach_pairs(self.kept_edges(predicate), table, reflexive, backward, kept=True)
                for s in set(starts):
                    self.closures[predicate, s, backward, reflexive] = pairs.where(F.col("start") == s).select("node")

    def steps(self, steps: list[Closure], now: Solutions) -> Solutions:
        rest = list(steps)
        while rest:
            step = min(rest, key=lambda c: self.step_rank(c, now))
            same = [c for c in rest if self.meets(c, step, now)]
            if len(same) > 1:  # closures from several constants that meet in one variable
                name = self.free_end(step).name
                self.together(same)
                nodes = paths.intersect([self.anchored(c) for c in same])
                now = joins.natural(now, Solutions(nodes.select(F.col("node").alias(name))))
                rest = [c for c in rest if c not in same]
            else:
                now = self.step(step, now)
                rest.remove(step)
        return now

    @staticmethod
    def is_bound(node, now: Solutions) -> bool:
        return isinstance(node, Const) or (node.name in now.names and node.name not in now.loose)

    def step_rank(self, c: Closure, now: Solutions) -> int:
        bound = self.is_bound(c.s, now), self.is_bound(c.o, now)
        return 0 if all(bound) else 1 if any(bound) else 2

    @staticmethod
    def free_end(c: Closure):
        return c.o if isinstance(c.s, Const) else c.s

    def meets(self, c: Closure, step: Closure, now: Solutions) -> bool:
        ends = [isinstance(c.s, Const), isinstance(c.o, Const)]
        if sum(ends) != 1 or sum([isinstance(step.s, Const), isinstance(step.o, Const)]) != 1:
            return c is step
        return self.free_end(c) == self.free_end(step) and self.free_end(c).name not in now.names

    def anchored(self, c: Closure) -> DataFrame:
        backward = isinstance(c.o, Const)
        return self.closure(c.predicate, (c.o if backward else c.s).key, backward, c.modifier == "*")

    def step(self, c: Closure, now: Solutions) -> Solutions:
        reflexive = c.modifier == "*"
        if isinstance(c.s, Const) and isinstance(c.o, Const):
            hit = self.closure(c.predicate, c.s.key, False, reflexive).where(F.col("node") == c.o.key).select(F.lit(True).alias("__holds"))
            return Solutions(hit.limit(1)) if now.df is None else Solutions(now.df.join(F.broadcast(hit.limit(1)), F.lit(True), "left_semi"), now.loose)
        if isinstance(c.s, Const) or isinstance(c.o, Const):
            name = self.free_end(c).name
            nodes = self.anchored(c).select(F.col("node").alias(name))
            if name in now.names and name not in now.loose:
                return joins.semi(now, nodes, [name])
            return joins.natural(now, Solutions(nodes))
        forward, back = self.is_bound(c.s, now), self.is_bound(c.o, now)
        if reflexive and not forward and not back and c.s.name not in now.names and c.o.name not in now.names:
            raise QueryError("a * path needs a bound end")
        here, there = (c.s.name, c.o.name) if forward or not back else (c.o.name, c.s.name)
        starts = now.df.select(F.col(here).alias("node")) if here in now.names else None
        pairs = paths.reach_pairs(self.kept_edges(c.predicate), starts, reflexive, back and not forward, kept=True)
        if here == there:
            return joins.natural(now, Solutions(pairs.where("start = node").select(F.col("start").alias(here))))
        return joins.natural(now, Solutions(pairs.select(F.col("start").alias(here), F.col("node").alias(there))))

    # -- groups

    def group(self, g: Group, now: Solutions) -> Solutions:
        elements, k = g.elements, 0
        while k < len(elements):
            triples, closures = [], []
            while k < len(elements) and isinstance(elements[k], (Triple, Closure)):
                (triples if isinstance(elements[k], Triple) else closures).append(elements[k])
                k += 1
            if triples or closures:
                now = self.steps(closures, self.block(triples, now))
                continue
            now = self.other(elements[k], now)
            k += 1
        return now

    def alone(self, g: Group) -> bool:
        """Whether a group means the same without the rows before it: its filters and options look at nothing else."""
        bound: set[str] = set()
        for e in g.elements:
            if isinstance(e, Triple):
                bound |= {n.name for n in (e.s, e.p, e.o) if isinstance(n, Ref)}
            elif isinstance(e, Closure):
                ends = {n.name for n in (e.s, e.o) if isinstance(n, Ref)}
                if len(ends) == 2 and not ends & bound:
                    return False
                bound |= ends
            elif isinstance(e, Compare):
                if not {v for v in map(self.read, (e.left, e.right)) if v} <= bound:
                    return False
            elif not isinstance(e, Select):
                return False
        return True

    @staticmethod
    def read(x) -> str | None:
        return x.name if isinstance(x, Ref) else x.variable if isinstance(x, Call) else None

    def within(self, g: Group, now: Solutions) -> Solutions:
        """A group that is joined to ``now`` afterwards."""
        if now.df is None or self.alone(g):
            return self.group(g, Solutions(None))
        used = self.mentioned(g)
        keep = [c for c in now.names if c in used]
        return self.group(g, Solutions(now.df.select(*keep).distinct(), frozenset(now.loose & set(keep))) if keep else Solutions(None))

    def mentioned(self, x) -> set[str]:
        if isinstance(x, Group):
            return set().union(*map(self.mentioned, x.elements)) if x.elements else set()
        if isinstance(x, (Optional_, Minus)):
            return self.mentioned(x.group)
        if isinstance(x, Union_):
            return set().union(*map(self.mentioned, x.branches))
        if isinstance(x, Select):
            return {p.alias if isinstance(p, Count) else p for p in x.projection} if "*" not in x.projection else self.mentioned(x.where)
        if isinstance(x, Compare):
            return {v for v in map(self.read, (x.left, x.right)) if v}
        return {n.name for n in (x.s, getattr(x, "p", None), x.o) if isinstance(n, Ref)}

    def unit(self, now: Solutions) -> Solutions:
        """A frame for the one solution that binds nothing."""
        return now if now.df is not None else Solutions(self.triples.sparkSession.range(1).select(F.lit(True).alias("__holds")))

    def other(self, e, now: Solutions) -> Solutions:
        if isinstance(e, Compare):
            now = self.unit(now)
            return Solutions(now.df.where(compare(self.value(e.left, now), e.op, self.value(e.right, now))), now.loose)
        if isinstance(e, Optional_):
            return joins.left_outer(self.unit(now), self.within(e.group, now))
        if isinstance(e, Minus):
            if now.df is None or not [c for c in now.names if c != "__holds"]:
                return now
            return joins.anti(now, self.within(e.group, now))
        if isinstance(e, Union_):
            return joins.natural(now, joins.union([self.within(b, now) for b in e.branches])) if all(map(self.alone, e.branches)) else joins.union([self.group(b, now) for b in e.branches])
        if isinstance(e, Group):
            return self.group(e, now)
        inner = self.select(e)
        return joins.natural(now, Solutions(inner, frozenset(inner.columns)) if self.may_be_loose(e) else Solutions(inner))

    def may_be_loose(self, q: Select) -> bool:
        """Whether a subquery may leave a projected variable unbound."""
        bound: set[str] = set()
        for e in q.where.elements:
            if isinstance(e, (Triple, Closure)):
                bound |= self.mentioned(e)
        names = [p for p in q.projection if isinstance(p, str)]
        return "*" in names and not all(isinstance(e, (Triple, Closure, Compare)) for e in q.where.elements) or any(n != "*" and n not in bound for n in names)

    @staticmethod
    def value(x, now: Solutions):
        if isinstance(x, Const):
            return F.lit(x.key)
        if isinstance(x, Call) and x.function == "lang":
            return F.lit("")
        name = SparqlPlan.read(x)
        return F.col(name).cast("string") if name in now.names else F.lit(None).cast("string")

    # -- modifiers

    def select(self, q: Select) -> DataFrame:
        now = self.unit(self.group(q.where, Solutions(None)))
        df = now.df
        counts = [p for p in q.projection if isinstance(p, Count)]
        plain = [p for p in q.projection if isinstance(p, str) and p != "*"]
        star = "*" in q.projection
        names = sorted(c for c in df.columns if not c.startswith("__")) if star else [p.alias if isinstance(p, Count) else p for p in q.projection]
        if q.group_by or counts:
            at = lambda v: F.col(v) if v in df.columns else F.lit(None).cast("string")
            made = [F.count_distinct(at(c.variable)).alias(c.alias) if c.distinct else F.count(F.lit(1)).alias(c.alias) for c in counts]
            # a variable that isn't grouped takes the least value of its group
            made += [F.min(at(v)).alias(v) for v in (names if star else plain) if v != q.group_by]
            if q.order_by and q.order_by[0] not in [q.group_by, *names, *(c.alias for c in counts)]:
                made.append(F.min(at(q.order_by[0])).alias(q.order_by[0]))
            if q.group_by:
                df = df.withColumn(q.group_by, at(q.group_by)).groupBy(q.group_by).agg(*(made or [F.count(F.lit(1)).alias("__n")]))
            else:
                df = df.agg(*made)
        for v in names:
            if v not in df.columns:
                df = df.withColumn(v, F.lit(None).cast("string"))
        order = []
        if q.order_by and q.order_by[0] in df.columns:
            name, down = q.order_by
            column = F.col(name)
            numeric = dict(df.dtypes)[name] != "string"
            order = [column.desc() if down else column.asc()] if numeric else sort_keys(column, down)
        if order and not q.distinct:
            df = df.orderBy(*order)
        if q.distinct and order and q.order_by[0] not in names:
            # the first row of each distinct one decides its place
            name = q.order_by[0]
            df = df.groupBy(*names).agg((F.max(name) if q.order_by[1] else F.min(name)).alias(name)).orderBy(*order)
        elif q.distinct:
            df = df.select(*names).distinct()
            df = df.orderBy(*order) if order else df
        df = df.limit(q.limit) if q.limit is not None else df
        return df.select(*names) if names else df.select(*[c for c in df.columns if c.startswith("__")][:0])


def predicates(x) -> set[str] | None:
    """The predicates that a query reads; None if a variable stands for one."""
    if isinstance(x, Triple):
        return {x.p.key} if isinstance(x.p, Const) else None
    if isinstance(x, Closure):
        return {x.predicate}
    inner = x.elements if isinstance(x, Group) else x.branches if isinstance(x, Union_) else (x.group,) if isinstance(x, (Optional_, Minus)) else (x.where,) if isinstance(x, Select) else ()
    found = [predicates(e) for e in inner]
    return None if None in found else set().union(*found)


def with_labels(rows: DataFrame, names: DataFrame, lang: str = "en") -> DataFrame:
    """Every column as ``key (label)`` where the node has a label in ``lang`` that differs from its key."""
    labels = names.where(F.col("lang") == lang).select(F.col("node").alias("__node"), F.col("name").alias("__label")).dropDuplicates(["__node"])
    out = rows
    for c in rows.columns:
        joined = out.join(labels, F.col(c) == F.col("__node"), "left")
        out = joined.withColumn(c, F.when(F.col("__label").isNotNull() & (F.col("__label") != F.col(c)), F.concat(F.col(c), F.lit(" ("), F.col("__label"), F.lit(")"))).otherwise(F.col(c))).drop("__node", "__label")
    return out.select(*rows.columns)
