"""Rules to a fixpoint: semi-naive rounds, negation after the positive rules, new nodes, contradictions, proofs.

State is a table of facts (``fact_id``, ``s``, ``p``, ``objects``, ``prob``,
``derived``, ``iter``, ``rule_id``, ``cluster``, ``premises``).  Each round
joins the newest facts into every place of every rule's body, keeps what isn't
known yet, and writes it to the shared folder.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from triplewright.plans.native import Near, Not, Pattern, Rule, read
from triplewright.plans.patterns import Matcher
from triplewright.storage import small_rows, stored
from triplewright.terms import Fact, SetTerm, Term, Var, fact_key_column, key, variables

FACTS = "fact_id string, s string, p string, objects array<string>, prob double, derived boolean, iter int, rule_id string, cluster string, premises array<string>"


#: Rounds after which all facts are written anew as one table, so that plans don't grow with the rounds.
COMPACT = 16


def predicates_of(term: Term) -> set[str] | None:
    """Keys of the predicates of a fact and of the facts in it; None if one may be any."""
    out: set[str] = set()
    for part in (term.s, term.p, *term.objects) if isinstance(term, Fact) else (term.elements if isinstance(term, SetTerm) else ()):
        if isinstance(part, SetTerm) and variables(part):
            return None
        inner = predicates_of(part)
        if inner is None:
            return None
        out |= inner
    if isinstance(term, Fact):
        if variables(term.p):
            return None
        out.add(key(term.p))
    return out


def feeds(makers: list[Rule], users: list[Rule]) -> bool:
    """Whether some fact that ``makers`` conclude may match a condition of ``users``."""
    made = [predicates_of(h) for r in makers for h in r.heads]
    used = [predicates_of(c.fact) if isinstance(c, Pattern | Not) else None if isinstance(c, Near) else set() for r in users if r.heads for c in r.body]
    return any(m is None and u != set() or u is None or m & u for m in made for u in used)


class TooManyRounds(RuntimeError):
    """Rules still add facts after the allowed number of rounds."""


def triples_of(facts: DataFrame) -> DataFrame:
    """(``fact_id``, ``s``, ``p``, ``o``) of the facts that aren't known to be wrong."""
    return facts.where("prob >= 0.5 or derived").select("fact_id", "s", "p", F.explode("objects").alias("o"))


def rule_id(rule: Rule, place: int) -> str:
    return f"rule {place}: {rule.name}" if rule.name else f"rule {place}"


@dataclass
class Inference:
    """The outcome of a run: all facts, those that are new, contradictions, rounds."""

    facts: DataFrame
    new: DataFrame
    contradictions: DataFrame
    rounds: int


@dataclass
class Engine:
    """Runs ``rules`` (text or ``Rule``) over a table of facts.

    ``mode``: ``semi-naive``; ``naive`` (every round looks at all facts);
    ``once`` (one pass over all rules); ``check`` (semi-naive, then a pass over
    all facts that must add nothing).
    """

    rules: list[Rule | str]
    networks: dict[str, DataFrame] = field(default_factory=dict)
    mode: str = "semi-naive"
    most_rounds: int = 1000

    def __post_init__(self):
        self.rules = [read(r) if isinstance(r, str) else r for r in self.rules]
        for r in self.rules:
            if not isinstance(r, Rule):
                raise ValueError(f"{r} is no rule")
        negated = {c.fact.p for r in self.rules if r.deferred for c in r.body if isinstance(c, Not)}
        made = {h.p for r in self.rules if r.deferred for h in r.heads}
        if any(p in made for p in negated):
            warnings.warn("a rule with a negation makes facts that another one negates; such rules all see the state before their round", stacklevel=2)

    def run(self, facts: DataFrame, fresh: DataFrame | None = None) -> Inference:
        """Infer over ``facts``.  With ``fresh``, those of them that came after an earlier fixpoint, the first round starts from these alone."""
        spark = facts.sparkSession
        known = facts if set(facts.columns) >= {"premises"} else facts.withColumn("premises", F.lit(None).cast("array<string>"))
        known = stored(known.select(*[c.split()[0] for c in FACTS.split(", ")]))
        added, contradictions, rounds, delta = [], [], 0, fresh
        wrong = known.where("prob < 0.5 and not derived").select("fact_id")
        self._wrong = None if wrong.isEmpty() else wrong
        self._against = contradictions
        positive = [k for k, r in enumerate(self.rules) if not r.deferred]
        deferred = [k for k, r in enumerate(self.rules) if r.deferred]
        of = lambda group: [self.rules[k] for k in group]
        again = self.mode == "naive" or feeds(of(positive), of(positive))
        back = self.mode == "naive" or feeds(of(deferred), self.rules)
        grew = False
        while True:
            # positive rules to their fixpoint; then the others, all against the same state
            for group in (positive, deferred):
                while group:
                    if rounds >= self.most_rounds:
                        raise TooManyRounds(f"{rounds} rounds")
                    rounds += 1
                    new = self.round(known, group, delta if group is positive else None, rounds)
                    grew = not new.isEmpty()
                    if grew:
                        known = known.unionByName(new)
                        added.append(new)
                        if rounds % COMPACT == 0:
                            known, added = stored(known), [stored(reduce(DataFrame.unionByName, added))]
                    if group is deferred or not grew or self.mode == "once" or not again:
                        break
                    delta = new if self.mode != "naive" else None
            if not deferred or self.mode == "once" or not grew or not back:
                break
            delta = new if self.mode != "naive" else None
        if self.mode == "check":
            missed = self.round(known, positive, None, rounds + 1)
            if not missed.isEmpty():
                raise AssertionError(f"semi-naive evaluation missed {missed.count()} facts")
        matcher = Matcher(triples_of(known), self.networks)
        for k, rule in enumerate(self.rules):
            if not rule.heads:
                contradictions.append(self.clashes(matcher.body(rule.body, proof=True).df, k))
        new = reduce(DataFrame.unionByName, added) if added else known.where(F.lit(False))
        return Inference(known, new, stored(reduce(DataFrame.unionByName, contradictions).distinct()), rounds) if contradictions else Inference(known, new, small_rows(spark, [], "rule_id string, bindings array<string>, premises array<string>"), rounds)

    # -- one round

    def round(self, known: DataFrame, group: list[int], delta: DataFrame | None, number: int) -> DataFrame:
        matcher = Matcher(triples_of(known), self.networks)
        fresh = triples_of(delta) if delta is not None else None
        parts = []
        for k in group:
            rule = self.rules[k]
            if not rule.heads:
                continue
            leaves = [i for i, c in enumerate(rule.body) if isinstance(c, Pattern)]
            if fresh is None or not leaves or any(isinstance(c, Near) for c in rule.body):
                parts.append(self.deduce(matcher, rule, k, matcher.body(rule.body, proof=True).df))
            else:
                parts += [self.deduce(matcher, rule, k, matcher.body(rule.body, (i, fresh), proof=True).df) for i in leaves]
        if not parts:
            return known.where(F.lit(False))
        made = reduce(DataFrame.unionByName, parts)
        # of several derivations the first by rule and premises
        one = made.groupBy("fact_id").agg(F.min(F.struct("rule_id", "premises", "s", "p", "objects", "prob")).alias("x")).select("fact_id", "x.*")
        if self._wrong is not None:  # what is known to be wrong isn't asserted but reported
            self._against.append(one.join(self._wrong, "fact_id", "left_semi").select("rule_id", F.array().cast("array<string>").alias("bindings"), "premises"))
        new = one.join(known.select("fact_id"), "fact_id", "left_anti")
        return stored(new.select("fact_id", "s", "p", "objects", "prob", F.lit(True).alias("derived"), F.lit(number).alias("iter"), "rule_id", F.lit(None).cast("string").alias("cluster"), "premises"))

    def deduce(self, matcher: Matcher, rule: Rule, place: int, found: DataFrame) -> DataFrame:
        """The facts that a rule's bindings assert, inner ones with them."""
        bound = {c for c in found.columns if not c.startswith("__")}
        wanted = {v for h in rule.heads for v in variables(h)}
        new_names = sorted(wanted - bound)
        because = [c for c in found.columns if c.startswith("__because")]
        scores = [c for c in found.columns if c.startswith("__score")]
        rows = found.withColumn("__prob", reduce(Column.__mul__, [F.col(c) for c in scores], F.lit(1.0))).withColumn("__premises", F.array_sort(F.array(*because)) if because else F.array().cast("array<string>"))
        if new_names:
            frontier = sorted(wanted & bound)
            rows = rows.groupBy(*frontier).agg(F.min(F.struct("__premises", "__prob")).alias("__x")).select(*frontier, "__x.*") if frontier else rows.agg(F.min(F.struct("__premises", "__prob")).alias("__x")).where("__x is not null").select("__x.*")
            # nothing to do where the heads hold with some node already
            holds = matcher.body(tuple(Pattern(h) for h in rule.heads)).df
            if frontier:
                rows = rows.join(holds.select(*frontier).distinct(), frontier, "left_anti")
            else:
                rows = rows.join(holds.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti")
            tag = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
            for v in new_names:
                rows = rows.withColumn(v, F.concat(F.lit("x:"), F.sha2(F.concat(tag(F.lit(rule_id(rule, place))), tag(F.lit(v)), *[tag(F.col(c)) for c in frontier]).cast("binary"), 256)))
        out = []
        for h in rule.heads:
            self.assert_fact(h, rows, out)
        return reduce(DataFrame.unionByName, [df.select("fact_id", "s", "p", "objects", F.col("__prob").alias("prob"), F.lit(rule_id(rule, place)).alias("rule_id"), F.col("__premises").alias("premises")) for df in out])

    def assert_fact(self, fact: Fact, rows: DataFrame, out: list[DataFrame]) -> Column:
        """Add the table of a head's facts to ``out``; returns the fact's key column."""

        def part(term: Term) -> Column:
            if isinstance(term, Var):
                return F.col(term.name)
            if isinstance(term, Fact):
                return self.assert_fact(term, rows, out)
            if isinstance(term, SetTerm) and variables(term):
                raise ValueError("a consequence can't build a set of variables")
            return F.lit(key(term))

        s, p, objects = part(fact.s), part(fact.p), F.array_sort(F.array_distinct(F.array(*[part(o) for o in fact.objects])))
        own = fact_key_column(s, p, objects)
        # a predicate among the objects, and a subject among several, make no fact
        ok = ~F.array_contains(objects, p) & ((F.size(objects) == 1) | ~F.array_contains(objects, s))
        out.append(rows.withColumns({"fact_id": own, "s": s, "p": p, "objects": objects}).where(ok))
        return own

    # -- contradictions

    def clashes(self, found: DataFrame, place: int) -> DataFrame:
        names = [c for c in found.columns if not c.startswith("__")]
        because = [c for c in found.columns if c.startswith("__because")]
        pairs = [x for c in names for x in (F.lit(c), F.col(c))]
        bindings = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        text = F.array_sort(F.transform(F.map_entries(bindings), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
        return found.select(F.lit(rule_id(self.rules[place], place)).alias("rule_id"), text.alias("bindings"), F.array_sort(F.array(*because)).alias("premises") if because else F.array().cast("array<string>").alias("premises")).distinct()
