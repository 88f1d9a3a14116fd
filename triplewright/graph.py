"""A graph of facts and names, held as DataFrames.

All methods that change the graph return a new one; DataFrames are never
altered.  Facts are idempotent: equal subject, predicate and object set are one
fact, whose probability moves away from a half and never across it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from triplewright.operators import paths
from triplewright.plans.native import Rule, read, show_rule
from triplewright.plans.patterns import Matcher
from triplewright.plans.rules import FACTS, Engine, Inference, triples_of
from triplewright.plans.sparql import SparqlPlan
from triplewright.storage import small_rows, stored
from triplewright.terms import NIL, Atom, Fact, SetTerm, Term, Var, compact_list, fact_key, fact_key_column, inner_facts, key, make_list

NAMES = "node string, lang string, name string"
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
CORE = ("->", "~", "=>", "!=", "!", "cons", "nil", "in", "conjunction", "negation")


class ContradictingFact(ValueError):
    """A fact is asserted against what is known of it."""


class ReadOnly(RuntimeError):
    """A partly loaded graph can't be changed."""


def as_term(x: Term | str) -> Term:
    return Atom(x) if isinstance(x, str) else x


def merged(facts: DataFrame) -> DataFrame:
    """One row for each fact: of several probabilities the one farthest from a half; its first origin otherwise."""
    by = facts.groupBy("fact_id").agg(
        *(F.min(c).alias(c) for c in ("s", "p", "objects")), F.when(F.max("prob") >= 0.5, F.max("prob")).otherwise(F.min("prob")).alias("prob"), F.min("prob").alias("__low"), F.max("prob").alias("__high"),
        F.min("derived").alias("derived"), F.min("iter").alias("iter"), F.min("rule_id").alias("rule_id"), F.when(F.count("cluster") == F.count("*"), F.min("cluster")).alias("cluster"), F.min("premises").alias("premises"),
    )
    return by


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    facts: DataFrame
    names: DataFrame
    synapses: DataFrame
    rules: tuple[Rule, ...] = ()
    cluster: str | None = None
    read_only: bool = False
    languages: dict[str, Callable] = field(default_factory=dict)
    number: Callable[[str], Term] | None = None
    display: Callable = F.col
    doubts: bool = True
    blank: bool = False
    kept: dict[str, DataFrame] = field(default_factory=dict)
    kept_of: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(doubts=False, blank=True, spark=spark, **dict(zip(("facts", "names", "synapses"), cls._tables(spark))))

    @staticmethod
    def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        return (small_rows(spark, [], FACTS), small_rows(spark, [], NAMES), small_rows(spark, [], "src string, dst string, w double"))

    # -- making facts

    def _own(self) -> None:
        if self.read_only:
            raise ReadOnly("this graph was loaded in part")

    def rows(self, facts: Iterable[tuple[Fact, float]]) -> DataFrame:
        """Facts as rows, with the facts inside them; set terms bring their ``in`` facts."""
        out = {}

        def put(f: Fact, prob: float) -> None:
            s, p, objects = key(f.s), key(f.p), sorted({key(o) for o in f.objects})
            if p in objects:
                raise ValueError(f"the predicate {p} is an object of its own fact")
            if s in objects and len(objects) > 1:
                raise ValueError(f"{s} can't be its own object among others")
            out[fact_key(s, p, objects)] = (fact_key(s, p, objects), s, p, objects, float(prob), False, 0, None, self.cluster, None)
            for part in (f.s, f.p, *f.objects):
                if isinstance(part, SetTerm) and f.p != Atom("in"):
                    for e in part.elements:
                        put(Fact(e, Atom("in"), (part,)), 1.0)

        for fact, prob in facts:
            for f in inner_facts(fact)[:-1]:
                put(f, 1.0)
            put(fact, prob)
        return small_rows(self.spark, list(out.values()), FACTS)

    def add(self, *facts: Fact | str, prob: float = 1.0) -> Graph:
        """Assert facts (terms, or text of the rule language; text of a rule is added as a rule)."""
        self._own()
        terms, rules = [], []
        for f in facts:
            t = self.read(f) if isinstance(f, str) else f
            if isinstance(t, Rule):
                rules.append(t)
            elif isinstance(t, Fact):
                terms.append((t, prob))
            else:
                raise ValueError(f"{f} is no fact")
        out = self._insert(self.rows(terms), min(1.0, prob)) if terms else self
        return replace(out, rules=(*out.rules, *rules))

    def insert(self, rows: DataFrame, trusted: bool = False) -> Graph:
        """Add a table of facts.  ``trusted`` appends it as it is: it must hold no known fact."""
        return self._insert(rows, 0.0, trusted)

    def _insert(self, rows: DataFrame, least: float, trusted: bool = False, distinct: bool = False) -> Graph:
        """``least``: no row has a lower probability; ``distinct``: no two rows are one fact.  Facts are looked through for clashes only if some may be held wrong."""
        self._own()
        doubts = self.doubts or least < 0.5
        if trusted or self.blank and distinct:
            return replace(self, facts=rows.select(*COLUMNS) if self.blank else self.facts.unionByName(rows.select(*COLUMNS)), doubts=doubts, blank=False)
        both = merged(rows.select(*COLUMNS) if self.blank else self.facts.unionByName(rows.select(*COLUMNS)))
        if doubts:
            both = stored(both)
            clash = both.where("__low < 0.5 and __high > 0.5").limit(1).collect()
            if clash:
                r = clash[0]
                raise ContradictingFact(f"{r['s']} {r['p']} {r['objects']} is known otherwise")
        return replace(self, facts=both.select(*COLUMNS), doubts=doubts, blank=False)

    def delta(self, before: Graph) -> DataFrame:
        """The facts, inner ones with them, that this graph has and ``before`` hasn't."""
        return self.facts.join(before.facts.select("fact_id"), "fact_id", "left_anti").select(*COLUMNS)

    def observe(self, rows: DataFrame, watch: Callable[[DataFrame], None]) -> Graph:
        """``insert``, which gives ``watch`` the facts that are new by it, written once."""
        grown = self.insert(rows)
        watch(stored(grown.delta(self)))
        return grown

    def insert_triples(self, df: DataFrame, prob: float = 1.0, distinct: bool = False) -> Graph:
        """Add a table of (``s``, ``p``, ``o``), each row a fact of one object; rows with nulls or ``p = o`` are left out.  ``distinct``: no two rows are equal."""
        rows = df.select("s", "p", "o").where("s is not null and p is not null and o is not null and p <> o")
        rows = rows if distinct else rows.distinct()
        objects = F.array("o")
        facts = rows.select(fact_key_column(F.col("s"), F.col("p"), objects).alias("fact_id"), "s", "p", objects.alias("objects"), F.lit(prob).alias("prob"), F.lit(False).alias("derived"), F.lit(0).alias("iter"), F.lit(None).cast("string").alias("rule_id"), F.lit(self.cluster).cast("string").alias("cluster"), F.lit(None).cast("array<string>").alias("premises"))
        return self._insert(facts, prob, distinct=True)

    def read(self, text: str, **names: Term):
        return read(text, self.number, names) if self.number else read(text, names=names)

    @staticmethod
    def list(*elements: Term | str) -> Term:
        return make_list([as_term(e) for e in elements])

    @staticmethod
    def chars(text: str) -> Term:
        return compact_list(text)

    @staticmethod
    def set(*elements: Term | str) -> SetTerm:
        return SetTerm(tuple(dict.fromkeys(as_term(e) for e in elements))) if elements else SetTerm(())

    @staticmethod
    def car(term: Term) -> Term | None:
        return term.s if isinstance(term, Fact) and term.p == Atom("cons") else None

    @staticmethod
    def cdr(term: Term) -> Term | None:
        return term.objects[0] if isinstance(term, Fact) and term.p == Atom("cons") else (Atom(NIL) if term == Atom(NIL) else None)

    # -- looking up

    @property
    def triples(self) -> DataFrame:
        """(``fact_id``, ``s``, ``p``, ``o``): a row for each object of each fact that isn't known to be wrong."""
        return triples_of(self.facts)

    def keep_edges(self, *predicates: str) -> Graph:
        """The graph with adjacency tables of some predicates, written once; closures and queries read them until facts change."""
        return replace(self, kept={p: paths.kept_edges(self.edges(p)) for p in predicates}, kept_of=self.facts)

    def _kept(self) -> dict[str, DataFrame]:
        return self.kept if self.kept_of is self.facts else {}

    def edges(self, predicate: str) -> DataFrame:
        return self.triples.where(F.col("p") == predicate).select("s", "o")

    def targets(self, s: str, p: str) -> DataFrame:
        return self.triples.where((F.col("s") == s) & (F.col("p") == p)).select(F.col("o").alias("node")).distinct()

    def sources(self, p: str, o: str) -> DataFrame:
        return self.triples.where((F.col("p") == p) & (F.col("o") == o)).select(F.col("s").alias("node")).distinct()

    def exists(self, s: Term | str, p: Term | str, *objects: Term | str) -> bool:
        """Whether exactly this fact is known and not wrong."""
        own = fact_key(key(as_term(s)), key(as_term(p)), [key(as_term(o)) for o in objects])
        return not self.facts.where((F.col("fact_id") == own) & ((F.col("prob") >= 0.5) | F.col("derived"))).isEmpty()

    def answer(self, fact: Fact) -> str:
        """``correct``, ``wrong`` or ``unknown``."""
        found = self.facts.where(F.col("fact_id") == key(fact)).select("prob").limit(1).collect()
        return "unknown" if not found or found[0]["prob"] == 0.5 else "correct" if found[0]["prob"] > 0.5 else "wrong"

    def closure(self, start: str, predicate: str, reflexive: bool = False, backward: bool = False) -> DataFrame:
        kept = self._kept().get(predicate)
        return paths.reach(self.edges(predicate) if kept is None else kept, small_rows(self.spark, [(start,)], "node string"), reflexive, backward, kept is not None)

    def nodes(self) -> DataFrame:
        """Every node that a fact or a name mentions, with its kind."""
        ends = self.facts.select(F.explode(F.concat(F.array("s", "p"), F.col("objects"))).alias("node")).unionByName(self.facts.select(F.col("fact_id").alias("node"))).unionByName(self.names.select("node")).distinct()
        start = F.substring("node", 1, 2)
        return ends.select("node", F.when(start == "f:", "fact").when(start == "s:", "set").when(start == "x:", "anon").otherwise("atom").alias("kind"))

    def first_nodes(self, n: int, lang: str | None = None) -> DataFrame:
        if lang is None:
            return self.nodes().orderBy("node").limit(n)
        return self.names.where(F.col("lang") == lang).orderBy("node").limit(n)

    def outgoing(self, node: str, n: int = 20) -> DataFrame:
        """What a node's own facts lead to: (``role``, ``p``, ``other``)."""
        mine = self.triples.where(F.col("s") == node).select(F.lit("subject").alias("role"), "p", F.col("o").alias("other"))
        return mine.unionByName(self.triples.where(F.col("fact_id") == node).select(F.lit("fact").alias("role"), "p", F.col("o").alias("other"))).orderBy("role", "p", "other").limit(n)

    def incoming(self, node: str, n: int = 20) -> DataFrame:
        mine = self.triples.where(F.col("o") == node).select(F.lit("object").alias("role"), "p", F.col("s").alias("other"))
        return mine.unionByName(self.triples.where(F.col("p") == node).select(F.lit("predicate").alias("role"), "p", F.col("s").alias("other"))).orderBy("role", "p", "other").limit(n)

    def node(self, name: str) -> DataFrame:
        """A node's names and degrees, one row."""
        t = self.triples
        n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
        degrees = t.agg(n(F.col("s") == name)("as_subject"), n(F.col("p") == name)("as_predicate"), n(F.col("o") == name)("as_object"))
        called = self.names.where(F.col("node") == name).agg(F.sort_array(F.collect_list(F.concat_ws(":", "lang", "name"))).alias("names"))
        return degrees.select(F.lit(name).alias("node"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("as_subject", "as_predicate", "as_object"))).crossJoin(called)

    # -- names

    def set_name(self, node: str, name: str, lang: str = "en") -> Graph:
        """Name a node in a language.  A name that another node has in it makes the two one node."""
        self._own()
        other = self.names.where((F.col("lang") == lang) & (F.col("name") == name) & (F.col("node") != node)).select("node").collect()
        kept = self.names.where(~((F.col("node") == node) & (F.col("lang") == lang)))
        out = replace(self, names=kept.unionByName(small_rows(self.spark, [(node, lang, name)], NAMES)))
        for r in other:
            out = out.merge_nodes(r["node"], node)
        return out

    def remove_name(self, node: str, lang: str) -> Graph:
        self._own()
        return replace(self, names=self.names.where(~((F.col("node") == node) & (F.col("lang") == lang))))

    def name_of(self, node: str, lang: str = "en") -> str | None:
        """A node's name in a language; else in English, else in any, else the node's key if it is an atom."""
        found = {r["lang"]: r["name"] for r in self.names.where(F.col("node") == node).collect()}
        return found.get(lang) or found.get("en") or (found[min(found)] if found else None) or (node if node[:2] not in ("f:", "s:", "x:") else None)

    def resolve(self, name: str, lang: str = "en") -> str:
        """The node of a name in a language; a name that no node has is its own node."""
        found = self.names.where((F.col("lang") == lang) & (F.col("name") == name)).select("node").orderBy("node").limit(1).collect()
        return found[0]["node"] if found else name

    def labelled(self, rows: DataFrame, lang: str = "en") -> DataFrame:
        from triplewright.plans.sparql import with_labels

        return with_labels(rows, self.names, lang)

    # -- queries and rules

    def sparql(self, text: str) -> DataFrame:
        return SparqlPlan(self.triples, kept=self._kept()).run(text)

    def match(self, pattern, networks: dict[str, DataFrame] | None = None) -> DataFrame:
        """Distinct bindings of a pattern or of several conditions (text or parsed)."""
        x = self.read(pattern) if isinstance(pattern, str) else pattern
        if isinstance(x, Rule):
            raise ValueError("a rule is no query")
        if isinstance(x, Fact):
            from triplewright.plans.native import conditions

            x = conditions(x)
        return Matcher(self.triples, networks or {}).query(x)

    def register_language(self, keyword: str, run: Callable) -> Graph:
        """Another query language: ``run(graph, text)`` is called by ``query`` for text that starts with the keyword."""
        return replace(self, languages={**self.languages, keyword: run})

    def query(self, text: str) -> DataFrame:
        """SELECT text, text of a registered language, or a pattern, by its first word."""
        words = text.split(None, 1)
        if words and words[0] in self.languages:
            return self.languages[words[0]](self, text)
        if words and words[0].upper() in ("SELECT", "PREFIX"):
            return self.sparql(text)
        return self.match(text)

    def rule(self, body: list[str | Fact], *heads: str | Fact) -> Graph:
        """Add a rule from its parts; without heads a match is a contradiction."""
        from triplewright.plans.native import conditions

        parts = tuple(c for b in body for c in (lambda x: x if isinstance(x, tuple) else conditions(x))(self.read(b) if isinstance(b, str) else b))
        made = tuple((lambda x: x[0].fact if isinstance(x, tuple) else x)(self.read(h) if isinstance(h, str) else h) for h in heads)
        return replace(self, rules=(*self.rules, Rule(parts, made)))

    def without_rules(self) -> Graph:
        return replace(self, rules=())

    def list_rules(self) -> DataFrame:
        """(``place``, ``rule``): the rules as text, in order."""
        return small_rows(self.spark, [(k, show_rule(r)) for k, r in enumerate(self.rules)], "place int, rule string")

    def remove_rule(self, which: int | str) -> Graph:
        """Without one rule, by its place or its text."""
        wanted = self.read(which) if isinstance(which, str) else self.rules[which]
        kept = [r for r in self.rules if (r.body, r.heads) != (wanted.body, wanted.heads)]
        if len(kept) == len(self.rules):
            raise ValueError(f"no such rule: {which}")
        return replace(self, rules=tuple(kept))

    def infer(self, mode: str = "semi-naive", networks: dict[str, DataFrame] | None = None) -> tuple[Graph, Inference]:
        """Run the rules; the graph with what they add, and the outcome."""
        out = Engine(list(self.rules), networks or {}, mode).run(self.facts)
        facts = out.facts.withColumn("cluster", F.when(F.col("derived") & F.col("cluster").isNull(), F.lit(self.cluster)).otherwise(F.col("cluster"))) if self.cluster else out.facts
        return replace(self, facts=facts.select(*COLUMNS)), out

    # -- statistics

    def predicate_usage(self) -> DataFrame:
        """Facts by predicate, rarest first."""
        return self.facts.groupBy("p").count().withColumnRenamed("count", "n").orderBy("n", "p")

    def value_usage(self, predicate: str) -> DataFrame:
        """Objects of a predicate by how often they occur."""
        return self.triples.where(F.col("p") == predicate).groupBy("o").count().withColumnRenamed("count", "n").orderBy("n", "o")

    def statistics(self) -> DataFrame:
        """(``what``, ``n``): facts, nodes, rules, names by language."""
        fixed = self.facts.agg(F.count("*").alias("n")).select(F.lit("facts").alias("what"), "n").unionByName(self.nodes().agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n"))
        fixed = fixed.unionByName(small_rows(self.spark, [("rules", len(self.rules))], "what string, n long"))
        return fixed.unionByName(self.names.groupBy("lang").count().select(F.concat(F.lit("names "), "lang").alias("what"), F.col("count").alias("n")))

    # -- changing

    def _matched(self, pattern) -> tuple[DataFrame, Fact]:
        x = self.read(pattern) if isinstance(pattern, str) else pattern
        fact = x[0].fact if isinstance(x, tuple) else x
        return Matcher(self.triples).match(fact, "__fact").df, fact

    def prune_facts(self, pattern) -> Graph:
        """Without the facts that match."""
        self._own()
        found, _ = self._matched(pattern)
        return replace(self, facts=self.facts.join(found.select(F.col("__fact").alias("fact_id")).distinct(), "fact_id", "left_anti"))

    def prune_nodes(self, pattern) -> Graph:
        """Without the nodes that match: the subjects if the pattern's subject is a variable, else the objects; and every fact of them."""
        self._own()
        found, fact = self._matched(pattern)
        side = fact.s if isinstance(fact.s, Var) else fact.objects[0]
        if not isinstance(side, Var):
            raise ValueError("the pattern has no variable as subject or object")
        return self._without(found.select(F.col(side.name).alias("node")).distinct())

    def _without(self, nodes: DataFrame) -> Graph:
        """Remove nodes, every fact of them, and facts about those facts."""
        facts, gone = self.facts, nodes
        while True:
            hit = facts.select("fact_id", F.explode(F.concat(F.array("s", "p"), F.col("objects"))).alias("node")).join(gone, "node", "left_semi").select(F.col("fact_id").alias("node")).distinct()
            next_facts = facts.join(hit.withColumnRenamed("node", "fact_id"), "fact_id", "left_anti")
            inner = self.facts.select(F.explode(F.concat(F.array("s", "p"), F.col("objects"))).alias("node")).where(F.col("node").startswith("f:"))
            gone = hit.join(inner, "node", "left_semi")
            facts = next_facts
            if gone.isEmpty():
                return replace(self, facts=facts, names=self.names.join(nodes, "node", "left_anti"))

    def remove_node(self, node: str) -> Graph:
        self._own()
        return self._without(small_rows(self.spark, [(node,)], "node string"))

    def cleanup(self) -> Graph:
        """Without facts about facts that don't exist, and names of nodes that no fact mentions."""
        self._own()
        out = self
        while True:
            ends = out.facts.select("fact_id", F.explode(F.concat(F.array("s"), F.col("objects"))).alias("node")).where(F.col("node").startswith("f:"))
            broken = ends.join(out.facts.select(F.col("fact_id").alias("node")), "node", "left_anti").select("fact_id").distinct()
            if broken.isEmpty():
                break
            out = replace(out, facts=out.facts.join(broken, "fact_id", "left_anti"))
        used = out.facts.select(F.explode(F.concat(F.array("s", "p"), F.col("objects"))).alias("node")).distinct()
        return replace(out, names=out.names.join(used, "node", "left_semi"))

    def merge_nodes(self, gone: str, kept: str) -> Graph:
        """Two nodes as one: ``gone`` is replaced in every fact, name and synapse."""
        self._own()
        now = lambda c: F.when(c == gone, F.lit(kept)).otherwise(c)
        objects = F.array_sort(F.array_distinct(F.transform("objects", now)))
        moved = self.facts.withColumns({"s": now(F.col("s")), "p": now(F.col("p")), "objects": objects})
        moved = moved.withColumn("fact_id", fact_key_column(F.col("s"), F.col("p"), F.col("objects"))).where(~F.array_contains("objects", F.col("p")))
        names = self.names.withColumn("node", now(F.col("node"))).groupBy("node", "lang").agg(F.min("name").alias("name"))
        synapses = self.synapses.withColumns({"src": now(F.col("src")), "dst": now(F.col("dst"))})
        return replace(self, facts=merged(moved).select(*COLUMNS), names=names, synapses=synapses)

    # -- clusters

    def use_cluster(self, name: str | None) -> Graph:
        """From now on new facts belong to a cluster; facts that are known already don't."""
        return replace(self, cluster=name)

    def clusters(self) -> DataFrame:
        return self.facts.where("cluster is not null").groupBy("cluster").count().withColumnRenamed("count", "n").orderBy("cluster")

    def drop_cluster(self, name: str) -> Graph:
        self._own()
        return replace(self, facts=self.facts.where(F.col("cluster").isNull() | (F.col("cluster") != name)), cluster=None if self.cluster == name else self.cluster)

    def merge_cluster(self, name: str, into: str | None = None) -> Graph:
        self._own()
        return replace(self, facts=self.facts.withColumn("cluster", F.when(F.col("cluster") == name, F.lit(into)).otherwise(F.col("cluster"))), cluster=into if self.cluster == name else self.cluster)

    # -- files

    def save(self, path: str) -> None:
        """Facts (in parts of predicates, each in as many files as it takes), names, synapses as Parquet, rules as text."""
        for r in self.rules:
            again = read(show_rule(r))
            if (again.body, again.heads) != (r.body, r.heads):
                raise ValueError(f"the rule can't be written as text: {r}")
        self.facts.withColumn("part", F.pmod(F.xxhash64("p"), F.lit(64))).repartitionByRange("part", "p", "s").sortWithinPartitions("part", "p", "s").write.mode("overwrite").partitionBy("part").parquet(f"{path}/facts")
        self.names.write.mode("overwrite").parquet(f"{path}/names")
        self.synapses.write.mode("overwrite").parquet(f"{path}/synapses")
        small_rows(self.spark, [(k, r.name or show_rule(r)) for k, r in enumerate(self.rules)], "place int, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/rules")

    @classmethod
    def load(cls, spark: SparkSession, path: str, predicates: list[str] | None = None, nodes: list[str] | None = None, meta_only: bool = False) -> Graph:
        """A saved graph.  With predicates or nodes only their facts are read, by partition and filter, and the graph is read-only."""
        facts = spark.read.parquet(f"{path}/facts")
        if meta_only:
            facts = facts.where(F.lit(False))
        if predicates is not None:
            parts = [r["h"] for r in small_rows(spark, [(p,) for p in predicates], "p string").select(F.pmod(F.xxhash64("p"), F.lit(64)).alias("h")).distinct().collect()]
            facts = facts.where(F.col("part").isin(parts) & F.col("p").isin(predicates))
        if nodes is not None:
            facts = facts.where(F.col("s").isin(nodes) | F.arrays_overlap("objects", F.array(*map(F.lit, nodes))))
        rules = tuple(read(r["text"]) for r in spark.read.schema("place int, text string").parquet(f"{path}/rules").orderBy("place").collect())
        part = predicates is not None or nodes is not None or meta_only
        return cls(spark, facts.select(*COLUMNS), spark.read.parquet(f"{path}/names"), spark.read.parquet(f"{path}/synapses"), rules, read_only=part)

    @staticmethod
    def file_stats(spark: SparkSession, path: str) -> DataFrame:
        """What each file of a saved graph holds: (``file``, ``bytes``, ``facts``, ``predicates``, ``first``, ``last``), subjects from first to last."""
        rows = spark.read.parquet(f"{path}/facts").select("s", "p", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return rows.groupBy("file", "bytes").agg(F.count("*").alias("facts"), F.sort_array(F.collect_set("p")).alias("predicates"), F.min("s").alias("first"), F.max("s").alias("last"))

    def save_sharded(self, path: str) -> None:
        """``save``, and beside it a manifest of the files, from which ``load_routed`` opens only those that it needs."""
        self.save(path)
        self.file_stats(self.spark, path).write.mode("overwrite").parquet(f"{path}/manifest")

    @classmethod
    def load_routed(cls, spark: SparkSession, path: str, subjects: list[str] | None = None, predicates: list[str] | None = None) -> Graph:
        """The facts of some subjects or predicates out of a sharded graph; no other file is opened.  The graph is read-only."""
        files = spark.read.parquet(f"{path}/manifest")
        if predicates is not None:
            files = files.where(F.arrays_overlap("predicates", F.array(*map(F.lit, predicates))))
        if subjects is not None:
            files = files.where(F.exists(F.array(*map(F.lit, subjects)), lambda s: (F.col("first") <= s) & (s <= F.col("last"))))
        chosen = [r["file"] for r in files.select("file").collect()]
        schema = spark.read.parquet(f"{path}/facts").schema
        facts = spark.read.schema(schema).option("basePath", f"{path}/facts").parquet(*chosen) if chosen else small_rows(spark, [], FACTS)
        for column, wanted in (("p", predicates), ("s", subjects)):
            if wanted is not None:
                facts = facts.where(F.col(column).isin(wanted))
        whole = cls.load(spark, path, meta_only=True)
        return replace(whole, facts=facts.select(*COLUMNS))

    def rendered(self, nodes: DataFrame, lang: str = "en", depth: int = 3) -> DataFrame:
        """(``node``, ``text``): nodes as text, by their names in ``lang``, else in English, else in any; facts as what they say, ``depth`` deep.

        ``display`` of the graph, a function of a name's column, has the last word on how a name is shown.
        """
        best = F.min(F.struct(F.when(F.col("lang") == lang, 0).when(F.col("lang") == "en", 1).otherwise(2).alias("r"), "lang", "name"))
        called = self.names.groupBy("node").agg(best.alias("x")).select("node", F.col("x.name").alias("name"))
        parts = self.facts.select(F.col("fact_id").alias("node"), F.posexplode(F.concat(F.array("s", "p"), "objects")).alias("at", "part"))

        def text(wanted: DataFrame, left: int) -> DataFrame:
            plain = wanted.join(called, "node", "left").select("node", F.coalesce("name", "node").alias("text")).select("node", self.display("text").alias("text"))
            if not left:
                return plain
            inside = wanted.where(F.col("node").startswith("f:")).join(parts, "node")
            below = text(inside.select(F.col("part").alias("node")).distinct(), left - 1)
            said = inside.join(below.withColumnRenamed("node", "part"), "part").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("x"))
            said = said.select("node", F.concat(F.lit("("), F.array_join("x.text", " "), F.lit(")")).alias("said"))
            return plain.join(said, "node", "left").select("node", F.coalesce("said", "text").alias("text"))

        return text(nodes.select("node").distinct(), depth)

    def run_script(self, text: str, folders: tuple[str, ...] = (), _seen: frozenset = frozenset()) -> Graph:
        """Statements, one a line; ``#`` outside quotes starts a comment.  Facts and rules are added in turn.

        ``.import name`` runs the script of that name, with or without an
        ending of ``.rules``, in the first of ``folders`` that has it, once;
        ``.auto-run`` infers after every statement that follows, until
        ``.auto-run off``.  Other lines that begin with a dot are left out.
        """
        out, auto = self, False
        for line in text.splitlines():
            line = re.match(r'(?:"[^"]*"|[^"#])*', line)[0].strip()
            if line.startswith(".import "):
                name = line[8:].strip().strip('"')
                found = next((p for f in folders for p in (f"{f}/{name}", f"{f}/{name}.rules") if os.path.isfile(p)), None)
                if found is None:
                    raise FileNotFoundError(f"no script {name} in {', '.join(folders) or 'no folder'}")
                if found not in _seen:
                    _seen |= {found}
                    with open(found, encoding="utf-8") as f:
                        out = out.run_script(f.read(), folders, _seen)
            elif line.startswith(".auto-run"):
                auto = not line.endswith("off")
            elif line and not line.startswith("."):
                out = out.add(line)
                if auto:
                    out = out.infer()[0]
        return out
