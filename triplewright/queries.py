"""Registered queries: each operator over the whole tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from triplewright.catalog import NAMES_SQL, TRIPLES_SQL, names, triples
from triplewright.functions import numbers, symbolic, texts
from triplewright.graph import Graph
from triplewright.operators import paths
from triplewright.plans.patterns import Matcher
from triplewright.plans.sparql import SparqlPlan, predicates as read_by, with_labels
from triplewright.plans.native import Reader
from triplewright.plans.sparql_ast import QueryError, parse
from triplewright.storage import small_rows
from triplewright.terms import fact_key_column, show

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _sql(text: str) -> str:
    """A twin over ``triples`` (and ``names``); text that starts with WITH brings its own parts."""
    recursive = "RECURSIVE " if "@recursive " in text else ""
    text = text.replace("@recursive ", "")
    parts = ([TRIPLES_SQL] if "triples" in text else []) + ([NAMES_SQL] if "names" in text else [])
    if text.startswith("WITH "):
        return f"WITH {recursive}{', '.join([*parts, text[5:]])}"
    return (f"WITH {', '.join(parts)} " if parts else "") + text


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = _sql(sql)


def ask(name: str, text: str, sql: str, s: str | None = None, o: str | None = None) -> None:
    """A SELECT query over the tables' triples; only the tables of predicates that it names are opened, of these the rows of ``s`` or ``o`` where all its triples have them."""
    q = parse(text)
    named = read_by(q)
    register(name, lambda spark, d: SparqlPlan(triples(spark, d, sorted(named) if named is not None else None, s, o)).select(q), sql)


def pattern(name: str, text: str, sql: str, predicates: list[str] | None, columns: list[str], s: str | None = None) -> None:
    """A pattern of the rule language over the tables' facts; only ``columns`` of it."""
    register(name, lambda spark, d: graph(spark, d, predicates, s=s).match(text).select(*columns), sql)


def graph(spark: SparkSession, d: str, predicates: list[str] | None, *text: str, s: str | None = None, o: str | None = None) -> Graph:
    return Graph.empty(spark).insert_triples(triples(spark, d, predicates, s, o, distinct=True), distinct=True).add(*text)


def named(spark: SparkSession, d: str, predicates: list[str] | None) -> Graph:
    return replace(graph(spark, d, predicates), names=names(spark, d))


def rules(name: str, predicates: list[str], text: list[str], sql: str, mode: str = "semi-naive", where: str = "true", select: str = "s, p, objects[0] AS o") -> None:
    """The new facts of an inference over the tables' facts."""
    register(name, lambda spark, d: graph(spark, d, predicates, *text).infer(mode)[1].new.where(where).selectExpr(*[c.strip() for c in select.split(",")]), sql)


def edges(spark: SparkSession, d: str, predicate: str) -> DataFrame:
    return triples(spark, d, [predicate]).select("s", "o")


def _starts(spark: SparkSession, *nodes: str) -> DataFrame:
    return small_rows(spark, [(n,) for n in nodes], "node string")


# Disjointness culprits: suppliers' nations that lie under two things at once, and nothing above them does.
CULPRIT = """
SELECT DISTINCT ?c WHERE {
  ?c within+ region/3 . ?c within+ nation/3 .
  MINUS { ?c within ?up . ?up within+ region/3 . ?up within+ nation/3 }
}""".replace("region/3", '"region/3"').replace("nation/3", '"nation/3"')  # fmt: skip
CULPRIT_SQL = """WITH @recursive a AS (SELECT s AS n FROM triples WHERE p = 'within' AND o = 'region/3' UNION SELECT t.s FROM triples t JOIN a ON t.o = a.n WHERE t.p = 'within'),
b AS (SELECT s AS n FROM triples WHERE p = 'within' AND o = 'nation/3' UNION SELECT t.s FROM triples t JOIN b ON t.o = b.n WHERE t.p = 'within')
SELECT n AS c FROM a WHERE n IN (SELECT n FROM b) AND n NOT IN (SELECT t.s FROM triples t WHERE t.p = 'within' AND t.o IN (SELECT n FROM a) AND t.o IN (SELECT n FROM b))"""


def disjointness(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: two closures intersected, less what lies below others of them."""
    return SparqlPlan(triples(spark, d, ["within"])).run(CULPRIT)


register("q_disjointness_culprits", disjointness, CULPRIT_SQL)

# -- access paths
ask("A01_predicate_scan", "SELECT ?s ?o { ?s located_in ?o }", "SELECT s, o FROM triples WHERE p = 'located_in'")
ask("A02_predicate_variable", 'SELECT ?p ?o { "part/7" ?p ?o }', "SELECT p, o FROM triples WHERE s = 'part/7'", s="part/7")
ask("A03_subject_anchored", 'SELECT ?o { "order/7" contains_part ?o }', "SELECT o FROM triples WHERE s = 'order/7' AND p = 'contains_part'", s="order/7")
ask("A04_object_anchored", 'SELECT ?s { ?s located_in "region/2" }', "SELECT s FROM triples WHERE o = 'region/2' AND p = 'located_in'", o="region/2")


def _seeded(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d, ["located_in", "placed_by"]).withColumn("fact_id", F.lit(""))
    delta = t.where("p = 'located_in' and o = 'nation/4'")
    x = Graph.empty(spark).read("(A placed_by B, B located_in N)")
    return Matcher(t.withColumn("fact_id", fact_key_column(F.col("s"), F.col("p"), F.array("o")))).body(x, (1, delta.withColumn("fact_id", fact_key_column(F.col("s"), F.col("p"), F.array("o"))))).df.select("A", "B", "N")


register("A05_seeded_candidates", _seeded, "SELECT a.s AS \"A\", a.o AS \"B\", b.o AS \"N\" FROM triples a JOIN triples b ON a.o = b.s WHERE a.p = 'placed_by' AND b.p = 'located_in' AND b.o = 'nation/4'")
register("A06_targets", lambda s, d: graph(s, d, ["contains_part"], s="order/3").targets("order/3", "contains_part"), "SELECT DISTINCT o AS node FROM triples WHERE s = 'order/3' AND p = 'contains_part'")
register("A07_sources", lambda s, d: graph(s, d, ["supplies"], o="part/5").sources("supplies", "part/5"), "SELECT DISTINCT s AS node FROM triples WHERE o = 'part/5' AND p = 'supplies'")
register("A08_exists", lambda s, d: small_rows(s, [(graph(s, d, ["peer_of"]).exists("nation/3", "peer_of", "nation/4"), graph(s, d, ["peer_of"]).exists("nation/3", "peer_of", "nation/5"))], "yes boolean, no boolean"),
         "SELECT count(*) FILTER (WHERE o = 'nation/4') > 0 AS yes, count(*) FILTER (WHERE o = 'nation/5') > 0 AS no FROM triples WHERE s = 'nation/3' AND p = 'peer_of'")
register("A09_named_nodes", lambda s, d: replace(Graph.empty(s), names=names(s, d)).first_nodes(20, "en"), "SELECT node, lang, name FROM names WHERE lang = 'en' ORDER BY node LIMIT 20")
register("A10_outgoing", lambda s, d: graph(s, d, None, s="nation/3").outgoing("nation/3"), "SELECT DISTINCT 'subject' AS role, p, o AS other FROM triples WHERE s = 'nation/3' ORDER BY 1, 2, 3 LIMIT 20")
register("A10_incoming", lambda s, d: graph(s, d, None, o="nation/3").incoming("nation/3"), "SELECT DISTINCT 'object' AS role, p, s AS other FROM triples WHERE o = 'nation/3' ORDER BY 1, 2, 3 LIMIT 20")


register("A11_node_detail", lambda s, d: replace(graph(s, d, None, s="customer/7").insert_triples(triples(s, d, None, o="customer/7")), names=names(s, d)).node("customer/7").select("node", "as_subject", "as_object", F.array_join("names", ";").alias("names")),
         "SELECT 'customer/7' AS node, count(*) FILTER (WHERE s = 'customer/7') AS as_subject, count(*) FILTER (WHERE o = 'customer/7') AS as_object, (SELECT string_agg(lang || ':' || name, ';') FROM names WHERE node = 'customer/7') AS names FROM (SELECT DISTINCT s, p, o FROM triples)")
register("A12_resolve_names", lambda s, d: (lambda g: g.labelled(g.triples.select(F.col("s").alias("node"), F.col("o").alias("other"))))(named(s, d, ["peer_of"])),
         "SELECT a.node || ' (' || a.name || ')' AS node, b.node || ' (' || b.name || ')' AS other FROM triples JOIN names a ON a.node = s JOIN names b ON b.node = o WHERE p = 'peer_of'")
register("A13_kept_adjacency", lambda s, d: (lambda g: g.closure("region/1", "located_in", backward=True).unionAll(g.closure("nation/3", "located_in")))(graph(s, d, ["located_in"]).keep_edges("located_in")),
         "WITH @recursive r AS (SELECT s AS n FROM triples WHERE p = 'located_in' AND o = 'region/1' UNION SELECT t.s FROM triples t JOIN r ON t.o = r.n WHERE t.p = 'located_in') SELECT n AS node FROM r UNION ALL SELECT o FROM triples WHERE p = 'located_in' AND s = 'nation/3'")

# -- projection and filters
ask("P01_projection", "SELECT ?o { ?s has_segment ?o }", "SELECT o FROM triples WHERE p = 'has_segment'")
ask("P02_star", "SELECT * { ?b located_in ?a }", "SELECT o AS a, s AS b FROM triples WHERE p = 'located_in'")
for _op, _name in (("=", "eq"), ("!=", "ne"), ("<", "lt"), (">", "gt"), ("<=", "le"), (">=", "ge")):
    ask(f"P03_filter_{_name}", f"SELECT ?x ?n {{ ?x has_size ?n FILTER (?n {_op} 25) }}", f"SELECT s AS x, o AS n FROM triples WHERE p = 'has_size' AND CAST(o AS DOUBLE) {_op.replace('!=', '<>')} 25")
ask("P04_str", 'SELECT ?x { ?x has_brand ?b FILTER (str(?b) = "Brand#13") }', "SELECT s AS x FROM triples WHERE p = 'has_brand' AND o = 'Brand#13'")
ask("P05_lang_is_empty", 'SELECT ?x { ?x in_lang ?l FILTER (lang(?l) = "") }', "SELECT s AS x FROM triples WHERE p = 'in_lang'")
ask("P05_lang_is_no_other", 'SELECT ?x { ?x in_lang ?l FILTER (lang(?l) = "en") }', "SELECT s AS x FROM triples WHERE p = 'in_lang' AND '' = 'en'")
ask("P06_numbers_or_strings", 'SELECT ?x ?b { ?x ?p ?b FILTER (?b < "12") FILTER (?p != within) FILTER (?p != contains_part) }', "SELECT s AS x, o AS b FROM triples WHERE p NOT IN ('within', 'contains_part') AND CASE WHEN regexp_full_match(o, '-?[0-9]+([.][0-9]+)?') THEN TRY_CAST(o AS DOUBLE) < 12 ELSE o < '12' END")
pattern("P07_inequality", "(X located_in R, Y located_in R, X peer_of A, Y peer_of B, X != Y)", "SELECT a.s AS \"X\", b.s AS \"Y\" FROM triples a JOIN triples b ON a.o = b.o AND a.p = 'located_in' AND b.p = 'located_in' JOIN triples c ON c.s = a.s AND c.p = 'peer_of' JOIN triples d ON d.s = b.s AND d.p = 'peer_of' WHERE a.s <> b.s", ["located_in", "peer_of"], ["X", "Y"])
pattern("P08_constants", '("order/5" P O)', "SELECT DISTINCT p AS \"P\", o AS \"O\" FROM triples WHERE s = 'order/5'", None, ["P", "O"], s="order/5")
register("P09_repeated_variable", lambda s, d: Graph.empty(s).insert_triples(triples(s, d, ["peer_of"]).selectExpr("s", "'likes' AS p", "CASE WHEN s < 'nation/2' THEN s ELSE o END AS o")).match("X likes X"), "SELECT s AS \"X\" FROM triples WHERE p = 'peer_of' AND s < 'nation/2'")
register("P10_labels", lambda s, d: with_labels(SparqlPlan(triples(s, d, ["located_in"])).run('SELECT ?n ?r { ?n located_in ?r . ?r1 located_in "region/0" FILTER (str(?n) = str(?r1)) }'), names(s, d)),
         "SELECT s || ' (' || a.name || ')' AS n, o || ' (' || b.name || ')' AS r FROM triples JOIN names a ON a.node = s JOIN names b ON b.node = o WHERE p = 'located_in' AND o = 'region/0'")

# -- joins
ask("J01_natural_join", "SELECT ?o ?c ?n { ?o placed_by ?c . ?c located_in ?n }", "SELECT a.s AS o, a.o AS c, b.o AS n FROM triples a JOIN triples b ON a.o = b.s WHERE a.p = 'placed_by' AND b.p = 'located_in'")
ask("J02_product", 'SELECT ?a ?b { ?a located_in "region/0" . ?b located_in "region/1" }', "SELECT a.s AS a, b.s AS b FROM triples a CROSS JOIN triples b WHERE a.p = 'located_in' AND a.o = 'region/0' AND b.p = 'located_in' AND b.o = 'region/1'")
ask("J03_unbound_join", 'SELECT ?x ?q ?y { ?x from_source "src3" OPTIONAL { ?x has_quality ?q } { SELECT DISTINCT ?q { ?y has_quality ?q } } }',
    "WITH a AS (SELECT t.s AS x, q.o AS q FROM triples t LEFT JOIN triples q ON q.s = t.s AND q.p = 'has_quality' WHERE t.p = 'from_source' AND t.o = 'src3'), b AS (SELECT DISTINCT o AS q FROM triples WHERE p = 'has_quality') SELECT a.x, coalesce(a.q, b.q) AS q, CAST(NULL AS VARCHAR) AS y FROM a JOIN b ON a.q = b.q OR a.q IS NULL")
ask("J04_left_outer", "SELECT ?x ?q { ?x in_lang ?l OPTIONAL { ?x has_quality ?q } }", "SELECT a.s AS x, b.o AS q FROM triples a LEFT JOIN triples b ON a.s = b.s AND b.p = 'has_quality' WHERE a.p = 'in_lang'")
ask("J05_anti", "SELECT ?x { ?x in_lang ?l MINUS { ?x has_quality ?q } }", "SELECT s AS x FROM triples WHERE p = 'in_lang' AND s NOT IN (SELECT s FROM triples WHERE p = 'has_quality')")
ask("J06_semi", 'SELECT ?c { ?c located_in ?n . "nation/3" located_in "region/3" . ?n located_in+ "region/3" }', "SELECT a.s AS c FROM triples a JOIN triples b ON a.o = b.s AND b.p = 'located_in' AND b.o = 'region/3' WHERE a.p = 'located_in' AND EXISTS (SELECT 1 FROM triples WHERE s = 'nation/3' AND p = 'located_in' AND o = 'region/3')")
ask("J07_block_of_five", "SELECT ?o ?s ?r { ?o placed_by ?c ; filled_by ?s . ?c located_in ?n . ?s located_in ?n . ?n located_in ?r }",
    "WITH f AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT 'order/' || o_orderkey AS o, 'supplier/' || l_suppkey AS s, 'region/' || n_regionkey AS r FROM orders JOIN f ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey")
pattern("J08_body_join", "(O placed_by C, C has_segment M, O has_priority U)", "SELECT a.s AS \"O\", b.o AS \"M\", c.o AS \"U\" FROM triples a JOIN triples b ON b.s = a.o AND b.p = 'has_segment' JOIN triples c ON c.s = a.s AND c.p = 'has_priority' WHERE a.p = 'placed_by'", ["placed_by", "has_segment", "has_priority"], ["O", "M", "U"])
ask("J09_theta", "SELECT ?a ?b { ?a located_in ?r . ?b located_in ?r . ?a peer_of ?x . ?b peer_of ?y FILTER (str(?a) < str(?b)) }", "SELECT a.s AS a, b.s AS b FROM triples a JOIN triples b ON a.o = b.o AND b.p = 'located_in' WHERE a.p = 'located_in' AND a.s < b.s AND a.s LIKE 'nation/%' AND b.s LIKE 'nation/%'")
register("J10_nested", lambda s, d: graph(s, d, ["located_in", "peer_of"]).insert(_stated(s, d)).match("((A located_in B) stated_by C)"), "SELECT s AS \"A\", o AS \"B\", 'atlas' AS \"C\" FROM triples WHERE p = 'located_in' AND s LIKE 'nation/%'")


def _stated(s: SparkSession, d: str) -> DataFrame:
    """Statements about the nations' places."""
    t = triples(s, d, ["located_in"]).where("s like 'nation/%'")
    inner = fact_key_column(F.col("s"), F.col("p"), F.array("o"))
    outer = t.select(inner.alias("s"), F.lit("stated_by").alias("p"), F.array(F.lit("atlas")).alias("objects"))
    return outer.select(fact_key_column(F.col("s"), F.col("p"), F.col("objects")).alias("fact_id"), "s", "p", "objects", F.lit(1.0).alias("prob"), F.lit(False).alias("derived"), F.lit(0).alias("iter"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("array<string>").alias("premises"))


def _baskets(s: SparkSession, d: str) -> Graph:
    """Orders as facts of several objects: their parts."""
    b = triples(s, d, ["contains_part"]).groupBy("s").agg(F.sort_array(F.collect_set("o")).alias("objects")).select("s", F.lit("holds").alias("p"), "objects")
    return Graph.empty(s).insert(b.select(fact_key_column(F.col("s"), F.col("p"), F.col("objects")).alias("fact_id"), "s", "p", "objects", F.lit(1.0).alias("prob"), F.lit(False).alias("derived"), F.lit(0).alias("iter"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("array<string>").alias("premises")))


register("J11_different_objects", lambda s, d: _baskets(s, d).match('(O holds "part/5" X)').select("O", "X"), "SELECT a.s AS \"O\", b.o AS \"X\" FROM triples a JOIN triples b ON a.s = b.s AND a.p = 'contains_part' AND b.p = 'contains_part' WHERE a.o = 'part/5' AND b.o <> 'part/5'")
register("J12_ground_probe", lambda s, d: graph(s, d, ["located_in"]).insert(_stated(s, d)).match('(("nation/3" located_in "region/3") stated_by C)'), "SELECT 'atlas' AS \"C\" FROM triples WHERE s = 'nation/3' AND p = 'located_in' AND o = 'region/3'")

# -- paths
_REACH = "WITH @recursive r AS (SELECT {there} AS n FROM triples WHERE p = '{p}' AND {here} = '{start}' UNION SELECT t.{there} FROM triples t JOIN r ON t.{here} = r.n WHERE t.p = '{p}') "
ask("C01_forward", 'SELECT ?n { "order/7" within+ ?n }', _REACH.format(there="o", here="s", p="within", start="order/7") + "SELECT n FROM r")
ask("C02_backward", 'SELECT ?n { ?n within+ "region/1" }', _REACH.format(there="s", here="o", p="within", start="region/1") + "SELECT n FROM r")
ask("C03_reflexive", 'SELECT ?n { ?n located_in* "region/1" }', _REACH.format(there="s", here="o", p="located_in", start="region/1") + "SELECT n FROM r UNION SELECT 'region/1'")
ask("C04_cycle", 'SELECT ?n { "nation/3" peer_of+ ?n }', _REACH.format(there="o", here="s", p="peer_of", start="nation/3") + "SELECT n FROM r")
ask("C05_intersection", 'SELECT ?x { ?x located_in+ "region/3" . ?x located_in+ "nation/3" }', _REACH.format(there="s", here="o", p="located_in", start="region/3") + ", q AS (SELECT s AS n FROM triples WHERE p = 'located_in' AND o = 'nation/3' UNION SELECT t.s FROM triples t JOIN q ON t.o = q.n WHERE t.p = 'located_in') SELECT n AS x FROM r WHERE n IN (SELECT n FROM q)")
_PAIRS = "WITH @recursive r AS (SELECT s AS a, o AS b FROM triples WHERE p = '{p}'{more} UNION SELECT r.a, t.o FROM r JOIN triples t ON t.s = r.b WHERE t.p = '{p}') "
ask("C06_from_each_bound", 'SELECT ?c ?x { ?c has_segment "BUILDING" . ?c located_in+ ?x }', _PAIRS.format(p="located_in", more="") + "SELECT a AS c, b AS x FROM r JOIN triples t ON t.s = r.a AND t.p = 'has_segment' AND t.o = 'BUILDING'")
ask("C07_all_pairs", "SELECT ?a ?b { ?a next_turn+ ?b }", _PAIRS.format(p="next_turn", more="") + "SELECT a, b FROM r")
ask("C09_sequence", "SELECT ?o ?r { ?o placed_by/located_in/located_in ?r }", "SELECT a.s AS o, c.o AS r FROM triples a JOIN triples b ON a.o = b.s AND b.p = 'located_in' JOIN triples c ON b.o = c.s AND c.p = 'located_in' WHERE a.p = 'placed_by'")
ask("C09_sequence_with_closure", "SELECT ?o ?r { ?o has_status P . ?o placed_by/located_in+ ?r }", _PAIRS.format(p="located_in", more="") + "SELECT a.s AS o, r.b AS r FROM triples a JOIN triples h ON h.s = a.s AND h.p = 'has_status' AND h.o = 'P' JOIN r ON r.a = a.o WHERE a.p = 'placed_by'")
ask("C10_bound_end_first", 'SELECT ?a ?c { ?a located_in+ ?c . ?a located_in "nation/3" }', _PAIRS.format(p="located_in", more="") + "SELECT r.a AS a, r.b AS c FROM r JOIN triples t ON t.s = r.a AND t.p = 'located_in' AND t.o = 'nation/3'")
register("C12_closure_api", lambda s, d: paths.reach(edges(s, d, "next_turn"), _starts(s, "turn/3/0", "turn/4/0"), reflexive=True), "WITH @recursive r AS (SELECT 'turn/3/0' AS node UNION SELECT 'turn/4/0' UNION SELECT t.o FROM triples t JOIN r ON t.s = r.node WHERE t.p = 'next_turn') SELECT node FROM r")

# -- aggregation
ask("G01_group", "SELECT ?r (COUNT(?n) AS ?k) { ?n located_in ?r } GROUP BY ?r", "SELECT o AS r, count(*) AS k FROM triples WHERE p = 'located_in' GROUP BY o")
ask("G02_count_rows", "SELECT ?l (COUNT(?q) AS ?k) { ?x in_lang ?l OPTIONAL { ?x has_quality ?q } } GROUP BY ?l", "SELECT o AS l, count(*) AS k FROM triples WHERE p = 'in_lang' GROUP BY o")
ask("G03_count_distinct", "SELECT ?s (COUNT(DISTINCT ?b) AS ?k) { ?s supplies ?x . ?x has_brand ?b } GROUP BY ?s", "SELECT a.s, count(DISTINCT b.o) AS k FROM triples a JOIN triples b ON a.o = b.s AND b.p = 'has_brand' WHERE a.p = 'supplies' GROUP BY a.s")
ask("G04_global", "SELECT (COUNT(?x) AS ?k) { ?x no_such ?y }", "SELECT CAST(0 AS BIGINT) AS k")
ask("G04_global_rows", "SELECT (COUNT(?x) AS ?k) { ?x has_size ?y FILTER (?y > 25) }", "SELECT count(*) AS k FROM triples WHERE p = 'has_size' AND CAST(o AS DOUBLE) > 25")
ask("G05_unbound_key", "SELECT ?q (COUNT(?x) AS ?k) { ?x in_lang ?l OPTIONAL { ?x has_quality ?q } } GROUP BY ?q", "SELECT b.o AS q, count(*) AS k FROM triples a LEFT JOIN triples b ON a.s = b.s AND b.p = 'has_quality' WHERE a.p = 'in_lang' GROUP BY b.o")
ask("G06_least_of_group", "SELECT ?r ?n (COUNT(?n) AS ?k) { ?n located_in ?r } GROUP BY ?r", "SELECT o AS r, min(s) AS n, count(*) AS k FROM triples WHERE p = 'located_in' GROUP BY o")
ask("G07_several_counts", "SELECT ?b (COUNT(?p) AS ?k) (COUNT(DISTINCT ?t) AS ?m) { ?p has_brand ?b ; has_type ?t } GROUP BY ?b", "SELECT a.o AS b, count(*) AS k, count(DISTINCT b.o) AS m FROM triples a JOIN triples b ON a.s = b.s AND b.p = 'has_type' WHERE a.p = 'has_brand' GROUP BY a.o")
register("G08_predicate_usage", lambda s, d: graph(s, d, None).predicate_usage(), "SELECT p, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM triples) GROUP BY p")
register("G09_value_usage", lambda s, d: graph(s, d, ["event_type"]).value_usage("event_type"), "SELECT o, count(*) AS n FROM triples WHERE p = 'event_type' GROUP BY o")
register("G10_statistics", lambda s, d: named(s, d, ["located_in"]).add("(A located_in B) => (B contains A)").statistics().where("what <> 'nodes'").unionAll(graph(s, d, ["located_in"]).nodes().where("kind = 'atom'").agg(F.lit("atoms").alias("what"), F.count("*").alias("n"))),
         "SELECT 'facts' AS what, count(*) AS n FROM triples WHERE p = 'located_in' UNION ALL SELECT 'rules', 1 UNION ALL SELECT 'names en', count(*) FROM names UNION ALL SELECT 'atoms', count(*) FROM (SELECT s FROM triples WHERE p = 'located_in' UNION SELECT o FROM triples WHERE p = 'located_in' UNION SELECT 'located_in')")

# -- order, limit, distinct, union
ask("O01_order", "SELECT ?x ?n { ?x has_size ?n } ORDER BY ?n", "SELECT s AS x, o AS n FROM triples WHERE p = 'has_size'")
ask("O02_limit", "SELECT ?s { ?s peer_of ?o } ORDER BY ?s LIMIT 7", "SELECT s FROM triples WHERE p = 'peer_of' ORDER BY s LIMIT 7")
ask("O02_limit_without_order", "SELECT (COUNT(?s) AS ?k) { { SELECT ?s { ?s has_size ?o } LIMIT 7 } }", "SELECT count(*) AS k FROM (SELECT s FROM triples WHERE p = 'has_size' LIMIT 7)")
ask("O03_top_k", "SELECT DISTINCT ?n { ?x has_size ?n } ORDER BY DESC(?n) LIMIT 5", "SELECT DISTINCT o AS n FROM triples WHERE p = 'has_size' ORDER BY CAST(o AS DOUBLE) DESC LIMIT 5")
ask("O04_distinct", "SELECT DISTINCT ?o { ?s has_type ?o } ORDER BY ?o", "SELECT DISTINCT o FROM triples WHERE p = 'has_type'")
ask("U01_union", 'SELECT ?x { { ?x located_in "nation/3" } UNION { ?x located_in ?n . ?n located_in "region/1" } }', "SELECT s AS x FROM triples WHERE p = 'located_in' AND o = 'nation/3' UNION ALL SELECT a.s FROM triples a JOIN triples b ON a.o = b.s AND b.p = 'located_in' AND b.o = 'region/1' WHERE a.p = 'located_in'")
ask("U02_difference", "SELECT DISTINCT ?p { ?s supplies ?p MINUS { ?p has_size ?n FILTER (?n > 10) } }", "SELECT DISTINCT o AS p FROM triples WHERE p = 'supplies' AND o NOT IN (SELECT s FROM triples WHERE p = 'has_size' AND CAST(o AS DOUBLE) > 10)")
ask("U03_intersection", "SELECT DISTINCT ?x { ?x has_segment BUILDING . ?o placed_by ?x }", "SELECT DISTINCT s AS x FROM triples WHERE p = 'has_segment' AND o = 'BUILDING' AND s IN (SELECT o FROM triples WHERE p = 'placed_by')")
register("U04_members", lambda s, d: _members(s, d), "SELECT a.s AS \"X\", a.o AS \"R\" FROM triples a WHERE a.p = 'located_in' AND a.o IN ('region/1', 'region/2')")


def _members(s: SparkSession, d: str) -> DataFrame:
    chosen = Graph.set("region/1", "region/2")
    g = graph(s, d, ["located_in"]).insert(Graph.empty(s).rows([(Graph.empty(s).read("some west ,w", w=chosen), 1.0)]))
    return g.match("(some west S, R in S, X located_in R)").select("X", "R")


# -- composition
ask("Q01_nested_group", 'SELECT ?c { ?c has_segment MACHINERY { ?c located_in ?n . ?n located_in "region/0" } }', "SELECT a.s AS c FROM triples a JOIN triples b ON a.s = b.s AND b.p = 'located_in' JOIN triples r ON r.s = b.o AND r.p = 'located_in' AND r.o = 'region/0' WHERE a.p = 'has_segment' AND a.o = 'MACHINERY'")
ask("Q02_subquery", "SELECT ?c ?k { { SELECT ?c (COUNT(?o) AS ?k) { ?o placed_by ?c } GROUP BY ?c } ?c has_segment BUILDING }", "SELECT t.o AS c, count(*) AS k FROM triples t WHERE t.p = 'placed_by' AND t.o IN (SELECT s FROM triples WHERE p = 'has_segment' AND o = 'BUILDING') GROUP BY t.o")
ask("Q03_lists", "SELECT ?o { ?o has_status F ; has_priority ?u ; contains_part ?x, ?y . ?x has_brand \"Brand#11\" . ?y has_brand \"Brand#12\" }", "WITH c AS (SELECT DISTINCT l_orderkey, l_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT 'order/' || o_orderkey AS o FROM orders JOIN c x ON x.l_orderkey = o_orderkey AND x.p_brand = 'Brand#11' JOIN c y ON y.l_orderkey = o_orderkey AND y.p_brand = 'Brand#12' WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL")
ask("Q04_predicate_variable", 'SELECT ?p ?k { { SELECT ?p (COUNT(?s) AS ?k) { ?s ?p ?o } GROUP BY ?p } }', "SELECT p, count(*) AS k FROM triples GROUP BY p")
ask("Q05_textual_order", "SELECT ?x ?q { ?x in_lang fr FILTER (?q = \"\") OPTIONAL { ?x has_quality ?q } }", "SELECT a.s AS x, b.o AS q FROM triples a LEFT JOIN triples b ON a.s = b.s AND b.p = 'has_quality' WHERE a.p = 'in_lang' AND a.o = 'fr'")
pattern("Q09_native", '(X located_in "region/3")', "SELECT s AS \"X\" FROM triples WHERE p = 'located_in' AND o = 'region/3'", ["located_in"], ["X"])
pattern("Q10_native_conjunction", '(C located_in N, N located_in "region/3", C has_segment S)', "SELECT a.s AS \"C\", a.o AS \"N\", c.o AS \"S\" FROM triples a JOIN triples b ON b.s = a.o AND b.p = 'located_in' AND b.o = 'region/3' JOIN triples c ON c.s = a.s AND c.p = 'has_segment' WHERE a.p = 'located_in'", ["located_in", "has_segment"], ["C", "N", "S"])
register("Q11_programmatic", lambda s, d: graph(s, d, ["supplies", "has_size"]).query('(S supplies P, P has_size "1")').select("S", "P"), "SELECT DISTINCT 'supplier/' || l_suppkey AS \"S\", 'part/' || l_partkey AS \"P\" FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1")

# -- rules
rules("R01_single", ["located_in"], ["(A located_in B) => (B contains A)"], "SELECT o AS s, 'contains' AS p, s AS o FROM triples WHERE p = 'located_in'")
rules("R02_conjunction", ["placed_by", "located_in"], ["(O placed_by C, C located_in N) => (O ordered_from N)"], "SELECT a.s, 'ordered_from' AS p, b.o FROM triples a JOIN triples b ON a.o = b.s AND b.p = 'located_in' WHERE a.p = 'placed_by'")
rules("R03_several_heads", ["peer_of"], ["(A peer_of B) => (A near B, B near A)"], "SELECT s, 'near' AS p, o FROM triples WHERE p = 'peer_of' UNION SELECT o, 'near', s FROM triples WHERE p = 'peer_of'")
rules("R04_transitive", ["located_in"], ["(R is transitive, A R B, B R C) => (A R C)", "located_in is transitive"], "SELECT a.s, 'located_in' AS p, b.o FROM triples a JOIN triples b ON a.o = b.s AND b.p = 'located_in' WHERE a.p = 'located_in'")
rules("R04_cycle", ["peer_of"], ["(R is transitive, A R B, B R C) => (A R C)", "peer_of is transitive"], "SELECT 'nation/' || a.n_nationkey AS s, 'peer_of' AS p, 'nation/' || b.n_nationkey AS o FROM nation a CROSS JOIN nation b WHERE b.n_nationkey <> (a.n_nationkey + 1) % 25")
rules("R05_nested_head", ["located_in"], ['(A located_in B) => ((A under B) known "yes")'], "SELECT s, 'under' AS p, o FROM triples WHERE p = 'located_in'", where="p = 'under'")
rules("R06_negation", ["in_lang", "has_quality"], ["(A in_lang L, ¬(A has_quality Q)) => (A lacks quality)"], "SELECT s, 'lacks' AS p, 'quality' AS o FROM triples WHERE p = 'in_lang' AND s NOT IN (SELECT s FROM triples WHERE p = 'has_quality')")
rules("R07_negated_subject", ["has_quality"], ["m marker k", "(M marker K, ¬(X has_quality 0)) => (X unflagged K)"], "SELECT s, 'unflagged' AS p, 'k' AS o FROM triples WHERE p = 'has_quality' AND o <> '0'")
rules("R08_inequality", ["located_in", "peer_of"], ["(A located_in R, B located_in R, A peer_of X, B peer_of Y, A != B) => (A neighbour B)"], "SELECT a.s, 'neighbour' AS p, b.s AS o FROM triples a JOIN triples b ON a.o = b.o AND a.s <> b.s WHERE a.p = 'located_in' AND b.p = 'located_in' AND a.s LIKE 'nation/%' AND b.s LIKE 'nation/%'")
rules("R09_strata", ["located_in"], ["(A located_in B) => (B used B)", "(B used B) => (B inner B)", "(A located_in B, ¬(A used A)) => (A leaf A)", "(A leaf A) => (A done A)"], "WITH used AS (SELECT DISTINCT o AS n FROM triples WHERE p = 'located_in'), leaf AS (SELECT s AS n FROM triples WHERE p = 'located_in' AND s NOT IN (SELECT n FROM used)) SELECT n AS s, 'used' AS p, n AS o FROM used UNION ALL SELECT n, 'inner', n FROM used UNION ALL SELECT n, 'leaf', n FROM leaf UNION ALL SELECT n, 'done', n FROM leaf")
for _mode in ("semi-naive", "naive", "check"):
    rules(f"R10_chains_{_mode.replace('-', '_')}", ["next_turn"], ["(A next_turn B) => (A before B)", "(A before B, B next_turn C) => (A before C)"], _PAIRS.format(p="next_turn", more="") + "SELECT a AS s, 'before' AS p, b AS o FROM r", mode=_mode)
rules("R11_single_pass", ["next_turn"], ["(A next_turn B) => (A before B)", "(A before B, B next_turn C) => (A before C)"], "SELECT s, 'before' AS p, o FROM triples WHERE p = 'next_turn'", mode="once")
rules("R12_new_nodes", ["located_in"], ["(A located_in B) => (X office_in B)"], "SELECT DISTINCT 'office_in' AS p, o FROM triples WHERE p = 'located_in'", select="p, objects[0] AS o")
register("R13_contradictions", lambda s, d: graph(s, d, ["located_in", "peer_of"], "(A peer_of B, A located_in R, B located_in Q) => !").infer()[1].contradictions.select(F.array_join("bindings", ";").alias("bindings")), "SELECT 'A=' || c.s || ';B=' || c.o || ';Q=' || b.o || ';R=' || a.o AS bindings FROM triples c JOIN triples a ON a.s = c.s AND a.p = 'located_in' JOIN triples b ON b.s = c.o AND b.p = 'located_in' WHERE c.p = 'peer_of'")
register("R14_against_known_wrong", lambda s, d: graph(s, d, ["peer_of"], "(A peer_of B) => (B after A)").insert_triples(triples(s, d, ["peer_of"]).selectExpr("o AS s", "'after' AS p", "s AS o").where("o < 'nation/2'"), 0.0).infer()[1].contradictions.select(F.explode("premises").alias("premise")).select(F.length("premise").alias("n")),
         "SELECT CAST(66 AS INTEGER) AS n FROM triples WHERE p = 'peer_of' AND s < 'nation/2'")
rules("R15_head_guards", ["has_segment"], ["(A has_segment B) => (A B B)", "(A has_segment B) => (A kept B)"], "SELECT s, 'kept' AS p, o FROM triples WHERE p = 'has_segment'")
rules("R16_proofs", ["located_in"], ["(A located_in B, B located_in C) => (A inside C)"], "SELECT a.s, b.o, CAST(2 AS INTEGER) AS premises FROM triples a JOIN triples b ON a.o = b.s AND b.p = 'located_in' WHERE a.p = 'located_in'", select="s, objects[0] AS o, size(premises) AS premises")
rules("R17_alternatives", ["located_in"], ['(A located_in "region/0") => (A in west)', '(A located_in "region/1") => (A in west)'], "SELECT s, 'in' AS p, 'west' AS o FROM triples WHERE p = 'located_in' AND o IN ('region/0', 'region/1')")


def _networked(s: SparkSession, d: str) -> DataFrame:
    t = triples(s, d, ["has_size"])
    scores = t.select("s", "o", (F.col("o").cast("double") / 50).alias("score"))
    return graph(s, d, ["has_size"], "(P has_size N, ≈large(P has_size N)) => (P is large)").infer(networks={"large": scores})[1].new.select("s", F.round("prob", 6).alias("prob"))


register("R23_network_condition", _networked, "SELECT s, round(least(CAST(o AS DOUBLE) / 50, 1.0), 6) AS prob FROM triples WHERE p = 'has_size' AND CAST(o AS DOUBLE) / 50 > 0.5")

# -- functions
_PART = lambda s, d: s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("a"), F.col("p_size").cast("string").alias("b"))
register("F01_lists", lambda s, d: triples(s, d, ["contains_part"]).groupBy("s").agg(F.sort_array(F.collect_list("o")).alias("l")).select("s", F.element_at("l", 1).alias("car"), F.size(F.slice("l", 2, 1000000)).cast("long").alias("cdr_size")), "SELECT s, min(o) AS car, count(*) - 1 AS cdr_size FROM triples WHERE p = 'contains_part' GROUP BY s")
register("F02_compact_list", lambda s, d: _PART(s, d).select("a", F.array_join(numbers.compact_list(F.col("a")), " ").alias("l")), "SELECT CAST(p_partkey AS VARCHAR) AS a, array_to_string(list_reverse(string_split(CAST(p_partkey AS VARCHAR), '')), ' ') AS l FROM part")
register("F03_sets", lambda s, d: triples(s, d, ["supplies"]).groupBy("s").agg(F.array_distinct(F.collect_list("o")).alias("x")).select("s", F.array_contains("x", "part/5").alias("has")), "SELECT s, bool_or(o = 'part/5') AS has FROM triples WHERE p = 'supplies' GROUP BY s")
for _name, _fn, _expr in (("F04_add", numbers.add, "p_partkey + p_size"), ("F05_subtract", numbers.subtract, "CASE WHEN p_partkey >= p_size THEN p_partkey - p_size END"), ("F06_multiply", numbers.multiply, "p_partkey * p_size"), ("F07_divide", numbers.divide, "CASE WHEN p_size <> 0 THEN p_partkey // p_size END"), ("F07_modulo", numbers.modulo, "CASE WHEN p_size <> 0 THEN p_partkey % p_size END")):
    register(_name, lambda s, d, f=_fn: _PART(s, d).select("a", "b", f(F.col("a"), F.col("b")).alias("r")), f"SELECT CAST(p_partkey AS VARCHAR) AS a, CAST(p_size AS VARCHAR) AS b, CAST({_expr} AS VARCHAR) AS r FROM part")
    register(_name + "_any_length", lambda s, d, f=_fn: _PART(s, d).select("a", "b", f(F.col("a"), F.col("b"), True).alias("r")), f"SELECT CAST(p_partkey AS VARCHAR) AS a, CAST(p_size AS VARCHAR) AS b, CAST({_expr} AS VARCHAR) AS r FROM part")
register("F08_compare", lambda s, d: _PART(s, d).select("a", "b", numbers.compare(F.concat(F.lit("00"), "a"), F.col("b")).alias("r")), "SELECT CAST(p_partkey AS VARCHAR) AS a, CAST(p_size AS VARCHAR) AS b, CASE WHEN p_partkey < p_size THEN '<' WHEN p_partkey > p_size THEN '>' ELSE '==' END AS r FROM part")
register("F09_canonical", lambda s, d: _PART(s, d).select("a", numbers.canonical(F.concat(F.lit("000"), "a")).alias("r")), "SELECT CAST(p_partkey AS VARCHAR) AS a, CAST(p_partkey AS VARCHAR) AS r FROM part")
register("F10_base_two", lambda s, d: _PART(s, d).select("a", numbers.to_base(F.col("a"), 2).alias("r")), "SELECT CAST(p_partkey AS VARCHAR) AS a, to_base(p_partkey, 2) AS r FROM part")
register("F11_primality", lambda s, d: _PART(s, d).select("a", numbers.primality(F.col("a")).alias("verdict"), numbers.smallest_divisor(F.col("a")).alias("divisor")), "SELECT CAST(p_partkey AS VARCHAR) AS a, CASE WHEN p_partkey < 2 THEN NULL WHEN d IS NULL THEN 'prime' ELSE 'composite' END AS verdict, d AS divisor FROM (SELECT p_partkey, (SELECT min(i) FROM range(2, 500) t(i) WHERE p_partkey % i = 0 AND i < p_partkey) AS d FROM part)")
register("F15_successor", lambda s, d: _PART(s, d).select("a", numbers.successor(F.col("a")).alias("r")), "SELECT CAST(p_partkey AS VARCHAR) AS a, CAST(p_partkey + 1 AS VARCHAR) AS r FROM part")

# -- changes
_SPO = "s, p, o FROM triples WHERE "
register("D01_insert_twice", lambda s, d: (lambda g: g.insert_triples(triples(s, d, ["located_in"])).triples.select("s", "p", "o"))(graph(s, d, ["located_in", "peer_of"])), f"SELECT {_SPO}p IN ('located_in', 'peer_of')")
register("D02_append", lambda s, d: (lambda g: g.insert(graph(s, d, ["peer_of"]).facts, trusted=True).triples.select("s", "p", "o"))(graph(s, d, ["located_in"])), f"SELECT {_SPO}p IN ('located_in', 'peer_of')")
register("D03_prune_facts", lambda s, d: graph(s, d, ["located_in", "peer_of"]).prune_facts('X located_in "region/1"').triples.select("s", "p", "o"), f"SELECT {_SPO}p IN ('located_in', 'peer_of') AND NOT (p = 'located_in' AND o = 'region/1')")
register("D04_prune_nodes", lambda s, d: graph(s, d, ["located_in", "peer_of"]).prune_nodes('X located_in "region/1"').triples.select("s", "p", "o"), f"SELECT {_SPO}p IN ('located_in', 'peer_of') AND s NOT IN (SELECT s FROM triples WHERE p = 'located_in' AND o = 'region/1') AND o NOT IN (SELECT s FROM triples WHERE p = 'located_in' AND o = 'region/1')")
register("D05_cleanup_names", lambda s, d: named(s, d, ["peer_of"]).cleanup().names, "SELECT node, lang, name FROM names WHERE node IN (SELECT s FROM triples WHERE p = 'peer_of')")


register("D06_remove_node", lambda s, d: graph(s, d, ["located_in", "peer_of"]).remove_node("nation/3").triples.select("s", "p", "o"), f"SELECT {_SPO}p IN ('located_in', 'peer_of') AND s <> 'nation/3' AND o <> 'nation/3'")
register("D07_drop_cluster", lambda s, d: graph(s, d, ["peer_of"]).use_cluster("work").insert_triples(triples(s, d, ["peer_of", "located_in"])).drop_cluster("work").triples.select("s", "p", "o"), f"SELECT {_SPO}p = 'peer_of'")
register("D07_clusters", lambda s, d: graph(s, d, ["peer_of"]).use_cluster("work").insert_triples(triples(s, d, ["peer_of", "located_in"])).clusters(), "SELECT 'work' AS cluster, count(*) AS n FROM triples WHERE p = 'located_in'")
register("D08_set_name", lambda s, d: named(s, d, ["peer_of"]).set_name("nation/3", "Third", "en").names, "SELECT node, lang, CASE WHEN node = 'nation/3' THEN 'Third' ELSE name END AS name FROM names")
register("D09_merge_nodes", lambda s, d: graph(s, d, ["located_in"]).merge_nodes("region/1", "region/2").triples.select("s", "p", "o"), "SELECT s, p, CASE WHEN o = 'region/1' THEN 'region/2' ELSE o END AS o FROM triples WHERE p = 'located_in'")
register("T02_import_again", lambda s, d: (lambda g: g.insert_triples(triples(s, d, ["has_segment"])).predicate_usage())(graph(s, d, ["has_segment"])), "SELECT p, count(*) AS n FROM triples WHERE p = 'has_segment' GROUP BY p")

# -- files, networks, streams
def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    from triplewright.storage import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _csv_again(spark: SparkSession, d: str) -> DataFrame:
    from triplewright.sources.tables import csv_triples

    path = _folder(spark, "csv")
    triples(spark, d, ["has_type", "located_in"]).write.csv(path, header=True)
    return csv_triples(spark, path)


def _json_again(spark: SparkSession, d: str) -> DataFrame:
    from triplewright.sources.tables import write_json

    path = _folder(spark, "json")
    write_json(SparqlPlan(triples(spark, d, ["has_size"])).run("SELECT ?x ?n { ?x has_size ?n FILTER (?n > 40) }"), path)
    return spark.read.schema("x string, n string").json(path)


def _snapshot(spark: SparkSession, d: str, **part) -> DataFrame:
    path = _folder(spark, "graph")
    graph(spark, d, ["located_in", "peer_of", "has_type"]).save(path)
    return Graph.load(spark, path, **part).triples.select("s", "p", "o")


def _entity_dump(spark: SparkSession, d: str) -> DataFrame:
    """Nations as entities of a dump, written and imported again."""
    from triplewright.sources.entities import direct, entities

    path = _folder(spark, "dump")
    line = "concat('{\"id\":\"N', n_nationkey, '\",\"type\":\"item\",\"labels\":{},\"claims\":{\"P1\":[{\"mainsnak\":{\"snaktype\":\"value\",\"property\":\"P1\",\"datavalue\":{\"value\":{\"id\":\"R', n_regionkey, '\"},\"type\":\"x\"}},\"id\":\"c\",\"rank\":\"normal\"}]}},')"
    spark.read.parquet(f"{d}/nation.parquet").selectExpr(f"{line} AS value").write.text(path, compression="bzip2")
    return direct(entities(spark, path))


def _log(spark: SparkSession, d: str) -> DataFrame:
    from triplewright.sources.reports import deductions, decode, encode

    g, _ = graph(spark, d, ["peer_of"], "(A peer_of B) => (B after A)").infer()
    return decode(*encode(deductions(g)))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    from triplewright.sources.reports import pages

    return pages(graph(spark, d, ["peer_of"]))


def _forward(spark: SparkSession, d: str) -> DataFrame:
    """Parts' sizes, less 25, through the synapses from parts to suppliers and on to nations."""
    from triplewright.operators.neural import forward

    inputs = triples(spark, d, ["has_size"]).select(F.lit(0).alias("sample"), F.col("s").alias("node"), (F.col("o").cast("double") - 25).alias("value"))
    first = triples(spark, d, ["supplies"]).select(F.col("o").alias("src"), F.col("s").alias("dst"), F.lit(1.0).alias("w"))
    second = triples(spark, d, ["located_in"]).where("s like 'supplier/%'").select(F.col("s").alias("src"), F.col("o").alias("dst"), F.lit(2.0).alias("w"))
    layers = [first.select(F.col("dst").alias("node")).distinct(), second.select(F.col("dst").alias("node")).distinct()]
    return forward(first.unionAll(second), inputs, layers).select("node", "value")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The chains of turns in files that arrive in three batches, each inferred on from the last."""
    from triplewright.streaming.incremental import Incremental

    path, done = _folder(spark, "stream"), _folder(spark, "progress")
    steps = Incremental(Graph.empty(spark).add("(A next_turn B) => (A before B)", "(A before B, B next_turn C) => (A before C)"))
    turns = triples(spark, d, ["next_turn"]).withColumn("part", F.pmod(F.xxhash64("s"), F.lit(3)))
    for k in range(3):
        turns.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
        query = steps.start(spark.readStream.schema("s string, p string, o string").parquet(path), done)
        query.awaitTermination()
    return steps.graph.triples.where("p = 'before'").select("s", "o")


register("IO1_entity_dump", lambda s, d: _entity_dump(s, d), "SELECT 'N' || n_nationkey AS s, 'P1' AS p, 'R' || n_regionkey AS o, 'normal' AS rank FROM nation")
register("IO6_csv", _csv_again, f"SELECT {_SPO}p IN ('has_type', 'located_in')")
register("IO8_json", _json_again, "SELECT s AS x, o AS n FROM triples WHERE p = 'has_size' AND CAST(o AS DOUBLE) > 40")
register("IO9_snapshot", lambda s, d: _snapshot(s, d), f"SELECT {_SPO}p IN ('located_in', 'peer_of', 'has_type')")
register("IO10_part_by_predicate", lambda s, d: _snapshot(s, d, predicates=["peer_of"]), f"SELECT {_SPO}p = 'peer_of'")
register("IO10_part_by_node", lambda s, d: _snapshot(s, d, nodes=["nation/3"]), f"SELECT {_SPO}p IN ('located_in', 'peer_of', 'has_type') AND (s = 'nation/3' OR o = 'nation/3')")
register("IO13_deduction_log", _log, "SELECT '(' || s || ' peer_of ' || o || ') => (' || o || ' after ' || s || ')' AS text FROM triples WHERE p = 'peer_of'")
register("IO14_pages", _pages, "SELECT s AS node, '# ' || s || chr(10) || chr(10) || '- peer_of ' || o || chr(10) AS page FROM triples WHERE p = 'peer_of'")
register("N04_forward", _forward, "WITH h AS (SELECT a.s AS node, greatest(sum(CAST(b.o AS DOUBLE) - 25), 0) AS v FROM triples a JOIN triples b ON b.s = a.o AND b.p = 'has_size' WHERE a.p = 'supplies' GROUP BY a.s) SELECT t.o AS node, CAST(sum(2 * coalesce(h.v, 0)) AS DOUBLE) AS value FROM triples t LEFT JOIN h ON h.node = t.s WHERE t.p = 'located_in' AND t.s LIKE 'supplier/%' GROUP BY t.o")
register("R19_rule_from_parts", lambda s, d: graph(s, d, ["in_lang", "has_quality"]).rule(["A in_lang L", "A has_quality Q"], "A rated L").infer()[1].new.selectExpr("s", "objects[0] AS o"), "SELECT a.s, a.o FROM triples a WHERE a.p = 'in_lang' AND a.s IN (SELECT s FROM triples WHERE p = 'has_quality')")
register("R21_syntax", lambda s, d: Graph.empty(s).add('("a b" likes <12>)', ":marked x", "(:marked X, Y likes <2 1>) => (X met Y)").infer()[1].new.selectExpr("s", "p", "objects[0] AS o"), "SELECT 'x' AS s, 'met' AS p, 'a b' AS o")
register("T01_incremental", _stream, _PAIRS.format(p="next_turn", more="") + "SELECT a AS s, b AS o FROM r")
register("X02_own_language", lambda s, d: graph(s, d, ["peer_of"]).register_language("PEERS", lambda g, text: g.targets(text.split()[1], "peer_of")).query("PEERS nation/3"), "SELECT o AS node FROM triples WHERE p = 'peer_of' AND s = 'nation/3'")


# -- dumps, scripts, snapshots, rules as objects
def _dump(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Entity lines, written compressed and read again."""
    from triplewright.sources.entities import entities

    path = _folder(spark, "dump")
    rows.write.text(path, compression="bzip2")
    return entities(spark, path)


def _snak(prop: str, value: str) -> str:
    return f"""'{{"snaktype":"value","property":"{prop}","datavalue":{{"value":{{"id":"', {value}, '"}},"type":"wikibase-entityid"}}}}'"""


def _qualified(spark: SparkSession, d: str) -> DataFrame:
    """Nations whose region is qualified by the nation's key, ranked by it."""
    line = f"""concat('{{"id":"N', n_nationkey, '","type":"item","claims":{{"P1":[{{"mainsnak":', {_snak("P1", "concat('R', n_regionkey)")}, ',"id":"c', n_nationkey, '","rank":"', IF(n_nationkey % 2 = 0, 'normal', 'preferred'), '","qualifiers":{{"P5":[', {_snak("P5", "concat('Q', n_nationkey)")}, ']}}}}]}}}},') AS value"""
    return _dump(spark, spark.read.parquet(f"{d}/nation.parquet").selectExpr(line))


def _constrained(spark: SparkSession, d: str) -> DataFrame:
    """Properties, one a region, that conflict with one value of P9."""
    line = f"""concat('{{"id":"P', r_regionkey, '","type":"property","claims":{{"P2302":[{{"mainsnak":', {_snak("P2302", "'Q21502838'")}, ',"id":"c","rank":"normal","qualifiers":{{"P2306":[', {_snak("P2306", "'P9'")}, '],"P2305":[', {_snak("P2305", "concat('Q', r_regionkey)")}, ']}}}}]}}}}') AS value"""
    return _dump(spark, spark.read.parquet(f"{d}/region.parquet").selectExpr(line))


def _imports(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        from triplewright.sources import entities

        if name == "qualified":
            return entities.qualified(_qualified(spark, d))
        if name == "rules":
            return entities.constraint_rules(_constrained(spark, d)).select("property", "rule")
        if name == "lines":
            return _qualified(spark, d).select("id", "type")
        path = _folder(spark, "part")
        entities.extract(_qualified(spark, d), ["N3", "N4"], path)
        return entities.entities(spark, path).select("id")

    return run


register("IO2_compressed_lines", _imports("lines"), "SELECT 'N' || n_nationkey AS id, 'item' AS type FROM nation")
register("IO3_qualifiers", _imports("qualified"), "SELECT 'N' || n_nationkey AS s, 'p:P1' AS p, 'c' || n_nationkey AS o FROM nation UNION ALL SELECT 'c' || n_nationkey, 'ps:P1', 'R' || n_regionkey FROM nation UNION ALL SELECT 'c' || n_nationkey, 'pq:P5', 'Q' || n_nationkey FROM nation UNION ALL SELECT 'c' || n_nationkey, 'wikibase:rank', CASE WHEN n_nationkey % 2 = 0 THEN 'wikibase:NormalRank' ELSE 'wikibase:PreferredRank' END FROM nation")
register("IO4_constraint_rules", _imports("rules"), "SELECT 'P' || r_regionkey AS property, '(X P' || r_regionkey || ' Y, X P9 Q' || r_regionkey || ') => !' AS rule FROM region")
register("IO5_extract", _imports("extract"), "SELECT 'N' || n_nationkey AS id FROM nation WHERE n_nationkey IN (3, 4)")


def _records(spark: SparkSession, d: str) -> DataFrame:
    from triplewright.sources.tables import json_records, record_chains, record_facts

    path = _folder(spark, "records")
    spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment").write.json(path)
    records = json_records(spark, path, "id long, name string, segment string", lines=True)
    return record_facts(records, "id").unionByName(record_chains(records, ["name", "segment"]))


register("IO7_json_records", _records, "SELECT CAST(c_custkey AS VARCHAR) AS s, 'name' AS p, c_name AS o FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'segment', c_mktsegment FROM customer UNION ALL SELECT DISTINCT c_name, 'member of', c_mktsegment FROM customer")


def _snapshot_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules made from text and from parts, saved and loaded with the facts they then run over."""
    path = _folder(spark, "graph")
    graph(spark, d, ["located_in", "peer_of"], "(A peer_of B) => (B after A)").rule(["A located_in B", "A peer_of C", "A != C"], "B holds A").save(path)
    return Graph.load(spark, path).infer()[1].new.selectExpr("s", "p", "objects[0] AS o")


def _routed(spark: SparkSession, d: str, stats: bool = False) -> DataFrame:
    path = _folder(spark, "graph")
    graph(spark, d, ["located_in", "peer_of", "has_type"]).save_sharded(path)
    if stats:
        return Graph.file_stats(spark, path).select(F.explode("predicates").alias("p"), "facts").groupBy("p").agg((F.sum("facts") > 0).alias("held"))
    return Graph.load_routed(spark, path, subjects=["nation/3", "part/5"]).triples.select("s", "p", "o")


register("IO9_snapshot_of_rules", _snapshot_rules, "SELECT o AS s, 'after' AS p, s AS o FROM triples WHERE p = 'peer_of' UNION ALL SELECT a.o, 'holds', a.s FROM triples a JOIN triples b ON b.s = a.s AND b.p = 'peer_of' WHERE a.p = 'located_in'")
register("IO11_routed_load", _routed, f"SELECT {_SPO}p IN ('located_in', 'peer_of', 'has_type') AND s IN ('nation/3', 'part/5')")
register("IO12_file_statistics", lambda s, d: _routed(s, d, True), "SELECT p, count(*) > 0 AS held FROM triples WHERE p IN ('located_in', 'peer_of', 'has_type') GROUP BY p")


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    from triplewright.sources.reports import drawing

    page = drawing(spark, graph(spark, d, ["peer_of", "located_in"]).prune_facts("X located_in Y").insert_triples(triples(spark, d, ["located_in"]).where("s like 'nation/%'")), "nation/3", 1)
    return small_rows(spark, [(page.count("-->"), page.count('["'))], "edges long, nodes long")


register("IO15_drawing", _drawn, "WITH e AS (SELECT s, o FROM triples WHERE ((p = 'located_in' AND s LIKE 'nation/%') OR p = 'peer_of') AND (s = 'nation/3' OR o = 'nation/3')) SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM (SELECT s FROM e UNION SELECT o FROM e)) AS nodes")
_LIBRARY = os.path.join(os.path.dirname(os.path.abspath(__file__)), "library")
_CLOSED = "SELECT a.s, 'located_in' AS p, b.o FROM triples a JOIN triples b ON a.o = b.s AND b.p = 'located_in' WHERE a.p = 'located_in'"
_scripted = lambda text: lambda s, d: graph(s, d, ["located_in"]).run_script(text, (_LIBRARY,)).infer()[1].new.selectExpr("s", "p", "objects[0] AS o")
register("IO16_script_with_import", _scripted('.import transitivity\nlocated_in is transitive # "as said"\n.import transitivity.rules'), _CLOSED)
register("X04_host_program", lambda s, d: (lambda g: [g := g.add(f"(A {p} B) => (B {q} A)") for p, q in (("located_in", "contains"),)][-1])(graph(s, d, ["located_in"])).infer()[1].new.selectExpr("s", "p", "objects[0] AS o"), "SELECT o AS s, 'contains' AS p, s AS o FROM triples WHERE p = 'located_in'")
register("R20_auto_run", lambda s, d: graph(s, d, ["located_in"]).run_script(".auto-run\n(A located_in B) => (B contains A)\n.auto-run off\n(A contains B) => (A holds B)").triples.where("p <> 'located_in'").select("s", "p", "o"), "SELECT o AS s, 'contains' AS p, s AS o FROM triples WHERE p = 'located_in'")
register("R18_list_rules", lambda s, d: Graph.empty(s).add("(A p B, ¬(A q B)) => (A r B)").rule(["A p B", "A != B"], "B s A").add("(A p A) => !").list_rules(), "SELECT * FROM (VALUES (CAST(0 AS INTEGER), '(A p B, ¬(A q B)) => (A r B)'), (1, '(A p B, A != B) => (B s A)'), (2, '(A p A) => !')) t(place, rule)")
register("R18_remove_a_rule", lambda s, d: graph(s, d, ["peer_of"], "(A peer_of B) => (B after A)", "(A peer_of B) => (A near B)").remove_rule("(A peer_of B) => (A near B)").infer()[1].new.selectExpr("s", "p", "objects[0] AS o"), "SELECT o AS s, 'after' AS p, s AS o FROM triples WHERE p = 'peer_of'")
rules("R22_condition_order", ["located_in", "placed_by", "has_priority"], ['(C located_in N, O has_priority U, N located_in "region/2", O placed_by C, U = U) => (O urgent U)'.replace(", U = U", "")], "SELECT o.s, 'urgent' AS p, u.o FROM triples o JOIN triples u ON u.s = o.s AND u.p = 'has_priority' JOIN triples c ON c.s = o.o AND c.p = 'located_in' JOIN triples n ON n.s = c.o AND n.p = 'located_in' AND n.o = 'region/2' WHERE o.p = 'placed_by'")
ask("P11_prefixes", "PREFIX e: <http://www.wikidata.org/entity/> SELECT ?s ?o { ?s wdt:located_in ?o ; <http://www.wikidata.org/prop/direct/peer_of> ?x . ?x e:located_in ?r }", "SELECT a.s, a.o FROM triples a JOIN triples b ON b.s = a.s AND b.p = 'peer_of' WHERE a.p = 'located_in'")


def _refused(*texts: str):
    """Which texts are refused, each a row."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = []
        for text in texts:
            try:
                SparqlPlan(triples(spark, d, ["located_in"])).run(text)
                out.append((text, False))
            except QueryError:
                out.append((text, True))
        return small_rows(spark, out, "text string, refused boolean")

    return run


def _refused_sql(*texts: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {'located_in ?y }' not in t})" for t in texts) + ") t(text, refused)"


_ANSWERED = "SELECT ?x { ?x located_in ?y }"
for _name, _texts in {
    "C08_unbound_reflexive": ("SELECT ?x ?y { ?x located_in* ?y }", _ANSWERED),
    "Q06_unsupported_words": (*(f"SELECT ?x {{ ?x located_in ?y {w} }}" for w in ("BIND", "VALUES", "SERVICE", "CONSTRUCT", "DESCRIBE", "GRAPH", "HAVING")), _ANSWERED),
    "Q07_ask_and_exists": ("ASK { ?x a ?y }", "SELECT ?x { FILTER NOT EXISTS { ?x a ?y } }", "SELECT ?x { FILTER EXISTS { ?x a ?y } }", _ANSWERED),
}.items():
    register(_name, _refused(*_texts), _refused_sql(*_texts))


def _rewritten(fn, texts: dict[str, str]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return small_rows(spark, [(text, show(fn(Reader(text).whole()))) for text in texts], "term string, becomes string")

    return run


_SYMBOLS = {"x", "y", "c"}
for _name, _fn, _texts in (
    ("F12_simplify", lambda t: symbolic.simplify(t, _SYMBOLS), {"(x + &0)": "x", "(x * &0)": "&0", "(exp of (ln of x))": "x", "(exp of (ln of (x + &0)))": "x", "(&2 + &3)": "&5", "(&6 / &3)": "&2", "(x / &1)": "x", "(x eml &1)": "(exp of x)", "(x + y)": "(x + y)"}),
    ("F13_differentiate", lambda t: symbolic.differentiate(t, "x", _SYMBOLS), {"x": "&1", "c": "&0", "(x * x)": "(x + x)", "(c * x)": "c", "(exp of (c * x))": "((exp of (c * x)) * c)", "(ln of x)": "(&1 / x)", "(x / c)": "(&1 / c)"}),
    ("F14_eml", lambda t: symbolic.compile_eml(t, _SYMBOLS), {"(exp of x)": "(x eml &1)", "(ln of x)": "(&1 eml ((&1 eml x) eml &1))", "(x - y)": "((&1 eml ((&1 eml x) eml &1)) eml (y eml &1))"}),
):
    register(_name, _rewritten(_fn, _texts), "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{show(Reader(b).whole())}')" for a, b in _texts.items()) + ") t(term, becomes)")
register("F16_rendering", lambda s, d: (lambda g: g.rendered(g.facts.select(F.col("fact_id").alias("node"))).select("text"))(named(s, d, ["peer_of"])), "SELECT '(' || a.name || ' peer_of ' || b.name || ')' AS text FROM triples JOIN names a ON a.node = s JOIN names b ON b.node = o WHERE p = 'peer_of'")
register("X03_display_hook", lambda s, d: (lambda g: replace(g, display=lambda c: F.lower(c)).rendered(g.facts.select(F.col("s").alias("node"))))(named(s, d, ["peer_of"])), "SELECT s AS node, lower(name) AS text FROM triples JOIN names ON node = s WHERE p = 'peer_of'")
register("F17_tokens", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(texts.tokens(texts.trimmed(F.concat(F.lit("  say \""), "p_name", F.lit("\" of "), "p_brand"))), "|").alias("parts")), "SELECT p_partkey, 'say|' || p_name || '|of|' || p_brand AS parts FROM part")
register("T03_delta", lambda s, d: (lambda g: g.insert_triples(triples(s, d, ["located_in", "peer_of"])).delta(g).selectExpr("s", "p", "objects[0] AS o"))(graph(s, d, ["located_in"])), f"SELECT {_SPO}p = 'peer_of'")
register("D10_reset", lambda s, d: Graph.empty(graph(s, d, ["located_in"], "(A peer_of B) => (B peer_of A)").spark).insert_triples(triples(s, d, ["peer_of"])).infer()[0].triples.select("s", "p", "o"), f"SELECT {_SPO}p = 'peer_of'")


def _stream_restarted(spark: SparkSession, d: str) -> DataFrame:
    """The chains of turns in three batches, each taken by a program that knows of the others by the checkpoint alone."""
    from triplewright.streaming.incremental import Incremental

    path, done = _folder(spark, "stream"), _folder(spark, "progress")
    turns = triples(spark, d, ["next_turn"]).withColumn("part", F.pmod(F.xxhash64("s"), F.lit(3)))
    for k in range(3):
        steps = Incremental(Graph.empty(spark).add("(A next_turn B) => (A before B)", "(A before B, B next_turn C) => (A before C)", "(A next_turn B, B before C) => (A before C)"))
        turns.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
        steps.start(spark.readStream.schema("s string, p string, o string").parquet(path), done).awaitTermination()
    return steps.graph.triples.where("p = 'before'").select("s", "o")


register("T01_restarted", _stream_restarted, _PAIRS.format(p="next_turn", more="") + "SELECT a AS s, b AS o FROM r")


# -- networks on a fixed start: region k leads to ``out`` with weight k + 1
def _net(spark: SparkSession, d: str, what: str) -> DataFrame:
    from triplewright.operators import neural

    wires = spark.read.parquet(f"{d}/region.parquet").selectExpr("concat('region/', r_regionkey) AS src", "'out' AS dst", "r_regionkey + 1.0D AS w")
    if what == "weight":
        wires = neural.set_weight(neural.set_weight(wires, "region/2", "out", 9.5), "new", "out", -1.0)
        return wires.unionByName(small_rows(spark, [("read", "out", neural.weight(wires, "region/2", "out"))], "src string, dst string, w double"))
    regions = [r["src"] for r in wires.select("src").collect()]
    if what == "connect":
        return neural.connect(spark, wires, [*regions, "one"], ["out", "other"], seed=3).select("src", "dst", F.when(F.col("w") >= 1, F.col("w")).alias("w"), (F.abs("w") <= 0.5).alias("small"))
    net = neural.Compiled(wires, [regions[::-1], ["out"]])
    if what == "layers":
        return small_rows(spark, [(k, n, float(net.weights[0][k, 0]) * float(net.masks[0][k, 0])) for k, n in enumerate(net.layers[0])], "place int, node string, w double")
    if what == "best":
        return small_rows(spark, [(n, *net.best(n, 1)[0]) for n in net.layers[0]], "source string, node string, value double")
    loss = net.train(net.one_hot(0, "region/3"), np.array([0.0]), 0.1)
    if what == "step":
        return small_rows(spark, [(loss, net.train_nodes("region/0", "out", 0.1))], "loss double, second double")
    return net.synapses(spark).withColumn("w", F.round("w", 6))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    from triplewright.operators.neural import link_predictor

    edges = triples(spark, d, ["located_in"]).where("s like 'nation/%'").select("s", "o")
    net, _ = link_predictor(spark, edges, hidden=32, epochs=200)
    return small_rows(spark, [(n, net.best(n, 1)[0][0]) for n in net.layers[0]], "s string, o string")


_WIRE = "SELECT 'region/' || r_regionkey AS src, 'out' AS dst, "
register("N01_weights", lambda s, d: _net(s, d, "weight"), _WIRE + "CASE WHEN r_regionkey = 2 THEN 9.5 ELSE CAST(r_regionkey + 1 AS DOUBLE) END AS w FROM region UNION ALL SELECT 'new', 'out', -1 UNION ALL SELECT 'read', 'out', 9.5")
register("N02_layer_order", lambda s, d: _net(s, d, "layers").select("place", "node"), "SELECT CAST(row_number() OVER (ORDER BY 'region/' || r_regionkey) - 1 AS INTEGER) AS place, 'region/' || r_regionkey AS node FROM region")
register("N03_compiled", lambda s, d: _net(s, d, "layers").select("node", "w"), "SELECT 'region/' || r_regionkey AS node, CAST(r_regionkey + 1 AS DOUBLE) AS w FROM region")
register("N05_step", lambda s, d: _net(s, d, "step"), "SELECT CAST(8 AS DOUBLE) AS loss, CAST(0 AS DOUBLE) AS second")
register("N06_written_back", lambda s, d: _net(s, d, "synapses"), _WIRE + "CASE WHEN r_regionkey = 3 THEN CAST(3.6 AS DOUBLE) ELSE CAST(r_regionkey + 1 AS DOUBLE) END AS w FROM region")
register("N07_best", lambda s, d: _net(s, d, "best"), "SELECT 'region/' || r_regionkey AS source, 'out' AS node, CAST(r_regionkey + 1 AS DOUBLE) AS value FROM region")
register("N08_connect", lambda s, d: _net(s, d, "connect"), _WIRE + "CAST(r_regionkey + 1 AS DOUBLE) AS w, false AS small FROM region UNION ALL SELECT 'region/' || r_regionkey, 'other', NULL, true FROM region UNION ALL SELECT 'one', 'out', NULL, true UNION ALL SELECT 'one', 'other', NULL, true")
register("N09_link_predictor", _linked, "SELECT s, o FROM triples WHERE p = 'located_in' AND s LIKE 'nation/%'")
