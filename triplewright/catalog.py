"""A graph over the relational tables, and its queries with their SQL twins.

Every table gives predicates; a query that names a predicate reads only the
tables and columns behind it, since the others' branches of the union fold
away while the plan is made.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from triplewright.storage import sized, small_rows

#: predicate -> (table, subject, object, filter, distinct), in SQL that both engines read.
VIEWS: list[tuple[str, str, str, str, str, bool]] = [
    ("located_in", "nation", "'nation/' || n_nationkey", "'region/' || n_regionkey", "", False),
    ("located_in", "customer", "'customer/' || c_custkey", "'nation/' || c_nationkey", "", False),
    ("located_in", "supplier", "'supplier/' || s_suppkey", "'nation/' || s_nationkey", "", False),
    ("placed_by", "orders", "'order/' || o_orderkey", "'customer/' || o_custkey", "", False),
    ("contains_part", "lineitem", "'order/' || l_orderkey", "'part/' || l_partkey", "", True),
    ("filled_by", "lineitem", "'order/' || l_orderkey", "'supplier/' || l_suppkey", "", True),
    ("supplies", "lineitem", "'supplier/' || l_suppkey", "'part/' || l_partkey", "", True),
    ("has_brand", "part", "'part/' || p_partkey", "p_brand", "", False),
    ("has_type", "part", "'part/' || p_partkey", "p_type", "", False),
    ("has_size", "part", "'part/' || p_partkey", "CAST(p_size AS STRING)", "", False),
    ("has_segment", "customer", "'customer/' || c_custkey", "c_mktsegment", "", False),
    ("has_status", "orders", "'order/' || o_orderkey", "o_orderstatus", "", False),
    ("has_priority", "orders", "'order/' || o_orderkey", "o_orderpriority", "", False),
    ("acted", "events", "'user/' || user_id", "'event/' || event_id", "", True),
    ("event_type", "events", "'event/' || event_id", "event_type", "", True),
    ("in_lang", "documents", "'document/' || doc_id", "lang", "", False),
    ("from_source", "documents", "'document/' || doc_id", "source", "", False),
    ("has_quality", "labels", "'document/' || doc_id", "CAST(quality AS STRING)", "", False),
    ("next_turn", "conversations", "'turn/' || conv_id || '/' || turn", "'turn/' || conv_id || '/' || (turn + 1)", "EXISTS", False),
    ("peer_of", "nation", "'nation/' || n_nationkey", "'nation/' || ((n_nationkey + 1) % 25)", "", False),
    ("within", "orders", "'order/' || o_orderkey", "'customer/' || o_custkey", "", False),
    ("within", "customer", "'customer/' || c_custkey", "'nation/' || c_nationkey", "", False),
    ("within", "nation", "'nation/' || n_nationkey", "'region/' || n_regionkey", "", False),
]


def _anchored(expression: str, node: str) -> str | None:
    """The condition on a table's own column under which an expression is ``node``; empty if none can be told, None if it never is."""
    made = re.fullmatch(r"'(\w+/)' \|\| (\w+)", expression)
    if made:
        own = node.removeprefix(made[1])
        return f"{made[2]} = {own}" if own != node and re.fullmatch(r"0|-?[1-9][0-9]{0,17}", own) else None
    if re.fullmatch(r"\w+", expression):
        return f"{expression} = '{node}'" if re.fullmatch(r"[\w #.-]*", node) else ""
    return ""


def _branch(p: str, table: str, s: str, o: str, where: str, distinct: bool) -> str:
    if where == "EXISTS":  # the following turn must exist
        return f"SELECT 'turn/' || a.conv_id || '/' || a.turn AS s, '{p}' AS p, 'turn/' || b.conv_id || '/' || b.turn AS o FROM {table} a JOIN {table} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
    return f"SELECT {'DISTINCT ' if distinct else ''}{s} AS s, '{p}' AS p, {o} AS o FROM {table} WHERE ({s}) IS NOT NULL AND ({o}) IS NOT NULL" + (f" AND {where}" if where else "")


def _column(expression: str) -> str | None:
    """The one column that an expression tells apart as well as it does its own values; None if there may be none."""
    made = re.fullmatch(r"(?:'\w+/' \|\| )?(\w+)|CAST\((\w+) AS STRING\)", expression)
    return made and (made[1] or made[2])


def _rows(p: str, table: str, s: str, o: str, where: str, distinct: bool) -> str:
    """``_branch`` for Spark: a DISTINCT compares the table's own columns, before names are made of them."""
    own = [_column(s), _column(o)]
    if not distinct or None in own:
        return _branch(p, table, s, o, where, distinct)
    kept = " AND ".join([f"{c} IS NOT NULL" for c in own] + [where] * bool(where))
    return f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM (SELECT DISTINCT {', '.join(dict.fromkeys(own))} FROM {table} WHERE {kept})"


#: For the SQL twins: ``WITH`` text that makes ``triples``.
TRIPLES_SQL = "triples AS (" + " UNION ALL ".join(_branch(*v) for v in VIEWS) + ")"


_SCHEMAS: dict[str, StructType] = {}


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A table of the folder; its schema is read from the files once in a session's life."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return sized(spark).read.schema(_SCHEMAS[path]).parquet(path)


def triples(spark: SparkSession, sf_dir: str, predicates: list[str] | None = None, s: str | None = None, o: str | None = None, distinct: bool = False) -> DataFrame:
    """The tables under ``sf_dir`` as (``s``, ``p``, ``o``); with ``predicates``, only those; ``distinct`` leaves no two rows equal.

    A subject or an object that is given becomes a condition on the table's
    own key, which reaches the scan and comes before the DISTINCT; tables that
    can't have it aren't opened.
    """
    subject, target, once = s, o, distinct
    chosen = [v for v in VIEWS if predicates is None or v[0] in predicates]
    parts = []
    for p, table, s, o, where, distinct in chosen:
        keys = [_anchored(e, n) for e, n in ((s, subject), (o, target)) if n is not None] if where != "EXISTS" else []
        if None in keys:
            continue
        where = where or " AND ".join(k for k in keys if k)
        tables = {table: _table(spark, f"{sf_dir}/{table}.parquet")}
        rows = spark.sql(_rows(p, "{" + table + "}", s, o, where, distinct or once), **tables)
        parts.append(rows.distinct() if once and where == "EXISTS" else rows)  # tables of one predicate have subjects of their own
    if not parts:
        return small_rows(spark, [], "s string, p string, o string")
    out = reduce(DataFrame.unionAll, parts)
    for column, node in (("s", subject), ("o", target)):
        if node is not None:
            out = out.where(out[column] == node)
    return out


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``node``, ``lang``, ``name``) of nations, regions, customers, suppliers and parts."""
    parts = []
    for table, key, name in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")):
        parts.append(spark.sql(f"SELECT '{table}/' || {key} AS node, 'en' AS lang, {name} AS name FROM {{t}}", t=spark.read.parquet(f"{sf_dir}/{table}.parquet")))
    return reduce(DataFrame.unionAll, parts)


NAMES_SQL = (
    "names AS (SELECT 'nation/' || n_nationkey AS node, 'en' AS lang, n_name AS name FROM nation UNION ALL SELECT 'region/' || r_regionkey, 'en', r_name FROM region UNION ALL SELECT 'customer/' || c_custkey, 'en', c_name FROM customer"
    " UNION ALL SELECT 'supplier/' || s_suppkey, 'en', s_name FROM supplier UNION ALL SELECT 'part/' || p_partkey, 'en', p_name FROM part)"
)
