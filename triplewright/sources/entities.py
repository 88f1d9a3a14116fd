"""Dumps of entities with claims, one JSON object a line, plain or compressed.

Lines may end in a comma and be enclosed in ``[`` and ``]`` lines.  Texts are
read once with a fixed schema; nested claims are exploded, nothing is inferred.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

_SNAK = "struct<snaktype:string,property:string,datavalue:struct<value:string,type:string>>"
SCHEMA = f"id string, type string, labels map<string,struct<language:string,value:string>>, claims map<string,array<struct<mainsnak:{_SNAK},id:string,rank:string,qualifiers:map<string,array<{_SNAK}>>>>>"


def entities(spark: SparkSession, path: str) -> DataFrame:
    """(``line``, ``id``, ``type``, ``labels``, ``claims``); lines that are no object are left out."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",$", "").alias("line")).where(F.col("line").startswith("{"))
    return lines.select("line", F.from_json("line", SCHEMA).alias("e")).select("line", "e.*").where("id is not null")


def names(dump: DataFrame, langs: tuple[str, ...] = ("en",)) -> DataFrame:
    """(``node``, ``lang``, ``name``) of the labels in ``langs``."""
    return dump.select(F.col("id").alias("node"), F.explode("labels").alias("lang", "label")).where(F.col("lang").isin(*langs)).select("node", "lang", F.col("label.value").alias("name"))


def _statements(dump: DataFrame) -> DataFrame:
    return dump.select("id", F.explode("claims").alias("property", "statements")).select("id", "property", F.explode("statements").alias("c"))


def _scalar(value) -> F.Column:
    """A value as a node: an item's id, a time or amount as written, a text as it is; null for others."""
    return F.coalesce(F.get_json_object(value, "$.id"), F.get_json_object(value, "$.time"), F.get_json_object(value, "$.amount"), F.get_json_object(value, "$.text"), F.when(~value.startswith("{"), value))


def direct(dump: DataFrame) -> DataFrame:
    """(``s``, ``p``, ``o``, ``rank``) of every statement whose main value is an item, whatever comes before it."""
    s = _statements(dump).where("c.mainsnak.snaktype = 'value'")
    out = s.select(F.col("id").alias("s"), F.col("property").alias("p"), F.get_json_object("c.mainsnak.datavalue.value", "$.id").alias("o"), F.col("c.rank").alias("rank"))
    return out.where("o is not null").distinct()


def qualified(dump: DataFrame, properties: list[str] | None = None) -> DataFrame:
    """(``s``, ``p``, ``o``): statements with qualifiers as nodes.

    A statement that has a qualifier with a value (of ``properties``, where
    given) is a node: ``p:`` leads to it, ``ps:`` to its main value, ``pq:`` to
    each qualifier's, ``wikibase:rank`` to its rank.  Unknown and missing
    values, and coordinates, are left out.
    """
    base = _statements(dump).where("c.id is not null and c.qualifiers is not null")
    each = base.select("id", "property", F.col("c.id").alias("node"), F.col("c.rank").alias("rank"), F.col("c.mainsnak").alias("main"), F.explode("c.qualifiers").alias("q", "snaks")).select("id", "property", "node", "rank", "main", "q", F.explode("snaks").alias("snak"))
    each = each.where("snak.snaktype = 'value' and coalesce(snak.datavalue.type, '') <> 'globecoordinate'")
    if properties is not None:
        each = each.where(F.col("q").isin(*properties))
    each = each.withColumn("o", _scalar(F.col("snak.datavalue.value"))).where("o is not null")
    own = each.select("id", "property", "node", "rank", "main").distinct()
    main = own.where("main.snaktype = 'value'").select(F.col("node").alias("s"), F.concat(F.lit("ps:"), "property").alias("p"), _scalar(F.col("main.datavalue.value")).alias("o")).where("o is not null")
    ranks = F.create_map(*[F.lit(x) for k, v in (("preferred", "PreferredRank"), ("normal", "NormalRank"), ("deprecated", "DeprecatedRank")) for x in (k, f"wikibase:{v}")])
    parts = [
        own.select(F.col("id").alias("s"), F.concat(F.lit("p:"), "property").alias("p"), F.col("node").alias("o")),
        main,
        each.select(F.col("node").alias("s"), F.concat(F.lit("pq:"), "q").alias("p"), "o"),
        own.where("rank is not null").select(F.col("node").alias("s"), F.lit("wikibase:rank").alias("p"), ranks[F.col("rank")].alias("o")),
    ]
    return reduce(DataFrame.unionAll, parts).distinct()


def constraint_rules(dump: DataFrame) -> DataFrame:
    """(``property``, ``type``, ``rule``): property constraints as rule text.

    Conflicts-with (Q21502838), none-of (Q52558054) and scope (Q53869507)
    constraints give rules; others are listed with a null rule.
    """
    s = _statements(dump).where("property = 'P2302' and c.mainsnak.snaktype = 'value'")
    s = s.select("id", F.get_json_object("c.mainsnak.datavalue.value", "$.id").alias("type"), F.col("c.qualifiers").alias("q"))
    values = lambda p: F.transform(F.filter(F.coalesce(F.col("q")[p], F.array()), lambda x: x["snaktype"] == "value"), lambda x: F.get_json_object(x["datavalue"]["value"], "$.id"))
    conflict = F.when(F.col("value").isNotNull(), F.format_string("(X %s Y, X %s %s) => !", "id", "other", "value")).otherwise(F.format_string("(X %s Y, X %s Z) => !", "id", "other"))
    rule = (
        F.when((F.col("type") == "Q21502838") & F.col("other").isNotNull(), conflict)
        .when((F.col("type") == "Q52558054") & F.col("value").isNotNull(), F.format_string("(X %s %s) => !", "id", "value"))
        .when((F.col("type") == "Q53869507") & ~F.array_contains(values("P5314"), "Q54828448"), F.format_string("(X %s Y) => !", "id"))
    )
    return s.select("id", "type", "q").select(F.col("id"), "type", "q", F.element_at(F.when(F.size(values("P2306")) > 0, values("P2306")), 1).alias("other"), F.explode_outer(values("P2305")).alias("value")).select(F.col("id").alias("property"), "type", rule.alias("rule")).distinct()


def extract(dump: DataFrame, ids: list[str], path: str) -> None:
    """The lines of some entities, as they are in the dump."""
    dump.where(F.col("id").isin(*ids)).select(F.col("line").alias("value")).write.mode("overwrite").text(path)
