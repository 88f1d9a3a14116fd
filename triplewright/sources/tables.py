"""CSV and JSON records as triples, and results as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def csv_triples(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file with a header: the first three columns, trimmed; rows with fewer are left out."""
    schema = "s string, p string, o string"
    rows = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", enforceSchema=True)
    return rows.select(*(F.trim(c).alias(c) for c in ("s", "p", "o"))).where("s <> '' and p <> '' and o <> ''")


def record_chains(records: DataFrame, chain: list[str], predicate: str = "member of") -> DataFrame:
    """Each record's columns along ``chain`` as facts from one to the next, each fact once."""
    parts = [records.select(F.col(a).alias("s"), F.lit(predicate).alias("p"), F.col(b).alias("o")) for a, b in zip(chain, chain[1:])]
    return reduce(DataFrame.unionAll, parts).where("s is not null and o is not null").distinct()


def record_facts(records: DataFrame, subject: str) -> DataFrame:
    """Each record's other columns as facts of its subject: the column is the predicate."""
    others = [c for c in records.columns if c != subject]
    pairs = F.array(*(F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o")) for c in others))
    return records.select(F.col(subject).cast("string").alias("s"), F.explode(pairs).alias("x")).select("s", "x.p", "x.o").where("o is not null").distinct()


def json_records(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """The records of JSON files that are arrays, or with ``lines`` one record a line, which large files can be split by."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
