"""What an inference found, as text: a log of deductions, a page for each node, a drawing of a neighbourhood."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession, functions as F

from triplewright.graph import Graph
from triplewright.storage import small_rows

#: The log's alphabet for compressed words: 4095 signs from here on.
FIRST_SIGN, SIGNS = 0x4E00, 4095


def fact_text(facts: DataFrame) -> DataFrame:
    """(``fact_id``, ``text``): subject, predicate and objects of each fact."""
    return facts.select("fact_id", F.concat_ws(" ", "s", "p", F.array_join("objects", " ")).alias("text"))


def deductions(graph: Graph) -> DataFrame:
    """(``text``): ``premises => conclusion`` of every derived fact."""
    texts = fact_text(graph.facts)
    each = graph.facts.where("derived").select("fact_id", F.explode_outer("premises").alias("because"))
    why = each.join(texts.select(F.col("fact_id").alias("because"), F.col("text").alias("reason")), "because", "left").groupBy("fact_id").agg(F.sort_array(F.collect_list(F.concat(F.lit("("), "reason", F.lit(")")))).alias("reasons"))
    return why.join(texts, "fact_id").select(F.concat_ws(" => ", F.array_join("reasons", ", "), F.concat(F.lit("("), "text", F.lit(")"))).alias("text"))


def signs(n: int) -> str:
    """A number in base 4095, as signs."""
    out = ""
    while True:
        out = chr(FIRST_SIGN + n % SIGNS) + out
        n //= SIGNS
        if not n:
            return out


def encode(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines with each word as its number in signs, and the table (``n``, ``word``) that reads them.

    Words are numbered by their order among all, in ranges, without bringing
    them to one task.
    """
    words = lines.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").count()
    ordered = words.repartitionByRange(F.desc("count"), "word").sortWithinPartitions(F.desc("count"), "word")
    parts = ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(total)]
        total += sizes[part]
    base = F.create_map(*starts)[F.col("part")] if starts else F.lit(0)
    table = parts.select((F.col("at") + base).alias("n"), "word")

    @F.pandas_udf("string")
    def to_signs(n):
        return n.map(signs)

    numbered = table.withColumn("sign", to_signs("n"))
    each = lines.withColumn("line", F.monotonically_increasing_id()).select("line", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    coded = each.join(numbered, "word").groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sign"))), lambda x: x["sign"]), " ").alias("text"))
    return coded.select("text"), table


def decode(coded: DataFrame, table: DataFrame) -> DataFrame:
    """The lines that ``encode`` made, as they were."""

    @F.pandas_udf("long")
    def number(sign):
        def one(s):
            n = 0
            for c in s:
                n = n * SIGNS + ord(c) - FIRST_SIGN
            return n

        return sign.map(one)

    each = coded.withColumn("line", F.monotonically_increasing_id()).select("line", F.posexplode(F.split("text", " ")).alias("pos", "sign"))
    return each.withColumn("n", number("sign")).join(table, "n").groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text")).select("text")


def pages(graph: Graph) -> DataFrame:
    """(``node``, ``page``): for each node a Markdown page of its facts, derived ones marked."""
    line = F.concat(F.lit("- "), "p", F.lit(" "), F.array_join("objects", ", "), F.when(F.col("derived"), F.lit(" *(derived)*")).otherwise(F.lit("")))
    body = graph.facts.where("s not like 'f:%'").select(F.col("s").alias("node"), line.alias("line"))
    return body.groupBy("node").agg(F.sort_array(F.collect_list("line")).alias("lines")).select("node", F.concat(F.lit("# "), "node", F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("page"))


def drawing(spark: SparkSession, graph: Graph, node: str, depth: int = 2, most: int = 500) -> str:
    """An HTML page that draws the edges within ``depth`` steps of a node; raises if there are more than ``most``."""
    edges, seen = graph.triples.select("s", "p", "o"), small_rows(spark, [(node,)], "node string")
    found = None
    for _ in range(depth):
        step = edges.join(seen.withColumnRenamed("node", "s"), "s", "left_semi").unionAll(edges.join(seen.withColumnRenamed("node", "o"), "o", "left_semi").select("s", "p", "o")).distinct()
        found = step
        seen = step.select(F.explode(F.array("s", "o")).alias("node")).distinct()
    rows = found.orderBy("s", "p", "o").limit(most + 1).collect() if found is not None else []
    if len(rows) > most:
        raise ValueError(f"more than {most} edges within {depth} steps")
    number = {n: k for k, n in enumerate(sorted({x for r in rows for x in (r["s"], r["o"])}))}
    lines = [f'  n{k}["{html.escape(n)}"]' for n, k in number.items()] + [f'  n{number[r["s"]]} -->|"{html.escape(r["p"])}"| n{number[r["o"]]}' for r in rows]
    return '<!doctype html>\n<pre class="mermaid">\ngraph LR\n' + "\n".join(lines) + "\n</pre>\n"
