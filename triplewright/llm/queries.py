"""The registered queries ``opN_<name>``: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from triplewright.llm import bm25_search, jaccard_join, lz_prints, mixing, packing, pseudo_lm, quality, secret_scan, token_counts, toxicity
from triplewright.llm.common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25_search.search(docs, docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"))


def op7_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_prints.compare_neighbours(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.score(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_jaccard_join, op3_secrets, op4_quality, op5_packing, op6_bm25_search, op7_lz_fingerprints, op8_toxicity, op9_token_counts, op10_lm_scores)}
#: Distinct shingles of each document, those that two share, links, and what links reach.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), sizes AS (SELECT doc_id, len(s) AS n FROM s
), x AS (SELECT doc_id, unnest(s) AS g FROM s
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common.n >= 70 * (p.n + q.n - common.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT sizes.doc_id, CAST(sizes.n AS BIGINT) AS n_shingles, CAST((SELECT count(*) FROM links WHERE links.a = sizes.doc_id) AS BIGINT) AS n_similar,
       (SELECT min(b) FROM reach WHERE reach.a = sizes.doc_id) AS component_id
FROM sizes
"""
#: BM25 of every document for every query, by joining postings.
BM25_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), size AS (SELECT doc_id, len(w) AS n FROM w
), corpus AS (SELECT count(*) AS n, sum(n) / count(*) AS mean FROM size
), x AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM w) GROUP BY 1, 2
), idf AS (SELECT t, ln(1 + ((SELECT n FROM corpus) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM x GROUP BY 1
), scored AS (
  SELECT q.doc_id AS query_id, x.doc_id, round(sum(idf.idf * x.tf * 2.2 / (x.tf + 1.2 * (0.25 + 0.75 * size.n / corpus.mean))), 6) AS score
  FROM x q JOIN x ON q.t = x.t AND q.doc_id % 100 = 0 JOIN idf ON idf.t = x.t JOIN size ON size.doc_id = x.doc_id CROSS JOIN corpus GROUP BY 1, 2
), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored)
SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
ORACLE_SQL: dict[str, str] = {"op6_bm25_search": BM25_SQL, "op2_jaccard_join": JACCARD_SQL}
