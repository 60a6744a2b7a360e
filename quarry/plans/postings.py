"""A posting table and a match table derived from the star-schema tables, in SQL that Spark and DuckDB read alike, so that an oracle starts from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "TIMESTAMP '2001-08-02 00:00:00'"

#: One posting for each part: title, skills and years by its numbers, place by its supplier's nation, date by an order.
POSTINGS = """
SELECT p.p_partkey AS id,
  concat(CASE p.p_partkey % 8 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Junior ' WHEN 2 THEN 'Lead ' WHEN 3 THEN 'Principal ' WHEN 4 THEN 'Associate ' ELSE '' END,
         CASE p.p_partkey % 5 WHEN 0 THEN 'Java Developer' WHEN 1 THEN 'Python Engineer' WHEN 2 THEN 'Data Analyst' WHEN 3 THEN 'Platform Engineer' ELSE 'Product Manager' END) AS title,
  concat('Company ', CAST(p.p_partkey % 97 AS VARCHAR(20))) AS company,
  CASE s.s_nationkey % 6 WHEN 0 THEN 'Berlin, Germany' WHEN 1 THEN 'Bengaluru, India' WHEN 2 THEN 'Remote' WHEN 3 THEN 'London, United Kingdom' WHEN 4 THEN 'Remote, Europe' ELSE '' END AS location,
  CASE p.p_partkey % 4 WHEN 0 THEN 'remoteok' WHEN 1 THEN 'hn' WHEN 2 THEN 'muse' ELSE 'lever' END AS source,
  concat('https://jobs.example.com/', CAST(p.p_partkey % 1500 AS VARCHAR(20)), CASE WHEN p.p_partkey % 3 = 0 THEN '/' ELSE '' END) AS url,
  concat(CASE WHEN p.p_size % 3 = 0 THEN 'Minimum ' ELSE 'Requires ' END, CAST(p.p_size % 12 + 1 AS VARCHAR(20)), CASE WHEN p.p_size % 2 = 0 THEN '+' ELSE '' END, ' years of experience with ',
         CASE p.p_partkey % 4 WHEN 0 THEN 'java and kafka and spring' WHEN 1 THEN 'python and sql' WHEN 2 THEN 'sql and excel' ELSE 'kubernetes and docker and java' END, '. ', p.p_name, ' ', p.p_type) AS description,
  concat(CASE p.p_partkey % 4 WHEN 0 THEN 'java,backend' WHEN 1 THEN 'python,data' WHEN 2 THEN 'sql' ELSE 'devops' END) AS tags,
  CAST(CASE WHEN p.p_size % 5 = 0 THEN NULL ELSE p.p_size % 12 END AS INTEGER) AS years,
  CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE CAST(o.o_orderdate AS TIMESTAMP) END AS posted,
  CAST(o.o_orderdate AS TIMESTAMP) AS scraped,
  CAST(p.p_retailprice AS DOUBLE) AS price
FROM part p
JOIN supplier s ON s.s_suppkey = p.p_partkey % (SELECT count(*) FROM supplier) + 1
LEFT JOIN orders o ON o.o_orderkey = p.p_partkey
"""

#: One match for each order of the first customers' segment: scores by the order's numbers, status by its priority.
MATCHES = """
SELECT o.o_orderkey AS match_id, o.o_custkey AS resume_id, o.o_orderkey % (SELECT count(*) FROM part) + 1 AS job_id,
  CAST(CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE (o.o_orderkey * 7) % 100 END AS DOUBLE) AS total,
  CAST((o.o_orderkey * 3) % 101 AS DOUBLE) AS ats, CAST((o.o_orderkey * 5) % 101 AS DOUBLE) AS semantic, CAST((o.o_orderkey * 11) % 101 AS DOUBLE) AS experience, CAST((o.o_orderkey * 17) % 101 AS DOUBLE) AS freshness,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'saved' WHEN 1 THEN 'applied' WHEN 2 THEN 'rejected' WHEN 3 THEN 'hidden' ELSE 'new' END AS status
FROM orders o
"""


def _frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    from ..session import table

    names = ("part", "supplier", "orders")
    return spark.sql("".join(("WITH ", ", ".join(f"{n} AS (SELECT * FROM {{{n}}})" for n in names), sql)), **{n: table(spark, sf_dir, n) for n in names})


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, POSTINGS)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, MATCHES)


def with_postings(body: str) -> str:
    return f"WITH postings AS ({POSTINGS}), matches AS ({MATCHES}) {body}"
