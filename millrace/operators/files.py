"""Queries that write, read again and compare: CSV scans, manifests, exports, payloads, sessions and vector caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.selection import shared
from millrace.plans.views import ctes, table, view
from millrace.registry import query
from millrace.sources import sinks

_NARROW = ("job_id", "title", "company", "location")


def _home(spark: SparkSession) -> str:
    return f"{shared(spark)}/files-{uuid.uuid4().hex}"


@query("files_csv_scan", ctes("postings") + "SELECT job_id, title, company, location, (SELECT count(*) FROM postings) AS written FROM postings ORDER BY job_id LIMIT 500 OFFSET 100")
def files_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03, SRC-05, SRC-06: written as CSV, then rows 101 to 600 of it."""
    home = _home(spark)
    n = sinks.write_csv(view(spark, sf_dir, "postings"), home, list(_NARROW))
    return sinks.scan_csv(spark, home, "job_id long, title string, company string, location string", order="job_id", offset=100, limit=500).withColumn("written", F.lit(n))


@query("files_manifest_lookup", ctes("postings") + "SELECT job_id AS line_no, title, job_id % 101 AS score FROM postings WHERE job_id % 7 = 0 AND job_id <= (SELECT max(job_id) // 2 FROM postings)")
def files_manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07: lines named by a manifest, looked up by their number, never by position."""
    raw = view(spark, sf_dir, "postings").select(F.col("job_id").alias("line_no"), "title")
    half = raw.agg(F.floor(F.max("line_no") / 2)).first()[0]
    manifest = raw.where((F.col("line_no") % 7 == 0) & (F.col("line_no") <= half)).select("line_no", (F.col("line_no") % 101).alias("score"))
    return sinks.by_line(raw, manifest)


@query("files_frozen_export", ctes("postings") + "SELECT job_id, title, company FROM postings")
def files_frozen_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-21: exported as JSON lines without the private column, and read again."""
    home = _home(spark)
    sinks.frozen(view(spark, sf_dir, "postings").select("job_id", "title", "company", F.col("description_text").alias("raw_payload_json_private")), home, ("raw_payload_json_private",))
    return spark.read.json(home, schema="job_id long, title string, company string, raw_payload_json_private string").where("raw_payload_json_private is null").drop("raw_payload_json_private")


@query("files_payloads", ctes("postings") + "SELECT CASE WHEN job_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider, job_id % 5 AS query, count(*) AS n, CAST(sum(length(title)) AS BIGINT) AS chars FROM postings GROUP BY 1, 2")
def files_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-28, SRC-11: raw payloads in folders by provider and query, and what is in each."""
    home = _home(spark)
    p = view(spark, sf_dir, "postings").select(F.when(F.col("job_id") % 2 == 0, "a").otherwise("b").alias("provider"), (F.col("job_id") % 5).alias("query"), "job_id", "title")
    p.write.partitionBy("provider", "query").json(home)
    back = spark.read.json(home, schema="job_id long, title string, provider string, query long")
    return back.groupBy("provider", "query").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("title")).cast("long").alias("chars"))


@query("files_company_cache", ctes("postings") + """
, o AS (SELECT company, count(*) AS jobs FROM postings WHERE job_id % 2 = 0 GROUP BY 1), n AS (SELECT company, count(*) AS jobs, max(location) AS place FROM postings WHERE job_id % 3 = 0 GROUP BY 1)
SELECT company, coalesce(n.jobs, o.jobs) AS jobs, place FROM o FULL JOIN n USING (company)
""")  # fmt: skip
def files_company_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19, SRC-30, SRC-31: a table replaced in full, then merged with newer rows that have one more column."""
    home = _home(spark)
    p = view(spark, sf_dir, "postings")
    for part in (p.where("job_id % 5 = 0"), p.where("job_id % 2 = 0")):  # the second load replaces the first
        part.groupBy("company").agg(F.count(F.lit(1)).alias("jobs")).write.mode("overwrite").parquet(home)
    newer = p.where("job_id % 3 = 0").groupBy("company").agg(F.count(F.lit(1)).alias("jobs"), F.max("location").alias("place"))
    return sinks.merged(spark.read.parquet(home), newer, "company")


@query("files_vector_cache", "SELECT vec_id, len(embedding) AS size FROM embeddings")
def files_vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-22: vectors written with a fingerprint, and loaded after it was checked."""
    home = _home(spark)
    sinks.write_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), home, "given")
    return sinks.load_vectors(spark, home, "given").select("vec_id", F.size("embedding").cast("long").alias("size"))
