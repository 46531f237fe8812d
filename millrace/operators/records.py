"""Queries over raw records of a bulk dump, made from postings as JSON text; oracles work on the postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import features as X
from millrace.functions import records as R
from millrace.functions import text as T
from millrace.operators.postings import q_key
from millrace.plans.views import ctes, view
from millrace.registry import query

#: JSON of a record; a name that says `null` counts as said, but not as an industry. Salaries come by the hour, month or year, as a range, one amount, text or not at all.
_RAW = """concat('{"source":"board_', lower(substr(nation, 1, 2)), '","idInSource":"', CAST(job_id AS STRING), '","_id":{"$oid":"', CAST(job_id AS STRING), '"},"name":"', CASE job_id % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN '' ELSE title END,
  '","alt":[{"x":{"jobTitle":"', title, '"}}],"orgCompany":{"name":"', company, '","urls":{"url":"https://c', CAST(job_id % 97 AS STRING), '.com","sameAs":["www.c', CAST(job_id % 97 AS STRING), '.org","https://c', CAST(job_id % 97 AS STRING), '.com"]}},"orgAddress":{"addressLine":"', location, '"}',
  ',"salary":{', CASE job_id % 5 WHEN 0 THEN '"text":"$30 - $45 per hour"' WHEN 1 THEN '"value":{"$numberInt":"4000"},"period":"monthly"' WHEN 2 THEN '"text":"competitive"' ELSE '' END, '}',
  ',"json":{"schemaOrg":{"skills":["', replace(extracted_skills, '|', '","'), '"],"industry":{"name":"', CASE job_id % 3 WHEN 0 THEN 'Software, Data' ELSE 'null' END, '"}', CASE job_id % 5 WHEN 3 THEN ',"baseSalary":{"currency":"USD","value":{"minValue":150000,"maxValue":120000.5,"unitText":"YEAR"}}' WHEN 4 THEN ',"baseSalary":{"currency":"USD","value":90000}' ELSE '' END, '}}',
  ',"orgTags":{"SKILLS":["Python","', CASE job_id % 4 WHEN 1 THEN 'SQL' ELSE 'n/a' END, '"],"CATEGORIES":["', region, '"]', CASE job_id % 2 WHEN 0 THEN ',"KEYWORDS":["etl;batch","ETL"]' ELSE '' END, '}}')"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "postings").select("job_id", F.expr(_RAW).alias("line"))


def bulk(lines: DataFrame) -> DataFrame:
    """ING-01: canonical columns of a record's line."""
    line = F.col("line")
    listed = lambda path: F.array_join(R.items(R.at(line, path)), "|")
    rows = lines.select(
        "job_id", T.stable_hash(F.concat_ws("|", F.lit("kaggle"), R.at(line, "source"), R.at(line, "idInSource")), 24).alias("record_id"), R.at(line, "_id").alias("oid"), R.title(R.at(line, "name"), R.find(line, "jobTitle", "job_title")).alias("t"),
        T.clean(R.at(line, "orgCompany.name")).alias("company"), R.urls(R.at(line, "orgCompany.urls")).alias("company_urls"), T.clean(R.at(line, "orgAddress.addressLine")).alias("location"), R.salary(line).alias("salary"),
        listed("orgTags.SKILLS").alias("raw_skills"), listed("json.schemaOrg.skills").alias("schema_org_skills"), listed("json.schemaOrg.industry").alias("schema_org_industry"), listed("orgTags.CATEGORIES").alias("raw_categories"), listed("orgTags.KEYWORDS").alias("raw_keywords"),
    )
    named = {n: F.col(n) for n in ("raw_skills", "schema_org_skills", "schema_org_industry", "raw_keywords", "raw_categories")}
    parsed = F.array_join(X.skills(F.col("t.title"), F.lit("")), "|")
    return rows.withColumn("parsed", parsed).withColumn("s", R.signal_sources(named, F.col("parsed")))


_SAL_LOW = "CASE job_id % 5 WHEN 0 THEN 62400.0 WHEN 1 THEN 48000.0 WHEN 3 THEN 120000.5 WHEN 4 THEN 90000.0 END"
_SAL_HIGH = "CASE job_id % 5 WHEN 0 THEN 93600.0 WHEN 1 THEN 48000.0 WHEN 3 THEN 150000.0 WHEN 4 THEN 90000.0 END"


@query("records_bulk", ctes("postings") + f"""
SELECT job_id, substr(sha256('kaggle|board_' || lower(substr(nation, 1, 2)) || '|' || job_id), 1, 24) AS record_id, title, job_id % 6 IN (0, 1) AS repaired, company, 'https://c' || (job_id % 97) || '.com|www.c' || (job_id % 97) || '.org' AS company_urls, location,
  {_SAL_LOW} AS low, {_SAL_HIGH} AS high, CASE job_id % 5 WHEN 0 THEN 'source_salary_text' WHEN 1 THEN 'source_salary_annualized_from_month' WHEN 2 THEN '' ELSE 'source_salary' END AS method FROM postings
""")  # fmt: skip
def records_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ING-01, TXT-06, TXT-07, TXT-11, FEA-09 to FEA-12, FEA-15: a bulk record's columns, title repaired, salary by the year."""
    return bulk(raw(spark, sf_dir)).select("job_id", "record_id", "t.title", "t.repaired", "company", "company_urls", "location", "salary.low", "salary.high", "salary.method")


_PARSED = f"contains(' ' || {q_key('title')} || ' ', ' machine learning ')"


@query("records_signals", ctes("postings") + f"""
SELECT job_id, CASE job_id % 4 WHEN 0 THEN 'Python|sql|spark' WHEN 1 THEN 'Python|SQL|tableau' WHEN 2 THEN 'Python|pytorch|kafka' ELSE 'Python' END || CASE WHEN {_PARSED} THEN '|machine learning' WHEN contains(title, 'MLOps') THEN '|mlops' ELSE '' END AS skills,
  CASE job_id % 3 WHEN 0 THEN 'Software|Data|' ELSE '' END || region AS industries, CASE job_id % 2 WHEN 0 THEN 'etl|batch' ELSE '' END AS keywords,
  concat_ws('|', 'raw_skills', CASE WHEN job_id % 4 <> 3 THEN 'schema_org_skills' END, 'schema_org_industry', CASE WHEN job_id % 2 = 0 THEN 'raw_keywords' END, 'raw_categories', CASE WHEN {_PARSED} OR contains(title, 'MLOps') THEN 'parser_fallback' END) AS sources,
  CASE WHEN 3 + (job_id % 4 <> 3)::INT + (job_id % 2 = 0)::INT >= 5 THEN 'high' WHEN 3 + (job_id % 4 <> 3)::INT + (job_id % 2 = 0)::INT >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM postings
""")  # fmt: skip
def records_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-13, FEA-14, TXT-07: lists of signals from all fields, which fields spoke, and how far to trust that."""
    c = F.col
    return bulk(raw(spark, sf_dir)).select(
        "job_id", R.piped(50, c("raw_skills"), c("schema_org_skills"), c("parsed")).alias("skills"), R.piped(30, c("schema_org_industry"), c("raw_categories")).alias("industries"), R.piped(60, c("raw_keywords")).alias("keywords"), "s.sources", "s.confidence",
    )
