"""Disclosure filings: latest record a case, rolling windows at two grains, joins to postings, company tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import features as X
from millrace.functions import rules as R
from millrace.functions import text as T
from millrace.operators.postings import _q_employer, q_clean, q_key
from millrace.plans.views import ctes, view
from millrace.registry import query

#: Windows, as quarters back from the last decision date.
WINDOWS = {"latest_2q": 2, "recent_3q": 3, "historical_8q": 8}


def latest_per_case(filings: DataFrame) -> DataFrame:
    """The record with the latest decision of each case. Ties are broken by the whole record, so reruns agree."""
    order = ["decision_date", *sorted(c for c in filings.columns if c != "decision_date")]
    return filings.groupBy("case_number").agg(F.max(F.struct(*order)).alias("r")).select("r.*")


def keyed(filings: DataFrame) -> DataFrame:
    return filings.select(
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("case_number"), X.employer_key(F.col("employer_name")).alias("employer_key"), "employer_name",
        X.filing_family(F.col("job_title"), F.col("soc_code")).alias("role_family"), T.key(F.col("case_status")).alias("status"), "decision_date", "positions",
    )


def windowed(records: DataFrame, as_of) -> DataFrame:
    """Seven measures in each window, by (employer, role) and by employer, in one pass over the records."""
    certified, either = F.col("status") == "certified", F.col("status").isin("certified", "certified withdrawn")
    aggs = []
    for name, quarters in WINDOWS.items():
        inside = (F.col("decision_date") > F.add_months(F.lit(as_of), -3 * quarters)) & (F.col("decision_date") <= F.lit(as_of))
        for what, cond in (("", F.lit(True)), ("certified_", certified), ("certified_or_withdrawn_", either)):
            aggs += [F.count_if(inside & cond).alias(f"{name}_{what}case_count"), F.coalesce(F.sum(F.when(inside & cond, F.col("positions"))), F.lit(0)).alias(f"{name}_{what}positions")]
        aggs.append(F.count_if(inside & (F.col("status") == "denied")).alias(f"{name}_denied_case_count"))
    sets = records.groupingSets([[F.col("employer_key"), F.col("role_family")], [F.col("employer_key")]], "employer_key", "role_family")
    out = sets.agg(F.grouping("role_family").alias("whole"), *aggs, F.max("decision_date").alias("latest"), F.count(F.lit(1)).alias("cases"))
    return out.withColumn("role_family", F.when(F.col("whole") == 1, "all").otherwise(F.col("role_family"))).drop("whole")


def label() -> Column:
    c = F.col
    return (
        F.when((c("recent_3q_certified_case_count") >= 10) | (c("recent_3q_certified_positions") >= 25), "recent_lca_activity_high")
        .when((c("recent_3q_certified_case_count") >= 3) | (c("recent_3q_certified_positions") >= 5), "recent_lca_activity_moderate")
        .when((c("recent_3q_certified_case_count") > 0) | (c("recent_3q_certified_positions") > 0), "recent_lca_activity_low")
        .when(c("recent_3q_case_count") > 0, "recent_lca_activity_no_certified_cases")
        .when(c("historical_8q_case_count") > 0, "historical_lca_activity_only")
        .otherwise("no_lca_activity_in_cache")
    )


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = latest_per_case(keyed(view(spark, sf_dir, "disclosures")))
    as_of = records.agg(F.max("decision_date")).first()[0]
    return windowed(records, as_of).withColumn("label", label())


def _q_has(k: str, words) -> str:
    return "(" + " OR ".join(f"contains(' ' || {k} || ' ', ' {w} ')" for w in words) + ")"


_FAMILY = "CASE " + " ".join(f"WHEN {_q_has('tk', words)} THEN '{name}'" for name, words in R.FILING_FAMILIES) + " " + " ".join("WHEN " + " OR ".join(f"starts_with(soc_code, '{h}')" for h in heads) + f" THEN '{name}'" for name, heads in R.FILING_CODES) + " ELSE 'other' END"


def _q_window(name: str, quarters: int) -> str:
    inside = f"decision_date > (as_of - INTERVAL {3 * quarters} MONTH)::DATE AND decision_date <= as_of"
    parts = []
    for what, cond in (("", "true"), ("certified_", "status = 'certified'"), ("certified_or_withdrawn_", "status IN ('certified', 'certified withdrawn')")):
        parts += [f"count(*) FILTER (WHERE {inside} AND {cond}) AS {name}_{what}case_count", f"CAST(coalesce(sum(positions) FILTER (WHERE {inside} AND {cond}), 0) AS BIGINT) AS {name}_{what}positions"]
    return ", ".join([*parts, f"count(*) FILTER (WHERE {inside} AND status = 'denied') AS {name}_denied_case_count"])


_FILED = f"""
, k0 AS (SELECT l_orderkey || '-' || l_linenumber AS case_number, {_q_employer('employer_name')} AS employer_key, employer_name, {q_key('job_title')} AS tk, soc_code, {q_key('case_status')} AS status, decision_date, positions FROM disclosures),
k1 AS (SELECT case_number, employer_key, employer_name, {_FAMILY} AS role_family, status, decision_date, positions FROM k0),
k AS (SELECT * FROM k1 QUALIFY row_number() OVER (PARTITION BY case_number ORDER BY decision_date DESC, case_number DESC, employer_key DESC, employer_name DESC, positions DESC, role_family DESC, status DESC) = 1),
a AS (SELECT max(decision_date) AS as_of FROM k),
w AS (SELECT employer_key, CASE WHEN grouping(role_family) = 1 THEN 'all' ELSE role_family END AS role_family, {', '.join(_q_window(n, q) for n, q in WINDOWS.items())}, max(decision_date) AS latest, count(*) AS cases
  FROM k CROSS JOIN a GROUP BY GROUPING SETS ((employer_key, role_family), (employer_key))),
s AS (SELECT *, CASE WHEN recent_3q_certified_case_count >= 10 OR recent_3q_certified_positions >= 25 THEN 'recent_lca_activity_high' WHEN recent_3q_certified_case_count >= 3 OR recent_3q_certified_positions >= 5 THEN 'recent_lca_activity_moderate'
  WHEN recent_3q_certified_case_count > 0 OR recent_3q_certified_positions > 0 THEN 'recent_lca_activity_low' WHEN recent_3q_case_count > 0 THEN 'recent_lca_activity_no_certified_cases' WHEN historical_8q_case_count > 0 THEN 'historical_lca_activity_only' ELSE 'no_lca_activity_in_cache' END AS label FROM w)
"""


@query("filings_latest_per_case", ctes("disclosures") + _FILED + "SELECT case_number, employer_key, role_family, status, decision_date, positions FROM k")
def filings_latest_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-06, FEA-20, FEA-26, FEA-27, SRC-29."""
    return latest_per_case(keyed(view(spark, sf_dir, "disclosures"))).select("case_number", "employer_key", "role_family", "status", "decision_date", "positions")


@query("filings_windows", ctes("disclosures") + _FILED + "SELECT * FROM s")
def filings_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12, AGG-13, SID-13, STR-05."""
    return summary(spark, sf_dir)


@query("filings_employer_names", ctes("disclosures") + _FILED + """
, n AS (SELECT employer_key, employer_name, count(*) AS n FROM k GROUP BY 1, 2)
SELECT k.employer_key, arg_max(n.employer_name, n.n * 1000000 - length(n.employer_name)) AS display, count(DISTINCT k.case_number) AS cases, array_to_string(list_sort(list_distinct(list(k.status))), '|') AS statuses FROM k JOIN n ON n.employer_key = k.employer_key GROUP BY 1
""")  # fmt: skip
def filings_employer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: the commonest spelling of an employer (the shorter on ties), its cases and its statuses."""
    k = latest_per_case(keyed(view(spark, sf_dir, "disclosures")))
    n = k.groupBy("employer_key", "employer_name", "status").agg(F.count(F.lit(1)).alias("n"))
    names = n.groupBy("employer_key", "employer_name").agg(F.sum("n").alias("n"), F.collect_set("status").alias("s"))
    by = names.groupBy("employer_key").agg(F.max_by("employer_name", F.col("n") * 1000000 - F.length("employer_name")).alias("display"), F.sum("n").alias("cases"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
    return by.select("employer_key", "display", "cases", F.array_join("s", "|").alias("statuses"))


@query("filings_top", ctes("disclosures") + _FILED + "SELECT employer_key, role_family, historical_8q_certified_case_count AS certified, historical_8q_certified_positions AS positions FROM s WHERE role_family <> 'all' ORDER BY certified DESC, positions DESC, employer_key, role_family LIMIT 20")
def filings_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15."""
    s = summary(spark, sf_dir).where("role_family <> 'all'").select("employer_key", "role_family", F.col("historical_8q_certified_case_count").alias("certified"), F.col("historical_8q_certified_positions").alias("positions"))
    return s.orderBy(F.desc("certified"), F.desc("positions"), "employer_key", "role_family").limit(20)


_JOINED = """
, emp AS (SELECT DISTINCT employer_key, row_number() OVER (ORDER BY employer_key) - 1 AS n FROM (SELECT DISTINCT employer_key FROM s)),
p AS (SELECT job_id, e.employer_key, CASE WHEN job_id % 2 = 0 THEN 'data_engineering' WHEN job_id % 3 = 0 THEN 'ml_ai' ELSE 'nothing' END AS role_family FROM postings LEFT JOIN emp e ON e.n = job_id % 37),
j AS (SELECT p.job_id, p.employer_key, p.role_family, CASE WHEN r.label IS NOT NULL THEN 'role_family' WHEN a.label IS NOT NULL THEN 'employer_only' ELSE 'none' END AS scope, coalesce(r.label, a.label, 'no_lca_activity_in_cache') AS label
  FROM p LEFT JOIN s r ON r.employer_key = p.employer_key AND r.role_family = p.role_family LEFT JOIN s a ON a.employer_key = p.employer_key AND a.role_family = 'all')
"""


def posting_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary(spark, sf_dir).select("employer_key", "role_family", "label")
    names = s.select("employer_key").distinct()
    emp = names.withColumn("n", F.row_number().over(Window.orderBy("employer_key")) - 1)
    family = F.when(F.col("job_id") % 2 == 0, "data_engineering").when(F.col("job_id") % 3 == 0, "ml_ai").otherwise("nothing")
    p = view(spark, sf_dir, "postings").select("job_id", (F.col("job_id") % 37).alias("n"), family.alias("role_family")).join(emp, "n", "left")
    role, whole = s.withColumnRenamed("label", "role_label"), s.where("role_family = 'all'").select("employer_key", F.col("label").alias("whole_label"))
    j = p.join(role, ["employer_key", "role_family"], "left").join(whole, "employer_key", "left")
    scope = F.when(F.col("role_label").isNotNull(), "role_family").when(F.col("whole_label").isNotNull(), "employer_only").otherwise("none")
    return j.select("job_id", "employer_key", "role_family", scope.alias("scope"), F.coalesce("role_label", "whole_label", F.lit("no_lca_activity_in_cache")).alias("label"))


@query("filings_joined_to_postings", ctes("disclosures", "postings") + _FILED + _JOINED + "SELECT * FROM j")
def filings_joined_to_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-02, SID-14: by employer and role, else by employer, else none."""
    return posting_evidence(spark, sf_dir)


@query("filings_coverage", ctes("disclosures", "postings") + _FILED + _JOINED + "SELECT scope, label, count(*) AS n FROM j GROUP BY 1, 2")
def filings_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17."""
    return posting_evidence(spark, sf_dir).groupBy("scope", "label").agg(F.count(F.lit(1)).alias("n"))


# --- companies: universe, evidence, current

_COMPANY = f"""
, u AS (SELECT {_q_employer('company')} AS company_key, count(*) AS postings FROM postings GROUP BY 1),
e AS (SELECT {_q_employer('company')} AS company_key, job_id AS evidence_id, CASE job_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, (job_id % 100) / 100.0 AS score, posted_at AS observed_at, (job_id % 5000) AS employees, job_id % 4 <> 0 AS accepted FROM postings),
b AS (SELECT * FROM e WHERE accepted QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, score DESC, observed_at DESC, evidence_id) = 1)
"""
_BUCKET = "CASE WHEN employees IS NULL OR employees = 0 THEN 'unknown' WHEN employees <= 10 THEN '1-10' WHEN employees <= 50 THEN '11-50' WHEN employees <= 200 THEN '51-200' WHEN employees <= 500 THEN '201-500' WHEN employees <= 1000 THEN '501-1000' WHEN employees <= 5000 THEN '1001-5000' WHEN employees <= 10000 THEN '5001-10000' ELSE '10001+' END"


def size_bucket(n: Column) -> Column:
    edges = ((10, "1-10"), (50, "11-50"), (200, "51-200"), (500, "201-500"), (1000, "501-1000"), (5000, "1001-5000"), (10000, "5001-10000"))
    start = F.when(n.isNull() | (n == 0), "unknown")
    return reduce(lambda w, e: w.when(n <= e[0], e[1]), edges, start).otherwise("10001+")


@query("company_current", ctes("postings") + _COMPANY + f"SELECT u.company_key, u.postings, b.evidence_id, coalesce(b.confidence, 'none') AS confidence, {_BUCKET} AS size_bucket, b.observed_at + INTERVAL 180 DAY AS stale_at FROM u LEFT JOIN b ON b.company_key = u.company_key")
def company_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-03, JON-05, SID-15, FEA-28, AGG-34: the best accepted evidence of each company, or none."""
    p = view(spark, sf_dir, "postings").withColumn("company_key", X.employer_key(F.col("company")))
    u = p.groupBy("company_key").agg(F.count(F.lit(1)).alias("postings"))
    third = F.col("job_id") % 3
    level = F.when(third == 0, 3).when(third == 1, 2).otherwise(1)
    best = F.max(F.struct(level.alias("level"), ((F.col("job_id") % 100) / 100.0).alias("score"), F.col("posted_at").alias("observed_at"), (-F.col("job_id")).alias("minus_id")))
    b = p.where(F.col("job_id") % 4 != 0).groupBy("company_key").agg(best.alias("b"))
    j = u.join(b, "company_key", "left")
    conf = F.when(F.col("b.level") == 3, "high").when(F.col("b.level") == 2, "medium").when(F.col("b.level") == 1, "low").otherwise("none")
    eid = -F.col("b.minus_id")
    return j.select("company_key", "postings", eid.alias("evidence_id"), conf.alias("confidence"), size_bucket(eid % 5000).alias("size_bucket"), F.date_add("b.observed_at", 180).cast("timestamp").alias("stale_at"))


@query("company_evidence_append", ctes("postings") + f"""
, e AS (SELECT job_id, substr(sha256({q_clean("company || '|' || title")}), 1, 20) AS evidence_id FROM postings), old AS (SELECT DISTINCT evidence_id FROM e WHERE job_id % 2 = 0)
SELECT evidence_id, min(job_id) AS job_id FROM e WHERE job_id % 2 = 1 AND evidence_id NOT IN (SELECT evidence_id FROM old) GROUP BY 1
""")  # fmt: skip
def company_evidence_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20: what an insert that ignores known ids adds."""
    e = view(spark, sf_dir, "postings").select("job_id", T.stable_hash(F.concat_ws("|", "company", "title"), 20).alias("evidence_id"))
    return e.where("job_id % 2 = 1").join(e.where("job_id % 2 = 0"), "evidence_id", "left_anti").groupBy("evidence_id").agg(F.min("job_id").alias("job_id"))


@query("company_candidates", ctes("postings") + _COMPANY + "SELECT b.company_key, b.evidence_id, u.postings FROM b JOIN u ON u.company_key = b.company_key WHERE b.confidence IN ('high', 'medium') ORDER BY u.postings DESC, b.company_key LIMIT 40")
def company_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-04, SID-16."""
    return company_current(spark, sf_dir).where(F.col("confidence").isin("high", "medium")).orderBy(F.desc("postings"), "company_key").limit(40).select("company_key", "evidence_id", "postings")
