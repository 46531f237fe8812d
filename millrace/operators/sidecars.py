"""Sidecar tables: policies, validation, nested lookups, segments, a learned additive score, simulated feedback."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import features as X
from millrace.functions import rules as R
from millrace.functions import text as T
from millrace.operators.filings import _FILED, summary
from millrace.operators.postings import _q_families, q_key
from millrace.operators.ranking import _BASE, _ORDER, base_order, ranked
from millrace.plans.views import ctes, table, view
from millrace.registry import query

POLICY = "VALUES ('python', 'core', true), ('sql', 'core', true), ('spark', 'platform', true), ('kafka', 'platform', false), ('tableau', 'reporting', true)"


@query("skill_readiness", ctes("postings") + f"""
, pol(skill, category, ready) AS ({POLICY}), s AS (SELECT job_id, unnest(string_split(extracted_skills, '|')) AS skill FROM postings)
SELECT coalesce(pol.category, 'unmapped') AS category, coalesce(pol.ready, false) AS ready, count(*) AS n, count(DISTINCT job_id) AS jobs FROM s LEFT JOIN pol ON pol.skill = s.skill WHERE s.skill <> '' GROUP BY 1, 2
""")  # fmt: skip
def skill_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-30 to FEA-32, AGG-35: terms by the policy of a dictionary table."""
    policy = spark.sql(f"SELECT * FROM ({POLICY}) AS t(skill, category, ready)")
    s = view(spark, sf_dir, "postings").select("job_id", F.explode(T.split_list(F.col("extracted_skills"))).alias("skill"))
    j = s.join(F.broadcast(policy), "skill", "left")  # a literal of five rows
    return j.groupBy(F.coalesce("category", F.lit("unmapped")).alias("category"), F.coalesce("ready", F.lit(False)).alias("ready")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("jobs"))


@query("sidecar_validation", ctes("postings") + """
, side AS (SELECT job_id, source FROM postings WHERE job_id % 5 <> 0 UNION ALL SELECT job_id, source FROM postings WHERE job_id % 100 = 1 UNION ALL SELECT -job_id - 1, source FROM postings WHERE job_id % 200 = 0)
SELECT (SELECT count(*) FROM side) AS n, (SELECT count(*) FROM (SELECT job_id FROM side GROUP BY 1 HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM postings WHERE job_id NOT IN (SELECT job_id FROM side)) AS missing,
  (SELECT count(DISTINCT job_id) FROM side WHERE job_id NOT IN (SELECT job_id FROM postings)) AS unknown
""")  # fmt: skip
def sidecar_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SID-08, SID-09, SID-11, SID-12, SID-21, JON-07, DED-09: repeated, missing and unknown keys of a sidecar."""
    p = view(spark, sf_dir, "postings").select("job_id")
    extra = p.where("job_id % 200 = 0").select((-F.col("job_id") - 1).alias("job_id"))
    side = p.where("job_id % 5 <> 0").union(p.where("job_id % 100 = 1")).union(extra)
    by = side.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    both = p.withColumn("here", F.lit(1)).join(by, "job_id", "full")
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("here").isNull()).alias("unknown"),
    )


@query("filings_lookup", ctes("disclosures") + _FILED + "SELECT employer_key, array_to_string(list(role_family || '=' || label ORDER BY role_family), '|') AS roles FROM s WHERE role_family <> 'all' GROUP BY 1")
def filings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16: an employer's roles in one row; there are as many roles as the rules have families."""
    s = summary(spark, sf_dir).where("role_family <> 'all'")
    by = s.groupBy("employer_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role_family", "label")))).alias("m"))
    return by.select("employer_key", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("roles"))


@query("market_segments", ctes("postings") + f"""
, t AS (SELECT job_id, company, salary_min, {_q_families(q_key('title'), R.TITLE_FAMILIES)} AS f FROM postings), s AS (SELECT job_id, company, salary_min, unnest(string_split(f, '|')) AS segment FROM t)
SELECT segment, count(*) AS n, round(count(*) / (SELECT count(*) FROM postings), 6) AS share, count(DISTINCT company) AS companies, round(median(salary_min), 4) AS median_salary FROM s WHERE segment <> '' GROUP BY 1
""")  # fmt: skip
def market_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-35 to FEA-37, AGG-08, AGG-09, JON-14: a posting counts in each of its segments."""
    p = view(spark, sf_dir, "postings")
    total = p.agg(F.count(F.lit(1)).alias("total"))
    s = p.select("company", "salary_min", F.explode(X.families(F.col("title"), R.TITLE_FAMILIES)).alias("segment"))
    by = s.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("company").alias("companies"), F.round(F.percentile("salary_min", F.lit(0.5)), 4).alias("median_salary"))
    return by.crossJoin(F.broadcast(total)).select("segment", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "companies", "median_salary")


@query("additive_effects", ctes("postings") + """
, r AS (SELECT salary_max / 100000.0 AS y, CAST(floor(coalesce(years_required, 0) / 3) AS INT) AS a, company_type AS b FROM postings WHERE salary_max IS NOT NULL), m AS (SELECT avg(y) AS m FROM r),
e1 AS (SELECT a, avg(y - m) AS e FROM r CROSS JOIN m GROUP BY a), e2 AS (SELECT b, avg(y - m - e1.e) AS e FROM r CROSS JOIN m JOIN e1 ON e1.a = r.a GROUP BY b)
SELECT 'years' AS feature, CAST(a AS VARCHAR) AS bin, round(e, 6) AS effect FROM e1 UNION ALL SELECT 'company_type', b, round(e, 6) FROM e2
""")  # fmt: skip
def additive_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-33: one cycle over two features' bins, each fitted to what the other leaves; no row is scored."""
    r = view(spark, sf_dir, "postings").where("salary_max is not null").select((F.col("salary_max") / 100000.0).alias("y"), F.floor(F.coalesce("years_required", F.lit(0)) / 3).cast("int").alias("a"), F.col("company_type").alias("b"))
    r = r.crossJoin(F.broadcast(r.agg(F.avg("y").alias("m"))))
    e1 = r.groupBy("a").agg(F.avg(F.col("y") - F.col("m")).alias("e"))  # a row a bin
    e2 = r.join(F.broadcast(e1), "a").groupBy("b").agg(F.avg(F.col("y") - F.col("m") - F.col("e")).alias("e"))
    one = lambda e, name, c: e.select(F.lit(name).alias("feature"), F.col(c).cast("string").alias("bin"), F.round("e", 6).alias("effect"))
    return one(e1, "years", "a").unionByName(one(e2, "company_type", "b"))


@query("feedback_simulation", _BASE + f"""
, t AS (SELECT profile_id, job_id, len(matched) AS k, row_number() OVER ({_ORDER}) AS spot FROM ranked WHERE violations = '' QUALIFY spot <= 30),
a AS (SELECT *, CASE WHEN k >= 2 AND row_number() OVER (PARTITION BY profile_id, k >= 2 ORDER BY spot) <= 3 THEN 'accept' WHEN k = 0 AND row_number() OVER (PARTITION BY profile_id, k = 0 ORDER BY spot) <= 2 THEN 'reject' ELSE 'skip' END AS action FROM t)
SELECT profile_id, action, count(*) AS n, min(spot) AS first FROM a GROUP BY 1, 2
""")  # fmt: skip
def feedback_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-27, RNK-28: the first three good postings are accepted, the first two poor ones rejected, others skipped."""
    t = ranked(spark, sf_dir).where(F.size("violations") == 0).withColumn("spot", F.row_number().over(base_order())).where("spot <= 30").withColumn("k", F.size("matched"))
    nth = lambda cond: F.row_number().over(Window.partitionBy("profile_id", cond).orderBy("spot"))
    good, poor = F.col("k") >= 2, F.col("k") == 0
    action = F.when(good & (nth(good) <= 3), "accept").when(poor & (nth(poor) <= 2), "reject").otherwise("skip")
    return t.select("profile_id", "spot", action.alias("action")).groupBy("profile_id", "action").agg(F.count(F.lit(1)).alias("n"), F.min("spot").alias("first"))


@query("cache_states", ctes("postings") + "SELECT sponsorship_signal AS status, company_type AS decision, count(*) AS n, min(posted_at) AS earliest, max(posted_at) AS latest FROM postings GROUP BY 1, 2")
def cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19, AGG-25, AGG-34."""
    return view(spark, sf_dir, "postings").groupBy(F.col("sponsorship_signal").alias("status"), F.col("company_type").alias("decision")).agg(F.count(F.lit(1)).alias("n"), F.min("posted_at").alias("earliest"), F.max("posted_at").alias("latest"))


@query("set_operations", ctes("postings") + """
SELECT job_id, array_to_string(list_sort(list_intersect(a, b)), '|') AS common, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|') AS only_left FROM
  (SELECT job_id, list_filter(string_split(extracted_skills, '|'), lambda x: x <> '') AS a, CASE WHEN job_id % 2 = 0 THEN ['python', 'sql'] ELSE ['kafka', 'tableau'] END AS b FROM postings)
""")  # fmt: skip
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-02 to SET-04, TXT-22."""
    a = T.split_list(F.col("extracted_skills"))
    b = F.when(F.col("job_id") % 2 == 0, F.array(F.lit("python"), F.lit("sql"))).otherwise(F.array(F.lit("kafka"), F.lit("tableau")))
    p = view(spark, sf_dir, "postings").select("job_id", a.alias("a"), b.alias("b"))
    return p.select("job_id", F.array_join(F.array_sort(F.array_intersect("a", "b")), "|").alias("common"), F.array_join(F.array_sort(F.array_except("a", "b")), "|").alias("only_left"))


@query("labels_joined", """
SELECT d.source, count(*) AS n, count(l.doc_id) AS labelled, CAST(sum(coalesce(l.quality, 0)) AS BIGINT) AS good, (SELECT count(*) FROM labels x WHERE x.doc_id NOT IN (SELECT doc_id FROM documents)) AS unmatched
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source
""")  # fmt: skip
def labels_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-08, JON-09, JON-15, AGG-30: left, semi and anti joins by id."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality", F.col("doc_id").alias("l"))
    away = lab.join(d, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))
    by = d.join(lab, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("l").alias("labelled"), F.sum(F.coalesce("quality", F.lit(0))).cast("long").alias("good"))
    return by.crossJoin(F.broadcast(away))


AUXILIARY = ("audition", "auditions", "survey", "surveys", "culture", "assessment", "assessments", "recruiting", "recruitment", "careers", "jobs")
BATCH = 25
EVIDENCE = """batch long, company long, item long, company_key string, observed_at string, provider string, provider_run_id string, input_mode string, input_value string, candidate_rank int,
    candidate_linkedin_company_id string, candidate_linkedin_universal_name string, candidate_name string, candidate_linkedin_url string, candidate_website string, candidate_website_domain string,
    candidate_employee_count string, candidate_industries_json string, match_features_json string, match_score double, confidence_label string, decision string, error_code string, error_message string,
    cost_units double, raw_payload_json_private string"""


def match_features(company: dict, item: dict) -> dict:
    """The features of a pair; *_key are normalised names, domain and domains are lowered hosts."""
    own, ck, dom, official = company["name_key"], item["name_key"], item["domain"], list(company["domains"])
    related = any(dom and d and (dom == d or dom.endswith("." + d) or d.endswith("." + dom)) for d in official)
    exact = bool(own and own in (ck, item["universal_key"]))
    apart = bool(official and dom and not related)
    auxiliary = apart and exact and all(any(t in d for t in AUXILIARY) for d in official)
    return {
        "input_name": company["name"], "input_company_key": company["company_key"], "candidate_name": item["name"], "candidate_universal_name": item["universal_name"], "candidate_domain": dom, "official_domains": official,
        "name_exact": exact, "name_contains": bool(own and ck and not exact and (own in ck or ck in own)), "domain_match": related, "domain_conflict": apart and not auxiliary, "auxiliary_domain_conflict": auxiliary,
        "has_linkedin_url": bool(item["linkedin_url"]), "has_employee_count": bool(item["employee_count"]), "has_industries": len(item["industries"]) > 0,
    }


def match_score(f: dict) -> float:
    score = 0.58 if f["name_exact"] else 0.35 if f["name_contains"] else 0.0
    score += 0.12 * f["has_linkedin_url"] + 0.08 * f["has_employee_count"] + 0.05 * f["has_industries"] + 0.17 * f["domain_match"] - 0.35 * f["domain_conflict"]
    return round(max(0.0, min(1.0, score)), 4)


def evidence_row(company: dict, item: dict | None, observed_at: str) -> dict:
    """SID-17: an item as a row of evidence on its company; without one, a row that says so."""
    import json

    dump = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True)
    row = {"batch": company["batch"], "company": company["company"], "company_key": company["company_key"], "observed_at": observed_at, "provider": "company_search", "provider_run_id": f"run-{company['batch']}", "input_mode": "searches", "input_value": company["name"], "candidate_rank": 1, "cost_units": 1.0}
    if item is None or not any(item[k] for k in ("name", "linkedin_url", "id", "universal_name")):
        return row | {"match_features_json": dump({"input_name": company["name"]}), "match_score": 0.0, "confidence_label": "none", "decision": "no_result", "error_code": "no_result", "error_message": "Provider returned no usable company item for this input.", "raw_payload_json_private": item["payload"] if item else "{}"}
    f = match_features(company, item)
    score = match_score(f)
    label = "high" if score >= 0.8 else "medium" if score >= 0.6 else "low" if score >= 0.4 else "none"
    decision = "review" if f["domain_conflict"] or label == "low" else "accepted" if label in ("high", "medium") else "rejected"
    return row | {
        "item": item["item"], "candidate_linkedin_company_id": item["id"], "candidate_linkedin_universal_name": item["universal_name"], "candidate_name": item["name"], "candidate_linkedin_url": item["linkedin_url"],
        "candidate_website": item["website"], "candidate_website_domain": item["domain"], "candidate_employee_count": item["employee_count"], "candidate_industries_json": dump(list(item["industries"])),
        "match_features_json": dump(f), "match_score": score, "confidence_label": label, "decision": decision, "error_code": "domain_conflict" if f["domain_conflict"] else "",
        "error_message": "Official-domain candidate conflicts with provider website." if f["domain_conflict"] else "", "raw_payload_json_private": item["payload"],
    }


def assign_greedily(companies: DataFrame, items: DataFrame, least: float = 0.4, observed_at: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A row of evidence for each company: companies in order take the best item that is left in their batch, from `least` on.

    companies: batch, company, company_key, name, domains. items: batch, item, id, name, universal_name, website,
    linkedin_url, employee_count, industries. A batch is one request of a bounded number of companies, and is the
    group. Only pairs whose names or domains are related are scored: without either, no score is over 0.25.
    """
    columns = [c.split()[0] for c in EVIDENCE.replace("\n", " ").split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found, out = right.sort_values("item").to_dict("records"), []
        taken = [False] * len(found)
        for company in left.sort_values("company").to_dict("records"):
            own, official = company["name_key"], company["domains"]
            best, top = None, -1.0
            for i, item in enumerate(found):
                ck, dom = item["name_key"], item["domain"]
                if taken[i] or not (own and (own == item["universal_key"] or (ck and (own in ck or ck in own))) or dom and any(d and (dom.endswith(d) or d.endswith(dom)) for d in official)):
                    continue
                score = match_score(match_features(company, item))
                if score > top:  # the first of the best
                    best, top = i, score
            if best is not None and top >= least:
                taken[best] = True
                out.append(evidence_row(company, found[best], observed_at))
            else:
                out.append(evidence_row(company, None, observed_at))
        return pd.DataFrame([[r.get(c) for c in columns] for r in out], columns=columns, dtype=object).astype({"item": "Int64"})

    text = lambda c: T.clean(F.col(c)).alias(c)
    host = F.lower(T.domain(T.clean(F.col("website"))))
    payload = F.to_json(F.struct("id", "name", "universal_name", "website", "linkedin_url", "employee_count", "industries"))
    domains = F.filter(F.transform(F.coalesce("domains", F.array().cast("array<string>")), lambda d: F.lower(T.clean(d))), lambda d: d != "")
    left = companies.select("batch", "company", text("company_key"), text("name"), T.key(F.col("name")).alias("name_key"), domains.alias("domains"))
    right = items.select(
        "batch", "item", *[text(c) for c in ("id", "name", "universal_name", "website", "linkedin_url", "employee_count")], T.key(F.col("name")).alias("name_key"), T.key(F.replace("universal_name", F.lit("-"), F.lit(" "))).alias("universal_key"),
        host.alias("domain"), F.coalesce("industries", F.array().cast("array<string>")).alias("industries"), payload.alias("payload"),
    )
    return left.groupBy("batch").cogroup(right.groupBy("batch")).applyInPandas(run, EVIDENCE)


@query("greedy_assignment")
def greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-06, SID-17: each company of a request gets at most one of the items that came back, as a row of evidence.

    Suppliers are the companies, BATCH of them a request; every part is an item that came back for one of them, with
    a name, an address and details that agree with it more or less. Tests hold it against a sequential run.
    """
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("company"), "s_name")
    batch = F.floor(F.col("company") / BATCH).alias("batch")
    site = F.regexp_replace(F.lower("s_name"), "[^a-z0-9]", "")
    domains = F.when(F.col("company") % 4 == 0, F.array().cast("array<string>")).when(F.col("company") % 4 == 1, F.array(F.concat(F.lit("careers."), site, F.lit("-hr.net")))).otherwise(F.array(F.concat(site, F.lit(".com"))))
    companies = s.select(batch, "company", T.key(F.col("s_name")).alias("company_key"), F.col("s_name").alias("name"), domains.alias("domains"))
    n = s.count()
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("item"), "p_name", "p_brand", "p_type", "p_size")
    p = p.withColumn("company", F.pmod("item", F.lit(max(n, 1)))).join(s, "company")  # keys are 0 to n - 1
    kind = F.floor(F.col("item") / max(n, 1)) % 5
    name = F.when(kind == 0, F.concat("s_name", F.lit(" Holdings"))).when(kind.isin(1, 3), F.col("s_name")).otherwise(F.col("p_name"))
    address = F.when(kind == 3, F.concat(F.lit("https://"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", ""), F.lit(".org"))).when(F.col("item") % 7 == 0, None).otherwise(F.concat(F.lit("http://www."), site, F.lit(".com/about")))
    linked = F.when(F.col("item") % 3 != 0, F.concat(F.lit("https://www.linkedin.com/company/"), F.col("item").cast("string")))
    items = p.select(
        batch, "item", F.col("item").cast("string").alias("id"), name.alias("name"), F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-").alias("universal_name"), address.alias("website"), linked.alias("linkedin_url"),
        F.when(F.col("item") % 5 != 0, F.col("p_size").cast("string")).alias("employee_count"), F.when(F.col("item") % 2 == 0, F.split("p_type", " ")).alias("industries"),
    )
    return assign_greedily(companies, items)


@query("embedding_components")
def embedding_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-03: eight principal components of the vectors, at length 1. Signs and rotations aren't fixed; rows only."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from millrace.operators.ranking import unit

    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = PCA(k=8, inputCol="v", outputCol="c").fit(e)
    return model.transform(e).select("vec_id", unit(vector_to_array("c")).alias("c")).select("vec_id", F.size("c").alias("n"))


def spans_without_overlap(spans: DataFrame) -> DataFrame:
    """row_id, field, term, start, stop, confidence: the most confident of equal spans; then, in order of start, those
    that overlap the last one kept of their field and term are dropped."""
    best = spans.groupBy("row_id", "field", "term", "start", "stop").agg(F.max("confidence").alias("confidence"))
    by = best.groupBy("row_id", "field", "term").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "confidence"))).alias("s"))
    kind = "array<struct<start:int,stop:int,confidence:double>>"
    add = lambda a, x: F.when((F.size(a) == 0) | (F.element_at(a, -1)["stop"] <= x["start"]), F.concat(a, F.array(x))).otherwise(a)
    kept = F.aggregate(F.col("s").cast(kind), F.array().cast(kind), add)
    return by.select("row_id", "field", "term", F.inline(kept))


def read_profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """profile_id, text to salary_min, max_years, needs_sponsorship, us_only: the rules of a free-text profile."""
    import re

    for batch in batches:
        out = []
        for pid, text in zip(batch["profile_id"], batch["text"].fillna(""), strict=True):
            low = text.lower()
            pay = re.search(r"\$\s*(\d{2,3})(?:,(\d{3})|\s*k)", low)
            years = re.search(r"(?:up to|max(?:imum)?|at most|no more than)\s+(\d{1,2})\s*\+?\s*years?", low)
            amount = int(pay[1]) * 1000 + (int(pay[2]) if pay[2] else 0) if pay else None
            out.append((pid, amount, int(years[1]) if years else None, bool(re.search(r"need(?:s)?\s+(?:visa\s+)?sponsorship|require(?:s)?\s+sponsorship", low)), bool(re.search(r"\bus[- ]only\b|only in the us\b|united states only", low))))
        yield pd.DataFrame(out, columns=["profile_id", "salary_min", "max_years", "needs_sponsorship", "us_only"]).astype({"salary_min": "Int64", "max_years": "Int64"})


PROFILE = "profile_id string, salary_min long, max_years long, needs_sponsorship boolean, us_only boolean"
