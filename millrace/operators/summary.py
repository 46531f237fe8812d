"""Queries that sum up or gate: role family with its basis, headquarters, the quality gate, flags of the best ten, a
snapshot's expectations, values coerced from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import display as D
from millrace.functions import features as X
from millrace.functions import records as J
from millrace.functions import rules as R
from millrace.functions import text as T
from millrace.operators.fit import _HEAD, fits, titles
from millrace.operators.postings import _OR, q_clean, q_key
from millrace.operators.search import shared
from millrace.plans.views import TEXT, beginnings, combinations, ctes, narrow, table, view, with_facts
from millrace.registry import query


def _q_family(key: str) -> str:
    return "CASE " + " ".join(f"WHEN {_OR(key, words)} THEN '{label}'" for label, words in R.FILING_FAMILIES) + " ELSE 'other' END"


@query("summary_role_basis", ctes("postings") + f"""
, t AS (SELECT job_id, {_q_family(q_key('title'))} AS own, {_q_family(q_key(f"title || ' ' || substr(concat_ws(' ', nullif(extracted_skills, ''), nullif({q_clean('description_text')}, '')), 1, 1200)"))} AS far FROM postings)
SELECT job_id, CASE WHEN own <> 'other' THEN own ELSE far END AS family, CASE WHEN own <> 'other' THEN 'title' WHEN far <> 'other' THEN 'title_description' ELSE 'unclassified' END AS basis FROM t
""")  # fmt: skip
def summary_role_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-21: a broad family by the title, else by the title with 1,200 characters of skills and description."""
    c, rules = F.col, [(label, [X._as_key(w) for w in words]) for label, words in R.FILING_FAMILIES]
    keys = ("extracted_skills", *TEXT)
    hint = F.substring(F.concat_ws(" ", F.nullif(T.clean(c("extracted_skills")), F.lit("")), F.nullif(c("said"), F.lit(""))), 1, 1200)
    hints = combinations(spark, sf_dir, *keys).join(beginnings(spark, sf_dir, 1200), list(TEXT)).select(*keys, hint.alias("hint"))
    own = titles(spark, sf_dir).select("title", X.padded(c("title")).alias("title_key"), X.plain(c("title")).alias("plain")).withColumn("own", X._first_rule(c("title_key"), rules))
    own = shared(own.withColumn("unclear", c("own") == len(rules)))
    said = shared(hints.select(*keys, T.let(X.padded(c("hint")), lambda t: X.said_rule(t, rules)).alias("said")))
    p = narrow(spark, sf_dir).select("job_id", F.coalesce("title", F.lit("")).alias("title"), *keys)
    p = with_facts(with_facts(p, own, "title"), said, *keys)
    over = F.concat(F.rtrim(c("title_key")), c("said.head"))  # a word of the text, or one that begins in the title
    p = p.withColumn("far", F.when(c("unclear"), F.least(c("said.at"), X._first_rule(over, rules))))
    odd = own.where("unclear and not plain").select("title")
    if not odd.isEmpty():  # markup in a title may reach into the text: such a combination is read whole
        whole = hints.crossJoin(F.broadcast(odd)).select("title", *keys, T.let(X.padded(F.concat_ws(" ", "title", "hint")), lambda t: X._first_rule(t, rules)).alias("whole"))
        p = with_facts(p, shared(whole), "title", *keys, how="left").withColumn("far", F.coalesce("whole", "far"))
    at = F.when(c("unclear"), c("far")).otherwise(c("own"))
    basis = F.when(~c("unclear"), "title").when(c("far") < len(rules), "title_description").otherwise("unclassified")
    return p.select("job_id", X.rule_name(at, rules, "other").alias("family"), basis.alias("basis"))


_PLACE = "STRUCT<headquarter: BOOLEAN, country: STRING, geographicArea: STRING, city: STRING, parsed: STRUCT<countryCode: STRING, state: STRING, city: STRING>>"


def headquarters(item: Column) -> Column:
    """struct<country, state, city, start, end> of a provider's item: the place that is flagged, else the first."""
    parsed = F.from_json(item, f"STRUCT<locations: ARRAY<{_PLACE}>, employeeCountRange: STRUCT<start: BIGINT, end: BIGINT>>")

    def read(p: Column) -> Column:
        places = F.filter(p["locations"], lambda x: x.isNotNull())
        hq = F.coalesce(F.get(F.filter(places, lambda x: x["headquarter"]), F.lit(0)), F.get(places, F.lit(0)))
        first = lambda h, a, b: F.coalesce(F.nullif(T.clean(h["parsed"][a]), F.lit("")), T.clean(h[b]))
        own = lambda h: F.struct(first(h, "countryCode", "country").alias("country"), first(h, "state", "geographicArea").alias("state"), first(h, "city", "city").alias("city"))
        return F.struct(T.let(hq, own).alias("hq"), p["employeeCountRange"]["start"].alias("start"), p["employeeCountRange"]["end"].alias("end"))

    return T.let(parsed, read)


_ITEM = """concat('{"name":"', c_name, '","locations":[', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('{"headquarter":false,"country":"US","city":"First"},{"headquarter":', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END,
  ',"country":"DE","geographicArea":"BE","city":" Berlin ","parsed":{"countryCode":"', CASE WHEN c_custkey % 3 = 0 THEN 'FR' ELSE '' END, '","state":"S"}}') END, ']', CASE WHEN c_custkey % 4 = 0 THEN concat(',"employeeCountRange":{"start":', CAST(c_custkey AS STRING), ',"end":1000000}') ELSE '' END, '}')"""


@query("summary_headquarters", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 2 <> 0 THEN 'US' WHEN c_custkey % 3 = 0 THEN 'FR' ELSE 'DE' END AS country, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN 'S' ELSE '' END AS state,
  CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 2 <> 0 THEN 'First' ELSE 'Berlin' END AS city, CASE WHEN c_custkey % 4 = 0 THEN c_custkey::BIGINT END AS size_from, CASE WHEN c_custkey % 4 = 0 THEN 1000000::BIGINT END AS size_to FROM customer
""")  # fmt: skip
def summary_headquarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-44: a company's headquarters and range of employees from a nested item."""
    h = table(spark, sf_dir, "customer").select("c_custkey", headquarters(F.expr(_ITEM)).alias("h"))
    return h.select("c_custkey", *[F.coalesce(f"h.hq.{c}", F.lit("")).alias(c) for c in ("country", "state", "city")], F.col("h.start").alias("size_from"), F.col("h.end").alias("size_to"))


_STRONG = "CASE WHEN greatest(0.0, least(1.0, base - penalty)) >= 0.72 THEN 'Strong match' WHEN greatest(0.0, least(1.0, base - penalty)) >= 0.62 THEN 'Good match' ELSE 'Possible fit' END"
_BASE = """
, w AS (SELECT *, (job_id % 101 / 100) * 0.27::DOUBLE + skill_part * 0.17::DOUBLE + target_role * 0.23::DOUBLE + salary_part * 0.09::DOUBLE + location_part * 0.08::DOUBLE + company_part * 0.05::DOUBLE + sponsor_part * 0.06::DOUBLE + employment_part * 0.06::DOUBLE AS base FROM k)
"""


@query("summary_quality_gate", _HEAD + _BASE + f"SELECT profile_id, {_STRONG} AS label, count(*) AS n, count(*) FILTER (WHERE len(matched) > 0 OR {_STRONG} <> 'Possible fit') AS passed FROM w GROUP BY 1, 2")
def summary_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08: a posting passes with a matched skill or a label above the lowest; counts by profile and label."""
    label = D.strength(F.col("raw_score"))
    rows = fits(spark, sf_dir).select("profile_id", label.alias("label"), (F.size("matched") > 0).alias("skilled"))
    return rows.groupBy("profile_id", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("skilled") | (F.col("label") != "Possible fit")).alias("passed"))


@query("summary_best_ten", _HEAD + _BASE + """
, t AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY job_id % 101 DESC, job_id) <= 10),
s AS (SELECT profile_id, max(n) AS same_company FROM (SELECT profile_id, company, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT profile_id, count(*) AS shown, count(*) FILTER (WHERE off_target) AS off_target, count(*) FILTER (WHERE reason IS NOT NULL) AS misplaced, count(*) FILTER (WHERE defense) AS defense, count(*) FILTER (WHERE remote) AS remote, count(*) FILTER (WHERE len(hits) > 0) AS too_senior,
  count(*) FILTER (WHERE top IS NULL) AS no_salary, count(*) FILTER (WHERE sponsorship_signal = 'no_sponsorship') AS no_sponsorship, any_value(same_company) AS same_company FROM t JOIN s USING (profile_id) GROUP BY 1
""")  # fmt: skip
def summary_best_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-30: flags among a profile's best ten, and how many of them one company has at most."""
    order = Window.partitionBy("profile_id").orderBy(F.desc(F.pmod("job_id", F.lit(101))), "job_id")
    best = fits(spark, sf_dir).withColumn("place", F.row_number().over(order)).where("place <= 10")
    same = best.groupBy("profile_id", "named").agg(F.count(F.lit(1)).alias("n")).groupBy("profile_id").agg(F.max("n").alias("same_company"))
    flags = {
        "off_target": F.col("off_target"), "misplaced": F.col("reason").isNotNull(), "defense": F.col("firm.defense"), "remote": F.col("where.remote"), "too_senior": F.col("too_senior"),
        "no_salary": F.coalesce("salary_max", "salary_min").isNull(), "no_sponsorship": F.col("says") == "no_sponsorship",
    }
    return best.groupBy("profile_id").agg(F.count(F.lit(1)).alias("shown"), *[F.count_if(c).alias(n) for n, c in flags.items()]).join(same, "profile_id")


@query("summary_snapshot", ctes("postings") + f"""
SELECT count(*) AS n, count(DISTINCT job_id) AS ids, count(DISTINCT {q_key('company')}) AS companies, count(*) FILTER (WHERE {q_clean('title')} = '') AS untitled, count(*) FILTER (WHERE salary_min IS NOT NULL) AS paid, round(count(*) FILTER (WHERE salary_min IS NOT NULL) / count(*), 6) AS coverage,
  strftime(min(posted_at), '%Y-%m-%d') AS first, strftime(max(posted_at), '%Y-%m-%d') AS last, count(*) BETWEEN 20000 AND 50000 AS expected_size, count(*) = count(DISTINCT job_id) AS unique_ids FROM postings
""")  # fmt: skip
def summary_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, SID-21: a snapshot's figures, and whether its size and ids are what is expected."""
    c, n = F.col, F.count(F.lit(1))
    return view(spark, sf_dir, "postings").agg(
        n.alias("n"), F.count_distinct("job_id").alias("ids"), F.count_distinct(T.key(c("company"))).alias("companies"), F.count_if(T.clean(c("title")) == "").alias("untitled"), F.count("salary_min").alias("paid"), F.round(F.count("salary_min") / n, 6).alias("coverage"),
        F.min("posted_at").cast("string").alias("first"), F.max("posted_at").cast("string").alias("last"), n.between(20_000, 50_000).alias("expected_size"), (n == F.count_distinct("job_id")).alias("unique_ids"),
    )


_GIVEN = "CASE o_orderkey % 7 WHEN 0 THEN concat('$', CAST(o_orderkey AS STRING), ',000') WHEN 1 THEN concat(CAST(o_orderkey AS STRING), '.50') WHEN 2 THEN '12d' WHEN 3 THEN concat('{\"$numberInt\":\"', CAST(o_orderkey AS STRING), '\"}') WHEN 4 THEN 'YES' WHEN 5 THEN '' ELSE '-5' END"


@query("summary_coerced", """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_orderkey * 1000.0 WHEN 1 THEN o_orderkey + 0.5 WHEN 3 THEN o_orderkey WHEN 6 THEN -5 END::DOUBLE AS number, CASE CASE WHEN o_orderkey = 0 THEN 5 ELSE o_orderkey % 7 END WHEN 0 THEN (o_orderkey * 1000)::VARCHAR WHEN 1 THEN o_orderkey || '.5' WHEN 3 THEN o_orderkey::VARCHAR ELSE '' END AS shown,
  CASE o_orderkey % 7 WHEN 4 THEN true ELSE false END AS flag, CASE o_orderkey % 7 WHEN 0 THEN least(1e6, o_orderkey * 1000.0) WHEN 1 THEN least(1e6, o_orderkey + 0.5) WHEN 3 THEN least(1e6, o_orderkey) ELSE 0 END::DOUBLE AS clamped FROM orders
""")  # fmt: skip
def summary_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-10, TXT-16, TXT-23: numbers out of text and wrappers, shown without idle zeros, flags, and numbers held within bounds."""
    n = J.number(F.expr(_GIVEN))
    held = F.greatest(F.lit(0.0), F.least(F.lit(1e6), F.coalesce(n, F.lit(0.0))))
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("number"), F.coalesce(J.shown(n), F.lit("")).alias("shown"), T.flag(F.expr(_GIVEN)).alias("flag"), held.alias("clamped"))
