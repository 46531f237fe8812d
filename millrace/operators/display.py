"""Queries over what a reader sees: cards, safe wording, notes, contacts, addresses and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import display as D
from millrace.functions import text as T
from millrace.operators.postings import q_clean, q_key
from millrace.plans.views import ctes, table, view
from millrace.registry import query


def _q_map(x: str, table_: dict[str, str], default: str) -> str:
    quote = lambda s: s.replace("'", "''")
    return f"CASE {x} " + " ".join(f"WHEN '{quote(k)}' THEN '{quote(v)}'" for k, v in table_.items()) + f" ELSE {default} END"


_TITLED = "array_to_string(list_transform(string_split(replace({0}, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query("display_cards", ctes("postings") + f"""
, t AS (SELECT *, job_id % 101 / 100 AS score, list_filter(string_split(extracted_skills, '|'), lambda s: s <> '') AS sk, CAST(CAST(floor(salary_min) AS BIGINT) AS VARCHAR) AS lo, CAST(CAST(floor(salary_max) AS BIGINT) AS VARCHAR) AS hi FROM postings)
SELECT job_id, CASE WHEN score >= 0.72 THEN 'Strong match' WHEN score >= 0.62 THEN 'Good match' ELSE 'Possible fit' END AS strength, {_q_map('sponsorship_signal', D.AUTHORIZATION, "'?'")} AS authorization,
  CASE WHEN employment_type IN ('', 'unknown') THEN 'Not listed' ELSE {_q_map('employment_type', D.VALUES, 'employment_type')} END AS employment, CASE WHEN company_type IN ('', 'unknown') THEN 'Not listed' WHEN contains(company_type, '_') THEN {_TITLED.format('company_type')} ELSE company_type END AS kind,
  CASE WHEN source IS NULL OR source = '' THEN 'Not listed' WHEN contains(lower(source), 'careerbuilder') THEN 'CareerBuilder' ELSE {_TITLED.format('source')} END AS provider,
  CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo || '-' || hi ELSE coalesce(lo, hi, 'Salary not listed') END AS salary, array_to_string(sk[1:2], ', ') AS chips, greatest(0, len(sk) - 2) AS extra,
  {_q_map("CASE job_id % 4 WHEN 0 THEN 'Apply Now' WHEN 1 THEN 'Same-company alternative' WHEN 2 THEN 'Potential duplicate role' ELSE 'Other' END", D.STRATEGIES, "'Other'")} AS strategy FROM t
""")  # fmt: skip
def display_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-19, TXT-26, FEA-41, FEA-46: a posting's card."""
    c, k = F.col, F.col("job_id") % 4
    whole = lambda n: F.floor(c(n)).cast("long").cast("string")
    chips = D.chips(F.split("extracted_skills", "[|]"), 2)
    given = F.when(k == 0, "Apply Now").when(k == 1, "Same-company alternative").when(k == 2, "Potential duplicate role").otherwise("Other")
    return view(spark, sf_dir, "postings").select(
        "job_id", D.strength(F.pmod("job_id", F.lit(101)) / 100).alias("strength"), D.authorization(c("sponsorship_signal")).alias("authorization"), D.value(c("employment_type")).alias("employment"), D.value(c("company_type")).alias("kind"),
        D.provider(c("source")).alias("provider"), D.salary(F.lit(""), whole("salary_min"), whole("salary_max")).alias("salary"), F.array_join(chips["visible"], ", ").alias("chips"), chips["extra"].alias("extra"), D.strategy(given).alias("strategy"),
    )


_SAID = "concat_ws('; ', CASE job_id % 5 WHEN 0 THEN 'Strong target-role/title match' WHEN 1 THEN 'Matched admitted hard-skill sidecar terms' WHEN 2 THEN 'salary_missing' WHEN 3 THEN 'some_internal_name' ELSE 'Score of the Sidecar_x' END, CASE job_id % 3 WHEN 0 THEN sponsorship_signal WHEN 1 THEN company_type END)"


def _q_safe(x: str) -> str:
    for old, new in D.SAFE:
        x = f"replace({x}, '{old}', '{new}')"
    return x


@query("display_safe_text", ctes("postings") + f"""
, t AS (SELECT job_id, {_q_safe(_SAID)} AS s FROM postings) SELECT job_id, CASE WHEN contains(s, '_') AND lower(s) = s THEN replace(s, '_', ' ') ELSE s END AS shown FROM t
""")  # fmt: skip
def display_safe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-20: internal wording replaced."""
    return view(spark, sf_dir, "postings").select("job_id", D.safe(F.expr(_SAID)).alias("shown"))


@query("display_evidence_notes", ctes("postings") + f"""
, t AS (SELECT job_id, CASE job_id % 7 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(D.ACTIVITY))} ELSE 'some_other_label' END AS label, job_id % 3 = 0 AS role, job_id % 3 = 1 AS employer FROM postings)
SELECT job_id, CASE WHEN role THEN 'Employer has ' || {_q_map('label', D.ACTIVITY, "replace(label, '_', ' ')")} || ' for data_engineering roles in the local DOL OFLC LCA cache. This does not confirm sponsorship for this specific posting.' WHEN employer THEN '{D.NOTES[1]}' ELSE '{D.NOTES[2]}' END AS note FROM t
""")  # fmt: skip
def display_evidence_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-25: what filings say of an employer, in words."""
    k = F.col("job_id") % 7
    label = F.lit("some_other_label")
    for i, name in enumerate(D.ACTIVITY):
        label = F.when(k == i, name).otherwise(label)
    role, employer = F.col("job_id") % 3 == 0, F.col("job_id") % 3 == 1
    return view(spark, sf_dir, "postings").select("job_id", D.evidence_note(role, employer, F.lit("data_engineering"), label).alias("note"))


@query("display_contacts", f"SELECT doc_id, coalesce({q_clean(f'''regexp_extract(text, '{D.EMAIL}')''')}, '') AS email, coalesce({q_clean(f'''regexp_extract(text, '{D.PHONE}')''')}, '') AS phone, coalesce({q_clean(f'''regexp_extract(text, '{D.LINKEDIN}')''')}, '') AS linkedin FROM documents")
def display_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-21: the first address, number and profile that a text gives."""
    return table(spark, sf_dir, "documents").select("doc_id", D.contacts(F.col("text")).alias("c")).select("doc_id", "c.*")


_DOMAIN = "regexp_replace(regexp_extract(lower(trim(url)), '^[a-z]+://([^/?#]*)', 1), '^www[.]', '')"
_UNDER = lambda d: f"(x = '{d}' OR ends_with(x, '.{d}'))"


@query("display_domains", f"""
, t AS (SELECT page_id, {_DOMAIN} AS d FROM pages),
u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'jobs.' || d WHEN 1 THEN d WHEN 2 THEN 'uk.linkedin.com' ELSE 'careers-' || d END AS x, d FROM t)
SELECT page_id, x AS domain, (x <> '' AND d <> '' AND (x = d OR ends_with(x, '.' || d) OR ends_with(d, '.' || x))) AS related, ({' OR '.join(_UNDER(d) for d in D.JOB_BOARDS)}) AS board,
  ({' OR '.join(f"contains({q_key('x')}, '{t}')" for t in D.AUXILIARY)}) AS auxiliary FROM u
""".replace(", t AS", "WITH t AS", 1))  # fmt: skip
def display_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-27, TXT-17: how an address's domain relates to the official one."""
    d, k = F.col("d"), F.col("page_id") % 4
    p = table(spark, sf_dir, "pages").select("page_id", T.domain(F.col("url")).alias("d"))
    p = p.withColumn("x", F.when(k == 0, F.concat(F.lit("jobs."), d)).when(k == 1, d).when(k == 2, "uk.linkedin.com").otherwise(F.concat(F.lit("careers-"), d)))
    return p.select("page_id", F.col("x").alias("domain"), D.same_domain(F.col("x"), d).alias("related"), D.job_board(F.col("x")).alias("board"), D.auxiliary(F.col("x")).alias("auxiliary"))


@query("display_profile_text", ctes("seekers") + """
, l AS (SELECT profile_id, array_to_string(list_filter(string_split(target_roles, '|'), lambda x: x <> ''), ', ') AS r, array_to_string(list_filter(string_split(skills, '|'), lambda x: x <> ''), ', ') AS s, array_to_string(list_filter(string_split(places, '|'), lambda x: x <> ''), ', ') AS p FROM seekers)
SELECT profile_id, trim(regexp_replace(profile_id || ' | Target roles: ' || r || ' | Skills: ' || s || ' | Education: | Experience: | Projects and publications: | Location preferences: ' || p || ' | Dealbreakers:', '\\s+', ' ', 'g')) AS said FROM l
""")  # fmt: skip
def display_profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-14: a profile as one text, whose labels are always there."""
    lists = lambda c: F.array_join(T.split_list(F.col(c)), ", ")
    parts = (("Target roles", lists("target_roles")), ("Skills", lists("skills")), ("Education", F.lit("")), ("Experience", F.lit("")), ("Projects and publications", F.lit("")), ("Location preferences", lists("places")), ("Dealbreakers", F.lit("")))
    said = F.concat_ws(" | ", "profile_id", *[F.concat(F.lit(f"{label}: "), part) for label, part in parts])
    return view(spark, sf_dir, "seekers").select("profile_id", T.clean(said).alias("said"))


EXPORT = ("rank", "job_id", "title", "company", "employer", "location", "salary_min", "salary_max", "salary_raw", "link", "apply_url", "description_text", "final_score", "adjusted_score", "feedback_adjustment", "matched_skills", "why_ranked_summary", "application_strategy_label", "source", "raw_source")


@query("display_export", ctes("postings") + """
, t AS (SELECT *, job_id % 101 / 100 AS s, row_number() OVER (ORDER BY job_id % 101 DESC, job_id) AS place FROM postings QUALIFY place <= 200)
SELECT CASE WHEN job_id % 3 = 0 THEN 1000 + place WHEN job_id % 3 = 1 THEN 500 + place ELSE place END AS rank, job_id, title, company, '' AS employer, location, CAST(CAST(floor(salary_min) AS BIGINT) AS VARCHAR) AS salary_min, CAST(CAST(floor(salary_max) AS BIGINT) AS VARCHAR) AS salary_max, '' AS salary_raw,
  'https://x.org/' || job_id AS link, 'https://x.org/' || job_id AS apply_url, length(description_text) AS description_text, round(s, 4) AS final_score, CAST(NULL AS DOUBLE) AS adjusted_score, CAST(NULL AS DOUBLE) AS feedback_adjustment,
  array_to_string(list_filter(string_split(extracted_skills, '|'), lambda x: x <> ''), ', ') AS matched_skills, '' AS why_ranked_summary, CASE WHEN job_id % 2 = 0 THEN 'Recommended' ELSE 'Additional posting' END AS application_strategy_label, source, source AS raw_source FROM t
""")  # fmt: skip
def display_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-24: the 200 best as 20 columns; the adjusted rank, else the rank, else the place. Descriptions are shown by their length."""
    c = F.col
    p = view(spark, sf_dir, "postings").withColumn("s", F.pmod("job_id", F.lit(101)) / 100).orderBy(F.desc("s"), "job_id").limit(200)
    p = p.withColumn("place", F.row_number().over(Window.orderBy(F.desc("s"), "job_id")))  # over 200 rows
    adjusted, rank = F.when(c("job_id") % 3 == 0, 1000 + c("place")), F.when(c("job_id") % 3 == 1, 500 + c("place"))
    link, whole = F.concat(F.lit("https://x.org/"), c("job_id")), lambda n: F.floor(c(n)).cast("long").cast("string")
    made = {
        "rank": F.coalesce(adjusted, rank, c("place")), "employer": F.lit(""), "salary_min": whole("salary_min"), "salary_max": whole("salary_max"), "salary_raw": F.lit(""), "link": link, "apply_url": T.first_nonempty(F.lit(None), link),
        "description_text": F.length("description_text"), "final_score": F.round("s", 4), "adjusted_score": F.lit(None).cast("double"), "feedback_adjustment": F.lit(None).cast("double"), "why_ranked_summary": F.lit(""), "raw_source": c("source"),
        "matched_skills": F.array_join(F.filter(F.split("extracted_skills", "[|]"), lambda x: x != ""), ", "), "application_strategy_label": D.strategy(F.when(c("job_id") % 2 == 0, "Apply Now").otherwise("Same-company alternative")),
    }
    return p.select(*[made[n].alias(n) if n in made else c(n) for n in EXPORT])
