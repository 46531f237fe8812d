"""Queries over postings: normalising, features, validation, exact dedup, quality, funnels and market figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import features as X
from millrace.functions import rules as R
from millrace.functions import text as T
from millrace.operators.search import shared
from millrace.plans.views import TEXT, ctes, distinct, narrow, once, table, texts, view, with_facts
from millrace.registry import query


def q_clean(x: str) -> str:
    for entity, char in T.ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


def q_key(x: str) -> str:
    return f"trim(regexp_replace(lower({q_clean(x)}), '[^a-z0-9]+', ' ', 'g'))"


def q_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def q_first(x: str, rules, default: str = "'unknown'") -> str:
    return "CASE " + " ".join(f"WHEN {q_any(x, words)} THEN '{label}'" for label, words in rules) + f" ELSE {default} END"


def q_list(items: list[tuple[str, str]]) -> str:
    """A list, as text, of the labels whose condition holds."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{label}' END" for label, cond in items) + "], lambda x: x IS NOT NULL), '|')"


# --- cleaning, keys and hashes


@query("text_clean_key_hash", f"""
SELECT doc_id, {q_clean('text')} AS cleaned, {q_key('text')} AS key, substr(sha256({q_clean('text')}), 1, 24) AS hash24,
  len(list_distinct(list_filter(string_split({q_key('text')}, ' '), lambda t: length(t) >= 2))) AS n_tokens FROM documents
""")  # fmt: skip
def text_clean_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01, TXT-02, TXT-03, TXT-28."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(c).alias("cleaned"), T.key(c).alias("key"), T.stable_hash(c, 24).alias("hash24"), F.size(T.tokens(c)).cast("long").alias("n_tokens"))


@query("pages_clean_domain", f"""
SELECT page_id, {q_clean('html')} AS cleaned, regexp_replace(regexp_extract(lower(trim(url)), '^[a-z]+://([^/?#]*)', 1), '^www[.]', '') AS domain,
  regexp_replace(url, '(?i)([?&](?:app_id|app_key|api_key|apikey|key|token|access_token)=)[^&#]*', '\\1REDACTED', 'g') AS shown FROM pages
""")  # fmt: skip
def pages_clean_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01, TXT-17, SRC-25 over whole pages."""
    return table(spark, sf_dir, "pages").select("page_id", T.clean(F.col("html")).alias("cleaned"), T.domain(F.col("url")).alias("domain"), T.without_secrets(F.col("url")).alias("shown"))


@query("text_lists_and_joins", ctes("postings") + f"""
SELECT job_id, array_to_string(string_split(extracted_skills, '|')[1:2], '|') AS two_skills, concat_ws(' | ', {', '.join(f"nullif({q_clean(c)}, '')" for c in ('title', 'company', 'location', 'employment_type'))}) AS embedding_text,
  coalesce(nullif({q_clean('employment_type')}, ''), nullif({q_clean('company_type')}, ''), '') AS first_known, coalesce(CAST(round(salary_min, 2) AS VARCHAR), '') <> '' AS has_salary FROM postings
""")  # fmt: skip
def text_lists_and_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-04, TXT-08, TXT-09, TXT-12, TXT-13, TXT-15."""
    p = view(spark, sf_dir, "postings")
    parts = [F.col(c) for c in ("title", "company", "location", "employment_type")]
    return p.select(
        "job_id", T.piped(F.col("extracted_skills"), 2).alias("two_skills"), T.joined(*parts).alias("embedding_text"),
        T.first_nonempty(F.col("employment_type"), F.col("company_type")).alias("first_known"), F.col("salary_min").isNotNull().alias("has_salary"),
    )


# --- features

_SCAN = lambda *parts: "lower(concat_ws(' ', " + ", ".join(parts) + "))"
_DESC = lambda n: f"substr({q_clean('description_text')}, 1, {n})"


@query("features_first_match", ctes("postings") + f"""
SELECT job_id, {q_first(_SCAN(q_clean('title'), _DESC(1500)), R.SENIORITY)} AS seniority,
  {q_first(_SCAN(q_clean('title'), q_clean('location'), _DESC(1500)), R.REMOTE)} AS remote,
  {q_first(_SCAN(q_clean('employment_type'), q_clean('title'), _DESC(2000)), R.EMPLOYMENT, f"coalesce(nullif({q_key('employment_type')}, ''), 'unknown')")} AS employment,
  {q_first(_SCAN(q_clean('company'), _DESC(2500)), R.COMPANY_TYPE)} AS company_kind, {q_first(f"lower({_DESC(5000)})", R.SPONSORSHIP)} AS sponsorship FROM postings
""")  # fmt: skip
def features_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-02, FEA-04, FEA-05, FEA-06, FEA-07."""
    c = F.col
    said = {"seniority": (1500, R.SENIORITY), "remote": (1500, R.REMOTE), "employment": (2000, R.EMPLOYMENT), "company_kind": (2500, R.COMPANY_TYPE), "sponsorship": (5000, R.SPONSORSHIP)}
    begin = lambda t, n, rules: T.let(F.lower(F.substring(t, 1, n)), lambda b: X.said_rule(b, rules))
    begins = T.let(T.clean(c("description_text")), lambda t: F.struct(*[begin(t, *rule).alias(name) for name, rule in said.items()]))
    p = once(spark, sf_dir, *TEXT, said=begins)
    p = p.withColumns({f"{n}_low": F.lower(T.clean(c(n))) for n in ("title", "location", "company", "employment_type")})
    own = {"seniority": ("title",), "remote": ("title", "location"), "employment": ("employment_type", "title"), "company_kind": ("company",)}
    label = lambda name, default="unknown": X.rule_label(F.concat_ws(" ", *[c(f"{n}_low") for n in own[name]]), c(f"said.{name}"), said[name][1], default)
    return p.select(
        "job_id", label("seniority").alias("seniority"), label("remote").alias("remote"), label("employment", F.coalesce(F.nullif(T.key(c("employment_type")), F.lit("")), F.lit("unknown"))).alias("employment"),
        label("company_kind").alias("company_kind"), X.rule_name(c("said.sponsorship.at"), R.SPONSORSHIP, "unknown").alias("sponsorship"),
    )


def _q_skill(k: str) -> tuple[str, str]:
    escaped = "".join(f"[{ch}]" if ch in "+./" else ch for ch in k)
    return ("scikit-learn" if k == "sklearn" else k), f"regexp_matches({_SCAN(q_clean('title'), _DESC(5000))}, '(^|[^a-z0-9+#]){escaped}($|[^a-z0-9+#])')"


@query("features_skills", ctes("postings") + f"SELECT job_id, {q_list([_q_skill(k) for k in R.SKILLS])} AS skills FROM postings")
def features_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-01. The oracle has no r-language phrase, which the views don't hold."""
    return view(spark, sf_dir, "postings").select("job_id", F.array_join(X.skills(F.col("title"), F.col("description_text")), "|").alias("skills"))


_AMOUNT = r"(\d{2,3}(?:,\d{3})?|\d{2,3}\s*k)"
_PAIR, _ONE = rf"(?i)(?:\$?\s*)?{_AMOUNT}\s*(?:-|to|through|–|—)\s*(?:\$?\s*)?{_AMOUNT}", rf"(?i)\$\s*{_AMOUNT}"
_YEARS_N, _YEARS_UNIT = r"(1[0-5]|[1-9])", r"\s*(?:\+|plus)?\s*(?:years?|yrs?)"
_YEARS_WHAT, _YEARS_KIND = r"(?:experience|exp\.?|background|expertise|professional experience|work experience|industry experience|hands-on experience)", r"(?:relevant\s+|professional\s+|work\s+|industry\s+|hands-on\s+)?"
_YEARS = (
    rf"\b{_YEARS_N}{_YEARS_UNIT}\s+(?:of\s+)?{_YEARS_KIND}{_YEARS_WHAT}\b", rf"\b{_YEARS_N}{_YEARS_UNIT}\s+(?:required|preferred)\b", rf"\b{_YEARS_WHAT}\s*(?:of|:|with)?\s*{_YEARS_N}{_YEARS_UNIT}\b",
    rf"\b(?:minimum|min\.?|at least|requires?|required|requirement|must have|have|possess|with)\s+(?:of\s+)?{_YEARS_N}{_YEARS_UNIT}\s+(?:of\s+)?{_YEARS_KIND}{_YEARS_WHAT}\b",
)


def _q_amount(pattern: str, group: int) -> str:
    bare = f"regexp_replace(lower(regexp_extract(w, '{pattern}', {group})), '[, ]', '', 'g')"
    n = f"(TRY_CAST(regexp_replace({bare}, 'k$', '') AS BIGINT) * CASE WHEN ends_with({bare}, 'k') THEN 1000 ELSE 1 END)"
    return f"CASE WHEN {n} < 1000 THEN {n} * 1000 ELSE {n} END"


@query("features_years_salary", ctes("postings") + f"""
, t AS (SELECT job_id, lower({q_clean('description_text')}) AS d, {q_clean('description_text')} AS w FROM postings),
s AS (SELECT job_id, list_min(list_transform(list_concat({', '.join(f"regexp_extract_all(d, '{p}', 1)" for p in _YEARS)}), lambda x: CAST(x AS INT))) AS years,
  {q_any('lower(w)', ('salary', 'compensation', '$', 'usd', 'per year', 'annually'))} AS about, {_q_amount(_PAIR, 1)} AS a, {_q_amount(_PAIR, 2)} AS b, {_q_amount(_ONE, 1)} AS c FROM t)
SELECT job_id, years, CASE WHEN about AND a > 0 AND b > 0 THEN least(a, b) WHEN about AND c > 0 THEN c END AS low, CASE WHEN about AND a > 0 AND b > 0 THEN greatest(a, b) END AS high FROM s
""")  # fmt: skip
def features_years_salary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-03, FEA-08."""
    p = once(spark, sf_dir, *TEXT, years=X.years_required(F.col("description_text")), s=X.salary(F.col("description_text")))
    return p.select("job_id", "years", F.col("s.low").alias("low"), F.col("s.high").alias("high"))


def _q_phrases(x: str, words) -> list[tuple[str, str]]:
    import re

    return [(w, f"contains(' ' || {x} || ' ', ' {' '.join(re.findall('[a-z0-9]+', w.lower()))} ')") for w in words]


def q_title_families(x: str) -> str:
    return q_list([(label, f"regexp_matches({x}, '(?i)\\b({'|'.join([*words, *R.TITLE_PATTERNS.get(label, ())])})\\b')") for label, words in R.TITLE_FAMILIES.items()])


def _q_families(x: str, rules: dict) -> str:
    return q_list([(label, "(" + " OR ".join(c for _, c in _q_phrases(x, words)) + ")") for label, words in rules.items()])


@query("features_role_families", ctes("postings") + f"SELECT job_id, {q_title_families(q_clean('title'))} AS title_families, {_q_families(q_key(q_clean('description_text')), R.DESCRIPTION_FAMILIES)} AS description_families FROM postings")
def features_role_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-16, FEA-17, FEA-35's labelling."""
    c, table_ = F.col, R.DESCRIPTION_FAMILIES
    said = texts(spark, sf_dir, lambda t: X.family_words(X.padded(T.untagged(t)), table_)).select(*TEXT, X.family_bits_after(c("sentence"), c("said"), table_).alias("bits"))
    titles = distinct(spark, sf_dir, "title").select("title", F.array_join(X.title_families(c("title")), "|").alias("title_families"))
    p = with_facts(narrow(spark, sf_dir).select("job_id", "title", *TEXT), shared(said), *TEXT)
    return p.join(titles, p["title"].eqNullSafe(titles["title"])).select("job_id", "title_families", X.named(c("bits"), list(table_)).alias("description_families"))


_POSTING_KEY = q_key(f"concat_ws(' ', company, title, company_type, {_DESC(2500)})")
_WHOLE_KEY = q_key(f"concat_ws(' ', company, title, company_type, {q_clean('description_text')})")


@query("features_company_signals", ctes("postings") + f"""
SELECT job_id, {q_list(_q_phrases(_WHOLE_KEY, R.DEFENSE))} AS defense_terms,
  ({' OR '.join(c for _, c in _q_phrases(_WHOLE_KEY, R.DEFENSE))} OR company_type = 'defense_military') AS defense, ({' OR '.join(c for _, c in _q_phrases(q_key('company'), R.SPONSOR_FRIENDLY))} OR company_type = 'large_company') AS large,
  {q_list(_q_phrases(q_key('company'), R.SPONSOR_FRIENDLY))} AS sponsor_terms, {q_list(_q_phrases(_WHOLE_KEY, R.RESEARCH_LABS))} AS lab_terms,
  ({' OR '.join(c for _, c in _q_phrases(_WHOLE_KEY, R.RESEARCH_LABS))} OR company_type = 'research_lab') AS research FROM postings
""")  # fmt: skip
def features_company_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-22."""
    c, out = F.col, ("defense_terms", "defense", "large", "sponsor_terms", "lab_terms", "research")
    said = texts(spark, sf_dir, lambda t: X.company_words(X.padded(T.untagged(t)))).select(*TEXT, X.company_words_after(c("sentence"), c("said")).alias("said"))
    p = with_facts(narrow(spark, sf_dir), shared(said), *TEXT)
    first = X.plain(c("company"), c("title"), c("company_type"))
    split = p.where(first).select("job_id", T.let(X.company_bits(c("company"), c("title"), c("company_type"), c("said")), X.company_signals_of).alias("s"))
    # Markup before the text may reach into it: such a posting is read whole.
    whole = view(spark, sf_dir, "postings", counted=True).where(~first)
    whole = whole.select("job_id", X.company_signals(c("company"), c("title"), c("company_type"), c("description_text"), most=None).alias("s"))
    whole = whole.select("job_id", *[F.array_join(f"s.{n}", "|").alias(n) if n.endswith("terms") else c(f"s.{n}").alias(n) for n in out])
    return split.select("job_id", *[f"s.{n}" for n in out]).unionByName(whole)


_OR = lambda x, words: "(" + " OR ".join(c for _, c in _q_phrases(x, words)) + ")"
_US = f"({_OR(q_key('location'), ('united states', 'usa', 'us'))} OR regexp_matches(upper({q_clean('location')}), '(^|[^A-Z0-9])({'|'.join(R.US_STATES)})($|[^A-Z0-9])'))"
_ABROAD = f"({_OR(q_key('location'), R.NON_US)} OR ({_OR(q_key('location'), R.NON_US_CITIES)} AND NOT {_US}))"
_REMOTE_KEY = q_key(f"concat_ws(' ', location, title, {_DESC(1200)})")


@query("features_location_signals", ctes("postings") + f"""
SELECT job_id, (NOT {_OR(_REMOTE_KEY, R.REMOTE_NEGATIONS)} AND {_OR(_REMOTE_KEY, R.REMOTE_TERMS)}) AS remote, ({_US} AND NOT {_ABROAD}) AS us, {_ABROAD} AS abroad,
  ({_OR(q_key('location'), R.BAY_AREA)} AND NOT {_ABROAD}) AS bay_area FROM postings
""")  # fmt: skip
def features_location_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-23."""
    c = F.col
    p = once(spark, sf_dir, *TEXT, said=X.remote_words(X.padded(X.start(c("description_text"), 1200))))
    first = X.plain(c("location"), c("title"))
    split = p.where(first).select("job_id", X.location_signals_of(c("location"), c("title"), c("said")).alias("s"))
    whole = view(spark, sf_dir, "postings", counted=True).where(~first)  # as for companies
    whole = whole.select("job_id", X.location_signals(c("location"), c("title"), c("description_text")).alias("s"))
    return split.unionByName(whole).select("job_id", "s.remote", "s.us", "s.abroad", "s.bay_area")


def _q_employer(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in R.CORPORATE)
    return f"coalesce(nullif(array_to_string(list_filter(string_split({q_key(x)}, ' '), lambda t: t NOT IN ({words})), ' '), ''), {q_key(x)})"


# --- validation and exact dedup


@query("validate_postings", ctes("postings") + f"""
SELECT coalesce(r, 'valid') AS reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(e) = 0 THEN [NULL] ELSE e END) AS r FROM (SELECT list_filter([
  CASE WHEN {q_clean('title')} = '' THEN 'missing_title' END, CASE WHEN {q_clean("coalesce(employment_type, '')")} = '' THEN 'missing_employment_type' END,
  CASE WHEN length({q_clean('description_text')}) < 40 THEN 'description_too_short' END], lambda x: x IS NOT NULL) AS e FROM postings)) GROUP BY 1
""")  # fmt: skip
def validate_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ING-05: a posting's errors, counted by reason."""
    p = view(spark, sf_dir, "postings")
    errors = F.array_compact(F.array(
        F.when(T.clean(F.col("title")) == "", "missing_title"), F.when(T.clean(F.col("employment_type")) == "", "missing_employment_type"),
        F.when(F.length(T.clean(F.col("description_text"))) < 40, "description_too_short"),
    ))
    return p.select(F.explode_outer(errors).alias("r")).groupBy(F.coalesce("r", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def dedup_key(title: str, company: str, location: str, description: str):
    parts = F.concat_ws("|", *[T.key(F.col(c)) for c in (title, company, location)], T.stable_hash(F.col(description)))
    return F.sha2(parts, 256)  # keys and hashes are clean


_DEDUP = f"sha256(concat_ws('|', {q_key('title')}, {q_key('company')}, {q_key('location')}, sha256({q_clean('description_text')})))"


@query("dedup_exact_keep_first", ctes("postings") + f"SELECT {_DEDUP} AS dedup_key, min(job_id) AS job_id, count(*) AS copies FROM postings GROUP BY 1")
def dedup_exact_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-01, DED-02, DED-07: the first of each key. An aggregate, so copies are combined before the shuffle."""
    p = view(spark, sf_dir, "postings").select("job_id", dedup_key("title", "company", "location", "description_text").alias("dedup_key"))
    return p.groupBy("dedup_key").agg(F.min("job_id").alias("job_id"), F.count(F.lit(1)).alias("copies"))


@query("dedup_documents_metrics", f"""
SELECT count(*) AS checked, count(DISTINCT k) AS kept, count(*) - count(DISTINCT k) AS removed, round((count(*) - count(DISTINCT k)) / count(*), 6) AS rate FROM (SELECT sha256({q_clean('text')}) AS k FROM documents)
""")  # fmt: skip
def dedup_documents_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-04: counts of an exact dedup."""
    per = table(spark, sf_dir, "documents").groupBy(T.stable_hash(F.col("text")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    a = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.count(F.lit(1)).alias("kept"))
    return a.select("checked", "kept", (F.col("checked") - F.col("kept")).alias("removed"), F.round((F.col("checked") - F.col("kept")) / F.col("checked"), 6).alias("rate"))


@query("dedup_live_against_offline", ctes("postings") + f"""
, k AS (SELECT job_id, {_DEDUP} AS k FROM postings), live AS (SELECT * FROM k WHERE job_id % 10 = 3), off AS (SELECT * FROM k WHERE job_id % 10 <> 3)
SELECT min(job_id) AS job_id, k AS dedup_key FROM live WHERE k NOT IN (SELECT k FROM off) GROUP BY k
""")  # fmt: skip
def dedup_live_against_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DED-05, JON-09, SID-19: live postings that no offline one equals, each key once."""
    p = once(spark, sf_dir, *TEXT, said=T.stable_hash(F.col("description_text")))
    k = p.select("job_id", F.sha2(F.concat_ws("|", *[T.key(F.col(c)) for c in ("title", "company", "location")], "said"), 256).alias("dedup_key"))
    live, off = k.where("job_id % 10 = 3"), k.where("job_id % 10 <> 3")
    return live.join(off, "dedup_key", "left_anti").groupBy("dedup_key").agg(F.min("job_id").alias("job_id"))


# --- quality and market


def has_value(c: Column) -> Column:
    return ~F.lower(T.clean(c)).isin(*R.INVALID)


_HAS = lambda x: f"(lower({q_clean(x)}) NOT IN ({', '.join(repr(v) for v in R.INVALID)}))"
_QUALITY = {"country": "nation", "city": "location", "salary_any": "coalesce(CAST(salary_min AS VARCHAR), '')", "employment_type_any": "employment_type", "raw_categories": "company_type", "schema_org_skills": "extracted_skills"}


def quality_score(features: dict[str, Column]) -> Column:
    """The sum of the weights of the features that a posting has."""
    return reduce(lambda a, b: a + b, [F.when(has_value(c), R.QUALITY_WEIGHTS[name]).otherwise(0) for name, c in features.items()])


_Q_SCORE = " + ".join(f"CASE WHEN {_HAS(c)} THEN {R.QUALITY_WEIGHTS[n]} ELSE 0 END" for n, c in _QUALITY.items())


@query("quality_score_tiers", ctes("postings") + f"""
, s AS (SELECT job_id, {_Q_SCORE} AS score, region = 'AMERICA' AS us, contains(lower(location), 'remote') AS far FROM postings)
SELECT CASE WHEN score >= 75 THEN 'strong_quality' WHEN score >= 60 THEN 'sampling_eligible' WHEN score >= 35 THEN 'medium_quality' ELSE 'required_ready' END AS tier,
  CASE WHEN score >= 80 THEN '80-100' WHEN score >= 60 THEN '60-79' WHEN score >= 40 THEN '40-59' WHEN score >= 20 THEN '20-39' ELSE '0-19' END AS bucket,
  CASE WHEN us THEN 'us' WHEN far THEN 'non_us_remote_compatible' ELSE 'non_us_not_remote_compatible' END AS market, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM s GROUP BY 1, 2, 3
""")  # fmt: skip
def quality_score_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUA-01, QUA-06, QUA-08, QUA-10, QUA-11."""
    c = F.col
    s = quality_score({"country": c("nation"), "city": c("location"), "salary_any": c("salary_min"), "employment_type_any": c("employment_type"), "raw_categories": c("company_type"), "schema_org_skills": c("extracted_skills")})
    p = view(spark, sf_dir, "postings").select(s.alias("score"), (c("region") == "AMERICA").alias("us"), F.lower("location").contains("remote").alias("far"))
    tier = F.when(c("score") >= 75, "strong_quality").when(c("score") >= 60, "sampling_eligible").when(c("score") >= 35, "medium_quality").otherwise("required_ready")
    bucket = F.when(c("score") >= 80, "80-100").when(c("score") >= 60, "60-79").when(c("score") >= 40, "40-59").when(c("score") >= 20, "20-39").otherwise("0-19")
    market = F.when(c("us"), "us").when(c("far"), "non_us_remote_compatible").otherwise("non_us_not_remote_compatible")
    return p.groupBy(tier.alias("tier"), bucket.alias("bucket"), market.alias("market")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("long").alias("total"))


@query("funnel_cumulative", ctes("postings") + """
, f AS (SELECT salary_max >= 150000 AS a, coalesce(years_required, 0) <= 5 AS b, sponsorship_signal <> 'no_sponsorship' AS c FROM postings),
s AS (SELECT count(*) AS n0, count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE a AND b) AS n2, count(*) FILTER (WHERE a AND b AND c) AS n3 FROM f)
SELECT 'salary' AS stage, n1 AS remaining, n0 - n1 AS removed FROM s UNION ALL SELECT 'years', n2, n1 - n2 FROM s UNION ALL SELECT 'sponsorship', n3, n2 - n3 FROM s
""")  # fmt: skip
def funnel_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03, FLT-04: what is left after each of some filters, in one pass."""
    return funnel(view(spark, sf_dir, "postings"), [
        ("salary", F.col("salary_max") >= 150000), ("years", F.coalesce("years_required", F.lit(0)) <= 5), ("sponsorship", F.col("sponsorship_signal") != "no_sponsorship"),
    ])


def funnel(df: DataFrame, stages: list) -> DataFrame:
    passed = [reduce(lambda a, b: a & b, [c for _, c in stages[: i + 1]]) for i in range(len(stages))]
    one = df.agg(F.count(F.lit(1)).alias("n0"), *[F.count_if(F.coalesce(p, F.lit(False))).alias(f"n{i + 1}") for i, p in enumerate(passed)])
    rows = F.array(*[F.struct(F.lit(name).alias("stage"), F.col(f"n{i + 1}").alias("remaining"), (F.col(f"n{i}") - F.col(f"n{i + 1}")).alias("removed")) for i, (name, _) in enumerate(stages)])
    return one.select(F.inline(rows))


@query("market_top_titles", ctes("postings") + "SELECT lower(title) AS title, count(*) AS n, min(job_id) AS first_seen FROM postings GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 25")
def market_top_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, TOP-07: the 25 most frequent; ties by first seen."""
    p = view(spark, sf_dir, "postings").groupBy(F.lower("title").alias("title")).agg(F.count(F.lit(1)).alias("n"), F.min("job_id").alias("first_seen"))
    return p.orderBy(F.desc("n"), "first_seen").limit(25)


@query("market_skills", ctes("postings") + "SELECT unnest(list_filter(string_split(extracted_skills, '|'), lambda x: x <> '')) AS skill, count(*) AS n, count(DISTINCT source) AS sources FROM postings GROUP BY 1")
def market_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-08: postings and sources by skill."""
    p = view(spark, sf_dir, "postings").select("source", F.explode(T.split_list(F.col("extracted_skills"))).alias("skill"))
    return p.groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


@query("market_missing_fields", ctes("postings") + """
SELECT unnest(['salary_min', 'employment_type', 'extracted_skills', 'years_required']) AS field, unnest([count(*) FILTER (WHERE salary_min IS NULL), count(*) FILTER (WHERE coalesce(employment_type, '') = ''),
  count(*) FILTER (WHERE coalesce(extracted_skills, '') = ''), count(*) FILTER (WHERE years_required IS NULL)]) AS missing, unnest([count(*), count(*), count(*), count(*)]) AS total FROM postings
""")  # fmt: skip
def market_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02, AGG-03: missing values of each field, in one pass."""
    fields = ("salary_min", "employment_type", "extracted_skills", "years_required")
    one = view(spark, sf_dir, "postings").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(c) for c in fields])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing"), F.col("total")) for c in fields])))


@query("market_coverage_by_source", ctes("postings") + """
SELECT source, count(*) AS n, round(avg(CASE WHEN salary_min IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS salary_rate, round(avg(CASE WHEN extracted_skills <> '' OR employment_type <> '' THEN 1.0 ELSE 0.0 END), 4) AS any_rate FROM postings GROUP BY source
""")  # fmt: skip
def market_coverage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03, AGG-04, AGG-05, AGG-11."""
    rate = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 4)
    return view(spark, sf_dir, "postings").groupBy("source").agg(F.count(F.lit(1)).alias("n"), rate(F.col("salary_min").isNotNull()).alias("salary_rate"), rate((F.col("extracted_skills") != "") | (F.col("employment_type") != "")).alias("any_rate"))


@query("market_salary_summary", ctes("postings") + """
, v AS (SELECT company_type, salary_min AS x FROM postings UNION ALL SELECT company_type, salary_max FROM postings)
SELECT company_type, count(*) FILTER (WHERE x BETWEEN 10000 AND 1000000) AS shown, count(*) FILTER (WHERE x < 10000) AS too_low, count(*) FILTER (WHERE x > 1000000) AS too_high,
  round(min(x), 2) AS low, round(max(x), 2) AS high, round(median(x), 4) AS mid FROM v WHERE x IS NOT NULL GROUP BY company_type
""")  # fmt: skip
def market_salary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-09, AGG-10: both ends of the salaries as one column, screened."""
    x = F.col("x")
    v = view(spark, sf_dir, "postings").select("company_type", F.explode(F.array("salary_min", "salary_max")).alias("x")).where(x.isNotNull())
    return v.groupBy("company_type").agg(
        F.count_if(x.between(10000, 1000000)).alias("shown"), F.count_if(x < 10000).alias("too_low"), F.count_if(x > 1000000).alias("too_high"),
        F.round(F.min("x"), 2).alias("low"), F.round(F.max("x"), 2).alias("high"), F.round(F.percentile("x", F.lit(0.5)), 4).alias("mid"),
    )


@query("market_companies", ctes("postings") + f"""
, c AS (SELECT {_q_employer('company')} AS company_key, company, source, job_id FROM postings), s AS (SELECT company_key, source, count(*) AS n FROM c GROUP BY 1, 2),
t AS (SELECT company_key, array_to_string(list(source || ':' || n ORDER BY n DESC, source)[1:5], '|') AS top_sources FROM s GROUP BY 1)
SELECT c.company_key, min(c.company) AS company, count(*) AS n, any_value(top_sources) AS top_sources FROM c JOIN t ON t.company_key = c.company_key GROUP BY 1
""")  # fmt: skip
def market_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18, FEA-26: companies with their postings and commonest sources."""
    c = view(spark, sf_dir, "postings").select(X.employer_key(F.col("company")).alias("company_key"), "company", "source")
    per = c.groupBy("company_key", "source").agg(F.count(F.lit(1)).alias("n"), F.min("company").alias("company"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "source"))), 1, 5)
    by = per.groupBy("company_key").agg(F.min("company").alias("company"), F.sum("n").alias("n"), top.alias("top"))
    return by.select("company_key", "company", "n", F.array_join(F.transform("top", lambda s: F.concat(s["source"], F.lit(":"), (-s["m"]).cast("string"))), "|").alias("top_sources"))


@query("keep_first_per_company", ctes("postings") + "SELECT job_id, company, row_number() OVER (PARTITION BY company ORDER BY salary_min DESC NULLS LAST, job_id) AS place FROM postings QUALIFY place <= 2")
def keep_first_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04, WIN-06, WIN-07, DED-09: the first rows of each key in an order that has no ties."""
    w = Window.partitionBy("company").orderBy(F.desc_nulls_last("salary_min"), "job_id")
    return view(spark, sf_dir, "postings").select("job_id", "company", F.row_number().over(w).alias("place")).where("place <= 2")
