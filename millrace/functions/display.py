"""What a reader sees: labels of scores, sources and values, salaries, safe wording, notes, contacts and addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as T

# Wordings and lists that results depend on.
VALUES = {
    "fulltime": "Full-time", "full_time": "Full-time", "full-time": "Full-time", "parttime": "Part-time", "part_time": "Part-time", "part-time": "Part-time", "contract": "Contract", "temporary": "Temporary",
    "internship": "Internship", "entry_junior": "Entry / junior", "junior": "Entry / junior", "entry": "Entry / junior", "mid": "Mid-level", "midlevel": "Mid-level", "mid_level": "Mid-level", "senior": "Senior",
    "staff": "Staff", "principal": "Principal", "lead": "Lead",
}
AUTHORIZATION = {"mentions_sponsorship_or_work_auth": "Mentions sponsorship/work authorization", "no_sponsorship": "Says no sponsorship", "unknown": "Not stated in posting", "": "Not stated in posting"}
STRATEGIES = {"Apply Now": "Recommended", "Same-company alternative": "Additional posting", "Potential duplicate role": "Similar posting"}
SAFE = (
    ("Strong target-role/title match", "Strong title match for your target role"), ("Partial target-role/title match", "Partial title match for your target role"), ("Weak target-role/title match", "Weak title match for your target role"),
    ("Matches required role family", "Matches required role area"), ("Matches preferred role family", "Matches preferred role area"),
    ("Weak description-level preferred role-family signal", "Some job-description evidence matches your preferred role area"), ("Preferred-region location matches profile preference", "Location matches your preference"),
    ("Salary meets preference when listed", "Listed salary appears to meet your preference"), ("salary_missing", "Salary preference cannot be verified because salary is missing"),
    ("salary missing", "Salary preference cannot be verified because salary is missing"), ("sponsorship_unknown", "Sponsorship not stated in the posting"), ("Sponsorship is unknown", "Sponsorship not stated in the posting"),
    ("mentions_sponsorship_or_work_auth", "Posting mentions sponsorship or work authorization"), ("no_sponsorship", "Posting says no sponsorship"), ("ml_related", "ML / AI"), ("research_ai", "AI research"), ("ml_infra", "ML infrastructure"),
    ("data_engineering", "data engineering"), ("analytics_entry", "entry-level analytics"), ("bi_analytics", "BI / analytics"), ("large_company", "large company"), ("medium_company", "medium company"), ("small_company", "small company"),
    ("research_lab", "research lab"), ("Hard-skill evidence uses admitted scoring-safe sidecar terms", "Skills confirmed in the job text"), ("Matched admitted hard-skill sidecar terms", "Skills confirmed in the job text"),
    ("sidecar", "offline evidence"), ("scoring-safe", "verified"),
)
ACTIVITY = {
    "recent_lca_activity_high": "high recent H-1B LCA activity", "recent_lca_activity_moderate": "moderate recent H-1B LCA activity", "recent_lca_activity_low": "low recent H-1B LCA activity",
    "recent_lca_activity_no_certified_cases": "recent H-1B LCA activity without certified cases", "historical_lca_activity_only": "historical H-1B LCA activity only", "no_lca_activity_in_cache": "no H-1B LCA activity in the local cache",
}
NOTES = (
    "Employer has {} for {} roles in the local DOL OFLC LCA cache. This does not confirm sponsorship for this specific posting.",
    "Employer has H-1B LCA activity in the local DOL OFLC cache, but no exact role-family row matched this posting. This does not confirm sponsorship for this specific posting.",
    "No exact normalized employer match was found in the local LCA cache. Absence of a match is not evidence that the employer will not sponsor.",
)
JOB_BOARDS = (
    "careerbuilder.com", "careerbuilder.co.uk", "careerbuilder.ca", "careerbuilder.vn", "careerbuilder.se", "snagajob.com", "efinancialcareers.co.uk", "jobs.aarp.org", "linkedin.com", "jobs.de", "applitrack.com", "indeed.com",
    "glassdoor.com", "ziprecruiter.com", "monster.com", "greenhouse.io", "lever.co", "workdayjobs.com", "myworkdayjobs.com",
)
AUXILIARY = ("audition", "auditions", "survey", "surveys", "culture", "assessment", "assessments", "recruiting", "recruitment", "careers", "jobs")
EMAIL, PHONE, LINKEDIN = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"(?:\+?1[\s.-]*)?(?:\(?\d{3}\)?[\s.-]*)\d{3}[\s.-]*\d{4}", r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/[^\s|,;]+"


def _words(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def titled(c: Column) -> Column:
    """Underscores to blanks, each word with a capital."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def strength(score: Column) -> Column:
    return F.when(score >= 0.72, "Strong match").when(score >= 0.62, "Good match").otherwise("Possible fit")


def authorization(signal: Column) -> Column:
    s = F.lower(T.clean(signal))
    return F.coalesce(F.element_at(_words(AUTHORIZATION), s), F.concat(F.upper(F.substring(s, 1, 1)), F.replace(F.substring(s, 2, 1000), F.lit("_"), F.lit(" "))))


def value(c: Column) -> Column:
    def shown(t: Column) -> Column:
        known = F.element_at(_words(VALUES), F.replace(F.lower(t), F.lit(" "), F.lit("_")))
        return F.when(F.lower(t).isin("", "unknown"), "Not listed").when(known.isNotNull(), known).when(t.contains("_") & (F.lower(t) == t), titled(t)).otherwise(t)

    return T.let(T.clean(c), shown)


def provider(source: Column) -> Column:
    def shown(s: Column) -> Column:
        named = [(F.lower(s).contains(n.lower()), n) for n in ("CareerBuilder", "Adzuna", "JSearch")]
        out = F.when(s == "", "Not listed")
        for cond, name in named:
            out = out.when(cond, name)
        return out.otherwise(titled(s))

    return T.let(T.clean(source), shown)


def salary(raw: Column, low: Column, high: Column) -> Column:
    raw, low, high = T.clean(raw), T.clean(low), T.clean(high)
    return F.when(raw != "", raw).when((low != "") & (high != ""), F.concat_ws("-", low, high)).when(low != "", low).when(high != "", high).otherwise("Salary not listed")


def chips(skills: Column, most: int = 4) -> Column:
    """struct<visible, extra> of a list of skills."""
    named = F.filter(F.transform(skills, lambda x: T.clean(x)), lambda s: s != "")
    return T.let(named, lambda a: F.struct(F.slice(a, 1, most).alias("visible"), F.greatest(F.lit(0), F.size(a) - most).alias("extra")))


def safe(c: Column) -> Column:
    """Internal names replaced, one after the other; what is left of underscores in all-lower text goes."""
    out = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), SAFE, T.clean(c))
    return T.let(out, lambda t: F.when(t.contains("_") & (F.lower(t) == t), F.replace(t, F.lit("_"), F.lit(" "))).otherwise(t))


def strategy(c: Column) -> Column:
    return T.let(T.clean(c), lambda t: F.coalesce(F.element_at(_words(STRATEGIES), t), t))


def activity(label: Column) -> Column:
    return F.coalesce(F.element_at(_words(ACTIVITY), label), F.replace(label, F.lit("_"), F.lit(" ")))


def evidence_note(role: Column, employer: Column, family: Column, label: Column) -> Column:
    by_role = F.format_string(NOTES[0].replace("{}", "%s"), activity(label), family)
    return F.when(role, by_role).when(employer, NOTES[1]).otherwise(NOTES[2])


def same_domain(a: Column, b: Column) -> Column:
    """Equal, or one a sub-domain of the other."""
    under = lambda x, y: x.endswith(F.concat(F.lit("."), y))
    return (a != "") & (b != "") & ((a == b) | under(a, b) | under(b, a))


def job_board(domain: Column) -> Column:
    return reduce(lambda x, y: x | y, [(domain == d) | domain.endswith(f".{d}") for d in JOB_BOARDS])


def auxiliary(domain: Column) -> Column:
    return T.let(T.key(domain), lambda k: reduce(lambda x, y: x | y, [k.contains(t) for t in AUXILIARY]))


def contacts(c: Column) -> Column:
    first = lambda p: T.clean(F.regexp_extract(T.text(c), p, 0))
    return F.struct(first(EMAIL).alias("email"), first(PHONE).alias("phone"), first(LINKEDIN).alias("linkedin"))
