"""Texts are read to their ends, and what a document says by itself is put together with what precedes it."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.functions import features as X
from millrace.functions import fit as M
from millrace.functions import rules as R
from millrace.functions import text as T
from millrace.operators import fit, summary
from millrace.plans.views import TEXT, beginnings, narrow, view

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables with few, odd documents; the last words of some lie far behind all cuts of old."""
    d, far = str(tmp_path_factory.mktemp("odd")), "word " * 2000
    for t in ("orders", "customer", "nation", "region"):
        shutil.copy(f"{SMALL}/{t}.parquet", d)
    said = [
        far + "top secret dashboards", far + "a dashboard of an AI lab", far + "with 4 years of experience", None, "", "lab, 3 years &amp;lt;b&amp;gt;x", "<b>Secret</b> sci", "clearance " + far,
        "level 3 at an intern-\tship", "i " * 343 + "senior lead", "grad", "etl" * 700, "of machine\n learning",
    ]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(said)], "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(f"{d}/all")
    os.rename(next(f"{d}/all/{f}" for f in os.listdir(f"{d}/all") if f.endswith(".parquet")), f"{d}/documents.parquet")
    return d


def run(spark, name, d):
    return __spark_entry__.queries()[name](spark, d)


def alike(spark, name, d, want):
    """Whether the query has just the rows of `want`."""
    got = run(spark, name, d).select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_company_signals_of_whole_texts(spark, odd):
    p, c = view(spark, odd, "postings"), F.col
    s = X.company_signals(c("company"), c("title"), c("company_type"), c("description_text"), most=None)
    alike(spark, "features_company_signals", odd, p.select("job_id", s.alias("s")).select("job_id", F.array_join("s.defense_terms", "|").alias("defense_terms"), F.array_join("s.lab_terms", "|").alias("lab_terms"), "s.defense"))
    got = run(spark, "features_company_signals", odd)
    assert got.where("job_id % 13 = 0 and defense_terms like '%top secret%'").count() == got.where("job_id % 13 = 0").count() > 0


def test_role_families_of_whole_texts(spark, odd):
    c, p = F.col, view(spark, odd, "postings")
    alike(spark, "features_role_families", odd, p.select("job_id", F.array_join(X.families(c("description_text"), R.DESCRIPTION_FAMILIES), "|").alias("description_families")))
    got = run(spark, "features_role_families", odd).where("job_id % 13 = 1")
    assert 0 < got.count() == got.where("description_families like '%analytics_entry%'").count()


def test_years_of_whole_texts(spark, odd):
    got = run(spark, "features_years_salary", odd).where("job_id % 13 = 2 and job_id % 7 not in (0, 2)")
    assert {r.years for r in got.collect()} == {4}


def test_long_texts_are_cleaned_alike(spark):
    odd = [None, "", " \0 a\0\0b &nbsp;&nbsp; c\t\r\n  d  ", "&amp;lt;b&amp;gt; x", "　a\x85\x1cb", "<\0> İ", "a   b    c     d", "  x  y <i\n>z</i>"]
    p, c = spark.createDataFrame([(t,) for t in odd], "t string"), F.col("t")
    for r in p.select(T.clean(c).alias("want"), T.clean_long(c).alias("got"), T.key(T.untagged(c)).alias("key"), T.key(T.clean(c)).alias("same")).collect():
        assert (r.got, r.key) == (r.want, r.same)


@pytest.mark.parametrize("name", ["fit_role_families", "fit_roles"])
def test_fit_has_no_row_a_title_and_text(spark, odd, monkeypatch, name):
    seen, once = [], fit.distinct
    monkeypatch.setattr(fit, "distinct", lambda spark, sf_dir, *keys: seen.append(keys) or once(spark, sf_dir, *keys))
    rows = M.role_fitted(M.said_facts(view(spark, odd, "postings"), "job_id").crossJoin(M.prepared(view(spark, odd, "seekers")))).withColumn("family_score", M.family_score())
    names = {"fit_role_families": [F.array_join(n, "|").alias(n) for n in ("required_title", "required_said", "preferred_title", "preferred_said")] + ["family_score"], "fit_roles": ["target_role", "off_target"]}
    alike(spark, name, odd, rows.select("profile_id", "job_id", *names[name]))
    assert seen and not any({"title", *TEXT} <= set(keys) for keys in seen)


@pytest.mark.parametrize("name", ["fit_title_signals"])
def test_levels_are_read_once_a_text(spark, odd, monkeypatch, name):
    seen, once = [], fit.distinct
    monkeypatch.setattr(fit, "distinct", lambda spark, sf_dir, *keys: seen.append(keys) or once(spark, sf_dir, *keys))
    rows = M.said_facts(view(spark, odd, "postings"), "job_id")
    alike(spark, name, odd, rows.select("job_id", *[F.array_join(n, "|").alias(n) for n in ("weak", "generic", "levels", "junior_levels")]))
    assert seen and not any({"title", *TEXT} <= set(keys) for keys in seen)


def test_levels_that_begin_in_the_title(spark, odd, monkeypatch):
    c, terms = F.col, ["staff", "level 3", "engineer senior lead", "c"]
    own = spark.createDataFrame([(t,) for t in ("New", "Chief Level", "Head", "Sr", "Entry-", "Data engineer", "", "a <b", "Objective C", "x &lt;")], "title string")
    monkeypatch.setattr(fit, "titles", lambda spark, sf_dir: own)
    begin = beginnings(spark, odd, 700).cache()
    texts = begin.select(*TEXT, *fit.level_facts(c("said"), terms)).cache()
    got = fit.levels(spark, odd, texts.crossJoin(own), texts, terms)
    want = begin.crossJoin(own).select("title", *TEXT, M.level_bits(T.clean(F.concat_ws(" ", "title", "said")), terms).alias("want"))
    rows = got.join(want, ["title", *TEXT])
    assert rows.count() == want.count() > 100 and rows.where("levels <> want").count() == 0
    assert rows.where(f"title = 'New' and levels & {1 << len(R.LEVELS)} <> 0").count() > 0


@pytest.mark.parametrize("title", ["Data", "a <b", ""])
def test_role_basis_without_titles(spark, odd, monkeypatch, title):
    seen, once = [], summary.combinations
    monkeypatch.setattr(summary, "combinations", lambda spark, sf_dir, *keys: seen.append(keys) or once(spark, sf_dir, *keys))
    monkeypatch.setattr(summary, "titles", lambda spark, sf_dir: spark.createDataFrame([(title,)], "title string"))
    monkeypatch.setattr(summary, "narrow", lambda spark, sf_dir: narrow(spark, sf_dir).withColumn("title", F.lit(title)))
    c, p = F.col, view(spark, odd, "postings")
    hint = F.substring(F.concat_ws(" ", *[F.nullif(T.clean(c(n)), F.lit("")) for n in ("extracted_skills", "description_text")]), 1, 1200)
    alike(spark, "summary_role_basis", odd, p.select("job_id", X.filing_family(F.concat_ws(" ", F.lit(title), hint), F.lit("")).alias("family")))
    assert seen and not any("title" in keys for keys in seen)


@pytest.mark.parametrize("name", ["fit_scores", "summary_best_ten", "summary_quality_gate"])
def test_scores_have_no_row_a_title_and_text(spark, odd, monkeypatch, name):
    seen, once = [], fit.distinct
    monkeypatch.setattr(fit, "distinct", lambda spark, sf_dir, *keys: seen.append(keys) or once(spark, sf_dir, *keys))
    got = run(spark, name, odd)
    if name == "fit_scores":
        rows = M.fitted(M.facts(view(spark, odd, "postings")).crossJoin(M.prepared(view(spark, odd, "seekers"))), F.pmod("job_id", F.lit(101)) / 100)
        want = rows.select("profile_id", "job_id", F.round("penalty", 6).alias("penalty"), F.round(F.col("raw_score") + 1e-9, 6).alias("final_score"))
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert seen and not any({"title", *TEXT} <= set(keys) for keys in seen)
