"""What follows from a posting's text is computed once a text: the plan that has a row a posting doesn't hold the text."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.functions import features as X
from millrace.functions import text as T
from millrace.operators import ranking, retrieval
from millrace.plans.views import TEXT, cleaned, distinct, view

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["features_years_salary", "features_role_families", "features_first_match", "summary_role_basis", "dedup_live_against_offline", "fit_title_signals", "fit_role_families", "fit_roles"])
def test_text_is_read_once(spark, name):
    plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan


def test_company_split(spark):
    rows = [
        ("Top", "Secret", "sci fi", "x"), ("Acme Research", "Lab", "", "x"), ("Meta", "", "", "AI lab of dod"), ("A", "b", "Top", "secret sci and clearance"), (None, None, None, None), ("Booz", "", "", "allen"),
    ]
    p, c = spark.createDataFrame(rows, "company string, title string, kind string, text string"), F.col
    want = X.company_signals(c("company"), c("title"), c("kind"), c("text"))
    p = p.withColumn("want", want).withColumn("bits", X.company_bits(c("company"), c("title"), c("kind"), X.company_words(X.padded(X.start(c("text"), 2500)))))
    for r in p.select("want", X.company_signals_of(c("bits")).alias("got"), X.plain(c("company"), c("title"), c("kind")).alias("plain")).collect():
        assert r.plain and all((("|".join(r.want[n]) if n.endswith("terms") else r.want[n]) == r.got[n]) for n in r.got.asDict())
    odd = spark.createDataFrame([("a <b",), ("AT&amp;T",), ("AT&T",)], "company string").select(X.plain(c("company")).alias("p")).collect()
    assert [r.p for r in odd] == [False, False, True]


def test_location_split(spark):
    rows = [("not", "remote", "x"), ("Remote", "", "US"), ("London", "anywhere", "in the US."), ("Austin, TX", "on site", "only; remote"), (None, None, None)]
    p, c = spark.createDataFrame(rows, "location string, title string, text string"), F.col
    got = X.location_signals_of(c("location"), c("title"), X.remote_words(X.padded(X.start(c("text"), 1200))))
    for r in p.select(X.location_signals(c("location"), c("title"), c("text")).alias("want"), got.alias("got")).collect():
        assert r.want == r.got


@pytest.mark.parametrize("name", ["skill_occurrences", "skill_occurrence_manifest"])
def test_occurrences_are_searched_once_a_text(spark, monkeypatch, name):
    postings, search, seen = view(spark, SMALL, "postings", counted=True), retrieval.occurrences, []
    want = search(retrieval.field_inputs(postings))
    if name == "skill_occurrence_manifest":
        want = retrieval.occurrence_manifest(want, postings.count())
    monkeypatch.setattr(retrieval, "occurrences", lambda inputs: seen.append(inputs.columns) or search(inputs))
    got = __spark_entry__.queries()[name](spark, SMALL)
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(got.collect()) == sorted(want.collect())
    assert seen and not any("job_id" in columns for columns in seen)


def test_cleaned_is_the_cleaned_description(spark, tmp_path):
    odd = ["", "   x <b>y</b>", None, "&lt;i&gt; a", "b > c", "\0\0", "&amp;lt; <", "<p>", "two  \t blanks\n", "+ years"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(odd)] + [(3, "again", "s")], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(-20, 200).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    want = distinct(spark, str(tmp_path), *TEXT).select(*TEXT, T.clean(F.col("description_text")).alias("said"))
    got = cleaned(spark, str(tmp_path))
    key = lambda r: (r.said_no, r.doc_id, r.said)
    assert want.count() > 60 and sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_letters_that_count_as_others(spark):
    rows = [(1, "KAFKA ſql", "a"), (2, "İ statİstics and statıstıcs İ SQL", "a"), (3, "ΑΣ sqlİ", "a")]
    got = retrieval.occurrences(spark.createDataFrame(rows, "job_id long, text string, field string"))
    assert sorted((r.job_id, r.field, r.skill, r.start, r.stop) for r in got.collect()) == [(1, "a", "kafka", 0, 5), (1, "a", "sql", 6, 9), (2, "a", "sql", 30, 33), (2, "a", "statistics", 2, 12), (2, "a", "statistics", 17, 27)]


def test_display_diversity_reads_texts_once(spark, monkeypatch):
    rows = ranking.ranked(spark, SMALL).where(F.size("violations") == 0).withColumn("base_rank", F.row_number().over(ranking.base_order()))
    cluster = F.concat_ws("|", T.key(F.col("company")), ranking.display_title()).alias("cluster")
    rows = rows.select("profile_id", "job_id", cluster, "final_score", ranking.completeness().alias("completeness"), "base_rank")
    want = sorted(ranking.diverse(rows, 25).collect())
    monkeypatch.setattr(ranking, "signals", None)  # what cleans a text for each posting
    assert len(want) > 25 and sorted(__spark_entry__.queries()["display_diversity"](spark, SMALL).collect()) == want
