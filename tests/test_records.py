"""Raw records and displayed text against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import display as D
from millrace.functions import records as R


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first()[0]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (["Python", {"name": "SQL"}, None, "n/a", ["x", {"value": " y "}]], ["Python", "SQL", "x", "y"]), ({"a": {"b": ["c"]}, "d": "e"}, ["c", "e"]), ({"type": "t", "title": "first of the names"}, ["first of the names"]),
        ({"name": "null"}, ["null"]), ("null", []), (5, ["5"]), ([], []),
    ],
)
def test_items(spark, value, want):
    assert one(spark, R.items(F.col("v")), v=json.dumps(value)) == want


def test_find_takes_an_objects_own_keys_first(spark):
    deep = {"a": {"title": "deep"}, "Title": "own"}
    assert one(spark, R.find(F.col("v"), "title"), v=json.dumps(deep)) == "own"
    assert one(spark, R.find(F.col("v"), "title"), v=json.dumps([{"x": [{"title": ""}, {"y": {"TITLE": {"b": 1, "a": 2}}}]}])) == '{"a":2,"b":1}'
    assert one(spark, R.find(F.col("v"), "title"), v="not json") is None


@pytest.mark.parametrize(
    ("text", "hint", "want"),
    [
        ("$30 - $45 per hour", "", (62400.0, 93600.0)), ("4k to 5k", "monthly", (48000.0, 60000.0)), ("usd 90,000", "year", (90000.0, None)), ("20/hour", "", (41600.0, None)), ("competitive", "hour", (None, None)),
        ("$50", "", (None, None)), ("100 usd a day: $100 daily", "", (26000.0, None)), ("", "year", (None, None)),
    ],
)
def test_salary_text(spark, text, hint, want):
    r = one(spark, R.salary_text(F.col("t"), F.col("h")), t=text, h=hint)
    assert (r["low"], r["high"]) == want


def test_salary_of_a_record(spark):
    def read(**record):
        r = one(spark, R.salary(F.col("v")), v=json.dumps(record))
        return r["low"], r["high"], r["method"]

    schema = lambda **v: {"schemaOrg": {"baseSalary": {"value": v}}}
    assert read(json=schema(minValue=60, maxValue="40", unitText="HOUR")) == (83200.0, 124800.0, "source_salary_annualized_from_hour")
    assert read(json=schema(value={"$numberInt": 1}, unitText="YEAR"), salary={"value": {"$numberDouble": "5000"}, "period": "MONTH"}) == (60000.0, 60000.0, "source_salary_annualized_from_month")
    assert read(salary={"value": 500}) == (None, None, "")
    assert read(salary={"value": 5000}) == (5000.0, 5000.0, "source_salary")


def test_titles_and_numbers(spark):
    assert tuple(one(spark, R.title(F.col("a"), F.col("b")), a="N/A", b="Analyst")) == ("Analyst", True)
    assert tuple(one(spark, R.title(F.col("a"), F.col("b")), a=" Data  Analyst", b="x")) == ("Data Analyst", False)
    assert tuple(one(spark, R.title(F.col("a"), F.col("b")), a="none", b="")) == ("", False)
    for v, want in (("100", "100"), ("62400.5", "62400.5"), ("0.1", "0.1"), ("-3", ""), ("1e3", "1000")):
        assert one(spark, R.shown(R.number(F.col("v"))), v=v) == want
    assert one(spark, R.urls(F.col("v")), v=json.dumps({"url": "https://a.com", "sameAs": ["www.b.org", "https://a.com", "c.net"]})) == "https://a.com|www.b.org"
    assert one(spark, R.piped(3, F.col("a"), F.col("b")), a="Python|sql, C++", b="PYTHON;n/a;etl;more") == "Python|sql|C++"


def test_display(spark):
    assert one(spark, D.value(F.col("v")), v="full time") == "Full-time" and one(spark, D.value(F.col("v")), v="on_call_work") == "On Call Work" and one(spark, D.value(F.col("v")), v="Unknown") == "Not listed"
    assert one(spark, D.provider(F.col("v")), v="adzuna_api") == "Adzuna" and one(spark, D.provider(F.col("v")), v="my_board") == "My Board" and one(spark, D.provider(F.col("v")), v="") == "Not listed"
    assert one(spark, D.authorization(F.col("v")), v="some_signal") == "Some signal" and one(spark, D.authorization(F.col("v")), v="") == "Not stated in posting"
    assert one(spark, D.salary(F.col("a"), F.col("b"), F.col("c")), a="", b="5", c="") == "5" and one(spark, D.salary(F.col("a"), F.col("b"), F.col("c")), a="", b="", c="") == "Salary not listed"
    assert one(spark, D.safe(F.col("v")), v="salary_missing") == "Salary preference cannot be verified because salary is missing" and one(spark, D.safe(F.col("v")), v="a_b") == "a b" and one(spark, D.safe(F.col("v")), v="A_b") == "A_b"
    c = one(spark, D.contacts(F.col("v")), v="Call (415) 555-0199 or mail a.b@x.io; see www.linkedin.com/in/me, thanks")
    assert tuple(c) == ("a.b@x.io", "(415) 555-0199", "www.linkedin.com/in/me")
    assert one(spark, D.same_domain(F.col("a"), F.col("b")), a="jobs.x.com", b="x.com") and not one(spark, D.same_domain(F.col("a"), F.col("b")), a="notx.com", b="x.com")
    assert one(spark, D.job_board(F.col("v")), v="uk.indeed.com") and one(spark, D.auxiliary(F.col("v")), v="x-careers.com") and not one(spark, D.job_board(F.col("v")), v="myindeed.com")
