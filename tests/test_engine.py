"""Functions, folds, sources and streams against plain Python."""

import html
import io
import json
import random
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.functions import features as X
from millrace.functions import text as T
from millrace.operators.ranking import diverse
from millrace.operators.selection import capped
from millrace.sources import readers
from millrace.streaming import events


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()) or "x int"
    row = spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()[0]
    return row


@pytest.mark.parametrize(
    ("text", "want"),
    [("a &lt;b&gt;x&lt;/b&gt; c", "a x c"), ("<p>Hi&nbsp;there</p>\n\tyou", "Hi there you"), (None, ""), ("a\0b", "a b"), ("x &amp;lt; y", "x &lt; y")],
)
def test_clean(spark, text, want):
    assert one(spark, T.clean(F.col("t")), t=text) == want


def test_unescape_all(spark):
    for t in ("&eacute;&#x41;&hellip; &amp;amp;", "plain", "&notanentity;"):
        assert one(spark, T.unescape_all(F.col("t")), t=t) == html.unescape(t)


@pytest.mark.parametrize(("text", "want"), [("$1,234.5", 1234.5), ("12d", None), ("1_000", None), ("", None), ("-3", -3.0), (".5", 0.5), ("1e3", 1000.0)])
def test_number(spark, text, want):
    assert one(spark, T.number(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("https://www.a.com/x?y", "a.com"), ("www.b.org", "b.org"), ("c.net:80/p", "c.net:80"), ("", "")])
def test_domain(spark, text, want):
    assert one(spark, T.domain(F.col("t")), t=text) == want


def test_lists(spark):
    assert one(spark, T.split_list(F.col("t")), t="Python, sql; PYTHON|\n Spark ,") == ["Python", "sql", "Spark"]
    assert one(spark, T.piped(F.col("t"), 2), t="a|b, c|A|d") == "a|b"
    assert one(spark, T.without_secrets(F.col("t")), t="http://x/?app_key=1&q=2&token=abc") == "http://x/?app_key=REDACTED&q=2&token=REDACTED"


def test_years_and_salary(spark):
    for t, want in (("5+ years of experience, or 3 yrs experience", 3), ("minimum of 7 years work experience", 7), ("20 years experience", None), ("2 years required", 2), ("in 3 years", None)):
        assert one(spark, X.years_required(F.col("t")), t=t) == want, t
    for t, want in (("Salary $120k-$150k", (120000, 150000)), ("pay $90,000 to $80,000 annually", (80000, 90000)), ("$95k", (95000, None)), ("120k to 150k", (None, None)), ("earn $ 85,000 usd", (85000, None))):
        got = one(spark, X.salary(F.col("t")), t=t)
        assert (got["low"], got["high"]) == want, t


def test_features(spark):
    assert one(spark, X.seniority(F.col("t"), F.lit("")), t="Internal tools engineer") == "internship"
    assert one(spark, X.skills(F.col("t"), F.lit("C++ and scikit-learn, sklearn; R programming")), t="Java dev") == ["scikit-learn", "scikit-learn", "java", "c++", "r"]
    assert one(spark, X.skills(F.col("t"), F.lit("")), t="javascript sqlx") == []
    assert one(spark, X.employer_key(F.col("t")), t="Acme Technologies, Inc.") == "acme"
    assert one(spark, X.employer_key(F.col("t")), t="The Company Inc") == "the"
    assert one(spark, X.employer_key(F.col("t")), t="US Services LLC") == "us services llc"
    assert one(spark, X.phrases(F.col("t"), ("ts/sci", "dod", "sci")), t="needs TS-SCI") == ["ts/sci", "sci"]
    for t, want in (("2024-03-01", date(2024, 3, 1)), ("03/01/2024", date(2024, 3, 1)), ("45000", date(2023, 3, 15)), ("01-Mar-2024", date(2024, 3, 1)), ("nope", None)):
        assert one(spark, X.filing_date(F.col("t")), t=t) == want, t
    s = one(spark, X.location_signals(F.col("t"), F.lit(""), F.lit("")), t="London, ON, Canada")
    assert (s["us"], s["abroad"]) == (False, True)
    assert one(spark, X.location_signals(F.col("t"), F.lit("not remote"), F.lit("")), t="Austin, TX").asDict() == {"remote": False, "us": True, "abroad": False, "bay_area": False}


def sequential_caps(rows, caps, target):
    used, out = {}, []
    for i, *keys in rows:
        if len(out) < target and all(used.get((k, v), 0) < caps[k] for k, v in enumerate(keys)):
            out.append(i)
            for k, v in enumerate(keys):
                used[k, v] = used.get((k, v), 0) + 1
    return out


def test_capped_is_the_sequential_pass(spark):
    rng = random.Random(8)
    for n, caps, target in ((120, (4, 9), 60), (60, (1, 1), 60), (80, (5, 100), 10)):
        rows = [(i, rng.choice("aaabcdefg"), rng.choice("xxyz")) for i in range(n)]
        df = spark.createDataFrame(rows, "i long, a string, b string")
        got = [r.i for r in capped(df, "i", {"a": caps[0], "b": caps[1]}, target).collect()]
        assert sorted(got) == sequential_caps(rows, caps, target)


def sequential_diverse(rows, k):
    chosen, place = [], {}
    for r in sorted(rows, key=lambda r: r[5]):
        if r[2] not in place:
            if len(chosen) < k:
                place[r[2]] = len(chosen)
                chosen.append(r)
            continue
        now = chosen[place[r[2]]]
        gap, more = now[3] - r[3], r[4] - now[4]
        if more > 0 and gap <= 0.08 and (gap <= 0.03 or more >= 2):
            chosen[place[r[2]]] = r
    return [r[1] for r in chosen]


def test_diverse_is_the_sequential_pass(spark):
    rng = random.Random(2)
    for _ in range(3):
        scores = sorted((rng.random() * 0.4 for _ in range(60)), reverse=True)
        rows = [("p", i, f"c{rng.randrange(15)}", s, rng.randrange(6), i + 1) for i, s in enumerate(scores)]
        df = spark.createDataFrame(rows, "profile_id string, job_id long, cluster string, final_score double, completeness int, base_rank int")
        assert [r.job_id for r in diverse(df, 10).orderBy("position").collect()] == sequential_diverse(rows, 10)


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": {"b": 1}, "c": "x"}\n\nbroken\n{"a": {"b": "two"}}\n')
    got = readers.read_json_lines(spark, f"{tmp_path}/a.jsonl").select(readers.get("v", "a.b").alias("b"), readers.get("v", "c").alias("c")).collect()
    assert sorted(((r.b, r.c) for r in got), key=str) == [("1", "x"), ("two", None)]
    assert tuple(readers.count_broken(spark, f"{tmp_path}/a.jsonl").first()) == (3, 1)
    with pytest.raises(Exception):  # noqa: B017
        readers.read_json_strict(spark, f"{tmp_path}/a.jsonl", "c string").collect()
    (tmp_path / "p1.json").write_text(json.dumps({"results": [{"id": "1", "title": "A"}, {"id": "2", "title": "B"}]}))
    assert [(r.id, r.place) for r in readers.read_payloads(spark, f"{tmp_path}/p1.json", "results", "struct<id string, title string>").collect()] == [("1", 0), ("2", 1)]
    empty, full = spark.range(0), spark.range(3)
    assert readers.first_that_has_rows(lambda: 1 / 0, lambda: empty, lambda: full).count() == 3


def test_table_sources(spark, tmp_path):
    (tmp_path / "f.csv").write_text('Case No,EMPLOYER NAME,Status\n1,"Acme, Inc",OK\n2,,\n')
    got = readers.read_csv_aliased(spark, f"{tmp_path}/f.csv", {"case": ("CASE_NUMBER", "CASE_NO"), "employer": ("EMPLOYER_NAME",), "other": ("NOPE",)}).collect()
    assert [tuple(r) for r in got] == [("1", "Acme, Inc", None), ("2", None, None)]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Case No</t></si><si><t>State</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="C2" t="inlineStr"><is><t>CA</t></is></c></row><row><c r="A3"><v>7</v></c></row></sheetData></worksheet>')
    (tmp_path / "s.xlsx").write_bytes(data.getvalue())
    assert [r.cells for r in readers.read_spreadsheets(spark, f"{tmp_path}/s.xlsx").orderBy("row").collect()] == [{"STATE": "CA"}, {"CASE_NO": "7"}]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(data.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no")
    assert sorted((r.text or "") for r in readers.read_word_documents(spark, f"{tmp_path}/*.docx").collect()) == ["", "One\nTwo"]


def test_append_and_fingerprint(spark):
    old, new = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",), ("c",)], "k string")
    assert [r.k for r in readers.append_new(old, new, "k").collect()] == ["c"]
    f = lambda d: d.agg(readers.fingerprint(d, "k").alias("f")).first().f
    assert f(old) == f(old.orderBy(F.desc("k"))) != f(new)


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 3:02d} 0{i % 9}:00:00", i % 4, "ab"[i % 2], float(i), "{}") for i in range(60)]
    df = spark.createDataFrame(rows + rows[:10], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    got = events.drain(events.unique_events(events.read_events(spark, f"{tmp_path}/in"), "90 days").select("event_id"), f"file://{tmp_path}/u", "append")
    assert sorted(r.event_id for r in got.collect()) == list(range(60))
    got = events.drain(events.daily_counts(events.read_events(spark, f"{tmp_path}/in", 1)), f"file://{tmp_path}/d", "complete")
    want = df.groupBy(F.to_date("ts").alias("d"), "event_type").count()
    assert sorted((str(r.w.start.date()), r.event_type, r.n) for r in got.collect()) == sorted((str(r.d), r.event_type, r["count"]) for r in want.collect())


def test_entry_module_lists_queries_with_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
