"""Market rules against values worked out by hand, selection against a sequential pass, sinks against what they were given."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import market as M
from millrace.operators.selection import first_rows, us_first

COLUMNS = ("title", "company", "link", "description_text", "source_record_id", "source", "country", "raw_source_country", "raw_locale", "location", "state", "city", "location_id", "is_remote", "position_work_type_raw", "raw_work_types", "salary_raw", "salary_min", "salary_max", "raw_salary_text", "schema_org_salary_min", "employment_type", "schema_org_employment_type", "company_url", "raw_categories", "raw_qualifications", "schema_org_skills", "schema_org_experience_requirements", "manifest_score", "employer")
FULL = dict(title="Data Analyst", company="Acme", link="https://x", description_text="Analytics role.", source_record_id="1", source="board", country="US", city="Austin", state="TX", location="Austin, TX", salary_raw="$120,000", employment_type="full-time", company_url="https://e.com", raw_categories="Technology", raw_work_types="Full-time", raw_qualifications="BSc", schema_org_employment_type="FULL_TIME", schema_org_skills="SQL", schema_org_experience_requirements="3 years")


def one(spark, column, **values):
    row = dict.fromkeys(COLUMNS, "") | values
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row)).select(column.alias("r")).first()[0]


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ({}, "us"), ({"source": "cvlibrary_uk", "country": "GB", "state": "London", "city": "London", "location": "London, United Kingdom"}, "non_us_not_remote_compatible"),
        ({"source": "linkedin_ie", "country": "IE", "state": "", "location": "Remote", "description_text": "Remote anywhere role."}, "non_us_remote_compatible"),
        ({"source": "linkedin_uk", "country": "GB", "state": "London", "location": "Remote, United Kingdom", "description_text": "Remote within the UK."}, "non_us_remote_restricted"),
        ({"source": "careerbuilder_uk", "country": "UK", "state": "Leeds", "location": "Remote, UK", "description_text": "Fully remote. UK applications only."}, "non_us_remote_restricted"),
        ({"country": "DE", "location": "Remote", "state": "", "description_text": "Candidates from Germany only."}, "non_us_remote_restricted"), ({"country": "DE", "location": "Remote", "state": "", "description_text": "Only in deutschland."}, "non_us_remote_restricted"),
        ({"country": "", "location": "", "state": "tx"}, "us"), ({"country": "", "location": "", "state": "tx", "source": "board_de"}, "non_us_not_remote_compatible"), ({"country": "", "location": "x", "state": "", "source": "us_board"}, "us"),
        ({"country": "FR", "location": "Paris", "state": "", "raw_locale": "en_us"}, "us"), ({"country": "France", "location": "USA or Paris", "state": ""}, "us"),
    ],
)
def test_market(spark, values, want):
    assert one(spark, M.market(), **(FULL | values)) == want


def test_quality(spark):
    assert one(spark, M.score(), **FULL) == 100 and one(spark, M.score()) == 0
    assert one(spark, M.score(), **(FULL | {"salary_raw": "n/a", "schema_org_salary_min": "5"})) == 100 and one(spark, M.score(), **(FULL | {"salary_raw": "None"})) == 86
    assert one(spark, M.selection_score(), **(FULL | {"manifest_score": "87.9"})) == 87 and one(spark, M.selection_score(), **(FULL | {"manifest_score": "bad"})) == 100
    assert one(spark, M.ready(), **FULL) and not one(spark, M.ready(), **(FULL | {"link": " N/A "}))
    assert one(spark, M.tier(M.score()), **FULL) == "strong_quality" and one(spark, M.tier(M.score()), **(FULL | {"title": ""})) == "not_required_ready"
    assert [one(spark, M.bucket(F.lit(n))) for n in (100, 79, 40, 20, 19)] == ["80-100", "60-79", "40-59", "20-39", "0-19"]
    k = {n: one(spark, c, **(FULL | {"title": " Sr.  Data/ML ", "company": "", "employer": "Acme, Inc", "raw_categories": " A |B", "state": ""})) for n, c in M.keys().items()}
    assert k == {"title": "sr data ml", "company": "acme inc", "category": "A", "state": "(blank)"}


def brute_us_first(rows, target, caps, soft):
    chosen, counts = [], {c: Counter() for c in caps}
    for r in rows:
        if any(counts[c][r[c]] >= cap for c, cap in caps.items()):
            continue
        far = sum(x["market"] != "us" for x in chosen)
        if len(chosen) < target:
            chosen.append(r)
        elif r["market"] != "us" and far < soft:
            home = [(x["score"], i) for i, x in enumerate(chosen) if x["market"] == "us"]
            if not home:
                continue
            i = min(home)[1]
            for c in caps:
                counts[c][chosen[i][c]] -= 1
            chosen[i] = r
        else:
            continue
        for c in caps:
            counts[c][r[c]] += 1
    return sorted(x["i"] for x in chosen)


@pytest.mark.parametrize("seed", range(4))
def test_us_first_is_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    rows = [{"i": i, "score": rng.randrange(86, 90), "market": "us" if rng.random() < 0.85 else "non_us_remote_compatible", "a": rng.randrange(4), "b": rng.randrange(6)} for i in range(200)]
    caps = {"a": 14, "b": 10} if seed % 2 else {"a": 30, "b": 30}
    df = spark.createDataFrame(rows, "i long, score int, market string, a int, b int")
    got = sorted(r.i for r in us_first(df, "i", 40, caps, 12, at_once=3).collect())
    assert got == brute_us_first(rows, 40, caps, 12)


def test_first_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("i")).repartition(5)
    assert [sorted(r.i for r in first_rows(df, "i", n).collect()) for n in (0, 1, 333, 2000)] == [list(range(min(n, 1000))) for n in (0, 1, 333, 2000)]


def test_sinks(spark, tmp_path):
    from millrace.sources import sinks

    df = spark.createDataFrame([(i, f'say "{i}",\nok' if i % 3 else None, i / 2) for i in range(50)], "i long, t string, v double")
    assert sinks.write_csv(df, f"{tmp_path}/c", ["i", "t"]) == 50
    back = sinks.scan_csv(spark, f"{tmp_path}/c", "i long, t string", order="i", offset=5, limit=7)
    assert [tuple(r) for r in back.collect()] == [(i, f'say "{i}",\nok' if i % 3 else None) for i in range(5, 12)]
    sinks.write_json(spark, f"{tmp_path}/r/report.json", {"é": 1, "rows": [1, 2]})
    assert json.loads((tmp_path / "r" / "report.json").read_text(encoding="utf-8")) == {"é": 1, "rows": [1, 2]}
    assert sinks.kind_of("a/B.XLSX") == "xlsx" and sinks.kind_of("x.csv") == "csv"
    with pytest.raises(ValueError, match="pdf"):
        sinks.kind_of("x.pdf")
    assert [p.rsplit("/", 1)[1] for p in sinks.discover(spark, f"{tmp_path}/r", ["*.json", "*.csv"])] == ["report.json"]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, s string")
    assert sorted(map(tuple, sinks.merged(a, spark.createDataFrame([(2, None, "n"), (3, "z", "m")], "id long, s string, n string"), "id").collect()), key=str) == [(1, "x", None), (2, "y", "n"), (3, "z", "m")]
    one = sinks.fingerprint(df, "i", ["t", "v"])
    assert one == sinks.fingerprint(df.repartition(7), "i", ["t", "v"]) != sinks.fingerprint(df.where("i > 0"), "i", ["t", "v"])
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    sinks.write_vectors(v, f"{tmp_path}/v", "model-1")
    assert sinks.load_vectors(spark, f"{tmp_path}/v", "model-1").count() == 20
    with pytest.raises(ValueError, match="model"):
        sinks.load_vectors(spark, f"{tmp_path}/v", "model-2")
    v.where("vec_id < 19").write.mode("overwrite").parquet(f"{tmp_path}/v/vectors")
    with pytest.raises(ValueError, match="fingerprint"):
        sinks.load_vectors(spark, f"{tmp_path}/v", "model-1")
