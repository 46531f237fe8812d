"""Operators that once did a part of their job, against plain sequential runs of the whole."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.operators import retrieval, search, sidecars

AUX = ("audition", "auditions", "survey", "surveys", "culture", "assessment", "assessments", "recruiting", "recruitment", "careers", "jobs")


def brute_score(c, i):
    key = lambda t: " ".join("".join(x if x.isascii() and x.isalnum() else " " for x in (t or "").lower()).split())
    own, ck, universal = key(c["name"]), key(i["name"]), key((i["universal_name"] or "").replace("-", " "))
    dom = (i["website"] or "").split("//")[-1].split("/")[0].lower().removeprefix("www.")
    rel = lambda a, b: bool(a and b) and (a == b or a.endswith("." + b) or b.endswith("." + a))
    match, exact = any(rel(dom, d) for d in c["domains"]), bool(own) and own in (ck, universal)
    aux = bool(c["domains"]) and bool(dom) and not match and exact and all(any(t in key(d) for t in AUX) for d in c["domains"])
    conflict = bool(c["domains"]) and bool(dom) and not match and not aux
    contains = bool(own and ck) and not exact and (own in ck or ck in own)
    s = (0.58 if exact else 0.35 if contains else 0) + 0.12 * bool(i["linkedin_url"]) + 0.08 * bool(i["employee_count"]) + 0.05 * bool(i["industries"]) + 0.17 * match - 0.35 * conflict
    return round(max(0.0, min(1.0, s)), 4), conflict


def brute_assign(companies, items):
    out = {}
    for c in companies:
        best, top = None, -1.0
        for i in items:
            if i["batch"] == c["batch"] and i["item"] not in {r[0] for r in out.values()}:
                s, conflict = brute_score(c, i)
                if s > top:
                    best, top = (i["item"], s, conflict), s
        out[c["company"]] = best[:2] if best and top >= 0.4 else (None, 0.0)
    return out


COMPANY = "batch long, company long, company_key string, name string, domains array<string>"
ITEM = "batch long, item long, id string, name string, universal_name string, website string, linkedin_url string, employee_count string, industries array<string>"


def rows_of(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_greedy_assignment_is_the_sequential_run(spark):
    rng = random.Random(4)
    names = ["Acme", "Acme Labs", "Beta-Works", "Beta", "Gamma Inc", "Zeta!", "", "Omega"]
    sites = ["acme.com", "labs.acme.com", "beta.org", "careers.gamma.net", "surveys.omega.io", "other.biz"]
    companies = [{"batch": k // 20, "company": k, "company_key": f"k{k}", "name": rng.choice(names), "domains": rng.sample(sites, rng.randrange(3))} for k in range(60)]
    items = []
    for k in range(150):
        name = rng.choice([*names, "Acme Labs Europe", "unrelated"])
        items.append({
            "batch": rng.randrange(3), "item": k, "id": str(k), "name": name, "universal_name": name.lower().replace(" ", "-"), "website": rng.choice([None, *[f"https://www.{s}/x" for s in sites]]),
            "linkedin_url": rng.choice([None, "l"]), "employee_count": rng.choice([None, "9"]), "industries": rng.choice([None, [], ["a"]]),
        })
    companies.append({"batch": 9, "company": 60, "company_key": "k60", "name": "Delta", "domains": ["delta.com"]})
    items.append(items[0] | {"batch": 9, "item": 150, "name": "Delta", "website": "http://other.biz", "linkedin_url": "l", "employee_count": "9"})
    got = sidecars.assign_greedily(rows_of(spark, companies, COMPANY), rows_of(spark, items, ITEM)).collect()
    assert {r.company: (r.item, r.match_score) for r in got} == brute_assign(companies, items)
    by = {i["item"]: i for i in items}
    for r in got:
        assert r.decision == "no_result" if r.item is None else r.candidate_name == by[r.item]["name"].strip()
        conflict = r.item is not None and brute_score(companies[r.company], by[r.item])[1]
        assert (r.error_code == "domain_conflict") == conflict and json.loads(r.match_features_json)["input_name"] == companies[r.company]["name"]
    assert any(r.item is None for r in got) and any(r.error_code == "domain_conflict" for r in got) and {r.confidence_label for r in got} >= {"high", "medium", "low"}


def test_greedy_assignment_takes_every_company_and_item(spark):
    got = sidecars.greedy_assignment(spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    assert sorted(r.company for r in got) == list(range(n)) and any(r.item is not None and r.item % 11 for r in got)
    assert len({r.item for r in got if r.item is not None}) == sum(r.item is not None for r in got)


def grams(text):
    words = [w for w in re.findall(r"\b\w\w+\b", (text or "").lower()) if w not in rules.STOP_WORDS]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def brute_vectors(rows, features):
    counts = {i: grams(t) for i, t in rows}
    df = Counter(t for c in counts.values() for t in c)
    tf = sum(counts.values(), Counter())
    terms = sorted((t for t in df if df[t] >= 2), key=lambda t: (-tf[t], t))[:features]
    raw = {i: {t: c[t] * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t in terms if c[t]} for i, c in counts.items()}
    return {i: {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()} for i, v in raw.items()}


@pytest.mark.parametrize(("features", "hot"), [(20_000, 1024), (20_000, 20), (150, 40)])
def test_tfidf_search_is_brute_force(spark, features, hot):
    rng = random.Random(6)
    words = ["the", "of", "naïve", "x", *[f"w{i}" for i in range(60)]]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(15)] + [(350, None), (400, ""), (401, "The OF"), (450, rows[3][1].upper())]
    v = brute_vectors(rows, features)
    want = []
    for q in (i for i, _ in rows if i % 50 == 0):
        scores = {d: round(sum(x * v[d].get(t, 0) for t, x in v[q].items()), 6) for d in v if d != q}
        want += [(q, d, s, k + 1) for k, (d, s) in enumerate(sorted(((d, s) for d, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:10])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in search.search(df, F.col("doc_id") % 50 == 0, features=features, block=3, hot=hot).collect()]
    assert {r[0] for r in got} == {r[0] for r in want} and len(got) == len(want)
    by_place = lambda rows: sorted(rows, key=lambda r: (r[0], r[3]))
    for a, b in zip(by_place(got), by_place(want)):
        assert (a[0], a[1], a[3]) == (b[0], b[1], b[3]) and abs(a[2] - b[2]) < 2e-6


def brute_occurrences(rows, policy):
    alone, out = set("abcdefghijklmnopqrstuvwxyz0123456789+#."), []
    for job, title, raw, text in rows:
        for field, t in (("title", title), ("raw_skills", raw), ("description_text", text)):
            if not t or field == "description_text" and (policy == "never" or policy == "when_no_source_skills" and raw):
                continue
            low = t.lower()
            for k in rules.SKILLS:
                at = low.find(k)
                while at >= 0:
                    end = at + len(k)
                    if (at == 0 or low[at - 1] not in alone) and (end == len(low) or low[end] not in alone):
                        out.append((job, field, k, at, end, t[max(0, at - 20) : end + 20].strip()))
                    at = low.find(k, at + 1)
    return sorted(out)


@pytest.mark.parametrize("policy", ["always", "when_no_source_skills", "never"])
def test_skill_occurrences(spark, policy):
    rng = random.Random(3)
    bits = [*rules.SKILLS, "SQL", "Kafka,", "mysql", "sqlx", "c++", "java", "javascript", "PySpark", "spark.", "é", "and", "(docker)"]
    rows = [(i, " ".join(rng.choices(bits, k=3)), rng.choice(["", None, "sql|aws|sql"]), " ".join(rng.choices(bits, k=rng.randrange(60)))) for i in range(80)]
    rows.append((80, "sql sql SQL", None, "mlops, Kafka and kafka; mysql"))
    spans = retrieval.occurrences(retrieval.field_inputs(spark.createDataFrame(rows, "job_id long, title string, raw_skills string, description_text string"), policy))
    got = sorted(tuple(r) for r in spans.collect())
    assert got == brute_occurrences(rows, policy)
    assert {g[2] for g in got} == set(rules.SKILLS)
    for r in retrieval.occurrence_manifest(spans, len(rows)).collect():
        own = [g for g in got if g[2] == r.skill]
        ids = sorted({g[0] for g in own})
        assert (r.n, r.jobs, r.samples) == (len(own), len(ids), "|".join(map(str, ids[:5]))) and abs(r.mean_start - sum(g[3] for g in own) / len(own)) < 1e-3
        assert abs(r.coverage - len(ids) / len(rows)) < 1e-6 and r.fields == "|".join(sorted(f"{f}={c}" for f, c in Counter(g[1] for g in own).items()))


def test_pipeline_drops_pairs_between_80_and_85_percent(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(7)
    rows, shares = [], []
    for k in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        copy = list(words)
        copy[30], copy[70] = f"e{k}", f"f{k}"
        apart = list(words)
        for at in (15, 30, 45, 60, 75):
            apart[at] = f"g{k}x{at}"
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(copy)), (3 * k + 2, " ".join(apart))]
        sets = [{tuple(w[i : i + 5]) for i in range(96)} for w in (words, copy, apart)]
        shares += [len(sets[0] & sets[1]) / len(sets[0] | sets[1]), *(len(s & sets[2]) / len(s | sets[2]) for s in sets[:2])]
    assert all(0.8 <= s < 0.85 for s in shares[::3]) and all(s < 0.8 for i, s in enumerate(shares) if i % 3)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [i for i, _ in rows if i % 3 != 1]
