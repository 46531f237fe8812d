"""Raw records of a bulk dump: nested JSON with several spellings of the same thing.

Paths and numbers are read natively; a search for a key anywhere, and lists of things that may be text, objects or
lists, need recursion and go through Pandas UDFs over the JSON text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.functions import text as T

# Tokens, names in the order in which they are tried, factors and patterns that results depend on.
NOTHING = ("none", "null", "n/a", "na")
NAMES = ("name", "title", "label", "value", "description", "localizationValue", "type", "typename")
NUMBERS = ("$numberDecimal", "$numberDouble", "$numberInt", "$numberLong", "value")
BAD_TITLES = ("", "false", "true", "none", "null", "nan", "n/a", "na")
PERIODS = (
    ("hour", ("hour", "hourly", "/hr", "/hour")), ("day", ("day", "daily", "/day")), ("week", ("week", "weekly", "/week")), ("month", ("month", "monthly", "/month")),
    ("year", ("year", "annual", "annually", "/yr", "/year")),
)
FACTORS = {"year": 1.0, "month": 12.0, "week": 52.0, "day": 260.0, "hour": 2080.0}
CURRENCY = r"(?:\$|usd|dollars?|dollar|gbp|pounds?|pound|eur|euros?|euro)"
AMOUNT = r"(\d+(?:,\d{3})*(?:\.\d+)?\s*k?|\d+(?:\.\d+)?\s*k?)"
SIGNALS = (
    "raw_skills", "schema_org_skills", "raw_industries", "schema_org_industry", "raw_jobnames", "schema_org_occupational_category", "position_department", "raw_keywords", "page_data_keywords", "raw_requirements", "raw_benefits",
    "schema_org_education_requirements", "raw_categories",
)


def _said(x: object) -> str:
    return "" if x is None else " ".join(str(x).replace("\x00", " ").split())


def _items(x: object) -> Iterator[str]:
    """Texts in x, in order: of an object its name, if it has one, else those of its parts."""
    if isinstance(x, dict):
        named = next((_said(x[n]) for n in NAMES if _said(x.get(n)) and not isinstance(x.get(n), dict | list)), "")
        if named:
            yield named
            return
        x = list(x.values())
    if isinstance(x, list):
        for part in x:
            yield from _items(part)
    elif _said(x) and _said(x).lower() not in NOTHING:
        yield _said(x)


def _find(x: object, names: frozenset[str]) -> object:
    """The value of the first key of these names that isn't empty: an object's own keys before what is below them."""
    todo = [x]
    while todo:
        x = todo.pop()
        below = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
        for key, value in x.items() if isinstance(x, dict) else ():
            if key.lower() in names and _said(value):
                return value
        todo += reversed(below)
    return None


def _parsed(s: pd.Series) -> Iterator[object]:
    for t in s:
        try:
            yield None if t is None else json.loads(t)
        except ValueError:
            yield t


@F.pandas_udf(ArrayType(StringType()))
def items(s: pd.Series) -> pd.Series:
    """All texts of a JSON value, as in _items; text that isn't JSON is itself."""
    return pd.Series([list(_items(x)) for x in _parsed(s)], dtype=object)


def find(c: Column, *names: str) -> Column:
    """TXT-06: the value of one of the keys, wherever it is: text as it is, all else as JSON with sorted keys."""
    wanted = frozenset(n.lower() for n in names)

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        found = (_find(x, wanted) for x in _parsed(s))
        return pd.Series([x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for x in found], dtype=object)

    return run(c)


def at(c: Column, path: str) -> Column:
    return F.get_json_object(c, f"$.{path}")


def number(c: Column) -> Column:
    """A number that may be wrapped in an object that names its type."""
    inner = F.coalesce(*[F.get_json_object(c, f"$['{n}']") for n in NUMBERS], c)
    return T.number(inner)


def shown(n: Column, places: int = 2) -> Column:
    """A positive number without idle zeros, else empty."""
    text = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", n), "0+$", ""), "[.]$", "")
    return F.when(n > 0, F.when(n == F.floor(n), F.floor(n).cast("long").cast("string")).otherwise(text)).otherwise("")


def urls(c: Column) -> Column:
    """Addresses among the texts of a value, the first of each."""
    return F.array_join(F.array_distinct(F.filter(items(c), lambda x: x.rlike(r"^(https?://|www\.)"))), "|")


def period(*parts: Column) -> Column:
    """The period that the texts name, by the first rule that holds; else the first text."""
    joined = F.lower(F.concat_ws(" ", *[F.nullif(T.clean(p), F.lit("")) for p in parts]))

    def named(t: Column) -> Column:
        out = F.when(t == "", "")
        for name, words in PERIODS:
            out = out.when(F.exists(F.array(*map(F.lit, words)), t.contains), name)
        return out.otherwise(F.lower(T.clean(parts[0])))

    return T.let(joined, named)


def annual(n: Column, of: Column) -> Column:
    """By the year; without a known period only what is 1000 or more."""
    factor = F.element_at(F.create_map(*[F.lit(x) for p in FACTORS.items() for x in p]), of)
    return F.when(n > 0, F.when(factor.isNotNull(), n * factor).when(n >= 1000, n))


def _k(c: Column) -> Column:
    return T.let(F.regexp_replace(F.lower(c), "[, ]", ""), lambda t: F.regexp_replace(t, "k$", "").try_cast("double") * F.when(t.endswith("k"), 1000.0).otherwise(1.0))


def salary_text(c: Column, hint: Column) -> Column:
    """struct<low, high>, by the year, that a text with a known period names: a range, else one amount."""
    pair = rf"(?i)(?:{CURRENCY}\s*)?{AMOUNT}\s*(?:-|to|through|–|—)\s*(?:{CURRENCY}\s*)?{AMOUNT}"
    by_money, by_period = rf"(?i){CURRENCY}\s*{AMOUNT}", rf"(?i){AMOUNT}\s*(?:/|per\s+)(?:hour|hr|day|week|month|year|yr)"
    group = lambda t, p, g: F.nullif(F.regexp_extract(t, p, g), F.lit(""))

    def read(s: Column) -> Column:
        t, of = s["t"], s["of"]
        ranged = t.rlike(pair)
        found = F.when(ranged, F.array(_k(group(t, pair, 1)), _k(group(t, pair, 2)))).otherwise(F.array(_k(F.coalesce(group(t, by_money, 1), group(t, by_period, 1)))))
        return F.array_sort(F.filter(F.transform(found, lambda v: annual(v, of)), lambda v: v.isNotNull()))

    def ends(a: Column) -> Column:
        return F.struct(F.get(a, F.lit(0)).alias("low"), F.when(F.size(a) > 1, F.element_at(a, -1)).alias("high"))

    both = F.struct(T.clean(c).alias("t"), period(hint, c).alias("of"))
    values = T.let(both, lambda s: F.when((s["t"] != "") & (s["of"] != ""), read(s)).otherwise(F.array().cast("array<double>")))
    return T.let(values, ends)


def salary(c: Column) -> Column:
    """FEA-11, FEA-12: struct<low, high, method> of a record: schema.org's amounts, else its own, else its text."""
    base, own = lambda p: at(c, f"json.schemaOrg.baseSalary.value.{p}"), lambda p: at(c, f"salary.{p}")
    exact = T.number(F.coalesce(base("value"), F.when(~at(c, "json.schemaOrg.baseSalary.value").startswith("{"), at(c, "json.schemaOrg.baseSalary.value"))))
    low, high = T.number(base("minValue")), T.number(base("maxValue"))
    nothing = low.isNull() & high.isNull()
    low, high = F.when(nothing, exact).otherwise(low), F.when(nothing, exact).otherwise(high)
    alone = low.isNull() & high.isNull()
    low, high = F.when(alone, number(own("value"))).otherwise(low), F.when(alone, number(own("value"))).otherwise(high)
    given = F.struct(low.alias("low"), high.alias("high"), period(own("period"), base("unitText"), own("text")).alias("of"), salary_text(own("text"), own("period")).alias("text"))

    def chosen(s: Column) -> Column:
        a, b = annual(s["low"], s["of"]), annual(s["high"], s["of"])
        lows = F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)).otherwise(a)
        highs = F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)).otherwise(b)
        how = F.when(s["of"].isin("", "year"), "source_salary").otherwise(F.concat(F.lit("source_salary_annualized_from_"), s["of"]))
        out = lambda x, y, m: F.struct(x.alias("low"), y.alias("high"), m.alias("method"))
        none = F.lit(None).cast("double")
        return F.when(lows.isNotNull() | highs.isNotNull(), out(lows, highs, how)).when(s["text"]["low"].isNotNull(), out(s["text"]["low"], s["text"]["high"], F.lit("source_salary_text"))).otherwise(out(none, none, F.lit("")))

    return T.let(given, chosen)


def title(*candidates: Column) -> Column:
    """struct<title, repaired>: the first candidate that is a title at all."""
    cleaned = [T.clean(c) for c in candidates]
    valid = F.coalesce(*[F.when(~F.lower(c).isin(*BAD_TITLES), c) for c in cleaned], F.lit(""))
    return T.let(F.struct(valid.alias("t"), cleaned[0].alias("first")), lambda s: F.struct(s["t"].alias("title"), ((s["t"] != "") & (s["t"] != s["first"])).alias("repaired")))


def piped(most: int, *parts: Column) -> Column:
    """FEA-13: items of several lists written as text, the first of each spelling, at most so many."""
    split = lambda p: F.split(T.text(p), r"[|;\n\r]+|,\s+(?=[A-Za-z0-9+#])")
    cleaned = F.filter(F.transform(F.flatten(F.array(*map(split, parts))), lambda x: T.clean(x)), lambda x: (x != "") & ~F.lower(x).isin(*NOTHING, "__class__"))
    return F.array_join(F.slice(T.distinct_by(cleaned), 1, most), "|")


def signal_sources(named: dict[str, Column], parsed: Column) -> Column:
    """FEA-14: struct<sources, confidence>: which fields say something, and how much that is worth."""
    labels = F.array_compact(F.array(*[F.when(T.clean(named[n]) != "", n) for n in SIGNALS if n in named]))

    def judged(a: Column) -> Column:
        n = F.size(a)
        by = F.when(n >= 5, "high").when(n >= 3, "medium").when(n >= 1, "low").when(T.clean(parsed) != "", "parser_only").otherwise("none")
        every = F.when(T.clean(parsed) != "", F.concat(a, F.array(F.lit("parser_fallback")))).otherwise(a)
        return F.struct(F.array_join(every, "|").alias("sources"), by.alias("confidence"))

    return T.let(labels, judged)
