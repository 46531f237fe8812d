"""Features inferred from a posting's words. Rules are arguments; most are first-match lists over lower-case text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import rules as R
from millrace.functions.text import ENTITIES, clean, key, let, text


def any_in(c: Column, words) -> Column:
    """Whether c holds one of the words, anywhere: `intern` is in `internal`."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def first_match(c: Column, table, default: str | Column = "unknown") -> Column:
    """Label of the first row of the table one of whose words c holds."""

    def chain(t: Column) -> Column:
        out = None
        for label, words in table:
            out = F.when(any_in(t, words), label) if out is None else out.when(any_in(t, words), label)
        return out.otherwise(default if isinstance(default, Column) else F.lit(default))

    return let(c, chain)


def _first_rule(t: Column, table) -> Column:
    """Number of the first row of the table one of whose words t holds, else that of its rows."""
    out = F.lit(len(table))
    for i, (_, words) in reversed(list(enumerate(table))):
        out = F.when(any_in(t, words), i).otherwise(out)
    return out


def said_rule(t: Column, table) -> Column:
    """What rule_label needs of a text: its first rule, and as much of its beginning as a word may reach into."""
    most = max(len(w) for _, words in table for w in words)
    return F.struct(_first_rule(t, table).alias("at"), F.substring(t, 1, most).alias("head"))


def rule_name(at: Column, table, default: str | Column) -> Column:
    out = default if isinstance(default, Column) else F.lit(default)
    for i, (label, _) in enumerate(table):
        out = F.when(at == i, label).otherwise(out)
    return out


def rule_label(own: Column, said: Column, table, default: str | Column) -> Column:
    """first_match over own, a blank and the text of which `said` is the said_rule: a word is in the text, or begins
    before it."""
    return rule_name(F.least(_first_rule(F.concat(own, F.lit(" "), said["head"]), table), said["at"]), table, default)


def scan(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def start(c: Column, n: int) -> Column:
    return F.substring(clean(c), 1, n)


def seniority(title: Column, description: Column) -> Column:
    return first_match(scan(clean(title), start(description, 1500)), R.SENIORITY)


def remote(title: Column, description: Column, location: Column) -> Column:
    return first_match(scan(clean(title), clean(location), start(description, 1500)), R.REMOTE)


def employment(title: Column, description: Column, raw: Column) -> Column:
    return first_match(scan(clean(raw), clean(title), start(description, 2000)), R.EMPLOYMENT, F.coalesce(F.nullif(key(raw), F.lit("")), F.lit("unknown")))


def company_type(company: Column, description: Column) -> Column:
    return first_match(scan(clean(company), start(description, 2500)), R.COMPANY_TYPE)


def sponsorship(description: Column) -> Column:
    return first_match(F.lower(start(description, 5000)), R.SPONSORSHIP)


def skills(title: Column, description: Column, keywords=R.SKILLS) -> Column:
    """Skills named as whole words, in the order of the list; sklearn counts as scikit-learn."""
    alike = {"sklearn": "scikit-learn"}
    r = r"\b(?:r programming|r language|programming in r|statistical computing in r|experience (?:with|using) r|using r (?:for|to|and))\b"

    def hits(t: Column) -> Column:
        # the plain search comes first: it is quick, and most keywords aren't there at all
        named = [F.when(t.contains(k) & t.rlike(f"(?<![a-z0-9+#]){re.escape(k)}(?![a-z0-9+#])"), F.lit(alike.get(k, k))) for k in keywords]
        return F.array_compact(F.array(*named, F.when(any_in(t, (" r ", " r", "r ")) & t.rlike(r), F.lit("r"))))

    return let(scan(clean(title), start(description, 5000)), hits)


def years_required(description: Column) -> Column:
    """The least number of years that an experience phrase asks for, 1 to 15."""
    # The phrases that name a number of years.
    n, unit = r"(1[0-5]|[1-9])", r"\s*(?:\+|plus)?\s*(?:years?|yrs?)"
    what = r"(?:experience|exp\.?|background|expertise|professional experience|work experience|industry experience|hands-on experience)"
    kind = r"(?:relevant\s+|professional\s+|work\s+|industry\s+|hands-on\s+)?"
    asks = r"\b(?:minimum|min\.?|at least|requires?|required|requirement|must have|have|possess|with)\s+(?:of\s+)?"
    found = [
        rf"\b{n}{unit}\s+(?:of\s+)?{kind}{what}\b", rf"{asks}{n}{unit}\s+(?:of\s+)?{kind}{what}\b",
        rf"\b{n}{unit}\s+(?:required|preferred)\b", rf"\b{what}\s*(?:of|:|with)?\s*{n}{unit}\b",
    ]
    numbers = lambda t: F.flatten(F.array(*[F.transform(F.regexp_extract_all(t, F.lit(p), 1), lambda x: x.cast("int")) for p in found]))
    # no phrase is without its unit, and most texts are
    return F.array_min(let(F.lower(clean(description)), lambda t: F.when(any_in(t, ("year", "yr")), numbers(t))))


def salary(*parts: Column) -> Column:
    """struct<low, high, raw> of a range or a single amount, if the text is about money at all."""
    # What an amount and a range look like.
    amount = r"(\d{2,3}(?:,\d{3})?|\d{2,3}\s*k)"
    pair = rf"(?i)(?:\$?\s*)?{amount}\s*(?:-|to|through|\u2013|\u2014)\s*(?:\$?\s*)?{amount}"
    one = rf"(?i)\$\s*{amount}"
    none = F.lit(None).cast("long")

    def value(x: Column) -> Column:
        bare = F.regexp_replace(F.lower(x), "[, ]", "")
        n = F.regexp_replace(bare, "k$", "").try_cast("long") * F.when(bare.endswith("k"), 1000).otherwise(1)
        return let(n, lambda v: F.when(v < 1000, v * 1000).otherwise(v))

    def found(t: Column) -> Column:
        about = any_in(F.lower(t), ("salary", "compensation", "$", "usd", "per year", "annually"))
        return F.when(about, F.struct(*[value(F.regexp_extract(t, p, g)).alias(n) for n, p, g in (("a", pair, 1), ("b", pair, 2), ("c", one, 1))], F.regexp_extract(t, pair, 0).alias("ranged"), F.regexp_extract(t, one, 0).alias("single")))

    def chosen(s: Column) -> Column:
        both, single = (s["a"] > 0) & (s["b"] > 0), s["c"] > 0
        out = lambda low, high, raw: F.struct(low.alias("low"), high.alias("high"), raw.alias("raw"))
        return F.when(both, out(F.least(s["a"], s["b"]), F.greatest(s["a"], s["b"]), s["ranged"])).when(single, out(s["c"], none, s["single"])).otherwise(out(none, none, F.lit("")))

    joined = F.array_join(F.filter(F.array(*[clean(p) for p in parts]), lambda x: x != ""), " ")
    return let(let(joined, found), chosen)


def annual(amount: Column, period: Column) -> Column:
    """An amount by the hour, week, fortnight or month as one by the year."""
    p = F.lower(clean(period))
    times = F.when(p.isin("hour", "hourly", "hr"), 2080).when(p.isin("week", "weekly"), 52).when(p.isin("month", "monthly"), 12).when(p.isin("day", "daily"), 260).otherwise(1)
    return amount * times


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), key(c), F.lit(" "))


def _as_key(word: str) -> str:
    return " " + " ".join(re.findall("[a-z0-9]+", word.lower())) + " "


def within(t: Column, words) -> Column:
    """Those of the words that the padded key t holds, in the words' order."""
    return F.array_compact(F.array(*[F.when(t.contains(_as_key(w)), F.lit(w)) for w in words]))


def phrases(c: Column, words) -> Column:
    """Those of the words that c holds as whole words, in the words' order."""
    return let(padded(c), lambda t: within(t, words))


def families(c: Column, table: dict, most: int | None = None) -> Column:
    """Labels of the table one of whose phrases c holds."""
    labels = lambda t: F.array_compact(F.array(*[F.when(any_in(t, [_as_key(w) for w in words]), F.lit(label)) for label, words in table.items()]))
    return let(padded(c if most is None else start(c, most)), labels)


def title_families(title: Column) -> Column:
    """Labels of the families one of whose titles stands in the title, as written but for case."""
    pattern = lambda label, words: "(?i)\\b(?:" + "|".join([*map(re.escape, words), *R.TITLE_PATTERNS.get(label, ())]).replace("\\ ", " ") + ")\\b"
    return let(clean(title), lambda t: F.array_compact(F.array(*[F.when(t.rlike(pattern(label, words)), F.lit(label)) for label, words in R.TITLE_FAMILIES.items()])))


def matching(t: Column, patterns: dict[str, str]) -> Column:
    """Labels of the patterns that t matches, whatever the case, in their order."""
    return F.array_compact(F.array(*[F.when(t.rlike(f"(?i){p}"), F.lit(label)) for label, p in patterns.items()]))


def company_signals(company: Column, title: Column, kind: Column, description: Column, most: int | None = 2500) -> Column:
    """most: how many characters of the description count; None for all."""
    posting = padded(F.concat_ws(" ", clean(company), clean(title), clean(kind), clean(description) if most is None else start(description, most)))
    hits = lambda t: F.struct(within(t, R.DEFENSE).alias("defense"), within(t, R.RESEARCH_LABS).alias("labs"), phrases(company, R.SPONSOR_FRIENDLY).alias("sponsors"))
    k = F.lower(clean(kind))

    def signals(s: Column) -> Column:
        lab, large = (F.size(s["labs"]) > 0) | (k == "research_lab"), (F.size(s["sponsors"]) > 0) | (k == "large_company")
        return F.struct(
            ((F.size(s["defense"]) > 0) | (k == "defense_military")).alias("defense"), large.alias("large"), lab.alias("research"),
            (large | lab).alias("sponsor_friendly"), s["defense"].alias("defense_terms"), s["sponsors"].alias("sponsor_terms"), s["labs"].alias("lab_terms"),
        )

    return let(let(posting, hits), signals)


def plain(*parts: Column) -> Column:
    """Whether no part holds markup or an entity, so that a text that follows them is cleaned as it would be alone."""
    return let(F.concat_ws(" ", *parts), lambda t: ~(t.contains("<") | t.contains("&") & any_in(t, [e for e, _ in ENTITIES])))


def plain_key(*parts: Column) -> Column:
    """The key of plain parts, without cleaning."""
    return F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), "[^a-z0-9]+", " "))


def hits(t: Column, words) -> Column:
    """Which of the words the padded key t holds, as bits."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(t.contains(_as_key(w)), F.lit(1 << i)).otherwise(F.lit(0)) for i, w in enumerate(words)]).cast("long")


def named(bits: Column, words) -> Column:
    """The words of the bits, in the words' order, joined by a bar."""
    return F.concat_ws("|", *[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(w)) for i, w in enumerate(words)])


def _head(t: Column, *lists) -> Column:
    return F.substring(t, 1, max(len(_as_key(w)) for words in lists for w in words))


def company_words(said: Column) -> Column:
    """What company_signals_of needs of a text, given as a padded key."""
    return let(said, lambda t: F.struct(hits(t, R.DEFENSE).alias("defense"), hits(t, R.RESEARCH_LABS).alias("labs"), _head(t, R.DEFENSE, R.RESEARCH_LABS).alias("head")))


def after(sentence: Column, head: Column) -> Column:
    """A padded key of a plain sentence and the text that follows, of whose padded key this is the beginning."""
    return let(plain_key(sentence), lambda k: F.when(k == "", head).otherwise(F.concat(F.lit(" "), k, head)))


def company_words_after(sentence: Column, said: Column) -> Column:
    """company_words of a plain sentence and the text of which `said` is the company_words; null: of no text."""
    both = lambda t: F.struct(hits(t, R.DEFENSE).bitwiseOR(said["defense"]).alias("defense"), hits(t, R.RESEARCH_LABS).bitwiseOR(said["labs"]).alias("labs"), _head(t, R.DEFENSE, R.RESEARCH_LABS).alias("head"))
    return F.when(sentence.isNotNull(), let(after(sentence, said["head"]), both)).otherwise(company_words(F.lit("  ")))


def family_bits(t: Column, table: dict) -> Column:
    """Which of the table's labels the padded key t holds a phrase of, as bits."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(_any_key(t, words), F.lit(1 << i)).otherwise(F.lit(0)) for i, words in enumerate(table.values())])


def family_words(said: Column, table: dict) -> Column:
    """What family_bits_after needs of a text, given as a padded key."""
    return let(said, lambda t: F.struct(family_bits(t, table).alias("bits"), _head(t, *table.values()).alias("head")))


def family_bits_after(sentence: Column, said: Column, table: dict) -> Column:
    """family_bits of a plain sentence and the text of which `said` is the family_words; null: of no text."""
    return F.when(sentence.isNotNull(), let(after(sentence, said["head"]), lambda t: family_bits(t, table)).bitwiseOR(said["bits"])).otherwise(F.lit(0))


def bit_labels(bits: Column, labels) -> Column:
    """The labels of the bits, as an array."""
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(w)) for i, w in enumerate(labels)]))


def flags(conditions) -> Column:
    """The conditions that hold, as bits."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, cond in enumerate(conditions)], F.lit(0).cast("long"))


def company_bits(company: Column, title: Column, kind: Column, said: Column) -> Column:
    """The terms of plain company, title and kind and of the text of which `said` is the company_words, as bits: a
    phrase is in the text, or begins before it."""
    own, firm = F.concat(F.lit(" "), plain_key(company, title, kind), said["head"]), F.concat(F.lit(" "), plain_key(company), F.lit(" "))
    found = lambda s: F.struct(hits(s["own"], R.DEFENSE).bitwiseOR(said["defense"]).alias("defense"), hits(s["own"], R.RESEARCH_LABS).bitwiseOR(said["labs"]).alias("labs"), hits(s["firm"], R.SPONSOR_FRIENDLY).alias("sponsors"), F.lower(clean(kind)).alias("kind"))
    return let(F.struct(own.alias("own"), firm.alias("firm")), found)


def company_signals_of(s: Column) -> Column:
    """company_signals of company_bits; terms are joined by bars."""
    lab, large = (s["labs"] != 0) | (s["kind"] == "research_lab"), (s["sponsors"] != 0) | (s["kind"] == "large_company")
    return F.struct(
        ((s["defense"] != 0) | (s["kind"] == "defense_military")).alias("defense"), large.alias("large"), lab.alias("research"), (large | lab).alias("sponsor_friendly"),
        named(s["defense"], R.DEFENSE).alias("defense_terms"), named(s["sponsors"], R.SPONSOR_FRIENDLY).alias("sponsor_terms"), named(s["labs"], R.RESEARCH_LABS).alias("lab_terms"),
    )


def company_flags(s: Column) -> Column:
    """company_signals_of without the terms."""
    lab, large = (s["labs"] != 0) | (s["kind"] == "research_lab"), (s["sponsors"] != 0) | (s["kind"] == "large_company")
    return F.struct(((s["defense"] != 0) | (s["kind"] == "defense_military")).alias("defense"), large.alias("large"), lab.alias("research"), (large | lab).alias("sponsor_friendly"))


def remote_words(said: Column) -> Column:
    """What location_signals_of needs of a text, given as a padded key."""
    return let(said, lambda t: F.struct(_any_key(t, R.REMOTE_NEGATIONS).alias("no"), _any_key(t, R.REMOTE_TERMS).alias("yes"), _head(t, R.REMOTE_NEGATIONS, R.REMOTE_TERMS).alias("head")))


def location_signals_of(location: Column, title: Column, said: Column) -> Column:
    """location_signals of plain location and title and the remote_words of a text."""
    return location_signals(location, title, F.lit(None), far=lambda: remote_of(plain_key(location, title), said))


def remote_of(own: Column, said: Column) -> Column:
    """Whether a posting is remote, of the key of its plain location and title and the remote_words of its text."""
    t = F.concat(F.lit(" "), own, said["head"])
    return ~(said["no"] | _any_key(t, R.REMOTE_NEGATIONS)) & (said["yes"] | _any_key(t, R.REMOTE_TERMS))


def _any_key(t: Column, words) -> Column:
    return any_in(t, [_as_key(w) for w in words])


def location_signals(location: Column, title: Column, description: Column, begin=start, far=None) -> Column:
    """begin: takes the first characters of the description; another one where it is clean already. far: gives whether
    the posting is remote, where that is known."""
    has = _any_key
    remote_text = F.concat_ws(" ", clean(location), clean(title), begin(description, 1200))
    texts = F.struct(padded(location).alias("at"), F.upper(clean(location)).alias("upper"), (far() if far else padded(remote_text)).alias("far"))

    def found(s: Column) -> Column:
        us = has(s["at"], ("united states", "usa", "us")) | s["upper"].rlike("(?<![A-Z0-9])(" + "|".join(R.US_STATES) + ")(?![A-Z0-9])")
        abroad = has(s["at"], R.NON_US) | (has(s["at"], R.NON_US_CITIES) & ~us)
        return F.struct(
            (s["far"] if far else ~has(s["far"], R.REMOTE_NEGATIONS) & has(s["far"], R.REMOTE_TERMS)).alias("remote"), (us & ~abroad).alias("us"), abroad.alias("abroad"),
            (has(s["at"], R.BAY_AREA) & ~abroad).alias("bay_area"),
        )

    return let(texts, found)


def employer_key(c: Column) -> Column:
    """The key without words of a corporate form; the whole key if nothing else is left."""
    bare = lambda k: F.array_join(F.filter(F.split(k, " "), lambda t: ~t.isin(*R.CORPORATE)), " ")
    return let(key(c), lambda k: F.coalesce(F.nullif(bare(k), F.lit("")), k))


def filing_family(title: Column, code: Column) -> Column:
    by_code = F.lit("other")
    for label, heads in reversed(R.FILING_CODES):
        by_code = F.when(reduce(lambda a, b: a | b, [text(code).startswith(h) for h in heads]), label).otherwise(by_code)
    return first_match(padded(title), [(label, [_as_key(w) for w in words]) for label, words in R.FILING_FAMILIES], by_code)


def filing_date(c: Column) -> Column:
    """A date in one of six forms, or a spreadsheet's serial number."""
    # The forms, in the order in which they are tried.
    forms = ("yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yy", "yyyy/MM/dd", "dd-MMM-yyyy", "MM-dd-yyyy")

    def parsed(t: Column) -> Column:
        serial = F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))
        written = [F.to_date(F.try_to_timestamp(F.substring(t, 1, 11 if "MMM" in f else 10), F.lit(f))) for f in forms]
        return F.when(serial.between(20_000, 80_000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))).otherwise(F.coalesce(*written))

    return let(F.replace(clean(c), F.lit("T00:00:00"), F.lit("")), parsed)
