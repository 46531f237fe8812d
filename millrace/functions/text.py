"""Scalar functions over text: cleaning, keys, hashes, lists, numbers and addresses.

All are Column to Column and stay in the JVM, but for unescape_all, which knows every HTML entity.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entities decoded natively; unescape_all has the rest.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
_ODD_SPACE = r"\t\n\x0b\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space that isn't one blank already; a lone blank needn't be replaced by itself.
ANY_SPACE = rf"[ {_ODD_SPACE}]{{2,}}|[{_ODD_SPACE}]"


def let(c: Column, f) -> Column:
    """f of c, with c computed once however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


@F.pandas_udf(StringType())
def unescape_all(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """The common entities, natively; texts without any are left alone."""
    out = c
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.when(c.contains("&"), out).otherwise(c)


def untagged(c: Column, decode=unescape) -> Column:
    """Entities decoded once, then tags dropped."""
    return F.regexp_replace(decode(text(c)), "<[^>]+>", " ")


def clean(c: Column, decode=unescape) -> Column:
    """Entities decoded once, then tags dropped, then white space made single."""
    return F.trim(F.regexp_replace(F.replace(untagged(c, decode), F.lit("\0"), F.lit(" ")), ANY_SPACE, " "))


def clean_long(c: Column) -> Column:
    """clean, for long texts: white space is replaced byte by byte, some five times faster than by a pattern. The
    expression is long."""
    def single(t: Column) -> Column:
        for space in ("\0", *(chr(i) for i in range(0x3001) if re.match(f"[{_ODD_SPACE}]", chr(i)))):
            t = F.replace(t, F.lit(space), F.lit(" "))
        # of a run of blanks the last stays; no \0 is left in the text
        for old, new in ((" ", " \0"), ("\0 ", ""), ("\0", "")):
            t = F.replace(t, F.lit(old), F.lit(new))
        return F.trim(t)

    return let(untagged(c), single)


def key(c: Column) -> Column:
    """Lower case, anything but a-z and 0-9, white space too, to one blank."""
    return F.trim(F.regexp_replace(F.lower(untagged(c)), "[^a-z0-9]+", " "))


def stable_hash(c: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(clean(c), 256), 1, length)


def first_nonempty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(clean(c), F.lit("")) for c in columns], F.lit(""))


def distinct_by(array: Column, by=lambda x: F.lower(x)) -> Column:
    """First of each key, in order."""
    return let(array, lambda a: F.filter(a, lambda x, i: F.array_position(F.transform(a, by), by(x)) == i + 1))


def split_list(c: Column, pattern: str = r"[|,;\n]+") -> Column:
    """A list written as text: items cleaned, empty ones dropped, the first of each spelling kept."""
    return distinct_by(F.filter(F.transform(F.split(text(c), pattern), lambda x: clean(x)), lambda x: x != ""))


def piped(c: Column, most: int) -> Column:
    return F.array_join(F.slice(split_list(c, r"[|;\n\r]+|,\s+(?=[A-Za-z0-9+#])"), 1, most), "|")


def number(c: Column) -> Column:
    """A number with or without commas and a dollar sign, else null; nothing else is tried."""
    plain = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
    return let(F.regexp_replace(clean(c), "[,$]", ""), lambda bare: F.when(bare.rlike(plain), bare.try_cast("double")))


def flag(c: Column) -> Column:
    return F.lower(clean(c)).isin("1", "true", "yes", "y", "on")


def domain(c: Column) -> Column:
    """Host of an address, which may lack its scheme, without www."""
    url = let(F.lower(clean(c)), lambda u: F.when(u.rlike("^[a-z][a-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u)))
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")), r"^www[.]", "")


def without_secrets(c: Column) -> Column:
    """An address whose credential parameters are hidden."""
    return F.regexp_replace(text(c), r"(?i)([?&](?:app_id|app_key|api_key|apikey|key|token|access_token)=)[^&#]*", "$1REDACTED")


def labelled(*parts: tuple[str, Column]) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(f"{label}: "), text(c)) for label, c in parts])


def joined(*columns: Column) -> Column:
    """Non-empty parts, joined by a bar."""
    return F.array_join(F.filter(F.array(*[clean(c) for c in columns]), lambda x: x != ""), " | ")


def snippet(c: Column, start: Column, end: Column, around: int = 90) -> Column:
    lo = F.greatest(F.lit(0), start - around)
    return F.trim(F.substring(c, (lo + 1).cast("int"), (end + around - lo).cast("int")))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key(c), " "), lambda t: F.length(t) >= 2))


def has_phrase(c: Column, phrase: str) -> Column:
    """Whether the key holds the phrase as whole words; c is a key."""
    return F.concat(F.lit(" "), c, F.lit(" ")).contains(f" {phrase} ")


def usd(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def email(c: Column) -> Column:
    return F.regexp_extract(text(c), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", 0)
