"""Chat formatting (native), by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only its text is
trainable. A conversation that ends in another turn, or has no assistant turn, also gives one example without a
target, so that no turn is lost. Offsets of all turns come from one window over the conversation; the examples
are prefixes of one formatted string.

Template: <|im_start|>ROLE newline TEXT <|im_end|> newline. Control strings inside texts and roles are escaped:
a backslash goes after their first character, and a backslash is doubled; unescape() takes them back. A newline
in a role is written as <|nl|>.

Defined results: null text and null role count as empty; rows that share conv_id and turn are ordered by role,
then text; null turns come first; a null conv_id is a conversation; roles other than `assistant` are context.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Strings with a meaning in this or a common other template; none is left whole inside a text.
CONTROL = (START, END, NEWLINE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), heads, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target_role: str = "assistant") -> DataFrame:
    """conv, example int (from 0), target_turn (place of the target among the turns, from 0, or null),
    formatted, loss_start and loss_length (characters of formatted; 0 and 0 without a target)."""
    says = F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), says.alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("said"),
    )
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("said"))).withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "said")
    rows = rows.withColumn("place", F.row_number().over(order) - 1).withColumn("end", F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.col("role") == target_role
    rows = rows.select("conv", F.struct("place", target.alias("target"), "end", F.length("head").alias("head"), F.length("body").alias("body"), F.length("segment").alias("length"), "segment").alias("t"))
    by = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    whole = by.select("conv", F.concat_ws("", F.col("t.segment")).alias("whole"), F.filter("t", lambda t: t["target"] | (t["place"] == F.size("t") - 1)).alias("t"))
    each = whole.select("conv", "whole", F.posexplode("t").alias("example", "t"))
    on_target = F.col("t.target")
    return each.select(
        F.col("conv").alias(conv),
        "example",
        F.when(on_target, F.col("t.place")).alias("target_turn"),
        F.substring(F.col("whole"), F.lit(1), F.col("t.end").cast("int")).alias("formatted"),
        F.when(on_target, F.col("t.end") - F.col("t.length") + F.col("t.head")).otherwise(0).cast("long").alias("loss_start"),
        F.when(on_target, F.col("t.body")).otherwise(0).cast("long").alias("loss_length"),
    )


def loss_text(formatted: str = "formatted", start: str = "loss_start", length: str = "loss_length") -> Column:
    """What an example trains on, as it was written."""
    return unescape(F.substring(F.col(formatted), (F.col(start) + 1).cast("int"), F.col(length).cast("int")))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    segments = F.filter(F.split(formatted, re.escape(END + "\n")), lambda s: s != "")
    opened = F.lit(len(START) + 1)
    inner = F.transform(segments, lambda s: F.substring(s, opened, F.length(s)))
    return F.transform(
        inner,
        lambda s: F.struct(
            unescape(F.replace(F.substring_index(s, "\n", 1), F.lit(NEWLINE), F.lit("\n"))).alias("role"),
            unescape(F.substring(s, F.length(F.substring_index(s, "\n", 1)) + 2, F.length(s))).alias("text"),
        ),
    )


def digest(found: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its examples: turns, what is trained on, and formatted characters."""
    part = F.struct("example", F.when(F.col("target_turn").isNotNull(), loss_text()).otherwise("").alias("loss"))
    by = found.groupBy(conv).agg(
        F.array_sort(F.collect_list(part)).alias("parts"),
        F.max_by("formatted", "example").alias("longest"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    loss = F.concat_ws("", F.col("parts.loss"))
    turns = F.concat_ws("", F.transform(read_turns(F.col("longest")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return by.select(
        conv,
        F.size(read_turns(F.col("longest"))).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
