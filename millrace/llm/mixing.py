"""Mixing sources to target weights (native), by pivotal dependent rounding in a distributed reduction tree.

Every document of a source starts with the same number of copies, target / size of the source. Whole copies
are taken; the fractions are rounded by the pivotal method: two documents at a time, mass moves from one to the
other at random until one of the two is 0 or 1. Mass is measured in words (probability times size), so each
move keeps the expected words of the source exactly, and keeps each document's expected copies. What is still
fractional in a leaf of the tree, one document at most, goes to the next level, FANOUT leaves at a time; the
last document of a source is rounded by its own probability. A source thus ends within one document of its
target.

Random numbers are hashes of the pair's ids, so reruns agree whatever the partitioning. Leaves are buckets of a
hash, about FANOUT documents each, so a source that holds most rows is spread like any other.

Defined results: a null text has size 0; documents of size 0 get their fraction rounded on their own; the null
source is a source, the last in order; a source without words has target 0; rows that repeat are units of their
own, numbered among themselves and dealt to leaves by that number too, so that a third of all rows may be alike; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.base import WORD, cut, fresh, join_checked, text_or_empty

#: Documents in a leaf of the reduction tree. Fixed: a leaf is folded in memory.
FANOUT = 48
EPS = 1e-9


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """One row per source of sizes(source, size): source, n, source_size, target.

    Weights go round by code point of the source, null last. A target that passes `most` times its source's size
    stops there and the excess is shared by weight among the others until none is above, which is water-filling:
    with sources in order of size / weight, the first k stop for the largest k that the level allows.
    """
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    # windows over the table of sources, a row each
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = by.withColumn("at", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    full = Window.orderBy("at", F.col("source").isNull(), F.col("source"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / weight_left)
    # the level is that of the first source, in this order, which does not stop
    by = by.withColumn("free", F.min(F.when(F.col("at") >= F.col("level"), F.struct("at", "level"))).over(everything))
    target = F.when(F.col("free").isNotNull(), F.least(F.col("cap"), F.col("free.level") * F.col("weight"))).otherwise(F.col("cap"))
    return by.select("source", "n", "source_size", target.alias("target"))


_UNIT = "struct<id:bigint,nth:bigint,size:bigint,p:double,base:bigint>"


def _uniform(seed: int, *columns: str) -> str:
    return f"((xxhash64({seed}L, {', '.join(columns)}) & 4503599627370495L) / 4503599627370496D)"


def _fold(items: str, seed: int) -> str:
    """SQL that folds an array of units: struct(carry, done), done with p 0 or 1. carry is the unit still open."""
    up = "least((1 - a.carry.p) * a.carry.size, x.p * x.size)"  # words that can move from x to the carried unit
    down = "least(a.carry.p * a.carry.size, (1 - x.p) * x.size)"
    unit = lambda u, p: f"named_struct('id', {u}.id, 'nth', {u}.nth, 'size', {u}.size, 'p', {p}, 'base', {u}.base)"
    moved = f"IF({_uniform(seed, 'a.carry.id', 'a.carry.nth', 'x.id', 'x.nth', 'a.carry.p', 'x.p')} * ({up} + {down}) < {down}, {up}, -{down})"
    # s.d: words moved; the unit that reached its end is done, the other is carried on
    step = f"""transform(array(named_struct('d', {moved}, 'up', {up}, 'down', {down})), s -> CASE
        WHEN s.d > 0 AND s.up = (1 - a.carry.p) * a.carry.size THEN named_struct('done', {unit('a.carry', '1D')}, 'carry', {unit('x', 'x.p - s.d / x.size')})
        WHEN s.d > 0 THEN named_struct('done', {unit('x', '0D')}, 'carry', {unit('a.carry', 'a.carry.p + s.d / a.carry.size')})
        WHEN s.down = a.carry.p * a.carry.size THEN named_struct('done', {unit('a.carry', '0D')}, 'carry', {unit('x', 'x.p - s.d / x.size')})
        ELSE named_struct('done', {unit('x', '1D')}, 'carry', {unit('a.carry', 'a.carry.p + s.d / a.carry.size')}) END)[0]"""
    return f"""aggregate(slice({items}, 2, greatest(0, size({items}) - 1)),
        named_struct('carry', CAST({items}[0] AS {_UNIT}), 'done', CAST(array() AS array<{_UNIT}>)),
        (a, x) -> transform(array({step}), r -> named_struct('carry', r.carry, 'done', concat(a.done, array(r.done))))[0])"""


def mix(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, share: float = 1.0, seed: int = 17, fanout: int = FANOUT) -> DataFrame:
    """sizes: (id long, source, size long). Returns id, source, size, source_size, target, copies long."""
    # rows that are alike get numbers, from a count of them that is summed before the shuffle
    alike = sizes.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(alike.select("id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")))
    targets = cut(source_targets(sizes, weights, most, share))
    on = sizes["source"].eqNullSafe(targets["source"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = join_checked(sizes, targets, on, "left").select(sizes["id"], sizes["nth"], sizes["source"], sizes["size"], "source_size", "target", "n", each.alias("x"))
    base = F.floor(F.col("x") + EPS)
    rows = rows.withColumn("base", base.cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("x") - base)).withColumn("p", F.when(F.col("p") < EPS, 0.0).otherwise(F.col("p")))
    group = ["source", "source_size", "target"]
    pick = [*group, F.col("unit.id").alias("id"), F.col("unit.size").alias("size"), (F.col("unit.base") + F.col("unit.p").cast("long")).alias("copies")]
    alone = (F.col("size") == 0) | (F.col("p") == 0)
    settled = rows.where(alone).select(*group, "id", "size", (F.col("base") + (F.expr(_uniform(seed + 1, "id", "nth")) < F.col("p")).cast("long")).alias("copies"))
    unit = F.struct("id", "nth", "size", "p", "base").cast(_UNIT)
    level = rows.where(~alone).select(*group, unit.alias("unit"), F.ceil(F.col("n") / fanout).alias("buckets"))
    parts, depth = [settled], 0
    most_rows = targets.agg(F.max("n")).first()[0] or 0
    while True:
        depth += 1
        leaf = F.pmod(F.expr(f"xxhash64({seed + 7 * depth}L, unit.id, unit.size, unit.nth)"), F.col("buckets"))
        by = level.withColumn("leaf", leaf).groupBy(*group, "buckets", "leaf")
        # a leaf holds about fanout units; the order inside is a hash's, so that it is no partitioning's
        gathered = by.agg(F.array_sort(F.collect_list(F.struct(F.expr(f"xxhash64({seed + depth}L, unit.id, unit.nth)").alias("at"), F.col("unit").alias("unit")))).alias("items")).withColumn("items", F.col("items.unit"))
        folded = cut(gathered.select(*group, "buckets", F.expr(_fold("items", seed + 100 * depth)).alias("f")))
        parts.append(folded.select(*group, F.explode("f.done").alias("unit")).select(*pick))
        rest = folded.select(*group, F.col("f.carry").alias("unit"), "buckets")
        last = rest.where(F.col("buckets") <= 1)
        u = F.expr(_uniform(seed + 3, "unit.id", "unit.size", "unit.nth"))
        parts.append(last.select(*group, F.col("unit.id").alias("id"), F.col("unit.size").alias("size"), (F.col("unit.base") + (u < F.col("unit.p")).cast("long")).alias("copies")))
        most_rows = -(-most_rows // fanout)
        if most_rows <= 1:
            break
        level = rest.where(F.col("buckets") > 1).select(*group, "unit", F.ceil(F.col("buckets") / fanout).alias("buckets"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns as they were.

    Rows with the same id, source and size share the copies drawn for them: evenly, and the rest by a hash of their
    text and place. Null ids and sources are matched as such.
    """
    size = n_words(text_col)
    drawn = mix(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), size.alias("size")), **options)
    own, of, size_, copies, n, words, times, copy = fresh(docs, "own_id", "own_source", "own_size", "copies", "n_alike", "words", "times", "copy")
    drawn = drawn.groupBy(F.col("id").alias(own), F.col("source").alias(of), F.col("size").alias(size_)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(n))
    drawn = cut(drawn.where(F.col(copies) > 0))
    keyed = docs.withColumn(words, size)
    on = F.col(id_col).cast("long").eqNullSafe(F.col(own)) & F.col(source_col).eqNullSafe(F.col(of)) & (F.col(words) == F.col(size_))
    # rows that are alike in id, source and size take turns by a random number of the row
    keyed = keyed.withColumn(copy, F.xxhash64(text_or_empty(text_col), F.monotonically_increasing_id()))
    shared = F.floor(F.col(copies) / F.col(n)) + (F.pmod(F.col(copy), F.col(n)) < F.pmod(F.col(copies), F.col(n))).cast("long")
    joined = join_checked(keyed, drawn, on, "inner").withColumn(times, shared.cast("int")).where(F.col(times) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
