"""Near-duplicates by b-bit MinHash, confirmed on the words of full shingle sets.

1. Documents with one and the same shingle set form a class; only classes go on.
2. Each class has 224 minima: 36 bands of 6 name its buckets, and the low 4 bits of each minimum are packed into
   14 integers. In a bucket every class pairs with the bucket's smallest one only.
3. Packed signatures are compared by bit counts; the estimate is corrected for chance collisions (a 16th) and a
   pair goes on unless it is more than 5 standard deviations below the threshold.
4. Pairs are confirmed on their shingles, word by word, and links joined into components.
5. Buckets that still hold several components are gone through whole, in blocks: classes of different components
   are compared by bit counts and, where they pass, confirmed on the spot; only links leave the task. Thus pairs
   inside a component cost nothing, no pair that shares a bucket and could still join two components is left
   untested, and a large bucket is spread over tasks.

A pair at the threshold of 85 % misses every one of the 36 bands with probability 4e-8, one at 80 % with 1.8e-5.

Defined results: texts without words (or null) have an empty set and link with nothing; null ids come after all
others; rows that repeat are in one component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import bounded_batches, cut, fresh, join_checked, lookup, text_or_empty

BANDS, ROWS, LANES, BITS = 36, 6, 224, 4
SIGMAS = 5
BLOCK = 512
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, LANES, dtype=np.uint64)
_C = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """LANES minima of each set; no set may be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((LANES, len(sets)), dtype=np.uint64)
    for k in range(LANES):
        out[k] = np.minimum.reduceat(flat * _A[k] + _B[k], starts)
    return out.T


def band_keys(m: np.ndarray) -> np.ndarray:
    from millrace.llm.wordhash import mix

    used = m[:, : BANDS * ROWS].reshape(len(m), BANDS, ROWS)
    return mix((used * _C).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    low = (m & np.uint64((1 << BITS) - 1)).reshape(len(m), -1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).astype(np.int64)


def least_matches(percent: int) -> int:
    """Equal lanes below which a pair is given up."""
    chance = 2.0**-BITS
    rate = chance + (1 - chance) * percent / 100
    return int(np.floor(LANES * rate - SIGMAS * np.sqrt(LANES * rate * (1 - rate))))


def matches(a: str, b: str) -> Column:
    """Equal lanes of two packed signatures, by bit counts."""
    return F.expr(f"""aggregate(zip_with({a}, {b}, (x, y) -> 16 - bit_count(
        ((x ^ y) | shiftrightunsigned(x ^ y, 1) | shiftrightunsigned(x ^ y, 2) | shiftrightunsigned(x ^ y, 3)) & 1229782938247303441L)), 0, (s, v) -> s + v)""")


def _sets(texts: list[str], k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    from millrace.llm.wordhash import chunks, shingles

    for lo, hi in chunks(texts):
        yield lo, shingles(texts[lo:hi], k, lower=True)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """docs(id, text): id, n_shingles, fp (128-bit fingerprint of the set, null if empty), bands, sig."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            ids = batch["id"].astype("Int64")
            for lo, sets in _sets(batch["text"].tolist(), k):
                full = [i for i, s in enumerate(sets) if len(s)]
                fp, bands, sig = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    m = minima([sets[i] for i in full])
                    for i, b, s in zip(full, band_keys(m), packed(m), strict=True):
                        fp[i], bands[i], sig[i] = xxhash.xxh128_digest(sets[i].tobytes()), b, s
                yield pd.DataFrame({"id": ids.iloc[lo : lo + len(sets)].array, "n_shingles": [len(s) for s in sets], "fp": fp, "bands": bands, "sig": sig})

    return docs.mapInPandas(run, "id long, n_shingles long, fp binary, bands array<long>, sig array<long>")


def _words_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """node, words (in lower case, joined by one blank) of the nodes, from the text of one document each."""
    need = cut(nodes.join(classes.select("node", "id", "fp"), "node"))
    ids = need.select(F.col("id").alias("wanted")).distinct()
    texts = join_checked(docs, ids, docs["id"].eqNullSafe(F.col("wanted")), "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            said = batch["text"].tolist()
            for lo, sets in _sets(said, k):
                own = [b" ".join(t.encode().lower().split()).decode() for t in said[lo : lo + len(sets)]]  # bytes.lower() changes A-Z only
                yield pd.DataFrame({"fp": [xxhash.xxh128_digest(s.tobytes()) for s in sets], "words": own})

    found = texts.select("text").mapInPandas(run, "fp binary, words string").join(need.select("fp", "node"), "fp").dropDuplicates(["node"])
    return cut(found.select("node", "words"))


def _shingle_set(said: str, k: int) -> set[tuple[str, ...]]:
    words = said.split(" ")
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)}


def _similar(x: set | np.ndarray, y: set | np.ndarray, percent: int) -> bool:
    """On shingles themselves, or on sorted hashes of them."""
    both = len(x & y) if isinstance(x, set) else np.intersect1d(x, y, assume_unique=True).size
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose full sets of shingles are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    found = _words_of(nodes, classes, docs, k)

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep, last, y = [], None, set()
            by_head = batch.sort_values("b", kind="stable")
            for b, said, other in zip(by_head["b"], by_head["y"], by_head["x"], strict=True):
                if b != last:
                    last, y = b, _shingle_set(said, k)
                keep.append(_similar(_shingle_set(other, k), y, percent))
            yield by_head.loc[keep, ["a", "b"]]

    with_b = pairs.join(found.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    with_both = with_b.join(found.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
    return cut(with_both.mapInPandas(similar, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of edges (a, b), by large-star and small-star."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = cut(large.unionByName(edges.join(least, "u").select("u", F.col("m").alias("v")).where("u > v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


_GROUP = ["bucket", "i", "j"]
_ROW = "bucket long, i int, j int, own int, node long, root long"


def _by_group(rows: DataFrame, each, schema: str) -> DataFrame:
    """each(group) for the rows of each block pair; a group is whole when the next begins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = batch[_GROUP].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
            rest = batch.iloc[cuts[-1] :]
            out = [each(batch.iloc[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi - lo > 1]
            if out:
                yield pd.concat(out, ignore_index=True)
        if rest is not None and len(rest) > 1:
            yield each(rest)

    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInPandas(run, schema)


class _Pairs:
    """The pairs of a group that may link: of different components, near enough by size and bit count, and in the
    first bucket that the two share."""

    fold, ones = [np.uint64(s) for s in (1, 2, 3)], np.uint64(0x1111111111111111)

    def __init__(self, g: pd.DataFrame, percent: int):
        self.sig, self.bands = np.stack(g["sig"].to_numpy()).astype(np.int64).view(np.uint64), np.stack(g["bands"].to_numpy())
        self.own, self.n, self.percent, self.edge = g["own"].to_numpy(), g["n_shingles"].to_numpy(), percent, least_matches(percent)
        self.part = np.unique(g["root"].to_numpy(), return_inverse=True)[1]
        self.band = int(np.flatnonzero(self.bands[0] == g["bucket"].iloc[0])[0])
        self.split = g["i"].iloc[0] != g["j"].iloc[0]

    def of(self, r: int) -> np.ndarray:
        n, m = self.n[r], self.n[r + 1 :]
        ok = (self.part[r + 1 :] != self.part[r]) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))
        if self.split:
            ok &= self.own[r + 1 :] != self.own[r]
        at = np.flatnonzero(ok) + r + 1
        if not len(at):
            return at
        z = self.sig[r] ^ self.sig[at]
        z |= (z >> self.fold[0]) | (z >> self.fold[1]) | (z >> self.fold[2])
        at = at[LANES - np.bitwise_count(z & self.ones).sum(axis=1, dtype=np.int64) >= self.edge]
        return at[~(self.bands[at, : self.band] == self.bands[r, : self.band]).any(axis=1)]


def _across(members: DataFrame, classes: DataFrame, roots: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that share a bucket and are in different components so far.

    Buckets with several components are gone through whole, in blocks. A first pass over packed signatures finds the
    classes with a pair that may link; a second has their words at hand and confirms on the spot (hashes of shingles
    first, then the shingles), so that only links leave a task, and of these none between what it has joined before.
    """
    lab = cut(members.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    several = lab.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("bucket", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = lab.join(several, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
    signed = classes.select("node", "sig", "bands", "n_shingles")

    def open_rows(g: pd.DataFrame) -> pd.DataFrame:
        pairs, keep = _Pairs(g, percent), np.zeros(len(g), dtype=bool)
        for r in range(len(g) - 1):
            at = pairs.of(r)
            if len(at):
                keep[r] = True
                keep[at] = True
        return g.loc[keep, ["bucket", "i", "j", "own", "node", "root"]]

    def links(g: pd.DataFrame) -> pd.DataFrame:
        pairs, node, out = _Pairs(g, percent), g["node"].to_numpy(), []
        said = g["words"].tolist()
        full = [s for _, sets in _sets(said, k) for s in sets]
        for r in range(len(g) - 1):
            for q in pairs.of(r).tolist():
                if pairs.part[q] != pairs.part[r] and _similar(full[r], full[q], percent) and _similar(_shingle_set(said[r], k), _shingle_set(said[q], k), percent):
                    out.append((int(node[r]), int(node[q])))
                    pairs.part[pairs.part == pairs.part[q]] = pairs.part[r]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    left = cut(_by_group(rows.join(signed, "node"), open_rows, _ROW))
    said = _words_of(left.select("node").distinct(), classes, docs, k)
    return _by_group(left.join(said, "node").join(signed, "node"), links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept. Links: 100 * intersection >= percent * union."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = cut(signatures(plain, k))
    full = rows.where("fp is not null")
    classes = full.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("n_shingles", "bands", "sig")], F.min("id").alias("id"), F.count(F.lit(1)).alias("held"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    in_buckets = classes.select("node", F.explode("bands").alias("bucket"))
    shared = in_buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "head")
    members = cut(in_buckets.join(shared, "bucket"))
    star = members.where("node > head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    side = lambda c, s: classes.select(F.col("node").alias(c), F.col("sig").alias(s), F.col("n_shingles").alias(s + "n"))
    near = star.join(side("a", "x"), "a").join(side("b", "y"), "b")
    near = near.where((matches("x", "y") >= least_matches(percent)) & (100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")))
    links = [_confirm(cut(near.select("a", "b")), classes, plain, k, percent)]
    roots = cut(components(links[0]))
    more = cut(_across(members, classes, roots, plain, k, percent))
    if not more.isEmpty():
        links.append(more)
        roots = cut(components(reduce(DataFrame.unionByName, links)))
    label = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = label.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("id").alias("component_id"))
    label = label.join(smallest, "root", "left").select("fp", "held", F.coalesce("component_id", "id").alias("component_id"))
    found = lookup(rows.select("id", "n_shingles", "fp"), cut(label), "fp", "held", rows.count())
    component = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, all columns as they were.

    Texts without words stay, and so do rows without an id that are alike to none; rows that share the id of a
    document that goes, go with it; rows that repeat whole stay together; an empty table stays empty.
    """
    (own,) = fresh(docs, "gone_id")
    gone = cut(near_duplicates(docs, id_col, text_col, k, percent).where("not kept").select(F.col(id_col).alias(own)).distinct())
    return join_checked(docs, gone, F.col(id_col).eqNullSafe(F.col(own)), "left_anti")
