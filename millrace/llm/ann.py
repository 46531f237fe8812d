"""Approximate nearest neighbours by collision-counting hashing.

Each block of vectors keeps, for each of PROJECTIONS random directions, its vectors sorted by their single
projection. A query opens a window around its own projection in each array and counts, for each vector, the
arrays in which both collide. Windows grow by virtual rehashing: a wider window adds what it newly covers to the
counts, there is no second index. Vectors whose count passes the collision threshold are verified by their exact
cosine; windows grow until k + EXTRA vectors of a block passed, a constant number, or the k best found are so near
that nothing nearer can have escaped.

Queries are a stated set. They are searched one group of bounded bytes after the other, each against all vectors in
blocks of at most BLOCK_ROWS; a group's broadcast goes when its search is written. Sorting a block again for each
group costs less than a hundredth of the group's searches. A task keeps the best k of a query only, so what is
shuffled is k rows a query and task. The work is queries x vectors; with a fixed share of rows as queries it grows
with the square of the table.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; all others
do, however large or small (norms are taken after scaling by a power of two, which is exact); vectors of other
lengths than the query's are no candidates; of query rows with one id the one with the smallest vector counts, and
no row with a query's id is its candidate; other rows that repeat are candidates each; ties go to the smaller id;
fewer than k candidates are all returned; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.base import cut

PROJECTIONS = 112
#: Share of the arrays in which a candidate collides at least.
THRESHOLD = 0.63
#: Half the first window, on vectors of length 1, and its growth.
FIRST, GROWTH = 0.5, 1.25
#: Vectors of a block, besides k, that pass the threshold before a search ends.
EXTRA = 400
#: Vectors of a block, and bytes, at most.
BLOCK_ROWS, BLOCK_BYTES = 10_000, 64_000_000
#: Bytes of the queries that are broadcast at a time, and queries whose counts are held at a time.
QUERY_BYTES, TOGETHER = 16_000_000, 64


def usable(v: str) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.col(v).isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is at least 0.5 and below 1; exact."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


class Block:
    """Sorted projections of some vectors, one array a direction."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, scaled(vectors)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        at = ((self.vectors / self.norms[:, None]) @ directions(vectors.shape[1])).T
        self.order = np.argsort(at, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(at, self.order, axis=1)

    def search(self, own: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, ids and cosines of the k best among the vectors that collide often enough."""
        out = []
        for lo in range(0, len(own), TOGETHER):
            out += self._search(own[lo : lo + TOGETHER], scaled(vectors[lo : lo + TOGETHER]), k)
        return out

    def _search(self, own: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n, least = len(self.ids), int(np.ceil(THRESHOLD * PROJECTIONS))
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        at = (vectors / norms[:, None]) @ directions(vectors.shape[1])
        lo = np.stack([s.searchsorted(a) for s, a in zip(self.sorted, at.T, strict=True)], axis=1)
        hi, counts, half = lo.copy(), np.zeros((len(own), n), dtype=np.int64), FIRST
        out: list = [None] * len(own)
        active = np.arange(len(own))
        while len(active):
            new_lo = np.stack([s.searchsorted(a - half) for s, a in zip(self.sorted, at[active].T, strict=True)], axis=1)
            new_hi = np.stack([s.searchsorted(a + half, "right") for s, a in zip(self.sorted, at[active].T, strict=True)], axis=1)
            ended = []
            for i, q in enumerate(active.tolist()):
                left = [o[a:b] for o, a, b in zip(self.order, new_lo[i].tolist(), lo[q].tolist(), strict=True)]
                right = [o[a:b] for o, a, b in zip(self.order, hi[q].tolist(), new_hi[i].tolist(), strict=True)]
                counts[q] += np.bincount(np.concatenate(left + right), minlength=n)
                found = np.flatnonzero(counts[q] >= least)
                mine = self.ids[found] == own[q]
                found = found[~mine]
                # all rows collide in the end, so a search with few candidates ends too
                enough = len(found) >= k + EXTRA or len(found) + int(mine.sum()) == n
                if enough or len(found) >= k:
                    score = (self.vectors[found] * vectors[q]).sum(axis=1) / (self.norms[found] * norms[q])
                    best = np.lexsort((self.ids[found], -score))[:k]
                    # vectors this near collide far more often than the threshold asks: the k best are safe
                    if enough or np.sqrt(max(0.0, 2 - 2 * score[best[-1]])) <= half / 2:
                        out[q] = (self.ids[found[best]], score[best])
                        ended.append(i)
            lo[active], hi[active] = new_lo, new_hi
            active = np.delete(active, ended)
            half *= GROWTH
        return out


_DIRECTIONS: dict[int, np.ndarray] = {}


def directions(d: int) -> np.ndarray:
    if d not in _DIRECTIONS:
        _DIRECTIONS[d] = np.random.default_rng(11 + d).standard_normal((d, PROJECTIONS))
    return _DIRECTIONS[d]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest found for each query row of vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).where(usable("v") & F.col("id").isNotNull())
    queries = cut(rows.where("q").groupBy("id").agg(F.min("v").alias("v")))
    size = queries.agg(F.sum(F.size("v"))).first()[0]
    groups = max(1, -(-8 * (size or 0) // QUERY_BYTES))
    parts = []
    for g in range(groups):
        asked = queries.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).toArrow()  # about QUERY_BYTES
        held = vectors.sparkSession.sparkContext.broadcast(_by_length(asked))
        parts.append(cut(rows.select("id", "v").mapInPandas(_search(held, k), "query_id long, id long, score double")))
        held.unpersist(blocking=True)
    found = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _by_length(asked) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and vectors, in the order of ids, of an Arrow table's rows by the length of the vector."""
    ids = asked.column("id").to_numpy()
    lists = asked.column("v").combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    ends, flat = np.cumsum(sizes), lists.flatten().to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        own = own[np.argsort(ids[own], kind="stable")]
        out[d] = (ids[own], flat[(ends[own] - d)[:, None] + np.arange(d)])
    return out


def _search(held, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def search(d: int) -> None:
            parts = waiting.pop(d)
            block = Block(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]))
            for j, (ids, score) in enumerate(block.search(*held.value[d], k)):
                if (d, j) in best:
                    ids, score = np.concatenate([best[d, j][0], ids]), np.concatenate([best[d, j][1], score])
                    first = np.lexsort((ids, -score))[:k]
                    ids, score = ids[first], score[first]
                best[d, j] = ids, score

        for batch in batches:
            sizes = batch["v"].map(len).to_numpy()
            for d in np.unique(sizes).tolist():
                if d not in held.value:
                    continue
                own = batch[sizes == d]
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * d)))
                ids, vectors = own["id"].to_numpy(dtype=np.int64), np.stack(own["v"].to_numpy()).astype(np.float64)
                while len(ids):
                    room = most - sum(len(i) for i, _ in waiting.get(d, []))
                    waiting.setdefault(d, []).append((ids[:room], vectors[:room]))
                    ids, vectors = ids[room:], vectors[room:]
                    if sum(len(i) for i, _ in waiting[d]) >= most:
                        search(d)
        for d in list(waiting):
            search(d)
        if best:
            yield pd.DataFrame({
                "query_id": np.concatenate([np.full(len(i), held.value[d][0][j]) for (d, j), (i, _) in best.items()]),
                "id": np.concatenate([i for i, _ in best.values()]),
                "score": np.concatenate([s for _, s in best.values()]),
            })

    return run
