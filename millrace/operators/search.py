"""TF-IDF vectors of texts over words and pairs of words, and the nearest texts by them.

The vocabulary has a fixed size and is sent to the workers; texts are counted in Arrow batches with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import rules as R
from millrace.plans.views import table
from millrace.registry import query

_WORD = re.compile(r"\b\w\w+\b")
FEATURES, BLOCK, HOT, NEAR = 20_000, 4096, 1024, 1e-5


def shared(df: DataFrame) -> DataFrame:
    """df, computed once and kept where all executors see it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not found:
            return df.localCheckpoint()
        sc.setCheckpointDir(found)
    return df.checkpoint()


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and code of each word that is no stop word, in order, and the words by code."""
    found = [[w for w in _WORD.findall(t.lower()) if w not in R.STOP_WORDS] for t in texts]
    flat = [w for words in found for w in words]
    codes, names = pd.factorize(np.array(flat, dtype=object)) if flat else (np.empty(0, np.int64), np.empty(0, object))
    return np.repeat(np.arange(len(texts)), [len(w) for w in found]), codes.astype(np.int64), names


def _chunks(texts: pd.Series, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some four million characters."""
    lo, size = 0, 0
    for i, n in enumerate(texts.str.len()):
        if size + n > most and i > lo:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def vocabulary(docs: DataFrame, features: int = FEATURES, min_df: int = 2) -> pd.DataFrame:
    """term, df of the terms (words and pairs of neighbours) in at least min_df texts: the most frequent ones, most first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi in _chunks(batch["text"]):
                row, code, names = words_of(batch["text"].iloc[lo:hi].tolist())
                if not len(code):
                    continue
                side = row[1:] == row[:-1]
                n = len(names)
                for keys, rows in ((code, row), ((code[:-1] * n + code[1:])[side], row[1:][side])):
                    by, tf = np.unique(keys, return_counts=True)
                    at = np.searchsorted(by, keys)
                    df = np.bincount(np.unique(at * (hi - lo) + rows) // (hi - lo), minlength=len(by))
                    terms = names[by] if keys is code else names[by // n] + " " + names[by % n]
                    yield pd.DataFrame({"term": terms, "tf": tf, "df": df})

    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "term string, tf long, df long")
    all_terms = parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where(F.col("df") >= min_df)
    return all_terms.orderBy(F.desc("tf"), "term").limit(features).select("term", "df").toPandas()


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, idx (16-bit places in terms, in order), tf (32-bit counts): both as bytes."""
    single = {t: i for i, t in enumerate(terms) if " " not in t}
    pairs = [(*t.split(" "), i) for i, t in enumerate(terms) if " " in t]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi in _chunks(batch["text"]):
                row, code, names = words_of(batch["text"].iloc[lo:hi].tolist())
                n, here = len(names), {w: i for i, w in enumerate(names)}
                place = np.array([single.get(w, -1) for w in names], dtype=np.int64)
                known = sorted((here[a] * n + here[b], i) for a, b, i in pairs if a in here and b in here)
                key, to = (np.array(known, dtype=np.int64).T) if known else (np.empty(0, np.int64), np.empty(0, np.int64))
                feature, rows = place[code], row
                if len(key) and len(code) > 1:
                    pair = code[:-1] * n + code[1:]
                    at = np.minimum(np.searchsorted(key, pair), len(key) - 1)
                    hit = (key[at] == pair) & (row[1:] == row[:-1])
                    feature, rows = np.concatenate([feature, to[at[hit]]]), np.concatenate([row, row[1:][hit]])
                cells, tf = np.unique((rows * FEATURES + feature)[feature >= 0], return_counts=True)
                idx, tf = (cells % FEATURES).astype(np.uint16), tf.astype(np.int32)
                cut = np.searchsorted(cells // FEATURES, np.arange(hi - lo + 1))
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[lo:hi].array, "idx": [idx[a:b].tobytes() for a, b in zip(cut, cut[1:])], "tf": [tf[a:b].tobytes() for a, b in zip(cut, cut[1:])]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, idx binary, tf binary")


class Rows:
    """Vectors of length 1, as cells by row."""

    def __init__(self, rows: pd.DataFrame, idf: np.ndarray):
        self.ids = rows["doc_id"].to_numpy(dtype=np.int64)
        self.starts = np.cumsum([0, *(len(x) // 2 for x in rows["idx"])])
        self.idx = np.frombuffer(b"".join(rows["idx"]), dtype=np.uint16).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.starts))
        x = np.frombuffer(b"".join(rows["tf"]), dtype=np.int32) * idf[self.idx]
        self.w = x / np.sqrt(np.bincount(self.row, weights=x * x, minlength=len(rows)))[self.row]

    def split(self, hot: int) -> tuple[np.ndarray, np.ndarray]:
        """The first `hot` features as a dense matrix, and the places of the other cells."""
        dense, first = np.zeros((len(self.ids), hot), dtype=np.float32), self.idx < hot
        dense[self.row[first], self.idx[first]] = self.w[first]
        return dense, np.flatnonzero(~first)

    def at(self, r: int) -> slice:
        return slice(self.starts[r], self.starts[r + 1])


def _nearest(blocks: Iterator[pd.DataFrame], queries: Rows, idf: np.ndarray, k: int, hot: int) -> pd.DataFrame:
    """The best k of the rows for each query. Scores in 32 bits find those near enough to be among them; 64 bits decide."""
    qd, cold = queries.split(hot)
    cold = cold[np.argsort(queries.idx[cold], kind="stable")]
    per, q_row, q_w = np.bincount(queries.idx[cold], minlength=len(idf)), queries.row[cold], queries.w[cold].astype(np.float32)
    first = np.cumsum(per) - per
    best = [([], []) for _ in queries.ids]
    floor = np.zeros(len(queries.ids))
    for block in blocks:
        d = Rows(block, idf)
        dd, cells = d.split(hot)
        s = qd @ dd.T
        flat = s.reshape(-1)
        for part in np.array_split(cells, max(1, int(per[d.idx[cells]].sum() // 4_000_000))):
            n = per[d.idx[part]]
            to = np.repeat(first[d.idx[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            np.add.at(flat, q_row[to] * len(d.ids) + np.repeat(d.row[part], n), q_w[to] * np.repeat(d.w[part].astype(np.float32), n))
        top = np.partition(s, -min(k + 1, s.shape[1]), axis=1)[:, -min(k + 1, s.shape[1])] if s.shape[1] > k + 1 else np.zeros(len(s))
        least = np.maximum(np.maximum(top, floor) - NEAR, 1e-9)
        for q in np.flatnonzero(s.max(axis=1) >= least):
            at = np.flatnonzero(s[q] >= least[q])
            at = at[d.ids[at] != queries.ids[q]]
            if not len(at):
                continue
            dense = np.zeros(len(idf))
            dense[queries.idx[queries.at(q)]] = queries.w[queries.at(q)]
            exact = np.round([dense[d.idx[d.at(r)]] @ d.w[d.at(r)] for r in at], 6)
            scores, ids = np.concatenate([best[q][0], exact]), np.concatenate([np.array(best[q][1], dtype=np.int64), d.ids[at]])
            order = np.lexsort((ids, -scores))[:k]
            best[q] = scores[order], ids[order]
            if len(order) == k:
                floor[q] = scores[order[-1]]
    return pd.DataFrame({"query_id": np.repeat(queries.ids, [len(b[0]) for b in best]), "doc_id": np.concatenate([np.empty(0, np.int64), *(b[1] for b in best)]).astype(np.int64), "score": np.concatenate([np.empty(0), *(b[0] for b in best)])})


def search(docs: DataFrame, is_query, k: int = 10, features: int = FEATURES, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """query_id, doc_id, score, place: the best k other texts with a term in common for each text that is_query takes.

    doc_id is unique; rows without one are no part of it. Queries go to the workers in blocks of some `block`.
    """
    docs = docs.where("doc_id is not null")
    n, found = docs.count(), vocabulary(docs, features)
    idf = np.log((1 + n) / (1 + found["df"].to_numpy(dtype=float))) + 1
    rows = shared(term_counts(docs, found["term"].tolist()).where("length(idx) > 0"))
    queries = rows.where(is_query)
    blocks = -(-queries.count() // block)
    sc, out = docs.sparkSession.sparkContext, rows.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.0).alias("score")).where("false")
    for b in range(blocks):
        sent = sc.broadcast(queries.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == b).toPandas())

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            if len(sent.value):
                pieces = (batch.iloc[lo : lo + 1000] for batch in batches for lo in range(0, len(batch), 1000))
                yield _nearest(pieces, Rows(sent.value, idf), idf, k, hot)

        out = out.unionByName(rows.mapInPandas(run, "query_id long, doc_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.where("score > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


@query("tfidf_search")
def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-02: the best ten for every text whose id is divisible by 50, over words and pairs of words without stop words.

    The 20,000 most frequent terms of at least two texts count. No SQL: tests hold it against brute force.
    """
    return search(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)
