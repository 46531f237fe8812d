"""Toxicity by a classifier chain.

Categories are predicted one after another; each linear model sees what the text's words say about its category, the
text's form (letters, repetition, length of words) and the probabilities of the categories before it. By default the chain is `poor` (labels.quality is 0), then `toxic`
(labels.toxic is 1): two labels that people gave, neither made from the text's features. The models are trained on
out-of-fold predictions of the earlier ones, so that what they see in training is what they will see later.

A word's terms are the word, its first five and its first four letters (for inflected words), hashed into BUCKETS
buckets. A bucket is telling for a category if a likelihood-ratio test on the labelled rows says that it occurs in
more documents of the category; its weight is the log odds, and a word weighs what its heaviest term does. There is
no limit on telling terms. Weights are made five times more, without one fold each, and a labelled row's features
come from those made without its own fold, so its words have no part in their own weights.

Labelled rows that are copies or near copies of one another would make all their words telling, so one of each
counts: rows that agree in the least hash of their runs of three words, for any of TWINS hashes, are taken for copies.

The fit uses at most 2 * each labelled rows (those with the smallest hashed ids, never held-out rows); the share
of each category is counted over all labels that aren't held out. Every text is scored whole.

Defined results: empty and null texts have no words and are scored like any; null labels count as 0; of repeated
labels of an id one counts, rows of documents that repeat are scored each; a category whose labelled rows are of one
class has the share of that class as its probability everywhere; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import bounded_batches, cut, text_or_empty
from millrace.llm.linear import held_out, labelled_sample, logistic, sigmoid

#: Labelled rows of each class at most, buckets of hashed terms, and folds.
EACH, BUCKETS, FOLDS = 5_000, 1 << 18, 5
TWINS = 3
#: Twice the log likelihood ratio from which a bucket is telling: chance reaches it once in 10 million.
TELLING = 28.0
#: In the order of the chain; each name's label as SQL over the table of labels.
CATEGORIES = {"poor": "quality = 0", "toxic": "toxic = 1"}
#: Features of a text for a category: what its words weigh, then its form, then a one.
WIDTH = 9
_TERM = re.compile(r"[^\W\d_]+")


def buckets(word: str) -> list[int]:
    crc = zlib.crc32
    if len(word) < 4:
        return [crc(word.encode()) % BUCKETS]
    if len(word) < 5:
        return [crc(word.encode()) % BUCKETS, crc((word + "*").encode()) % BUCKETS]
    return [crc(word.encode()) % BUCKETS, crc((word[:5] + "*").encode()) % BUCKETS, crc((word[:4] + "*").encode()) % BUCKETS]


def term_weights(inside: np.ndarray, outside: np.ndarray, n_inside: int, n_outside: int) -> np.ndarray:
    """Log odds of the buckets that are telling, else 0. inside, outside: documents of each class that have it."""
    a, b = inside.astype(float), outside.astype(float)
    rate, all_rows = (a + b) / max(1, n_inside + n_outside), [(a, n_inside), (b, n_outside)]
    g = np.zeros(len(a))
    with np.errstate(divide="ignore", invalid="ignore"):
        for k, n in all_rows:
            for x, p in ((k, rate), (n - k, 1 - rate)):
                g += np.where(x > 0, 2 * x * np.log(x / np.maximum(n * p, 1e-300)), 0)
    odds = np.log((a + 0.5) / (n_inside + 1)) - np.log((b + 0.5) / (n_outside + 1))
    return np.where((g >= TELLING) & (odds > 0), odds, 0.0)


def features(weights: np.ndarray, n_words: int, form: list[float]) -> list[float]:
    """weights: of the text's different words, those above 0."""
    hits = len(weights)
    return [float(weights.sum()) / 10, float(weights.max()) if hits else 0.0, float(np.log1p(hits)), float(hits > 0), min(5.0, 100 * hits / max(1, n_words)), *form, 1.0]


class Lexicon:
    """A row of weights a category; remembers the words that it has looked up, a bounded number of them."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.known = weights, {}
        self.telling = (weights > 0).any(axis=0).tobytes()

    def features(self, text: str) -> np.ndarray:
        """WIDTH numbers a category, one after the other."""
        all_words = _TERM.findall(text.lower())
        words = set(all_words)
        letters = sum(map(len, all_words))
        form = [letters / max(1, len(text)), len(words) / max(1, len(all_words)), letters / max(1, len(all_words)) / 10]
        if len(self.known) > 100_000:
            self.known.clear()
        get, telling, found = self.known.get, self.telling.__getitem__, []
        for w in words:
            own = get(w)
            if own is None:
                at = buckets(w)
                own = self.known[w] = tuple(self.weights[:, at].max(axis=1).tolist()) if any(map(telling, at)) else ()
            if own:
                found.append(own)
        each = np.array(found).reshape(-1, len(self.weights))
        return np.concatenate([features(each[each[:, c] > 0, c], len(words), form) for c in range(len(self.weights))])


@dataclass
class Chain:
    names: list[str]
    priors: list[float]
    lexicon: np.ndarray
    weights: list[np.ndarray | None] = field(default_factory=list)
    shifts: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column a category, for rows of Lexicon.features."""
        before = np.zeros((len(x), 0))
        for c, (w, shift) in enumerate(zip(self.weights, self.shifts, strict=True)):
            own = x[:, c * WIDTH : (c + 1) * WIDTH]
            p = np.full(len(x), self.priors[c]) if w is None else sigmoid(np.column_stack([before, own]) @ w + shift)
            before = np.column_stack([before, p])
        return before


def learn_chain(names: list[str], priors: list[float], lexicon: np.ndarray, x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> Chain:
    """x: features of labelled rows, from weights made without the row's fold; labels: a column a category.

    A category's shift takes its probability from its share in the sample to its share among all labels (priors).
    """
    chain, before = Chain(names, priors, lexicon), np.zeros((len(x), 0))
    for c in range(len(names)):
        y, z = labels[:, c].astype(float), np.column_stack([before, x[:, c * WIDTH : (c + 1) * WIDTH]])
        free = z.shape[1] - 1
        if len(np.unique(y)) < 2:
            chain.weights.append(None)
            chain.shifts.append(0.0)
            before = np.column_stack([before, np.full(len(x), priors[c])])
            continue
        sampled = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        shift = float(np.log(priors[c] / (1 - priors[c])) - np.log(sampled / (1 - sampled)))
        out = np.zeros(len(x))
        for f in range(FOLDS):
            rest = fold != f
            if (~rest).any():
                out[~rest] = sigmoid(z[~rest] @ logistic(z[rest], y[rest], l2=1.0, free=free) + shift)
        chain.weights.append(logistic(z, y, l2=1.0, free=free))
        chain.shifts.append(shift)
        before = np.column_stack([before, out])
    return chain


def _without_copies(rows: DataFrame) -> DataFrame:
    """Of rows (with id and text) that agree in one of TWINS least hashes the one with the smallest id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from millrace.llm.wordhash import chunks, mix, shingles

        for batch in batches:
            texts, least = batch["text"].tolist(), []
            for lo, hi in chunks(texts):
                for s in shingles(texts[lo:hi], 3):
                    least.append([mix(s + np.uint64(k)).min().astype(np.int64) if len(s) else 0 for k in range(TWINS)])
            yield batch.assign(**{f"twin{k}": [x[k] for x in least] for k in range(TWINS)})

    marks = [f"twin{k}" for k in range(TWINS)]
    rows = cut(rows.mapInPandas(run, rows.schema.simpleString()[7:-1] + "".join(f",{m}:bigint" for m in marks)))
    kept = rows.select("id", *marks)
    for mark in marks:
        kept = kept.join(kept.groupBy(mark).agg(F.min("id").alias("id")), [mark, "id"], "left_semi")
    return rows.join(F.broadcast(kept.select("id").distinct()), "id", "left_semi").drop(*marks)  # the sample's ids


def fit(docs: DataFrame, labels: DataFrame, each: int = EACH, categories: dict[str, str] = CATEGORIES) -> Chain:
    """docs(doc_id, text) and labels; rows are sampled by the last category. The driver gets counts of the buckets
    by fold and labels (some 40 MB at most) and 2 * each rows of features."""
    names, spark = list(categories), docs.sparkSession
    own = [F.coalesce(F.expr(sql), F.lit(False)).cast("int").alias(f"y{c}") for c, sql in enumerate(categories.values())]
    rows = labels.select("doc_id", *own)
    shares = rows.where(~held_out("doc_id")).agg(*[F.avg(f"y{c}") for c in range(len(names))]).first()
    priors = [float(np.clip(0.5 if s is None else s, 1e-3, 1 - 1e-3)) for s in shares]
    said = [f"y{c}" for c in range(len(names))]
    sample = labelled_sample(rows, said[-1], each, extra=said)
    fold_of = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    known = _without_copies(texts.join(F.broadcast(sample), "id").select("id", "text", fold_of.alias("fold"), *said))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, fold, *y in batch[["text", "fold", *said]].itertuples(index=False):
                cell = fold << len(names) | sum(v << c for c, v in enumerate(y))
                if cell not in seen:
                    seen[cell] = np.zeros(BUCKETS + 1, dtype=np.int64)
                seen[cell][list({b for w in set(_TERM.findall(text.lower())) for b in buckets(w)})] += 1
                seen[cell][BUCKETS] += 1
        for cell, n in seen.items():
            used = np.flatnonzero(n)
            yield pd.DataFrame({"bucket": used, "cell": cell, "n": n[used]})

    cells = FOLDS << len(names)
    per = known.mapInPandas(count, "bucket int, cell int, n long").groupBy("bucket").agg(*[F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(cells)])
    found = per.toArrow()  # at most BUCKETS + 1 rows
    at = found.column("bucket").to_numpy()
    counts = np.zeros((cells, BUCKETS + 1), dtype=np.int64)
    for k in range(cells):
        counts[k, at] = found.column(f"c{k}").to_numpy()
    cell = np.arange(cells)

    def lexicon(used: np.ndarray) -> np.ndarray:
        out = []
        for c in range(len(names)):
            a, b = (counts[used & ((cell >> c & 1) == v)].sum(axis=0) for v in (1, 0))
            out.append(term_weights(a[:BUCKETS], b[:BUCKETS], int(a[BUCKETS]), int(b[BUCKETS])))
        return np.array(out, dtype=np.float32)

    whole = lexicon(np.ones(cells, dtype=bool))
    without = spark.sparkContext.broadcast([lexicon(cell >> len(names) != f) for f in range(FOLDS)])

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_fold = [Lexicon(w) for w in without.value]
        for batch in batches:
            x = [by_fold[f].features(t) for f, t in zip(batch["fold"], batch["text"], strict=True)]
            yield batch[["id", "fold", *said]].assign(x=x)

    schema = "id long, fold int, " + ", ".join(f"{y} int" for y in said) + ", x array<double>"
    got = sorted(known.mapInPandas(describe, schema).collect(), key=lambda r: (r["id"], r["x"]))
    without.unpersist()
    x = np.array([r["x"] for r in got]).reshape(-1, WIDTH * len(names))
    y = np.array([[r[c] for c in said] for r in got], dtype=int).reshape(-1, len(names))
    return learn_chain(names, priors, whole, x, y, np.array([r["fold"] for r in got], dtype=int))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, categories: dict[str, str] = CATEGORIES) -> DataFrame:
    """doc_id, a probability a category (p_poor, p_toxic), score (of the last category), predicted."""
    bounded_batches(docs.sparkSession)
    chain = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, categories=categories))  # BUCKETS weights a category
    names = list(categories)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(chain.value.lexicon)
        for batch in batches:
            p = chain.value.predict(np.array([lexicon.features(t) for t in batch["text"]]).reshape(-1, WIDTH * len(names)))
            yield pd.DataFrame({"doc_id": batch["id"].astype("Int64"), **{f"p_{n}": p[:, k] for k, n in enumerate(names)}})

    plain = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    found = plain.mapInPandas(run, "doc_id long, " + ", ".join(f"p_{n} double" for n in names))
    return found.withColumn("score", F.col(f"p_{names[-1]}")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
