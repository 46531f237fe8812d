"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in features of its text: 18 measures of its form and the shares of its words that fall
into each of WORDS hashed buckets. The weights come from preference pairs by logistic loss on the difference of their
features: all pairs of a labelled document marked good and one marked bad. The threshold is a quantile of the scores: as large a share of
the labelled rows, each counted for its part of the corpus, lies below it as has label 0 among all labels. A
logistic map of the score takes the threshold to `cut` and keeps the order; its slope is fitted to the labels.

The fit uses every labelled row that isn't held out. It goes through their features, which are kept in the shared
folder, in passes whose sums are added up by executors; the driver gets one row a pass, however many partitions
there are. Sums over all pairs need no pairs: a row meets the other class as sums
at NODES of the score, between which a cubic interpolates (to some 1e-6). Every text is scored whole.

Defined results: empty and null texts have all features 0 and are scored like any; rows without an id are not
held out; null labels play no part; rows that repeat are scored each; without labels of both classes all documents
get the same score, the share of label 1; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import bounded_batches, cut as kept, fresh, join_checked, text_or_empty
from millrace.llm.linear import held_out, labelled_rows, sigmoid

#: What the mean loss of a pair weighs against the penalty, and the distance of nodes of the score.
PAIRS, NODES = 40_000, 0.1
#: Tasks of a pass for each core, and sums that one task adds up.
TASKS, FAN = 2, 32
#: Buckets of hashed words.
WORDS = 64
KNOTS = (0.1, 0.3, 0.5, 0.7, 0.9)

_KIND = np.zeros((6, 256))
_KIND[0, [*range(97, 123), *range(128, 256)]] = 1  # small letters and what is not ASCII
_KIND[1, 65:91] = 1
_KIND[2, 48:58] = 1
_KIND[3, [ord(c) for c in ".,;:'\"?-()"]] = 1
_KIND[4, [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 1
_KIND[5, 10] = 1


def form(text: str) -> list[float]:
    """Shares of kinds of characters, words and repetitions; none depends on a language's words."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * FORM
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = (_KIND @ counts) / len(data)
    different = len(set(words))
    again = sum(map(bytes.__eq__, words[1:], words)) / n
    bare = sum(1 for w in words if not w.isalnum()) / n
    capital = sum(1 for w in words if w[:1].isupper()) / n
    lines = data.split(b"\n")
    half = data[: len(data) // 2]
    top = counts[33:].max() / max(1, counts[33:].sum())
    return [
        np.log1p(n), *kinds.tolist(), different / n, np.log1p(different) / np.log1p(n), again, bare, capital,
        len(data) / n / 10, len(set(lines)) / len(lines), max(map(len, words)) / len(data), top, float(np.log1p(max(map(len, words)))), len(half.split()) / n,
    ]


FORM = 18


def features(texts: list[str]) -> np.ndarray:
    """A row a text: its form, then the shares of its words by bucket."""
    from millrace.llm.wordhash import chunks, hashes, words

    out = np.zeros((len(texts), FORM + WORDS))
    for lo, hi in chunks(texts):
        out[lo:hi, :FORM] = [form(t) for t in texts[lo:hi]]
        codes, different, begins = words(texts[lo:hi], lower=True)
        n = np.diff(begins)
        cell = np.repeat(np.arange(hi - lo), n) * WORDS + (hashes(different) % np.uint64(WORDS)).astype(np.int64)[codes]
        out[lo:hi, FORM:] = np.bincount(cell, minlength=(hi - lo) * WORDS).reshape(-1, WORDS) / np.maximum(n, 1)[:, None]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    slope: float
    edge: float
    cut: float

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Features, and of those of form the parts beyond each knot, so that the score may bend."""
        z = (x - self.mean) / self.scale
        return np.hstack([z, *(np.maximum(0, z[:, :FORM] - k) for k in self.knots)])

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.spread(x) @ self.weights
        return sigmoid(self.slope * (raw - self.edge) + np.log(self.cut / (1 - self.cut)))


#: Sums of f(x, y) over blocks of the labelled rows; a sum is a dictionary, of numbers and arrays.
Passes = Callable[[Callable[[np.ndarray, np.ndarray], dict]], dict]


def merged(a: dict, b: dict) -> dict:
    """Values added; under keys that begin with `min` or `max` the least and greatest."""
    for k, v in b.items():
        how = {"min": np.minimum, "max": np.maximum}.get(k[:3] if isinstance(k, str) else "", np.add)
        a[k] = how(a[k], v) if k in a else v
    return a


def narrowed(passes: Passes, of: Callable, lo: np.ndarray, hi: np.ndarray, below: np.ndarray, part: tuple[float, float], rounds: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each column of of(x) ends between which the share of smaller values passes `below`; a row of class v counts
    part[v]. lo, hi: the least and the greatest value."""
    lo, hi, under = lo.copy(), np.nextafter(hi, np.inf), np.zeros(len(lo))
    for _ in range(rounds):
        edges = lo + (hi - lo) * np.arange(bins + 1)[:, None] / bins
        edges[-1] = hi

        def count(x: np.ndarray, y: np.ndarray, edges: np.ndarray = edges) -> dict:
            v, out = of(x), np.zeros((2, bins, edges.shape[1]))
            for c in range(edges.shape[1]):
                at = np.searchsorted(edges[:, c], v[:, c], side="right") - 1
                ok = (at >= 0) & (at < bins)
                for k in (0, 1):
                    out[k, :, c] = np.bincount(at[ok & (y == k)], minlength=bins)
            return {"n": out}

        n = passes(count)["n"]
        cum = under + np.cumsum(part[0] * n[0] + part[1] * n[1], axis=0)
        at = np.minimum((cum <= below + 1e-12).sum(axis=0), bins - 1)
        each = np.arange(len(lo))
        under = np.where(at > 0, cum[at - 1, each], under)
        lo, hi = edges[at, each], edges[at + 1, each]
    return lo, hi


def corners(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of the four nodes around each score, and their weights."""
    at = np.floor(s / NODES).astype(np.int64)
    u = s / NODES - at
    return at - 1, np.stack([-u * (u - 1) * (u - 2) / 6, (u + 1) * (u - 1) * (u - 2) / 2, -(u + 1) * u * (u - 2) / 2, (u + 1) * u * (u - 1) / 6])


def at_nodes(s: np.ndarray, z: np.ndarray, label: int) -> dict:
    """(label, node) to the sum of the rows' weights and of their weighted features."""
    if not len(s):
        return {}
    first, weights = corners(s)
    order = np.argsort(first, kind="stable")
    first, weights, z = first[order], weights[:, order], np.column_stack([np.ones(len(s)), z])[order]
    begins = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    out: dict = {}
    for k in range(4):
        for node, row in zip((first[begins] + k).tolist(), np.add.reduceat(weights[k][:, None] * z, begins), strict=True):
            merged(out, {(label, node): row})
    return out


def pair_weights(passes: Passes, model: Model, n: tuple[int, int], l2: float, steps: int = 25) -> np.ndarray:
    """Newton's method on the mean loss of all pairs."""
    w = np.zeros(FORM * (1 + len(KNOTS)) + WORDS)
    scale = PAIRS / n[0] / n[1]
    for _ in range(steps):

        def nodes(x: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> dict:
            z = model.spread(x)
            s = z @ w
            return at_nodes(s[y == 0], z[y == 0], 0) | at_nodes(s[y == 1], z[y == 1], 1)

        found = passes(nodes)
        ends = min(k for _, k in found), max(k for _, k in found)
        sums = np.zeros((2, ends[1] - ends[0] + 1, len(w) + 1))
        for (label, node), row in found.items():
            sums[label, node - ends[0]] = row
        t = NODES * np.arange(ends[0], ends[1] + 1)
        wrong = sigmoid(t[None, :] - t[:, None])  # that the worse, at the second, comes before the better
        (m0, x0), (m1, x1) = ((side[:, 0], side[:, 1:]) for side in sums)
        gradient = scale * ((m1 @ wrong) @ x0 - (wrong @ m0) @ x1) + l2 * w
        bend = wrong * (1 - wrong)
        held = np.stack([m1 @ bend, bend @ m0])

        def second(x: np.ndarray, y: np.ndarray, w: np.ndarray = w, held: np.ndarray = held, begin: int = ends[0]) -> dict:
            z = model.spread(x)
            first, weights = corners(z @ w)
            a = sum(weights[k] * held[y, first - begin + k] for k in range(4))
            return {"h": (z * a[:, None]).T @ z}

        cross = x1.T @ bend @ x0
        h = scale * (passes(second)["h"] - cross - cross.T) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_from(passes: Passes, good: float, cut: float) -> Model:
    """good: share of label 1 among all labels; the rows may hold the classes in another ratio."""
    found = passes(lambda x, y: {"n": np.bincount(y, minlength=2), "x": x.sum(axis=0), "min": x.min(axis=0), "max": x.max(axis=0)} if len(y) else {})
    n = found.get("n", np.zeros(2, dtype=int))
    if not n.all():
        flat = np.clip(good, 0.01, 0.99)
        m = FORM + WORDS
        return Model(np.zeros(m), np.ones(m), np.zeros((len(KNOTS), FORM)), np.zeros(m + FORM * len(KNOTS)), 1.0, float(np.log(cut / (1 - cut)) - np.log(flat / (1 - flat))), cut)
    rows, mean = int(n.sum()), found["x"] / n.sum()
    scale = np.sqrt(passes(lambda x, y: {"v": ((x - mean) ** 2).sum(axis=0)})["v"] / rows)
    model = Model(mean, np.where(scale > 0, scale, 1), np.zeros(0), np.zeros(0), 1.0, 0.0, cut)
    ends = [np.tile(found[k][:FORM], len(KNOTS)) for k in ("min", "max")]
    at = narrowed(passes, lambda x: np.tile(x[:, :FORM], len(KNOTS)), *ends, np.repeat(KNOTS, FORM), (1 / rows, 1 / rows), 4, 512)[0]
    model.knots = (at.reshape(len(KNOTS), FORM) - mean[:FORM]) / model.scale[:FORM]
    model.weights = pair_weights(passes, model, tuple(n.tolist()), l2=2.0)
    raw = lambda x: (model.spread(x) @ model.weights)[:, None]
    ends = passes(lambda x, y: {"min": raw(x).min(axis=0), "max": raw(x).max(axis=0)} if len(y) else {})
    part = ((1 - good) / n[0], good / n[1])  # each row's part of the corpus
    lo, hi = narrowed(passes, raw, ends["min"], ends["max"], np.array([1 - good]), part, 4, 4096)

    def near(x: np.ndarray, y: np.ndarray) -> dict:
        r = raw(x)[:, 0]
        out = {"under": np.bincount(y[r < lo], minlength=2), "maxlow": r[r < lo].max(initial=ends["min"][0] - 1), "minhigh": r[r >= hi].min(initial=ends["max"][0] + 1)}
        for v, k in zip(r[(r >= lo) & (r < hi)].tolist(), y[(r >= lo) & (r < hi)], strict=True):
            merged(out, {("at", v): np.eye(2, dtype=int)[k]})
        return out

    found = passes(near)
    inside = sorted(k[1] for k in found if isinstance(k, tuple))
    steps = [float(np.dot(found["under"], part)), *(float(np.dot(found["at", v], part)) for v in inside)]
    values = [float(found["maxlow"]), *inside, float(found["minhigh"])]
    best = int(np.abs(np.cumsum(steps) - (1 - good)).argmin())
    model.edge = (values[best] + values[best + 1]) / 2
    model.slope = slope(passes, raw, model.edge)
    return model


def slope(passes: Passes, raw: Callable, edge: float, l2: float = 1e-3, steps: int = 25) -> float:
    """Of the labels' logistic regression on the score, with an intercept."""
    w, penalty = np.zeros(2), np.array([l2, 1e-6])
    for _ in range(steps):

        def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> dict:
            v = np.column_stack([raw(x)[:, 0] - edge, np.ones(len(y))])
            p = sigmoid(v @ w)
            return {"g": v.T @ (p - y), "h": (v * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ v}

        found = passes(sums)
        step = np.linalg.solve(found["h"] + np.diag(penalty), found["g"] + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return float(max(0.05, w[0]))


def learn(x: np.ndarray, y: np.ndarray, good: float, cut: float) -> Model:
    """learn_from of rows that are all here."""
    return learn_from(lambda f: f(x, y), good, cut)


def quantile(raw: np.ndarray, share: np.ndarray, below: float) -> float:
    """Between two scores, so that the shares of the scores under it come nearest to `below`."""
    order = np.argsort(raw, kind="stable")
    at = int(np.abs(np.concatenate([[0], np.cumsum(share[order])]) - below).argmin())
    ends = np.concatenate([[raw.min() - 1], raw[order], [raw.max() + 1]])
    return float((ends[at] + ends[at + 1]) / 2)


SUMS = "at int, sums binary"


def summed(sums: DataFrame, n: int) -> dict:
    """Of the sums in n partitions, a row (at, pickled sums) each: tasks add up some FAN each, until one row is left
    for the driver. They add in the order of `at`, whatever comes first, so that reruns agree."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = sorted((r for batch in batches for r in zip(batch["at"].tolist(), batch["sums"], strict=True)), key=lambda r: r[0])
        if found:
            out: dict = {}
            for _, own in found:
                merged(out, pickle.loads(own))
            yield pd.DataFrame({"at": [found[0][0]], "sums": [pickle.dumps(out)]})

    while n > 1:
        n = -(-n // FAN)
        sums = sums.repartition(n).mapInPandas(add, SUMS)
    (row,) = sums.collect() or [None]
    return pickle.loads(row["sums"]) if row else {}


def fit(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> Model:
    """docs(doc_id, text), labels(doc_id, quality). Only sums over the rows come to the driver, a row a pass."""
    good = labels.where(~held_out("doc_id")).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    rows = join_checked(docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")), labelled_rows(labels, "quality"), "id", "inner")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [v.tobytes() for v in features(batch["text"].tolist())]})

    rows = kept(rows.select("label", "text").mapInPandas(run, "label int, x binary"))
    n = rows.rdd.getNumPartitions()

    def passes(f: Callable[[np.ndarray, np.ndarray], dict]) -> dict:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out: dict = {}
            for batch in batches:
                if len(batch):
                    merged(out, f(np.frombuffer(b"".join(batch["x"])).reshape(-1, FORM + WORDS), batch["label"].to_numpy(dtype=np.int64)))
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "sums": [pickle.dumps(out)]})

        wide = max(1, min(n, TASKS * rows.sparkSession.sparkContext.defaultParallelism))
        return summed(rows.coalesce(wide).mapInPandas(part, SUMS), wide)

    return learn_from(passes, 0.5 if good is None else good, cut)


def score(docs: DataFrame, model: Model, keep: list[str], name: str) -> DataFrame:
    """docs' columns `keep` and the score under `name`."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(features(texts.tolist())))

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.pandas_udf(run, "double")(text_or_empty()).alias(name))


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    found = score(docs, fit(docs, labels, cut), ["doc_id"], "score")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """docs without the documents that the classifier rejects, all columns as they were.

    Empty and null texts are scored like any; rows that repeat stay or go together; an empty table stays empty.
    """
    (own,) = fresh(docs, "score")
    return score(docs, fit(docs, labels, cut), docs.columns, own).where(F.col(own) >= cut).drop(own)


