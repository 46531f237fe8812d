"""What each operator and stage makes of nulls, very long texts, ties, repeated rows, empty tables and clashing names,
and the learned models against plain implementations."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, exact_dedup, linear, minhash, mixing, packing, quality, toxicity
from millrace.llm.token_files import read_token_files, write_token_files

path = pytest.importorskip("public_tokenizers").path
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ALIKE = 100_000


@pytest.fixture(scope="module")
def alike(spark):
    """A third of all rows and more are one row, without an id or a source."""
    same = spark.range(ALIKE).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same few words in each of them").alias("text"), F.lit(None).cast("string").alias("source"))
    others = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id"), F.lit(" of its own")).alias("text"), F.lit("a").alias("source"))
    return same.unionByName(others).cache()


def test_alike_rows_are_mixed(alike):
    sizes = alike.select(F.col("doc_id").alias("id"), "source", mixing.n_words().alias("size"))
    found = mixing.mix(sizes)
    by = {r["source"]: r for r in found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most")).collect()}
    assert by[None]["n"] == ALIKE and by["a"]["n"] == 1000
    assert all(abs(r["taken"] - r["target"]) <= 8 and r["most"] <= 3 for r in by.values())
    again = sorted(map(tuple, mixing.mix(sizes.repartition(5)).groupBy("id", "source", "copies").count().collect()), key=str)
    assert again == sorted(map(tuple, found.groupBy("id", "source", "copies").count().collect()), key=str)
    stage = mixing.mix_documents(alike)
    assert abs(stage.where("source is null").count() * 8 - by[None]["target"]) < 0.02 * by[None]["target"]


def test_alike_rows_are_packed_and_written(alike, spark, tmp_path):
    found = packing.pack_documents(alike, path("byte_bpe_50k.json"))
    by = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("places"), F.count(F.lit(1)).alias("rows"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert found.count() == ALIKE + 1000 and by.where("n <> end or places <> rows or n > 2048").isEmpty()
    write_token_files(alike, f"{tmp_path}/t", path("word_bpe_49k.json"), end_id=1)
    back = read_token_files(spark, f"{tmp_path}/t")
    assert back.count() == ALIKE + 1000 and back.where("doc_id is null").agg(F.count_distinct("ids_crc32")).first()[0] == 1
    assert back.agg(F.max(F.col("start") + F.col("n_tokens")) == F.sum("n_tokens")).first()[0]


def test_alike_rows_are_deduped(alike):
    exact = exact_dedup.exact_duplicates(alike)
    assert exact.where("kept").count() == 1001 and exact.agg(F.max("group_size")).first()[0] == ALIKE
    assert exact_dedup.drop_exact_duplicates(alike).count() == 1001
    near = minhash.near_duplicates(alike)
    assert near.count() == ALIKE + 1000 and near.where("doc_id is not null and component_id <> doc_id").isEmpty()


CLASHING = ["_id", "_score", "_sha", "_kept", "_n", "_words", "_times", "_copy", "_size", "own_id", "OWN_SHA", "key_sha", "times", "kept", "score", "gone_id", "copies", "words", "copy", "n_alike", "own_source", "own_size", "row", "share", "rank", "first", "length"]


def test_stages_keep_clashing_columns_nulls_and_long_texts(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    rows = [(i, words(40), "en", "a" if i % 2 else None, i) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "b", 0), (None, "null id", "en", "a", 0), (102, "long " * 200_000, "en", "a", 0), (103, "long " * 200_000, "en", "a", 0), (5, rows[5][1], "en", "a", 5), (5, rows[5][1], "en", "a", 5)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in CLASHING:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id")))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    held = lambda df: df.columns == docs.columns and df.where(" or ".join(f"`{c}` <> concat('{c}', doc_id)" for c in CLASHING)).isEmpty()
    assert held(quality.keep_good(docs, labels, cut=0.3))
    left = exact_dedup.drop_exact_duplicates(docs)
    assert held(left)
    assert sorted((r.doc_id for r in left.select("doc_id").collect()), key=str) == sorted([*range(60), 100, None, 102], key=str)
    near = minhash.drop_near_duplicates(left)
    assert held(near) and near.count() == left.count()
    mixed = mixing.mix_documents(docs)
    assert held(mixed) and mixed.count() > 0
    packed = packing.pack_documents(docs, path("byte_bpe_50k.json"))
    assert packed.where("piece = 0").count() == len(rows)
    one = toxicity.classify(docs, labels)
    assert one.count() == len(rows) and one.where("predicted = 1 or score is null").isEmpty()
    found = quality.classify(docs, labels)
    assert found.where("doc_id = 5").select("score").distinct().count() == 1 and found.count() == len(rows)


def test_nearest_takes_any_finite_norm(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((600, 16))
    v[300:305] = v[0] + 0.01 * rng.standard_normal((5, 16))
    scale = np.ones(600)
    scale[[0, 50, 301]], scale[[100, 302, 303]] = 1e200, 1e-200
    rows = [(i, (x * s).tolist()) for i, (x, s) in enumerate(zip(v, scale, strict=True))] + [(50, [9.0] * 16), (301, v[301].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(ann, "QUERY_BYTES", 600)  # several groups of queries
    found = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert {r.query_id for r in found} == set(range(0, 600, 50)) and len(found) == 60
    own = sorted((r for r in found if r.query_id == 0), key=lambda r: r["rank"])
    assert {r.vec_id for r in own} <= {300, 301, 302, 303, 304} and all(r.score > 0.99 for r in own)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for r in found:
        if r.query_id != 50 and r.vec_id != 50:
            assert r.score == pytest.approx(float(u[r.query_id] @ u[r.vec_id]), abs=1e-9)
    assert not any(r.vec_id == r.query_id for r in found)


def test_blocks_and_queries_in_groups():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 24))
    v[1000:1800] = v[7]  # a hot vector
    block, u = ann.Block(np.arange(3000), v), v / np.linalg.norm(v, axis=1, keepdims=True)
    asked = np.arange(0, 3000, 20)
    hit = 0
    for q, (ids, _) in zip(asked.tolist(), block.search(asked, v[asked], 5), strict=True):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        hit += len(set(ids.tolist()) & set(np.lexsort((np.arange(3000), -s))[:5].tolist()))
    assert hit >= 0.9 * 5 * len(asked)


def descend(x, y, l2, steps=4000):
    """Weights of a logistic regression, by plain gradient descent."""
    w = np.zeros(x.shape[1])
    rate = 4 / (np.linalg.norm(x, 2) ** 2 + l2)
    for _ in range(steps):
        w -= rate * (x.T @ (1 / (1 + np.exp(-(x @ w))) - y) + l2 * w)
    return w


def test_pair_weights_are_those_of_plain_descent():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 4))
    y = (x @ [2, -1, 0, 0.5] + rng.standard_normal(300) > 0).astype(int)
    good, bad = rng.choice(np.flatnonzero(y == 1), 400), rng.choice(np.flatnonzero(y == 0), 400)
    pairs = x[good] - x[bad]
    assert np.allclose(linear.logistic(pairs, np.ones(400), l2=2.0), descend(pairs, np.ones(400), 2.0), atol=1e-4)


def test_threshold_is_a_quantile_of_the_scores():
    raw, share = np.array([3.0, 1.0, 2.0, 5.0, 4.0]), np.array([0.1, 0.3, 0.2, 0.2, 0.2])
    for below, want in ((0.3, 1.5), (0.5, 2.5), (0.0, 0.5), (1.0, 5.5), (0.58, 3.5)):
        assert quality.quantile(raw, share, below) == pytest.approx(want)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((800, quality.FORM + quality.WORDS))
    y = (x[:, 0] + 0.3 * rng.standard_normal(800) > 0.6).astype(int)
    model = quality.learn(x, y, 0.25, 0.3)
    score = model.score(x)
    part = np.where(y == 1, 0.25 / (y == 1).sum(), 0.75 / (y == 0).sum())
    assert part[score < 0.3].sum() == pytest.approx(0.75, abs=0.01)
    assert ((score >= 0.3) == y).mean() > 0.85


def test_telling_terms():
    inside, outside = np.array([12, 10, 0, 1, 300]), np.array([0, 10, 10, 0, 400])
    got = toxicity.term_weights(inside, outside, 400, 1200)
    assert got[0] == pytest.approx(math.log(12.5 / 401) - math.log(0.5 / 1201)) and got[2] == got[3] == 0
    for k in range(5):
        a, b = float(inside[k]), float(outside[k])
        table = [[a, 400 - a], [b, 1200 - b]]
        total = sum(map(sum, table))
        g = 2 * sum(v * math.log(v * total / (sum(r) * sum(x[j] for x in table))) for r in table for j, v in enumerate(r) if v)
        assert (got[k] > 0) == (g >= toxicity.TELLING and a / 400 > b / 1200)


def test_chain_is_trained_on_out_of_fold_predictions():
    rng = np.random.default_rng(8)
    n, w = 400, toxicity.WIDTH
    x = rng.standard_normal((n, 2 * w))
    x[:, w - 1] = x[:, 2 * w - 1] = 1
    first = (x[:, 0] + rng.standard_normal(n) > 0).astype(int)
    second = ((2 * first - 1) + x[:, w] + rng.standard_normal(n) > 0).astype(int)
    fold = rng.integers(0, toxicity.FOLDS, n)
    priors = [float(first.mean()), float(second.mean())]
    chain = toxicity.learn_chain(["a", "b"], priors, np.zeros((2, 4)), x, np.column_stack([first, second]), fold)

    out = np.zeros(n)
    for f in range(toxicity.FOLDS):
        rest = fold != f
        out[~rest] = 1 / (1 + np.exp(-(x[~rest, :w] @ linear.logistic(x[rest, :w], first[rest], l2=1.0, free=w - 1))))
    z = np.column_stack([out, x[:, w:]])
    assert np.allclose(chain.weights[1], linear.logistic(z, second, l2=1.0, free=w), atol=1e-5)
    assert chain.weights[1][0] > 0.5  # what the first model says matters to the second
    p = chain.predict(x)
    assert np.allclose(p[:, 0], 1 / (1 + np.exp(-(x[:, :w] @ chain.weights[0]))), atol=1e-9)
    assert ((p[:, 1] > 0.5) == second).mean() > 0.7


def test_chain_learns_categories_that_are_not_its_features(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(1200):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 60))]
        words = ["".join(chr(97 + int(c)) for c in w[1:].zfill(4)) for w in words]
        toxic, poor = i % 5 == 0, i % 7 == 0
        if toxic:
            words[3] = rng.choice(["nasty", "vile"]) + rng.choice(["", "ly", "ness"])
        if poor:
            words[5] = "buynow"
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(not poor), int(toxic)))
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.classify(docs, lab).collect()}
    out = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert sum((found[d].p_poor >= 0.5) == (q == 0) for d, q, _ in out) >= 0.97 * len(out)
    assert sum(found[d].predicted == t for d, _, t in out) >= 0.97 * len(out)
    # held-out labels play no part
    flipped = lab.withColumn("toxic", F.when(linear.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in toxicity.classify(docs, flipped).collect()} == {(d, r.score) for d, r in found.items()}
