"""The quality fit takes in every labelled row, and every pair of a good one and a bad one."""

import pickle

import numpy as np

from millrace.llm import linear, quality


def test_weights_are_those_of_all_pairs():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, quality.FORM + quality.WORDS))
    y = (x[:, 0] + 0.3 * rng.standard_normal(400) > 0.6).astype(int)
    model = quality.learn(x, y, 0.25, 0.3)
    z = model.spread(x)
    i, j = np.nonzero((y == 1)[:, None] & (y == 0)[None, :])
    pairs = z[i] - z[j]
    gradient = -quality.PAIRS / len(i) * (pairs.T @ linear.sigmoid(-(pairs @ model.weights))) + 2.0 * model.weights
    assert np.abs(gradient).max() < 1e-2
    part = np.where(y == 1, 0.25 / (y == 1).sum(), 0.75 / (y == 0).sum())
    assert np.isclose(model.edge, quality.quantile(z @ model.weights, part, 0.75))


def test_every_labelled_row_counts():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((14_000, quality.FORM + quality.WORDS))
    y = np.arange(14_000) % 2
    half = quality.learn_from(lambda f: quality.merged(f(x[:7000], y[:7000]), f(x[7000:], y[7000:])), 0.5, 0.3)
    assert np.allclose(half.mean, x.mean(axis=0)) and np.allclose(half.weights, quality.learn(x, y, 0.5, 0.3).weights, atol=1e-6)


def test_a_pass_brings_one_row_to_the_driver(spark, monkeypatch):
    """However many partitions the labelled rows lie in."""
    for name, value in (("TASKS", 12), ("FAN", 4)):
        monkeypatch.setattr(quality, name, value, raising=False)
    texts = [" ".join(f"w{(i * 7 + k) % 90}" + "%%" * (i % 4 == 0) for k in range(5 + i % 9)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(12)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(240)], "doc_id long, quality int")
    seen, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    found = quality.fit(docs, labels)
    assert len(seen) > 10 and max(map(len, seen)) == 1
    own = {r.doc_id for r in labels.where(~linear.held_out("doc_id")).collect()}
    x, y = quality.features([texts[i] for i in sorted(own)]), np.array([int(i % 4 != 0) for i in sorted(own)])
    assert np.allclose(found.weights, quality.learn(x, y, y.mean(), 0.3).weights, atol=1e-6)


def test_sums_are_added_in_one_order(spark):
    values = np.random.default_rng(8).standard_normal((24, 50)) * 10.0 ** np.arange(24)[:, None]
    out: dict = {}
    for v in values:
        quality.merged(out, {"v": v, "min": v, "max": v})
    rows = [(k, pickle.dumps({"v": v, "min": v, "max": v})) for k, v in enumerate(values)]
    for deal in (rows, rows[::-1], rows[1::2] + rows[::2]):
        got = quality.summed(spark.createDataFrame(deal, quality.SUMS).repartition(6), 24)
        assert all(np.array_equal(got[k], out[k]) for k in out)
