"""The pipeline's stages, each on what the one before kept, on a small corpus with planted cases."""

import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(20, 120))]
        if i % 5 == 0:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "en", "big" if i % 3 else f"s{i % 4}", 0))
        labels.append((i, int(i % 5 != 0), 0))
    good = [r for r in rows if r[0] % 5]
    rows += [(1000 + k, good[k][1].replace(" ", "  "), "en", None, 0) for k in range(10)]  # equal texts
    rows += [(2000 + k, good[20 + k][1] + " one more", "en", "big", 0) for k in range(10) if len(good[20 + k][1].split()) > 60]  # near ones
    return rows, labels


def test_stages(spark, corpus, tmp_path):
    rows, labels = corpus
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    text = {r[0]: r[1] for r in rows}
    bad = {i for i, q, _ in labels if not q}
    kept = {r.doc_id for r in seen["quality"]}
    assert not kept & bad and len(kept) >= 0.98 * (len(rows) - len(bad))
    exact = {r.doc_id for r in seen["exact_dedup"]}
    assert {" ".join(text[i].split()) for i in exact} == {" ".join(text[i].split()) for i in kept} and not any(1000 <= i < 1010 for i in exact if i - 1000 < 10)
    near = {r.doc_id for r in seen["near_dedup"]}
    assert near == {i for i in exact if i < 2000}
    size = {}
    for r in seen["near_dedup"]:
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    taken = {}
    for r in seen["mixing"]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert abs(sum(taken.values()) - sum(size.values())) <= 120 * len(size)
    assert all(t <= 3 * size[s] + 120 for s, t in taken.items())
    packed = seen["packing"]
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(r.doc_id for r in seen["mixing"])
    assert len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // 2048) + 1


def test_run_equals_its_stages(spark, corpus, tmp_path):
    rows, labels = corpus
    spark.createDataFrame(rows[:60], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels[:60], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, tmp_path, stage):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert stage(spark, spark.createDataFrame([], DOCS), str(tmp_path)).count() == 0
