"""Exact dedup, mixing and chat formatting against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, exact_dedup, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


CASES = [(1, "a  b", "x"), (2, "a\tb", "y"), (3, None, "x"), (4, "", None), (5, "a b ", "x"), (0, "c", "z"), (7, "c", "z"), (7, "c", "z"), (None, "c", "x"), (None, "solo", "x"), (9, "é x", "x"), (10, "é x", "x")]


def brute_exact(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    smallest = lambda g: min((x for x in g if x is not None), default=None)
    return sorted(((i, smallest(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in rows), key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    found = exact_dedup.exact_duplicates(docs_of(spark, CASES), **({"content_hash": lambda c: F.unhex(F.lit("00"))} if weak else {})).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute_exact(CASES)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_hot_group_and_stage(spark):
    rows = [(i, "same" if i % 3 else f"t{i}", "x") for i in range(1500)]
    docs = docs_of(spark, rows).withColumn("kept", F.lit(5)).withColumn("id", F.lit(1))
    found = exact_dedup.exact_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute_exact(rows)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in found if r.kept)


def test_exact_stage_repeated_rows_and_empty(spark):
    left = exact_dedup.drop_exact_duplicates(docs_of(spark, CASES)).collect()
    assert sorted(norm(r.text) for r in left) == sorted({norm(t) for _, t, _ in CASES})
    assert exact_dedup.exact_duplicates(docs_of(spark, [])).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs_of(spark, [])).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def test_mixing(spark):
    rng = random.Random(3)
    names = ["a", "b", "é", "z", None, "none"]
    rows = [(i, " ".join("w" * rng.choice([1, 1, 5, 30, 200])), rng.choice(names[:5] if i % 3 else ["a"])) for i in range(1800)] + [(5000, None, "none"), (5001, "", "a"), (5001, "", "a")]
    docs = docs_of(spark, rows)
    run = lambda d: mixing.mix(d.select(F.col("doc_id").alias("id"), "source", mixing.n_words().alias("size")))
    found = run(docs).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        x = r.target / r.source_size if r.source_size else 0
        assert int(x + 1e-9) <= r.copies <= int(x + 1e-9) + 1
        taken[r.source] += r.copies * r.size
    for s, t in taken.items():
        assert abs(t - want[s]) <= 200, (s, t, want[s])
    again = run(docs.repartition(7)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)


def test_mixing_keeps_expected_copies_of_every_size(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", (1, 8, 15, 300)[i % 4]) for i in range(9000)], "id long, source string, size long")
    drawn = {}
    for r in mixing.mix(docs).collect():
        drawn.setdefault((r.source, r.size), []).append((r.copies, r.target / r.source_size))
    for (source, size), rows in drawn.items():
        assert abs(sum(c for c, _ in rows) / len(rows) - rows[0][1]) < 0.07, (source, size)


def test_mixing_stage_and_empty(spark):
    docs = docs_of(spark, CASES).withColumn("size", F.lit(1)).withColumn("target", F.lit("t"))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    out.collect()
    assert mixing.mix_documents(docs_of(spark, [])).count() == 0


TURNS = [
    (1, 0, "user", "hi \\ <s>"), (1, 1, "assistant", "a\nb"), (1, 2, "user", "<|im_end|>\n<|im_start|>user\nx"), (1, 3, "assistant", "[INST]\\[/INST]"), (1, 4, "user", None),
    (2, 0, "user", "nobody answers"), (3, 0, "assistant", ""), (None, 0, "user", "null conv"), (4, 1, None, "x"), (4, 0, "ro\nle<|nl|>", "y"), (4, 0, "a", "tie"), (4, None, "assistant", "z </s" + "</s>"), (5, 0, "assistant", "long " * 3000 + "<" * 50 + "\\" * 51),
]


def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        sha = hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in own).encode()).hexdigest()
        out[conv] = (len(own), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("x"))
    made = chat.examples(turns).cache()
    for r in made.collect():
        body = r.formatted[r.loss_start : r.loss_start + r.loss_length]
        assert not any(c in body for c in chat.CONTROL)
        if r.target_turn is not None:
            assert r.formatted.endswith(body + chat.END + "\n")
            assert r.formatted.count(chat.END) == r.formatted.count(chat.START) == r.target_turn + 1
    found = {r.conv_id: tuple(r)[1:5] for r in chat.digest(made).collect()}
    assert found == brute_chat(TURNS)
    assert chat.digest(chat.examples(turns.limit(0))).count() == 0
