"""Substring dedup by prefix-partitioned suffix trees over words.

A word sequence that starts in two documents is an inner node of the suffix tree. The tree is built in parts, by words:

1. Suffixes are grouped by a prefix of variable length. A suffix's key is the least hash among the runs of ANCHOR
   words in its first `window` words (minimum substring partitioning), so that neighbours mostly share a key and
   travel as one run of words, about three times the text in all. Where a pass over all words finds the group of a
   key too large, its suffixes take the hash of their whole first `window` words as their key instead.
2. A second pass cuts the corpus into blocks and sends each part its runs of every block, as words, with the
   document's id. Runs of a block with the same words go once, with the smallest id, so that a passage in a third of
   all documents costs a part one run a block.
3. A part builds its subtree from the top: suffixes are refined by their next words, a few at a time, and what is
   alone in its node drops out. Nodes that reach the depth of the window are the deep inner nodes; the smallest id
   below a node keeps its copy and the other suffixes' places are sent back to their blocks. Words are compared as
   codes of the part's dictionary, so no hash decides what is equal.
4. A block adds what its own repeats say, and each document gets the starts of the windows that go. Windows that
   overlap or touch make up the maximal spans that are removed.

The counting pass has 16 counters per part (4,096 at least, 2**24 at most); the driver gets the keys that are too
large, at most total / fits of them. A part holds about PART suffixes, whatever the size of the corpus, up to some
2e12 suffixes; beyond that keys share counters and a part may be larger in proportion.

Defined results: null text has no words; rows with one id don't remove each other's windows; a null id counts as
larger than any other; texts shorter than the window stay whole; rows that repeat have the same result each; an
empty table gives an empty table; a very long text is a block of its own; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import bounded_batches, cut, text_or_empty

#: Words of the runs whose least hash is a suffix's key.
ANCHOR = 3
#: Suffixes in a part, about.
PART = 1_000_000
#: Characters of a block of texts.
BLOCK = 8_000_000
COUNTERS = (1 << 12, 1 << 24)
NO_ID = (1 << 63) - 1


def _starts(begins: np.ndarray, window: int) -> np.ndarray:
    """Places, among all words, at which a window begins within one text."""
    lo, hi = begins[:-1], np.maximum(begins[1:] - window + 1, begins[:-1])
    return _ranges(lo, hi - lo)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... n of them, for each pair, strung together."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - n), n)


def _least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the least of values[place : place + width], and where it is first."""
    at, span = np.arange(len(values)), 1
    while span < width and len(values):
        shift = min(span, width - span)
        take = values[shift:] < values[:-shift]
        values, at = np.where(take, values[shift:], values[:-shift]), np.where(take, at[shift:], at[:-shift])
        span += shift
    return values, at


def _runs(values: np.ndarray, begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First place, number of suffixes, key and text of each run of neighbouring suffixes with one anchor."""
    from millrace.llm.wordhash import grams

    starts = _starts(begins, window)
    if not len(starts):
        return starts, starts, np.zeros(0, dtype=np.uint64), starts
    width = min(ANCHOR, window)
    least, at = _least(grams(values, width), window - width + 1)
    doc, at = np.searchsorted(begins, starts, "right") - 1, at[starts]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    return starts[head], np.diff(np.append(head, len(starts))), least[starts[head]], doc[head]


def _count_keys(docs: DataFrame, window: int, counters: int) -> DataFrame:
    """bucket, n: suffixes by key modulo `counters`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from millrace.llm.wordhash import chunks, hashes, words

        total = np.zeros(counters, dtype=np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in chunks(texts, 1 << 21):
                codes, different, begins = words(texts[lo:hi])
                _, n, key, _ = _runs(hashes(different)[codes], begins, window)
                total += np.bincount((key % np.uint64(counters)).astype(np.int64), n, counters).astype(np.int64)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": found, "n": total[found]})

    return docs.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


_SENT = "part int, block long, kind int, words binary, size long, sizes binary, places binary, ids binary"
_BACK = "block long, kind int, places binary, ids binary, sizes binary"


def _send(docs: DataFrame, window: int, hot: np.ndarray, counters: int, parts: int, block_chars: int) -> DataFrame:
    """Rows for the parts (kind 0: words of runs, suffixes in each, places, ids) and each block's own row (kind 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from millrace.llm.wordhash import chunks

        task, nth = TaskContext.get().partitionId(), 0
        texts, ids, versions, chars = [], [], [], 0
        for batch in batches:
            texts += batch["text"].tolist()
            ids.append(batch["id"].to_numpy(dtype=np.int64))
            versions.append(batch["version"].to_numpy(dtype=np.int64))
            chars += int(batch["text"].str.len().sum())
            if chars >= block_chars:
                own, other = np.concatenate(ids), np.concatenate(versions)
                for lo, hi in chunks(texts, block_chars):
                    yield from _block(texts[lo:hi], own[lo:hi], other[lo:hi], (task << 32) + nth, window, hot, counters, parts)
                    nth += 1
                texts, ids, versions, chars = [], [], [], 0
        if texts:
            yield from _block(texts, np.concatenate(ids), np.concatenate(versions), (task << 32) + nth, window, hot, counters, parts)

    return docs.mapInPandas(run, _SENT)


def _block(texts: list[str], ids: np.ndarray, version: np.ndarray, block: int, window: int, hot: np.ndarray, counters: int, parts: int) -> Iterator[pd.DataFrame]:
    import pyarrow as pa
    import pyarrow.compute as pc

    from millrace.llm import wordhash

    codes, different, begins = wordhash.words(texts)
    values = wordhash.hashes(different)[codes]
    lo, n, key, doc = _runs(values, begins, window)
    if not len(lo):
        return
    split = np.isin(key % np.uint64(counters), hot)
    if split.any():  # one suffix a run, by its whole window
        single = _ranges(lo[split], n[split])
        lo, doc, n, key = np.concatenate([lo[~split], single]), np.concatenate([doc[~split], np.repeat(doc[split], n[split])]), np.concatenate([n[~split], np.ones(len(single), dtype=n.dtype)]), np.concatenate([key[~split], wordhash.runs(values, single, single + window)])
    own, size = ids[doc], n + window - 1
    same = wordhash.runs(values, lo, lo + size)
    del values
    order = np.lexsort((own, same))  # of equal runs the smallest id's first
    head = np.ones(len(order), dtype=bool)
    head[1:] = same[order][1:] != same[order][:-1]
    first = order[head][np.cumsum(head) - 1]  # for each run in order, the run that stands for it
    again, stands = order[~head], first[~head]
    equal = size[again] == size[stands]
    for j in range(int(size.max())):
        more = np.flatnonzero(equal & (j < size[again]))
        equal[more] = codes[lo[again[more]] + j] == codes[lo[stands[more]] + j]
    sent = np.sort(np.concatenate([order[head], again[~equal]]))
    again, stands = again[equal], stands[equal]
    part = ((key >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    sent = sent[np.argsort(part[sent], kind="stable")]
    edges = np.searchsorted(part[sent], np.arange(parts + 1))
    codec = pa.Codec("zstd", compression_level=1)
    rows = [(block % parts, block, 1, b"", 0, n[again].astype("u1").tobytes(), np.stack([lo[again], lo[stands]]).astype("<u4").tobytes(), np.concatenate([[len(texts)], begins, ids, version]).astype("<i8").tobytes())]
    used = np.flatnonzero(np.diff(edges)).tolist()
    for some in (used[i : i + 16] for i in range(0, len(used), 16)):
        mine = sent[edges[some[0]] : edges[some[-1] + 1]]
        said = different.take(pa.array(codes[_ranges(lo[mine], size[mine])]))
        ends = np.cumsum(size[mine])
        cuts = [0, *(int(ends[edges[p + 1] - edges[some[0]] - 1]) for p in some)]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), said), pa.scalar(" ", pa.large_string()))
        for k, p in enumerate(some):
            runs_ = sent[edges[p] : edges[p + 1]]
            data = joined[k].as_buffer()
            rows.append((p, block, 0, codec.compress(data, asbytes=True), data.size, n[runs_].astype("u1").tobytes(), np.diff(lo[runs_], prepend=0).astype("<u4").tobytes(), own[runs_].astype("<i8").tobytes()))
    yield pd.DataFrame(rows, columns=["part", "block", "kind", "words", "size", "sizes", "places", "ids"])


def deep_nodes(codes: np.ndarray, starts: np.ndarray, depth: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of `codes` at `starts` that share their first `depth` words with another, and their nodes.

    Built from the top: each round refines the nodes by as many words as fit into 63 bits and drops what is alone.
    """
    bits = max(1, int(n_words).bit_length())
    alive, node, done = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64), 0
    while done < depth and len(alive):
        step = min(63 // bits, depth - done)
        at, key = starts[alive] + done, np.zeros(len(alive), dtype=np.int64)
        for j in range(step):
            key = (key << bits) | codes[at + j]
        order = np.lexsort((key, node)) if done else np.argsort(key, kind="stable")
        alive, key, node = alive[order], key[order], node[order]
        new = np.ones(len(alive), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        node = np.cumsum(new) - 1
        shared = np.bincount(node)[node] > 1
        alive, node = alive[shared], node[shared]
        done += step
    return alive, node


def _subtrees(sent: DataFrame, parts: int, window: int) -> DataFrame:
    """Each part's deep inner nodes: the places, of all but the smallest id's suffixes, go back to their blocks."""

    def one(rows: list[tuple]) -> pd.DataFrame:
        import pyarrow as pa

        from millrace.llm.wordhash import words

        codec = pa.Codec("zstd")
        texts = pa.array([codec.decompress(r[1], r[2], asbytes=True) for r in rows], pa.large_binary()).view(pa.large_string())
        codes, different, _ = words(texts)
        n = np.concatenate([np.frombuffer(r[3], dtype="u1") for r in rows]).astype(np.int64)
        runs = [len(r[3]) for r in rows]
        size = n + window - 1
        starts = _ranges(np.cumsum(size) - size, n)
        suffix, node = deep_nodes(codes, starts, window, len(different))
        del codes
        out: list[tuple] = []
        if len(suffix):
            run = np.repeat(np.arange(len(n)), n)[suffix]
            own = np.concatenate([np.frombuffer(r[5], dtype="<i8") for r in rows])[run]
            head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            least = np.repeat(np.minimum.reduceat(own, head), np.diff(np.append(head, len(node))))
            goes = np.sort(suffix[own > least])
            lo = np.concatenate([np.cumsum(np.frombuffer(r[4], dtype="<u4"), dtype=np.uint32) for r in rows]).astype(np.int64)
            first = np.cumsum(n) - n
            run = np.searchsorted(first, goes, "right") - 1
            places = (lo[run] + goes - first[run]).astype("<u4")
            edges = np.searchsorted(run, np.cumsum([0, *runs]))
            out = [(r[0], 0, places[a:b].tobytes(), b"", b"") for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True) if a < b]
        return pd.DataFrame(out, columns=["block", "kind", "places", "ids", "sizes"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []
        for batch in batches:
            own = batch[batch["kind"] == 1]
            if len(own):
                yield own[["block", "kind", "places", "ids", "sizes"]]
            for p, block, kind, *data in batch.itertuples(index=False):
                if kind == 1:
                    continue
                if p != now and rows:
                    yield one(rows)
                    rows = []
                now = p
                rows.append((block, *data))
        if rows:
            yield one(rows)

    dealt = sent.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInPandas(run, _BACK)


def _by_document(back: DataFrame) -> DataFrame:
    """id, version, starts (uint32 word places in the text of windows that go)."""

    def one(rows: list[tuple]) -> list[tuple]:
        own = next(r for r in rows if r[0] == 1)
        table = np.frombuffer(own[2], dtype="<i8")
        n = int(table[0])
        begins, ids, version = table[1 : n + 2], table[n + 2 : 2 * n + 2], table[2 * n + 2 :]
        runs = np.frombuffer(own[3], dtype="u1").astype(np.int64)
        other, first = (_ranges(x, runs) for x in np.frombuffer(own[1], dtype="<u4").astype(np.int64).reshape(2, -1))
        flag = np.zeros(int(begins[-1]) + 1, dtype=bool)
        for r in rows:
            if r[0] == 0:
                flag[np.frombuffer(r[1], dtype="<u4")] = True
        doc_of = lambda at: np.searchsorted(begins, at, "right") - 1
        later = flag[first] | (ids[doc_of(other)] > ids[doc_of(first)])
        flag[other[later]] = True
        places = np.flatnonzero(flag)
        doc = doc_of(places)
        edges = np.searchsorted(doc, np.arange(n + 1))
        return [(ids[d], version[d], (places[edges[d] : edges[d + 1]] - begins[d]).astype("<u4").tobytes()) for d in np.flatnonzero(np.diff(edges)).tolist()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []
        for batch in batches:
            out = []
            for block, kind, *data in batch.itertuples(index=False):
                if block != now and rows:
                    out += one(rows)
                    rows = []
                now = block
                rows.append((kind, *data))
            yield pd.DataFrame(out, columns=["id", "version", "starts"])
        if rows:
            yield pd.DataFrame(one(rows), columns=["id", "version", "starts"])

    dealt = back.repartition("block").sortWithinPartitions("block")
    return dealt.mapInPandas(run, "id long, version long, starts binary")


def repeated_windows(docs: DataFrame, window: int = 13, part: int = PART, block: int = BLOCK) -> DataFrame:
    """docs(id long, version long, text): id, version, starts of the windows that go."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = int(np.clip(1 << int(16 * chars / 6 / part).bit_length(), *COUNTERS))
    counts = cut(_count_keys(docs, window, counters))
    total = counts.agg(F.sum("n")).first()[0] or 0
    fits = max(part // 4, 4 * total // counters)
    hot = np.array([r[0] for r in counts.where(F.col("n") > fits).select("bucket").collect()], dtype=np.uint64)  # at most total / fits
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part))
    back = _subtrees(_send(docs, window, hot, counters, parts, min(max(block, 2_000 * parts), 4 * block)), parts, window)
    return cut(_by_document(back))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept (the words that stay, joined by one blank), spans
    (array of [from, to) word places that went)."""
    bounded_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    starts = repeated_windows(plain, window).groupBy("id", "version").agg(F.collect_set("starts").alias("starts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, found in zip(batch["id"], batch["text"], batch["starts"], strict=True):
                words = text.encode().split()
                spans: list[list[int]] = []
                if found is not None and len(found):
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.unique(np.frombuffer(b"".join(found), dtype="<u4"))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.diff(np.cumsum(edge)[:-1] > 0, prepend=False, append=False)
                    marks = np.flatnonzero(gone)
                    spans = marks.reshape(-1, 2).tolist()
                kept, last = [], 0
                for lo, hi in spans:
                    kept += words[last:lo]
                    last = hi
                kept += words[last:]
                out.append((None if doc == NO_ID else doc, len(words), len(words) - len(kept), b" ".join(kept).decode(), spans))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "spans"]).astype({"doc_id": "Int64"})

    joined = plain.join(starts, ["id", "version"], "left").select("id", "text", "starts")
    return joined.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept string, spans array<array<long>>").withColumnRenamed("doc_id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
