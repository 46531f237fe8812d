"""Best-fit packing of tokenised documents into sequences, by best-two-fit on the histogram of lengths.

A sequence is filled greedily, longest piece that fits first; then its smallest piece is replaced by the two
unpacked pieces that fit the expanded gap more tightly, if there are such. Pieces of one length are
interchangeable, so the choice is made for lengths, of which there are at most `capacity`: the driver holds one
count per length, and a pattern that can be repeated is used as often as the counts allow, which is what
best-two-fit does piece by piece. Tasks then number the pieces of each length and look up their places. No
group of pieces is gathered anywhere; a length that holds a third of all rows is numbered in shares.

Defined results: a null text is empty (one piece of its end token alone); an empty table gives an empty table;
rows that repeat are packed as often as they occur; null ids are packed like any.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.base import bounded_batches, cut, fresh, text_or_empty
from millrace.llm.tokens import CACHE_WORDS

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """A document's ids and end_id, cut from its end into pieces of `capacity`; the first piece may be shorter.

    doc_id, piece, start, length, ids_crc32, and with with_ids the ids as little-endian bytes.
    """

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from millrace.llm.tokens import encoder

        code = encoder(path, cache_words)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["id"], code.encode(batch["text"].tolist()), strict=True):
                ids = np.append(ids, code.dtype.type(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, lo in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[lo : first if k == 0 else lo + capacity].tobytes()
                    rows.append((doc, k, lo, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc_id": "Int64"})

    plain = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return plain.mapInPandas(_nullable(cut_up), PIECES + (", ids binary" if with_ids else ""))


def _nullable(f):
    """Ids come as floats where a batch has nulls among them, which would round them; so they travel as Int64."""

    def run(batches):
        return f(b.assign(id=b["id"].astype("Int64")) for b in batches)

    return run


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns, each a count per length, and how many sequences have it."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while True:
        present = np.flatnonzero(left)
        if not len(present):
            return out
        lengths, used, gap = present.tolist(), {}, capacity
        at = len(lengths)
        while gap and (at := bisect_right(lengths, gap, 0, at)):  # greedily, the longest that fits first
            length = lengths[at - 1]
            used[length] = int(min(gap // length, left[length]))
            gap -= used[length] * length
            at -= 1
        if gap:
            smallest = min(used)
            rest = left.copy()
            for length, n in used.items():
                rest[length] -= n
            open_ = np.flatnonzero(rest[: gap + smallest])
            if len(open_):
                mate = np.searchsorted(open_, np.minimum(open_, gap + smallest - open_), "right") - 1
                mate = np.where((mate >= 0) & (open_[mate] == open_) & (rest[open_] < 2), mate - 1, mate)
                both = np.where(mate >= 0, open_ + open_[mate], 0)
                best = int(both.argmax())
                if both[best] > smallest:
                    used[smallest] -= 1
                    for length in (int(open_[best]), int(open_[mate[best]])):
                        used[length] = used.get(length, 0) + 1
        used = {length: n for length, n in used.items() if n}
        times = int(min(left[length] // n for length, n in used.items()))
        for length, n in used.items():
            left[length] -= n * times
        out.append((used, times))


def _slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Sorted by (length, first rank): length, first rank, copies per sequence, first sequence, offset of the first copy."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for used, times in patterns:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, taken.get(length, 0), n, base, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = 2048, shares: int = 10_000) -> DataFrame:
    """found (pieces, written to the shared folder, so that reading them again gives the same rows in place) with sequence_id and offset.

    A length with over a `shares`-th of the pieces is numbered in several shares, so at most
    capacity + shares counts come to the driver, whatever the size. Shares and ranks go by a number of the row, so
    that rows which repeat are spread like any.
    """
    spark, columns = found.sparkSession, found.columns
    row, share_, shares_, first_, rank_ = fresh(found, "row", "share", "n_shares", "first", "rank")
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    total = sum(counts.values())
    if not total:
        return found.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    most = max(256, total // shares)
    split = spark.createDataFrame([(k, -(-n // most)) for k, n in counts.items()], f"length long, {shares_} long")
    numbered = found.withColumn(row, F.monotonically_increasing_id())
    shared = numbered.join(F.broadcast(split), "length").withColumn(share_, F.pmod(F.xxhash64(row), F.col(shares_))).drop(shares_)
    sizes = sorted((r[0], r[1], r[2]) for r in shared.groupBy("length", share_).count().collect())  # at most capacity + 2 * shares rows
    firsts, before = [], {}
    for length, s, n in sizes:
        firsts.append((length, s, before.get(length, 0)))
        before[length] = before.get(length, 0) + n
    firsts = spark.createDataFrame(firsts, f"length long, {share_} long, {first_} long")
    order = Window.partitionBy("length", share_).orderBy(row)
    ranked = shared.withColumn(rank_, F.row_number().over(order)).join(F.broadcast(firsts), ["length", share_])
    ranked = ranked.select(*columns, (F.col(rank_) - 1 + F.col(first_)).alias(rank_))
    slots = spark.sparkContext.broadcast(_slots(best_two_fit(counts, capacity)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = slots.value
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            rank, length = batch[rank_].to_numpy(), batch["length"].to_numpy()
            row = table[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            yield batch.drop(columns=rank_).assign(sequence_id=row[:, 3] + nth // row[:, 2], offset=row[:, 4] + nth % row[:, 2] * length)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    fixed = [f.name for f in found.schema if f.dataType.simpleString() == "bigint"]

    def run(batches):
        return place(b.astype(dict.fromkeys(fixed, "Int64")).astype({rank_: "int64", "length": "int64"}) for b in batches)

    return ranked.mapInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """pieces of docs with sequence_id and offset; other columns of docs play no part."""
    bounded_batches(docs.sparkSession)
    return pack(cut(pieces(docs, path, capacity, end_id, with_ids=with_ids, cache_words=cache_words)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (bytes), documents (array of doc_id, piece, offset, length) of pack_documents(with_ids=True)."""
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    by = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))  # at most `capacity` pieces
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return by.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("documents"))
