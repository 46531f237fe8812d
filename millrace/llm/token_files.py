"""Token ids as flat files for training: unsigned integers, 64-bit document offsets, memory-mapped.

Documents go in ascending id order: a range shuffle deals them to tasks, each task writes one shard, and the
shards' places in the whole follow from a prefix sum over their token counts.

A folder holds, for each shard NNNNN, `NNNNN.ids` (little-endian uint16, or uint32 for vocabularies over 65,536),
`NNNNN.idx` (uint64, one more than documents: where each begins in the shard) and `NNNNN.doc` (int64 ids), and
meta.json, written last: the integer type and for each shard its name, documents, tokens and base. A shard is
written under a name of its own and renamed, so a task that runs twice leaves one whole shard.

The folder must be on a file system that driver and executors mount, as memory mapping asks for.

Defined results: a null text is empty, so its ids are the end id alone; null ids come first and are kept as the
smallest int64; rows with one id are ordered by a hash of their text, then by the text, and may be dealt to several
tasks, so that an id with a third of all rows is no one task's; an empty table gives a folder without shards.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import inner_action, text_or_empty

NULL_ID = -(1 << 63)


def mounted(folder: str) -> str:
    """The folder as a path of this machine's file system."""
    parts = urlsplit(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped; {folder} is not on a mounted file system")
    return unquote(parts.path) if parts.scheme else folder


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write docs to a new folder; returns its meta."""
    home = mounted(folder)
    os.makedirs(home)

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from millrace.llm.tokens import encoder

        code, name = encoder(path), f"{TaskContext.get().partitionId():05d}"
        own = f"{home}/.{name}-{uuid.uuid4().hex}"
        offsets, ids_of, at = [np.zeros(1, "<u8")], [], 0
        with open(f"{own}.ids", "wb") as out:
            for batch in batches:
                found = code.encode(batch["text"].tolist())
                end = np.array([end_id], dtype=code.dtype)
                for ids in found:
                    out.write(ids.tobytes())
                    out.write(end.tobytes())
                ends = at + np.cumsum([len(x) + 1 for x in found], dtype=np.uint64)
                at = int(ends[-1]) if len(found) else at
                offsets.append(ends.astype("<u8"))
                ids_of.append(batch["id"].to_numpy(dtype="<i8"))
        n = sum(map(len, ids_of))
        if n:
            np.concatenate(offsets).tofile(f"{own}.idx")
            np.concatenate(ids_of).tofile(f"{own}.doc")
            for kind in ("idx", "doc", "ids"):
                os.replace(f"{own}.{kind}", f"{home}/{name}.{kind}")
            yield pd.DataFrame([(name, n, at, code.dtype.str)], columns=["name", "docs", "tokens", "dtype"])
        else:
            os.remove(f"{own}.ids")

    with inner_action(docs.sparkSession):
        text = text_or_empty(text_col)
        plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
        # rows with one id and hash are one text, but for a collision; the row's number lets ranges part them
        dealt = plain.repartitionByRange("id", "hash", "row").sortWithinPartitions("id", "hash", "text").drop("hash", "row")
        # one small row a shard comes to the driver
        shards = sorted(tuple(r) for r in dealt.mapInPandas(shard, "name string, docs long, tokens long, dtype string").collect())
    base, listed = 0, []
    for name, n, tokens, _ in shards:
        listed.append({"name": name, "docs": n, "tokens": tokens, "base": base})
        base += tokens
    meta = {"dtype": shards[0][3] if shards else "<u2", "end_id": end_id, "tokens": base, "shards": listed}
    with open(f"{home}/.meta", "w") as out:
        json.dump(meta, out)
    os.replace(f"{home}/.meta", f"{home}/meta.json")
    return meta


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 (of the ids as uint32), and with_ids the ids."""
    home = mounted(folder)
    with open(f"{home}/meta.json") as f:
        meta = json.load(f)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, base in zip(batch["name"], batch["base"], strict=True):
                ids = np.memmap(f"{home}/{name}.ids", dtype=meta["dtype"], mode="r")
                offsets = np.fromfile(f"{home}/{name}.idx", "<u8").astype(np.int64)
                docs = np.fromfile(f"{home}/{name}.doc", "<i8")
                for lo in range(0, len(docs), 4096):
                    own, cuts = docs[lo : lo + 4096], offsets[lo : lo + 4097]
                    parts = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    out = pd.DataFrame({"doc_id": pd.array(own, dtype="Int64"), "start": base + cuts[:-1], "n_tokens": np.diff(cuts), "ids_crc32": [zlib.crc32(p) for p in parts]})
                    out.loc[own == NULL_ID, "doc_id"] = pd.NA
                    yield out.assign(ids=parts) if with_ids else out

    names = spark.createDataFrame([(s["name"], s["base"]) for s in meta["shards"]], "name string, base long")
    return names.repartition(max(1, len(meta["shards"]))).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
