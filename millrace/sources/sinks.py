"""Writers, exports and scans: CSV and JSON, dispatch by suffix, sessions, frozen exports, a cache of vectors."""

from __future__ import annotations

import fnmatch
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Suffixes and the reader that each goes to.
KINDS = {".csv": "csv", ".xlsx": "xlsx", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet", ".docx": "docx"}
#: Rows that are put together in a step of a fingerprint.
TOGETHER = 1_000


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_csv(df: DataFrame, path: str, columns: list[str]) -> int:
    """SRC-03: these columns, with a header; the number of rows, counted as they are written."""
    seen = Observation()
    df.select(*columns).observe(seen, F.count(F.lit(1)).alias("n")).write.csv(path, header=True, escape='"', mode="overwrite")
    return seen.get["n"]


def scan_csv(spark: SparkSession, path: str, schema: str, order: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """SRC-05, SRC-06: a CSV with a header; rows from `offset` on, at most `limit`, of an explicit order."""
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', encoding="UTF-8")
    rows = rows.orderBy(order) if order else rows
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """SRC-04: a small value as one file, on whatever file system."""
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small file


def kind_of(path: str) -> str:
    """SRC-15: the reader that a file's suffix asks for."""
    for suffix, kind in KINDS.items():
        if path.lower().endswith(suffix):
            return kind
    raise ValueError(f"no reader for {path}")


def discover(spark: SparkSession, folder: str, patterns: list[str]) -> list[str]:
    """SRC-15: files of a folder that match a pattern, in order of the patterns, then of names."""
    fs, at = _fs(spark, folder)
    names = sorted(str(s.getPath().toString()) for s in fs.listStatus(at) if s.isFile())
    return list(dict.fromkeys(n for p in patterns for n in names if fnmatch.fnmatch(n.rsplit("/", 1)[-1], p)))


def by_line(raw: DataFrame, manifest: DataFrame, line: str = "line_no") -> DataFrame:
    """SRC-07: raw lines that a manifest names, none beyond its last; the manifest's columns go with them."""
    last = manifest.agg(F.max(line)).first()[0]
    return raw.where(F.col(line) <= F.lit(-1 if last is None else last)).join(manifest, line)


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SRC-31, SRC-19: rows by key; what the new row says goes before the old one's, nulls say nothing. Columns that one
    side lacks are null there."""
    a, b = old.withColumn("_age", F.lit(1)), new.withColumn("_age", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (key, "_age")]
    return both.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_age"))).alias(c) for c in columns])


def frozen(df: DataFrame, path: str, private: tuple[str, ...]) -> None:
    """SRC-21: JSON lines without private columns."""
    df.drop(*private).write.mode("overwrite").json(path)


def fingerprint(df: DataFrame, key: str, columns: list[str]) -> str:
    """SRC-22: SHA-256 over rows in order of `key`, taken in steps, so that no step sees more than TOGETHER of them when
    keys are whole numbers without large gaps or repeats."""
    row = F.sha2(F.to_json(F.struct(key, *columns)), 256)
    level = df.select(F.col(key).cast("long").alias("k"), row.alias("h"))
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
        level = level.groupBy(F.floor(F.col("k") / TOGETHER).alias("k")).agg(F.sha2(joined, 256).alias("h"))
        few = level.limit(TOGETHER + 1).collect()
        if len(few) <= TOGETHER:
            import hashlib

            return hashlib.sha256("".join(r["h"] for r in sorted(few)).encode()).hexdigest()


def write_vectors(vectors: DataFrame, folder: str, model: str) -> None:
    """SRC-22: vectors with what they have to be checked by: their number, fingerprint and model."""
    vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    kept = vectors.sparkSession.read.parquet(f"{folder}/vectors")
    write_json(vectors.sparkSession, f"{folder}/meta.json", {"model": model, "rows": kept.count(), "fingerprint": fingerprint(kept, "vec_id", ["embedding"])})


def load_vectors(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """Vectors of a folder, if they are those that were written, by this model, all finite."""
    meta, vectors = read_json(spark, f"{folder}/meta.json"), spark.read.parquet(f"{folder}/vectors")
    if meta["model"] != model:
        raise ValueError(f"vectors of the model {meta['model']}, not {model}")
    if fingerprint(vectors, "vec_id", ["embedding"]) != meta["fingerprint"]:
        raise ValueError("vectors don't have the fingerprint that was written")
    if not vectors.where(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).isEmpty():
        raise ValueError("vectors that aren't finite")
    return vectors
