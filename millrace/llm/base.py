"""Shared plumbing: shared-folder checkpoints, size-checked broadcasts and skew-proof lookups."""

from __future__ import annotations

import contextlib
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 500_000

#: A key that holds more than this share of all rows is hot; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-3
HOT_LEAST = 200

#: Settings of inner actions: shuffle files go when the action ends, and Arrow batches stay small in memory.
_INNER = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextlib.contextmanager
def inner_action(spark: SparkSession):
    """What is planned and run inside has the settings of inner actions."""
    old = {k: spark.conf.get(k, None) for k in _INNER}
    for k, v in _INNER.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def remove(spark: SparkSession, folder: str) -> None:
    """The folder, on whatever file system it is, with all that is in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's limit of an Arrow batch, by bytes, unless it has one: whole texts go to Python in what is
    planned after an operator has returned, too."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, _INNER[name])


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared folder and carry on from there; survives lost executors."""
    spark = df.sparkSession
    shared_dir(spark)
    with inner_action(spark):
        return df.select("*").checkpoint(eager=True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df, which is cheap to read again, has at most that many rows; looks at no more than it must."""
    return df.limit(rows + 1).count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """left joined with right; right is broadcast if it was counted and is small, else both are shuffled."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, on, how)


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], held: str, total: int) -> DataFrame:
    """rows left-joined with table, which has one row per key and in `held` the number of rows with that key.

    Keys with over max(HOT_LEAST, HOT_SHARE * total) rows number at most 1 / HOT_SHARE, so they are broadcast;
    what is left has no hot key and is shuffled.
    """
    edge = max(HOT_LEAST, int(HOT_SHARE * total))
    hot = table.where(F.col(held) > edge)
    rest = table.where(F.col(held) <= edge)
    keys = [key] if isinstance(key, str) else key
    with_hot = rows.join(F.broadcast(hot), keys, "inner")
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, "left")
    return with_hot.unionByName(others)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
