"""Selection under several caps at once, with the semantics of taking rows one by one in order."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.views import view
from millrace.registry import query


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, in local mode one of our own where none is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Computed once, in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows that come first in `order` (unique), without sorting all of them in one task: ranges are counted, and
    only the range in which the n-th row lies is sorted for it."""
    ranged = cut(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before = 0
    for part, size in sorted(map(tuple, ranged.groupBy("_range").count().collect())):  # one row a partition
        if before + size >= n:
            whole, split = ranged.where(F.col("_range") < part), ranged.where(F.col("_range") == part).orderBy(order).limit(n - before)
            return whole.unionByName(split).drop("_range")
        before += size
    return ranged.drop("_range")


def capped(rows: DataFrame, order: str, caps: dict[str, int], target: int) -> DataFrame:
    """The rows that one pass in `order` (unique) accepts: a row counts against the cap of each of its keys only if
    it is accepted, and is rejected if one of its keys is full. At most `target` rows.

    Rounds decide many rows at a time. A row is accepted if, for each key, fewer than the cap of rows that are not
    rejected come before it; it is rejected if for some key as many accepted rows as the cap come before it. The
    first undecided row is always decided, so rounds end; each is a few windows with a limit and an aggregate.
    """
    left = cut(rows.withColumn("_ok", F.lit(False)))
    while True:
        sure = left
        for i, (key, cap) in enumerate(caps.items()):
            w = Window.partitionBy(key).orderBy(order)
            first = left.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).select(order, F.lit(True).alias(f"_in{i}"))
            sure = sure.join(first, order, "left")
        within = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_in{i}"), F.lit(False)) for i in range(len(caps))])
        now = cut(sure.withColumn("_ok", F.col("_ok") | within).select(*rows.columns, "_ok"))
        for i, (key, cap) in enumerate(caps.items()):
            w = Window.partitionBy(key).orderBy(order)
            full = now.where("_ok").withColumn("_n", F.row_number().over(w)).where(F.col("_n") == cap).select(key, F.col(order).alias(f"_full{i}"))
            now = now.join(full, key, "left").where(F.col("_ok") | F.col(f"_full{i}").isNull() | (F.col(order) < F.col(f"_full{i}"))).drop(f"_full{i}")
        left = cut(now)
        if left.where("not _ok").isEmpty():
            return first_rows(left.drop("_ok"), order, target)


def us_first(rows: DataFrame, order: str, target: int, caps: dict[str, int], soft: int, at_once: int = 500) -> DataFrame:
    """The rows that one pass in `order` selects: up to `target` under the caps; then rows whose market isn't `us` take
    the place of the selected `us` rows with the smallest score (of ties the first), until `soft` of them are in.

    The replacements, at most `soft`, are decided on the driver; it reads at most `at_once` candidates at a time, those
    whose keys aren't full, and reads again when a key that was full has room.
    """
    taken = cut(capped(rows, order, caps, target))
    have, elsewhere, last = taken.agg(F.count(F.lit(1)), F.count_if(F.col("market") != "us"), F.max(order)).first()
    if have < target or elsewhere >= soft:
        return taken
    weakest = [r.asDict() for r in taken.where("market = 'us'").orderBy("score", order).limit(soft - elsewhere).collect()]  # at most `soft`
    counts = {c: dict(map(tuple, taken.groupBy(c).count().where(F.col("count") >= cap - soft).collect())) for c, cap in caps.items()}  # keys that may fill: at most target / (cap - soft)
    known = lambda c, k: counts[c].get(k)
    out, came = [], []
    while len(came) < len(weakest):
        open_ = rows.where((F.col("market") != "us") & (F.col(order) > last))
        for c, cap in caps.items():
            open_ = open_.where(~F.col(c).isin([k for k, n in counts[c].items() if n >= cap]))
        batch = open_.orderBy(order).limit(at_once).collect()
        opened = False
        for r in batch:
            last = r[order]
            if any((known(c, r[c]) or 0) >= cap for c, cap in caps.items()):
                continue
            old = weakest[len(came)]
            for c, cap in caps.items():
                opened |= known(c, old[c]) == cap
                for k, step in ((old[c], -1), (r[c], 1)):
                    if known(c, k) is not None:
                        counts[c][k] += step
            out.append(old[order])
            came.append(r[order])
            if opened or len(came) == len(weakest):
                break
        if len(batch) < at_once and not opened:
            break
    return taken.where(~F.col(order).isin(out)).unionByName(rows.where(F.col(order).isin(came)))


@query("select_under_caps")
def select_under_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUA-09, QUA-12 to QUA-15. No oracle: a fold; tests hold it against a sequential pass."""
    p = view(spark, sf_dir, "postings").select("job_id", "source", "region", "company_type")
    target = p.count() // 2
    share = lambda s: max(20, int(target * s))
    return capped(p, "job_id", {"source": share(0.04), "region": share(0.30), "company_type": share(0.20)}, target)
