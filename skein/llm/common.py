"""Helpers that several operators share: shared storage, lineage cuts, components."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.storage import discard, fresh_dir, materialize, shared_dir, ship_package

__all__ = ["connected_components", "discard", "fresh_dir", "materialize", "release", "shared_dir", "tune"]

#: Rows a Python worker gets at once; texts can be long, so far below Spark's default.
ARROW_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker's memory doesn't follow the text length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_package(spark)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are done with;
    the cleaner acts when the driver's JVM collects its garbage."""
    for _ in range(2):  # the driver's handles go first, then what only they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of the edges (src, dst): the smallest node
    that links reach.

    Alternates large-star and small-star steps: each is one aggregation and one
    join on the node, linear in the edges, and a round at least halves the depth
    of the trees. Every round is written to the shared folder, so no plan grows
    and nothing but two counts reaches the driver; the round before it is deleted
    then. Nulls and loops are left out.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        """large: neighbours above a node move to the least of its neighbours and
        itself; small: a node and those below it move to the least of them."""
        if large:
            sym = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        else:
            sym = e
        least = sym.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        moved = sym.join(least, "src")
        if large:
            out = moved.filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        else:
            out = moved.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(
                least.select("src", F.col("m").alias("dst")))
        return out.filter("src <> dst").distinct()

    e = edges.filter("src is not null and dst is not null and src <> dst")
    e = materialize(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        before, e = e, materialize(star(star(e, True), False), "cc")
        discard(before)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
