"""Storage that driver and executors share: where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; in local mode else a temporary folder of the driver."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = os.path.join(tempfile.gettempdir(), f"skein-{spark.sparkContext.applicationId}")
    if not os.path.isdir(root):
        os.makedirs(root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return "file://" + root


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def materialize_alone(df: DataFrame, name: str) -> DataFrame:
    """materialize, for rounds that follow each other: the shuffle files of the write are deleted once it is done,
    not when the driver happens to collect garbage. The session's setting is as before afterwards."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(key, before)


def numbered(df: DataFrame, name: str, column: str) -> DataFrame:
    """df written, with a gapless number from 0 for each row: short keys for traversals in place of names."""
    rows = materialize_alone(df.withColumn("_m", F.monotonically_increasing_id()), name).withColumn("_p", F.shiftright("_m", 33))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_c"))  # a row for each part of the written table
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_b")
    return rows.join(F.broadcast(sizes.select("_p", before.alias("_b"))), "_p").withColumn(column, n).drop("_m", "_p", "_b")


#: Rows of a table that is sent to every task whole, to spare a shuffle of far more rows.
ROWS_SENT = 2_000_000


def sent(df: DataFrame) -> DataFrame:
    """df, a written table, marked to be sent whole where it is small enough."""
    return F.broadcast(df) if df.count() <= ROWS_SENT else df


def discard(*dfs: DataFrame) -> None:
    """Deletes the files of materialized tables that no result still reads."""
    for df in dfs:
        spark, path = df.sparkSession, df._skein_path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package, where neither PYTHONPATH nor the
    working folder does: Spark's own file server hands them a zip of it."""
    import zipfile

    package = os.path.dirname(os.path.abspath(__file__))
    root, app = os.path.dirname(package), spark.sparkContext.applicationId
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _SHIPPED or root in known or os.getcwd() == root:
        return
    folder = tempfile.mkdtemp()  # the driver's own: its file server hands the zip out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "skein.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
