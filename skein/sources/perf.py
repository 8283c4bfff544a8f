"""Load-test results: five formats to samples (endpoint_fqn, p50_ms, p99_ms, rps, sample_time, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = "endpoint_fqn string, p50_ms double, p99_ms double, rps double, sample_time string, source string"


def iso(ms: Column) -> Column:
    """Epoch milliseconds as ISO-8601; the session's time zone must be UTC."""
    return F.concat(F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value with at least p of all at or below it."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def aggregate(requests: DataFrame, source: str, wall: str = "max(end_ms) - min(start_ms)") -> DataFrame:
    """Samples of requests (endpoint_fqn, elapsed_ms, start_ms, end_ms); wall: the test's milliseconds for a key."""
    out = requests.groupBy("endpoint_fqn").agg(
        nearest_rank("elapsed_ms", 0.5).cast("double").alias("p50_ms"), nearest_rank("elapsed_ms", 0.99).cast("double").alias("p99_ms"),
        F.count("*").alias("n"), F.expr(wall).cast("double").alias("wall"), F.max("end_ms").alias("last"))
    rps = F.when(F.col("wall") > 0, F.col("n") / (F.col("wall") / 1000.0)).otherwise(0.0)
    return out.select("endpoint_fqn", "p50_ms", "p99_ms", rps.alias("rps"), iso(F.col("last")).alias("sample_time"), F.lit(source).alias("source"))


def read_gatling(spark: SparkSession, path: str) -> DataFrame:
    """simulation.log: tab-separated REQUEST lines with name, start and end in columns 3 to 5; lines with bad numbers or blank names are skipped."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.col("value").startswith("REQUEST")).filter(F.size(p) >= 7)
    rows = rows.select(F.trim(p[3]).alias("endpoint_fqn"), F.expr("try_cast(trim(split(value, '\t')[4]) as bigint)").alias("start_ms"), F.expr("try_cast(trim(split(value, '\t')[5]) as bigint)").alias("end_ms"))
    rows = rows.filter("endpoint_fqn <> '' and start_ms is not null and end_ms is not null")
    return aggregate(rows.withColumn("elapsed_ms", (F.col("end_ms") - F.col("start_ms")).cast("double")), "gatling")


def read_jmeter(spark: SparkSession, path: str) -> DataFrame:
    """JTL: httpSample and sample elements with lb, t and ts; missing numbers are 0.

    The wall time runs from the first start to the end of the last started sample
    (of several, the longest).
    """
    schema = T.StructType.fromDDL("_lb string, _t string, _ts string")
    rows = None
    for tag in ("httpSample", "sample"):
        x = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        rows = x if rows is None else rows.unionByName(x)
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.when(F.col(c).isNull(), F.lit(0).cast("long")))
    rows = rows.select(F.trim("_lb").alias("endpoint_fqn"), number("_t").alias("t"), number("_ts").alias("start_ms")).filter("endpoint_fqn <> '' and t is not null and start_ms is not null")
    rows = rows.withColumn("end_ms", F.col("start_ms") + F.col("t")).withColumn("elapsed_ms", F.col("t").cast("double"))
    return aggregate(rows, "jmeter", "max(start_ms) + max_by(t, struct(start_ms, t)) - min(start_ms)")


def read_simple_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects with fqn or endpoint_fqn, p50_ms, p99_ms, rps and sample_time."""
    schema = "fqn string, endpoint_fqn string, p50_ms double, p99_ms double, rps double, sample_time string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    name = F.coalesce(F.nullif("fqn", F.lit("")), F.nullif("endpoint_fqn", F.lit("")))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    now = F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return rows.select(name.alias("endpoint_fqn"), zero("p50_ms"), zero("p99_ms"), zero("rps"), F.coalesce("sample_time", now).alias("sample_time"), F.lit("json").alias("source")).filter("endpoint_fqn is not null")


def read_k6_summary(spark: SparkSession, path: str) -> DataFrame:
    """k6 summary: http_req_duration metrics, with or without a {url:...} tag, and the rate of the http_reqs metric
    of the same tag. The untagged duration has no tag to match and gets the rate 0."""
    schema = "metrics map<string, struct<values: map<string, double>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("metrics").alias("metric", "v"))
    tag = F.regexp_extract("metric", r"\{.*?url:([^,}]+).*\}", 1)
    rows = rows.select("metric", F.col("v.values").alias("v"), F.when(tag != "", tag).alias("url"))
    took = rows.filter(F.col("metric").startswith("http_req_duration"))
    rate = rows.filter(F.col("metric").startswith("http_reqs") & F.col("url").isNotNull()).groupBy("url").agg(F.max(F.col("v")["rate"]).alias("rate"))
    out = took.join(rate, "url", "left")
    now = F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    p = lambda k: F.coalesce(F.col("v")[k], F.lit(0.0))
    return out.select(F.coalesce("url", "metric").alias("endpoint_fqn"), F.coalesce(F.col("v")["p(50)"], F.col("v")["med"], F.lit(0.0)).alias("p50_ms"), p("p(99)").alias("p99_ms"), F.coalesce("rate", F.lit(0.0)).alias("rps"), now.alias("sample_time"), F.lit("k6").alias("source"))


def read_k6_csv(spark: SparkSession, path: str) -> DataFrame:
    """k6 raw CSV: http_req_duration rows by url, else name, else the metric; timestamps in seconds."""
    rows = spark.read.option("header", True).csv(path).filter("metric_name = 'http_req_duration'")
    have = set(rows.columns)
    col = lambda c: F.nullif(c, F.lit("")) if c in have else F.lit(None).cast("string")
    rows = rows.select(F.coalesce(col("url"), col("name"), F.lit("http_req_duration")).alias("endpoint_fqn"), F.expr("try_cast(metric_value as double)").alias("elapsed_ms"),
                       (F.expr("try_cast(timestamp as double)") * 1000).cast("long").alias("start_ms")).filter("elapsed_ms is not null and start_ms is not null")
    return aggregate(rows.withColumn("end_ms", F.col("start_ms")), "k6")


def read_perf(spark: SparkSession, path: str) -> DataFrame:
    """By extension; a .json file with a top-level metrics key is a k6 summary. No sample at all is an error for k6."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "log":
        return read_gatling(spark, path)
    if kind in ("xml", "jtl"):
        return read_jmeter(spark, path)
    if kind == "csv":
        out = read_k6_csv(spark, path)
    elif kind == "json":
        keys = spark.read.text(path, wholetext=True).select(F.json_object_keys("value").alias("k")).first()
        if keys is None or keys.k is None or "metrics" not in keys.k:
            return read_simple_json(spark, path)
        out = read_k6_summary(spark, path)
    else:
        raise ValueError(f"no load-test format ends in .{kind}")
    if out.isEmpty():
        raise ValueError(f"{path} holds no http_req_duration")
    return out
