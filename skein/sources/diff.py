"""Unified diffs: which new lines a diff adds, and where they stand in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def added_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, file, line, position of each added line; diffs: (diff_id, text).

    line counts in the new file, from the hunk's header; position counts the
    file's lines in the diff, its first hunk header being 1. Deleted files add nothing.
    """
    x = F.col("x")
    rows = diffs.select("diff_id", F.posexplode(F.split("text", "\r?\n")).alias("i", "x"))
    head = x.startswith("+++ b/")
    rows = rows.withColumn("part", F.expr("count_if(x like '+++ b/%' or x like 'diff --git%') over (partition by diff_id order by i)"))
    rows = rows.withColumn("file", F.expr("first_value(case when x like '+++ b/%' then substring(x, 7) end) over (partition by diff_id, part order by i)"))
    rows = rows.filter(F.col("file").isNotNull() & ~head)
    rows = rows.withColumn("hunk", F.expr("count_if(x like '@@ %') over (partition by diff_id, part order by i)")).filter("hunk > 0")
    rows = rows.withColumn("start", F.expr(r"first_value(try_cast(regexp_extract(x, '\\+(\\d+)', 1) as int)) over (partition by diff_id, part, hunk order by i)"))
    rows = rows.withColumn("line", F.expr("start - 1 + count_if(x like '+%' or x like ' %' or x = '') over (partition by diff_id, part, hunk order by i)"))
    rows = rows.withColumn("position", F.expr("count_if(x like '@@ %' or x like '-%' or x like '+%' or x like ' %' or x = '') over (partition by diff_id, part order by i)"))
    return rows.filter(x.startswith("+")).select("diff_id", "file", F.col("line").cast("int").alias("line"), F.col("position").cast("int").alias("position"))
