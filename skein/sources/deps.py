"""Build files: declared dependencies as (file, group, artifact, version)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Gradle configurations that count, and prefixes of those that don't.
CONFIGURATIONS = ("implementation", "api", "compileOnly", "runtimeOnly", "annotationProcessor", "kapt", "compile")
SKIPPED = ("test", "androidTest", "debugImplementation", "releaseImplementation")


def read_poms(spark: SparkSession, path: str) -> DataFrame:
    """<dependency> elements of pom.xml files, those of dependencyManagement too; scopes test and provided go.
    Property references in versions stay as they are."""
    schema = "groupId string, artifactId string, version string, scope string"
    rows = spark.read.format("xml").option("rowTag", "dependency").option("ignoreNamespace", True).schema(schema).load(path).withColumn("file", F.input_file_name())
    rows = rows.filter(~F.coalesce("scope", F.lit("")).isin("test", "provided"))
    blank = lambda c, n: F.coalesce(F.trim(c), F.lit("")).alias(n)
    return rows.select("file", blank("groupId", "group"), blank("artifactId", "artifact"), blank("version", "version")).filter("group <> '' and artifact <> ''")


def read_gradle(spark: SparkSession, path: str) -> DataFrame:
    """group:artifact:version strings of build.gradle and build.gradle.kts files, each group and artifact once a file (the first line)."""
    part = r"""^[ \t]*(\w+)\s*\(?["']([A-Za-z0-9._\-]+):([A-Za-z0-9._\-]+):([A-Za-z0-9._\-]+)["']"""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    g = lambda i: F.regexp_extract("text", part, i)
    rows = rows.select("file", "line", g(1).alias("conf"), g(2).alias("group"), g(3).alias("artifact"), g(4).alias("version"))
    rows = rows.filter(F.col("conf").isin(list(CONFIGURATIONS)) & ~F.col("conf").rlike("^(" + "|".join(SKIPPED) + ")"))
    return rows.groupBy("file", "group", "artifact").agg(F.min_by("version", "line").alias("version"))
