"""Source trees: files of known languages with a content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.patterns import lookup

# Folders that are never read, and the language of each extension.
PRUNED = ("build", "out", "generated", ".gradle", ".git", "node_modules", ".venv", "__pycache__", "target")
LANGUAGES = {"java": "java", "kt": "kotlin", "kts": "kotlin", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript"}


def blob_hash(content: Column, git: bool = False) -> Column:
    """SHA-1 of the bytes; git: framed as git hashes a blob."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content)) if git else F.sha1(content)


def keep_path(path: Column) -> Column:
    """Whether a path below the root is read: no pruned folder in it, not under src/test."""
    folders = F.split(path, "/")
    return ~F.exists(F.slice(folders, 1, F.size(folders) - 1), lambda d: d.isin(list(PRUNED))) & ~F.contains(F.concat(F.lit("/"), path), F.lit("/src/test/"))


def read_tree(spark: SparkSession, root: str, repo_id: str, branch: str = "master", git: bool = False) -> DataFrame:
    """id, path (below root), language, repo_id, branch_name, blob_hash, content of the source files under root."""
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.withColumn("path", F.expr(f"substring(path, locate({base!r}, path) + {len(base)})") if base != "//" else F.col("path")).drop("modificationTime", "length")
    language = lookup(LANGUAGES, F.substring_index("path", ".", -1), "")
    files = files.filter(keep_path(F.col("path"))).withColumn("language", language).filter("language <> ''")
    return files.select(F.md5(F.concat_ws(":", F.lit(repo_id), F.lit(branch), "path")).alias("id"), "path", "language", F.lit(repo_id).alias("repo_id"), F.lit(branch).alias("branch_name"), blob_hash(F.col("content"), git).alias("blob_hash"), "content")
