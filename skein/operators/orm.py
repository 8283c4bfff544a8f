"""Entity-relation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.graph import CodeGraph


def list_entity_relations(g: CodeGraph, repo: str | None = None) -> DataFrame:
    """repo_name, source_class_fqn, field_name, relation_type, fetch_type, target_class_fqn."""
    c = g["class"].select(F.col("id").alias("src"), F.col("fqn").alias("source_class_fqn"), F.col("repo_id").alias("class_repo"))
    r = g.entity_relation.withColumnRenamed("id", "dst").drop("source_class_id", "repo_id")
    names = F.broadcast(g.repos(repo).withColumnRenamed("repo_id", "class_repo"))
    return g.has_relation.join(c, "src").join(r, "dst").join(names, "class_repo").select(
        "repo_name", "source_class_fqn", "field_name", "relation_type", "fetch_type", "target_class_fqn")


def find_eager_fetches(g: CodeGraph, repo: str | None = None) -> DataFrame:
    """The EAGER ones, without fetch_type."""
    return list_entity_relations(g, repo).filter(F.col("fetch_type") == "EAGER").drop("fetch_type")
