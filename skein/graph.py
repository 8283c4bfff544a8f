"""A code graph: one DataFrame per node and edge table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema


def _default(kind: str, value: object) -> Column:
    if value == ():
        return F.array().cast(kind)
    return F.lit(value).cast(kind)


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns: missing ones get the default, extra ones go."""
    have = set(df.columns)
    return df.select(*[(F.col(c).cast(t) if c in have else _default(t, d)).alias(c) for c, t, d in schema.COLUMNS[table]])


class CodeGraph:
    """Named DataFrames; g.method, g.calls and so on. Nothing runs until an operator's result is used."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]]) -> None:
        """tables: DataFrames, or functions that give one when the table is first used."""
        unknown = set(tables) - set(schema.TABLES)
        if unknown:
            raise ValueError(f"no such tables: {sorted(unknown)}")
        self.spark = spark
        self._given = dict(tables)
        self._ready: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._ready:
            given = self._given.get(name)
            if given is None:
                df = self.spark.createDataFrame([], schema.struct(name))
            else:
                df = conform(given() if callable(given) else given, name)
            self._ready[name] = df
        return self._ready[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in schema.TABLES:
            raise AttributeError(name)
        return self[name]

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {t: self[t] for t in schema.TABLES}

    def with_tables(self, **tables: DataFrame) -> "CodeGraph":
        return CodeGraph(self.spark, {**self._given, **self._ready, **tables})

    def union(self, **tables: DataFrame) -> "CodeGraph":
        return self.with_tables(**{t: self.tables[t].unionByName(conform(df, t)) for t, df in tables.items()})

    @classmethod
    def from_rows(cls, spark: SparkSession, **tables: list[dict]) -> "CodeGraph":
        """Small hand-made graphs: rows as dicts; columns that a row lacks get defaults."""
        out = {}
        for t, rows in tables.items():
            cols = schema.COLUMNS[t]
            data = [tuple(r.get(c, list(d) if d == () else d) for c, _, d in cols) for r in rows]
            out[t] = spark.createDataFrame(data, schema.struct(t))
        return cls(spark, out)

    @classmethod
    def read(cls, spark: SparkSession, path: str, tables: tuple[str, ...] = schema.TABLES) -> "CodeGraph":
        return cls(spark, {t: spark.read.schema(schema.struct(t)).parquet(f"{path}/{t}") for t in tables})

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Node tables are partitioned by repository, so that a repository's queries read its files only."""
        for t, df in self.tables.items():
            w = df.withColumn("_repo", F.col("repo_id")) if "repo_id" in df.columns else df
            w = w.write.mode(mode)
            (w.partitionBy("_repo") if "repo_id" in df.columns else w).parquet(f"{path}/{t}")

    def repos(self, repo: str | None) -> DataFrame:
        """(repo_id, repo_name) of one repository, or of all."""
        r = self.repo.select(F.col("id").alias("repo_id"), F.col("name").alias("repo_name"))
        return r if repo is None else r.filter(F.col("repo_name") == repo)

    def methods_of(self, repo: str | None, located: bool = True) -> DataFrame:
        """Methods of a repository with repo_name, and file_path by an inner join: methods without a file go."""
        m = self.method.join(F.broadcast(self.repos(repo)), "repo_id")
        if located:
            m = m.join(self.file.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")
        return m


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
