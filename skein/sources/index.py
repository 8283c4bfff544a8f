"""From a source tree to a resolved graph."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import schema
from skein.functions import text
from skein.graph import CodeGraph
from skein.operators import resolve
from skein.sources import code
from skein.storage import materialize, ship_package

FACTS = "path string, file_id string, kind string, fact string"
# The fields of each kind of fact.
KINDS = {
    "class": "name string, fqn string, is_interface boolean, is_object boolean, enclosing_class_name string, annotations array<string>, line int",
    "method": "name string, fqn string, class_fqn string, class_name string, package string, line_start long, is_suspend boolean, annotations array<string>, generated boolean, is_entry_point boolean, complexity_hint string, io_fanout long, io_parallel_count long, io_serial_count long, io_parallel_wrapper string",
    "import": "simple string, fqn string", "parent": "child_fqn string, package string, parent string, kind string", "impl": "interface_name string, class_fqn string", "field": "class_fqn string, field string, type string",
    "param": "method_fqn string, param string, type string", "constant": "name string, value string", "site": "caller_fqn string, caller_class string, package string, receiver string, callee string, argc int, line int",
    "rest": "caller_fqn string, http_method string, url_pattern string", "endpoint": "http_method string, prefix array<string>, parts array<string>, handler_fqn string, kotlin boolean, raw boolean",
    "relation": "class_fqn string, target string, package string, field_name string, relation_type string, fetch_type string",
}


def extract_facts(files: DataFrame) -> DataFrame:
    """A row per fact of files (id, path, language, content); a file that can't be read as UTF-8 is read with replacements."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from skein.sources.extract.parser import extract

        for pdf in batches:
            rows = []
            for i, path, language, content in zip(pdf["id"], pdf["path"], pdf["language"], pdf["content"]):
                for kind, fact in extract(path, bytes(content).decode("utf-8", "replace"), language):
                    rows.append((path, i, kind, json.dumps(fact)))
            yield pd.DataFrame(rows, columns=["path", "file_id", "kind", "fact"])

    return files.select("id", "path", "language", "content").mapInPandas(run, FACTS)


def facts_of(facts: DataFrame, kind: str) -> DataFrame:
    return facts.filter(F.col("kind") == kind).select("path", "file_id", F.from_json("fact", KINDS[kind]).alias("f")).select("path", "file_id", "f.*")


def _whole_paths(ends: DataFrame, constants: DataFrame) -> DataFrame:
    """Endpoints with `path`: references to constants replaced by their values (an unknown one by nothing)."""
    ends = ends.withColumn("e", F.xxhash64("file_id", "handler_fqn", "http_method", F.to_json("prefix"), F.to_json("parts")))
    known = constants.groupBy("name").agg(F.min("value").alias("value"))
    out = ends
    for c in ("prefix", "parts"):
        each = ends.select("e", F.posexplode(c).alias("i", "part"))
        each = each.withColumn("ref", F.when(F.col("part").startswith("${"), F.substring_index(F.regexp_replace("part", r"[${}]", ""), ".", -2)))
        each = each.join(known, F.col("ref") == F.col("name"), "left").withColumn("v", F.when(F.col("ref").isNull(), F.col("part")).otherwise(F.coalesce("value", F.lit(""))))
        whole = each.groupBy("e").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("i", "v"))), lambda x: x["v"]), "").alias(f"{c}_whole"))
        out = out.join(whole, "e", "left")
    head, tail = F.coalesce("prefix_whole", F.lit("")), F.coalesce("parts_whole", F.lit(""))
    bare = F.regexp_replace(head, "/+$", "")
    joined = F.when(F.col("kotlin") & (head != "") & (tail != ""), F.concat(bare, F.lit("/"), F.regexp_replace(tail, "^/+", ""))).otherwise(F.concat(bare, tail))
    return out.withColumn("path", F.when(F.col("raw"), tail).otherwise(joined))


def _whole_urls(rest: DataFrame, constants: DataFrame) -> DataFrame:
    """Requests with the constant in their url replaced by its value; a url with an unknown one, or with several, is DYNAMIC."""
    known = constants.groupBy("name").agg(F.min("value").alias("value"))
    ref = F.regexp_extract("url_pattern", r"\$\{([^}]*)\}", 1)
    out = rest.withColumn("ref", ref).join(known, F.col("ref") == F.col("name"), "left")
    whole = F.replace("url_pattern", F.concat(F.lit("${"), "ref", F.lit("}")), F.col("value"))
    whole = F.when(whole.isNull() | F.contains(whole, F.lit("${")), schema.DYNAMIC_URL).otherwise(whole)
    return out.withColumn("url_pattern", F.when(F.col("ref") == "", F.col("url_pattern")).otherwise(whole)).drop("ref", "name", "value")


def index_files(spark: SparkSession, files: DataFrame, repo: str, root: str = "", framework: bool = True) -> CodeGraph:
    """A graph of files (as sources.code.read_tree gives them) of one repository.

    Ids come from names, so indexing again gives the same rows. Classes and
    methods that share an fqn count once, the first by (path, line).
    """
    rid = F.md5(F.lit(repo))
    mid = lambda c: F.md5(F.concat_ws(":", F.lit(repo), F.lit("m"), c))
    cid = lambda c: F.md5(F.concat_ws(":", F.lit(repo), F.lit("c"), c))
    facts = materialize(extract_facts(files), "facts")
    of = lambda k: facts_of(facts, k)
    first = lambda df, line: resolve.dedupe_by_fqn(df, ("path", line))
    cls = first(of("class"), "line").withColumn("id", cid("fqn")).withColumn("repo_id", rid)
    met = first(of("method"), "line_start").withColumn("id", mid("fqn")).withColumn("class_id", cid("class_fqn")).withColumn("repo_id", rid)
    ends = _whole_paths(of("endpoint"), of("constant"))
    regex = F.when(F.col("raw"), F.col("path")).otherwise(text.path_regex(F.col("path")))
    endpoint = ends.select(F.md5(F.concat_ws(":", F.lit(repo), "http_method", "path", "handler_fqn")).alias("id"), "http_method", "path", regex.alias("path_regex"), F.when(F.col("handler_fqn") != "", mid("handler_fqn")).otherwise("").alias("handler_method_id"), rid.alias("repo_id")).dropDuplicates(["id"])
    rest = _whole_urls(of("rest"), of("constant")).withColumn("i", F.row_number().over(Window.partitionBy("caller_fqn").orderBy("http_method", "url_pattern")))
    rest = rest.select(F.md5(F.concat_ws(":", F.lit(repo), "caller_fqn", "http_method", "url_pattern", F.col("i").cast("string"))).alias("id"), "http_method", "url_pattern", mid("caller_fqn").alias("caller_method_id"), rid.alias("repo_id"))
    imports = of("import")
    rel = of("relation").join(imports.select("file_id", F.col("simple").alias("target"), F.col("fqn").alias("imported")), ["file_id", "target"], "left")
    target = F.coalesce("imported", F.concat_ws(".", F.nullif("package", F.lit("")), "target"))
    rel = rel.select(F.md5(F.concat_ws(":", cid("class_fqn"), "field_name", "target")).alias("id"), cid("class_fqn").alias("source_class_id"), target.alias("target_class_fqn"), "field_name", "relation_type", "fetch_type", rid.alias("repo_id"))

    sites = of("site").withColumn("site_id", F.xxhash64("file_id", "caller_fqn", "receiver", "callee", "line", "argc").cast("string")).withColumn("caller_id", mid("caller_fqn")).dropDuplicates(["site_id"])
    for_calls = met.select("id", "name", "class_fqn", "class_name", "file_id", F.col("path").alias("file_path"), "line_start")
    parents = materialize(resolve.resolve_parents(of("parent"), imports, cls), "parents")
    found, stubs = resolve.resolve_calls(sites, for_calls, imports, of("field").dropDuplicates(["class_fqn", "field"]), of("impl"), parents)
    found, stubs = materialize(found, "calls"), materialize(stubs, "stubs")
    calls = found.groupBy("src", "dst").agg(F.min("callee_name").alias("callee_name"), F.max("caller_arg_pos").alias("caller_arg_pos"), F.max("callee_param_pos").alias("callee_param_pos"))
    # a constructor of a class that is not here makes no stub
    stubs = stubs.filter(~F.col("callee_name").endswith("<init>")).select(F.md5(F.concat_ws(":", F.lit(repo), F.lit("s"), "site_id")).alias("dst"), "src", "callee_name")
    stub_rows = stubs.select(F.col("dst").alias("id"), F.lit("UNKNOWN").alias("http_method"), F.lit("UNRESOLVED").alias("url_pattern"), "callee_name", F.col("src").alias("caller_method_id"), rid.alias("repo_id"))
    edge = lambda df, a, b: df.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    branches = files.select("branch_name").distinct().select(F.md5(F.concat_ws(":", rid, "branch_name")).alias("id"), F.col("branch_name").alias("name"), rid.alias("repo_id"))
    rest_rows = rest.withColumn("callee_name", F.lit(""))
    kinds = edge(stubs, "src", "dst").withColumn("kind", F.lit("stub")).unionByName(edge(rest, "caller_method_id", "id").withColumn("kind", F.lit("rest")))
    g = CodeGraph(spark, {
        "repo": spark.range(1).select(rid.alias("id"), F.lit(repo).alias("name"), F.lit(root).alias("root_path")), "file": files.withColumn("repo_id", rid), "branch": branches, "class": cls, "method": met, "endpoint": endpoint,
        "rest_call": rest_rows.unionByName(stub_rows.select(rest_rows.columns)), "entity_relation": rel, "calls": calls, "unresolved_call": kinds, "contains_class": edge(cls, "file_id", "id"),
        "contains_method": edge(met, "class_id", "id"), "exposes": edge(endpoint, "repo_id", "id"), "has_branch": edge(branches, "repo_id", "id"), "has_relation": edge(rel, "source_class_id", "id")})
    g, kin = resolve.external_stubs(g, parents)
    g = g.with_tables(extends=kin.filter("kind = 'extends'"), implements=kin.filter("kind = 'implements'"))
    g = g.union(calls=resolve.virtual_dispatch(g))
    if framework:
        g = g.with_tables(method=resolve.validator_entry_points(g))
        g = g.union(calls=resolve.framework_edges(g, files.select("path", "content")))
    return g


def index_repo(spark: SparkSession, root: str, repo: str, branch: str = "master", framework: bool = True) -> CodeGraph:
    files = materialize(code.read_tree(spark, root, repo, branch), "files")
    return index_files(spark, files, repo, root, framework)
