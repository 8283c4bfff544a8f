"""Call-graph and lookup queries.

Every operator takes a CodeGraph and optional filters; without a seed it answers
for all seeds at once and adds the seed's column. Results are lazy DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.graph import CodeGraph, union_all
from skein.plans import traverse
from skein.schema import SYNTHETIC_ARG_POS
from skein.storage import materialize, materialize_alone, numbered, sent


def _ends(g: CodeGraph, side: str, fqn: str | None) -> DataFrame:
    """Calls with the seed's fqn on one side."""
    seed = g.method.select(F.col("id").alias(side), F.col("fqn").alias("seed_fqn"))
    if fqn is not None:
        seed = seed.filter(F.col("seed_fqn") == fqn)
    return g.calls.join(seed, side)


def _located(g: CodeGraph, calls: DataFrame, side: str, exclude_generated: bool) -> DataFrame:
    m = g.method.select(F.col("id").alias(side), "fqn", "line_start", "file_id", "generated")
    if exclude_generated:
        m = m.filter(~F.col("generated"))  # methods without the flag go too
    files = g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    return calls.join(m, side).join(files, "file_id")


def find_callers(g: CodeGraph, method_fqn: str | None = None, exclude_generated: bool = False) -> DataFrame:
    """method_fqn, fqn, file_path, line_start: one row per call edge into the method."""
    out = _located(g, _ends(g, "dst", method_fqn), "src", exclude_generated)
    return out.select(F.col("seed_fqn").alias("method_fqn"), "fqn", "file_path", "line_start")


def find_callees(g: CodeGraph, method_fqn: str | None = None, exclude_generated: bool = False, include_synthetic: bool = False) -> DataFrame:
    """method_fqn, fqn, file_path, line_start: one row per call edge out of the method."""
    calls = _ends(g, "src", method_fqn)
    if not include_synthetic:
        calls = calls.filter(F.col("caller_arg_pos") != SYNTHETIC_ARG_POS)
    out = _located(g, calls, "dst", exclude_generated)
    return out.select(F.col("seed_fqn").alias("method_fqn"), "fqn", "file_path", "line_start")


def find_endpoint_callers(g: CodeGraph, http_method: str | None = None, path: str | None = None) -> DataFrame:
    """http_method, path, role (handler or caller), fqn, file_path, line_start."""
    e = g.endpoint.select("http_method", "path", F.col("handler_method_id").alias("id"))
    if http_method is not None:
        e = e.filter(F.col("http_method") == http_method.upper())
    if path is not None:
        e = e.filter(F.col("path") == path)
    handlers = e.join(g.method.select("id", "fqn", "line_start", "file_id"), "id")
    files = g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    own = handlers.join(files, "file_id").select("http_method", "path", F.lit("handler").alias("role"), "fqn", "file_path", "line_start")
    callers = find_callers(g).withColumnRenamed("fqn", "caller_fqn")
    met = handlers.select("http_method", "path", F.col("fqn").alias("method_fqn")).join(callers, "method_fqn")
    return own.unionByName(met.select("http_method", "path", F.lit("caller").alias("role"), F.col("caller_fqn").alias("fqn"), "file_path", "line_start"))


def find_repo_dependencies(g: CodeGraph, repo: str | None = None) -> DataFrame:
    """repo_name, name of each repository it depends on."""
    to = g.repo.select(F.col("id").alias("dst"), "name")
    return g.depends_on.join(g.repos(repo).withColumnRenamed("repo_id", "src"), "src").join(to, "dst").select("repo_name", "name")


def _of(fqns: DataFrame, col: str, wanted: str | list[str] | DataFrame | None) -> DataFrame:
    """The rows whose col is wanted: a name, some names, a table (fqn), or None for all."""
    if wanted is None:
        return fqns
    if isinstance(wanted, DataFrame):
        return fqns.join(wanted.select(F.col("fqn").alias("_wanted")).distinct(), F.col(col) == F.col("_wanted"), "left_semi")
    return fqns.filter(F.col(col).isin([wanted] if isinstance(wanted, str) else list(wanted)))


def _up(g: CodeGraph, exclude_generated: bool = False, include_synthetic: bool = False) -> DataFrame:
    """Calls with callee, and fqn and file_path of a caller that has a file."""
    calls = g.calls if include_synthetic else g.calls.filter(F.col("caller_arg_pos") != SYNTHETIC_ARG_POS)
    to = g.method.select(F.col("id").alias("dst"), F.col("fqn").alias("callee"))
    return _located(g, calls, "src", exclude_generated).join(to, "dst")


def blast_radius(g: CodeGraph, method_fqn: str | list[str] | DataFrame | None = None, max_depth: int = 3, exclude_generated: bool = False,
                 include_synthetic: bool = False) -> DataFrame:
    """method_fqn, fqn, file_path, depth: transitive callers with their least depth (10 at most), of
    a method, of some, of those in a table (fqn), or of all.

    The search runs on fqns; a method on a cycle is among its own callers.
    Callers without a file are neither listed nor passed.
    """
    # methods as numbers; fqns go by the least number that bears them, as pairs of them are far more than the names
    m = numbered(g.method.select("id", "fqn", "file_id", "generated").filter("fqn IS NOT NULL"), "methods", "m")
    m = m.withColumn("n", F.min("m").over(Window.partitionBy("fqn")))
    calls = g.calls if include_synthetic else g.calls.filter(F.col("caller_arg_pos") != SYNTHETIC_ARG_POS)
    files = g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    callers = m.join(files.select("file_id").distinct(), "file_id", "left_semi")
    if exclude_generated:
        callers = callers.filter(~F.col("generated"))
    up = calls.select("src", "dst").join(callers.select(F.col("id").alias("src"), "m", F.col("n").alias("caller")), "src")
    up = materialize_alone(up.join(m.select(F.col("id").alias("dst"), F.col("n").alias("callee")), "dst").select("callee", "caller", "m"), "up")
    paths = m.join(up.select("m").distinct(), "m").join(files, "file_id").groupBy(F.col("n").alias("node"), "fqn").agg(F.min("file_path").alias("file_path"))
    names = _of(m.filter("m = n").select(F.col("n").alias("seed"), F.col("fqn").alias("method_fqn")), "method_fqn", method_fqn)
    starts = names.select("seed", F.col("seed").alias("node"))
    met = traverse.reach(up.select(F.col("callee").alias("src"), F.col("caller").alias("dst")), starts, names, min(max_depth, 10))
    pairs = met.select("method_fqn", "depth", F.explode("nodes").alias("node"))
    return pairs.join(sent(materialize(paths, "paths")), "node").select("method_fqn", "fqn", "file_path", "depth")


def search_symbol(g: CodeGraph, query: str, cap: int = 50) -> tuple[DataFrame, DataFrame]:
    """(results, counts). A literal substring of the simple name, case-insensitive.

    results: kind, name, fqn, file_path, line_start; at most `cap` of each kind, by
    fqn. counts: total_count, total_class_count, total_method_count, is_truncated,
    before the cap and before files are joined.
    """
    hit = F.contains(F.lower("name"), F.lit(query.lower()))
    classes = g["class"].filter(hit).select(F.lit("class").alias("kind"), "name", "fqn", "file_id", F.lit(0).cast("long").alias("line_start"))
    methods = g.method.filter(hit).select(F.lit("method").alias("kind"), "name", "fqn", "file_id", "line_start")
    files = g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    rows = union_all([x.join(files, "file_id").orderBy("fqn", "file_path").limit(cap) for x in (classes, methods)])
    counts = classes.unionByName(methods).agg(
        F.count("*").alias("total_count"), F.count_if(F.col("kind") == "class").alias("total_class_count"),
        F.count_if(F.col("kind") == "method").alias("total_method_count"))
    over = (F.col("total_class_count") > cap) | (F.col("total_method_count") > cap)
    return rows.select("kind", "name", "fqn", "file_path", "line_start"), counts.withColumn("is_truncated", over)


def get_file_location(g: CodeGraph, fqn: str | None = None) -> DataFrame:
    """fqn, file_path, line_start: of the method of that name, else of the class (line 0)."""
    m = g.method.select("fqn", "file_id", "line_start", F.lit(0).alias("p"), "id")
    c = g["class"].select("fqn", "file_id", F.lit(0).cast("long").alias("line_start"), F.lit(1).alias("p"), "id")
    both = m.unionByName(c)
    if fqn is not None:
        both = both.filter(F.col("fqn") == fqn)
    files = g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    best = both.join(files, "file_id").groupBy("fqn").agg(F.min_by(F.struct("file_path", "line_start"), F.struct("p", "id")).alias("b"))
    return best.select("fqn", "b.file_path", "b.line_start")


def list_endpoints(g: CodeGraph, repo: str | None = None) -> DataFrame:
    """http_method, path, handler_fqn, repo_name; endpoints without a known handler go."""
    m = g.method.select(F.col("id").alias("handler_method_id"), F.col("fqn").alias("handler_fqn"))
    e = g.endpoint.join(m, "handler_method_id").join(F.broadcast(g.repos(repo)), "repo_id")
    return e.select("http_method", "path", "handler_fqn", "repo_name")


def endpoints_view(g: CodeGraph) -> DataFrame:
    """list_endpoints in the order repository, verb, path."""
    return list_endpoints(g).orderBy("repo_name", "http_method", "path", "handler_fqn")


def list_unresolved_calls(g: CodeGraph, repo: str | None = None, kind: str | None = "stub") -> DataFrame:
    """url_pattern, http_method, callee_name, caller_fqn, repo_name. kind None lists requests that matched no endpoint too."""
    u = g.unresolved_call if kind is None else g.unresolved_call.filter(F.col("kind") == kind)
    m = g.method.select(F.col("id").alias("src"), F.col("fqn").alias("caller_fqn"), "repo_id").join(F.broadcast(g.repos(repo)), "repo_id")
    r = g.rest_call.select(F.col("id").alias("dst"), "url_pattern", "http_method", "callee_name")
    return u.join(m, "src").join(r, "dst").select("url_pattern", "http_method", "callee_name", "caller_fqn", "repo_name")


def list_repos(g: CodeGraph) -> DataFrame:
    """name, root_path, method_count, endpoint_count; repositories without either are kept."""
    m = g.method.groupBy("repo_id").agg(F.count_distinct("id").alias("method_count"))
    e = g.exposes.groupBy(F.col("src").alias("repo_id")).agg(F.count_distinct("dst").alias("endpoint_count"))
    out = g.repo.withColumnRenamed("id", "repo_id").join(m, "repo_id", "left").join(e, "repo_id", "left")
    return out.select("name", "root_path", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("method_count", "endpoint_count")])


def list_branches(g: CodeGraph, repo: str | None = None) -> DataFrame:
    """repo_name, branch_name."""
    b = g.branch.select(F.col("id").alias("dst"), F.col("name").alias("branch_name"))
    return g.has_branch.join(g.repos(repo).withColumnRenamed("repo_id", "src"), "src").join(b, "dst").select("repo_name", "branch_name")


def find_implementations(g: CodeGraph, interface_fqn: str | None = None, max_hops: int = 10, distinct: bool = False) -> DataFrame:
    """interface_fqn, class_fqn, class_name, file_path, repo_name: classes 1 to max_hops
    IMPLEMENTS edges below. One row per path, as edges can join in several ways;
    distinct=True gives each class once."""
    c = g["class"]
    start = c.select(F.col("id").alias("node"), F.col("fqn").alias("interface_fqn"))
    if interface_fqn is not None:
        start = start.filter(F.col("interface_fqn") == interface_fqn)
    found, level = [], start
    down = g.implements.select(F.col("dst").alias("node"), F.col("src").alias("child"))
    if distinct:
        met = traverse.bfs(g.implements.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start.select(F.col("interface_fqn").alias("seed"), "node"), max_hops)
        paths = met.select(F.col("seed").alias("interface_fqn"), "node")
    else:
        for _ in range(max_hops):
            level = materialize(level.join(down, "node").select("interface_fqn", F.col("child").alias("node")), "implements")
            if level.isEmpty():
                break
            found.append(level)
        paths = union_all(found) if found else start.limit(0).select("interface_fqn", "node")
    at = c.select(F.col("id").alias("node"), F.col("fqn").alias("class_fqn"), F.col("name").alias("class_name"), "file_id", "repo_id")
    files = g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    return paths.join(at, "node").join(files, "file_id").join(F.broadcast(g.repos(None)), "repo_id").select(
        "interface_fqn", "class_fqn", "class_name", "file_path", "repo_name")


def find_superclasses(g: CodeGraph, class_fqn: str | None = None, max_depth: int = 10) -> DataFrame:
    """start_fqn, class_fqn, depth, repo_name: EXTENDS upward. Parents outside all
    repositories are neither listed nor passed; a class on a cycle meets itself."""
    c = g["class"].join(F.broadcast(g.repos(None)), "repo_id").select("id", "fqn", "repo_name")
    child = g["class"].select(F.col("id").alias("src"), F.col("fqn").alias("child"))
    edges = g.extends.join(child, "src").join(c.select(F.col("id").alias("dst"), F.col("fqn").alias("parent")), "dst")
    seeds = g["class"].select(F.col("fqn").alias("seed"), F.col("fqn").alias("node")).distinct()
    if class_fqn is not None:
        seeds = seeds.filter(F.col("seed") == class_fqn)
    met = traverse.bfs(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")), seeds, max_depth)
    names = c.groupBy("fqn").agg(F.min("repo_name").alias("repo_name"))
    return met.withColumnRenamed("node", "fqn").join(names, "fqn").select(F.col("seed").alias("start_fqn"), F.col("fqn").alias("class_fqn"), "depth", "repo_name")


def find_external_calls(g: CodeGraph, repo: str | None = None) -> DataFrame:
    """repo_name, caller_fqn, callee_name, call_count: calls into other repositories and calls that stayed unresolved."""
    m = g.method.select(F.col("id").alias("src"), F.col("fqn").alias("caller_fqn"), "repo_id").join(F.broadcast(g.repos(repo)), "repo_id")
    to = g.method.select(F.col("id").alias("dst"), F.col("repo_id").alias("to_repo"), F.col("name").alias("to_name"))
    across = g.calls.join(m, "src").join(to, "dst").filter("repo_id <> to_repo").select("repo_name", "caller_fqn", F.col("to_name").alias("callee_name"))
    stubs = g.unresolved_call.join(m, "src").join(g.rest_call.select(F.col("id").alias("dst"), "callee_name"), "dst").select("repo_name", "caller_fqn", "callee_name")
    out = across.unionByName(stubs).groupBy("repo_name", "caller_fqn", "callee_name").agg(F.count("*").alias("call_count"))
    return out.orderBy(F.desc("call_count"), "repo_name", "caller_fqn", "callee_name")


def impacted_endpoints(g: CodeGraph, changed: list[str] | DataFrame | None = None, max_depth: int = 5) -> DataFrame:
    """http_method, path, handler_fqn, repo_name: endpoints whose handler is a changed
    method or calls one within max_depth steps (10 at most). changed: names, or a table (fqn); None: all methods.

    One search from all changed methods at once: who is met matters, not from which of them.
    """
    own = _of(g.method.select("fqn").distinct(), "fqn", changed)
    edges = _up(g).select(F.col("callee").alias("src"), F.col("fqn").alias("dst"))
    hit = traverse.bfs(edges, own.select(F.lit(0).alias("seed"), F.col("fqn").alias("node")), min(max_depth, 10), True).select(F.col("node").alias("fqn"))
    return list_endpoints(g).join(hit.unionByName(own), F.col("handler_fqn") == F.col("fqn"), "left_semi")


def graph_nodes_edges(g: CodeGraph, repo: str | None = None, branch: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a repository's picture.

    nodes: id, label, fqn, kind, degree, parent_id, is_test. edges: src, dst, weight, etype.
    The branch restricts class and method nodes only.
    """
    ids = F.broadcast(g.repos(repo).select("repo_id"))
    files = g.file.select(F.col("id").alias("file_id"), "path", "branch_name")
    if branch:
        files = files.filter(F.col("branch_name") == branch)
    test = lambda p: F.lower(F.translate(p, "\\", "/")).rlike("/(test|tests|androidtest)/")
    owned = g.contains_method.select(F.col("src").alias("c"), F.col("dst").alias("m"))
    cls = g["class"].join(ids, "repo_id").select(F.col("id").alias("c"), F.col("repo_id").alias("r"))
    inside = owned.join(cls, "c").select("c", "m", "r")
    calls = g.calls.select("src", "dst")
    a, b = inside.alias("a"), inside.alias("b")
    class_call = calls.join(a, F.col("src") == F.col("a.m")).join(b, F.col("dst") == F.col("b.m")).filter("a.r = b.r and a.c <> b.c")
    class_call = class_call.groupBy(F.col("a.c").alias("src"), F.col("b.c").alias("dst")).agg(F.count("*").alias("weight")).withColumn("etype", F.lit("class_call"))
    m = g.method.join(ids, "repo_id").select("id", F.col("repo_id").alias("r"))
    method_call = calls.join(m.alias("x"), F.col("src") == F.col("x.id")).join(m.alias("y"), F.col("dst") == F.col("y.id")).filter("x.r = y.r")
    method_call = method_call.select("src", "dst").distinct().select("src", "dst", F.lit(1).cast("long").alias("weight"), F.lit("method_call").alias("etype"))
    name = F.when(F.coalesce(F.col("callee_name"), F.lit("")) == "", "unknown").otherwise(F.col("callee_name"))
    ext = g.unresolved_call.join(inside, F.col("src") == F.col("m")).join(g.rest_call.select(F.col("id").alias("dst"), name.alias("name")), "dst")
    ext = ext.groupBy(F.col("c").alias("src"), "name").agg(F.count("*").alias("weight"))
    ext_call = ext.select("src", F.concat(F.lit("__ext__"), "name").alias("dst"), "weight", F.lit("ext_call").alias("etype"))
    one = F.lit(1).cast("long").alias("weight")
    kin = [e.join(cls.select(F.col("c").alias("src")), "src", "left_semi").select("src", "dst", one, F.lit(k).alias("etype")) for e, k in ((g.extends, "extends"), (g.implements, "implements"))]
    rel = g.entity_relation.join(ids, "repo_id").join(g["class"].select(F.col("id").alias("dst"), F.col("fqn").alias("target_class_fqn")), "target_class_fqn")
    rel = rel.join(g.has_relation.select(F.col("src").alias("owner"), F.col("dst").alias("id")), "id")
    jpa = rel.select(F.col("owner").alias("src"), "dst", one, F.concat(F.lit("jpa_"), F.lower("relation_type")).alias("etype"))
    edges = union_all([class_call, method_call, ext_call, *kin, jpa])

    kin_ends = union_all([k.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(1).cast("long").alias("d")) for k in kin])
    degree = class_call.select(F.col("src").alias("id"), F.col("weight").alias("d")).unionByName(kin_ends).groupBy("id").agg(F.sum("d").alias("degree"))
    out_degree = method_call.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    zero = F.coalesce("degree", F.lit(0)).cast("long").alias("degree")
    none = F.lit("").alias("parent_id")
    held = g.contains_class.select(F.col("src").alias("file_id"), F.col("dst").alias("id")).join(files, "file_id")
    classes = g["class"].join(ids, "repo_id").drop("file_id").join(held, "id")
    class_nodes = classes.join(degree, "id", "left").select(
        "id", F.col("name").alias("label"), "fqn", F.when(F.col("is_interface"), "interface").otherwise("class").alias("kind"), zero, none, test(F.col("path")).alias("is_test"))
    methods = g.method.select("id", "name", "fqn").join(owned.join(classes.select(F.col("id").alias("c"), "path"), "c").select(F.col("m").alias("id"), F.col("c").alias("parent_id"), "path"), "id")
    method_nodes = methods.join(out_degree, "id", "left").select("id", F.col("name").alias("label"), "fqn", F.lit("method").alias("kind"), zero, "parent_id", test(F.col("path")).alias("is_test"))
    ext_nodes = ext.select("name").distinct().select(
        F.concat(F.lit("__ext__"), "name").alias("id"), F.col("name").alias("label"), F.concat(F.lit("[external] "), "name").alias("fqn"),
        F.lit("external").alias("kind"), F.lit(0).cast("long").alias("degree"), none, F.lit(False).alias("is_test"))
    return union_all([class_nodes, method_nodes, ext_nodes]), edges
