"""Write-side operators: what turns extracted facts into a resolved graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import schema
from skein.functions import text
from skein.graph import CodeGraph, union_all
from skein.storage import materialize, materialize_alone

# Framework types and methods that run for every request.
FILTER_BASES = ("OncePerRequestFilter", "GenericFilterBean", "HandlerInterceptorAdapter")
FILTER_BASE_FQNS = ("org.springframework.web.filter.OncePerRequestFilter", "org.springframework.web.filter.GenericFilterBean", "org.springframework.web.servlet.handler.HandlerInterceptorAdapter")
FILTER_INTERFACES = ("org.springframework.web.servlet.HandlerInterceptor", "jakarta.servlet.Filter", "javax.servlet.Filter")
FILTER_METHODS = ("doFilterInternal", "doFilter", "preHandle", "postHandle", "afterCompletion")
# Annotations of advice methods.
ADVICE = ("Around", "Before", "After", "AfterReturning", "AfterThrowing")
#: Publishers of events that meet a listener at once: as many as a run of equal values in the result is long.
PUBLISHERS_AT_ONCE = 1024


def _matches(g: CodeGraph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, endpoints, pairs): requests (src, call_id, src_repo, rs) and endpoints (dst, dst_repo, es), each once,
    with the sets of urls and of patterns they stand for, and the distinct pairs (rs, es) that fit.

    Verbs agree or one is empty; the url's path matches the endpoint's pattern. Different paths are tested against
    different patterns, however many requests and endpoints share them. Two equi-joins carry the test: on the literal
    first segment, and, for patterns that begin with a variable, on the verb.
    """
    verb = F.coalesce(F.upper("http_method"), F.lit(""))
    calls = g.rest_call.filter((F.col("url_pattern") != schema.DYNAMIC_URL) & (F.coalesce("caller_method_id", F.lit("")) != ""))
    calls = calls.select(F.col("id").alias("call_id"), F.col("caller_method_id").alias("src"), verb.alias("v"), text.url_path(F.col("url_pattern")).alias("p"), F.col("repo_id").alias("src_repo")).filter("p <> ''")
    regex = F.when(F.coalesce("path_regex", F.lit("")) == "", text.path_regex(F.col("path"))).otherwise(
        F.regexp_replace(F.when(F.col("path_regex").startswith("^"), F.col("path_regex")).otherwise(F.concat(F.lit("^"), F.regexp_replace("path_regex", r"([{}])", r"\\$1"))), r"\(\?P<[A-Za-z0-9_]+>", "("))
    eseg = text.first_segment(F.col("path"))
    ends = g.endpoint.select(F.col("id").alias("dst"), verb.alias("ev"), regex.alias("regex"), eseg.isNotNull().alias("literal"), F.coalesce(eseg, F.lit("")).alias("eseg"), F.col("repo_id").alias("dst_repo"))
    urls = calls.select("p", "v").distinct().withColumn("seg", F.split_part(F.regexp_replace("p", "^/", ""), F.lit("/"), F.lit(1)))
    pats = ends.select("regex", "ev", "literal", "eseg").distinct()
    fits = F.rlike(F.col("p"), F.col("regex")) & ((F.col("v") == "") | (F.col("ev") == "") | (F.col("v") == F.col("ev")))
    literal = urls.join(pats.filter("literal"), (F.col("seg") == F.col("eseg")) & fits)
    # patterns that begin with a variable: the request's verb, or the empty verb on either side
    keyed = pats.filter("not literal").withColumn("k", F.explode(F.array_distinct(F.array(F.col("ev"), F.lit("*")))))
    named = urls.withColumn("k", F.explode(F.when(F.col("v") == "", F.array(F.lit("*"))).otherwise(F.array("v", F.lit(""))))).join(keyed, "k").filter(fits)
    url, pat = ["p", "v"], ["regex", "ev", "literal", "eseg"]
    hits = materialize(union_all([x.select(*url, *pat) for x in (literal, named)]).distinct(), "hits")
    requests = calls.join(hits.select(*url).distinct(), url, "left_semi").groupBy("src", "call_id", "src_repo").agg(F.array_sort(F.collect_set(F.struct(*url))).alias("rs"))
    endpoints = ends.join(hits.select(*pat).distinct(), pat, "left_semi").groupBy("dst", "dst_repo").agg(F.array_sort(F.collect_set(F.struct(*pat))).alias("es"))
    pairs = requests.select("rs").distinct().select("rs", F.inline("rs")).join(hits, url)
    pairs = pairs.join(endpoints.select("es").distinct().select("es", F.inline("es")), pat).select("rs", "es").distinct()
    return requests, endpoints, pairs


def cross_repo_matches(g: CodeGraph) -> DataFrame:
    """(src, dst, call_id, src_repo, dst_repo): every endpoint that an outbound request can mean, see _matches. No two rows are
    equal, as each request, each endpoint and each pair of their sets comes once."""
    return _expand(*_matches(g))


def _expand(requests: DataFrame, endpoints: DataFrame, pairs: DataFrame) -> DataFrame:
    return requests.join(pairs, "rs").join(endpoints, "es").select("src", "dst", "call_id", "src_repo", "dst_repo")


def resolve_cross_repo(g: CodeGraph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls_rest, depends_on, counts): one call edge for each matched pair of request and endpoint, distinct
    dependencies between repositories, and the numbers of matched and unresolved requests. Running it again changes nothing.

    Dependencies and counts come from the distinct urls and patterns, not from the pairs of requests and endpoints."""
    requests, endpoints, pairs = _matches(g)
    depends = requests.select("src_repo", "rs").distinct().join(pairs, "rs").select("src_repo", "es").distinct()
    depends = depends.join(endpoints.select("dst_repo", "es").distinct(), "es").filter("src_repo <> dst_repo").select(F.col("src_repo").alias("src"), F.col("dst_repo").alias("dst")).distinct()
    # each url in a request's set fits a pattern
    hit = requests.select("call_id").distinct().withColumn("hit", F.lit(1))
    counts = g.rest_call.select(F.col("id").alias("call_id")).join(hit, "call_id", "left").agg(F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unresolved"))
    return _expand(requests, endpoints, pairs).select("src", "dst"), depends, counts


def dedupe_by_fqn(df: DataFrame, order: tuple[str, ...] = ("file_path", "line_start", "id")) -> DataFrame:
    """The first row of each fqn; ties go by `order`, where its columns exist."""
    by = ", ".join(c for c in order if c in df.columns)
    return df.selectExpr("*", f"row_number() over (partition by fqn order by {by}) as _n").filter("_n = 1").drop("_n")


def resolve_parents(declared: DataFrame, imports: DataFrame, classes: DataFrame) -> DataFrame:
    """(child_fqn, parent_fqn, kind) for declared parents (child_fqn, package, file_id, parent, kind).

    A simple name means what the file imports under it, else the class of the same
    package. A qualified name stays.
    """
    by_import = imports.select("file_id", F.col("simple").alias("parent"), F.col("fqn").alias("imported"))
    here = F.when(F.coalesce("package", F.lit("")) == "", F.col("parent")).otherwise(F.concat_ws(".", "package", "parent"))
    full = F.when(F.contains("parent", F.lit(".")), F.col("parent")).otherwise(F.coalesce("imported", here))
    return declared.join(by_import, ["file_id", "parent"], "left").select("child_fqn", full.alias("parent_fqn"), "kind")


def external_stubs(g: CodeGraph, parents: DataFrame) -> tuple[CodeGraph, DataFrame]:
    """(graph, edges): classes for parent_fqns that no class has, in the external repository, and the
    (src, dst, kind) edges of (child_fqn, parent_fqn, kind)."""
    known = g["class"].select("fqn").distinct()
    missing = parents.select(F.col("parent_fqn").alias("fqn")).distinct().join(known, "fqn", "left_anti")
    stubs = missing.select(F.md5(F.concat(F.lit(schema.EXTERNAL_REPO + ":"), "fqn")).alias("id"), F.substring_index("fqn", ".", -1).alias("name"), "fqn", F.lit("").alias("file_id"), F.lit(schema.EXTERNAL_REPO).alias("repo_id"))
    out = g.union(**{"class": stubs})
    ids = out["class"].groupBy("fqn").agg(F.min("id").alias("id"))
    a, b = ids.alias("a"), ids.alias("b")
    edges = parents.join(a, F.col("child_fqn") == F.col("a.fqn")).join(b, F.col("parent_fqn") == F.col("b.fqn"))
    return out, edges.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), "kind").distinct()


def _fresh(g: CodeGraph, edges: DataFrame, arg_pos: int = -1) -> DataFrame:
    """New call edges (src, dst, callee_name): distinct pairs that no call has."""
    new = edges.groupBy("src", "dst").agg(F.min("callee_name").alias("callee_name")).join(g.calls.select("src", "dst"), ["src", "dst"], "left_anti")
    pos = F.lit(arg_pos).cast("long")
    return new.select("src", "dst", "callee_name", pos.alias("caller_arg_pos"), pos.alias("callee_param_pos"))


def virtual_dispatch(g: CodeGraph) -> DataFrame:
    """Call edges to overrides: a call of a parent's method also calls the same-named method of direct children.

    One level; of several same-named methods in a child the last by (line, id) is taken.
    """
    kin = g.extends.unionByName(g.implements).select(F.col("src").alias("child"), F.col("dst").alias("class_id")).distinct()
    m = g.method.select("id", "name", "class_id")
    parent = m.select(F.col("id").alias("dst"), "name", "class_id")
    own = g.method.groupBy(F.col("class_id").alias("child"), "name").agg(F.max_by("id", F.struct("line_start", "id")).alias("override"))
    met = g.calls.select("src", "dst").join(parent, "dst").join(kin, "class_id").join(own, ["child", "name"])
    return _fresh(g, met.select("src", F.col("override").alias("dst"), F.col("name").alias("callee_name")))


def bean_validation(g: CodeGraph, arg_pos: int = -1) -> DataFrame:
    """Call edges from constructors, and from their callers, to the class's @AssertTrue/@AssertFalse methods."""
    checks = g.method.filter(F.arrays_overlap("annotations", F.array(F.lit("AssertTrue"), F.lit("AssertFalse")))).select(F.col("id").alias("dst"), F.col("name").alias("callee_name"), "class_id")
    made = g.method.filter(F.col("name") == "<init>").select(F.col("id").alias("init"), "class_id")
    pairs = made.join(checks, "class_id")
    callers = g.calls.select("src", F.col("dst").alias("init")).join(pairs, "init").select("src", "dst", "callee_name")
    return _fresh(g, callers.unionByName(pairs.select(F.col("init").alias("src"), "dst", "callee_name")), arg_pos)


def request_filters(g: CodeGraph, arg_pos: int = -1) -> DataFrame:
    """Call edges from every endpoint handler of a repository to its filters' methods."""
    bases = g["class"].filter(F.col("fqn").isin(list(FILTER_BASE_FQNS)) | F.col("name").isin(list(FILTER_BASES))).select(F.col("id").alias("dst"))
    faces = g["class"].filter(F.col("fqn").isin(list(FILTER_INTERFACES))).select(F.col("id").alias("dst"))
    kin = g.extends.join(bases, "dst").select("src").unionByName(g.implements.join(faces, "dst").select("src")).distinct()
    runs = g.method.filter(F.col("name").isin(list(FILTER_METHODS))).join(kin, F.col("class_id") == F.col("src")).select(F.col("id").alias("dst"), F.col("name").alias("callee_name"), "repo_id")
    handlers = g.endpoint.filter("handler_method_id <> ''").select(F.col("handler_method_id").alias("src"), "repo_id").distinct()
    return _fresh(g, handlers.join(runs, "repo_id").filter("src <> dst").select("src", "dst", "callee_name"), arg_pos)


def application_events(g: CodeGraph, arg_pos: int = -1) -> DataFrame:
    """Call edges from methods that publish events to the @EventListener methods of their repository."""
    hears = F.coalesce(F.array_contains("annotations", "EventListener"), F.lit(False))
    publishes = F.coalesce(F.col("name") == "publishEvent", F.lit(False))
    ends = g.method.filter(hears | publishes).groupBy(F.col("id").alias("dst")).agg(F.bool_or(publishes).alias("publishes"), F.bool_or(hears).alias("hears"))
    # the calls are gone through once, for those that publish and those that listeners have already
    near = materialize_alone(g.calls.select("src", "dst").join(ends, "dst"), "near")
    stubs = g.rest_call.filter(F.substring_index("callee_name", ".", -1) == "publishEvent").select(F.col("id").alias("dst"))
    by_stub = g.unresolved_call.join(stubs, "dst", "left_semi").select("src")
    # every publisher once with the set of its repositories, every listener once with its (repository, name) pairs: no pair of
    # theirs comes twice, so that none is shuffled to be made distinct or to be held against the calls that exist
    who = near.filter("publishes").select("src").unionByName(by_stub).distinct().join(g.method.select(F.col("id").alias("src"), "repo_id"), "src").groupBy("src").agg(F.array_sort(F.collect_set("repo_id")).alias("repos"))
    who = materialize_alone(who.join(near.filter("hears").groupBy("src").agg(F.collect_set("dst").alias("had")), "src", "left"), "publishers")
    listeners = g.method.filter(hears)
    heard = listeners.groupBy(F.col("id").alias("dst")).agg(F.array_sort(F.collect_set(F.struct("repo_id", "name"))).alias("at"))
    met = who.select("repos").distinct().select("repos", F.explode("repos").alias("repo_id"))
    met = met.join(heard.select("at").distinct().select("at", F.inline("at")), "repo_id").groupBy("repos", "at").agg(F.min("name").alias("callee_name"))
    # publishers come in blocks, and a listener with a whole block: a column of the result then holds one value for long, or the
    # same run of values again and again, which Parquet stores in little
    blocks = max(1, who.count() // PUBLISHERS_AT_ONCE)
    block = F.pmod(F.xxhash64("src"), F.lit(blocks))
    block = who.groupBy("repos", block.alias("_b")).agg(F.collect_list(F.struct("src", "had")).alias("who"))
    block = block.repartition(max(4 * g.spark.sparkContext.defaultParallelism, blocks // 16)).drop("_b")
    # the pairs are far more than the listeners: a result that can be written leaves few enough of them to be sent whole
    pairs = block.join(F.broadcast(heard.join(met, "at").select("repos", "dst", "callee_name")), "repos")
    pairs = pairs.select("dst", "callee_name", F.inline("who"))
    pos = F.lit(arg_pos).cast("long")
    fresh = pairs.filter((F.col("src") != F.col("dst")) & ~F.coalesce(F.array_contains("had", F.col("dst")), F.lit(False)))
    return fresh.select("src", "dst", "callee_name", pos.alias("caller_arg_pos"), pos.alias("callee_param_pos"))


def pointcut_annotation(window: Column, language: Column) -> Column:
    """The annotation an advice's @annotation(x) means: the type of parameter x in the text around it, or the
    last segment of a qualified name."""
    var = F.regexp_extract(window, r"@annotation\(\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\)", 1)
    quoted = F.concat(F.lit(r"\Q"), var, F.lit(r"\E"))
    kotlin = F.call_function("regexp_extract", window, F.concat(F.lit(r"\b"), quoted, F.lit(r"\s*:\s*(?:[A-Za-z0-9_.]+\.)?([A-Za-z][A-Za-z0-9_]+)")), F.lit(1))
    java = F.call_function("regexp_extract", window, F.concat(F.lit(r"(?:^|[\s,(<])(?:[A-Za-z0-9_.]+\.)?([A-Za-z][A-Za-z0-9_]+)\s+"), quoted, F.lit(r"\b")), F.lit(1))
    typed = F.when(language == "kotlin", kotlin).otherwise(java)
    return F.when(F.contains(var, F.lit(".")), F.substring_index(var, ".", -1)).when(var != "", F.nullif(typed, F.lit("")))


def aop_advice(g: CodeGraph, sources: DataFrame, arg_pos: int = -1, before: int = 6, after: int = 40) -> DataFrame:
    """Call edges from methods with an annotation to the advice that names it. sources: (path, content) of the
    files; the text from `before` lines above an advice method to `after` below is searched."""
    advice = g.method.filter(F.arrays_overlap("annotations", F.array(*[F.lit(a) for a in ADVICE]))).select(F.col("id").alias("dst"), F.col("name").alias("callee_name"), "file_id", "line_start", "repo_id")
    files = g.file.select(F.col("id").alias("file_id"), "path", "language").join(sources.select("path", F.col("content").cast("string").alias("content")), "path")
    start = F.greatest(F.col("line_start") - before, F.lit(0).cast("long")).cast("int")
    window = F.array_join(F.slice(F.split("content", "\n"), start + 1, (F.col("line_start") + after).cast("int") - start), "\n")
    named = advice.join(files, "file_id").withColumn("target", pointcut_annotation(window, F.col("language"))).filter("target is not null")
    marked = g.method.select(F.col("id").alias("src"), "repo_id", F.explode("annotations").alias("target"))
    return _fresh(g, marked.join(named, ["repo_id", "target"]).filter("src <> dst").select("src", "dst", "callee_name"), arg_pos)


def validator_entry_points(g: CodeGraph) -> DataFrame:
    """The method table with isValid of ConstraintValidator classes marked as entry points."""
    faces = g["class"].filter(F.contains("fqn", F.lit("ConstraintValidator"))).select(F.col("id").alias("dst"))
    kin = g.implements.join(faces, "dst").select(F.col("src").alias("class_id")).distinct().withColumn("_v", F.lit(True))
    m = g.method.join(kin, "class_id", "left")
    on = F.coalesce("is_entry_point", F.lit(False)) | (F.coalesce("_v", F.lit(False)) & (F.col("name") == "isValid"))
    return m.withColumn("is_entry_point", on).select(g.method.columns)


def framework_edges(g: CodeGraph, sources: DataFrame | None = None, synthetic: bool = False) -> DataFrame:
    """The call edges of all passes, each pair once. synthetic: marks them with the argument position that
    callee queries leave out by default."""
    pos = schema.SYNTHETIC_ARG_POS if synthetic else -1
    parts = [bean_validation(g, pos), request_filters(g, pos), application_events(g, pos)]
    if sources is not None:
        parts.append(aop_advice(g, sources, pos))
    return union_all(parts).groupBy("src", "dst").agg(*[F.min(c).alias(c) for c in ("callee_name", "caller_arg_pos", "callee_param_pos")])


def incremental_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path, repo_id, branch_name, change (added, changed, removed or unchanged) of files (path, repo_id, branch_name, blob_hash)."""
    keys = ["repo_id", "branch_name", "path"]
    a = stored.select(*keys, F.col("blob_hash").alias("old"), F.lit(True).alias("was"))
    b = current.select(*keys, F.col("blob_hash").alias("new"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full").select("path", "repo_id", "branch_name", change.alias("change"))


def delete_files(g: CodeGraph, files: DataFrame) -> CodeGraph:
    """The graph without the files (id) and all that hangs on them: classes, methods, endpoints, requests,
    relations, and every edge that has lost an end."""
    gone = files.select("id").distinct()
    of_file = lambda df: df.join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_anti").select(df.columns)
    t = dict(g.tables)
    t["file"] = g.file.join(gone, "id", "left_anti")
    t["class"], t["method"] = of_file(g["class"]), of_file(g.method)
    lost_m = g.method.join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_semi").select("id")
    lost_c = g["class"].join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_semi").select("id")
    t["endpoint"] = g.endpoint.join(lost_m.withColumnRenamed("id", "handler_method_id"), "handler_method_id", "left_anti").select(g.endpoint.columns)
    t["rest_call"] = g.rest_call.join(lost_m.withColumnRenamed("id", "caller_method_id"), "caller_method_id", "left_anti").select(g.rest_call.columns)
    t["entity_relation"] = g.entity_relation.join(lost_c.withColumnRenamed("id", "source_class_id"), "source_class_id", "left_anti").select(g.entity_relation.columns)
    return prune_edges(CodeGraph(g.spark, t))


def delete_repo(g: CodeGraph, repo: str) -> CodeGraph:
    """The graph without a repository: its nodes and all edges into, out of and between them."""
    ids = F.broadcast(g.repos(repo).select("repo_id"))
    t = {n: (df.join(ids, "repo_id", "left_anti").select(df.columns) if "repo_id" in df.columns else df) for n, df in g.tables.items()}
    t["repo"] = g.repo.filter(F.col("name") != repo)
    return prune_edges(CodeGraph(g.spark, t))


# The node tables at the ends of each edge table.
ENDS = {"calls": ("method", "method"), "calls_rest": ("method", "endpoint"), "unresolved_call": ("method", "rest_call"), "contains_class": ("file", "class"), "contains_method": ("class", "method"),
        "exposes": ("repo", "endpoint"), "depends_on": ("repo", "repo"), "has_branch": ("repo", "branch"), "extends": ("class", "class"), "implements": ("class", "class"),
        "has_relation": ("class", "entity_relation"), "observed_at": ("method", "perf_sample")}


def prune_edges(g: CodeGraph) -> CodeGraph:
    """The graph without edges that lack an end."""
    out = {}
    for e, (a, b) in ENDS.items():
        df = g[e].join(g[a].select(F.col("id").alias("src")), "src", "left_semi").join(g[b].select(F.col("id").alias("dst")), "dst", "left_semi")
        out[e] = df.select(g[e].columns)
    return g.with_tables(**out)


def merge_rows(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Upsert: new rows replace old ones of the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(old.columns).unionByName(new.select(old.columns))


def ancestors(parents: DataFrame, max_depth: int = 5) -> DataFrame:
    """(start, class_fqn, up): the classes above each class of parents (child_fqn, parent_fqn), with the least number of steps."""
    step = parents.select(F.col("child_fqn").alias("start"), F.col("parent_fqn").alias("class_fqn")).filter("start <> class_fqn").distinct()
    level = step.withColumn("up", F.lit(1))
    met = [level]
    for up in range(2, max_depth + 1):
        above = step.select(F.col("start").alias("class_fqn"), F.col("class_fqn").alias("next"))
        level = level.join(above, "class_fqn").select("start", F.col("next").alias("class_fqn")).distinct().withColumn("up", F.lit(up))
        met.append(level)
    # on a cycle a class is not above itself
    return union_all(met).filter("start <> class_fqn").groupBy("start", "class_fqn").agg(F.min("up").alias("up"))


def _best_two(found: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and a struct `name` of the first two methods (one, two) of each key by (up, file_path, line_start, dst); two is one where there is no other."""
    order = F.struct("up", "file_path", "line_start", "dst")
    each = found.groupBy(*keys, "dst").agg(F.min(order).alias("b"))
    top = each.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("b"))).filter("i <= 2")
    return top.groupBy(*keys).agg(F.struct(F.min("b").alias("one"), F.max("b").alias("two")).alias(name))


def resolve_calls(sites: DataFrame, methods: DataFrame, imports: DataFrame, fields: DataFrame, impls: DataFrame,
                  parents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls, stubs) for call sites.

    sites: site_id, caller_id, caller_class (fqn), package, file_id, receiver (''
    for none), callee, argc. methods: id, name, class_fqn, class_name, file_id,
    file_path, line_start, is_static. imports: file_id, simple, fqn. fields:
    class_fqn, field, type (simple name). impls: interface_name, class_fqn.
    parents: child_fqn, parent_fqn (extends and implements).

    Candidates carry a precedence: the receiver as a type, the receiver's declared
    type, the caller's own class, an imported class, a class of the same package,
    an implementation of the declared interface, any class. A type or the own
    class stands for the classes above it too, the nearest that has the method
    first; `super` means these alone. The best of each site wins, ties by
    (file_path, line_start, id); the caller itself is never one. What has none
    becomes a stub (src, callee_name).
    """
    # A precedence fixes the rank of all that a key finds: the best two methods of each (key, callee) are enough, as
    # only the caller itself can be ruled out. Sites look these up; no pair of a site and a method of its name is formed.
    s = sites.withColumn("recv", F.substring_index("receiver", ".", -1)).withColumn("pkg", F.coalesce("package", F.lit("")))
    typed = fields.select(F.col("class_fqn").alias("caller_class"), F.col("field").alias("recv"), F.col("type").alias("declared"))
    s = s.join(typed, ["caller_class", "recv"], "left").withColumn("type_name", F.coalesce("declared", "recv"))
    m = methods.select(F.col("id").alias("dst"), F.col("name").alias("callee"), "class_fqn", "class_name", "file_path", "line_start", F.lit(0).alias("up"))
    simple = F.concat(F.lit("."), "class_name")
    package = (F.when(F.col("class_name").isNull(), F.col("class_fqn")).when(F.col("class_fqn") == F.col("class_name"), "")
               .when(F.endswith("class_fqn", simple), F.expr("left(class_fqn, length(class_fqn) - length(class_name) - 1)")))
    has, free, here = F.col("recv") != "", F.col("declared").isNull() & (F.col("recv") != "super"), F.col("recv").isin("", "this")
    typing = F.when(F.col("declared").isNull(), 0).otherwise(1)
    imp = imports.select("file_id", F.col("fqn").alias("class_fqn")).distinct()
    di = impls.select(F.col("interface_name").alias("declared"), "class_fqn").distinct()
    # (key of the site, when it counts, precedence, methods by that key)
    by_name = m.withColumn("named", F.col("class_name"))
    routes = [
        ("recv", has & (F.col("recv") != "super"), typing, by_name.withColumnRenamed("named", "recv")),
        ("declared", has & (F.col("recv") != "super"), F.lit(1), by_name.withColumnRenamed("named", "declared")),
        ("caller_class", here, F.lit(2), m.withColumn("caller_class", F.col("class_fqn"))),
        ("declared", F.col("recv") != "super", F.lit(3), m.join(di, "class_fqn")),
        ("file_id", free, F.lit(4), m.join(imp, "class_fqn")),
        ("pkg", free, F.lit(5), m.withColumn("pkg", package)),
        ("caller_class", free, F.lit(6), m.withColumn("caller_class", F.col("class_fqn"))),
        (None, free, F.lit(7), m)]
    if parents is not None:
        above = ancestors(parents)
        own_up = above.select(F.col("start").alias("caller_class"), "class_fqn", "up")
        type_up = above.groupBy(F.substring_index("start", ".", -1).alias("type_name"), "class_fqn").agg(F.min("up").alias("up"))
        routes.append(("type_name", has & (F.col("recv") != "super"), typing, m.drop("up").join(type_up, "class_fqn")))
        routes.append(("caller_class", here | (F.col("recv") == "super"), F.lit(2), m.drop("up").join(own_up, "class_fqn")))
    ranked = []
    for i, (key, when, prio, found) in enumerate(routes):
        keys = [key, "callee"] if key else ["callee"]
        s = s.join(_best_two(found, keys, f"r{i}"), keys, "left")
        one, two = F.col(f"r{i}.one"), F.col(f"r{i}.two")
        pick = F.when(one["dst"] != F.col("caller_id"), one).when(two["dst"] != F.col("caller_id"), two)
        ranked.append(F.when(when & pick.isNotNull(), F.struct(prio.alias("prio"), *[pick[c].alias(c) for c in ("up", "file_path", "line_start", "dst")])))
    best = s.select("site_id", F.col("caller_id").alias("src"), F.col("callee").alias("callee_name"), "argc", F.least(*ranked).alias("b")).filter("b is not null")
    best = best.groupBy("site_id", "src", "callee_name", "argc").agg(F.min("b").alias("b")).select("site_id", "src", "callee_name", "argc", F.col("b.dst").alias("dst"))
    pos = F.when(F.col("argc") > 0, 0).otherwise(-1).cast("long")
    calls = best.select("site_id", "src", "dst", "callee_name", pos.alias("caller_arg_pos"), pos.alias("callee_param_pos"))
    full = F.when(F.col("receiver") != "", F.concat_ws(".", "receiver", "callee")).otherwise(F.col("callee"))
    stubs = sites.join(best.select("site_id"), "site_id", "left_anti").select("site_id", F.col("caller_id").alias("src"), full.alias("callee_name"))
    return calls, stubs
