"""Taint and security queries. Without a repository every repository is answered for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import patterns
from skein.functions.patterns import SecurityConfig
from skein.graph import CodeGraph
from skein.plans import traverse
from skein.storage import materialize, numbered, sent

# Method names that write to and read from a store.
WRITE_NAMES = ("save", "saveAll", "persist", "merge", "insert", "saveAndFlush", "store")
READ_NAMES = ("findById", "findAll", "findOne", "getById", "getOne", "findAllById", "executeQuery", "createQuery", "query", "load", "get")


def _callees(g: CodeGraph) -> DataFrame:
    return g.method.select(F.col("id").alias("dst"), F.col("fqn").alias("callee_fqn"), F.col("name").alias("callee"))


def _sink_calls(g: CodeGraph, repo: str | None, cfg: SecurityConfig) -> DataFrame:
    """Calls of sinks: the unresolved ones by name (custom), the resolved ones by fqn or name (configured)."""
    m = g.methods_of(repo).select(F.col("id").alias("src"), F.col("fqn").alias("caller_fqn"), "repo_id", "repo_name", "file_path", "line_start")
    stubs = g.rest_call.filter(cfg.is_sink(F.col("callee_name"))).select(F.col("id").alias("dst"), F.col("callee_name").alias("sink_method"))
    minus = F.lit(-1).cast("long")
    custom = g.unresolved_call.select("src", "dst").join(stubs, "dst").join(m, "src").select(
        "repo_name", "repo_id", F.col("src").alias("caller_id"), "caller_fqn", "sink_method", "file_path", "line_start",
        F.lit("custom").alias("sink_category"), minus.alias("caller_arg_pos"), minus.alias("callee_param_pos"))
    sinks = _callees(g).filter(cfg.is_sink(F.col("callee_fqn")) | cfg.is_sink(F.col("callee")))
    found = g.calls.drop("callee_name").join(sinks, "dst").join(m, "src").select(
        "repo_name", "repo_id", F.col("src").alias("caller_id"), "caller_fqn", F.col("callee_fqn").alias("sink_method"), "file_path", "line_start",
        F.lit("configured").alias("sink_category"), "caller_arg_pos", "callee_param_pos")
    return custom.unionByName(found)


def find_taint_sinks(g: CodeGraph, repo: str | None = None, cfg: SecurityConfig = SecurityConfig()) -> DataFrame:
    """repo_name, caller_fqn, sink_method, file_path, line_start, sink_category, caller_arg_pos, callee_param_pos; one row per call."""
    return _sink_calls(g, repo, cfg).drop("repo_id", "caller_id")


def _sources(g: CodeGraph, repo: str | None, cfg: SecurityConfig, with_callees: bool = True) -> DataFrame:
    """id of methods that a request feeds: by annotation, or by calling a source method."""
    m = g.methods_of(repo)
    own = m.filter(cfg.has_source_annotation(F.col("annotations"))).select("id")
    src = _callees(g).filter(cfg.is_source_method(F.col("callee_fqn")) | cfg.is_source_method(F.col("callee")))
    by_call = g.calls.join(src, "dst", "left_semi").select(F.col("src").alias("id")).join(m.select("id"), "id", "left_semi")
    return own.unionByName(by_call).distinct() if with_callees else own


def find_taint_flows(g: CodeGraph, repo: str | None = None, cfg: SecurityConfig = SecurityConfig()) -> DataFrame:
    """repo_name, source_method_fqn, sink_method_name, caller_arg_pos, callee_param_pos, file_path,
    line_start, owasp_category: one call from a source to a sink with the first argument passed on."""
    m = g.methods_of(repo).join(_sources(g, repo, cfg), "id", "left_semi").select(F.col("id").alias("src"), F.col("fqn").alias("source_method_fqn"), "repo_name", "file_path", "line_start")
    sinks = _callees(g).filter(cfg.is_sink(F.col("callee_fqn")) | cfg.is_sink(F.col("callee")))
    out = g.calls.drop("callee_name").filter("caller_arg_pos = 0").join(m, "src").join(sinks, "dst")
    return out.select("repo_name", "source_method_fqn", F.col("callee_fqn").alias("sink_method_name"), "caller_arg_pos",
                      F.coalesce("callee_param_pos", F.lit(0).cast("long")).alias("callee_param_pos"), "file_path", "line_start",
                      patterns.lookup(patterns.OWASP, patterns.short_name(F.col("callee")), patterns.OWASP_OTHER).alias("owasp_category"))


def _in_repo_calls(g: CodeGraph, repo: str | None) -> DataFrame:
    """Calls whose caller is in a repository; (src, dst, callee_name, repo_id)."""
    ids = g.method.join(F.broadcast(g.repos(repo)), "repo_id").select(F.col("id").alias("src"), "repo_id")
    return g.calls.select("src", "dst", "callee_name").join(ids, "src")


def find_taint_paths(g: CodeGraph, repo: str | None = None, max_depth: int = 5, cfg: SecurityConfig = SecurityConfig()) -> DataFrame:
    """repo_name, source_method_fqn, source_annotations, sink_method_fqn, sink_type, path_length,
    call_chain, sanitizer_pruned (false), file_path, line_start.

    Every path without a repeated method of at most max_depth (10 at most) calls
    from a source to a sink of the same repository. A sanitizer ends a branch, a
    sink does not. Each chain once; where two sources share an fqn, the one with
    the least (path, line) speaks for it.
    """
    methods = g.method.join(F.broadcast(g.repos(repo)), "repo_id")
    known = methods.select(F.col("id").alias("dst"), F.col("fqn").alias("callee_fqn"), F.col("repo_id").alias("callee_repo"))
    edges = _in_repo_calls(g, repo).join(known, "dst", "left")
    same = F.col("callee_repo") == F.col("repo_id")
    edges = edges.withColumn("label", F.when(same, F.col("callee_fqn")).otherwise(F.col("dst")))
    edges = edges.filter(~(F.coalesce(same, F.lit(False)) & cfg.is_sanitizer(F.col("callee_fqn"))))
    # a callee of another repository has no name here and is passed by its id, but is no sink; its own calls are not followed
    edges = edges.filter(F.coalesce(same, F.lit(False))).select("src", "dst", "label")
    targets = methods.filter(cfg.is_sink(F.col("fqn"))).select(F.col("id").alias("node"))

    located = g.methods_of(repo)
    marked = located.filter(cfg.has_source_annotation(F.col("annotations"))).select(
        "id", "fqn", cfg.source_annotations_in(F.col("annotations")).alias("source_annotations"), "file_path", F.coalesce("line_start", F.lit(0).cast("long")).alias("line_start"))
    named = methods.select(F.col("id").alias("dst"), F.col("fqn").alias("to_fqn"), F.col("repo_id").alias("to_repo"))
    calling = _in_repo_calls(g, repo).join(named, "dst", "left")
    # a callee's fqn counts inside its repository, the name at the call anywhere
    calls_source = (F.col("to_repo") == F.col("repo_id")) & cfg.is_source_method(F.col("to_fqn")) | cfg.is_source_method(F.col("callee_name"))
    callers = calling.filter(calls_source).select(F.col("src").alias("id")).distinct()
    callers = callers.join(marked, "id", "left_anti").join(methods.select("id", "fqn"), "id")
    callers = callers.select("id", "fqn", F.array().cast("array<string>").alias("source_annotations"), F.lit("").alias("file_path"), F.lit(0).cast("long").alias("line_start"))
    sources = materialize(marked.unionByName(callers), "sources")

    paths = traverse.simple_paths(edges, sources.select(F.col("id").alias("node"), F.col("fqn").alias("label")), targets, min(max_depth, 10))
    out = paths.join(sources.withColumnRenamed("id", "start"), "start").join(methods.select(F.col("id").alias("start"), "repo_name"), "start")
    source = F.struct("file_path", "line_start", "source_annotations")
    # chains can only be equal where methods of a repository share an fqn; else they need no shuffle
    if methods.groupBy("repo_name", "fqn").count().filter("count > 1").isEmpty():
        out = out.withColumn("s", source)
    else:
        out = out.groupBy("repo_name", "chain").agg(F.min(source).alias("s"))
    sink = F.element_at("chain", -1)
    return out.select(
        "repo_name", F.col("chain")[0].alias("source_method_fqn"), F.col("s.source_annotations").alias("source_annotations"), sink.alias("sink_method_fqn"),
        patterns.lookup(patterns.OWASP, patterns.short_name(sink), patterns.OWASP_OTHER).alias("sink_type"), (F.size("chain") - 1).alias("path_length"),
        F.col("chain").alias("call_chain"), F.lit(False).alias("sanitizer_pruned"), F.col("s.file_path").alias("file_path"), F.col("s.line_start").alias("line_start"))


def _requests(g: CodeGraph) -> DataFrame:
    """(src, url, verb): the outbound urls of methods, a row for each request."""
    out_rest = g.unresolved_call.select("src", "dst").join(g.rest_call.select(F.col("id").alias("dst"), F.col("url_pattern").alias("url"), F.col("http_method").alias("verb")), "dst").select("src", "url", "verb")
    out_ends = g.calls_rest.join(g.endpoint.select(F.col("id").alias("dst"), F.col("path").alias("url"), F.col("http_method").alias("verb")), "dst").select("src", "url", "verb")
    return out_rest.unionByName(out_ends)


def find_cross_service_taint(g: CodeGraph, repo: str | None = None, max_depth: int = 6, with_chain: bool = True) -> DataFrame:
    """repo_name, source_handler_fqn, source_endpoint, sink_method_fqn, sink_url_pattern, sink_http_method,
    path_length, call_chain (array of fqn, callee_name; not there without with_chain, and then no round carries it).

    Shortest call path from each endpoint handler to each other method that sends
    a request; one row per outbound url. A handler of several endpoints reports
    the least (verb, path); among equally short paths the least chain is taken.
    """
    methods = g.method.join(F.broadcast(g.repos(repo)), "repo_id").select("id", "fqn", "repo_id", "repo_name")
    ends = g.exposes.select(F.col("src").alias("repo_id"), F.col("dst").alias("e")).join(g.endpoint.select(F.col("id").alias("e"), "http_method", "path", F.col("handler_method_id").alias("id")), "e")
    handlers = ends.join(methods, ["repo_id", "id"]).groupBy("id", "fqn", "repo_name").agg(F.min(F.struct("http_method", "path")).alias("ep"))
    # in-repository calls, the least name for each pair of methods
    calls = _in_repo_calls(g, repo).join(methods.select(F.col("id").alias("dst"), F.col("repo_id").alias("r"), "fqn"), "dst").filter("r = repo_id")
    if not with_chain:
        return _cross_service_lengths(methods, handlers, calls, _requests(g), max_depth)
    calls = materialize(calls.groupBy("src", "dst", "fqn").agg(F.min(F.coalesce("callee_name", F.lit(""))).alias("callee_name")), "edges")
    sinks = _requests(g)
    hop = F.struct(F.col("fqn"), F.lit("").alias("callee_name"))
    frontier = materialize(handlers.select("id", F.col("id").alias("node"), F.array(hop).alias("chain")), "taint")
    seen, met = frontier.select("id", "node"), []
    for _ in range(max_depth):
        step = frontier.join(calls, F.col("node") == F.col("src")).select("id", F.col("dst").alias("node"), F.concat("chain", F.array(F.struct("fqn", "callee_name"))).alias("chain"))
        step = step.join(seen, ["id", "node"], "left_anti").groupBy("id", "node").agg(F.min("chain").alias("chain"))
        frontier = materialize(step, "taint")
        if frontier.isEmpty():
            break
        met.append(frontier)
        seen = seen.unionByName(frontier.select("id", "node"))
    reached = frontier.limit(0)
    for x in met:
        reached = reached.unionByName(x)
    out = reached.join(sinks, F.col("node") == F.col("src")).join(handlers, "id")
    return out.select("repo_name", F.col("fqn").alias("source_handler_fqn"), F.concat_ws(" ", "ep.http_method", "ep.path").alias("source_endpoint"),
                      F.element_at("chain", -1)["fqn"].alias("sink_method_fqn"), F.col("url").alias("sink_url_pattern"), F.col("verb").alias("sink_http_method"),
                      (F.size("chain") - 1).alias("path_length"), F.col("chain").alias("call_chain"))


def _cross_service_lengths(methods: DataFrame, handlers: DataFrame, calls: DataFrame, sinks: DataFrame, max_depth: int) -> DataFrame:
    """find_cross_service_taint without chains: a search over numbers, whose pairs meet names and requests that are sent."""
    ids = numbered(methods.groupBy("id").agg(F.min("fqn").alias("sink_method_fqn")), "methods", "n")
    number = lambda c, n: ids.select(F.col("id").alias(c), F.col("n").alias(n))
    edges = calls.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(number("a", "src"), "a").join(number("b", "dst"), "b")
    named = handlers.withColumnRenamed("id", "h").join(number("h", "seed"), "h").select(
        "seed", "repo_name", F.col("fqn").alias("source_handler_fqn"), F.concat_ws(" ", "ep.http_method", "ep.path").alias("source_endpoint"))
    named = materialize(named, "handlers")
    met = traverse.reach(edges, named.select("seed", F.col("seed").alias("node")), named, max_depth, True)
    # equal requests of a method as one with their count; the methods of equal requests share a set
    ends = sinks.groupBy(F.col("src").alias("id"), "url", "verb").agg(F.count("*").cast("int").alias("times")).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("url", "verb", "times"))).alias("ends"))
    ends = materialize(ends.join(ids, "id").select(F.col("n").alias("node"), "sink_method_fqn", "ends"), "ends")
    sets = materialize(numbered(ends.select("ends").distinct(), "sets", "set"), "sets")
    senders = materialize(ends.join(sets, "ends").select("node", "sink_method_fqn", "set"), "senders")
    out = met.select("repo_name", "source_handler_fqn", "source_endpoint", F.col("depth").alias("path_length"), F.explode("nodes").alias("node"))
    out = out.join(sent(senders), "node").join(sent(sets), "set")
    out = out.select("repo_name", "source_handler_fqn", "source_endpoint", "sink_method_fqn", "path_length", F.inline("ends"))
    # a row for each request
    return out.select("repo_name", "source_handler_fqn", "source_endpoint", "sink_method_fqn", F.col("url").alias("sink_url_pattern"), F.col("verb").alias("sink_http_method"), "path_length",
                      F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_")).drop("_")


def _holding(names: DataFrame, name: str, parts: DataFrame, part: str) -> DataFrame:
    """(repo_name, name, part): distinct names and the distinct parts of the same repository that they hold, by an
    equi-join on the substrings of the lengths that parts have."""
    parts = parts.select("repo_name", part).distinct()
    sizes = parts.select("repo_name", F.length(part).alias("_n")).distinct()
    cut = names.select("repo_name", name).distinct().join(F.broadcast(sizes), "repo_name").filter(F.length(name) >= F.col("_n"))
    cut = cut.select("repo_name", name, "_n", F.explode(F.sequence(F.lit(1), F.length(name) - F.col("_n") + 1)).alias("_i"))
    return cut.select("repo_name", name, F.substring(F.col(name), F.col("_i"), F.col("_n")).alias(part)).distinct().join(parts, ["repo_name", part])


def find_second_order_injection(g: CodeGraph, repo: str | None = None) -> DataFrame:
    """repo_name, entity_fqn, write_method_fqn, write_callee, read_method_fqn, read_callee, read_file_path, risk_level.

    Writers and readers of the same class (HIGH), or of classes one of whose
    simple names is part of the other's name (MEDIUM), within a repository. Names are
    found in names by equi-joins on their parts; no pair of classes is tested.
    """
    calls = _in_repo_calls(g, repo).join(_callees(g), "dst").join(g.method.select(F.col("id").alias("src"), "fqn"), "src")
    calls = calls.join(F.broadcast(g.repos(repo)), "repo_id")
    cls = F.regexp_replace("fqn", r"\.?[^.]*$", "")

    def side(names: tuple[str, ...], p: str) -> DataFrame:
        x = calls.filter(F.col("callee").isin(list(names))).groupBy("repo_name", "repo_id", "fqn").agg(F.max("callee").alias("callee"))
        x = x.withColumn("cls", cls).filter("cls <> ''")
        return x.select("repo_name", "repo_id", F.col("fqn").alias(f"{p}_fqn"), F.col("callee").alias(f"{p}_callee"), F.col("cls").alias(f"{p}_cls"), patterns.short_name(F.col("cls")).alias(f"{p}_short"))

    w, r = side(WRITE_NAMES, "w"), side(READ_NAMES, "r")
    files = g.methods_of(repo).groupBy("repo_name", F.col("fqn").alias("r_fqn")).agg(F.min("file_path").alias("read_file_path"))
    w, r = w.drop("repo_id"), r.drop("repo_id").join(files, ["repo_name", "r_fqn"], "left")
    # a reader's class holds the writer's short name, or the other way round and not this way too; the methods of a class follow it
    by_writer = r.join(_holding(r, "r_cls", w, "w_short"), ["repo_name", "r_cls"]).join(w, ["repo_name", "w_short"])
    by_reader = w.join(_holding(w, "w_cls", r, "r_short"), ["repo_name", "w_cls"]).join(r, ["repo_name", "r_short"]).filter(~F.contains("r_cls", "w_short"))
    out = by_writer.unionByName(by_reader).filter("w_fqn <> r_fqn")
    risk = F.when(F.col("w_cls") == F.col("r_cls"), "HIGH").otherwise("MEDIUM")
    return out.select("repo_name", F.col("w_cls").alias("entity_fqn"), F.col("w_fqn").alias("write_method_fqn"), F.col("w_callee").alias("write_callee"),
                      F.col("r_fqn").alias("read_method_fqn"), F.col("r_callee").alias("read_callee"), F.coalesce("read_file_path", F.lit("")).alias("read_file_path"), risk.alias("risk_level"))


def generate_security_report(g: CodeGraph, repo: str | None = None, framework: str = "owasp", cfg: SecurityConfig = SecurityConfig()) -> DataFrame:
    """repo_name, category, caller_fqn, sink_method, file_path, line_start by category: owasp, cwe, pci or stig."""
    short = patterns.short_name(F.col("sink_method"))
    cwe = patterns.lookup(patterns.CWE, short, patterns.CWE_OTHER)
    kinds = {"owasp": patterns.lookup(patterns.OWASP, short, patterns.OWASP_OTHER), "cwe": cwe,
             "pci": patterns.lookup(patterns.PCI, cwe, patterns.PCI_OTHER), "stig": patterns.lookup(patterns.STIG, cwe, patterns.STIG_OTHER)}
    if framework.lower() not in kinds:
        raise ValueError(f"unknown framework {framework!r}; one of {sorted(kinds)}")
    out = find_taint_sinks(g, repo, cfg).withColumn("category", kinds[framework.lower()])
    return out.select("repo_name", "category", "caller_fqn", "sink_method", "file_path", "line_start").orderBy("category", "caller_fqn", "sink_method", "file_path", "line_start")


def find_entry_points(g: CodeGraph, repo: str | None = None) -> DataFrame:
    """repo_name, fqn, file_path, line_start, annotations."""
    return g.methods_of(repo).filter("is_entry_point").select("repo_name", "fqn", "file_path", "line_start", "annotations")


def reachable_methods(g: CodeGraph, repo: str | None = None) -> DataFrame:
    """node: ids of methods that calls reach from entry points and endpoint handlers of the same repository."""
    ids = g.method.join(F.broadcast(g.repos(repo)), "repo_id").select("id", "repo_id")
    seeds = g.method.filter("is_entry_point").join(F.broadcast(g.repos(repo)), "repo_id").select(F.col("id").alias("node"))
    ends = g.exposes.join(g.endpoint.select(F.col("id").alias("dst"), "handler_method_id"), "dst").join(ids, F.expr("handler_method_id = id and src = repo_id"))
    # a call counts for the repository of its caller, and a callee elsewhere calls nothing there
    calls = g.calls.join(ids.select(F.col("id").alias("src"), F.col("repo_id").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("repo_id").alias("b")), "dst").filter("a = b")
    return traverse.closure(calls, seeds.unionByName(ends.select(F.col("id").alias("node"))))


def find_reachable_sinks(g: CodeGraph, repo: str | None = None, show_all: bool = False, cfg: SecurityConfig = SecurityConfig()) -> DataFrame:
    """find_taint_sinks without the argument positions, for callers that an entry point reaches; show_all: find_taint_sinks."""
    if show_all:
        return find_taint_sinks(g, repo, cfg)
    sinks = _sink_calls(g, repo, cfg).withColumnRenamed("caller_id", "node").join(reachable_methods(g, repo), "node", "left_semi")
    return sinks.select("repo_name", "caller_fqn", "sink_method", "file_path", "line_start", "sink_category")


def findings(g: CodeGraph, repo: str | None = None, finding_type: str = "all", min_severity: str = "low", reachable_only: bool = False, cfg: SecurityConfig = SecurityConfig()) -> DataFrame:
    """repo_name, type, severity, category, method_fqn, file_path, line_start, detail, owasp, complexity_hint, p99_ms.

    Security sinks and complexity hints, once for each (type, method, detail), most severe first.
    """
    parts = []
    null = F.lit(None)
    if finding_type in ("all", "security"):
        s = _sink_calls(g, repo, cfg)
        if reachable_only:
            s = s.withColumnRenamed("caller_id", "node").join(reachable_methods(g, repo), "node", "left_semi")
        owasp = F.substring_index(patterns.lookup(patterns.OWASP, patterns.short_name(F.col("sink_method")), patterns.OWASP_OTHER), "-", 1)
        s = s.withColumn("owasp", owasp)
        parts.append(s.select(
            "repo_name", F.lit("taint_sink").alias("type"), F.when(F.col("owasp").isin("A01:2021", "A03:2021"), "HIGH").otherwise("MEDIUM").alias("severity"), F.col("owasp").alias("category"),
            F.col("caller_fqn").alias("method_fqn"), "file_path", "line_start", F.concat(F.lit("Call to sink: "), "sink_method").alias("detail"), "owasp",
            null.cast("string").alias("complexity_hint"), null.cast("double").alias("p99_ms")))
    if finding_type in ("all", "perf"):
        m = g.methods_of(repo).filter("complexity_hint <> ''")
        tags = F.array_distinct(F.filter(F.transform(F.split("complexity_hint", ","), F.trim), lambda t: t != ""))
        severity = F.when(F.contains("complexity_hint", F.lit("O(n2)")) | F.contains("complexity_hint", F.lit("n+1-risk")), "HIGH").when(tags == F.array(F.lit("recursive")), "LOW").otherwise("MEDIUM")
        parts.append(m.select(
            "repo_name", F.lit("complexity_hint").alias("type"), severity.alias("severity"), F.lit("Performance").alias("category"), F.col("fqn").alias("method_fqn"), "file_path", "line_start",
            F.col("complexity_hint").alias("detail"), null.cast("string").alias("owasp"), "complexity_hint", null.cast("double").alias("p99_ms")))
    if not parts:
        raise ValueError(f"unknown finding type {finding_type!r}")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rank = patterns.lookup({"HIGH": 3, "MEDIUM": 2, "LOW": 1}, F.col("severity"), 0)
    out = out.filter(rank >= {"high": 3, "medium": 2, "low": 1}.get(min_severity.lower(), 1))
    keys = ["repo_name", "type", "method_fqn", "detail"]
    rest = [c for c in out.columns if c not in keys]
    cols = out.columns
    out = out.groupBy(*keys).agg(F.min(F.struct("file_path", "line_start", *[c for c in rest if c not in ("file_path", "line_start")])).alias("s"))
    out = out.select(*[c if c in keys else F.col(f"s.{c}").alias(c) for c in cols])
    return out.orderBy(rank.desc(), "method_fqn", "type", "detail", "repo_name")


def new_rows(now: DataFrame, baseline: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of now whose keys the baseline lacks; a null key equals a null key."""
    b = baseline.select(*[F.col(k).alias(f"_b_{k}") for k in keys]).distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return now.join(b, cond, "left_anti")


def new_sinks(now: DataFrame, baseline: DataFrame) -> DataFrame:
    return new_rows(now, baseline, ("caller_fqn", "sink_method"))


def new_taint_paths(now: DataFrame, baseline: DataFrame) -> DataFrame:
    return new_rows(now, baseline, ("source_method_fqn", "sink_method_fqn"))
