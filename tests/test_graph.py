"""Catalogue operators on small hand-made graphs."""

import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import patterns, text
from skein.functions.patterns import SecurityConfig
from skein.graph import CodeGraph
from skein.operators import callgraph, license, orm, perf, resolve, security
from skein.plans import traverse


def method(i, name, fqn=None, **more):
    return {"id": i, "name": name, "fqn": fqn or f"com.A.{name}", "file_id": "f", "class_id": "c", "repo_id": "r", "line_start": 1, "generated": False, **more}


def small(spark, **tables):
    base = {"repo": [{"id": "r", "name": "main"}], "file": [{"id": "f", "path": "src/A.java", "language": "java", "repo_id": "r"}],
            "class": [{"id": "c", "name": "A", "fqn": "com.A", "file_id": "f", "repo_id": "r"}]}
    return CodeGraph.from_rows(spark, **{**base, **tables})


def calls(*pairs, pos=0):
    return [{"src": a, "dst": b, "callee_name": b, "caller_arg_pos": pos, "callee_param_pos": pos} for a, b in pairs]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def g(spark):
    return small(
        spark, method=[method("a", "callFoo"), method("b", "doWork"), method("d", "late", generated=True), method("n", "unknown", generated=None)],
        calls=calls(("a", "b"), ("d", "a"), ("n", "a")) + [{"src": "b", "dst": "a", "caller_arg_pos": -99}],
        endpoint=[{"id": "e", "http_method": "GET", "path": "/api/foo", "handler_method_id": "b", "repo_id": "r"}, {"id": "x", "http_method": "GET", "path": "/express", "repo_id": "r"}],
        exposes=[{"src": "r", "dst": "e"}])


def test_lookups(g):
    assert rows(callgraph.find_callers(g, "com.A.doWork"), "fqn", "file_path") == [("com.A.callFoo", "src/A.java")]
    assert rows(callgraph.find_callees(g, "com.A.doWork"), "fqn") == []
    assert rows(callgraph.find_callees(g, "com.A.doWork", include_synthetic=True), "fqn") == [("com.A.callFoo",)]
    assert rows(callgraph.find_callers(g, "com.A.callFoo", exclude_generated=True), "fqn") == [("com.A.doWork",)]
    assert callgraph.find_callers(g, "nobody").count() == 0
    assert rows(callgraph.find_endpoint_callers(g, "get", "/api/foo"), "role", "fqn") == [("caller", "com.A.callFoo"), ("handler", "com.A.doWork")]
    assert rows(callgraph.list_endpoints(g), "path") == [("/api/foo",)]
    assert rows(callgraph.get_file_location(g, "com.A"), "line_start") == [(0,)]
    assert rows(callgraph.list_repos(g), "name", "method_count", "endpoint_count") == [("main", 4, 1)]
    found, counts = callgraph.search_symbol(g, "W")
    assert rows(found, "fqn") == [("com.A.doWork",), ("com.A.unknown",)] and counts.first().total_count == 2


def test_blast_radius_passes_depth_and_flags(g):
    assert rows(callgraph.blast_radius(g, "com.A.doWork"), "fqn", "depth") == [("com.A.callFoo", 1), ("com.A.late", 2), ("com.A.unknown", 2)]
    assert rows(callgraph.blast_radius(g, "com.A.doWork", exclude_generated=True), "fqn", "depth") == [("com.A.callFoo", 1)]
    assert ("com.A.doWork", 2) in rows(callgraph.blast_radius(g, "com.A.doWork", include_synthetic=True), "fqn", "depth")
    assert callgraph.blast_radius(g, "com.A.doWork", 0).count() == 0
    assert rows(callgraph.impacted_endpoints(g, ["com.A.doWork"]), "path") == [("/api/foo",)]


EDGES = st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=18)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(EDGES, st.integers(0, 7), st.integers(0, 4), st.sets(st.integers(0, 7), max_size=3))
def test_traversals_equal_a_model(spark, edges, start, depth, ends):
    e = spark.createDataFrame([(a, b, str(b)) for a, b in edges], "src int, dst int, label string")
    dist, frontier = {}, {start}
    for d in range(1, depth + 1):
        frontier = {b for a, b in edges if a in frontier} - set(dist)
        dist.update({x: d for x in frontier})
    seeds = spark.createDataFrame([(start, start)], "seed int, node int")
    assert rows(traverse.bfs(e, seeds, depth), "node", "depth") == sorted(dist.items())
    reach, todo = {start}, [start]
    while todo:
        for a, b in edges:
            if a == todo[0] and b not in reach:
                reach.add(b)
                todo.append(b)
        todo.pop(0)
    assert rows(traverse.closure(e, seeds.select("node")), "node") == [(x,) for x in sorted(reach)]
    paths, out = [[start]], set()
    for _ in range(depth):
        paths = [p + [b] for p in paths for a, b in set(edges) if a == p[-1] and b not in p]
        out |= {tuple(map(str, p)) for p in paths if p[-1] in ends}
    targets = spark.createDataFrame([(x,) for x in ends], "node int")
    got = traverse.simple_paths(e, spark.createDataFrame([(start, str(start))], "node int, label string"), targets, depth)
    assert sorted(tuple(r.chain) for r in got.collect()) == sorted(out)


SRC = {"annotations": ["RequestParam", "Transactional"]}


def taint(spark, methods, edges, **more):
    return small(spark, method=methods, calls=calls(*edges), **more)


def chains(g, depth=5):
    return sorted(">".join(x.rsplit(".", 1)[-1] for x in r.call_chain) for r in security.find_taint_paths(g, "main", depth).collect())


def test_taint_paths(spark):
    src, mid = method("s", "getUser", "com.C.getUser", **SRC), method("m", "find", "com.S.find")
    sink, sink2 = method("k", "execute", "x.StatementHelper.execute"), method("q", "executeQuery", "x.StatementHelper.executeQuery")
    clean = method("h", "htmlEscape", "x.HtmlUtils.htmlEscape")
    assert chains(taint(spark, [src, sink], [("s", "k")])) == ["getUser>execute"]
    assert chains(taint(spark, [src, mid, sink], [("s", "m"), ("m", "k"), ("m", "s")])) == ["getUser>find>execute"]
    assert chains(taint(spark, [src, clean, sink], [("s", "h"), ("h", "k")])) == []
    assert chains(taint(spark, [src, clean, mid, sink], [("s", "h"), ("h", "k"), ("s", "m"), ("m", "k")])) == ["getUser>find>execute"]
    assert chains(taint(spark, [src, sink], [("s", "k"), ("s", "k")]), 0) == []
    assert chains(taint(spark, [src, sink, sink2], [("s", "k"), ("k", "q"), ("s", "k")])) == ["getUser>execute", "getUser>execute>executeQuery"]
    r = security.find_taint_paths(taint(spark, [{**src, "line_start": None}, sink], [("s", "k")])).first()
    assert (r.source_annotations, r.line_start, r.path_length, r.sink_type, r.sanitizer_pruned) == (["RequestParam"], 0, 1, "A03:2021-Injection", False)
    long = [method(f"n{i}", f"n{i}") for i in range(11)]
    g = taint(spark, [src, *long, sink], [("s", "n0"), *[(f"n{i}", f"n{i + 1}") for i in range(10)], ("n8", "k"), ("n10", "k")])
    assert [c.count(">") for c in chains(g, 99)] == [10]


def test_source_by_call(spark):
    g = taint(spark, [method("s", "handler"), method("b", "req.body", "req.body"), method("k", "fetch", "lib.fetch")], [("s", "b"), ("s", "k")])
    r = security.find_taint_paths(g).first()
    assert (r.source_annotations, r.file_path, r.line_start, r.sink_method_fqn) == ([], "", 0, "lib.fetch")
    assert rows(security.find_taint_flows(g), "source_method_fqn", "sink_method_name") == [("com.A.handler", "lib.fetch")]


def test_patterns(spark):
    cfg = SecurityConfig()
    df = spark.createDataFrame([(x,) for x in ("a.b.execute", "Statement.execute", "execute#2", "my.Client.query", "query", "obj.get", "axios.get", "new.<init>", None)], "x string")
    assert [r[0] for r in df.select(cfg.is_sink(F.col("x"))).collect()] == [True, True, False, True, False, False, True, True, False]
    assert cfg.table(spark).count() == 69


def test_user_patterns(tmp_path):
    p = tmp_path / "s.yml"
    p.write_text("sink_methods: [my.sink, fetch]\nsource_annotations: 3\n")
    cfg = SecurityConfig.load(str(p))
    assert cfg.sink_methods[-1] == "my.sink" and len(cfg.sink_methods) == len(patterns.SINK_METHODS) + 1 and cfg.source_annotations == patterns.SOURCE_ANNOTATIONS
    p.write_text("{bad")
    assert SecurityConfig.load(str(p)) == SecurityConfig() == SecurityConfig.load(str(tmp_path / "none"))


def test_findings_and_reachability(spark):
    g = small(spark, method=[method("a", "unsafe", line_start=10), method("b", "heavy", complexity_hint="O(n2)-candidate"), method("c", "deep", complexity_hint="recursive"), method("e", "entry", is_entry_point=True)],
              calls=calls(("e", "b")), rest_call=[{"id": "s", "http_method": "UNKNOWN", "url_pattern": "UNRESOLVED", "callee_name": "Statement.execute", "caller_method_id": "a", "repo_id": "r"}],
              unresolved_call=[{"src": "a", "dst": "s"}, {"src": "a", "dst": "s"}])
    assert security.find_taint_sinks(g).count() == 2
    assert rows(security.findings(g), "type", "severity") == [("complexity_hint", "HIGH"), ("complexity_hint", "LOW"), ("taint_sink", "HIGH")]
    assert rows(security.findings(g, finding_type="perf", min_severity="medium"), "method_fqn") == [("com.A.heavy",)]
    assert security.findings(g, "nobody").count() == 0
    assert security.find_reachable_sinks(g).count() == 0 and security.find_reachable_sinks(g, show_all=True).count() == 2
    assert rows(callgraph.list_unresolved_calls(g), "callee_name") == [("Statement.execute",)] * 2
    with pytest.raises(ValueError):
        security.generate_security_report(g, framework="none")


def test_cross_repo(spark):
    e = lambda i, m, p, **more: {"id": i, "http_method": m, "path": p, "handler_method_id": "h", "repo_id": "r2", **more}
    c = lambda i, m, u: {"id": i, "http_method": m, "url_pattern": u, "caller_method_id": "m", "repo_id": "r"}
    g = small(spark, repo=[{"id": "r", "name": "caller"}, {"id": "r2", "name": "callee"}], method=[method("m", "call"), method("h", "get", repo_id="r2")],
              endpoint=[e("e1", "GET", "/api/users/{id}"), e("e2", "", "/{any}/users/{id}"), e("e3", "GET", "/api/{a}/{a}"), e("e4", "POST", "/files/**"), e("e5", "GET", "/js/{id}", path_regex="/js/{id}")],
              rest_call=[c("1", "GET", "http://svc/api/users/123"), c("2", "get", "/api/users/1"), c("3", "", "/api/users/9"), c("4", "GET", "DYNAMIC"), c("5", "GET", "https://host"), c("6", "PUT", "/api/users/1"), c("7", "POST", "/files/a/b"), c("8", "GET", "/js/1")])
    met = rows(resolve.cross_repo_matches(g), "call_id", "dst")
    assert met == [("1", "e1"), ("1", "e2"), ("2", "e1"), ("2", "e2"), ("3", "e1"), ("3", "e2"), ("6", "e2"), ("7", "e4")]
    _, depends, counts = resolve.resolve_cross_repo(g)
    assert rows(depends, "src", "dst") == [("r", "r2")] and tuple(counts.first()) == (5, 3)


def test_path_regex(spark):
    df = spark.createDataFrame([(x,) for x in ("/a/{id}", "/a/**", "/{x}/{x}", "/{id:\\d+}", "/a")], "p string")
    assert [r[0] for r in df.select(text.path_regex(F.col("p"))).collect()] == ["^/a/([^/]+)$", "^/a(?:/.*)?$", "$.^", "$.^", "^/a$"]


def test_framework_passes(spark):
    cls = lambda i, n, f=None: {"id": i, "name": n, "fqn": f or f"com.{n}", "file_id": "f", "repo_id": "r"}
    g = small(spark, **{"class": [cls("c", "Config"), cls("s", "Service"), cls("flt", "MyFilter"), cls("b", "OncePerRequestFilter"), cls("v", "MyValidator"), cls("cv", "ConstraintValidator", "javax.ConstraintValidator")]},
              method=[method("i", "<init>"), method("t", "isGood", annotations=["AssertTrue"]), method("m", "make", class_id="s"), method("df", "doFilterInternal", class_id="flt"), method("h", "handle", class_id="s"),
                      method("p", "publish", class_id="s"), method("l", "onEvent", class_id="s", annotations=["EventListener"]), method("iv", "isValid", class_id="v"),
                      method("ad", "around", class_id="s", annotations=["Around"], line_start=3), method("tm", "timed", class_id="s", annotations=["Timed"])],
              calls=calls(("m", "i")), extends=[{"src": "flt", "dst": "b"}], implements=[{"src": "v", "dst": "cv"}],
              endpoint=[{"id": "e", "http_method": "GET", "path": "/", "handler_method_id": "h", "repo_id": "r"}],
              rest_call=[{"id": "s1", "callee_name": "publisher.publishEvent", "repo_id": "r"}], unresolved_call=[{"src": "p", "dst": "s1"}])
    assert rows(resolve.bean_validation(g), "src", "dst") == [("i", "t"), ("m", "t")]
    assert rows(resolve.request_filters(g), "src", "dst") == [("h", "df")]
    assert rows(resolve.application_events(g), "src", "dst") == [("p", "l")]
    assert rows(resolve.validator_entry_points(g).filter("is_entry_point"), "id") == [("iv",)]
    code = "class A {\n@Around(\"@annotation(timed)\")\nObject around(ProceedingJoinPoint p, Timed timed) {}\n}"
    sources = spark.createDataFrame([("src/A.java", code)], "path string, content string")
    assert rows(resolve.aop_advice(g, sources), "src", "dst") == [("tm", "ad")]
    every = resolve.framework_edges(g, sources, synthetic=True)
    assert every.count() == 5 and {r.caller_arg_pos for r in every.collect()} == {-99}


def test_virtual_dispatch(spark):
    cls = lambda i: {"id": i, "name": i, "fqn": f"com.{i}", "file_id": "f", "repo_id": "r"}
    g = small(spark, **{"class": [cls("P"), cls("C"), cls("D")]}, extends=[{"src": "C", "dst": "P"}], implements=[{"src": "D", "dst": "P"}],
              method=[method("x", "run", class_id="X"), method("p", "go", class_id="P"), method("c1", "go", class_id="C", line_start=1), method("c2", "go", class_id="C", line_start=9), method("d", "go", class_id="D")], calls=calls(("x", "p"), ("x", "d")))
    assert rows(resolve.virtual_dispatch(g), "src", "dst") == [("x", "c2")]


def test_parents_and_stubs(spark):
    declared = spark.createDataFrame([("a.B", "a", "f", "Base", "extends"), ("a.B", "a", "f", "Face", "implements"), ("a.C", "a", "f2", "q.Far", "extends"), ("D", "", "f3", "Base", "extends")], "child_fqn string, package string, file_id string, parent string, kind string")
    imports = spark.createDataFrame([("f", "Face", "lib.Face")], "file_id string, simple string, fqn string")
    g = small(spark, **{"class": [{"id": i, "name": i[-1], "fqn": i, "file_id": "f", "repo_id": "r"} for i in ("a.B", "a.C", "D", "a.Base")]})
    parents = resolve.resolve_parents(declared, imports, g["class"])
    assert rows(parents, "child_fqn", "parent_fqn") == [("D", "Base"), ("a.B", "a.Base"), ("a.B", "lib.Face"), ("a.C", "q.Far")]
    out, edges = resolve.external_stubs(g, parents)
    assert rows(out["class"].filter("repo_id = '__external__'"), "fqn", "name") == [("Base", "Base"), ("lib.Face", "Face"), ("q.Far", "Far")]
    assert edges.count() == 4


def test_call_resolution(spark):
    m = lambda i, n, c, p="p": (i, n, f"{p}.{c}", c, "f", f"{c}.java", 1)
    methods = spark.createDataFrame([m("1", "run", "Main"), m("2", "save", "Repo"), m("3", "save", "Other", "q"), m("4", "help", "Main"), m("5", "help", "Util", "q"), m("6", "pay", "PayImpl", "z")], "id string, name string, class_fqn string, class_name string, file_id string, file_path string, line_start int")
    site = lambda i, recv, callee, n=1: (i, "1", "p.Main", "p", "f", recv, callee, n)
    sites = spark.createDataFrame([site("a", "repo", "save"), site("b", "", "help", 0), site("c", "Util", "help"), site("d", "service", "pay"), site("e", "x", "gone"), site("f", "this", "run")], "site_id string, caller_id string, caller_class string, package string, file_id string, receiver string, callee string, argc int")
    imports = spark.createDataFrame([("f", "Util", "q.Util")], "file_id string, simple string, fqn string")
    fields = spark.createDataFrame([("p.Main", "repo", "Repo"), ("p.Main", "service", "Pay")], "class_fqn string, field string, type string")
    impls = spark.createDataFrame([("Pay", "z.PayImpl")], "interface_name string, class_fqn string")
    found, stubs = resolve.resolve_calls(sites, methods, imports, fields, impls)
    assert rows(found, "site_id", "dst", "caller_arg_pos") == [("a", "2", 0), ("b", "4", -1), ("c", "5", 0), ("d", "6", 0)]
    assert rows(stubs, "site_id", "callee_name") == [("e", "x.gone"), ("f", "this.run")]


def test_call_resolution_up_the_hierarchy(spark):
    """Nearest class above first; super never means the own class, nor a class that only shares the package."""
    m = lambda i, n, c: (i, n, f"p.{c}", c, "f", f"{c}.java", 1)
    methods = spark.createDataFrame([m("0", "run", "C"), m("1", "go", "A"), m("2", "go", "B"), m("3", "go", "Z"), m("4", "deep", "Z"), m("5", "go", "C"), m("6", "lone", "A")], "id string, name string, class_fqn string, class_name string, file_id string, file_path string, line_start int")
    sites = spark.createDataFrame([(i, "0", "p.C", "p", "f", r, c, 0) for i, r, c in (("a", "super", "go"), ("b", "super", "deep"), ("c", "", "deep"), ("d", "super", "lone"), ("e", "x", "deep"), ("f", "B", "deep"), ("g", "this", "go"))],
                                  "site_id string, caller_id string, caller_class string, package string, file_id string, receiver string, callee string, argc int")
    parents = spark.createDataFrame([("p.C", "p.B"), ("p.B", "p.Z"), ("p.Z", "p.C"), ("p.A", "p.A")], "child_fqn string, parent_fqn string")
    none = lambda ddl: spark.createDataFrame([], ddl)
    fields = spark.createDataFrame([("p.C", "x", "B")], "class_fqn string, field string, type string")
    found, stubs = resolve.resolve_calls(sites, methods, none("file_id string, simple string, fqn string"), fields, none("interface_name string, class_fqn string"), parents)
    assert rows(found, "site_id", "dst") == [("a", "2"), ("b", "4"), ("c", "4"), ("e", "4"), ("f", "4"), ("g", "5")]
    assert rows(stubs, "site_id") == [("d",)]


def test_incremental_and_delete(spark, g):
    f = "path string, repo_id string, branch_name string, blob_hash string"
    a = spark.createDataFrame([("x", "r", "m", "1"), ("y", "r", "m", "2"), ("z", "r", "m", "3")], f)
    b = spark.createDataFrame([("x", "r", "m", "1"), ("y", "r", "m", "9"), ("w", "r", "m", "4"), ("x", "r", "dev", "1")], f)
    assert rows(resolve.incremental_diff(a, b), "path", "branch_name", "change") == [("w", "m", "added"), ("x", "dev", "added"), ("x", "m", "unchanged"), ("y", "m", "changed"), ("z", "m", "removed")]
    left = resolve.delete_files(g, spark.createDataFrame([("f",)], "id string"))
    assert left.method.count() == left.calls.count() == 0 and left.repo.count() == 1 and left.endpoint.count() == 1
    gone = resolve.delete_repo(g, "main")
    assert all(gone[t].count() == 0 for t in ("repo", "method", "calls", "endpoint", "exposes", "file"))


def test_write_and_read(spark, g, tmp_path):
    g.write(str(tmp_path / "g"))
    back = CodeGraph.read(spark, str(tmp_path / "g"))
    assert all(sorted(map(str, back[t].collect())) == sorted(map(str, g[t].collect())) for t in ("method", "calls", "repo", "endpoint", "perf_sample"))


def test_load_queries(spark):
    p = lambda i, f, p99, rps, repo="r", p50=1.0: {"id": i, "endpoint_fqn": f, "p50_ms": p50, "p99_ms": p99, "rps": rps, "repo_id": repo}
    g = small(spark, repo=[{"id": "r", "name": "main"}, {"id": "r2", "name": "down"}],
              method=[method("a", "a", complexity_hint="recursive,n+1-risk", io_fanout=3, io_serial_count=2, io_parallel_count=1), method("b", "b", complexity_hint="odd"), method("h", "h", repo_id="r2")],
              endpoint=[{"id": "e", "http_method": "GET", "path": "/d/{id}", "handler_method_id": "h", "repo_id": "r2"}], calls_rest=[{"src": "a", "dst": "e"}],
              perf_sample=[p("1", "com.A.a", 100.0, 1900.0), p("2", "com.A.a2", 300.0, 10.0), p("3", "svc/d/{id}", 110.0, 1.0, "r2"), p("4", "zero", 0.0, 5.0)],
              observed_at=[{"src": "a", "dst": "1"}, {"src": "a", "dst": "2"}])
    assert rows(perf.find_hotspots(g, "main"), "method_fqn", "risk_score", "p99_ms") == [("com.A.a", 600.0, 300.0), ("com.A.b", 50.0, None)]
    assert rows(perf.find_io_fanout(g), "handler_fqn", "latency_floor_ms", "endpoint_path") == [("com.A.a", 600.0, "")]
    assert rows(perf.estimate_capacity(g, "main"), "endpoint_fqn", "risk_level") == [("com.A.a", "CRITICAL"), ("com.A.a2", "LOW")]
    assert rows(perf.find_cascade_risk(g), "downstream_endpoint", "risk") == [("GET /d/{id}", "SATURATED")]
    new = spark.createDataFrame([("com.A.a", 1.0, 2.0, 3.0, "t2", "x"), ("com.A.a", 9.0, 9.0, 9.0, "t1", "x"), ("GET /api/b", 1.0, 1.0, 1.0, "t", "x"), ("", 1.0, 1.0, 1.0, "t", "x"), ("gone", 1.0, 1.0, 1.0, "t", "x")], "endpoint_fqn string, p50_ms double, p99_ms double, rps double, sample_time string, source string")
    assert tuple(perf.link_samples(g, new, "main")[2].first()) == (3, 2, 1)
    once = perf.ingest_perf_results(g, new, "main")
    twice = perf.ingest_perf_results(once, new, "main")
    assert once.perf_sample.count() == twice.perf_sample.count() == 7 and once.observed_at.count() == twice.observed_at.count() == 4


def test_licenses(spark):
    deps = spark.createDataFrame([("g", a, "1") for a in "abcdef"] + [("g", "a", "2")], "group string, artifact string, version string")
    known = spark.createDataFrame([("g", "a", "MIT"), ("g", "b", "GPL-3.0"), ("g", "c", "MPL-2.0"), ("g", "d", "Odd"), ("g", "f", "GPL-2.0")], "group string, artifact string, spdx string")
    assert rows(license.check_licenses(deps, known, overrides={"g:f": "MIT"}), "artifact", "status") == [("a", "OK"), ("b", "VIOLATION"), ("c", "WARNING"), ("d", "WARNING"), ("e", "UNKNOWN"), ("f", "OK")]
    assert rows(license.find_license_violations(deps, known, allowed=["GPL-3.0"]), "artifact") == [("a",), ("c",), ("d",), ("e",), ("f",)]


def test_entities(spark):
    g = small(spark, entity_relation=[{"id": "1", "source_class_id": "c", "target_class_fqn": "com.B", "field_name": "b", "relation_type": "ManyToOne", "fetch_type": "EAGER", "repo_id": "r"}], has_relation=[{"src": "c", "dst": "1"}])
    assert rows(orm.find_eager_fetches(g), "source_class_fqn", "field_name") == [("com.A", "b")] and orm.list_entity_relations(g, "none").count() == 0


def test_calls_and_stubs_come_from_all_of_lineitem(spark):
    from skein import testdata

    d = "/root/testdata/sf0.001"
    parts = defaultdict(set)
    for r in spark.read.parquet(f"{d}/lineitem.parquet").collect():
        parts[r.l_orderkey, r.l_linenumber].add(r.l_partkey)
    methods = {r.k for r in testdata.view(spark, d, "g_method").collect()}
    want = {(str(a), str(b)) for (o, n), ks in parts.items() for a in ks for b in parts.get((o, n + 1), ()) if a != b and b in methods}
    assert {(r.src, r.dst) for r in testdata.view(spark, d, "g_calls").collect()} == want
    stubs = {f"s{o}_{n}" for (o, n), ks in parts.items() if n % 3 == 1 and min(ks) in methods}
    assert {r.id for r in testdata.view(spark, d, "g_stub").collect()} == stubs


def test_paths_stay_distinct_where_nodes_share_a_label(spark):
    """Two nodes named b give one chain; with names of their own they give two."""
    starts, targets = spark.createDataFrame([("1", "a"), ("1", "a")], "node string, label string"), spark.createDataFrame([("4",)], "node string")
    for names, want in ((("b", "b"), [["a", "b", "d"]]), (("b", "c"), [["a", "b", "d"], ["a", "c", "d"]])):
        rows = [("1", "2", names[0]), ("1", "3", names[1]), ("2", "4", "d"), ("3", "4", "d"), ("4", "1", "a")]
        edges = spark.createDataFrame(rows + rows[:1], "src string, dst string, label string")
        assert sorted(r.chain for r in traverse.simple_paths(edges, starts, targets, 4).collect()) == want


def test_patterns_match_as_endswith(spark):
    pats, names = ("a.save", "save", "é.x"), ["a.save", "x.save", "ve", "é.x", "bé.x", "", None, "save\n"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(patterns._matches(F.col("n"), pats, frozenset(pats))).collect()]
    assert got == [n is not None and n.endswith(pats) for n in names]
