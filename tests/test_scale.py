"""Work of the catalogue's operators: the rows that joins give and that rounds write, not only the results."""

import re

import pytest

from skein.operators import callgraph, resolve, security
from skein.plans import traverse
from tests.test_graph import calls, method, rows, small


@pytest.fixture
def plain(spark):
    """Plans without adaptive stages, whose counts of rows can be read after a run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def most_rows(df):
    """The most rows that one operation of df's plan gave in the run that collected it."""
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        kids = p.children()
        plan += [kids.apply(i) for i in range(kids.size())]
        n = p.metrics().get("numOutputRows")
        most = max(most, n.get().value() if n.isDefined() else 0)
    return most


@pytest.fixture
def written(monkeypatch):
    """Rows of the tables that traversals write."""
    counts = []

    def counted(df, name, write=traverse.materialize):
        out = write(df, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(traverse, "materialize", counted)
    return counts


def test_calls_resolve_without_pairs_of_sites_and_methods_of_a_name(plain):
    n = 300
    methods = plain.createDataFrame([(f"m{i:03}", "save", f"com.C{i}", f"C{i}", "f", "p", i, False) for i in range(n)],
                                    "id string, name string, class_fqn string, class_name string, file_id string, file_path string, line_start long, is_static boolean")
    sites = plain.createDataFrame([(f"s{i}", f"m{i:03}", "org.X", "org", "g", "", "save", 0) for i in range(n)],
                                  "site_id string, caller_id string, caller_class string, package string, file_id string, receiver string, callee string, argc int")
    none = lambda ddl: plain.createDataFrame([], ddl)
    found, _ = resolve.resolve_calls(sites, methods, none("file_id string, simple string, fqn string"), none("class_fqn string, field string, type string"), none("interface_name string, class_fqn string"))
    got = rows(found, "site_id", "dst")
    assert got == sorted((f"s{i}", "m000" if i else "m001") for i in range(n))  # the least method but the caller itself
    assert most_rows(found) <= 2 * n


def test_impacted_endpoints_search_once_for_all_changed_methods(spark, written):
    n = 20
    g = small(spark, method=[method(str(i), f"m{i}") for i in range(n)], calls=calls(*[(str(i), str((i + 1) % n)) for i in range(n)]),
              endpoint=[{"id": f"e{i}", "http_method": "GET", "path": f"/{i}", "handler_method_id": str(i), "repo_id": "r"} for i in range(n)])
    got = rows(callgraph.impacted_endpoints(g, [f"com.A.m{i}" for i in range(10)], 5), "path")
    assert got == sorted((f"/{i}",) for i in [*range(10), *range(15, 20)])
    assert sum(written) <= 2 * n  # the edges, and each method once


def test_requests_are_matched_by_distinct_urls_and_patterns(plain):
    n = 60
    g = small(plain, method=[method(str(i), f"m{i}") for i in range(n)],
              rest_call=[{"id": f"c{i}", "http_method": "GET", "url_pattern": f"http://h/en/{i % 2}", "caller_method_id": str(i), "repo_id": "r"} for i in range(n)],
              endpoint=[{"id": f"e{i}", "http_method": "GET", "path": "/en/{id}" if i % 2 else "/en/x", "handler_method_id": str(i), "repo_id": f"q{i % 3}"} for i in range(n)])
    _, depends, counts = resolve.resolve_cross_repo(g)
    assert rows(depends, "src", "dst") == [("r", "q0"), ("r", "q1"), ("r", "q2")] and rows(counts, "matched", "unresolved") == [(n, 0)]
    assert max(most_rows(depends), most_rows(counts)) <= 2 * n  # before: n * n / 2 matched pairs
    met = resolve.cross_repo_matches(g)
    assert met.count() == met.distinct().count() == n * n // 2


def test_matches_stay_distinct_where_ids_repeat(spark):
    twice = [{"id": "c", "http_method": v, "url_pattern": u, "caller_method_id": "a", "repo_id": "r"} for v, u in (("GET", "/en/1"), ("", "/en/2"), (None, "/en/2"), ("GET", "/en/1"))]
    ends = [{"id": "e", "http_method": v, "path": p, "repo_id": "q"} for v, p in (("GET", "/en/{id}"), ("POST", "/en/2"), ("GET", "/{x}/{id}"))]
    g = small(spark, rest_call=twice + [{"id": "d", "http_method": "PUT", "url_pattern": "/en/2", "caller_method_id": "a", "repo_id": "r"}], endpoint=ends)
    assert rows(resolve.cross_repo_matches(g), "src", "dst", "call_id") == [("a", "e", "c")]
    assert rows(resolve.resolve_cross_repo(g)[2], "matched", "unresolved") == [(4, 1)]


def test_events_reach_listeners_without_a_shuffle_of_the_pairs(plain):
    n = 20
    g = small(plain, method=[method(f"w{i}", "run") for i in range(n)] + [method(f"h{i}", f"on{i}", annotations=["EventListener"]) for i in range(n)] + [method("h0", "again", annotations=["EventListener"], repo_id="q"), method("w0", "run", repo_id="q")]
              + [method("p", "publishEvent")], calls=calls(*[(f"w{i}", "p") for i in range(n)], ("w0", "h1"), ("h0", "p")))
    plain.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = resolve.application_events(g)
        got = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        plain.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.src, r.dst, r.callee_name) for r in got) == sorted((w, f"h{i}", "again" if i == 0 and w == "w0" else f"on{i}") for w in [f"w{i}" for i in range(n)] + ["h0"] for i in range(n) if (w, i) not in (("w0", 1), ("h0", 0)))
    above = plan[:plan.index("BroadcastHashJoin")]
    assert "Exchange" not in above and "Aggregate" not in above  # nothing is shuffled once pairs are formed


def test_second_order_names_are_found_without_pairs_of_classes(plain):
    n = 60
    cls = [f"com.w.Writer{i:02}" for i in range(n)] + [f"com.r.Reader{i:02}" for i in range(n)] + ["com.r.Writer07Reader", "com.r.Writer0"]
    g = small(plain, method=[method(c, "go", f"{c}.go") for c in cls] + [method("s", "save", "x.Y.save"), method("f", "findById", "x.Y.findById")],
              calls=calls(*[(c, "s" if ".w." in c else "f") for c in cls]))
    found = security.find_second_order_injection(g)
    got = rows(found, "write_method_fqn", "read_method_fqn", "risk_level")
    assert got == sorted([("com.w.Writer07.go", "com.r.Writer07Reader.go", "MEDIUM")] + [(f"com.w.Writer0{i}.go", "com.r.Writer0.go", "MEDIUM") for i in range(10)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    # before, classes met on the repository alone, with a test of every pair
    assert "NestedLoop" not in plan and not re.search(r"Join \[repo_name#\d+\].*Contains\(", plan)


def test_cross_service_lengths_equal_those_of_the_chains(spark, written):
    n = 9
    g = small(spark, method=[method(str(i), f"m{i}") for i in range(n)], calls=calls(*[(str(i), str(j % n)) for i in range(n) for j in (i + 1, i + 3)]),
              endpoint=[{"id": f"e{i}", "http_method": "GET", "path": f"/{i}", "handler_method_id": str(i), "repo_id": "r"} for i in (0, 4)], exposes=[{"src": "r", "dst": "e0"}, {"src": "r", "dst": "e4"}],
              rest_call=[{"id": f"u{i}", "http_method": "GET", "url_pattern": f"/x{i % 2}", "caller_method_id": str(i), "repo_id": "r"} for i in range(n)],
              unresolved_call=[{"src": str(i), "dst": f"u{j}"} for i in range(n) for j in (i, i, (i + 1) % n)])
    cols = ("repo_name", "source_handler_fqn", "source_endpoint", "sink_method_fqn", "sink_url_pattern", "sink_http_method", "path_length")
    short = rows(security.find_cross_service_taint(g, max_depth=3, with_chain=False), *cols)
    assert written  # rounds of bfs, whose rows are pairs of numbers
    assert short == rows(security.find_cross_service_taint(g, max_depth=3), *cols) and len(short) > 2 * n


def test_the_last_round_of_paths_is_not_written(spark, written):
    n = 12  # every method of a layer calls every one of the next
    e = spark.createDataFrame([(f"{d}_{i}", f"{d + 1}_{j}", f"{d + 1}_{j}") for d in range(3) for i in range(n) for j in range(n)], "src string, dst string, label string")
    starts = spark.createDataFrame([("0_0", "0_0")], "node string, label string")
    ends = spark.createDataFrame([(f"3_{i}",) for i in range(n)], "node string")
    assert traverse.simple_paths(e, starts, ends, 3).count() == n ** 3 > max(written)


def test_blast_radius_travels_as_numbers(spark, monkeypatch):
    kinds = {}

    def seen(df, name, write=traverse.materialize):
        kinds.setdefault(name, dict(df.dtypes))
        return write(df, name)

    monkeypatch.setattr(traverse, "materialize", seen)
    g = small(spark, method=[method(str(i), f"m{i}") for i in range(4)], calls=calls(("0", "1"), ("1", "2"), ("2", "0"), ("2", "3")))
    assert rows(callgraph.blast_radius(g, max_depth=2), "method_fqn", "fqn", "depth") == sorted(
        (f"com.A.m{a}", f"com.A.m{b}", d) for a, b, d in ((1, 0, 1), (2, 1, 1), (0, 2, 1), (3, 2, 1), (1, 2, 2), (2, 0, 2), (0, 1, 2), (3, 1, 2)))
    assert kinds["bfs"] == {"seed": "bigint", "node": "bigint"}


def test_blast_radius_writes_no_pairs(plain, written, monkeypatch):
    n = 30
    g = small(plain, method=[method(str(i), f"m{i}") for i in range(n)], calls=calls(*[(str(i), str((i + k) % n)) for i in range(n) for k in (1, 2, 3)]))
    want = sorted((f"com.A.m{i}", f"com.A.m{(i - k) % n}", -(-k // 3)) for i in range(n) for k in range(1, 10))
    found = callgraph.blast_radius(g, max_depth=3)
    assert rows(found, "method_fqn", "fqn", "depth") == want
    assert sum(written) == 3 * n + n < len(want)  # edges and seeds
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")].replace("BroadcastExchange", "")  # no list or pair is shuffled
    monkeypatch.setattr(traverse, "EDGES_AT_HAND", 0)  # more edges than a task may hold: the rounds of bfs
    assert rows(callgraph.blast_radius(g, max_depth=3), "method_fqn", "fqn", "depth") == want


def test_cross_service_pairs_meet_requests_once_each(plain, written):
    n, times = 12, 40
    g = small(plain, method=[method(str(i), f"m{i}") for i in range(n)], calls=calls(*[(str(i), str(j)) for i in range(n) for j in range(n) if i != j]),
              endpoint=[{"id": f"e{i}", "http_method": "GET", "path": f"/{i}", "handler_method_id": str(i), "repo_id": "r"} for i in range(n)], exposes=[{"src": "r", "dst": f"e{i}"} for i in range(n)],
              rest_call=[{"id": f"u{j}", "http_method": "GET", "url_pattern": None if j % 4 == 0 else f"/x{j % 2}", "caller_method_id": "0", "repo_id": "r"} for j in range(times)],
              unresolved_call=[{"src": str(i), "dst": f"u{j}"} for i in range(n) for j in range(times)])
    found = security.find_cross_service_taint(g, max_depth=6, with_chain=False)
    got = found.collect()
    assert len(got) == n * (n - 1) * times and {r.path_length for r in got} == {1}
    assert sum(r.sink_url_pattern is None for r in got) == len(got) // 4
    assert sum(written) == n * (n - 1) + n  # edges and seeds
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")].replace("BroadcastExchange", "")  # no list or pair is shuffled


def test_events_come_in_runs_of_one_listener(plain, tmp_path):
    import pyarrow.parquet as pq

    p, n = 1000, 60
    ids = [f"w{i}" for i in range(p)]
    g = small(plain, method=[method(w, "run") for w in ids] + [method(f"h{i}", f"on{i}", annotations=["EventListener"]) for i in range(n)] + [method("p", "publishEvent")], calls=calls(*[(w, "p") for w in ids], ("w0", "h1")))
    found = resolve.application_events(g)
    found.write.parquet(str(tmp_path / "out"))
    assert sorted(plain.read.parquet(str(tmp_path / "out")).select("src", "dst").collect()) == sorted((w, f"h{i}") for w in ids for i in range(n) if (w, i) != ("w0", 1))
    heard = [pq.read_table(f)["dst"].to_pylist() for f in (tmp_path / "out").glob("*.parquet")]
    assert sum(a != b for x in heard for a, b in zip(x, x[1:])) <= n  # before, nearly every row had another listener than the one above
