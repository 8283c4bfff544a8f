"""Extraction and indexing of small source trees."""

import json

import pytest

from skein import cli
from skein.graph import CodeGraph
from skein.operators import callgraph, orm, security
from skein.sources import index
from skein.sources.extract.parser import extract

JAVA = {
    "src/main/UserController.java": '''package com.x;
import com.y.Paths;
@RestController
@RequestMapping("/api/")
public class UserController extends Base<String> {
    private final UserService service;
    @GetMapping({"/users/{id}", Paths.ALL + "/x"})
    public <T> String get(@PathVariable("id") String id, Pageable pageable) {
        for (A a : b) { while (true) { repo.findById(id); list.contains(a); } }
        restTemplate.getForObject("http://svc/internal/" + id, String.class);
        helper(); service.load(id); new Order(1);
        return Outside.run(); // Gone.call()
    }
    @RequestMapping(value = "/all", method = RequestMethod.POST)
    void helper() { helper(); }
}''',
    "src/main/Paths.java": 'package com.y;\npublic interface Marker {}\npublic class Paths { public static final String ALL = "/every"; }',
    "src/main/UserService.java": "package com.x;\npublic interface UserService { String load(String id); }",
    "src/main/UserServiceImpl.java": "package com.x;\n@Service\npublic class UserServiceImpl implements UserService {\n  public String load(String id) { return stmt.execute(id); }\n}",
    "src/main/Order.java": '''package com.x;
@Entity
@Data
public class Order {
    public Order(int n) {}
    @ManyToOne(fetch = FetchType.EAGER) private Customer customer;
    @OneToMany(mappedBy = "o") private List<Item> items;
    abstract String getName();
    String toText() { return "a { } b"; }
}
class Customer { enum Kind { A(1) { void f() {} }, B; int v() { return 1; } } }''',
}


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in JAVA.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    out = str(tmp_path_factory.mktemp("graph"))
    index.index_repo(spark, str(root), "shop").write(out)
    g = CodeGraph.read(spark, out)
    g.path = out
    return g


def names(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_nodes(g):
    assert names(g["class"].filter("repo_id <> '__external__'"), "name") == [(n,) for n in ("Customer", "Kind", "Marker", "Order", "Paths", "UserController", "UserService", "UserServiceImpl")]
    m = {r.fqn: r for r in g.method.collect()}
    got = m["com.x.UserController.get"]
    assert got.complexity_hint == "O(n2)-candidate,O(n2)-list-scan,n+1-risk" and got.is_entry_point and got.line_start == 8
    assert m["com.x.UserController.helper"].complexity_hint == "recursive"
    assert m["com.x.Order.getName"].generated and not m["com.x.Order.toText"].generated and m["com.x.Order.<init>"].generated
    assert (got.io_fanout, got.io_serial_count, got.io_parallel_wrapper) == (2, 2, "")


def test_endpoints_and_requests(g):
    assert names(g.endpoint, "http_method", "path") == [("GET", "/api/every/x"), ("GET", "/api/users/{id}"), ("POST", "/api/all")]
    assert names(g.rest_call.filter("url_pattern <> 'UNRESOLVED'"), "http_method", "url_pattern") == [("GET", "http://svc/internal/{id}")]
    assert names(callgraph.list_endpoints(g, "shop"), "handler_fqn")[0] == ("com.x.UserController.get",)


def test_calls(g):
    out = names(callgraph.find_callees(g, "com.x.UserController.get"), "fqn")
    assert out == [("com.x.Order.<init>",), ("com.x.UserController.helper",), ("com.x.UserServiceImpl.load",)] or out == [("com.x.Order.<init>",), ("com.x.UserController.helper",), ("com.x.UserService.load",), ("com.x.UserServiceImpl.load",)]
    stubs = {r.callee_name for r in callgraph.list_unresolved_calls(g).collect()}
    assert {"Outside.run", "repo.findById", "stmt.execute"} <= stubs and not any("Gone" in s for s in stubs)
    assert ("com.x.UserServiceImpl.load", "stmt.execute") in names(security.find_reachable_sinks(g), "caller_fqn", "sink_method")


def test_inheritance_and_entities(g):
    assert names(callgraph.find_implementations(g, "com.x.UserService"), "class_fqn") == [("com.x.UserServiceImpl",)]
    assert names(g["class"].filter("repo_id = '__external__'"), "fqn") == [("com.x.Base",)]
    assert names(orm.list_entity_relations(g), "field_name", "relation_type", "fetch_type", "target_class_fqn") == [("customer", "ManyToOne", "EAGER", "com.x.Customer"), ("items", "OneToMany", "LAZY", "com.x.Item")]




def test_cli(spark, g, capsys):
    assert cli.main(["query", g.path, "find_callers", "method_fqn=com.x.UserController.helper"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert {r["fqn"] for r in rows} == {"com.x.UserController.get"}
    assert "blast_radius" in cli.QUERIES and "find_hotspots" in cli.QUERIES


def facts(path, source, language, kind):
    return [f for k, f in extract(path, source, language) if k == kind]


def test_kotlin():
    k = '''package com.k
import a.b.C
@Service
data class Svc(private val repo: Repo, val n: Int = 3) : Base(1), Face {
    companion object { const val P = "/k" }
    @GetMapping("/users/{id}")
    suspend fun getUser(id: String): String = repo.load(id)!!.name
    fun other() { coroutineScope { async { repo.save(x) } } }
}
fun top(a: Int) = helper(a)
object Single : Face { fun go() { Svc(1) } }'''
    assert [(p["parent"], p["kind"]) for p in facts("p/my.kt", k, "kotlin", "parent")] == [("Base", "extends"), ("Face", "implements"), ("Face", "implements")]
    m = {f["name"]: f for f in facts("p/my.kt", k, "kotlin", "method")}
    assert m["getUser"]["is_suspend"] and m["component2"]["generated"] and m["top"]["class_fqn"] == "com.k.MyKt"
    assert (m["other"]["io_parallel_count"], m["other"]["io_parallel_wrapper"]) == (1, "coroutine")
    assert [f["value"] for f in facts("p/my.kt", k, "kotlin", "constant")] == ["/k"]
    assert ("Svc", "<init>") in [(s["receiver"], s["callee"]) for s in facts("p/my.kt", k, "kotlin", "site")]


def test_scripts():
    s = '''import { a } from './lib';
export async function GET(req) { await fetch('/u', {method: 'post'}); return axios.get(`/q`); }
const helper = (x) => { return a(x); };
class K extends Base { constructor() { super(); } run(a) { this.go(a); } }
app.all('/users/:id', (req, res) => { res.send(1); });'''
    p = "web/app/api/users/[id]/route.ts"
    assert sorted((e["http_method"], e["parts"][0]) for e in facts(p, s, "typescript", "endpoint")) == [("GET", "/api/users/{id}"), ("GET", "/users/:id")]
    assert [(r["http_method"], r["url_pattern"]) for r in facts(p, s, "typescript", "rest")] == [("POST", "/u"), ("GET", "/q")]
    assert [m["name"] for m in facts(p, s, "typescript", "method")] == ["GET", "helper", "<init>", "run"]


@pytest.mark.parametrize("text", ["", "class", "class A {", "}}}", "@", "class A { int f(", "fun", "/* open", '"open', "enum E { A", "package", "import", "interface I<T extends X<Y> { void a(); }", "const x = ", "@A(", "x\0y"])
def test_broken_sources_do_not_stop(text):
    for language in ("java", "kotlin", "javascript", "typescript"):
        extract("p/x.y", text, language)


def test_stream(spark, tmp_path):
    from skein.streaming import perf

    (tmp_path / "in").mkdir()
    rows = [{"endpoint_fqn": "a", "ts": f"2024-01-01T00:0{m}:{s:02d}Z", "elapsed_ms": float(s)} for m in (0, 1) for s in range(0, 60, 10)] + [{"endpoint_fqn": "z", "ts": "2024-01-01T01:00:00Z", "elapsed_ms": 1.0}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    q = perf.ingest_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r.endpoint_fqn, r.n, r.p50_ms, r.p99_ms, r.rps) for r in got] == [("a", 6, 20.0, 50.0, 0.1)] * 2


INHERITED = {
    "a/Z.java": "package p;\npublic class Z { void shared() {} void foo() {} }",
    "a/B.java": "package p;\npublic class B extends Z { void foo() { super.foo(); shared(); super.none(); } }",
    "a/A.java": "package p;\npublic class A { void foo() {} void none() {} }",
    "a/User.java": """package p;
public class User {
    private B helper;
    void go() { helper.shared(); helper.foo(); }
    void call(long id) {
        String url = UriComponentsBuilder.fromHttpUrl("http://svc").path("/users").path("/all").toUriString();
        restTemplate.getForObject(url, String.class);
        restTemplate.getForObject(UriComponentsBuilder.fromUriString("/inline").toUriString(), String.class);
        restTemplate.getForObject(Urls.BASE + "/x", String.class);
        restTemplate.getForObject(Urls.GONE + "/x", String.class);
        restTemplate.getForObject(id, String.class);
    }
}""",
    "a/Urls.java": 'package p;\npublic class Urls { public static final String BASE = "http://h/base"; }',
    "a/K.kt": "package k\nclass K {\n  fun b(x: Int) = x\n  fun all(xs: List<Int>) { xs.map(this::b)\n    xs.forEach(::c) }\n}\nfun c(x: Int) = x\n",
}


def test_inherited_methods_references_and_urls(spark, tmp_path):
    for name, text in INHERITED.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    g = index.index_repo(spark, str(tmp_path), "kin")
    fqn = {r.id: r.fqn for r in g.method.select("id", "fqn").collect()}
    edges = {(fqn[r.src], fqn[r.dst]) for r in g.calls.collect()}
    assert {("p.B.foo", "p.Z.foo"), ("p.B.foo", "p.Z.shared"), ("p.User.go", "p.Z.shared"), ("p.User.go", "p.B.foo"), ("k.K.all", "k.K.b"), ("k.K.all", "k.KKt.c")} <= edges
    assert not {("p.B.foo", "p.A.foo"), ("p.B.foo", "p.A.none"), ("p.User.go", "p.A.foo"), ("p.User.go", "p.Z.foo")} & edges
    assert "super.none" in {r.callee_name for r in g.rest_call.collect()}
    urls = sorted(r.url_pattern for r in g.rest_call.filter("url_pattern <> 'UNRESOLVED'").collect())
    assert urls == ["/inline", "DYNAMIC", "DYNAMIC", "http://h/base/x", "http://svc/users/all"]
