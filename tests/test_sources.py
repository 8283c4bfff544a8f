"""File formats."""

import hashlib

import pytest
from pyspark.sql import functions as F

from skein.sources import code, config, deps, diff, perf


def samples(df):
    return {r.endpoint_fqn: (r.p50_ms, r.p99_ms, r.rps) for r in df.collect()}


def put(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


def test_gatling(spark, tmp_path):
    row = lambda n, a, b: f"REQUEST\t1\t\t{n}\t{a}\t{b}\tOK\tmsg"
    p = put(tmp_path, "s.log", "\n".join(["RUN\tx", row("GetItems", 1000, 1150), row("GetItems", 1000, 1200), row("GetItems", 2000, 2300), row("PostOrder", 0, 1000), row("Bad", "x", 3), row(" ", 1, 2), "END"]))
    got = samples(perf.read_perf(spark, p))
    assert got == {"GetItems": (200.0, 300.0, pytest.approx(3 / 1.3)), "PostOrder": (1000.0, 1000.0, 1.0)}


def test_jmeter(spark, tmp_path):
    p = put(tmp_path, "r.xml", '<testResults><httpSample t="120" ts="1000" lb="GetUsers"/><httpSample t="200" ts="1500" lb="GetUsers"/><sample t="90" ts="1200" lb="GetUsers"/><sample t="500" lb="CreateOrder"/><sample t="1" ts="1"/></testResults>')
    got = samples(perf.read_perf(spark, p))
    assert got["GetUsers"] == (120.0, 200.0, pytest.approx(3 / 0.7)) and got["CreateOrder"] == (500.0, 500.0, pytest.approx(2.0))


def test_json_and_k6(spark, tmp_path):
    p = put(tmp_path, "a.json", '[{"fqn": "a.b", "p50_ms": 1, "p99_ms": 2, "rps": 3, "sample_time": "t"}, {"endpoint_fqn": "c"}, {"fqn": ""}]')
    assert samples(perf.read_perf(spark, p)) == {"a.b": (1.0, 2.0, 3.0), "c": (0.0, 0.0, 0.0)}
    p = put(tmp_path, "k.json", '{"metrics": {"http_req_duration": {"values": {"p(50)": 1, "p(99)": 9}}, "http_reqs": {"values": {"rate": 50}}, "http_req_duration{url:GET /api/items}": {"values": {"p(50)": 80, "p(99)": 310}}, "http_reqs{url:GET /api/items}": {"values": {"rate": 40}}}, "state": {"testRunDurationMs": 5}}')
    assert samples(perf.read_perf(spark, p)) == {"http_req_duration": (1.0, 9.0, 0.0), "GET /api/items": (80.0, 310.0, 40.0)}
    p = put(tmp_path, "k.csv", "metric_name,timestamp,metric_value,url,name\nhttp_req_duration,1.0,95,GET /api/items,x\nhttp_req_duration,2.5,120,GET /api/items,x\nhttp_req_duration,1,5,,n\nvus,1,1,,\n")
    assert samples(perf.read_perf(spark, p)) == {"GET /api/items": (95.0, 120.0, pytest.approx(2 / 1.5)), "n": (5.0, 5.0, 0.0)}
    with pytest.raises(ValueError):
        perf.read_perf(spark, put(tmp_path, "e.csv", "metric_name,timestamp,metric_value\nvus,1,1\n"))
    with pytest.raises(ValueError):
        perf.read_perf(spark, "x.txt")


@pytest.mark.parametrize("n", [1, 2, 9, 10, 100, 101])
def test_nearest_rank(spark, n):
    got = spark.range(1, n + 1).select(F.col("id").cast("double").alias("v")).agg(perf.nearest_rank("v", 0.5), perf.nearest_rank("v", 0.99)).first()
    rank = lambda p: max(1, -(-p * n // 100))
    assert tuple(got) == (rank(50), rank(99))


def test_dependencies(spark, tmp_path):
    dep = lambda a, v="1", s="": f"<dependency><groupId>g</groupId><artifactId>{a}</artifactId><version>{v}</version>{s}</dependency>"
    p = put(tmp_path, "pom.xml", f'<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencies>{dep("a")}{dep("b", "${v}")}{dep("t", s="<scope>test</scope>")}{dep("p", s="<scope>provided</scope>")}</dependencies></project>')
    assert sorted((r.artifact, r.version) for r in deps.read_poms(spark, p).collect()) == [("a", "1"), ("b", "${v}")]
    p = put(tmp_path, "build.gradle", "dependencies {\n  implementation 'g:a:1'\n  api(\"g:b:2\")\n\tkapt \"g:c:3\"\n  testImplementation 'g:t:1'\n  androidTestImplementation 'g:u:1'\n  implementation 'g:a:9'\n  println 'x:y:z'\n}\n")
    assert sorted((r.artifact, r.version) for r in deps.read_gradle(spark, p).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_tree(spark, tmp_path):
    for name in ("src/main/A.java", "src/main/b.kt", "web/c.tsx", "build/D.java", "a/node_modules/x.js", "src/test/T.java", "README.md"):
        put(tmp_path, name, name)
    got = {r.path: r for r in code.read_tree(spark, str(tmp_path), "r").collect()}
    assert {p: r.language for p, r in got.items()} == {"src/main/A.java": "java", "src/main/b.kt": "kotlin", "web/c.tsx": "typescript"}
    body = b"src/main/A.java"
    assert got["src/main/A.java"].blob_hash == hashlib.sha1(body).hexdigest()
    framed = {r.path: r.blob_hash for r in code.read_tree(spark, str(tmp_path), "r", git=True).collect()}
    assert framed["src/main/A.java"] == hashlib.sha1(b"blob 15\0" + body).hexdigest()


def test_pool_size(spark, tmp_path):
    assert config.read_pool_size(spark, str(tmp_path)) == 200
    put(tmp_path, "src/main/resources/application.yml", "server:\n  undertow:\n    threads: {worker: 64}\n")
    assert config.read_pool_size(spark, str(tmp_path)) == 64
    put(tmp_path, "src/main/resources/application.properties", "# c\nserver.tomcat.threads.max = x\nserver.netty.worker-count=32\n")
    assert config.read_pool_size(spark, str(tmp_path)) == 32


def test_diff(spark):
    text = "diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1,3 +1,4 @@\n a\n-b\n+c\n+d\n e\n@@ -10 +11,2 @@\n+z\n\\ No newline\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-q"
    df = spark.createDataFrame([(1, text), (2, "")], "diff_id int, text string")
    assert sorted(tuple(r) for r in diff.added_lines(df).collect()) == [(1, "x", 2, 4), (1, "x", 3, 5), (1, "x", 11, 8)]
