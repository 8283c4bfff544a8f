"""A code graph projected from star-schema tables.

The views are written in SQL that Spark and DuckDB read alike, so that the same
text feeds the operators and the reference SQL they are held against. Annotations
are comma lists here; each engine splits them for itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.graph import CodeGraph

#: view -> SQL; later views use earlier ones.
VIEWS: dict[str, str] = {
    "g_repo": "SELECT CAST(r_regionkey AS STRING) AS id, r_name AS name, '/src/' || lower(r_name) AS root_path FROM region",
    "g_file": """SELECT 'f' || CAST(s_suppkey AS STRING) AS id,
        '/src/' || lower(r_name) || CASE WHEN s_suppkey % 11 = 0 THEN '/test/Sup' ELSE '/main/Sup' END || CAST(s_suppkey AS STRING) || CASE s_suppkey % 4 WHEN 0 THEN '.java' WHEN 1 THEN '.kt' WHEN 2 THEN '.js' ELSE '.ts' END AS path,
        CASE s_suppkey % 4 WHEN 0 THEN 'java' WHEN 1 THEN 'kotlin' WHEN 2 THEN 'javascript' ELSE 'typescript' END AS language,
        CAST(n_regionkey AS STRING) AS repo_id, md5(s_name) AS blob_hash, CASE WHEN s_suppkey % 5 = 0 THEN 'develop' ELSE 'master' END AS branch_name, s_suppkey
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "g_size": "SELECT (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(*) FROM part) AS parts",
    "g_part": """SELECT p_partkey AS k, p_partkey * 7 % suppliers AS s, CAST(substr(p_brand, 7) AS INT) AS b, p_name, p_size FROM part CROSS JOIN g_size""",
    "g_class": """SELECT 'c' || CAST(s AS STRING) || '_' || CAST(b AS STRING) AS id, 'Brand' || CAST(b AS STRING) AS name, 'com.s' || CAST(s AS STRING) || '.Brand' || CAST(b AS STRING) AS fqn,
        g_file.id AS file_id, g_file.repo_id, b % 6 = 0 AS is_interface,
        CASE b % 5 WHEN 0 THEN 'RestController' WHEN 1 THEN 'Service,Transactional' WHEN 2 THEN 'Entity' ELSE '' END AS annotations, s, b
        FROM (SELECT DISTINCT s, b FROM g_part) x JOIN g_file ON g_file.s_suppkey = s""",
    "g_method": """SELECT CAST(k AS STRING) AS id,
        CASE k % 24 WHEN 0 THEN 'execute' WHEN 1 THEN 'executeQuery' WHEN 2 THEN 'htmlEscape' WHEN 3 THEN 'save' WHEN 4 THEN 'findById' WHEN 5 THEN 'exchange' WHEN 6 THEN 'getParameter' WHEN 7 THEN 'exec'
          WHEN 8 THEN 'doFilterInternal' WHEN 9 THEN 'publishEvent' WHEN 10 THEN 'isValid' WHEN 11 THEN '<init>' WHEN 12 THEN 'get' ELSE replace(p_name, ' ', '_') END AS name,
        c.fqn || '.m' || CAST(k AS STRING) || CASE k % 24 WHEN 0 THEN '.execute' WHEN 1 THEN '.executeQuery' WHEN 2 THEN '.htmlEscape' WHEN 3 THEN '.save' WHEN 4 THEN '.findById' WHEN 5 THEN '.exchange' WHEN 6 THEN '.getParameter' WHEN 7 THEN '.exec'
          WHEN 8 THEN '.doFilterInternal' WHEN 9 THEN '.publishEvent' WHEN 10 THEN '.isValid' WHEN 11 THEN '.<init>' WHEN 12 THEN '.axios.get' ELSE '.' || replace(p_name, ' ', '_') END AS fqn,
        c.id AS class_id, CASE WHEN k % 101 = 100 THEN 'lost' ELSE c.file_id END AS file_id, c.repo_id, CASE WHEN k % 97 = 0 THEN NULL ELSE k % 400 + 1 END AS line_start,
        CASE k % 13 WHEN 0 THEN 'RequestParam,Transactional' WHEN 1 THEN 'GetMapping' WHEN 2 THEN 'EventListener' WHEN 3 THEN 'AssertTrue' WHEN 4 THEN 'PathVariable' ELSE '' END AS annotations,
        CASE WHEN k % 31 = 30 THEN NULL ELSE k % 29 = 0 END AS generated, k % 13 = 1 OR k % 31 = 0 AS is_entry_point,
        CASE k % 9 WHEN 0 THEN 'O(n2)-candidate' WHEN 1 THEN 'recursive' WHEN 2 THEN 'recursive,n+1-risk' WHEN 3 THEN 'unbounded-query' WHEN 4 THEN 'O(n2)-list-scan,n+1-risk' WHEN 5 THEN 'odd-tag' ELSE '' END AS complexity_hint,
        CAST(k % 4 + k % 3 AS BIGINT) AS io_fanout, CAST(k % 3 AS BIGINT) AS io_parallel_count, CAST(k % 4 AS BIGINT) AS io_serial_count, CASE WHEN k % 3 > 0 THEN 'coroutine' ELSE '' END AS io_parallel_wrapper, k
        FROM g_part p JOIN g_class c ON c.s = p.s AND c.b = p.b""",
    # consecutive parts of an order, over all of lineitem: about 22 calls a method
    "g_line": "SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_partkey AS k, l_returnflag AS f FROM lineitem",
    "g_calls": """SELECT CAST(a.k AS STRING) AS src, CAST(b.k AS STRING) AS dst, min(m.name) AS callee_name,
        CAST(min(CASE a.f WHEN 'A' THEN 0 WHEN 'N' THEN -1 ELSE CASE WHEN a.k % 2 = 0 THEN -99 ELSE 0 END END) AS BIGINT) AS caller_arg_pos, CAST(min(CASE a.f WHEN 'A' THEN 0 ELSE -1 END) AS BIGINT) AS callee_param_pos
        FROM g_line a JOIN g_line b ON a.o = b.o AND b.n = a.n + 1 JOIN g_method m ON m.k = b.k WHERE a.k <> b.k GROUP BY a.k, b.k""",
    "g_endpoint": """SELECT k, 'e' || id AS id, CASE k % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS http_method,
        '/' || CASE k % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE '{lang}' END || '/' || CASE WHEN k % 5 = 0 THEN CAST(k % 1000 AS STRING) ELSE '{id}' END AS path,
        CASE WHEN k % 17 = 0 THEN '' ELSE id END AS handler_method_id, repo_id FROM g_method WHERE k % 13 = 1""",
    "g_rest": """SELECT page_id AS n, 'r' || CAST(page_id AS STRING) AS id, CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN '' ELSE 'put' END AS http_method,
        CASE WHEN page_id % 19 = 0 THEN 'DYNAMIC' ELSE url END AS url_pattern, '' AS callee_name, m.id AS caller_method_id, m.repo_id
        FROM pages CROSS JOIN g_size JOIN g_method m ON m.k = page_id * 13 % parts""",
    "g_stub": """SELECT 's' || CAST(o AS STRING) || '_' || CAST(n AS STRING) AS id, 'UNKNOWN' AS http_method, 'UNRESOLVED' AS url_pattern,
        CASE (o + n) % 7 WHEN 0 THEN 'Statement.execute' WHEN 1 THEN 'Files.readAllBytes' WHEN 2 THEN 'fetch' WHEN 3 THEN 'log.info' WHEN 4 THEN 'RestTemplate.exchange' WHEN 5 THEN 'publisher.publishEvent' ELSE 'helper' END AS callee_name,
        m.id AS caller_method_id, m.repo_id FROM (SELECT o, n, min(k) AS k FROM g_line GROUP BY o, n) x JOIN g_method m ON m.k = x.k WHERE n % 3 = 1""",
    "g_rest_call": "SELECT id, http_method, url_pattern, callee_name, caller_method_id, repo_id FROM g_rest UNION ALL SELECT * FROM g_stub",
    "g_unresolved": "SELECT caller_method_id AS src, id AS dst, 'stub' AS kind FROM g_stub UNION ALL SELECT caller_method_id AS src, id AS dst, 'rest' AS kind FROM g_rest WHERE n % 3 = 0",
    "g_exposes": "SELECT repo_id AS src, id AS dst FROM g_endpoint",
    "g_contains_class": "SELECT file_id AS src, id AS dst FROM g_class",
    "g_contains_method": "SELECT class_id AS src, id AS dst FROM g_method",
    "g_branch": "SELECT DISTINCT repo_id || ':' || branch_name AS id, branch_name AS name, repo_id FROM g_file",
    "g_has_branch": "SELECT repo_id AS src, id AS dst FROM g_branch",
    "g_depends_on": "SELECT DISTINCT a.repo_id AS src, b.repo_id AS dst FROM g_calls JOIN g_method a ON a.id = src JOIN g_method b ON b.id = dst WHERE a.repo_id <> b.repo_id AND a.k % 7 = 0",
    "g_ext_class": "SELECT 'x' || CAST(b AS STRING) AS id, 'Base' || CAST(b AS STRING) AS name, 'ext.Base' || CAST(b AS STRING) AS fqn, '' AS file_id, '__external__' AS repo_id, FALSE AS is_interface, '' AS annotations FROM (SELECT DISTINCT b FROM g_part WHERE b < 5) x",
    "g_all_class": "SELECT id, name, fqn, file_id, repo_id, is_interface, annotations FROM g_class UNION ALL SELECT * FROM g_ext_class",
    # each class extends the class of the next brand at the same supplier, some an external one
    "g_extends": """SELECT a.id AS src, b.id AS dst FROM g_class a JOIN g_class b ON a.s = b.s AND b.b = a.b % 25 + 1 WHERE a.b % 7 <> 0
        UNION ALL SELECT a.id AS src, 'x' || CAST(a.b % 5 AS STRING) AS dst FROM g_class a JOIN g_ext_class x ON x.id = 'x' || CAST(a.b % 5 AS STRING) WHERE a.b % 7 = 0""",
    "g_implements": "SELECT a.id AS src, b.id AS dst FROM g_class a JOIN g_class b ON a.s = b.s AND (b.b = a.b + 3 OR b.b = a.b + 6) WHERE b.b % 3 = 0",
    "g_entity": """SELECT 'er' || CAST(c_custkey AS STRING) AS id, a.class_id AS source_class_id, c.fqn AS target_class_fqn, 'field' || CAST(c_custkey % 10 AS STRING) AS field_name,
        CASE c_custkey % 4 WHEN 0 THEN 'OneToMany' WHEN 1 THEN 'ManyToOne' WHEN 2 THEN 'OneToOne' ELSE 'ManyToMany' END AS relation_type, CASE WHEN c_custkey % 3 = 0 THEN 'EAGER' ELSE 'LAZY' END AS fetch_type, a.repo_id
        FROM customer CROSS JOIN g_size JOIN g_method a ON a.k = c_custkey % parts JOIN g_method b ON b.k = c_custkey * 3 % parts JOIN g_class c ON c.id = b.class_id""",
    "g_has_relation": "SELECT source_class_id AS src, id AS dst FROM g_entity",
    # a load test: events of a user are requests to one method, value x 4 its milliseconds
    "g_request": "SELECT user_id % parts AS k, value * 4 AS ms, event_id FROM events CROSS JOIN g_size",
    "g_ranked": "SELECT k, ms, row_number() OVER (PARTITION BY k ORDER BY ms, event_id) AS i, count(*) OVER (PARTITION BY k) AS n FROM g_request",
    "g_perf": """SELECT 'p' || m.id AS id, CASE WHEN m.k % 3 = 0 THEN m.name ELSE m.fqn END || CASE WHEN m.k % 5 = 0 THEN CASE WHEN m.k % 4 = 0 THEN '/en/{id}' ELSE '/fr/{id}' END ELSE '' END AS endpoint_fqn,
        max(CASE WHEN i = CAST(ceil(0.5 * n) AS BIGINT) THEN ms END) AS p50_ms, max(CASE WHEN i = CAST(ceil(0.99 * n) AS BIGINT) THEN ms END) AS p99_ms, CAST(max(n) AS DOUBLE) * (4 + m.k % 40) AS rps, '' AS sample_time, 'events' AS source, m.repo_id, m.id AS method_id
        FROM g_ranked JOIN g_method m ON m.k = g_ranked.k GROUP BY m.id, m.k, m.name, m.fqn, m.repo_id""",
    "g_observed": "SELECT method_id AS src, id AS dst FROM g_perf",
    "g_calls_rest": "SELECT DISTINCT r.caller_method_id AS src, e.id AS dst FROM g_rest r JOIN g_endpoint e ON r.n % 11 = e.k % 11 AND r.n % 5 = 0",
}

SOURCES = ("region", "nation", "supplier", "part", "customer", "lineitem", "events", "pages")
_NODE = {"repo": "g_repo", "file": "g_file", "branch": "g_branch", "class": "g_all_class", "method": "g_method", "endpoint": "g_endpoint", "rest_call": "g_rest_call", "entity_relation": "g_entity", "perf_sample": "g_perf"}
_EDGE = {"calls": "g_calls", "unresolved_call": "g_unresolved", "contains_class": "g_contains_class", "contains_method": "g_contains_method", "exposes": "g_exposes", "has_branch": "g_has_branch",
         "depends_on": "g_depends_on", "extends": "g_extends", "implements": "g_implements", "has_relation": "g_has_relation", "observed_at": "g_observed", "calls_rest": "g_calls_rest"}


def needed(sql: str) -> list[str]:
    """The views that a query uses, itself or through others, in the order of VIEWS."""
    todo, seen = [sql], set()
    while todo:
        text = todo.pop()
        for v in VIEWS:
            if v not in seen and re.search(rf"\b{v}\b", text):
                seen.add(v)
                todo.append(VIEWS[v])
    return [v for v in VIEWS if v in seen]


def with_views(sql: str, recursive: bool = False) -> str:
    """The query with the views it uses as common tables; its own WITH list is merged in."""
    views = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in needed(sql))
    body = sql.strip()
    if not views:
        return body
    if m := re.match(r"WITH(\s+RECURSIVE)?\s", body):
        return f"WITH{' RECURSIVE' if recursive or m[1] else ''} {views},\n{body[m.end():]}"
    return f"WITH {views}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables in sf_dir."""
    sql = with_views(f"SELECT * FROM {name}")
    for t in SOURCES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    def table(t: str, v: str) -> DataFrame:
        df = view(spark, sf_dir, v)
        if t in ("class", "method"):
            df = df.withColumn("annotations", F.filter(F.split("annotations", ","), lambda a: a != ""))
        return df

    return CodeGraph(spark, {t: (lambda t=t, v=v: table(t, v)) for t, v in {**_NODE, **_EDGE}.items()})
