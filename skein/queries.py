"""Registered queries over the projected graph, and reference SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import testdata
from skein.functions import patterns
from skein.functions.patterns import SecurityConfig
from skein.graph import CodeGraph, union_all
from skein.operators import callgraph, license, orm, perf, resolve, security
from skein.sources import perf as perf_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    """Registers a function of the graph (or of spark and sf_dir, see `raw`) with its reference SQL."""

    def add(f):
        key = name or f.__name__
        if getattr(f, "raw", False):
            QUERIES[key] = f
        else:
            QUERIES[key] = lambda spark, sf_dir: f(testdata.graph(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = testdata.with_views(sql)
        return f

    return add


def _raw(f):
    f.raw = True
    return f


def _flat(df: DataFrame, *columns: str, sep: str = ">") -> DataFrame:
    """Array columns as strings, so that every engine hashes them alike."""
    return df.withColumns({c: F.concat_ws(sep, c) for c in columns})


# --- SQL fragments -----------------------------------------------------------

def _in(names) -> str:
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


def _match(col: str, pats, whole=patterns.ENDSWITH_ONLY) -> str:
    short = sorted({p.rsplit(".", 1)[-1] for p in pats if p not in whole})
    ends = " OR ".join(f"ends_with({col}, '{p}')" for p in pats)
    return f"coalesce(split_part({col}, '.', -1) IN {_in(short)} OR {ends}, false)"


def _sink(col: str) -> str:
    return _match(col, patterns.SINK_METHODS)


def _source(col: str) -> str:
    return _match(col, patterns.SOURCE_METHODS)


def _annotated(col: str) -> str:
    return f"len(list_filter(string_split({col}, ','), lambda a: a IN {_in(patterns.SOURCE_ANNOTATIONS)} OR " + " OR ".join(f"ends_with(a, '{p}')" for p in patterns.SOURCE_ANNOTATIONS) + ")) > 0"


def _case(col: str, table: dict, other: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


_METHODS = "located AS (SELECT m.*, f.path AS file_path, r.name AS repo_name FROM g_method m JOIN g_file f ON f.id = m.file_id JOIN g_repo r ON r.id = m.repo_id)"
_SINKS = f"""{_METHODS},
sinks AS (
  SELECT l.repo_name, l.repo_id, l.id AS caller_id, l.fqn AS caller_fqn, r.callee_name AS sink_method, l.file_path, l.line_start, 'custom' AS sink_category, -1 AS caller_arg_pos, -1 AS callee_param_pos
  FROM g_unresolved u JOIN g_rest_call r ON r.id = u.dst JOIN located l ON l.id = u.src WHERE {_sink('r.callee_name')}
  UNION ALL
  SELECT l.repo_name, l.repo_id, l.id, l.fqn, s.fqn, l.file_path, l.line_start, 'configured', c.caller_arg_pos, c.callee_param_pos
  FROM g_calls c JOIN located l ON l.id = c.src JOIN g_method s ON s.id = c.dst WHERE {_sink('s.fqn')} OR {_sink('s.name')})"""
_REACH = """seeds AS (SELECT id, repo_id FROM g_method WHERE is_entry_point UNION SELECT m.id, m.repo_id FROM g_exposes x JOIN g_endpoint e ON e.id = x.dst JOIN g_method m ON m.id = e.handler_method_id AND m.repo_id = x.src),
inrepo AS (SELECT a.id AS src, b.id AS dst FROM g_calls c JOIN g_method a ON a.id = c.src JOIN g_method b ON b.id = c.dst WHERE a.repo_id = b.repo_id),
reach(node) AS (SELECT id FROM seeds UNION SELECT dst FROM reach JOIN inrepo ON src = node)"""


# --- call graph --------------------------------------------------------------

@_query("""SELECT d.fqn AS method_fqn, s.fqn, f.path AS file_path, s.line_start FROM g_calls c JOIN g_method s ON s.id = c.src JOIN g_method d ON d.id = c.dst JOIN g_file f ON f.id = s.file_id""")
def q01_find_callers(g: CodeGraph) -> DataFrame:
    return callgraph.find_callers(g)


@_query("""SELECT s.fqn AS method_fqn, d.fqn, f.path AS file_path, d.line_start FROM g_calls c JOIN g_method s ON s.id = c.src JOIN g_method d ON d.id = c.dst JOIN g_file f ON f.id = d.file_id
WHERE c.caller_arg_pos <> -99 AND d.generated = false""")
def q02_find_callees(g: CodeGraph) -> DataFrame:
    return callgraph.find_callees(g, exclude_generated=True)


@_query("""WITH h AS (SELECT e.http_method, e.path, m.id, m.fqn, f.path AS file_path, m.line_start FROM g_endpoint e JOIN g_method m ON m.id = e.handler_method_id LEFT JOIN g_file f ON f.id = m.file_id)
SELECT http_method, path, 'handler' AS role, fqn, file_path, line_start FROM h WHERE file_path IS NOT NULL
UNION ALL SELECT h.http_method, h.path, 'caller', s.fqn, f.path, s.line_start FROM h JOIN g_calls c ON c.dst = h.id JOIN g_method s ON s.id = c.src JOIN g_file f ON f.id = s.file_id""")
def q03_find_endpoint_callers(g: CodeGraph) -> DataFrame:
    return callgraph.find_endpoint_callers(g)


@_query("SELECT a.name AS repo_name, b.name FROM g_depends_on d JOIN g_repo a ON a.id = d.src JOIN g_repo b ON b.id = d.dst")
def q04_find_repo_dependencies(g: CodeGraph) -> DataFrame:
    return callgraph.find_repo_dependencies(g)


_UP = "up AS (SELECT DISTINCT d.fqn AS src, s.fqn AS dst, f.path AS file_path FROM g_calls c JOIN g_method s ON s.id = c.src JOIN g_method d ON d.id = c.dst JOIN g_file f ON f.id = s.file_id WHERE c.caller_arg_pos <> -99)"


@_query(f"""WITH RECURSIVE {_UP},
b(seed, node, depth) AS (SELECT src, dst, 1 FROM up UNION SELECT seed, dst, depth + 1 FROM b JOIN up ON src = node WHERE depth < 3)
SELECT seed AS method_fqn, node AS fqn, (SELECT min(file_path) FROM up WHERE dst = node) AS file_path, min(depth) AS depth FROM b GROUP BY seed, node""")
def q05_blast_radius(g: CodeGraph) -> DataFrame:
    return callgraph.blast_radius(g, max_depth=3)


@_query("""WITH x AS (SELECT 'class' AS kind, name, fqn, file_id, 0 AS line_start FROM g_all_class UNION ALL SELECT 'method', name, fqn, file_id, line_start FROM g_method),
y AS (SELECT kind, name, fqn, path AS file_path, line_start, row_number() OVER (PARTITION BY kind ORDER BY fqn, path) AS i FROM x JOIN g_file f ON f.id = file_id WHERE contains(lower(name), 'an'))
SELECT kind, name, fqn, file_path, line_start FROM y WHERE i <= 50""")
def q06_search_symbol(g: CodeGraph) -> DataFrame:
    return callgraph.search_symbol(g, "aN")[0]


@_query("""WITH x AS (SELECT 'class' AS kind, name FROM g_all_class UNION ALL SELECT 'method', name FROM g_method)
SELECT count(*) AS total_count, count(*) FILTER (kind = 'class') AS total_class_count, count(*) FILTER (kind = 'method') AS total_method_count,
  count(*) FILTER (kind = 'class') > 50 OR count(*) FILTER (kind = 'method') > 50 AS is_truncated FROM x WHERE contains(lower(name), 'an')""")
def q06_search_symbol_counts(g: CodeGraph) -> DataFrame:
    return callgraph.search_symbol(g, "aN")[1]


@_query("""WITH x AS (SELECT fqn, file_id, line_start, 0 AS p, id FROM g_method UNION ALL SELECT fqn, file_id, 0, 1, id FROM g_all_class),
y AS (SELECT x.*, f.path, row_number() OVER (PARTITION BY fqn ORDER BY p, x.id) AS i FROM x JOIN g_file f ON f.id = file_id)
SELECT fqn, path AS file_path, line_start FROM y WHERE i = 1""")
def q07_get_file_location(g: CodeGraph) -> DataFrame:
    return callgraph.get_file_location(g)


@_query("SELECT e.http_method, e.path, m.fqn AS handler_fqn, r.name AS repo_name FROM g_endpoint e JOIN g_method m ON m.id = e.handler_method_id JOIN g_repo r ON r.id = e.repo_id")
def q08_list_endpoints(g: CodeGraph) -> DataFrame:
    return callgraph.list_endpoints(g)


@_query("""SELECT c.url_pattern, c.http_method, c.callee_name, m.fqn AS caller_fqn, r.name AS repo_name FROM g_unresolved u JOIN g_rest_call c ON c.id = u.dst JOIN g_method m ON m.id = u.src JOIN g_repo r ON r.id = m.repo_id WHERE u.kind = 'stub'""")
def q09_list_unresolved_calls(g: CodeGraph) -> DataFrame:
    return callgraph.list_unresolved_calls(g)


@_query("""SELECT r.name, r.root_path, (SELECT count(DISTINCT id) FROM g_method m WHERE m.repo_id = r.id) AS method_count, (SELECT count(DISTINCT dst) FROM g_exposes x WHERE x.src = r.id) AS endpoint_count FROM g_repo r""")
def q10_list_repos(g: CodeGraph) -> DataFrame:
    return callgraph.list_repos(g)


@_query("SELECT r.name AS repo_name, b.name AS branch_name FROM g_has_branch h JOIN g_repo r ON r.id = h.src JOIN g_branch b ON b.id = h.dst")
def q11_list_branches(g: CodeGraph) -> DataFrame:
    return callgraph.list_branches(g)


_BELOW = "SELECT interface_fqn, c.fqn AS class_fqn, c.name AS class_name, f.path AS file_path, r.name AS repo_name FROM {x} JOIN g_all_class c ON c.id = node JOIN g_file f ON f.id = c.file_id JOIN g_repo r ON r.id = c.repo_id"
_DOWN = "d(interface_fqn, node, n) AS (SELECT c.fqn, i.src, 1 FROM g_implements i JOIN g_all_class c ON c.id = i.dst UNION ALL SELECT interface_fqn, i.src, n + 1 FROM d JOIN g_implements i ON i.dst = node WHERE n < 10)"


@_query(f"WITH RECURSIVE {_DOWN} " + _BELOW.format(x="d"))
def q12_find_implementations(g: CodeGraph) -> DataFrame:
    return callgraph.find_implementations(g)


@_query(f"WITH RECURSIVE {_DOWN}, e AS (SELECT DISTINCT interface_fqn, node FROM d) " + _BELOW.format(x="e"))
def q12_find_implementations_distinct(g: CodeGraph) -> DataFrame:
    return callgraph.find_implementations(g, distinct=True)


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT a.fqn AS src, b.fqn AS dst, r.name AS repo_name FROM g_extends x JOIN g_all_class a ON a.id = x.src JOIN g_all_class b ON b.id = x.dst JOIN g_repo r ON r.id = b.repo_id),
u(seed, node, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT seed, dst, depth + 1 FROM u JOIN e ON src = node WHERE depth < 10)
SELECT seed AS start_fqn, node AS class_fqn, min(depth) AS depth, (SELECT min(repo_name) FROM e WHERE dst = node) AS repo_name FROM u GROUP BY seed, node""")
def q13_find_superclasses(g: CodeGraph) -> DataFrame:
    return callgraph.find_superclasses(g)


@_query("""SELECT repo_name, caller_fqn, callee_name, count(*) AS call_count FROM (
SELECT r.name AS repo_name, a.fqn AS caller_fqn, b.name AS callee_name FROM g_calls c JOIN g_method a ON a.id = c.src JOIN g_method b ON b.id = c.dst JOIN g_repo r ON r.id = a.repo_id WHERE a.repo_id <> b.repo_id
UNION ALL SELECT r.name, a.fqn, x.callee_name FROM g_unresolved u JOIN g_method a ON a.id = u.src JOIN g_rest_call x ON x.id = u.dst JOIN g_repo r ON r.id = a.repo_id) t GROUP BY ALL""")
def q14_find_external_calls(g: CodeGraph) -> DataFrame:
    return callgraph.find_external_calls(g)


@_query("SELECT e.http_method, e.path, m.fqn AS handler_fqn, r.name AS repo_name FROM g_endpoint e JOIN g_method m ON m.id = e.handler_method_id JOIN g_repo r ON r.id = e.repo_id ORDER BY 4, 1, 2, 3")
def q16_endpoints_view(g: CodeGraph) -> DataFrame:
    return callgraph.endpoints_view(g)


@_query("""WITH k AS (SELECT 'extends' AS etype, src, dst FROM g_extends UNION ALL SELECT 'implements', src, dst FROM g_implements)
SELECT a.id AS src, b.id AS dst, count(*) AS weight, 'class_call' AS etype FROM g_calls c JOIN g_method x ON x.id = c.src JOIN g_method y ON y.id = c.dst JOIN g_class a ON a.id = x.class_id JOIN g_class b ON b.id = y.class_id WHERE a.repo_id = b.repo_id AND a.id <> b.id GROUP BY a.id, b.id
UNION ALL SELECT DISTINCT c.src, c.dst, 1, 'method_call' FROM g_calls c JOIN g_method x ON x.id = c.src JOIN g_method y ON y.id = c.dst WHERE x.repo_id = y.repo_id
UNION ALL SELECT x.class_id, '__ext__' || coalesce(nullif(r.callee_name, ''), 'unknown'), count(*), 'ext_call' FROM g_unresolved u JOIN g_method x ON x.id = u.src JOIN g_rest_call r ON r.id = u.dst GROUP BY 1, 2
UNION ALL SELECT k.src, k.dst, 1, etype FROM k JOIN g_class c ON c.id = k.src
UNION ALL SELECT h.src, t.id, 1, 'jpa_' || lower(e.relation_type) FROM g_entity e JOIN g_has_relation h ON h.dst = e.id JOIN g_all_class t ON t.fqn = e.target_class_fqn""")
def q17_graph_edges(g: CodeGraph) -> DataFrame:
    return callgraph.graph_nodes_edges(g)[1]


@_query("""WITH cc AS (SELECT a.id AS src, count(*) AS w FROM g_calls c JOIN g_method x ON x.id = c.src JOIN g_method y ON y.id = c.dst JOIN g_class a ON a.id = x.class_id JOIN g_class b ON b.id = y.class_id WHERE a.repo_id = b.repo_id AND a.id <> b.id GROUP BY a.id),
k AS (SELECT src, dst FROM g_extends UNION ALL SELECT src, dst FROM g_implements), ends AS (SELECT src AS id FROM k UNION ALL SELECT dst FROM k),
mc AS (SELECT c.src, count(DISTINCT c.dst) AS w FROM g_calls c JOIN g_method x ON x.id = c.src JOIN g_method y ON y.id = c.dst WHERE x.repo_id = y.repo_id GROUP BY c.src)
SELECT c.id, c.name AS label, c.fqn, CASE WHEN is_interface THEN 'interface' ELSE 'class' END AS kind, CAST(coalesce(cc.w, 0) + (SELECT count(*) FROM ends WHERE ends.id = c.id) AS BIGINT) AS degree, '' AS parent_id, contains(lower(f.path), '/test/') AS is_test
FROM g_class c JOIN g_file f ON f.id = c.file_id LEFT JOIN cc ON cc.src = c.id
UNION ALL SELECT m.id, m.name, m.fqn, 'method', coalesce(mc.w, 0), m.class_id, contains(lower(f.path), '/test/') FROM g_method m JOIN g_class c ON c.id = m.class_id JOIN g_file f ON f.id = c.file_id LEFT JOIN mc ON mc.src = m.id
UNION ALL SELECT DISTINCT '__ext__' || n, n, '[external] ' || n, 'external', 0, '', false FROM (SELECT coalesce(nullif(r.callee_name, ''), 'unknown') AS n FROM g_unresolved u JOIN g_method x ON x.id = u.src JOIN g_rest_call r ON r.id = u.dst) z""")
def q17_graph_nodes(g: CodeGraph) -> DataFrame:
    return callgraph.graph_nodes_edges(g)[0]


@_query(f"""WITH RECURSIVE {_UP}, changed AS (SELECT fqn FROM g_method WHERE name = 'save'),
b(node, depth) AS (SELECT fqn, 0 FROM changed UNION SELECT dst, depth + 1 FROM b JOIN up ON src = node WHERE depth < 5)
SELECT e.http_method, e.path, m.fqn AS handler_fqn, r.name AS repo_name FROM g_endpoint e JOIN g_method m ON m.id = e.handler_method_id JOIN g_repo r ON r.id = e.repo_id WHERE m.fqn IN (SELECT node FROM b)""")
def q18_impacted_endpoints(g: CodeGraph) -> DataFrame:
    return callgraph.impacted_endpoints(g, g.method.filter("name = 'save'").select("fqn"), 5)  # the changed methods of one diff


# --- entities ----------------------------------------------------------------

_REL = "SELECT r.name AS repo_name, c.fqn AS source_class_fqn, e.field_name, e.relation_type, {x}e.target_class_fqn FROM g_has_relation h JOIN g_entity e ON e.id = h.dst JOIN g_all_class c ON c.id = h.src JOIN g_repo r ON r.id = c.repo_id"


@_query(_REL.format(x="e.fetch_type, "))
def q19_list_entity_relations(g: CodeGraph) -> DataFrame:
    return orm.list_entity_relations(g)


@_query(_REL.format(x="") + " WHERE e.fetch_type = 'EAGER'")
def q20_find_eager_fetches(g: CodeGraph) -> DataFrame:
    return orm.find_eager_fetches(g)


# --- security ----------------------------------------------------------------

@_query(f"WITH {_SINKS} SELECT repo_name, caller_fqn, sink_method, file_path, line_start, sink_category, caller_arg_pos, callee_param_pos FROM sinks")
def q21_find_taint_sinks(g: CodeGraph) -> DataFrame:
    return security.find_taint_sinks(g)


_SRC = f"""src AS (SELECT id FROM located WHERE {_annotated('annotations')} UNION SELECT l.id FROM g_calls c JOIN located l ON l.id = c.src JOIN g_method s ON s.id = c.dst WHERE {_source('s.fqn')} OR {_source('s.name')})"""


@_query(f"""WITH {_METHODS}, {_SRC} SELECT l.repo_name, l.fqn AS source_method_fqn, s.fqn AS sink_method_name, c.caller_arg_pos, c.callee_param_pos, l.file_path, l.line_start, {_case('s.name', patterns.OWASP, patterns.OWASP_OTHER)} AS owasp_category
FROM src JOIN located l ON l.id = src.id JOIN g_calls c ON c.src = l.id JOIN g_method s ON s.id = c.dst WHERE c.caller_arg_pos = 0 AND ({_sink('s.fqn')} OR {_sink('s.name')})""")
def q22_find_taint_flows(g: CodeGraph) -> DataFrame:
    return security.find_taint_flows(g)


@_query(f"""WITH RECURSIVE {_METHODS},
marked AS (SELECT id, fqn, list_filter(string_split(annotations, ','), lambda a: a IN {_in(patterns.SOURCE_ANNOTATIONS)}) AS ann, file_path, coalesce(line_start, 0) AS line_start FROM located WHERE {_annotated('annotations')}),
calling AS (SELECT DISTINCT a.id, a.fqn FROM g_calls c JOIN g_method a ON a.id = c.src JOIN g_method b ON b.id = c.dst WHERE (a.repo_id = b.repo_id AND {_source('b.fqn')}) OR {_source('c.callee_name')}),
start AS (SELECT * FROM marked UNION ALL SELECT id, fqn, [], '', 0 FROM calling WHERE id NOT IN (SELECT id FROM marked)),
e AS (SELECT DISTINCT a.id AS src, b.id AS dst, b.fqn FROM g_calls c JOIN g_method a ON a.id = c.src JOIN g_method b ON b.id = c.dst WHERE a.repo_id = b.repo_id AND NOT {_match('b.fqn', patterns.SANITIZER_METHODS, ())}),
p(s, node, chain) AS (SELECT id, id, [fqn] FROM start UNION ALL SELECT s, dst, list_append(chain, fqn) FROM p JOIN e ON src = node WHERE len(chain) <= 5 AND NOT list_contains(chain, fqn))
SELECT r.name AS repo_name, x.fqn AS source_method_fqn, array_to_string(x.ann, '>') AS source_annotations, m.fqn AS sink_method_fqn, {_case("split_part(m.fqn, '.', -1)", patterns.OWASP, patterns.OWASP_OTHER)} AS sink_type, len(chain) - 1 AS path_length,
  array_to_string(chain, '>') AS call_chain, false AS sanitizer_pruned, x.file_path, x.line_start
FROM p JOIN g_method m ON m.id = node JOIN start x ON x.id = p.s JOIN g_repo r ON r.id = m.repo_id WHERE len(chain) > 1 AND {_sink('m.fqn')}""")
def q23_find_taint_paths(g: CodeGraph) -> DataFrame:
    return _flat(security.find_taint_paths(g), "source_annotations", "call_chain")


@_query(f"""WITH RECURSIVE h AS (SELECT m.id, m.fqn, m.repo_id, min(e.http_method || ' ' || e.path) AS ep FROM g_exposes x JOIN g_endpoint e ON e.id = x.dst JOIN g_method m ON m.id = e.handler_method_id AND m.repo_id = x.src GROUP BY ALL),
inrepo AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM g_calls c JOIN g_method a ON a.id = c.src JOIN g_method b ON b.id = c.dst WHERE a.repo_id = b.repo_id),
w(s, node, n) AS (SELECT id, id, 0 FROM h UNION SELECT s, dst, n + 1 FROM w JOIN inrepo ON src = node WHERE n < 6),
near AS (SELECT s, node, min(n) AS n FROM w GROUP BY s, node),
out AS (SELECT u.src, r.url_pattern AS url, r.http_method AS verb FROM g_unresolved u JOIN g_rest_call r ON r.id = u.dst UNION ALL SELECT c.src, e.path, e.http_method FROM g_calls_rest c JOIN g_endpoint e ON e.id = c.dst)
SELECT r.name AS repo_name, h.fqn AS source_handler_fqn, h.ep AS source_endpoint, m.fqn AS sink_method_fqn, url AS sink_url_pattern, verb AS sink_http_method, near.n AS path_length
FROM near JOIN h ON h.id = near.s JOIN out ON out.src = near.node JOIN g_method m ON m.id = near.node JOIN g_repo r ON r.id = h.repo_id WHERE near.n > 0""")
def q24_find_cross_service_taint(g: CodeGraph) -> DataFrame:
    return security.find_cross_service_taint(g, with_chain=False)


_CLS = "regexp_replace(a.fqn, '\\.?[^.]*$', '')"


@_query(f"""WITH {_METHODS}, x AS (SELECT a.fqn, a.repo_id, b.name AS callee, {_CLS} AS cls FROM g_calls c JOIN g_method a ON a.id = c.src JOIN g_method b ON b.id = c.dst),
w AS (SELECT repo_id, fqn, cls, split_part(cls, '.', -1) AS short, max(callee) AS callee FROM x WHERE callee IN {_in(security.WRITE_NAMES)} AND cls <> '' GROUP BY ALL),
r AS (SELECT repo_id, fqn, cls, split_part(cls, '.', -1) AS short, max(callee) AS callee FROM x WHERE callee IN {_in(security.READ_NAMES)} AND cls <> '' GROUP BY ALL)
SELECT p.name AS repo_name, w.cls AS entity_fqn, w.fqn AS write_method_fqn, w.callee AS write_callee, r.fqn AS read_method_fqn, r.callee AS read_callee, coalesce((SELECT min(file_path) FROM located l WHERE l.fqn = r.fqn), '') AS read_file_path,
CASE WHEN w.cls = r.cls THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level FROM w JOIN r ON w.repo_id = r.repo_id AND w.fqn <> r.fqn AND (contains(r.cls, w.short) OR contains(w.cls, r.short)) JOIN g_repo p ON p.id = w.repo_id""")
def q25_find_second_order_injection(g: CodeGraph) -> DataFrame:
    return security.find_second_order_injection(g)


_SHORT = "split_part(sink_method, '.', -1)"
_CWE = _case(_SHORT, patterns.CWE, patterns.CWE_OTHER)
for _kind, _sql in (("owasp", _case(_SHORT, patterns.OWASP, patterns.OWASP_OTHER)), ("cwe", _CWE), ("pci", _case(f"({_CWE})", patterns.PCI, patterns.PCI_OTHER)), ("stig", _case(f"({_CWE})", patterns.STIG, patterns.STIG_OTHER))):
    _query(f"WITH {_SINKS} SELECT repo_name, {_sql} AS category, caller_fqn, sink_method, file_path, line_start FROM sinks", f"q26_security_report_{_kind}")(
        lambda g, k=_kind: security.generate_security_report(g, framework=k))


@_query(f"WITH {_METHODS} SELECT repo_name, fqn, file_path, line_start, replace(annotations, ',', '>') AS annotations FROM located WHERE is_entry_point")
def q27_find_entry_points(g: CodeGraph) -> DataFrame:
    return _flat(security.find_entry_points(g), "annotations")


@_query(f"WITH RECURSIVE {_SINKS}, {_REACH} SELECT repo_name, caller_fqn, sink_method, file_path, line_start, sink_category FROM sinks WHERE caller_id IN (SELECT node FROM reach)")
def q28_find_reachable_sinks(g: CodeGraph) -> DataFrame:
    return security.find_reachable_sinks(g)


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{p}', {str(p in patterns.ENDSWITH_ONLY and k in ('source_methods', 'sink_methods')).lower()})" for k in ("source_annotations", "source_methods", "sink_methods", "sanitizer_methods") for p in getattr(SecurityConfig(), k)) + ") t(kind, pattern, whole)")
def q29_list_security_config(g: CodeGraph) -> DataFrame:
    return SecurityConfig().table(g.spark)


_OW = f"regexp_replace({_case(_SHORT, patterns.OWASP, patterns.OWASP_OTHER)}, '-.*$', '')"
_FIND = f"""WITH RECURSIVE {_SINKS}, {_REACH}, s AS (SELECT *, {_OW} AS owasp FROM sinks WHERE {{where}}),
f AS (SELECT repo_name, 'taint_sink' AS type, CASE WHEN owasp IN ('A01:2021', 'A03:2021') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, owasp AS category, caller_fqn AS method_fqn, file_path, line_start, 'Call to sink: ' || sink_method AS detail, owasp, CAST(NULL AS VARCHAR) AS complexity_hint FROM s
UNION ALL SELECT repo_name, 'complexity_hint', CASE WHEN contains(complexity_hint, 'O(n2)') OR contains(complexity_hint, 'n+1-risk') THEN 'HIGH' WHEN complexity_hint = 'recursive' THEN 'LOW' ELSE 'MEDIUM' END, 'Performance', fqn, file_path, line_start, complexity_hint, NULL, complexity_hint FROM located WHERE complexity_hint <> '')
SELECT DISTINCT *, CAST(NULL AS DOUBLE) AS p99_ms FROM f WHERE severity IN {{severity}}"""


@_query(_FIND.format(where="true", severity="('HIGH', 'MEDIUM', 'LOW')"))
def q30_findings(g: CodeGraph) -> DataFrame:
    return security.findings(g)


@_query(_FIND.format(where="caller_id IN (SELECT node FROM reach)", severity="('HIGH')"))
def q30_findings_reachable_high(g: CodeGraph) -> DataFrame:
    return security.findings(g, min_severity="high", reachable_only=True)


@_query(f"""WITH {_SINKS}, old AS (SELECT caller_fqn, sink_method FROM sinks WHERE caller_arg_pos = 0)
SELECT repo_name, caller_fqn, sink_method, file_path, line_start, sink_category, caller_arg_pos, callee_param_pos FROM sinks s WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.caller_fqn = s.caller_fqn AND o.sink_method = s.sink_method)""")
def q31_new_sinks(g: CodeGraph) -> DataFrame:
    now = security.find_taint_sinks(g)
    return security.new_sinks(now, now.filter("caller_arg_pos = 0"))


# --- complexity, load, licences -----------------------------------------------

_HINTS = f"""WITH {_METHODS} SELECT repo_name, fqn AS method_fqn, file_path, line_start, complexity_hint, (SELECT count(*) FROM g_calls c WHERE c.dst = l.id) AS call_degree FROM located l WHERE complexity_hint <> ''"""


@_query(_HINTS + " AND complexity_hint <> 'recursive'")
def q32_find_complexity_hints(g: CodeGraph) -> DataFrame:
    return perf.find_complexity_hints(g)


@_query(_HINTS + " AND (contains(complexity_hint, 'O(n2)') OR contains(complexity_hint, 'n+1-risk'))")
def q32_find_complexity_hints_high(g: CodeGraph) -> DataFrame:
    return perf.find_complexity_hints(g, min_severity="high")


@_query(f"""WITH {_METHODS}, e AS (SELECT handler_method_id AS id, path, http_method, row_number() OVER (PARTITION BY handler_method_id ORDER BY path, http_method) AS i FROM g_endpoint),
a AS (SELECT o.src AS id, avg(p.p99_ms) AS a FROM g_observed o JOIN g_perf p ON p.id = o.dst GROUP BY o.src)
SELECT repo_name, coalesce(e.path, '') AS endpoint_path, coalesce(e.http_method, '') AS http_method, fqn AS handler_fqn, file_path, line_start, io_fanout AS total_io, io_serial_count AS serial_io, io_parallel_count AS parallel_io, io_parallel_wrapper AS parallel_wrapper,
a.a * io_serial_count + CASE WHEN io_parallel_count > 0 THEN a.a ELSE 0.0 END AS latency_floor_ms FROM located l LEFT JOIN e ON e.id = l.id AND e.i = 1 LEFT JOIN a ON a.id = l.id WHERE io_fanout >= 2""")
def q33_find_io_fanout(g: CodeGraph) -> DataFrame:
    return perf.find_io_fanout(g)


_LINK = """s AS (SELECT DISTINCT ON (repo_id, endpoint_fqn) repo_id, endpoint_fqn, p50_ms, p99_ms, rps FROM g_perf ORDER BY repo_id, endpoint_fqn, p99_ms DESC, p50_ms DESC, rps DESC),
x AS (SELECT s.repo_id, s.endpoint_fqn, m.id FROM s JOIN g_method m ON m.fqn = s.endpoint_fqn AND m.repo_id = s.repo_id),
n AS (SELECT s.repo_id, s.endpoint_fqn, m.id FROM s JOIN g_method m ON m.name = split_part(split_part(s.endpoint_fqn, '.', -1), '/', -1) AND m.repo_id = s.repo_id
  WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.repo_id = s.repo_id AND x.endpoint_fqn = s.endpoint_fqn)),
a AS (SELECT * FROM x UNION ALL SELECT * FROM n)"""


@_query(f"WITH {_LINK} SELECT (SELECT count(*) FROM s) AS ingested, (SELECT count(DISTINCT id) FROM a) AS matched_methods, (SELECT count(*) FROM s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.repo_id = s.repo_id AND a.endpoint_fqn = s.endpoint_fqn)) AS unmatched")
def q34_ingest_perf_counts(g: CodeGraph) -> DataFrame:
    return perf.link_samples(g, g.perf_sample)[2]


@_query(f"WITH {_LINK} SELECT a.id AS src, md5(a.repo_id || ':' || a.endpoint_fqn) AS dst FROM a")
def q34_ingest_perf_edges(g: CodeGraph) -> DataFrame:
    return perf.link_samples(g, g.perf_sample)[1]


@_query("""SELECT event_type || '/' || CAST(user_id % 10 AS VARCHAR) AS endpoint_fqn, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50_ms, CAST(quantile_disc(value, 0.99) AS DOUBLE) AS p99_ms,
count(*) / ((max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000))::DOUBLE / 1000.0::DOUBLE) AS rps, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS sample_time, 'events' AS source FROM events GROUP BY 1""")
@_raw
def q35_aggregate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws("/", "event_type", (F.col("user_id") % 10).cast("string")).alias("endpoint_fqn"), F.col("value").alias("elapsed_ms"), ms.alias("start_ms"), ms.alias("end_ms"))
    return perf_source.aggregate(e, "events")


_WEIGHT = "CASE t " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in perf.HINT_WEIGHTS.items()) + " ELSE 0.5 END"


@_query(f"""WITH {_METHODS}, p AS (SELECT o.src AS id, max(struct_pack(a := p99_ms, b := p50_ms)) AS w FROM g_observed o JOIN g_perf p ON p.id = o.dst GROUP BY o.src),
x AS (SELECT l.*, list_max(list_transform(string_split(complexity_hint, ','), lambda t: CAST({_WEIGHT} AS DOUBLE))) AS weight FROM located l WHERE complexity_hint <> '')
SELECT repo_name, fqn AS method_fqn, complexity_hint, p.w.a AS p99_ms, p.w.b AS p50_ms, CASE WHEN p.w IS NULL THEN weight * 100.0 ELSE p.w.a * weight END AS risk_score, file_path, line_start FROM x LEFT JOIN p ON p.id = x.id""")
def q36_find_hotspots(g: CodeGraph) -> DataFrame:
    return perf.find_hotspots(g)


@_query("""SELECT r.name AS repo_name, endpoint_fqn, rps AS current_rps, p99_ms, 200.0::DOUBLE / (p99_ms / 1000.0::DOUBLE) AS saturation_rps, rps * (p99_ms / 1000.0::DOUBLE) AS ceiling_concurrency,
CASE WHEN rps / (200.0::DOUBLE / (p99_ms / 1000.0::DOUBLE)) > 0.8 THEN 'CRITICAL' WHEN rps / (200.0::DOUBLE / (p99_ms / 1000.0::DOUBLE)) > 0.6 THEN 'HIGH' WHEN rps / (200.0::DOUBLE / (p99_ms / 1000.0::DOUBLE)) > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, 200 AS thread_pool_size
FROM g_perf p JOIN g_repo r ON r.id = p.repo_id WHERE p99_ms > 0""")
def q37_estimate_capacity(g: CodeGraph) -> DataFrame:
    return perf.estimate_capacity(g)


@_query("""WITH c AS (SELECT m.fqn, m.id, m.repo_id, e.path, e.http_method, e.repo_id AS down FROM g_calls_rest x JOIN g_method m ON m.id = x.src JOIN g_endpoint e ON e.id = x.dst WHERE m.repo_id <> e.repo_id),
d AS (SELECT endpoint_fqn, max(p99_ms) AS p99 FROM g_perf WHERE p99_ms > 0 AND repo_id IN (SELECT down FROM c) GROUP BY endpoint_fqn),
t AS (SELECT path, p99, row_number() OVER (PARTITION BY path ORDER BY endpoint_fqn <> path, endpoint_fqn) AS i FROM (SELECT DISTINCT path FROM c) z JOIN d ON contains(endpoint_fqn, path) OR contains(path, endpoint_fqn)),
u AS (SELECT o.src, max(rps) AS rps FROM g_observed o JOIN g_perf p ON p.id = o.dst GROUP BY o.src),
x AS (SELECT r.name AS repo_name, c.fqn, c.http_method || ' ' || c.path AS ep, 200.0::DOUBLE / (p99 / 1000.0::DOUBLE) AS sat, rps FROM c JOIN t ON t.path = c.path AND i = 1 JOIN u ON u.src = c.id JOIN g_repo r ON r.id = c.repo_id WHERE rps > 0)
SELECT repo_name, fqn AS upstream_method_fqn, ep AS downstream_endpoint, sat AS downstream_saturation_rps, rps AS upstream_current_rps, CASE WHEN rps / sat > 1.0 THEN 'SATURATED' ELSE 'NEAR_SATURATION' END AS risk FROM x WHERE rps / sat > 0.8""")
def q38_find_cascade_risk(g: CodeGraph) -> DataFrame:
    return perf.find_cascade_risk(g)


_SPDX = ("MIT", "Apache-2.0", "GPL-3.0", "MPL-2.0", "Proprietary", "UNKNOWN", "AGPL-3.0-only")


@_query(f"""WITH d AS (SELECT DISTINCT 'org.' || lower(replace(p_brand, '#', '')) AS g, replace(p_name, ' ', '-') AS a, CAST(p_size AS VARCHAR) AS v FROM part),
o AS (SELECT g, a, min(v) AS v FROM d GROUP BY g, a), l AS (SELECT *, CASE WHEN g = 'org.brand3' AND a = 'red-ring' THEN 'MIT' ELSE {_case("CAST((length(g) * 3 + length(a)) % 9 AS VARCHAR)", {str(i): s for i, s in enumerate(_SPDX)}, 'UNKNOWN')} END AS lic FROM o)
SELECT g AS "group", a AS artifact, v AS version, lic AS license, CASE WHEN lic IN {_in(license.ALLOWED)} THEN 'OK' WHEN lic IN {_in(license.STRONG)} THEN 'VIOLATION' WHEN lic = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'WARNING' END AS status,
lic || ' ' || CASE WHEN lic IN {_in(license.STRONG)} THEN 'is a strong copyleft licence' WHEN lic IN {_in(license.WEAK)} THEN 'is a weak copyleft licence' WHEN lic = 'UNKNOWN' THEN 'could not be determined' ELSE 'is not in the allowed list' END AS reason
FROM l WHERE lic NOT IN {_in(license.ALLOWED)}""")
@_raw
def q39_find_license_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    deps = part.select(F.concat(F.lit("org."), F.lower(F.translate("p_brand", "#", ""))).alias("group"), F.translate("p_name", " ", "-").alias("artifact"), F.col("p_size").cast("string").alias("version"))
    i = (F.length("group") * 3 + F.length("artifact")) % 9
    known = deps.select("group", "artifact", patterns.lookup({str(k): s for k, s in enumerate(_SPDX)}, i.cast("string"), "UNKNOWN").alias("spdx")).distinct()
    return license.find_license_violations(deps, known, overrides={"org.brand3:red-ring": "MIT"})


# --- write side --------------------------------------------------------------

@_query("""SELECT coalesce(a.path, b.path) AS path, coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.branch_name, b.branch_name) AS branch_name,
CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.blob_hash = b.h THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT * FROM g_file WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT *, CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE blob_hash END AS h FROM g_file WHERE s_suppkey % 5 <> 0) b ON a.path = b.path AND a.repo_id = b.repo_id AND a.branch_name = b.branch_name""")
@_raw
def q41_incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = testdata.view(spark, sf_dir, "g_file")
    now = f.filter("s_suppkey % 5 <> 0").withColumn("blob_hash", F.expr("case when s_suppkey % 4 = 0 then 'new' else blob_hash end"))
    return resolve.incremental_diff(f.filter("s_suppkey % 3 <> 0"), now)


@_query("""SELECT fqn, id FROM (SELECT regexp_replace(fqn, '[0-9]+', '') AS fqn, id, row_number() OVER (PARTITION BY regexp_replace(fqn, '[0-9]+', '') ORDER BY line_start NULLS FIRST, id) AS i FROM g_method) x WHERE i = 1""")
def q43_dedupe_by_fqn(g: CodeGraph) -> DataFrame:
    m = g.method.select(F.regexp_replace("fqn", r"^([^0-9]*)[0-9]+", "$1").alias("fqn"), "id", "line_start")
    return resolve.dedupe_by_fqn(m).select("fqn", "id")


_PARENTS = """p AS (SELECT c.fqn AS child_fqn, CASE WHEN b % 3 = 0 THEN 'other.Brand' || CAST(b % 7 AS VARCHAR) WHEN b % 3 = 1 AND b % 2 = 0 THEN 'lib.Imported' || CAST(b AS VARCHAR) ELSE 'com.s' || CAST(s AS VARCHAR) || '.Brand' || CAST(b + 1 AS VARCHAR) END AS parent_fqn, CASE WHEN b % 2 = 0 THEN 'extends' ELSE 'implements' END AS kind FROM g_class c)"""


def _parents(g: CodeGraph) -> DataFrame:
    c = g["class"].filter("file_id <> ''").withColumn("b", F.expr("cast(substr(name, 6) as int)"))
    name = F.expr("case when b % 3 = 0 then concat('other.Brand', b % 7) when b % 3 = 1 and b % 2 = 0 then concat('Imported', b) else concat('Brand', b + 1) end")
    declared = c.select(F.col("fqn").alias("child_fqn"), F.substring_index("fqn", ".", 2).alias("package"), "file_id", name.alias("parent"), F.expr("case when b % 2 = 0 then 'extends' else 'implements' end").alias("kind"))
    imports = declared.filter("parent like 'Imported%'").select("file_id", F.col("parent").alias("simple"), F.concat(F.lit("lib."), "parent").alias("fqn")).distinct()
    return resolve.resolve_parents(declared, imports, g["class"])


@_query(f"WITH {_PARENTS} SELECT * FROM p")
def q44_resolve_parents(g: CodeGraph) -> DataFrame:
    return _parents(g)


@_query(f"WITH {_PARENTS} SELECT DISTINCT split_part(parent_fqn, '.', -1) AS name, parent_fqn AS fqn, '__external__' AS repo_id FROM p WHERE parent_fqn NOT IN (SELECT fqn FROM g_all_class)")
def q45_external_stubs(g: CodeGraph) -> DataFrame:
    out, _ = resolve.external_stubs(g, _parents(g))
    return out["class"].join(g["class"], "id", "left_anti").select("name", "fqn", "repo_id")


@_query("""WITH kin AS (SELECT src AS child, dst AS parent FROM g_extends UNION SELECT src, dst FROM g_implements),
o AS (SELECT class_id, name, id, row_number() OVER (PARTITION BY class_id, name ORDER BY line_start DESC NULLS LAST, id DESC) AS i FROM g_method)
SELECT DISTINCT c.src, o.id AS dst, m.name AS callee_name, -1 AS caller_arg_pos, -1 AS callee_param_pos FROM g_calls c JOIN g_method m ON m.id = c.dst JOIN kin ON kin.parent = m.class_id JOIN o ON o.class_id = kin.child AND o.name = m.name AND o.i = 1
WHERE NOT EXISTS (SELECT 1 FROM g_calls d WHERE d.src = c.src AND d.dst = o.id)""")
def q48_virtual_dispatch(g: CodeGraph) -> DataFrame:
    return resolve.virtual_dispatch(g)


_NEW = "SELECT src, dst, min(n) AS callee_name, -1 AS caller_arg_pos, -1 AS callee_param_pos FROM t WHERE NOT EXISTS (SELECT 1 FROM g_calls d WHERE d.src = t.src AND d.dst = t.dst) GROUP BY src, dst"


@_query(f"""WITH pairs AS (SELECT i.id AS init, v.id AS dst, v.name AS n FROM g_method i JOIN g_method v ON v.class_id = i.class_id WHERE i.name = '<init>' AND v.annotations = 'AssertTrue'),
t AS (SELECT init AS src, dst, n FROM pairs UNION SELECT c.src, p.dst, n FROM g_calls c JOIN pairs p ON p.init = c.dst) {_NEW}""")
def q49_bean_validation(g: CodeGraph) -> DataFrame:
    return resolve.bean_validation(g)


@_query(f"""WITH kin AS (SELECT DISTINCT src FROM g_extends WHERE dst IN ('x1', 'x2')), t AS (SELECT DISTINCT e.handler_method_id AS src, m.id AS dst, m.name AS n FROM g_endpoint e JOIN g_method m ON m.repo_id = e.repo_id JOIN kin ON kin.src = m.class_id
WHERE e.handler_method_id <> '' AND m.name = 'doFilterInternal' AND e.handler_method_id <> m.id) {_NEW}""")
def q50_request_filters(g: CodeGraph) -> DataFrame:
    named = g["class"].withColumn("name", F.when(F.col("id").isin("x1", "x2"), "OncePerRequestFilter").otherwise(F.col("name")))
    return resolve.request_filters(g.with_tables(**{"class": named}))


@_query(f"""WITH w AS (SELECT c.src FROM g_calls c JOIN g_method m ON m.id = c.dst WHERE m.name = 'publishEvent' UNION SELECT u.src FROM g_unresolved u JOIN g_rest_call r ON r.id = u.dst WHERE split_part(r.callee_name, '.', -1) = 'publishEvent'),
t AS (SELECT w.src, l.id AS dst, l.name AS n FROM w JOIN g_method s ON s.id = w.src JOIN g_method l ON l.repo_id = s.repo_id AND l.annotations = 'EventListener' AND l.id <> w.src) {_NEW}""")
def q51_application_events(g: CodeGraph) -> DataFrame:
    return resolve.application_events(g)


@_query("SELECT m.id, m.is_entry_point OR (m.name = 'isValid' AND m.class_id IN (SELECT i.src FROM g_implements i JOIN g_all_class c ON c.id = i.dst WHERE contains(c.fqn, 'Brand6'))) AS is_entry_point FROM g_method m")
def q53_validator_entry_points(g: CodeGraph) -> DataFrame:
    named = g["class"].withColumn("fqn", F.when(F.contains("fqn", F.lit("Brand6")), F.concat("fqn", F.lit("ConstraintValidator"))).otherwise(F.col("fqn")))
    return resolve.validator_entry_points(g.with_tables(**{"class": named})).select("id", "is_entry_point")


_MATCH = """m AS (SELECT DISTINCT r.caller_method_id AS src, e.id AS dst, r.id AS call_id, r.repo_id AS src_repo, e.repo_id AS dst_repo FROM g_rest_call r JOIN g_endpoint e
ON (r.http_method = '' OR upper(r.http_method) = e.http_method) AND regexp_matches(regexp_replace(r.url_pattern, '^https?://[^/]+', ''), '^' || regexp_replace(e.path, '\\{[^{}]*\\}', '([^/]+)', 'g') || '$')
WHERE r.url_pattern <> 'DYNAMIC' AND r.caller_method_id <> '' AND regexp_replace(r.url_pattern, '^https?://[^/]+', '') <> '')"""


@_query(f"WITH {_MATCH} SELECT * FROM m")
def q54_cross_repo_matches(g: CodeGraph) -> DataFrame:
    return resolve.cross_repo_matches(g)


@_query(f"WITH {_MATCH} SELECT DISTINCT src_repo AS src, dst_repo AS dst FROM m WHERE src_repo <> dst_repo")
def q54_cross_repo_dependencies(g: CodeGraph) -> DataFrame:
    return resolve.resolve_cross_repo(g)[1]


@_query(f"WITH {_MATCH} SELECT (SELECT count(DISTINCT call_id) FROM m) AS matched, (SELECT count(*) FROM g_rest_call) - (SELECT count(DISTINCT call_id) FROM m) AS unresolved")
def q54_cross_repo_counts(g: CodeGraph) -> DataFrame:
    return resolve.resolve_cross_repo(g)[2]


@_query("""SELECT 'method' AS t, count(*) AS n FROM g_method WHERE repo_id <> '2' UNION ALL SELECT 'calls', count(*) FROM g_calls c JOIN g_method a ON a.id = c.src JOIN g_method b ON b.id = c.dst WHERE a.repo_id <> '2' AND b.repo_id <> '2'
UNION ALL SELECT 'exposes', count(*) FROM g_exposes WHERE src <> '2' UNION ALL SELECT 'depends_on', count(*) FROM g_depends_on WHERE src <> '2' AND dst <> '2' UNION ALL SELECT 'repo', count(*) - 1 FROM g_repo""")
def q56_delete_repo(g: CodeGraph) -> DataFrame:
    left = resolve.delete_repo(g, "ASIA")
    parts = [left[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in ("method", "calls", "exposes", "depends_on", "repo")]
    return union_all(parts)


@_query("""WITH lost AS (SELECT id FROM g_file WHERE s_suppkey % 10 = 1), m AS (SELECT id FROM g_method WHERE file_id NOT IN (SELECT id FROM lost)), c AS (SELECT id FROM g_all_class WHERE file_id NOT IN (SELECT id FROM lost))
SELECT 'calls' AS t, count(*) AS n FROM g_calls WHERE src IN (SELECT id FROM m) AND dst IN (SELECT id FROM m) UNION ALL SELECT 'extends', count(*) FROM g_extends WHERE src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c)
UNION ALL SELECT 'contains_method', count(*) FROM g_contains_method WHERE src IN (SELECT id FROM c) AND dst IN (SELECT id FROM m)""")
@_raw
def q56_delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = testdata.graph(spark, sf_dir)
    left = resolve.delete_files(g, testdata.view(spark, sf_dir, "g_file").filter("s_suppkey % 10 = 1").select("id"))
    return union_all([left[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in ("calls", "extends", "contains_method")])


@_query("SELECT id, CASE WHEN k % 3 = 0 THEN 'new' ELSE name END AS name FROM g_method UNION ALL SELECT 'n' || id, 'new' FROM g_method WHERE k % 6 = 0")
def q57_merge_rows(g: CodeGraph) -> DataFrame:
    old = g.method.select("id", "name")
    new = old.filter("cast(id as int) % 3 = 0").withColumn("name", F.lit("new"))
    more = old.filter("cast(id as int) % 6 = 0").select(F.concat(F.lit("n"), "id").alias("id"), F.lit("new").alias("name"))
    return resolve.merge_rows(old, new.unionByName(more))


@_query("""WITH s AS (SELECT o.id AS site_id, o.k, o.src AS caller_id, o.callee FROM (SELECT c.src || '>' || c.dst AS id, c.src, m.name AS callee, m.k FROM g_calls c JOIN g_method m ON m.id = c.dst) o),
c AS (SELECT s.site_id, s.caller_id, s.callee, t.id AS dst, CASE WHEN t.class_id = a.class_id THEN 2 WHEN split_part(tc.fqn, '.', 2) = split_part(ac.fqn, '.', 2) THEN 5 ELSE 7 END AS p, tf.path, t.line_start
FROM s JOIN g_method a ON a.id = s.caller_id JOIN g_class ac ON ac.id = a.class_id JOIN g_method t ON t.name = s.callee AND t.id <> s.caller_id JOIN g_class tc ON tc.id = t.class_id LEFT JOIN g_file tf ON tf.id = t.file_id),
b AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY p, path NULLS FIRST, line_start NULLS FIRST, dst) AS i FROM c)
SELECT site_id, caller_id AS src, dst, callee AS callee_name, 0 AS caller_arg_pos, 0 AS callee_param_pos FROM b WHERE i = 1""")
def q46_resolve_calls(g: CodeGraph) -> DataFrame:
    cls = g["class"].select(F.col("id").alias("class_id"), F.col("fqn").alias("class_fqn"), F.col("name").alias("class_name"))
    paths = g.file.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    m = g.method.join(cls, "class_id").join(paths, "file_id", "left")
    sites = g.calls.join(m.select(F.col("id").alias("src"), F.col("class_fqn").alias("caller_class"), "file_id"), "src").join(g.method.select(F.col("id").alias("dst"), F.col("name").alias("callee")), "dst")
    sites = sites.select(F.concat_ws(">", "src", "dst").alias("site_id"), F.col("src").alias("caller_id"), "caller_class", F.substring_index("caller_class", ".", 2).alias("package"), "file_id", F.lit("").alias("receiver"), "callee", F.lit(1).alias("argc"))
    none = lambda ddl: g.spark.createDataFrame([], ddl)
    return resolve.resolve_calls(sites, m, none("file_id string, simple string, fqn string"), none("class_fqn string, field string, type string"), none("interface_name string, class_fqn string"))[0]
