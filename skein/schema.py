"""Node and edge tables of a code graph, with their types and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

#: table -> (column, type, default or None). The data model's names and defaults.
COLUMNS: dict[str, list[tuple[str, str, object]]] = {
    "repo": [("id", "string", None), ("name", "string", None), ("root_path", "string", "")],
    "file": [("id", "string", None), ("path", "string", None), ("language", "string", None), ("repo_id", "string", None), ("blob_hash", "string", ""), ("branch_name", "string", "master")],
    "branch": [("id", "string", None), ("name", "string", None), ("repo_id", "string", None)],
    "class": [("id", "string", None), ("name", "string", None), ("fqn", "string", None), ("file_id", "string", ""), ("repo_id", "string", None), ("is_interface", "boolean", False), ("is_object", "boolean", False), ("enclosing_class_name", "string", ""), ("annotations", "array<string>", ())],
    "method": [("id", "string", None), ("name", "string", None), ("fqn", "string", None), ("class_id", "string", ""), ("file_id", "string", ""), ("repo_id", "string", None), ("line_start", "long", None), ("is_suspend", "boolean", False), ("annotations", "array<string>", ()), ("generated", "boolean", None), ("is_entry_point", "boolean", False), ("complexity_hint", "string", ""), ("io_fanout", "long", 0), ("io_parallel_count", "long", 0), ("io_serial_count", "long", 0), ("io_parallel_wrapper", "string", "")],
    "endpoint": [("id", "string", None), ("http_method", "string", None), ("path", "string", None), ("path_regex", "string", ""), ("handler_method_id", "string", ""), ("repo_id", "string", None)],
    "rest_call": [("id", "string", None), ("http_method", "string", None), ("url_pattern", "string", None), ("callee_name", "string", ""), ("caller_method_id", "string", ""), ("repo_id", "string", None)],
    "entity_relation": [("id", "string", None), ("source_class_id", "string", None), ("target_class_fqn", "string", None), ("field_name", "string", None), ("relation_type", "string", None), ("fetch_type", "string", "LAZY"), ("repo_id", "string", None)],
    "perf_sample": [("id", "string", None), ("endpoint_fqn", "string", None), ("p50_ms", "double", None), ("p99_ms", "double", None), ("rps", "double", None), ("sample_time", "string", ""), ("source", "string", ""), ("repo_id", "string", None)],
    "capacity_estimate": [("id", "string", None), ("endpoint_fqn", "string", None), ("saturation_rps", "double", None), ("ceiling_concurrency", "double", None), ("risk_level", "string", None), ("repo_id", "string", None)],
    "calls": [("src", "string", None), ("dst", "string", None), ("callee_name", "string", ""), ("caller_arg_pos", "long", -1), ("callee_param_pos", "long", -1)],
    # kind: stub (a call to a method that was not found) or rest (an outbound request)
    "unresolved_call": [("src", "string", None), ("dst", "string", None), ("kind", "string", "stub")],
}
for _edge in ("calls_rest", "contains_class", "contains_method", "exposes", "depends_on", "has_branch", "extends", "implements", "has_relation", "observed_at"):
    COLUMNS[_edge] = [("src", "string", None), ("dst", "string", None)]

TABLES = tuple(COLUMNS)
#: Table holding the repository of each edge's source, for partitioning.
EDGES = tuple(t for t in TABLES if COLUMNS[t][0][0] == "src")

SYNTHETIC_ARG_POS = -99
EXTERNAL_REPO = "__external__"
DYNAMIC_URL = "DYNAMIC"


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t, _ in COLUMNS[table]))
