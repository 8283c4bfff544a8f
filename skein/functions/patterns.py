"""Security patterns: built-in lists, user lists, and matching as column expressions."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Annotations that mark a method as fed by a request.
SOURCE_ANNOTATIONS = ("RequestParam", "PathVariable", "RequestBody", "RequestHeader", "MatrixVariable", "ModelAttribute", "QueryParam", "PathParam", "FormParam", "HeaderParam", "CookieParam")
# Methods that return request data.
SOURCE_METHODS = ("HttpServletRequest.getParameter", "HttpServletRequest.getHeader", "HttpServletRequest.getCookies", "HttpServletRequest.getInputStream", "HttpServletRequest.getReader", "ServerHttpRequest.getBody", "req.query", "req.params", "req.body", "req.headers", "request.query", "request.params", "request.body", "request.headers", "searchParams.get", "useSearchParams")
# Methods that must not get unchecked data.
SINK_METHODS = ("Statement.execute", "Statement.executeQuery", "Statement.executeUpdate", "PreparedStatement.execute", "PreparedStatement.executeQuery", "RestTemplate.getForEntity", "RestTemplate.postForEntity", "RestTemplate.exchange", "RestTemplate.getForObject", "RestTemplate.postForObject", "WebClient.get", "WebClient.post", "WebClient.put", "WebClient.delete", "WebClient.patch", "Runtime.exec", "ProcessBuilder.start", "File.<init>", "Files.readAllBytes", "Files.newBufferedReader", "Client.query", "Pool.query", "Connection.query", "pool.query", "child_process.exec", "child_process.execSync", "child_process.spawn", "child_process.spawnSync", "fs.readFile", "fs.readFileSync", "fs.createReadStream", "axios.get", "axios.post", "axios.put", "axios.delete", "axios.patch", "axios.request", "fetch")
# Methods that clean data.
SANITIZER_METHODS = ("HtmlUtils.htmlEscape", "StringEscapeUtils.escapeHtml4", "ESAPI.encoder", "Encode.forHtml")
# Patterns whose last segment is too common to match alone.
ENDSWITH_ONLY = ("req.query", "req.params", "req.body", "req.headers", "request.query", "request.params", "request.body", "request.headers", "searchParams.get", "Client.query", "Pool.query", "Connection.query", "pool.query", "axios.get", "axios.post", "axios.put", "axios.delete", "axios.patch", "axios.request", "WebClient.get", "WebClient.post", "WebClient.put", "WebClient.delete", "WebClient.patch")
# Last segment of a sink -> OWASP category.
OWASP = {"execute": "A03:2021-Injection", "executeQuery": "A03:2021-Injection", "executeUpdate": "A03:2021-Injection", "createQuery": "A03:2021-Injection", "query": "A03:2021-Injection", "exec": "A03:2021-Injection", "start": "A03:2021-Injection", "getForEntity": "A10:2021-Server-Side Request Forgery", "postForEntity": "A10:2021-Server-Side Request Forgery", "exchange": "A10:2021-Server-Side Request Forgery", "readAllBytes": "A01:2021-Broken Access Control", "newBufferedReader": "A01:2021-Broken Access Control"}
OWASP_OTHER = "A00:2021-Uncategorized"
# Last segment -> CWE.
CWE = {"execute": "CWE-89: SQL Injection", "executeQuery": "CWE-89: SQL Injection", "createQuery": "CWE-89: SQL Injection", "getForEntity": "CWE-918: Server-Side Request Forgery", "postForEntity": "CWE-918: Server-Side Request Forgery", "exchange": "CWE-918: Server-Side Request Forgery", "exec": "CWE-78: OS Command Injection", "start": "CWE-78: OS Command Injection", "readAllBytes": "CWE-22: Path Traversal"}
CWE_OTHER = "CWE-000: Unclassified"
# CWE -> PCI DSS and STIG.
PCI = {"CWE-89: SQL Injection": "PCI DSS 6.3.1: Injection flaws", "CWE-78: OS Command Injection": "PCI DSS 6.3.1: Injection flaws", "CWE-918: Server-Side Request Forgery": "PCI DSS 6.3.1: Other flaws", "CWE-22: Path Traversal": "PCI DSS 6.3.1: Other flaws"}
PCI_OTHER = "PCI DSS 6.3.1: Review required"
STIG = {"CWE-89: SQL Injection": "APSC-DV-002560 CAT I", "CWE-78: OS Command Injection": "APSC-DV-002560 CAT I", "CWE-918: Server-Side Request Forgery": "APSC-DV-002510 CAT II", "CWE-22: Path Traversal": "APSC-DV-002300 CAT II"}
STIG_OTHER = "APSC-DV-000000 Review required"


def lookup(table: dict[str, object], key: Column, default: object) -> Column:
    """The value of a small fixed table for a key column."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _ends_with(name: Column, patterns: tuple[str, ...]) -> Column:
    """endswith for any pattern: one set lookup for each length, so that the generated code stays
    small however long the list is (a term for each pattern outgrows the JVM's method limit)."""
    by_length: dict[int, list[str]] = {}
    for p in dict.fromkeys(patterns):
        by_length.setdefault(len(p), []).append(p)
    return reduce(or_, (F.substring(name, -n, n).isin(ps) for n, ps in sorted(by_length.items())), F.lit(False))


def _matches(name: Column, patterns: tuple[str, ...], whole: frozenset[str]) -> Column:
    """endswith for every pattern; equality of last segments too, unless the pattern
    is in `whole`. Null names match nothing. Plain expressions: no Python runs."""
    hit = _ends_with(name, patterns)
    short = sorted({p.rsplit(".", 1)[-1] for p in patterns if p not in whole})
    if short:
        hit = hit | short_name(name).isin(short)
    return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class SecurityConfig:
    source_annotations: tuple[str, ...] = SOURCE_ANNOTATIONS
    source_methods: tuple[str, ...] = SOURCE_METHODS
    sink_methods: tuple[str, ...] = SINK_METHODS
    sanitizer_methods: tuple[str, ...] = SANITIZER_METHODS
    whole: frozenset[str] = field(default_factory=lambda: frozenset(ENDSWITH_ONLY))

    def is_source_method(self, name: Column) -> Column:
        return _matches(name, self.source_methods, self.whole)

    def is_sink(self, name: Column) -> Column:
        return _matches(name, self.sink_methods, self.whole)

    def is_sanitizer(self, name: Column) -> Column:
        return _matches(name, self.sanitizer_methods, frozenset())

    def source_annotations_in(self, annotations: Column) -> Column:
        return F.filter(F.coalesce(annotations, F.array().cast("array<string>")), lambda a: _matches(a, self.source_annotations, frozenset()))

    def has_source_annotation(self, annotations: Column) -> Column:
        return F.size(self.source_annotations_in(annotations)) > 0

    def table(self, spark: SparkSession) -> DataFrame:
        """list_security_config: (kind, pattern, whole), in list order."""
        rows = [(k, p, p in self.whole and k in ("source_methods", "sink_methods"))
                for k in ("source_annotations", "source_methods", "sink_methods", "sanitizer_methods") for p in getattr(self, k)]
        return spark.createDataFrame(rows, "kind string, pattern string, whole boolean")

    @classmethod
    def load(cls, path: str | None = None) -> "SecurityConfig":
        """Built-in lists with a user's YAML lists appended; a file that can't be read is ignored."""
        path = path or os.environ.get("SKEIN_SECURITY_CONFIG")
        if not path:
            return cls()
        try:
            import yaml

            with open(path, encoding="utf-8") as f:
                data = yaml.safe_load(f)
        except Exception:  # noqa: BLE001  a bad file leaves the built-in lists
            return cls()
        if not isinstance(data, dict):
            return cls()

        def more(key: str, own: tuple[str, ...]) -> tuple[str, ...]:
            extra = data.get(key) or []
            return tuple(dict.fromkeys([*own, *(x for x in extra if isinstance(x, str))])) if isinstance(extra, list) else own

        return cls(more("source_annotations", SOURCE_ANNOTATIONS), more("source_methods", SOURCE_METHODS),
                   more("sink_methods", SINK_METHODS), more("sanitizer_methods", SANITIZER_METHODS))
