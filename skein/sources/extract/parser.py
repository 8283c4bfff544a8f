"""Declarations of Java, Kotlin, JavaScript and TypeScript files as facts (kind, dict)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from skein.sources.extract import body
from skein.sources.extract.lexer import Token, after_generics, closing, lex, split_commas

# Annotations that map requests, that start methods, of managed classes and of generated code.
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "GET"}
ENTRY = frozenset("KafkaListener Scheduled JmsListener RabbitListener PostConstruct PreDestroy Bean".split()) | set(MAPPINGS)
COMPONENTS = frozenset("Service Component Repository Controller RestController".split())
LOMBOK = frozenset("Data Value Builder Getter Setter EqualsAndHashCode ToString".split())
LOMBOK_NAMES = re.compile(r"(get|is)[A-Z].*|set[A-Z].*|equals|hashCode|toString|canEqual|builder|build")
RELATIONS = frozenset("OneToMany ManyToOne OneToOne ManyToMany".split())
WRAPPERS = frozenset("List Set Collection Optional MutableList MutableSet Iterable".split())
ROUTES = frozenset("GET POST PUT DELETE PATCH HEAD OPTIONS".split())
EXPRESS = frozenset("get post put delete patch all".split())

Fact = tuple[str, dict]


def extract(path: str, source: str, language: str) -> list[Fact]:
    tokens = lex(source)
    if language in ("javascript", "typescript"):
        return list(_Script(path, tokens, language).run())
    return list(_Typed(path, tokens, language).run())


def _type_name(tokens: list[Token]) -> str:
    """The simple name a type means: of List<Order> it is Order."""
    names = [t.text for t in tokens if t.kind == "id"]
    return next((n for n in names if n not in WRAPPERS and n[:1].isupper()), names[-1] if names else "")


class _Typed:
    """Java and Kotlin."""

    def __init__(self, path: str, tokens: list[Token], language: str) -> None:
        self.path, self.t, self.language = path, tokens, language
        self.kotlin = language == "kotlin"
        self.package = ""
        self.seen: dict[str, int] = {}

    def run(self) -> Iterator[Fact]:
        t, i = self.t, 0
        while i < len(t) and t[i].text in ("package", "import"):
            j = i + 1
            static = j < len(t) and t[j].text == "static"
            j += static
            name = []
            line = t[i].line
            while j < len(t) and t[j].text != ";" and (t[j].line == line or not self.kotlin) and (t[j].kind == "id" or t[j].text in ".*"):
                if t[j].text == "as":
                    break
                name.append(t[j].text)
                j += 1
            full = "".join(name)
            if t[i].text == "package":
                self.package = full
            elif full:
                yield "import", {"simple": full.rsplit(".", 1)[-1], "fqn": full}
            while j < len(t) and (t[j].text == ";" or t[j].line == line and self.kotlin):
                j += 1
            i = j
        yield from self.members(i, len(t), None)

    def annotations(self, i: int, end: int) -> tuple[dict[str, list[Token]], int]:
        """Annotations and modifiers from i on: name -> argument tokens, and where they end."""
        out: dict[str, list[Token]] = {}
        t = self.t
        while i < end:
            if t[i].text == "@" and i + 1 < end and t[i + 1].text != "interface":
                j = i + 1
                if j + 1 < end and t[j + 1].text == ":" and self.kotlin:  # @field:X
                    j += 2
                name = t[j].text
                while j + 2 < end and t[j + 1].text == ".":
                    j += 2
                    name = t[j].text
                j += 1
                args: list[Token] = []
                if j < end and t[j].text == "(":
                    close = closing(t, j, end)
                    args, j = t[j + 1 : close], close + 1
                out[name] = args
                i = j
            elif t[i].kind == "id" and t[i].text in _MODIFIERS:
                out.setdefault(" " + t[i].text, [])
                i += 1
            else:
                break
        return out, i

    def members(self, i: int, end: int, owner: dict | None) -> Iterator[Fact]:
        t = self.t
        while i < end:
            marks, j = self.annotations(i, end)
            if j >= end:
                return
            x = t[j].text
            if x in ("class", "interface", "enum", "record", "object") or x == "@":
                if x == "@" or x == "enum" and self.kotlin:
                    j += 1
                if j >= end:
                    return
                i = yield from self.type(j, end, marks, owner)
            elif self.kotlin and x == "fun":
                i = yield from self.kotlin_function(j, end, marks, owner)
            elif self.kotlin and x in ("val", "var"):
                i = yield from self.kotlin_property(j, end, marks, owner)
            elif self.kotlin and x == "init" and j + 1 < end and t[j + 1].text == "{":
                i = closing(t, j + 1, end) + 1
            elif x == "{":
                i = closing(t, j, end) + 1
            elif self.kotlin or owner is None or t[j].kind != "id" and x != "<":
                i = j + 1
            else:
                i = yield from self.java_member(j, end, marks, owner)

    def type(self, i: int, end: int, marks: dict, owner: dict | None) -> Iterator[Fact]:
        t = self.t
        word = t[i].text
        i += 1
        name = t[i].text if i < end and t[i].kind == "id" else "Companion"
        if i < end and t[i].kind == "id":
            i += 1
        line = t[min(i, end - 1)].line
        i = after_generics(t, i)
        params: list[list[Token]] = []
        if self.kotlin:
            marks2, i = self.annotations(i, end)
            marks = {**marks, **{k: v for k, v in marks2.items() if k.startswith(" ")}}
            if i < end and t[i].text == "constructor":
                i += 1
        if i < end and t[i].text == "(":
            close = closing(t, i, end)
            params = split_commas(t[i + 1 : close])
            i = close + 1
        fqn = ".".join(x for x in (self.package, name if name != "Companion" or owner is None else f"{owner['name']}.Companion") if x)
        own = {"name": name, "fqn": fqn, "is_interface": word == "interface", "is_object": word == "object", "enclosing_class_name": owner["name"] if owner else "",
               "annotations": [k for k in marks if not k.startswith(" ")], "package": self.package, "line": line}
        yield "class", own
        own = {**own, "prefix": self.paths(marks.get("RequestMapping", [])), "marks": marks}
        kind = "extends"
        while i < end and t[i].text not in ("{", ";") and not (self.kotlin and t[i].text in _KOTLIN_STARTS):
            if t[i].text in ("extends", "implements", "permits"):
                kind = t[i].text
                i += 1
            elif t[i].text in (":", ","):
                i += 1
            elif t[i].text == "where":
                while i < end and t[i].text != "{":
                    i += 1
            elif t[i].kind == "id":
                parent = [t[i].text]
                while i + 2 < end and t[i + 1].text == ".":
                    parent.append(t[i + 2].text)
                    i += 2
                i = after_generics(t, i + 1)
                called = i < end and t[i].text == "("
                if called:
                    i = closing(t, i, end) + 1
                if self.kotlin:
                    how = "extends" if called else "implements"
                else:
                    how = "implements" if kind == "implements" or word == "interface" else "extends"
                if kind != "permits":
                    yield "parent", {"child_fqn": fqn, "package": self.package, "parent": ".".join(parent), "kind": how}
                    if how == "implements" and COMPONENTS & set(own["annotations"]):
                        yield "impl", {"interface_name": parent[-1], "class_fqn": fqn}
            else:
                i += 1
        for p in params:
            colon = next((k for k, x in enumerate(p) if x.text == ":"), None)
            if self.kotlin and colon and p[colon - 1].kind == "id":
                yield "field", {"class_fqn": fqn, "field": p[colon - 1].text, "type": _type_name(p[colon + 1 :])}
        if self.kotlin and word == "class" and not own["is_interface"] or word == "record":
            yield from self.method(own, "<init>", {}, params, [], line, True, False)
        if " data" in marks:
            for k, n in enumerate(["copy", "equals", "hashCode", "toString", *(f"component{k + 1}" for k in range(len(params)))]):
                yield from self.method(own, n, {}, [], [], line, True, False)
        if i < end and t[i].text == "{":
            close = closing(t, i, end)
            start = i + 1
            if word == "enum":  # constants come first
                while start < close and t[start].text != ";":
                    start = closing(t, start, close) + 1 if t[start].text in "({" else start + 1
            yield from self.members(start, close, own)
            i = close + 1
        return i

    def java_member(self, i: int, end: int, marks: dict, owner: dict) -> Iterator[Fact]:
        t, j = self.t, after_generics(self.t, i)
        first = j
        while j < end and t[j].text not in ("(", ";", "=", "{", "}"):
            j = after_generics(t, j) if t[j].text == "<" and after_generics(t, j) > j else j + 1
        if j >= end or t[j].text == "}":
            return j + 1
        if t[j].text == "{":
            return closing(t, j, end) + 1
        name = t[j - 1].text
        if t[j].text != "(":
            stop = j
            while stop < end and t[stop].text != ";":
                stop = closing(t, stop, end) + 1 if t[stop].text in "({[" else stop + 1
            kind = _type_name(t[first : j - 1])
            yield "field", {"class_fqn": owner["fqn"], "field": name, "type": kind}
            if " static" in marks and " final" in marks and t[j].text == "=" and all(x.kind == "str" or x.text == "+" for x in t[j + 1 : stop]):
                yield "constant", {"name": f"{owner['name']}.{name}", "value": "".join(x.value for x in t[j + 1 : stop] if x.kind == "str")}
            yield from self.relation(owner, marks, name, kind)
            return stop + 1
        close = closing(t, j, end)
        params = split_commas(t[j + 1 : close])
        k = close + 1
        while k < end and t[k].text not in ("{", ";"):
            k = closing(t, k, end) + 1 if t[k].text == "(" else k + 1
        code: list[Token] = []
        has_body = k < end and t[k].text == "{"
        if has_body:
            stop = closing(t, k, end)
            code, k = t[k + 1 : stop], stop
        made = name == owner["name"] and j - 1 == first
        generated = made or not has_body and bool(LOMBOK & set(owner["annotations"])) and bool(LOMBOK_NAMES.fullmatch(name))
        yield from self.method(owner, "<init>" if made else name, marks, params, code, t[j - 1].line, generated, False)
        return k + 1

    def kotlin_function(self, i: int, end: int, marks: dict, owner: dict | None) -> Iterator[Fact]:
        t, j = self.t, after_generics(self.t, i + 1)
        while j < end and t[j].text != "(":
            j = after_generics(t, j) if t[j].text == "<" and after_generics(t, j) > j else j + 1
        if j >= end:
            return j
        name, close = t[j - 1].text, closing(t, j, end)
        params = split_commas(t[j + 1 : close])
        k, line = close + 1, t[j - 1].line
        while k < end and t[k].text not in ("{", "=") and not (t[k].text in _KOTLIN_STARTS and t[k].line > line) and t[k].text != "}":
            k = closing(t, k, end) + 1 if t[k].text == "(" else k + 1
        code: list[Token] = []
        if k < end and t[k].text == "{":
            stop = closing(t, k, end)
            code, k = t[k + 1 : stop], stop + 1
        elif k < end and t[k].text == "=":
            stop = k + 1
            while stop < end and not (t[stop].text in _KOTLIN_STARTS and t[stop].line > t[stop - 1].line):
                stop = closing(t, stop, end) + 1 if t[stop].text in "({[" else stop + 1
            code, k = t[k + 1 : stop], stop
        if owner is None:
            owner = self.file_class()
            if "file" not in self.seen:
                self.seen["file"] = 1
                yield "class", {k2: v for k2, v in owner.items() if k2 not in ("prefix", "marks")}
        yield from self.method(owner, name, marks, params, code, line, False, " suspend" in marks)
        return max(k, close + 1)

    def file_class(self) -> dict:
        stem = re.sub(r"\W", "_", self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
        name = stem[:1].upper() + stem[1:] + "Kt"
        return {"name": name, "fqn": ".".join(x for x in (self.package, name) if x), "is_interface": False, "is_object": False, "enclosing_class_name": "", "annotations": [], "package": self.package, "line": 1, "prefix": [], "marks": {}}

    def kotlin_property(self, i: int, end: int, marks: dict, owner: dict | None) -> Iterator[Fact]:
        t, j = self.t, after_generics(self.t, i + 1)
        if j >= end:
            return end
        name, k, line = t[j].text, j + 1, t[j].line
        start = k
        while k < end and t[k].text not in ("=", "by", "}") and not (t[k].text in _KOTLIN_STARTS and t[k].line > line):
            k = closing(t, k, end) + 1 if t[k].text in "({[" else k + 1
        kind = _type_name(t[start:k]) if start < k and t[start].text == ":" else ""
        value = k
        while k < end and not (t[k].text in _KOTLIN_STARTS and t[k].line > t[k - 1].line) and t[k].text != "}":
            k = closing(t, k, end) + 1 if t[k].text in "({[" else k + 1
        if owner:
            if not kind and value + 2 < end and t[value].text == "=" and t[value + 1].text[:1].isupper():
                kind = t[value + 1].text
            yield "field", {"class_fqn": owner["fqn"], "field": name, "type": kind}
            if " const" in marks and value + 1 < end and t[value + 1].kind == "str":
                yield "constant", {"name": f"{owner['enclosing_class_name'] if owner['name'] == 'Companion' else owner['name']}.{name}", "value": t[value + 1].value}
            yield from self.relation(owner, marks, name, kind)
        return max(k, j + 1)

    def relation(self, owner: dict, marks: dict, name: str, kind: str) -> Iterator[Fact]:
        how = next((a for a in marks if a in RELATIONS), None)
        if how and kind and {"Entity", "MappedSuperclass"} & set(owner["annotations"]):
            eager = any(x.text == "EAGER" for x in marks[how])
            yield "relation", {"class_fqn": owner["fqn"], "target": kind, "package": self.package, "field_name": name, "relation_type": how, "fetch_type": "EAGER" if eager else "LAZY"}

    def paths(self, args: list[Token]) -> list[list[str]]:
        """Paths of a mapping annotation; each as parts: a literal, or ${Class.FIELD}."""
        out = []
        for part in split_commas(args):
            key = part[0].text if len(part) > 2 and part[1].text == "=" else "value"
            if key not in ("value", "path"):
                continue
            value = part[2:] if len(part) > 2 and part[1].text == "=" else part
            if value and value[0].text in "{[" or value and value[0].text == "arrayOf":
                value = value[1:-1] if value[0].text != "arrayOf" else value[2:-1]
            for one in split_commas(value):
                parts, ref = [], []
                for x in one:
                    if x.kind == "str":
                        parts.append(x.value)
                    elif x.kind == "id" or x.text == ".":
                        ref.append(x.text)
                    elif x.text == "+" and ref:
                        parts.append("${" + "".join(ref) + "}")
                        ref = []
                if ref:
                    parts.append("${" + "".join(ref) + "}")
                out.append(parts)
        return out

    def method(self, owner: dict, name: str, marks: dict, params: list[list[Token]], code: list[Token], line: int, generated: bool, suspend: bool) -> Iterator[Fact]:
        base = f"{owner['fqn']}.{name}"
        n = self.seen[base] = self.seen.get(base, 0) + 1
        fqn = base if n == 1 else f"{base}#{n}"
        own = [a for a in marks if not a.startswith(" ")]
        names = []
        for p in params:
            at = 0
            while at + 1 < len(p) and p[at].text == "@":  # annotations of the parameter
                at += 2
                if at < len(p) and p[at].text == "(":
                    at = closing(p, at) + 1
            p = p[at:]
            ids = [x.text for x in p if x.kind == "id"]
            colon = next((k for k, x in enumerate(p) if x.text == ":"), None)
            names.append(p[colon - 1].text if self.kotlin and colon else ids[-1] if ids else "")
            if ids:
                yield "param", {"method_fqn": fqn, "param": names[-1], "type": _type_name(p[colon + 1 :] if self.kotlin and colon else p[:-1])}
        sites = body.calls(code, self.language)
        total, parallel, serial, wrapper = body.io_calls(sites, own)
        yield "method", {"name": name, "fqn": fqn, "class_fqn": owner["fqn"], "class_name": owner["name"], "package": self.package, "line_start": line, "is_suspend": suspend, "annotations": own, "generated": generated,
                         "is_entry_point": bool(ENTRY & set(own)), "complexity_hint": body.complexity(code, sites, name, names), "io_fanout": total, "io_parallel_count": parallel, "io_serial_count": serial, "io_parallel_wrapper": wrapper}
        for c in [*sites, *body.references(code, self.language)]:
            yield "site", {"caller_fqn": fqn, "caller_class": owner["fqn"], "package": self.package, "receiver": c.receiver, "callee": c.name, "argc": len(c.args), "line": c.line}
        for verb, url in body.requests(sites, self.language, code):
            yield "rest", {"caller_fqn": fqn, "http_method": verb, "url_pattern": url}
        for a in own:
            if a in MAPPINGS:
                verb = MAPPINGS[a]
                if a == "RequestMapping" and not self.kotlin:
                    verb = next((x.text for x in marks[a] if x.text in ROUTES), verb)
                for head in owner.get("prefix") or [[]]:
                    for tail in self.paths(marks[a]) or [[]]:
                        yield "endpoint", {"http_method": verb, "prefix": head, "parts": tail, "handler_fqn": fqn, "kotlin": self.kotlin, "raw": False}


_MODIFIERS = frozenset("public private protected internal static final abstract sealed open override data inline suspend const lateinit default synchronized native transient volatile strictfp tailrec operator infix external inner companion annotation value vararg expect actual".split())
_KOTLIN_STARTS = frozenset("fun val var class interface object private public protected internal override open abstract data companion suspend inline const lateinit init @ sealed enum".split())


class _Script:
    """JavaScript and TypeScript: functions, classes, routes and requests."""

    def __init__(self, path: str, tokens: list[Token], language: str) -> None:
        self.path, self.t, self.language = path, tokens, language
        parts = re.split(r"[\\/]", path)
        self.module = ".".join(re.sub(r"\.\w+$", "", p) for p in parts if p)
        self.name = self.module.rsplit(".", 1)[-1]
        self.seen: dict[str, int] = {}

    def run(self) -> Iterator[Fact]:
        own = {"name": self.name, "fqn": self.module, "is_interface": False, "is_object": False, "enclosing_class_name": "", "annotations": [], "package": "", "line": 1}
        yield "class", own
        t, i, n = self.t, 0, len(self.t)
        while i < n:
            x = t[i].text
            if x == "import":
                j = i
                while j < n and t[j].kind != "str" and t[j].text != ";":
                    j += 1
                for name in (y.text for y in t[i + 1 : j] if y.kind == "id" and y.text not in ("from", "as", "type")):
                    yield "import", {"simple": name, "fqn": f"{t[j].value}.{name}" if j < n and t[j].kind == "str" else name}
                i = j + 1
            elif x == "function" and i + 2 < n and t[i + 1].kind == "id":
                i = yield from self.function(i + 1, t[i + 1].text, own, self.exported(i))
            elif x == "class" and i + 1 < n and t[i + 1].kind == "id":
                i = yield from self.klass(i + 1)
            elif x in ("const", "let", "var") and i + 3 < n and t[i + 2].text in ("=", ":"):
                j = i + 2
                while j < n and t[j].text not in ("=>", "function", ";", "{", "const", "let", "var"):
                    j = closing(t, j) + 1 if t[j].text in "([" else j + 1
                if j < n and t[j].text in ("=>", "function"):
                    i = yield from self.function(i + 1, t[i + 1].text, own, self.exported(i))
                else:
                    i += 1
            else:
                i += 1
        for c in body.calls(t, self.language):
            if c.name in EXPRESS and "." not in c.receiver and c.receiver in ("app", "router", "server", "api") and c.args and c.args[0][0].kind == "str":
                yield "endpoint", {"http_method": "GET" if c.name == "all" else c.name.upper(), "prefix": [], "parts": [c.args[0][0].value], "handler_fqn": "", "kotlin": False, "raw": True}

    def exported(self, i: int) -> bool:
        return any(x.text == "export" for x in self.t[max(0, i - 3) : i])

    def route(self) -> str:
        parts = [p for p in re.split(r"[\\/]", self.path) if p]
        at = next((k for k, p in enumerate(parts) if p in ("app", "pages")), None)
        if at is None:
            return "/" + (parts[-2] if self.name in ("route", "index") and len(parts) > 1 else self.name)
        rest = [re.sub(r"\.\w+$", "", p) for p in parts[at + 1 :]]
        if rest and rest[-1] in ("route", "index"):
            rest.pop()
        return "/" + "/".join("{" + p[1:-1] + "}" if p.startswith("[") and p.endswith("]") else p for p in rest)

    def klass(self, i: int) -> Iterator[Fact]:
        t = self.t
        name = t[i].text
        own = {"name": name, "fqn": f"{self.module}.{name}", "is_interface": False, "is_object": False, "enclosing_class_name": "", "annotations": [], "package": self.module, "line": t[i].line}
        yield "class", own
        j = after_generics(t, i + 1)
        kind = ""
        while j < len(t) and t[j].text != "{":
            if t[j].text in ("extends", "implements"):
                kind = t[j].text
            elif t[j].kind == "id" and kind:
                yield "parent", {"child_fqn": own["fqn"], "package": self.module, "parent": t[j].text, "kind": kind}
            j += 1
        end = closing(t, j)
        k = j + 1
        while k < end:
            if t[k].kind == "id" and k + 1 < end and t[k + 1].text == "(" and t[k].text not in body.KEYWORDS - {"constructor"}:
                k = yield from self.function(k, "<init>" if t[k].text == "constructor" else t[k].text, own, False)
            elif t[k].text in "({[":
                k = closing(t, k, end) + 1
            else:
                k += 1
        return end + 1

    def function(self, i: int, name: str, owner: dict, exported: bool) -> Iterator[Fact]:
        t, j, n = self.t, i + 1, len(self.t)
        params: list[list[Token]] = []
        while j < n and t[j].text not in ("{", "=>", ";"):
            if t[j].text == "(":
                close = closing(t, j)
                params = params or split_commas(t[j + 1 : close])
                j = close + 1
            else:
                j += 1
        if j < n and t[j].text == "=>":
            j += 1
        if j < n and t[j].text == "{":
            stop = closing(t, j)
            code = t[j + 1 : stop]
        else:
            stop = j
            while stop < n and t[stop].text != ";" and t[stop].line == t[min(j, n - 1)].line:
                stop = closing(t, stop) + 1 if t[stop].text in "({[" else stop + 1
            code = t[j:stop]
        base = f"{owner['fqn']}.{name}"
        k = self.seen[base] = self.seen.get(base, 0) + 1
        fqn = base if k == 1 else f"{base}#{k}"
        sites = body.calls(code, self.language)
        entry = exported and (name in ROUTES or "pages" in self.path and "/api/" in self.path)
        yield "method", {"name": name, "fqn": fqn, "class_fqn": owner["fqn"], "class_name": owner["name"], "package": owner["package"], "line_start": t[i].line, "is_suspend": any(x.text == "async" for x in t[max(0, i - 2) : i + 4]), "annotations": [], "generated": False,
                         "is_entry_point": entry, "complexity_hint": body.complexity(code, sites, name, [x[0].text for x in params]), "io_fanout": 0, "io_parallel_count": 0, "io_serial_count": 0, "io_parallel_wrapper": ""}
        for c in [*sites, *body.references(code, self.language)]:
            yield "site", {"caller_fqn": fqn, "caller_class": owner["fqn"], "package": owner["package"], "receiver": c.receiver, "callee": c.name, "argc": len(c.args), "line": c.line}
        for verb, url in body.requests(sites, self.language, code):
            yield "rest", {"caller_fqn": fqn, "http_method": verb, "url_pattern": url}
        if entry:
            yield "endpoint", {"http_method": name if name in ROUTES else "GET", "prefix": [], "parts": [self.route()], "handler_fqn": fqn, "kotlin": False, "raw": True}
        return stop + 1
