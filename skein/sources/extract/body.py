"""What a method's body tells: call sites, complexity hints, I/O calls, outbound requests."""

from __future__ import annotations

from typing import NamedTuple

from skein.sources.extract.lexer import Token, closing, split_commas

# Words before a parenthesis that are no calls.
KEYWORDS = frozenset("if for while switch when catch return synchronized super this throw else do try new function fun typeof instanceof in is as await yield assert constructor".split())
# Names of database, request and cache calls, and of parallel wrappers.
FETCH = frozenset("findById findAll findOne getOne getById load fetch".split())
DB = frozenset("save saveAll delete deleteById findAll findById findOne getOne getById count existsById execute executeQuery executeUpdate prepareStatement query queryForObject queryForList".split())
HTTP = frozenset("exchange getForObject postForObject getForEntity postForEntity retrieve bodyToMono block".split())
CACHE = frozenset("get put evict".split())
COROUTINE = frozenset("async coroutineScope withContext runBlocking".split())
FUTURE = frozenset("supplyAsync runAsync allOf thenCompose thenCombine thenApply".split())
REACTOR = frozenset("zip merge when".split())
# Request methods of clients and their verbs; clients by name.
REST = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST", "put": "PUT", "delete": "DELETE", "exchange": "DYNAMIC", "execute": "DYNAMIC", "get": "GET", "post": "POST", "retrieve": "GET"}
CLIENTS = frozenset("restTemplate restClient webClient".split())
VERBS = frozenset("GET POST PUT DELETE PATCH HEAD OPTIONS".split())


class Call(NamedTuple):
    receiver: str
    name: str
    args: list[list[Token]]
    at: int
    end: int
    line: int


def calls(tokens: list[Token], language: str) -> list[Call]:
    """Call sites in source order; `new X()` and Kotlin's `X()` call <init> of X."""
    out = []
    for i, t in enumerate(tokens[:-1]):
        if t.kind != "id" or t.text in KEYWORDS:
            continue
        j = i + 1
        trailing = tokens[j].text == "{" and language == "kotlin" and i and tokens[i - 1].text in (".", "?.")
        if tokens[j].text != "(" and not (trailing or language == "kotlin" and t.text in COROUTINE and tokens[j].text == "{"):
            continue
        if i and tokens[i - 1].text in ("fun", "function", "class", "@"):
            continue
        end = closing(tokens, j)
        args = split_commas(tokens[j + 1 : end]) if tokens[j].text == "(" else []
        if language == "kotlin" and end + 1 < len(tokens) and tokens[end + 1].text == "{" and tokens[j].text == "(":
            end = closing(tokens, end + 1)
        receiver, k = [], i - 1
        while k > 0 and tokens[k].text in (".", "?.", "!!"):
            if tokens[k].text == "!!":
                k -= 1
                continue
            k -= 1
            if tokens[k].text == ")":  # a call's result: its name stands for it
                depth = 0
                while k >= 0:
                    depth += (tokens[k].text == ")") - (tokens[k].text == "(")
                    k -= 1
                    if depth == 0:
                        break
            if k < 0 or tokens[k].kind != "id":
                break
            receiver.insert(0, tokens[k].text)
            k -= 1
        name = t.text
        made = k >= 0 and tokens[k].text == "new" or language == "kotlin" and name[:1].isupper() and not receiver
        if made:
            out.append(Call(name, "<init>", args, i, end, t.line))
        else:
            out.append(Call(".".join(receiver), name, args, i, end, t.line))
    return out


def references(tokens: list[Token], language: str) -> list[Call]:
    """Kotlin's references to functions, `::f` and `X::f`, as calls without arguments."""
    out = []
    for i, t in enumerate(tokens[:-1]):
        to = tokens[i + 1]
        if language == "kotlin" and t.text == "::" and to.kind == "id" and to.text != "class":
            receiver = tokens[i - 1].text if i and tokens[i - 1].kind == "id" and tokens[i - 1].line == t.line else ""
            out.append(Call(receiver, to.text, [], i, i + 1, t.line))
    return out


def loops(tokens: list[Token]) -> list[tuple[int, int]]:
    """(begin, end) of every loop with its body."""
    out = []
    for i, t in enumerate(tokens):
        if t.kind != "id" or t.text not in ("for", "while", "do") or i and tokens[i - 1].text == ".":
            continue
        j = i + 1
        if t.text != "do":
            if j >= len(tokens) or tokens[j].text != "(":
                continue
            j = closing(tokens, j) + 1
        if j < len(tokens) and tokens[j].text == "{":
            out.append((i, closing(tokens, j)))
        elif t.text != "do":
            while j < len(tokens) and tokens[j].text not in (";", "}"):
                j = closing(tokens, j) + 1 if tokens[j].text in "([{" else j + 1
            out.append((i, j))
    return out


def complexity(tokens: list[Token], sites: list[Call], name: str, params: list[str]) -> str:
    spans = loops(tokens)
    inside = lambda c: any(a < c.at <= b for a, b in spans)
    found = []
    if any(a < c <= b for a, b in spans for c, _ in spans):
        found.append("O(n2)-candidate")
    if any(c.name in ("contains", "indexOf") and inside(c) for c in sites):
        found.append("O(n2)-list-scan")
    if name not in ("<init>", "init", "") and any(c.name == name for c in sites):
        found.append("recursive")
    if any((c.name in FETCH or c.name.startswith("findBy")) and inside(c) for c in sites):
        found.append("n+1-risk")
    if not any("pageable" in p.lower() for p in params) and any(c.name.startswith(("findAll", "findBy")) for c in sites):
        found.append("unbounded-query")
    return ",".join(found)


def io_calls(sites: list[Call], annotations: list[str]) -> tuple[int, int, int, str]:
    """(total, parallel, serial, wrapper)."""
    cached = bool({"Cacheable", "CacheEvict"} & set(annotations))
    io = [c for c in sites if c.name in DB or c.name.startswith("findBy") or c.name in HTTP or cached or c.name in CACHE and "cache" in c.receiver.lower()]
    kinds = {
        "coroutine": [c for c in sites if c.name in COROUTINE],
        "completable_future": [c for c in sites if c.name in FUTURE],
        "reactor": [c for c in sites if c.name in REACTOR and c.receiver.split(".")[-1] in ("Mono", "Flux")],
    }
    wrapper = next((k for k, v in kinds.items() if v), "spring_async" if "Async" in annotations else "")
    spans = [(c.at, c.end) for v in kinds.values() for c in v]
    parallel = len(io) if wrapper == "spring_async" else sum(any(a < c.at <= b for a, b in spans) for c in io)
    return len(io), parallel, len(io) - parallel, wrapper


def built_urls(sites: list[Call], tokens: list[Token]) -> list[tuple[int, str, str]]:
    """(place, variable or '', url) of every UriComponentsBuilder chain: its base and its literal paths."""
    out: list[tuple[int, str, str]] = []
    for c in sites:
        literal = "".join(t.value for a in c.args[:1] for t in a if t.kind == "str")
        if c.name in ("fromHttpUrl", "fromUriString") and c.receiver.split(".")[-1] == "UriComponentsBuilder":
            named = c.at >= 4 and tokens[c.at - 3].text == "=" and tokens[c.at - 4].kind == "id"
            out.append((c.at, tokens[c.at - 4].text if named else "", literal))
        elif out and c.name == "path" and c.receiver.startswith("UriComponentsBuilder."):
            out[-1] = *out[-1][:2], out[-1][2] + literal
    return out


def requests(sites: list[Call], language: str, tokens: list[Token] = ()) -> list[tuple[str, str]]:
    """(verb, url) of outbound requests. A url is a literal, what a builder puts together, or
    has `${Class.FIELD}` for a constant; any other is DYNAMIC."""
    built = built_urls(sites, tokens)
    variables = {name: value for _, name, value in built if name}

    def url(args: list[list[Token]]) -> str:
        parts = args[0] if args else []
        if parts and all(t.kind == "str" or t.text == "+" for t in parts):
            return "".join(t.value for t in parts if t.kind == "str")
        if len(parts) == 3 and parts[0].kind == "str" and parts[1].text == "+":
            return parts[0].value + "{" + parts[2].text + "}"
        if parts and parts[0].kind == "id" and variables.get(parts[0].text):  # url, url.toString()
            return variables[parts[0].text]
        if any(t.text == "UriComponentsBuilder" for t in parts):
            inside = [value for at, _, value in built if any(tokens[at] is t for t in parts)]
            return inside[0] if inside and inside[0] else "DYNAMIC"
        return constant(parts)

    def constant(parts: list[Token]) -> str:
        out, ref = "", ""
        for t in [*parts, None]:
            if t is not None and (t.kind == "id" or t.text == "."):
                ref += t.text
                continue
            if ref:
                names = ref.split(".")
                if len(names) < 2 or not names[-2][:1].isupper() or names[-1] != names[-1].upper():
                    return "DYNAMIC"
                out, ref = out + "${" + ".".join(names[-2:]) + "}", ""
            if t is not None and t.kind == "str":
                out += t.value
            elif t is not None and t.text != "+":
                return "DYNAMIC"
        return out or "DYNAMIC"

    out = []
    for k, c in enumerate(sites):
        head = c.receiver.split(".")[0]
        if language in ("javascript", "typescript"):
            if c.name == "fetch" and not c.receiver:
                opts = c.args[1] if len(c.args) > 1 else []
                verb = next((opts[i + 2].value.upper() for i in range(len(opts) - 2) if opts[i].text == "method" and opts[i + 2].kind == "str"), "GET")
                out.append((verb, url(c.args)))
            elif c.receiver == "axios" and c.name in ("get", "post", "put", "delete", "patch"):
                out.append((c.name.upper(), url(c.args)))
        elif head in CLIENTS and c.name in REST and c.receiver == head:
            verb = REST[c.name]
            if verb == "DYNAMIC":
                verb = next((t.text for a in c.args for t in a if t.text in VERBS), "DYNAMIC")
            target = url(c.args)
            if not c.args:  # a fluent chain names its url later
                target = next((url(d.args) for d in sites[k + 1 :] if d.name == "uri" and head in d.receiver.split(".")), "DYNAMIC")
            out.append((verb, target))
    return out
