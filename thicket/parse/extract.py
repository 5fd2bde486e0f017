"""Symbols, imports, exports and references out of one source file, by its tokens and matched brackets.

It needs no complete parse: in a damaged file what can't be read is skipped, open brackets are closed, and all that stands before and
after is extracted. Plug-ins are functions of the file's ``Reader`` that add to its lists, in the order of ``EXTRACTORS``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field

from thicket.errors import ParseError
from thicket.operators.resolve import BUILTINS
from thicket.parse.js_lexer import SyntaxFault, tokenize, tokenize_damaged
from thicket.parse.words import DIALECTS

# Suffixes of each dialect (plain JavaScript is read with JSX), verbs of routes, and built-in hooks.
BY_SUFFIX = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "jsx", "jsx": "jsx", "mjs": "jsx", "cjs": "jsx"}
VERBS = {"get", "post", "put", "patch", "delete", "head", "options", "all"}
BUILTIN_HOOKS = set(
    """useState useEffect useContext useReducer useCallback useMemo useRef useImperativeHandle useLayoutEffect useDebugValue useDeferredValue useTransition useId
    useSyncExternalStore useInsertionEffect useOptimistic useActionState""".split()
)
_HOOK = re.compile(r"use[A-Z0-9]")
_IDENT = re.compile(r"[\w$]+")


@dataclass
class Symbol:
    kind: str
    name: str
    qualified: str
    signature: str
    start: int
    end: int
    exported: bool
    first: int
    last: int
    doc: str | None = None
    meta: dict[str, str] = field(default_factory=dict)
    outer: Symbol | None = None


class Reader:
    """A file's tokens, with what was found in it so far."""

    def __init__(self, path: str, text: str):
        suffix = path.rsplit(".", 1)[-1].lower()
        if suffix not in BY_SUFFIX:
            raise ParseError(f"no parser for {path!r}")
        self.path, self.text, self.error = path, text, None
        ts, jsx = DIALECTS[BY_SUFFIX[suffix]]
        try:
            tokens = tokenize(text, ts, jsx)
        except SyntaxFault as fault:
            self.error = f"{fault} at line {text.count(chr(10), 0, fault.offset) + 1}"
            tokens = tokenize_damaged(text, ts, jsx)
        self.kinds, self.lines, self.match, self.offsets = tokens
        self.n = len(self.kinds) - 1
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.symbols: list[Symbol] = []
        self.imports: list[dict] = []
        self.exports: list[dict] = []
        self.refs: list[dict] = []
        self.named: set[int] = set()
        self.file_doc: str | None = None
        self._seen: set[tuple] = set()
        self._qualified: set[str] = set()
        # Symbols that are scopes, by their first token.
        self._firsts: list[int] = []
        self._scopes: list[Symbol] = []

    def word(self, i: int) -> str:
        m = _IDENT.match(self.text, self.offsets[i]) if i < self.n else None
        return m[0] if m else ""

    def string(self, i: int) -> str | None:
        """The value of a plain string token."""
        if i >= self.n or self.kinds[i] not in ("STR", "JSTR", "TPL"):
            return None
        start = self.offsets[i]
        quote = self.text[start]
        end = start + 1
        while end < len(self.text) and self.text[end] != quote:
            end += 2 if self.text[end] == "\\" else 1
        return self.text[start + 1 : end]

    def line(self, i: int) -> int:
        return bisect_right(self.breaks, self.offsets[min(i, self.n)] - 1) + 1

    def is_name(self, i: int) -> bool:
        return i < self.n and (self.kinds[i] == "ID" or self.kinds[i] in ("async", "of", "get", "set", "type", "from", "as", "declare", "is", "module", "namespace", "require", "out", "constructor"))

    def close(self, i: int) -> int:
        return self.match[i] if 0 <= i < self.n and self.match[i] > i else min(i + 1, self.n)

    def body_after(self, i: int) -> int:
        """The '{' of the body that follows parameters closed before ``i``, over a return type; -1 without one."""
        typed = i < self.n and self.kinds[i] == ":"
        while i < self.n:
            k = self.kinds[i]
            if k == "{":
                if typed and self.kinds[i - 1] in (":", "|", "&", "<", ",", "=>", "extends", "is"):
                    i = self.close(i) + 1
                    continue
                return i
            if k in (";", "}", "EOF") or k == "=>" and not typed:
                return -1
            i = self.close(i) + 1 if k in "([" else i + 1
        return -1

    def end_of_expression(self, i: int) -> int:
        """The last token of the expression that starts at ``i``."""
        last = i
        while i < self.n:
            k = self.kinds[i]
            if k in (";", ",", ")", "]", "}") or i > last and self.lines[i] and self.kinds[i - 1] not in ("=>", "=", "(", ",", "?", ":", "&&", "||", "+", ".", "|", "&") and k not in (".", "?.", "?", ":", "&&", "||", "+", "|", "&"):
                break
            last = i
            i = self.close(i) + 1 if k in "([{" else i + 1
            last = i - 1
        return last

    def scope_at(self, i: int) -> Symbol | None:
        """The innermost symbol around a token, its own name aside."""
        n = bisect_left(self._firsts, i) - 1
        s = self._scopes[n] if n >= 0 else None
        while s and i > s.last:
            s = s.outer
        return s

    def add(self, kind: str, name: str, first: int, last: int, head: int, exported: bool, **meta: str) -> Symbol:
        parent = self.scope_at(first)
        qualified = f"{parent.qualified}.{name}" if parent else name
        signature = " ".join(self.text[self.offsets[first] : self.offsets[min(head, self.n)]].split())
        s = Symbol(kind, name, qualified, signature, self.line(first), self.line(last), exported, first, last, meta=meta, outer=parent)
        if qualified not in self._qualified:
            self._qualified.add(qualified)
            self.symbols.append(s)
            if kind not in ("variable", "interface", "enum", "typeAlias"):
                at = bisect_right(self._firsts, first)
                self._firsts.insert(at, first)
                self._scopes.insert(at, s)
        return s

    def span(self, first: int, last: int) -> str:
        """The text of tokens, with its space folded."""
        return " ".join(self.text[self.offsets[first] : self.offsets[min(last + 1, self.n)]].split())

    def ref(self, i: int, name: str, kind: str) -> None:
        scope = self.scope_at(i)
        key = (scope.qualified if scope else None, name, kind, self.line(i))
        if key not in self._seen:
            self._seen.add(key)
            self.refs.append({"scope": key[0], "name": name, "kind": kind, "line": key[3]})

    def chain(self, i: int) -> tuple[str, int]:
        """A dotted chain of names from ``i`` and the token after it."""
        parts = [self.word(i)]
        i += 1
        while i + 1 < self.n and self.kinds[i] in (".", "?.") and _IDENT.match(self.text, self.offsets[i + 1]):
            parts.append(self.word(i + 1))
            i += 2
        return ".".join(parts), i


def _start(r: Reader, i: int) -> tuple[int, bool]:
    """The first token of a declaration with its modifiers, and whether it is exported."""
    exported = False
    while i > 0 and r.kinds[i - 1] in ("async", "export", "default", "abstract", "declare"):
        i -= 1
        exported = exported or r.kinds[i] == "export"
    return i, exported


def _function_value(r: Reader, i: int) -> tuple[int, int] | None:
    """(end of the head, last token) of a function expression or arrow at ``i``."""
    k = i + (r.kinds[i] == "async")
    if r.kinds[k] == "function":
        p = k + 1
        while p < r.n and r.kinds[p] != "(":
            p += 1
        body = r.body_after(r.close(p) + 1)
        return (body, r.close(body)) if body > 0 else None
    if r.kinds[k] == "<":
        while k < r.n and r.kinds[k] != "(":
            k += 1
    after = r.close(k) + 1 if r.kinds[k] == "(" else k + 1
    if not (r.kinds[k] == "(" or r.is_name(k)):
        return None
    if after < r.n and r.kinds[after] == ":" and r.kinds[k] == "(":
        while after < r.n and r.kinds[after] not in ("=>", ";", ",", "EOF"):
            after = r.close(after) + 1 if r.kinds[after] in "([{" else after + 1
    if after >= r.n or r.kinds[after] != "=>":
        return None
    body = after + 1
    return (body, r.close(body)) if r.kinds[body] == "{" else (body, r.end_of_expression(body))


def symbols(r: Reader) -> None:
    """Functions, function-valued variables, classes with methods, types and module variables."""
    depth_end: list[int] = []
    for i in range(r.n):
        while depth_end and i >= depth_end[-1]:
            depth_end.pop()
        k = r.kinds[i]
        top = not depth_end
        if k == "{":
            depth_end.append(r.close(i))
        if i and r.kinds[i - 1] in (".", "?."):
            continue
        if k == "function" and r.kinds[i - 1 if i else 0] not in ("=", "(", ",", ":", "return", "=>"):
            n = i + 1 + (r.kinds[i + 1] == "*")
            if r.is_name(n):
                p = n + 1
                while p < r.n and r.kinds[p] not in ("(", "{", ";"):
                    p += 1
                body = r.body_after(r.close(p) + 1)
                first, exported = _start(r, i)
                last = r.close(body) if body > 0 else r.close(p)
                r.add("function", r.word(n), first, last, body if body > 0 else last + 1, exported, **{"async": str(r.kinds[i - 1] == "async").lower() if i else "false", "generator": str(n > i + 1).lower()})
        elif k in ("const", "let", "var") and r.is_name(i + 1):
            eq = i + 2
            while eq < r.n and r.kinds[eq] not in ("=", ";", ",") and not (r.lines[eq] and r.kinds[eq - 1] not in (":", "|", "&", "<", ",")):
                eq = r.close(eq) + 1 if r.kinds[eq] in "([{" else eq + 1
            first, exported = _start(r, i)
            value = eq + 1 if eq < r.n and r.kinds[eq] == "=" else None
            f = _function_value(r, value) if value and value < r.n else None
            if f:
                arrow = r.kinds[value + (r.kinds[value] == "async")] != "function"
                r.add("function", r.word(i + 1), first, f[1], f[0], exported, **{"async": str(r.kinds[value] == "async").lower(), "arrow": str(arrow).lower()})
            elif top:
                last = r.end_of_expression(value) if value else i + 1
                made = r.chain(value)[0] if value and r.is_name(value) else ""
                wrapped = made.split(".")[-1] in ("memo", "forwardRef")
                kind = "context" if made.split(".")[-1] == "createContext" else "component" if wrapped and r.word(i + 1)[:1].isupper() else "variable"
                r.add(kind, r.word(i + 1), first, last, value or last + 1, exported, varKind=k)
        elif k == "class" and r.is_name(i + 1):
            body = i + 2
            while body < r.n and r.kinds[body] != "{":
                body = r.close(body) + 1 if r.kinds[body] in "([" else body + 1
            first, exported = _start(r, i)
            c = r.add("class", r.word(i + 1), first, r.close(body), body, exported)
            heritage = None
            for j in range(i + 2, body):
                if r.kinds[j] in ("extends", "implements"):
                    heritage = r.kinds[j]
                elif heritage and r.is_name(j) and r.kinds[j - 1] in ("extends", "implements", ","):
                    name, _ = r.chain(j)
                    r.ref(j, name, heritage)
                    if name.split(".")[-1] in ("Component", "PureComponent"):
                        c.kind = "component"
            _methods(r, body, c)
        elif k in ("interface", "enum") and r.is_name(i + 1) and r.kinds[i - 1 if i else 0] != "const" or k == "enum" and r.is_name(i + 1):
            body = i + 2
            while body < r.n and r.kinds[body] != "{":
                body += 1
            first, exported = _start(r, i - 1 if i and r.kinds[i - 1] == "const" else i)
            r.add(k, r.word(i + 1), first, r.close(body), body, exported, members=",".join(_members(r, body)), const=str(i > 0 and r.kinds[i - 1] == "const").lower())
            if k == "interface" and r.kinds[i + 2] == "extends":
                for j in range(i + 3, body):
                    if r.is_name(j) and r.kinds[j - 1] in ("extends", ","):
                        r.ref(j, r.chain(j)[0], "extends")
        elif k == "type" and r.is_name(i + 1) and r.kinds[i + 2] in ("=", "<") and (i == 0 or r.lines[i] or r.kinds[i - 1] in ("export", ";", "declare", "}")):
            first, exported = _start(r, i)
            last = r.end_of_expression(i + 2)
            alias = r.add("typeAlias", r.word(i + 1), first, last, last + 1, exported)
            eq = next((j for j in range(i + 2, last + 1) if r.kinds[j] == "="), last)
            alias.signature = f"type {r.word(i + 1)} = {r.span(eq + 1, last).rstrip(';').rstrip() if eq < last else 'unknown'}"


def _members(r: Reader, body: int) -> list[str]:
    """Names of the members of an interface or enum, in order."""
    out, i, end = [], body + 1, r.close(body)
    while i < end:
        j = i
        while j < end and r.kinds[j] in ("readonly", "get", "set", "static") and r.kinds[j + 1] not in (":", "?", "(", ";", ",", "}", "<"):
            j += 1
        name = r.string(j) if r.kinds[j] == "STR" else r.word(j)
        if name and r.kinds[j] != "[":
            out.append(name)
        while i < end and r.kinds[i] not in (";", ",") and not (i > j and r.lines[i] and r.kinds[i - 1] not in (":", "|", "&", "=", "<", "=>", "?")):
            i = r.close(i) + 1 if r.kinds[i] in "([{" else i + 1
        i += i < end and r.kinds[i] in (";", ",")
    return out


def _methods(r: Reader, body: int, c: Symbol) -> None:
    end, i = r.close(body), body + 1
    while i < end:
        first = i
        while i < end and r.kinds[i] in ("static", "async", "public", "private", "protected", "readonly", "abstract", "override", "get", "set", "*", "@") and r.kinds[i + 1] != "(":
            i = r.chain(i + 1)[1] if r.kinds[i] == "@" else i + 1
            if i < end and r.kinds[i - 1] != "@" and r.kinds[i] == "(" and r.kinds[first] == "@":
                i = r.close(i) + 1
        name = r.text[r.offsets[i] :] if i < end else ""
        m = re.match(r"#?[\w$]+", name)
        k = i + 1
        if m and k < end and r.kinds[k] == "<":
            while k < end and r.kinds[k] != "(":
                k += 1
        if m and k < end and r.kinds[k] == "(":
            block = r.body_after(r.close(k) + 1)
            last = r.close(block) if block > 0 else r.close(k)
            marks = set(r.kinds[first:i])
            r.named.add(i)
            meta = {"static": str("static" in marks).lower(), "async": str("async" in marks).lower(), "abstract": str("abstract" in marks).lower(), "visibility": next((v for v in ("private", "protected") if v in marks), "public")}
            r.add("method", m[0], first, last, block if block > 0 else last + 1, False, **meta)
            i = last + 1
        else:
            while i < end and r.kinds[i] != ";" and not (i > first and r.lines[i]):
                i = r.close(i) + 1 if r.kinds[i] in "([{" else i + 1
            i = i + 1 if i < end and r.kinds[i] == ";" else max(i, first + 1)


def modules(r: Reader) -> None:
    """Imports and exports of all forms."""
    for i in range(r.n):
        k = r.kinds[i]
        before = r.kinds[i - 1] if i else ""
        if k == "import" and before not in (".", "?."):
            if r.kinds[i + 1] == "(":
                source = r.string(i + 2)
                if source is not None:
                    _import(r, i, source, "dynamic", [])
                continue
            if r.kinds[i + 1] == "STR":
                _import(r, i, r.string(i + 1), "sideEffect", [])
                continue
            j, names = i + 1, []
            while j < r.n and r.kinds[j] not in ("STR", ";") and not (r.kinds[j] == "=" and j > i + 1):
                if r.kinds[j] == "{":
                    names += [(local, imported) for imported, local in _named(r, j)]
                    j = r.close(j)
                elif r.kinds[j] == "*" and r.kinds[j + 1] == "as":
                    names.append((r.word(j + 2), "*"))
                    j += 2
                elif r.is_name(j) and r.kinds[j] != "from" and not (r.kinds[j] == "type" and r.kinds[j + 1] not in ("from", ",")):
                    names.append((r.word(j), "default"))
                j += 1
            if j < r.n and r.kinds[j] == "STR":
                _import(r, i, r.string(j), "static", names)
        elif r.word(i) == "require" and r.kinds[i + 1] == "(" and before not in (".", "?.") and r.string(i + 2) is not None:
            _import(r, i, r.string(i + 2), "require", [])
        elif k == "export" and before != ".":
            _export(r, i)


def _named(r: Reader, brace: int) -> list[tuple[str, str]]:
    """(name, alias) of each entry of an import or export list."""
    out, j, end = [], brace + 1, r.close(brace)
    while j < end:
        if r.kinds[j] == "type" and r.kinds[j + 1] not in (",", "}", "as"):
            j += 1
        name = r.string(j) if r.kinds[j] == "STR" else r.word(j)
        alias = name
        if r.kinds[j + 1] == "as":
            alias = r.word(j + 2)
            j += 2
        if name:
            out.append((name, alias))
        j += 2
    return out


def _import(r: Reader, i: int, source: str, kind: str, names: list[tuple[str, str]]) -> None:
    group = "relative" if source.startswith(".") else "builtin" if source.startswith("node:") or source in BUILTINS else "package"
    r.imports.append({"source": source, "kind": kind, "source_class": group, "line": r.line(i), "specifiers": [{"local": a, "imported": b} for a, b in names]})


def _export(r: Reader, i: int) -> None:
    def out(name: str, local: str | None, kind: str, source: str | None) -> None:
        r.exports.append({"ord": len(r.exports), "name": name, "local": local, "kind": kind, "source": source, "line": r.line(i)})

    j = i + 1 + (r.kinds[i + 1] == "type" and r.kinds[i + 2] in ("{", "*"))
    if r.kinds[j] == "*":
        name = r.word(j + 2) if r.kinds[j + 1] == "as" else "*"
        source = next((r.string(x) for x in range(j, min(j + 6, r.n)) if r.kinds[x] == "STR"), None)
        out(name, None, "star", source)
    elif r.kinds[j] == "{":
        end = r.close(j)
        source = r.string(end + 2) if r.kinds[end + 1] == "from" else None
        for local, name in _named(r, j):
            out(name, local, "reExport" if source is not None else "default" if name == "default" else "named", source)
    elif r.kinds[j] == "default":
        k = j + 1
        while r.kinds[k] in ("async", "abstract", "function", "class", "*") and not r.kinds[k + 1] == "=>":
            k += 1
        out("default", r.word(k) if r.is_name(k) else "default", "default", None)
    else:
        k = j
        while r.kinds[k] in ("async", "abstract", "declare", "const", "let", "var", "function", "class", "interface", "type", "enum", "namespace", "*") and not (r.kinds[k] == "type" and r.kinds[k + 1] in ("=", ";")):
            k += 1
        if r.is_name(k):
            out(r.word(k), r.word(k), "named", None)


def _props(r: Reader, s: Symbol) -> tuple[list[str], str | None]:
    """(names that a component takes out of its first parameter, that parameter's type)."""
    p = next((i for i in range(s.first, s.last) if r.kinds[i] == "(" and (r.kinds[r.close(i) + 1] in ("=>", "{", ":") or "function" in r.kinds[max(0, i - 2) : i])), None)
    if p is None or s.kind == "class" or r.kinds[p + 1] == ")":
        return [], None
    end, names, j = r.close(p), [], p + 2
    if r.kinds[p + 1] == "{":
        close = r.close(p + 1)
        at = p + 2
        while at < close:
            names.append("..." + r.word(at + 1) if r.kinds[at] == "..." else r.word(at))
            while at < close and r.kinds[at] != ",":
                at = r.close(at) + 1 if r.kinds[at] in "([{" else at + 1
            at += 1
        j = close + 1
    j += r.kinds[j] == "?"
    if r.kinds[j] != ":":
        return [n for n in names if n], None
    last = j + 1
    depth = 0
    while last < end and not (depth == 0 and r.kinds[last] in (",", "=")):
        depth += (r.kinds[last] == "<") - (r.kinds[last] == ">")
        last = r.close(last) + 1 if r.kinds[last] in "([{" else last + 1
    return [n for n in names if n], r.span(j + 1, last - 1)


def components(r: Reader) -> None:
    """Components and hooks among the functions, what they take and what they render."""
    elements = [i for i in range(r.n) if r.kinds[i] == "<J"]
    for s in r.symbols:
        tags: Counter[str] = Counter()
        if s.kind in ("function", "component", "class"):
            inside = elements[bisect_left(elements, s.first) : bisect_right(elements, s.last)]
            for i in inside:
                if i + 1 < r.n and r.kinds[i + 1] == "JNAME":
                    name, j = r.word(i + 1), i + 2
                    while r.kinds[j] == ".J":
                        name += "." + r.word(j + 1)
                        j += 2
                    if name[:1].isupper() or "." in name:
                        tags[name] += 1
            if s.kind == "function" and inside and s.name[:1].isupper():
                s.kind = "component"
            if s.kind == "component":
                s.meta["jsxUsage"] = ",".join(f"{n}:{c}" for n, c in sorted(tags.items()))
                props, kind = _props(r, s)
                s.meta["props"] = ",".join(props)
                if kind:
                    s.meta["propsType"] = kind
                provided = sorted(t.removesuffix(".Provider") for t in tags if t.endswith(".Provider"))
                if provided:
                    s.meta["providesContexts"] = ",".join(provided)
        if s.kind == "function" and _HOOK.match(s.name):
            s.kind = "hook"


def express_routes(r: Reader) -> None:
    """Calls of a verb with a path: ``app.get('/x', handler)``."""
    for i in range(r.n - 3):
        if r.kinds[i] == "." and r.kinds[i + 2] == "(" and r.word(i + 1) in VERBS:
            path = r.string(i + 3)
            if path is not None and path.startswith("/"):
                close = r.close(i + 2)
                _route(r, i, close, r.word(i + 1).upper(), path)
                for j in range(i + 5, close):
                    if r.is_name(j) and r.kinds[j - 1] == "," and r.kinds[j + 1] in (",", ")"):
                        r.refs.append({"scope": f"{r.word(i + 1).upper()} {path.replace(':', '$')}", "name": r.word(j), "kind": "handles", "line": r.line(j)})


def element_routes(r: Reader) -> None:
    """Route elements of a router, with the component that they show."""
    for i in range(r.n - 3):
        if r.kinds[i] == "<J" and r.word(i + 1) == "Route":
            j, path, element = i + 2, None, None
            while j < r.n and r.kinds[j] not in (">J", "/>J"):
                if r.kinds[j] == "JNAME" and r.word(j) == "path":
                    path = r.string(j + 2)
                elif r.kinds[j] == "JNAME" and r.word(j) in ("element", "component", "Component") and r.kinds[j + 2] == "{":
                    element = r.word(j + 4) if r.kinds[j + 3] == "<J" else r.word(j + 3)
                    j = r.close(j + 2)
                j += 1
            if path is not None:
                _route(r, i, j, "ROUTE", path)
                if element:
                    r.refs.append({"scope": f"ROUTE {path.replace(':', '$')}", "name": element, "kind": "handles", "line": r.line(i)})


def folder_routes(r: Reader) -> None:
    """Pages and APIs that a file's place below app/ or pages/ makes."""
    m = re.match(r"^(?:src/)?app/(.*?/?)(page|route)\.[jt]sx?$", r.path) or re.match(r"^(?:src/)?pages/(.*?)()\.[jt]sx?$", r.path)
    if m and r.n:
        pattern = "/" + re.sub(r"\[(?:\.\.\.)?(\w+)\]", r":\1", re.sub(r"\(\w+\)/", "", m[1])).removesuffix("index").strip("/")
        _route(r, 0, r.n - 1, "PAGE" if m[2] != "route" else "API", pattern)


#: Plug-ins that find routes; add a function of the ``Reader`` to find those of another framework.
ROUTE_DETECTORS = [express_routes, element_routes, folder_routes]


def routes(r: Reader) -> None:
    for detect in ROUTE_DETECTORS:
        detect(r)


def _route(r: Reader, first: int, last: int, verb: str, pattern: str) -> None:
    name = f"{verb} {pattern.replace(':', '$')}"
    if name not in r._qualified:
        r._qualified.add(name)
        r.symbols.append(Symbol("route", name, name, name, r.line(first), r.line(last), False, first, first, meta={"routePattern": pattern}))


def references(r: Reader) -> None:
    """Calls, hooks and rendered elements; reads and writes of the module's own variables, unless a scope shadows them."""
    shared = {s.name for s in r.symbols if s.kind in ("variable", "context") and "." not in s.qualified}
    shadows: dict[str, set[str]] = {}
    for s in r.symbols:
        if s.kind in ("function", "component", "hook", "method"):
            own = shadows.setdefault(s.qualified, set())
            for i in range(s.first, s.last):
                if r.kinds[i] in ("const", "let", "var") and r.is_name(i + 1):
                    own.add(r.word(i + 1))
            p = next((i for i in range(s.first, s.last) if r.kinds[i] == "("), None)
            if p is not None:
                own |= {r.word(i) for i in range(p, r.close(p)) if r.is_name(i)}
    used: dict[str, tuple[Symbol, dict[str, dict[str, None]]]] = {}
    # What stands in a type is no call.
    types = {i for s in r.symbols if s.kind in ("interface", "typeAlias") for i in range(s.first, s.last + 1)}
    for i in range(r.n):
        if i in types:
            continue
        before = r.kinds[i - 1] if i else ""
        k = r.kinds[i]
        if k == "<J" and r.kinds[i + 1] == "JNAME":
            name, j = r.word(i + 1), i + 2
            while r.kinds[j] == ".J":
                name += "." + r.word(j + 1)
                j += 2
            if name[:1].isupper() or "." in name:
                r.ref(i, name, "jsx")
            continue
        if before in (".", "?.", "function", "class", "interface", "new", "enum") or not (r.is_name(i) or k in ("this", "super")):
            continue
        name, after = r.chain(i)
        if after < r.n and r.kinds[after] == "<":
            j = after
            while j < r.n and j < after + 40 and r.kinds[j] not in ("(", ";", ")", "{"):
                j += 1
            after = j if r.kinds[j] == "(" and r.kinds[j - 1] == ">" else after
        if after < r.n and r.kinds[after] == "(" and k != "super":
            if i not in r.named:
                called = name.split(".")[-1]
                hook = _HOOK.match(called)
                r.ref(i, name, "hook" if hook else "call")
                scope = r.scope_at(i) if hook else None
                if scope:
                    used.setdefault(scope.qualified, (scope, {}))[1].setdefault("hooksUsed", {})[called] = None
                if called in ("useContext", "useReducer") and r.is_name(after + 1):
                    read = r.chain(after + 1)[0]
                    r.ref(after + 1, read, "read")
                    if scope:
                        used[scope.qualified][1].setdefault("consumesContexts" if called == "useContext" else "reducers", {})[read] = None
        first = name.split(".")[0]
        if first in shared and before not in ("const", "let", "var") and not (after < r.n and r.kinds[after] == ":" and before in ("{", ",")):
            scope = r.scope_at(i)
            around = scope.qualified.split(".") if scope else []
            if scope and not any(first in shadows.get(".".join(around[:n]), ()) for n in range(1, len(around) + 1)):
                write = after < r.n and after == i + 1 and (r.kinds[after].endswith("=") and r.kinds[after] not in ("==", "===", "!=", "!==", "<=", ">=") or r.kinds[after] in ("++", "--"))
                r.ref(i, first, "write" if write else "read")
    for scope, found in used.values():
        for name, values in found.items():
            scope.meta[name] = ",".join(values)
        scope.meta["customHooksUsed"] = ",".join(h for h in found.get("hooksUsed", ()) if h not in BUILTIN_HOOKS)


_PARAM = re.compile(r"@param\s+(?:\{[^}]*\}\s+)?(\[?[\w.$]+\]?)\s*-?\s*([^\n]*)")


def read_doc(raw: str) -> tuple[str, dict[str, str]]:
    """(text of a documentation block, its tags): the summary ahead of the first tag, parameters, returns and deprecation."""
    text = "\n".join(re.sub(r"^\s*\*? ?", "", x).rstrip() for x in raw.removeprefix("/**").removesuffix("*/").split("\n")).strip()
    first = re.search(r"^@\w", text, re.M)
    tags = text[first.start() :] if first else ""
    meta = {"summary": (text[: first.start()] if first else text).strip()}
    params = [f"{m[1].strip('[]')}: {m[2].strip()}" for m in _PARAM.finditer(tags)]
    if params:
        meta["params"] = "\n".join(params)
    returns = re.search(r"@returns?\s+([^\n]*)", tags)
    if returns and returns[1].strip():
        meta["returns"] = returns[1].strip()
    deprecated = re.search(r"@deprecated\s*([^\n]*)", tags)
    if deprecated:
        meta["deprecated"] = deprecated[1].strip() or "true"
    return text, meta


def docs(r: Reader) -> None:
    """Documentation blocks that end right ahead of a symbol, and one at the top that belongs to none: the file's."""
    taken: set[int] = set()
    for s in r.symbols:
        if s.kind == "route":
            continue
        at = r.offsets[s.first]
        while at and r.text[at - 1].isspace():
            at -= 1
        if r.text.endswith("*/", 0, at):
            start = r.text.rfind("/**", 0, at - 2)
            if start >= 0 and r.text.find("*/", start + 3) == at - 2:
                taken.add(start)
                text, meta = read_doc(r.text[start:at])
                s.doc = text or None
                s.meta |= {k: v for k, v in meta.items() if v and k != "summary"}
    top = 1 if r.text.startswith("\ufeff") else 0
    if r.text.startswith("/**", top) and top not in taken:
        end = r.text.find("*/", top + 3)
        if end >= 0:
            r.file_doc = read_doc(r.text[top : end + 2])[1]["summary"]


EXTRACTORS = [symbols, modules, components, routes, references, docs]


def extract(path: str, text: str, extractors=None) -> Reader:
    """All that a file holds; raises ParseError for a suffix without parser."""
    r = Reader(path, text)
    for step in extractors or EXTRACTORS:
        step(r)
    return r
