"""Grammars compiled to predictive, table-driven parsers.

A grammar is a text of rules. Each rule has ordered alternatives; for every alternative the compiler works out the set of token
kinds that can start it (its row of the predict table), so that an alternative is entered only where the next token allows it.
Rules marked ``!`` keep a chart of their results by position, which bounds the work where alternatives share a long prefix.

Notation of the right side: 'x' a token kind; Name a rule; @Set a named set of kinds; item? item* item+; ( a | b ) a group;
&item and !item look ahead; %name a predicate without width, which the caller gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_ITEM = re.compile(r"\s*(?:'([^']*)'|@(\w+)|%([\w;]+)|(\w+)|([()|?*+&!]))")


class _Parser:
    """Rules' right sides as trees: ('t', kind) ('s', set) ('p', predicate) ('r', rule) ('seq', ..) ('alt', ..) ('?', x) ('*', x) ('+', x) ('&', x) ('!', x)."""

    def __init__(self, text: str):
        self.items = [m for m in _ITEM.finditer(text)]
        self.at = 0

    def _sign(self) -> str | None:
        return self.items[self.at][5] if self.at < len(self.items) else None

    def alternatives(self):
        out = [self.sequence()]
        while self._sign() == "|":
            self.at += 1
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("alt", *out)

    def sequence(self):
        out = []
        while self.at < len(self.items) and self._sign() not in ("|", ")"):
            out.append(self.item())
        return out[0] if len(out) == 1 else ("seq", *out)

    def item(self):
        m = self.items[self.at]
        self.at += 1
        if m[5] in ("&", "!"):
            return (m[5], self.item())
        if m[5] == "(":
            node = self.alternatives()
            self.at += 1
        elif m[1] is not None:
            node = ("t", m[1])
        else:
            node = ("s", m[2]) if m[2] else ("p", m[3]) if m[3] else ("r", m[4])
        while self._sign() in ("?", "*", "+"):
            node = (self._sign(), node)
            self.at += 1
        return node


def read_rules(text: str) -> tuple[dict[str, tuple], set[str]]:
    """(rules, names of those with a chart) of a grammar's text; a rule starts at a line's first column as ``Name:`` or ``Name!:``."""
    rules, charted = {}, set()
    for part in re.split(r"\n(?=\w+!?:)", "\n" + re.sub(r"(?m)^\s*#.*$", "", text)):
        m = re.match(r"\s*(\w+)(!?):(.*)", part, re.S)
        if m:
            rules[m[1]] = _Parser(m[3]).alternatives()
            if m[2]:
                charted.add(m[1])
    return rules, charted


class Compiled:
    """A parser's source and its tables. ``bind`` gives the rules as functions of a position over one list of tokens.

    Its last argument takes the charts: by rule, the position after it (or -1) by that where it was tried.
    """

    def __init__(self, text: str, sets: dict[str, Iterable[str]], start: str, tracing: bool = False):
        self.rules, self.charted = read_rules(text)
        self.sets = {k: frozenset(v) for k, v in sets.items()}
        self.start, self.tracing = start, tracing
        self.tables: dict[str, frozenset[str]] = {}
        self.nothing: set[str] = set()
        self.first: dict[str, set[str]] = {n: set() for n in self.rules}
        self._close()
        self.predicates: set[str] = set()
        source = self._generate()
        scope: dict = {}
        exec(compile(source, f"<grammar {start}>", "exec"), {**self.tables}, scope)  # noqa: S102
        self.bind: Callable = scope["bind"]
        self.source = source

    def _close(self) -> None:
        changed = True
        while changed:
            changed = False
            for name, node in self.rules.items():
                starts, nothing = self._starts(node)
                if not starts <= self.first[name]:
                    self.first[name] |= starts
                    changed = True
                if nothing and name not in self.nothing:
                    self.nothing.add(name)
                    changed = True

    def _starts(self, node) -> tuple[set[str], bool]:
        kind = node[0]
        if kind == "t":
            return {node[1]}, False
        if kind == "s":
            return set(self.sets[node[1]]), False
        if kind in ("p", "&", "!"):
            return set(), True
        if kind == "r":
            return self.first[node[1]], node[1] in self.nothing
        if kind == "seq":
            found: set[str] = set()
            for x in node[1:]:
                starts, nothing = self._starts(x)
                found |= starts
                if not nothing:
                    return found, False
            return found, True
        if kind == "alt":
            both = [self._starts(x) for x in node[1:]]
            return set().union(*(s for s, _ in both)), any(n for _, n in both)
        starts, nothing = self._starts(node[1])
        return starts, nothing or kind in ("?", "*")

    def _table(self, kinds: Iterable[str]) -> str:
        kinds = frozenset(kinds)
        for name, known in self.tables.items():
            if known == kinds:
                return name
        name = f"T{len(self.tables)}"
        self.tables[name] = kinds
        return name

    def _test(self, kinds: set[str], at: str) -> str:
        if len(kinds) == 1:
            return f"K[{at}] == {next(iter(kinds))!r}"
        return f"K[{at}] in {self._table(kinds)}"

    def _generate(self) -> str:
        self.lines: list[str] = []
        self.fresh = 0
        bodies = []
        for name, node in self.rules.items():
            self.lines = []
            self._emit(f"def r_{name}(i):", 1)
            depth = 2
            if name in self.charted:
                self._emit(f"j = M_{name}.get(i)", depth)
                self._emit("if j is not None:", depth)
                self._emit("return j", depth + 1)
            self._node(node, "i", "j", depth)
            if name in self.charted:
                self._emit(f"M_{name}[i] = j", depth)
            self._emit("return j", depth)
            bodies += self.lines
        head = ["def bind(K, P, far, charts):"]
        head += [f"    p_{re.sub(';', 'semi', p)} = P[{p!r}]" for p in sorted(self.predicates)]
        head += [f"    M_{n} = charts[{n!r}] = {{}}" for n in sorted(self.charted)]
        return "\n".join([*head, *bodies, f"    return r_{self.start}"])

    def _emit(self, line: str, depth: int) -> None:
        self.lines.append("    " * depth + line)

    def _name(self) -> str:
        self.fresh += 1
        return f"v{self.fresh}"

    def _node(self, node, at: str, to: str, d: int) -> None:
        """Code that sets ``to`` to the position after ``node`` at ``at``, or to -1."""
        kind = node[0]
        if kind in ("t", "s"):
            kinds = {node[1]} if kind == "t" else set(self.sets[node[1]])
            if self.tracing:
                self._emit(f"if {at} > far[0]: far[0] = {at}", d)
            self._emit(f"{to} = {at} + 1 if {self._test(kinds, at)} else -1", d)
        elif kind == "r":
            self._emit(f"{to} = r_{node[1]}({at})", d)
        elif kind == "p":
            self.predicates.add(node[1])
            self._emit(f"{to} = {at} if p_{re.sub(';', 'semi', node[1])}({at}) else -1", d)
        elif kind in ("&", "!"):
            v = self._name()
            self._node(node[1], at, v, d)
            self._emit(f"{to} = {at} if {v} {'>=' if kind == '&' else '<'} 0 else -1", d)
        elif kind == "seq":
            if len(node) == 1:
                self._emit(f"{to} = {at}", d)
                return
            v = self._name()
            now = at
            for n, x in enumerate(node[1:]):
                last = n == len(node) - 2
                self._node(x, now, to if last else v, d)
                if not last:
                    if not self._sure(x):
                        self._emit(f"{to} = -1", d)
                        self._emit(f"if {v} >= 0:", d)
                        d += 1
                    now = v
                    v = self._name()
        elif kind == "alt":
            self._emit(f"{to} = -1", d)
            for n, x in enumerate(node[1:]):
                starts, nothing = self._starts(x)
                test = None if nothing else self._test(starts, at)
                if self.tracing and test:
                    self._emit(f"if {at} > far[0]: far[0] = {at}", d)
                condition = " and ".join(filter(None, [f"{to} < 0" if n else "", test or ""])) or "True"
                self._emit(f"if {condition}:", d)
                self._node(x, at, to, d + 1)
        elif kind == "?":
            starts, nothing = self._starts(node[1])
            v = self._name()
            self._emit(f"{to} = {at}", d)
            if not nothing:
                self._emit(f"if {self._test(starts, at)}:", d)
                d += 1
            self._node(node[1], at, v, d)
            self._emit(f"if {v} >= 0: {to} = {v}", d)
        elif kind in ("*", "+"):
            starts, nothing = self._starts(node[1])
            v, w = self._name(), self._name()
            self._emit(f"{w} = {at}", d)
            self._emit("while True:" if nothing else f"while {self._test(starts, w)}:", d)
            self._node(node[1], w, v, d + 1)
            self._emit(f"if {v} <= {w}: break", d + 1)
            self._emit(f"{w} = {v}", d + 1)
            self._emit(f"{to} = {w}" if kind == "*" else f"{to} = {w} if {w} > {at} else -1", d)

    def _sure(self, node) -> bool:
        return node[0] in ("?", "*")
