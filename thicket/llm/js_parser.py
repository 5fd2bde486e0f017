"""Whether a text is a complete, valid one of its language, and where it first isn't."""

from __future__ import annotations

import contextlib
import functools
import sys
from bisect import bisect_right
from collections.abc import Callable, Iterator

from thicket.llm.grammar import Compiled
from thicket.llm.js_grammar import BINARY, JSON, MODULE, SETS
from thicket.parse.js_lexer import SyntaxFault, tokenize, tokenize_json
from thicket.parse.words import DIALECTS


@contextlib.contextmanager
def _room(tokens: int) -> Iterator[None]:
    """Lets calls nest as deeply as ``tokens`` may."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 10_000 + 40 * tokens))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


@functools.cache
def module_parser(tracing: bool = False) -> Compiled:
    sets = {k: set(v) for k, v in SETS.items()}
    sets["Binary"] = set(BINARY) | {"/"}
    sets["Assign"] = sets["Assign"] | {"/="}
    return Compiled(MODULE, sets, "Module", tracing)


@functools.cache
def json_parser(tracing: bool = False) -> Compiled:
    return Compiled(JSON, SETS, "Text", tracing)


_PLAIN_MEMBER = frozenset(["static", "async", "accessor"])


def _predicates(kinds: list[str], lines: list[bool], match: list[int], offsets: list[int], ts: bool, jsx: bool) -> dict:
    def arrow(i: int) -> bool:
        k = kinds[i]
        if k == "async" and kinds[i + 1] != "=>":
            if lines[i + 1]:
                return False
            i += 1
            k = kinds[i]
        if k == "(":
            after = kinds[match[i] + 1]
            return after == "=>" or ts and after == ":"
        if k == "<":
            return ts
        return kinds[i + 1] == "=>"

    def functype(i: int) -> bool:
        k = kinds[i]
        return k == "<" or k == "new" or k == "abstract" and kinds[i + 1] == "new" or k == "(" and kinds[match[i] + 1] == "=>"

    return {
        "ts": lambda i: ts,
        "nl": lambda i: not lines[i],
        "asi": lambda i: lines[i] or kinds[i] in ("}", "EOF"),
        "adjacent": lambda i: offsets[i] == offsets[i - 1] + 1,
        "assertion": lambda i: ts and not jsx,
        "member": lambda i: ts or kinds[i] in _PLAIN_MEMBER,
        "arrow": arrow,
        "functype": functype,
    }


class _Spans:
    """Spans of tokens that nest, as a chart gives them."""

    def __init__(self, *charts: dict[int, int]):
        found = sorted({(i, j) for chart in charts for i, j in chart.items() if j >= 0}, key=lambda s: (s[0], -s[1]))
        self.starts = [i for i, _ in found]
        self.ends = [j for _, j in found]
        self.outer: list[int] = []
        open_: list[int] = []
        for n, (i, _) in enumerate(found):
            while open_ and self.ends[open_[-1]] <= i:
                open_.pop()
            self.outer.append(open_[-1] if open_ else -1)
            open_.append(n)

    def around(self, at: int) -> int:
        """Where the innermost span around a token starts, or -1."""
        n = bisect_right(self.starts, at) - 1
        while n >= 0 and self.ends[n] <= at:
            n = self.outer[n]
        return self.starts[n] if n >= 0 else -1


def _early(kinds: list[str], charts: dict[str, dict[int, int]]) -> tuple[int, str] | None:
    """The first return outside of functions, break outside of loops and switches, or continue outside of loops."""
    jumps = sorted(i for rule in ("Return", "Jump") for i, j in charts[rule].items() if j >= 0)
    if not jumps:
        return None
    bodies, loops = _Spans(charts["Body"]), _Spans(charts["Loop"])
    breakable = _Spans(charts["Loop"], charts["Cases"])
    for i in jumps:
        body = bodies.around(i)
        if kinds[i] == "return":
            if body < 0:
                return i, "return outside of a function"
        elif kinds[i + 1] in (";", "}", "EOF") or charts["Jump"][i] == i + 1:
            if (breakable if kinds[i] == "break" else loops).around(i) <= body:
                return i, f"{kinds[i]} outside of a loop"
    return None


def fault(text: str, language: str) -> tuple[int, str] | None:
    """(offset, message) of the first unrecoverable error of ``text``, or None where all of it is valid.

    ``language`` is javascript, typescript, jsx, tsx or json. An empty script is valid, an empty JSON text isn't.
    """
    try:
        if language == "json":
            kinds, offsets = tokenize_json(text)
            kinds.append("EOF")
            return _parse(json_parser, kinds, offsets, {}, {})
        ts, jsx = DIALECTS[language]
        kinds, lines, match, offsets = tokenize(text, ts, jsx)
    except SyntaxFault as e:
        return e.offset, str(e)
    kinds += ["EOF", "EOF"]
    lines += [True, True]
    charts: dict[str, dict[int, int]] = {}
    found = _parse(module_parser, kinds, offsets, _predicates(kinds, lines, match, offsets, ts, jsx), charts)
    if found is None and (early := _early(kinds, charts)):
        return offsets[early[0]], early[1]
    return found


def _parse(parser: Callable[..., Compiled], kinds: list[str], offsets: list[int], predicates: dict, charts: dict) -> tuple[int, str] | None:
    far = [0]
    with _room(len(kinds)):
        if parser().bind(kinds, predicates, far, charts)(0) >= 0:
            return None
        parser(True).bind(kinds, predicates, far, {})(0)
    return offsets[min(far[0], len(offsets) - 1)], f"unexpected {kinds[far[0]]}"
