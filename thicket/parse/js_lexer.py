"""Tokens of ECMAScript, TypeScript, JSX and JSON texts, with matched brackets."""

from __future__ import annotations

import re

from thicket.parse.words import CONTEXTUAL, RESERVED, STRICT


class SyntaxFault(Exception):
    """The first place that can't be read."""

    def __init__(self, message: str, offset: int):
        super().__init__(message)
        self.offset = offset


# Possessive: space and comments once read are never given back, not even where no token follows.
_SPACE = r"(?:[\s\ufeff]++|//[^\n\r\u2028\u2029]*+|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/)*+"
_ESC = r"\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]{1,6}\}"
_NAME = rf"(?:[^\W\d]|\$|{_ESC})(?:[\w$\u200c\u200d]|{_ESC})*"
_TOKEN = re.compile(
    rf"({_SPACE})(?:({_NAME})"
    r"|(>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*%&|^!~?:=@]|\.(?!\d))"
    r"|(0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:0|[1-9]\d*(?:_\d+)*)n|(?:(?:0(?![\d_])|[1-9]\d*(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?)(?![\w$])"
    r"|(\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    rf"|(`)|(/)|(#{_NAME}))"
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([\w$]*)")
_GAP = re.compile(_SPACE)
_JSX_NAME = re.compile(r"[^\W\d][\w$-]*|\$[\w$-]*")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_JSX_TEXT = re.compile(r"[^{}<>]*")
_TAG_TYPES = re.compile(r"<(?:[^<>=]|=>|<(?:[^<>=]|=>)*>)+>")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|=(?!=))")
_GENERIC_CALL = re.compile(r"<\s*([A-Za-z_$][\w$]*)\s*>\s*\(")

WORDS = {w: w for w in (*RESERVED, *STRICT, *CONTEXTUAL)}
_ENDS_OPERAND = frozenset(["ID", *CONTEXTUAL, "NUM", "STR", "TPL", "TPLT", "REGEX", "this", "super", "null", "true", "false", "PRIV", ")", "]", "}", "++", "--", ">J", "/>J"])
_BLOCK_BEFORE = frozenset([")", ";", "{", "}", "else", "do", "try", "finally", "", "=>"])
_HEADS = frozenset(["if", "while", "for", "with"])
_CLOSER = {"(": ")", "[": "]", "{": "}"}
_REST = re.compile(r"[^\n\r\u2028\u2029]*")
_MALFORMED = re.compile(r"\d[\w$.]*|[\s\S]")
LINE_ENDS = re.compile(r"[\n\r\u2028\u2029]")


class Repairs:
    """What a damaged text's reading makes up for. ``unclosed`` and ``spare`` are those of an earlier reading, known ahead in the next."""

    def __init__(self, unclosed: frozenset[int] = frozenset(), spare: int = 0):
        self.known, self.left = unclosed, spare
        #: Offsets of brackets closed by force, and how many closing braces had no opener.
        self.unclosed: set[int] = set()
        self.spare = 0
        #: Offsets of '<' that begin no element.
        self.plain: set[int] = set()
        #: The first token of each element by the last one of its opening tag.
        self.born: dict[int, int] = {}


def tokenize_damaged(text: str, ts: bool, jsx: bool) -> tuple[list[str], list[bool], list[int], list[int]]:
    """As ``tokenize`` for a damaged text: what can't be read is skipped and the text is read on to its end.

    It is read twice: only at the end it shows which brackets stay open. The second reading closes these where a line is no further
    indented than theirs, so what follows isn't taken for their contents.
    """
    first = Repairs()
    tokens = tokenize(text, ts, jsx, first)
    return tokenize(text, ts, jsx, Repairs(frozenset(first.unclosed), first.spare)) if first.unclosed or first.spare else tokens


def tokenize(text: str, ts: bool, jsx: bool, repairs: Repairs | None = None) -> tuple[list[str], list[bool], list[int], list[int]]:
    """(kinds, whether a line ends before, index of the matching bracket or -1, offsets), closed by EOF.

    It raises SyntaxFault at what can't be a token and at a bracket or tag that doesn't match, unless there are ``repairs``.
    """
    kinds: list[str] = []
    lines: list[bool] = []
    match: list[int] = []
    offsets: list[int] = []
    # (opener, index, flag): flag of '(' is whether it belongs to a head, of '{' whether it opens a block, of tags their name.
    stack: list[tuple[str, int, object]] = []
    n = len(text)
    at = 1 if text.startswith("\ufeff") else 0
    if text.startswith("#!", at):
        m = LINE_ENDS.search(text, at)
        at = m.start() if m else n
    prev = ""
    operand_closed = False
    token, words = _TOKEN.match, WORDS

    def put(kind: str, offset: int, line: bool = False) -> None:
        kinds.append(kind)
        lines.append(line)
        match.append(-1)
        offsets.append(offset)

    def open_tag(offset: int) -> int:
        """Reads '<' of an element or fragment; the new offset."""
        put("<J", offset)
        gap = _GAP.match(text, offset + 1).end()
        if text.startswith(">", gap):
            put(">J", gap)
            stack.append(("child", len(kinds) - 1, ""))
            if repairs is not None:
                repairs.born[len(kinds) - 1] = len(kinds) - 2
            return gap + 1
        stack.append(("tag", len(kinds) - 1, None))
        return offset + 1

    def fail(message: str, offset: int) -> None:
        if repairs is None:
            raise SyntaxFault(message, offset)

    def indent(offset: int) -> int:
        line = text[text.rfind("\n", 0, offset) + 1 : offset]
        return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())

    def force(offset: int) -> None:
        """Closes the innermost bracket or element at an offset."""
        opener, k, _ = stack.pop()
        if opener in _CLOSER or opener == "${":
            repairs.unclosed.add(offsets[k])
            put("TPLT" if opener == "${" else _CLOSER[opener], offset)
            if opener != "${":
                match[k] = len(kinds) - 1
                match[-1] = k

    def rewind(lowest: bool) -> int:
        """Takes back an unclosed element, the outermost or the innermost one, and reads its '<' as a sign; the offset after it."""
        n = next(n for n in (range(len(stack)) if lowest else range(len(stack) - 1, -1, -1)) if stack[n][0] in ("tag", "child"))
        kind, k, _ = stack[n]
        k = repairs.born[k] if kind == "child" else k
        offset, line = offsets[k], lines[k]
        if lowest:
            # All that are open at the end at once: each is then read again only once.
            repairs.plain.update(offsets[repairs.born[x[1]] if x[0] == "child" else x[1]] for x in stack[n:] if x[0] in ("tag", "child"))
        repairs.plain.add(offset)
        del stack[n:], kinds[k:], lines[k:], match[k:], offsets[k:]
        if not (stack and stack[-1][0] == "child"):
            put("<", offset, line)
        return offset + 1

    while True:
        top = stack[-1][0] if stack else ""
        if at >= n and repairs is not None and any(x[0] in ("tag", "child") for x in stack):
            at, prev, operand_closed = rewind(True), "<", False
            continue
        if top == "child":
            m = _JSX_TEXT.match(text, at)
            if m.end() > at:
                put("JTEXT", at)
            at = m.end()
            if at >= n:
                if repairs is not None:
                    continue
                break
            c = text[at]
            if c == "{":
                put("{", at)
                stack.append(("{", len(kinds) - 1, False))
                prev, operand_closed = "{", False
                at += 1
            elif c == "<" and repairs is not None and at in repairs.plain:
                at += 1
            elif c == "<":
                gap = _GAP.match(text, at + 1).end()
                if not text.startswith("/", gap):
                    at = open_tag(at)
                    continue
                put("</J", at)
                at = gap + 1
                name = ""
                while True:
                    at = _GAP.match(text, at).end()
                    m = _JSX_NAME.match(text, at)
                    if m:
                        put("JNAME", at)
                        name += m[0]
                        at = m.end()
                    elif at < n and text[at] in ".:":
                        put(text[at] + "J", at)
                        name += text[at]
                        at += 1
                    else:
                        break
                if at >= n or text[at] != ">":
                    fail("closing tag isn't complete", at)
                    at -= 1
                if name != stack[-1][2]:
                    fail(f"closing tag {name!r} for {stack[-1][2]!r}", at)
                    own = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] != "child" or stack[k][2] == name), -1)
                    if own < 0 or stack[own][0] != "child":
                        put(">J", at)
                        at += 1
                        continue
                    del stack[own + 1 :]
                put(">J", at)
                stack.pop()
                at += 1
                prev, operand_closed = ">J", True
            else:
                fail(f"unexpected {c!r} in text of an element", at)
                if c == "}" and any(x[0] in ("{", "${") for x in stack):
                    while stack[-1][0] == "child":
                        stack.pop()
                    prev, operand_closed = ">J", True
                else:
                    at += 1
            continue
        if top == "tag":
            at = _GAP.match(text, at).end()
            if at >= n:
                if repairs is not None:
                    continue
                break
            c = text[at]
            m = _JSX_NAME.match(text, at)
            if m:
                put("JNAME", at)
                at = m.end()
            elif c in "'\"":
                m = _JSX_STRING.match(text, at)
                if not m:
                    fail("string isn't closed", at)
                    at, prev, operand_closed = rewind(False), "<", False
                    continue
                put("JSTR", at)
                at = m.end()
            elif c == "{":
                put("{", at)
                stack.append(("{", len(kinds) - 1, False))
                prev, operand_closed = "{", False
                at += 1
            elif c == "/":
                gap = _GAP.match(text, at + 1).end()
                if not text.startswith(">", gap):
                    fail("unexpected '/' in a tag", at)
                    at, prev, operand_closed = rewind(False), "<", False
                    continue
                put("/>J", at)
                stack.pop()
                at = gap + 1
                prev, operand_closed = "/>J", True
            elif c == ">":
                first = stack[-1][1]
                name = ""
                k = first
                while k < len(kinds) and kinds[k] in ("<J", "JNAME", ".J", ":J"):
                    if kinds[k] == "JNAME":
                        if k > first and kinds[k - 1] == "JNAME":
                            break
                        name += _JSX_NAME.match(text, offsets[k])[0]
                    elif kinds[k] != "<J":
                        name += text[offsets[k]]
                    k += 1
                put(">J", at)
                stack[-1] = ("child", len(kinds) - 1, name)
                if repairs is not None:
                    repairs.born[len(kinds) - 1] = first
                at += 1
            elif c in "=.:":
                put(c + "J", at)
                at += 1
            elif c == "<" and kinds[-1] == "=J":
                at = open_tag(at)
            elif c == "<" and ts and kinds[-1] == "JNAME" and (m := _TAG_TYPES.match(text, at)):
                at = m.end()
            else:
                fail(f"unexpected {c!r} in a tag", at)
                at, prev, operand_closed = rewind(False), "<", False
            continue
        m = token(text, at)
        if m is None:
            at = _GAP.match(text, at).end()
            if at >= n:
                break
            fail(f"unexpected {text[at]!r}", at)
            # The rest of the line goes with an open string, a malformed number goes as a whole.
            at = (_REST if text[at] in "'\"" else _MALFORMED).match(text, at).end()
            continue
        group = m.lastindex
        start = m.start(group)
        line = start > at and LINE_ENDS.search(text, at, start) is not None
        if repairs is not None and line and stack and text[start] not in ")]}" and offsets[stack[-1][1]] in repairs.known:
            while stack and offsets[stack[-1][1]] in repairs.known and indent(start) <= indent(offsets[stack[-1][1]]):
                force(at)
            if stack and stack[-1][0] == "child":
                continue
            prev, operand_closed = kinds[-1], False
        at = m.end()
        if group == 2:
            word = m[2]
            kind = "ID" if prev in (".", "?.") else words.get(word, "ID")
            kinds.append(kind)
            lines.append(line)
            match.append(-1)
            offsets.append(start)
            prev = kind
            operand_closed = kind in _ENDS_OPERAND
        elif group == 3:
            kind = m[3]
            if kind == "}" and stack and stack[-1][0] == "${":
                stack.pop()
                t = _TEMPLATE.match(text, at)
                if not t:
                    fail("template isn't closed", start)
                    put("TPLT", start, line)
                    prev, operand_closed = "TPLT", True
                    continue
                kind = "TPLT" if t[1] == "`" else "TPLM"
                put(kind, start, line)
                at = t.end()
                if kind == "TPLM":
                    stack.append(("${", len(kinds) - 1, None))
                prev = kind
                operand_closed = kind == "TPLT"
                continue
            if kind == "<" and jsx and not operand_closed and at < n and (text[at] in ">_$" or text[at].isalpha()) and not (repairs is not None and start in repairs.plain):
                generic = ts and (_GENERIC.match(text, start) or (g := _GENERIC_CALL.match(text, start)) and f"</{g[1]}" not in text)
                if not generic:
                    at = open_tag(start)
                    lines[-1 if kinds[-1] == "<J" else -2] = line
                    continue
            if repairs is not None and kind in ")]}":
                own = next((k for k in range(len(stack) - 1, -1, -1) if _CLOSER.get(stack[k][0], "}" if stack[k][0] == "${" else "") == kind or stack[k][0] in ("tag", "child")), -1)
                if own >= 0 and kind == "}" and line:
                    # A brace at the start of a line belongs to the one whose line is indented alike.
                    level = indent(start)
                    alike = next((k for k in range(own, -1, -1) if stack[k][0] in ("tag", "child") or stack[k][0] == "{" and indent(offsets[stack[k][1]]) <= level), -1)
                    if alike >= 0 and stack[alike][0] == "{" and indent(offsets[stack[alike][1]]) == level:
                        own = alike
                    elif repairs.left and indent(offsets[stack[own][1]]) < level:
                        repairs.left -= 1
                        continue
                if own < 0 or stack[own][0] in ("tag", "child"):
                    repairs.spare += kind == "}"
                    continue
                if own < len(stack) - 1:
                    while len(stack) - 1 > own:
                        force(start)
                if stack[-1][0] == "${":
                    at = start
                    continue
            kinds.append(kind)
            lines.append(line)
            match.append(-1)
            offsets.append(start)
            if kind in "([{":
                flag = prev in _HEADS or prev == "await" and len(kinds) > 2 and kinds[-3] == "for" if kind == "(" else prev in _BLOCK_BEFORE
                stack.append((kind, len(kinds) - 1, flag))
                operand_closed = False
            elif kind in ")]}":
                if not stack or _CLOSER.get(stack[-1][0]) != kind:
                    raise SyntaxFault(f"{kind!r} without its opening bracket", start)
                _, k, flag = stack.pop()
                match[k] = len(kinds) - 1
                match[-1] = k
                operand_closed = not flag
            else:
                operand_closed = kind in ("++", "--")
            prev = kind
        elif group == 4 or group == 5:
            prev = "NUM" if group == 4 else "STR"
            kinds.append(prev)
            lines.append(line)
            match.append(-1)
            offsets.append(start)
            operand_closed = True
        elif group == 6:
            t = _TEMPLATE.match(text, at)
            if not t:
                fail("template isn't closed", start)
                continue
            prev = "TPL" if t[1] == "`" else "TPLH"
            put(prev, start, line)
            at = t.end()
            if prev == "TPLH":
                stack.append(("${", len(kinds) - 1, None))
            operand_closed = prev == "TPL"
        elif group == 7:
            if text.startswith("*", at):
                fail("comment isn't closed", start)
                at = _REST.match(text, at).end()
                continue
            r = None if operand_closed else _REGEX.match(text, start)
            if r:
                if len(set(r[1])) < len(r[1]) or set(r[1]) - set("dgimsuvy"):
                    fail("flags of a regular expression", start)
                put("REGEX", start, line)
                at = r.end()
                prev = "REGEX"
                operand_closed = True
            elif not operand_closed:
                fail("regular expression isn't closed", start)
            else:
                prev = "/=" if text.startswith("=", at) else "/"
                at += prev == "/="
                put(prev, start, line)
                operand_closed = False
        else:
            prev = "PRIV"
            put(prev, start, line)
            operand_closed = True
    if stack:
        fail("the text ends before what it opened is closed", n)
        while stack:
            force(n)
    kinds.append("EOF")
    lines.append(True)
    match.append(-1)
    offsets.append(n)
    return kinds, lines, match, offsets


_JSON_TOKEN = re.compile(
    r"[ \t\n\r]*(?:(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[\da-fA-F]{4}))*\")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(true|false|null)(?!\w)|([{}\[\]:,]))"
)


def tokenize_json(text: str) -> tuple[list[str], list[int]]:
    """(kinds, offsets) of strict JSON."""
    kinds: list[str] = []
    offsets: list[int] = []
    at, n = (1 if text.startswith("\ufeff") else 0), len(text)
    while True:
        m = _JSON_TOKEN.match(text, at)
        if m is None:
            rest = len(text) - len(text[at:].lstrip(" \t\n\r"))
            if rest >= n:
                break
            raise SyntaxFault(f"unexpected {text[rest]!r}", rest)
        g = m.lastindex
        kinds.append("STR" if g == 1 else "NUM" if g == 2 else m[g])
        offsets.append(m.start(g))
        at = m.end()
    kinds.append("EOF")
    offsets.append(n)
    return kinds, offsets
