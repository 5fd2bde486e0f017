"""Problem 3: source files that weren't written by hand in their repository."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.components import connected_components
from thicket.llm.files import sources_of
from thicket.session import cut_lineage

#: Tokens of a fingerprint's gram and fingerprints of a winnowing window: any run of GRAM + WINDOW - 1 tokens leaves one.
GRAM, WINDOW = 64, 16
#: A file is a copy if this share of its fingerprints recurs in at least so many repositories.
COPIED, REPOSITORIES = 0.8, 5
#: A file needs so many fingerprints to be told a copy.
LEAST_PRINTS = 3
#: Grams of so many tokens must differ to this share for a text to be winnowed with its names blanked: monotonous ones match all of their form.
VARIED_GRAM, VARIED = 16, 0.5
#: Repositories with the same least fingerprints in all places of a band are forks of one another: 8 bands of 8 of the 64 parts that hashes fall in.
PARTS, BAND = 64, 8

CODE_SUFFIX = re.compile(r"\.(?:[cm]?[jt]sx?)$", re.I)
_SCAN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)"
    r"|(?P<regex>(?:(?<=[=(,:!&|?{};\[+])|(?<=[=(,:!&|?{};\[+]\s)|(?<=\breturn\s))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)"
    r"|(?P<number>\b(?:0[xX][\da-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)n?\b)"
    r"|(?P<word>[^\W\d][\w$]*|[$#][\w$]*)"
    r"|(?P<space>\s+)"
    r"|(?P<sign>.)",
    re.S,
)
# Languages without rules of their own: a quote or slash there opens nothing that is sure to close.
_PLAIN = re.compile(r"(?P<number>\d[\w.]*)|(?P<word>[^\W\d]\w*)|(?P<space>\s+)|(?P<sign>.)", re.S)
# How tools say, in the head of a file, that they wrote it.
_MADE = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated (?:by|from|file|code)\b|\bcode generated by\b|\bautomatically generated\b|\bthis (?:file|code|module) (?:is|was|has been) (?:auto|machine|generated)"
    r"|\bmachine[ -](?:made|generated)\b|\bdo not (?:edit|change|modify) this file\b|\bgenerated (?:by|from|with) [\w.-]+[ @v]*\d|\bproduced (?:from|by)\b|\bchanges (?:here )?will be (?:lost|overwritten)\b"
    r"|\bedits are overwritten\b|\bautomatisch (?:erzeugt|generiert)\b|\bnicht von hand ändern\b|\bproduit par\b|\bne pas modifier\b|\bgénéré automatiquement\b|\bgenerado automáticamente\b|\bno (?:editar|modificar)\b",
    re.I,
)
_NOT_MADE = re.compile(r"\bnot generated\b|\bmaintained by hand\b|\bedit freely\b|\bids? (?:are|is) auto|\bonce by\b", re.I)
_COMPILED = re.compile(
    r"Object\.defineProperty\(exports, ?[\"']__esModule[\"']|\b__(?:awaiter|generator|importDefault|importStar|extends|decorate|createBinding|toESM|commonJS|webpack_require__)\b"
    r"|/\*{6}/ |^!function\([\w$]+(?:,[\w$]+)*\)\{|\b_interopRequireDefault\(|\b_classCallCheck\(|\bregeneratorRuntime\b|\bSystem\.register\(\["
)
# One of these stands in all that _COMPILED matches; looking for them is far cheaper.
_COMPILED_SIGNS = ("__", "/******/ ", "_interopRequireDefault(", "_classCallCheck(", "regeneratorRuntime", "System.register([")
_COMPILED_HEAD = re.compile(r"\s*(?:/\*.*?\*/\s*)*(?:!function\(|/\*{6}/|[\"']use strict[\"'];?\s*Object\.defineProperty\(exports)", re.S)
_UMD = re.compile(r"typeof define === ?'function' && define\.amd|typeof define===?\"function\"&&define\.amd|typeof exports === ?'object' && typeof module !== ?'undefined'")
# All comments before the first line that says something.
_AHEAD = re.compile(r"(?:\s*(?://[^\n]*|/\*.*?\*/))+", re.S)
_CONTROL = {"if", "for", "while", "switch", "try", "throw", "await", "new", "class", "this", "return", "function", "case", "yield", "catch"}
_WORDS = _CONTROL | set(
    "var let const import export from default extends static get set of in instanceof typeof delete void true false null undefined break continue do else finally super interface type enum".split()
)


def scan(text: str) -> list[tuple[str, str]]:
    """(kind, text) of comments, strings, numbers, words, spaces and signs."""
    return [(m.lastgroup, m[0]) for m in _SCAN.finditer(text)]


def scan_plain(text: str) -> list[tuple[str, str]]:
    """(kind, text) of numbers, words, spaces and signs of a text in any language."""
    return [(m.lastgroup, m[0]) for m in _PLAIN.finditer(text)]


_BASE = 6364136223846793005
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, ..., base**(n-1) modulo 2**64."""
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps, dtype=np.uint64)


def normalized(toks: list[tuple[str, str]]) -> list[str]:
    """Tokens with the names blanked that a renaming may change: properties, words of the language and literals stay."""
    out: list[str] = []
    before = ""
    for kind, t in toks:
        if kind not in ("comment", "space"):
            out.append("a" if kind == "word" and t not in _WORDS and before != "." else t)
            before = t
    return out


def _grams(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams from one prefix sum: a gram's is a difference of sums of codes over powers of the base, modulo 2**64."""
    n = len(codes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * _powers(_INVERSE, n), out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * _powers(_BASE, n)[gram - 1 :]
    # The high bits of such a product are well mixed, the low ones aren't.
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (hashes >> np.uint64(1)).astype(np.int64)


def _codes(tokens: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.array([known[t] if t in known else known.setdefault(t, zlib.crc32(t.encode("utf-8", "replace"))) for t in tokens], dtype=np.uint64)


def fingerprints(text: str, gram: int = GRAM, window: int = WINDOW, toks: list[tuple[str, str]] | None = None, blank: bool = True) -> list[int]:
    """Winnowed hashes of the token stream without comments and space: of each window the least one, the last of equals.

    With ``blank`` names are blanked, so that a renamed copy has the prints of its model, unless the text is then too monotonous to tell.
    """
    toks = scan(text) if toks is None else toks
    plain = [t for kind, t in toks if kind not in ("comment", "space")]
    if len(plain) < gram:
        return []
    codes = _codes(normalized(toks) if blank else plain)
    if blank and len(np.unique(_grams(codes, VARIED_GRAM))) < VARIED * (len(codes) - VARIED_GRAM + 1):
        codes = _codes(plain)
    hashes = _grams(codes, gram)
    if len(hashes) <= window:
        return [int(hashes.min())]
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    # The last of equal minima: the first one from behind.
    least = window - 1 - views[:, ::-1].argmin(axis=1) + np.arange(len(views))
    return list(dict.fromkeys(hashes[np.unique(least)].tolist()))


def _logic(text: str) -> int:
    """Words of control flow, counted in the raw text: an unclosed quote in a damaged file must not hide them."""
    return len(re.findall(r"\b(?:if|for|while|switch|try|throw|await|catch)\b\s*[({]?", re.sub(r"[\w+/=]{120,}", "", text)))


def _json_kind(text: str, path: str) -> str | None:
    """Lock files, source maps and records dumped by a program; None for a document that a hand may have written."""
    if '"mappings"' in text and re.search(r'"version"\s*:\s*3', text) and '"sources"' in text or path.lower().endswith(".map"):
        return "source map"
    if '"lockfileVersion"' in text or len(re.findall(r'"(?:integrity|resolved)"\s*:', text)) >= 3 or re.search(r"(?:^|/)(?:package-lock|npm-shrinkwrap|composer\.lock|yarn\.lock|pnpm-lock)", path, re.I):
        return "lock file"
    body = text.strip()
    lines = body.count("\n") + 1
    if len(body) > 600 and len(body) / lines > 200:
        return "compressed data"
    keys = re.findall(r'"((?:[^"\\]|\\.)*)"\s*:', text)
    if body.startswith("[") and len(keys) >= 60 and len(set(keys)) * 8 <= len(keys):
        return "records"
    numbers = len(re.findall(r"(?<![\w\"])-?\d+(?:\.\d+)?(?=\s*[,\]\n])", text))
    if numbers >= 120 and numbers > 4 * len(keys):
        return "numbers"
    return None


def _numbered(text: str) -> int:
    """How many exported names are counted up one by one, as tools do."""
    found = re.findall(r"^\s*(?:export\s+(?:interface|const|type|class|function|enum|let|var)\s+|(?:module\.)?exports\.)[A-Za-z_$]+?_?(\d+)", text, re.M)
    numbers = sorted({int(x) for x in found})
    return len(numbers) if numbers and numbers[0] <= 1 and numbers[-1] - numbers[0] == len(numbers) - 1 else 0


_QUOTED = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`")
_NAMED = re.compile(rf"(?<![\w$])(?!(?:{'|'.join(sorted(_CONTROL))})(?![\w$]))[\w$]+")
_LISTED = re.compile(r"(?:a[.,]?[^\S\n]?)+")


def _skeletons(text: str) -> tuple[int, int]:
    """(lines that say something, distinct shapes among them), with names, numbers and strings blanked; imports and barrels aside."""
    said = [x for x in (line.strip() for line in text.split("\n")) if len(x) >= 4 and not x.startswith(("//", "*", "/*", "import ", "export *", "export {"))]
    shapes = _LISTED.sub("a", _NAMED.sub("a", _QUOTED.sub("a", "\n".join(said))))
    return len(said), len(set(shapes.split("\n"))) if said else 0


def written_by(text: str | None, path: str | None, language: str | None = None, toks: list[tuple[str, str]] | None = None) -> str | None:
    """What kind of machine-made text a source is by itself, or None where it may be hand-written or is empty.

    Content decides, never folder or name alone; comments only where the text's build agrees. ``language`` is the normalised one, ``toks`` the text's
    scan where there is one.
    """
    if not text or not text.strip():
        return None
    path = path or ""
    text = text.lstrip("﻿").replace("\r\n", "\n")
    if re.match(r"\s*(?:\{\s*\"|\[\s*[\[{\"\d-])", text) and (language == "json" or not re.search(r"[;)]\s*$", text)):
        return _json_kind(text, path)
    code = language in ("json",) or language in ("javascript", "typescript", "jsx", "tsx") or bool(CODE_SUFFIX.search(path))
    if re.search(r"(?:^|/)(?:yarn\.lock|pnpm-lock\.ya?ml|poetry\.lock|cargo\.lock|gemfile\.lock)$", path, re.I):
        return "lock file"
    if not code:
        lines = text.count("\n") + 1
        dense = len(text) > 400 and len(text) / lines > 300 and len(re.findall(r"\s", text)) < 0.09 * len(text)
        return "compressed" if dense and re.search(r"[{};]", text) else None
    toks = scan(text) if toks is None else toks
    held: dict[str, list[str]] = {kind: [] for kind in ("comment", "string", "regex", "number", "word", "space", "sign")}
    for kind, t in toks:
        held[kind].append(t)
    size = {kind: sum(map(len, ts)) for kind, ts in held.items()}
    count = {kind: len(ts) for kind, ts in held.items()}
    live = sum(size.values()) - size["comment"]
    bare = live - size["string"] - size["regex"]
    words = held["word"]
    lines = [x for x in text.split("\n") if x.strip()]
    ahead = _AHEAD.match(text)
    comments_ahead = ahead[0] if ahead else ""
    made = bool(_MADE.search(comments_ahead)) and not _NOT_MADE.search(comments_ahead)
    signed = text.startswith("!function(") or any(x in text for x in _COMPILED_SIGNS)
    if signed and _COMPILED.search(text) and (_COMPILED_HEAD.match(text) or len(_COMPILED.findall(text)) >= 3):
        return "compiled"
    names = [w for w in words if w not in _CONTROL and w not in ("var", "let", "const")]
    short = sum(len(w) <= 2 for w in names) / len(names) if names else 0.0
    if bare > 300 and size["space"] < 0.08 * bare and (short > 0.35 or max(map(len, lines)) > 400) and size["string"] < 0.7 * live:
        return "compressed"
    literal = size["string"] + size["number"] + (size["sign"] if count["number"] > 100 else 0)
    many = count["number"] + count["string"]
    if live > 400 and literal > 0.7 * live and count["word"] * 16 < live or many > 100 and many > 3 * max(1, len(names) - count["string"]):
        # Tables and blobs are flat; an object nested deeper is a configuration, whatever its suffix.
        flat = len({len(x) - len(x.lstrip()) for x in lines}) <= 3
        if flat and _logic(text) == 0 and not re.search(r"\bfunction\b|\bclass\b|\bfrom\s*['\"]\.|\brequire\(", text):
            return "data"
    n, shapes = _skeletons(text)
    numbered = _numbered(text)
    # Even lines alone don't tell a tool from a patient hand; names counted one by one do.
    if numbered >= 3 and shapes <= 9 and n >= 2 * shapes or numbered >= 2 and shapes <= 7 and n <= 30:
        return "generated"
    if made and (shapes <= 12 and n >= 2 * shapes or n < 12 and _logic(text) <= 2):
        return "generated"
    if _UMD.search(text) and re.search(r"\bVERSION\b|\bversion\b|\bLICEN[CS]E\b|\(c\)|Copyright", text):
        return "library"
    return None


def families(prints: DataFrame) -> DataFrame | None:
    """(repo_id, family) of repositories that share most of their fingerprints, as forks do; None where there are none.

    Each repository has the least of its hashes in each of ``PARTS`` parts; those that agree in a whole band are linked to the least of
    them, and linked ones are one family. With 8 bands of 8, repositories alike to 0.9 are linked with probability 0.99, those alike to
    0.5 with 0.03.
    """
    least = prints.groupBy("repo_id", F.pmod("h", F.lit(PARTS)).alias("part")).agg(F.min("h").alias("least"))
    # At most BAND entries a group; PARTS small rows a repository are all that is left of its prints.
    by_band = least.groupBy("repo_id", F.floor(F.col("part") / BAND).alias("band")).agg(F.array_sort(F.collect_list(F.struct("part", "least"))).alias("s"))
    signs = cut_lineage(by_band.filter(F.size("s") == BAND).select("repo_id", "band", F.xxhash64("s").alias("sign")))
    # One link for each repository of a band, to the first of it: never all pairs.
    first = signs.groupBy("band", "sign").agg(F.min("repo_id").alias("first"))
    links = cut_lineage(signs.join(first, ["band", "sign"]).filter("repo_id <> first").select(F.col("repo_id").alias("a"), F.col("first").alias("b")).distinct())
    if links.isEmpty():
        return None
    return connected_components(links).select(F.col("node").alias("repo_id"), F.col("component").alias("family"))


def machine_made(files: DataFrame, sources: DataFrame, copied: float = COPIED, repositories: int = REPOSITORIES) -> DataFrame:
    """(file_id, reason): files that weren't written by hand in their repository.

    Each text of any language is judged by its own build and winnowed once, where it is read. A fingerprint recurs if it stands in at least
    ``repositories`` unrelated repositories, forks of one another counting as one; a file whose fingerprints do so to the share ``copied`` is
    a copy of third-party code, whatever its own build. Fingerprints are reduced to (hash, repository) before they are counted, so
    a text that a third of all files hold weighs one row a repository; nothing is collected by group. Null, empty and blank sources
    are no cases. Copies of rows count once, and where texts of one file differ, any case makes it one.
    """
    texts = sources_of(files, sources)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, repo, path, language, text in zip(batch["file_id"], batch["repo_id"], batch["rel_path"], batch["language"], batch["source"]):
                code = language != "other" or bool(CODE_SUFFIX.search(path or ""))
                toks = scan(text) if code else scan_plain(text)
                # Other languages have no words of their own here that could be told from names.
                prints = fingerprints(text, toks=toks, blank=code)
                out.append((file, repo, written_by(text, path, language, toks if code else None), prints if len(prints) >= LEAST_PRINTS else []))
            yield pd.DataFrame(out, columns=["file_id", "repo_id", "reason", "prints"])

    # Read several times below; what is kept of a text is an eighth of its tokens.
    seen = cut_lineage(texts.mapInPandas(judged, "file_id string, repo_id string, reason string, prints array<long>"))
    prints = seen.filter(F.size("prints") > 0).select("file_id", "repo_id", F.size("prints").alias("n"), F.explode("prints").alias("h"))
    held = prints.select("h", "repo_id").distinct()
    related = families(held)
    if related is not None:
        held = held.join(related, "repo_id", "left").select("h", F.coalesce("family", "repo_id").alias("repo_id")).distinct()
    often = held.groupBy("h").agg(F.count("*").alias("repos")).filter(F.col("repos") >= repositories).select("h")
    copies = (
        prints.join(often, "h", "left_semi")
        .groupBy("file_id", "n")
        .agg(F.countDistinct("h").alias("met"))
        .filter(F.col("met") >= copied * F.col("n"))
        .select("file_id", F.lit("copy").alias("reason"))
    )
    own = seen.filter("reason is not null").select("file_id", "reason")
    return own.unionByName(copies).groupBy("file_id").agg(F.min("reason").alias("reason"))
