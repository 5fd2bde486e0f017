"""Faults, provenance and documentation of source files."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from thicket.llm.docpairs import documented_functions, leading_comments
from thicket.llm.docvalue import is_useful
from thicket.llm.faults import fault_rates, parse_flags
from thicket.llm.files import language_of
from thicket.llm.gll import Grammar, recognise
from thicket.llm.provenance import fingerprints, machine_made, written_by

FILES = "id string, repo_id string, rel_path string, language string"
SOURCES = "file_id string, source string"


def test_language(spark):
    cases = [("TypeScript", "a.js", "typescript"), ("ts", "a.tsx", "tsx"), (None, "a.mts", "typescript"), (None, "a.map", "json"), ("js", "a", "javascript"), ("Other", "a.ts", "other"), (None, "a.py", "other"), (None, None, "other"), (" JSX ", "a.js", "jsx")]
    df = spark.createDataFrame([c[:2] for c in cases], "language string, path string")
    assert [r[0] for r in df.select(language_of(F.col("language"), F.col("path"))).collect()] == [c[2] for c in cases]


def test_flags(spark):
    files = spark.createDataFrame([("r:a.ts", "r", "a.ts", "typescript"), ("r:a.ts", "r", "a.ts", "typescript"), ("r:b.js", "r", "b.js", None), ("r:c.json", "r", "c.json", "json"), ("r:d.css", "r", "d.css", "other"), ("r:e.js", "r", "e.js", "js"), ("r:f.js", "r", "f.js", "js")], FILES).withColumn("source", F.lit("clash"))
    sources = spark.createDataFrame([("r:a.ts", "let a: = 1"), ("r:a.ts", "let a: = 1"), ("r:b.js", "let a = 1"), ("r:c.json", ""), ("r:d.css", "}{"), ("r:e.js", ""), ("r:f.js", None), ("q:new.tsx", "<a></b>")], SOURCES)
    flags = parse_flags(files, sources)
    got = {r["file_id"]: (r["valid"], r["line"]) for r in flags.collect()}
    assert got == {"r:a.ts": (False, 1), "r:b.js": (True, None), "r:c.json": (False, 1), "r:e.js": (True, None), "q:new.tsx": (False, 1)}
    rates = {(r["repo_id"], r["language"]): (r["files"], r["faulty"]) for r in fault_rates(flags).collect()}
    assert rates[("r", "javascript")] == (2, 0) and rates[("q", "tsx")] == (1, 1)
    assert parse_flags(files.limit(0), sources.limit(0)).isEmpty()


HAND = "import { a } from './a';\n\n// Ids are auto-generated by the store, do not edit them by hand.\nexport function f(x) {\n  if (!x) {\n    return null;\n  }\n  for (const y of x) {\n    a(y, 'some text');\n  }\n  return x;\n}\n"
LIBRARY = "(function (root, factory) {\n  if (typeof define === 'function' && define.amd) {\n    define([], factory);\n  } else {\n    root.lib = factory();\n  }\n}(this, function () {\n  var lib = { VERSION: '1.2.3' };\n  lib.go = function (a) { if (a) { return lib; } return a; };\n  return lib;\n}));\n"


@pytest.mark.parametrize(
    "path,text,made",
    [
        ("src/vendor/a.ts", HAND, False),
        ("third_party/a.ts", "/* lib 1.0, local mirror */\n" + HAND, False),
        ("a.ts", HAND + f"const blob = '{'Ab1+' * 400}';\n", False),
        ("a.js", "!function(e,t){'use strict';var n={};" + "e['id']&&(n.a=!0,t.o=void 0);" * 20 + "}(this,{});", True),
        ("a.js", '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\nvar x_1 = require("x");\n', True),
        ("a.js", "module.exports = [\n" + "".join(f"  [{i}.5, -{i}.25, {i * 3}],\n" for i in range(60)) + "];\n", True),
        ("a.js", f"export default '{'Ab1+' * 400}';\n", True),
        ("a.ts", "// Code generated by gen. DO NOT EDIT.\n" + "".join(f"export interface A{i}Msg {{\n  a_{i}?: string;\n}}\n" for i in range(20)), True),
        ("a.js.map", '{"version": 3, "sources": ["a.ts"], "names": [], "mappings": "AAAA"}', True),
        ("x/package-lock.json", '{\n  "name": "x",\n  "lockfileVersion": 3\n}', True),
        ("a.json", '{\n  "name": "x",\n  "list": [1, 2]\n}\n', False),
        ("a.json", "[" + ",".join(f'{{"i":{i},"v":{i * 7}}}' for i in range(100)) + "]", True),
        ("a.css", ".a{margin:1px;padding:0 2px}" * 40, True),
        ("a.css", ".a {\n  margin: 1px;\n}\n" * 40, False),
        ("a.js", LIBRARY, True),
        ("a.js", "", False),
        ("a.js", None, False),
    ],
)
def test_kinds_of_text(path, text, made):
    assert (written_by(text, path) is not None) is made


MESSAGES = "".join(f"export interface A{i}Msg {{\n  a?: string;\n}}\n" for i in "abcdefghijkl")


@pytest.mark.parametrize(
    "path,text",
    [
        ("a.ts", "/*\n" + " * Some words of a licence.\n" * 40 + " */\n\n// Code generated by gen. DO NOT EDIT.\n" + MESSAGES),
        ("a.ts", "/*\n" + " * Some words of a licence.\n" * 40 + " * @generated\n */\n" + MESSAGES),
        ("a.js", LIBRARY.replace("VERSION: '1.2.3'", "").replace("  return lib;\n}));", "  lib.more = function (a) { if (a) { return lib; } return a; };\n" * 60 + "  lib.VERSION = '1.2.3';\n  return lib;\n}));")),
        ("x/deps.json", '{\n  "name": "x",\n' + "".join(f'  "key{i}": {{\n    "v": "{i}"\n  }},\n' for i in range(300)) + '  "lockfileVersion": 3\n}'),
    ],
)
def test_marks_count_wherever_they_stand(path, text):
    assert written_by(text, path) is not None


def test_winnowing_is_position_free():
    r = random.Random(2)
    body = " ".join(f"v{r.randrange(999)} = f{r.randrange(99)}({r.randrange(99)});" for _ in range(200))
    prints = set(fingerprints(body))
    assert prints and prints <= set(fingerprints("const before = 1;\n" * 5 + body.replace(" ", "\n  ") + "// after\n")) and fingerprints("a b") == []


def test_copies_need_many_repositories(spark):
    r = random.Random(3)

    def body():
        return "import { a } from './a';\n" + "\n".join(f"export function f{r.randrange(9999)}(x) {{ if (x > {r.randrange(99)}) {{ return g{r.randrange(99)}(x, '{r.randrange(999)}'); }} }}" for _ in range(30))

    shared, own = body(), [body() for _ in range(8)]
    rows = [(f"r{i}:lib.js", f"r{i}", "lib.js", "javascript", shared + f"\n// {i}") for i in range(6)] + [(f"r{i}:own.js", f"r{i}", "own.js", "javascript", t) for i, t in enumerate(own)]
    rows += [(f"s:{i}.js", "s", f"{i}.js", "javascript", own[0]) for i in range(9)]
    files = spark.createDataFrame([x[:4] for x in rows] * 2, FILES)
    sources = spark.createDataFrame([(x[0], x[4]) for x in rows] * 2 + [("r0:null.js", None)], SOURCES)
    assert {x["file_id"] for x in machine_made(files, sources).collect()} == {f"r{i}:lib.js" for i in range(6)}
    assert machine_made(files.limit(0), sources.limit(0)).isEmpty()


def test_renamed_copies_and_forks(spark):
    r = random.Random(5)

    def body(n):
        return "\n".join(f"export function f{r.randrange(9999)}(x) {{ if (x.p{r.randrange(99)} > {r.randrange(99)}) {{ return g{r.randrange(99)}(x.q{r.randrange(99)}, '{r.randrange(999)}'); }} }}" for _ in range(n))

    def renamed(text, i):
        return re.sub(r"\b([fgx])(\d*)\b(?!:)", lambda m: f"{m[1]}{i}_{m[2]}", text)

    lib, app = body(30), [body(60) for _ in range(6)]
    # Six repositories hold a renamed copy of one library; six forks of a seventh hold all of its own files.
    rows = [(f"r{i}:lib.js", f"r{i}", "lib.js", "javascript", renamed(lib, i)) for i in range(6)] + [(f"r{i}:own.js", f"r{i}", "own.js", "javascript", app[i]) for i in range(6)]
    fork = [body(60) for _ in range(4)]
    rows += [(f"k{i}:{n}.js", f"k{i}", f"{n}.js", "javascript", t) for i in range(6) for n, t in enumerate(fork)]
    files = spark.createDataFrame([x[:4] for x in rows], FILES)
    sources = spark.createDataFrame([(x[0], x[4]) for x in rows], SOURCES)
    assert {x["file_id"] for x in machine_made(files, sources).collect()} == {f"r{i}:lib.js" for i in range(6)}
    assert fingerprints(lib) == fingerprints(renamed(lib, 7)) and fingerprints(lib, blank=False) != fingerprints(renamed(lib, 7), blank=False)


def test_copies_in_other_languages(spark):
    r = random.Random(4)

    def css():
        return "/* it's open */\n" + "".join(f".c{r.randrange(9999)} {{\n  background: url(http://x/*/{r.randrange(99)});\n  margin: {r.randrange(99)}px;\n}}\n" for _ in range(30))

    def python():
        return "# don't\n" + "".join(f"def f{r.randrange(9999)}(x):\n    return g{r.randrange(99)}(x, '{r.randrange(999)}')\n" for _ in range(30))

    rows = []
    for name, language, body in (("a.css", "other", css), ("a.py", None, python), ("a.ts", "other", python)):
        shared = body()
        rows += [(f"r{i}:{name}", f"r{i}", name, language, shared) for i in range(5)] + [(f"r{i}:own.{name}", f"r{i}", f"own.{name}", language, body()) for i in range(6)]
    files = spark.createDataFrame([x[:4] for x in rows], FILES)
    sources = spark.createDataFrame([(x[0], x[4]) for x in rows] + [("r0:null.css", None)], SOURCES)
    assert {x["file_id"] for x in machine_made(files, sources).collect()} == {f"r{i}:{name}" for i in range(5) for name in ("a.css", "a.py", "a.ts")}


@pytest.mark.parametrize(
    "doc,useful",
    [
        ("Retries twice, then gives up.", True), ("O(n) in the batch length.", True), ("/** Ignores case and accents. */", True), ("重複がある場合は新しい行だけを残す。", True), ("Bricht nach 3 Versuchen ab.", True),
        ("TODO: remove once the import is gone. Until then both ids are kept.", True), ("@deprecated since the rewrite, which stores the rank per day.", True), ("Merges the rows. Returns undefined rather than an empty list.", True),
        ("Merges the recipe rows.", False), ("mergeRecipeRows", False), ("This is the mergeRecipeRows function.", False), ("@param rows the rows\n@returns the result", False), ("TODO", False), ("FIXME", False), ("TODO document this", False),
        ("/** */", False), ("--- helpers ---", False), ("====", False), ("eslint-disable-next-line no-console", False), ("@ts-ignore", False), ("#__PURE__", False), ("istanbul ignore next", False), ("v1.2", False), ("@since 1.2", False),
        ("Created by team-b on 2024-01-01", False), ("@author team-b", False), ("console.log(rows)", False), ("const a = rows.map((x) => x); return a;", False), ("{@inheritDoc}", False), ("n/a", False), ("No description provided.", False), (None, False), ("​", False),
    ],
)
def test_usefulness(doc, useful):
    assert is_useful(doc, "mergeRecipeRows", "function mergeRecipeRows(rows: string[]): any") is useful


def test_gll_takes_any_grammar():
    g = Grammar({"S": [("S", "S"), ("a",), ()]})
    assert recognise(g, "S", ["a"] * 6)[("S", 0)] == set(range(7))
    g = Grammar({"E": [("E", "+", "E"), ("n",)]})
    assert max(recognise(g, "E", ["n", "+", "n", "+", "n"])[("E", 0)]) == 5 and recognise(g, "E", ["+"]).get(("E", 0)) == set()


@pytest.mark.parametrize(
    "content,target,comments",
    [
        ("// a.ts · function f\n// function f(a)\n// Told here.\nexport function f(a) {\n  // inside\n}", "f", ["// Told here."]),
        ("// a.ts · method C.m\n// async m(a)\n/** Doc. */\n@dec()\n  async m(a: {b: c}): x {\n", "m", ["/** Doc. */"]),
        ("// a.ts · function f\n/** One. */\nconst f = <T,>(a) => {", "f", ["/** One. */"]),
        ("// a.ts · function f\n// function f()\n// part 2\n  // inside\n  x();", "f", []),
        ("// a.ts · function f\n)) broken ((\n/** Still. */\nfunction f(", "f", []),
        ("// a.ts · function f\n)) broken\n/** Still. */\nfunction f() {", "f", ["/** Still. */"]),
        ("", "f", []),
    ],
)
def test_leading_comments(content, target, comments):
    assert leading_comments(content, target)[0] == comments


@pytest.mark.parametrize(
    "content,comments",
    [
        ("// a.ts · function f\nexport default f;\nclass A { x() {} }\n/** Told late. */\nfunction f(a) {\n  // inside\n}", ["/** Told late. */"]),
        ("// a.ts · function f\nf.limit = 3;\nif (f) { f(1); }\n// Told late.\nexport const f = () => {};", ["// Told late."]),
        ("// a.ts · function f\nf(1);\n/** Told late. */\nasync function f(a) {}", ["/** Told late. */"]),
        ("// a.ts · method C.f\nf(a: string): void;\n/** Told late. */\nf(a: number): void {}\n// A call.\nf(2);", ["/** Told late. */"]),
    ],
)
def test_definitions_late_in_a_text(content, comments):
    assert leading_comments(content, "f")[0] == comments == leading_comments(content, "f", True)[0]


def test_pairs(spark):
    symbols = spark.createDataFrame(
        [("r:a#f", "Function", "f", "function f()", "Retries twice, then gives up."), ("r:a#f", "Function", "f", "function f()", "Retries twice, then gives up."), ("r:a#g", "method", "g", None, None), ("r:a#C", "class", "C", None, "Keeps what was read first."), ("r:a#h", "HOOK", "h", "h()", "/** */"), ("r:a#i", "component", "i", "i()", "Waits for the slower side."), (None, "function", "x", None, None)],
        "id string, kind string, name string, signature string, doc string",
    ).withColumn("comments", F.lit("clash"))
    chunks = spark.createDataFrame([("r:a#g", "// a · method g\n/** Blocks until the lock is free. */\n  g() { return 1; }"), ("r:a#g", None), ("r:a#h", "// a · hook h\nfunction h() {}"), ("r:a#f", "// a · function f\nfunction f() {}")], "symbol_id string, content string")
    got = {r["symbol_id"]: r for r in documented_functions(symbols, chunks).collect()}
    assert set(got) == {"r:a#f", "r:a#g", "r:a#i"} and got["r:a#g"]["code"] == "g() { return 1; }" and got["r:a#i"]["code"] is None
    assert documented_functions(symbols.limit(0), chunks.limit(0)).isEmpty()
    again = symbols.union(symbols.filter("id = 'r:a#f'").withColumn("id", F.lit("r:b#f")))
    assert {r[0] for r in documented_functions(again, chunks, most_share=0.4).select("symbol_id").collect()} == {"r:a#g", "r:a#i"}
    assert {r[0] for r in documented_functions(again, chunks, most_share=0.5).select("symbol_id").collect()} == {"r:a#f", "r:b#f", "r:a#g", "r:a#i"}


@pytest.mark.parametrize(
    "text", ["x = foo(1);\n" * 45_000 + "/** Told. */\nfunction target() {}\n" + "x = foo(1);\n" * 45_000, "export " * 100_000, "target: " + "a " * 200_000, "// a\n" * 100_000, "@a.b " * 50_000]
)
def test_long_texts_take_time_in_proportion(text):
    start = time.process_time()
    leading_comments(text, "target", True)
    assert time.process_time() - start < 12
