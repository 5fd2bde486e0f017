"""Damaged sources are read to their end."""

import pytest


@pytest.mark.parametrize(
    "path,text,names",
    [
        ("a.js", "}\n<<<<<<< HEAD\nexport function a() { b(); }\n=======\n>>>>>>> x\nexport const c = () => { d(); };\n", ["a", "c"]),
        ("a.ts", "function f() {\n  if (x) {\n    g();\n}\n\nclass A {\n  m() {\n    x();\n  n() {\n    return 2;\n  }\n}\nexport const last = 1;\n", ["f", "A", "A.m", "A.n", "last"]),
        ("a.js", "const a = foo('abc);\nfunction b() { return 'x'; }\n", ["a", "b"]),
        ("a.js", "const t = `abc\nfunction b() {\n  return 2;\n}\n", ["t", "b"]),
        ("a.jsx", "export function A() {\n  return (\n    <div>\n      <p>hi</p>\n  );\n}\nfunction B() {\n  return <b>x</b>;\n}\n", ["A", "B"]),
        ("a.jsx", "const a = <div>\nfunction B() { return <b>x</b>; }\n", ["a", "B"]),
        ("a.js", "".join(f"const a{i} = );\n" for i in range(120)) + "function last() {}\n", [*[f"a{i}" for i in range(120)], "last"]),
    ],
)
def test_damaged_sources_are_read_to_their_end(path, text, names):
    from thicket.parse.extract import extract

    read = extract(path, text)
    assert read.error and [s.qualified for s in read.symbols] == names


@pytest.mark.parametrize("text", ["<a>" * 3000, "{\n" * 3000, "(<a>{" * 1000, "`${" * 1000, "'\n}" * 1000])
def test_damaged_brackets_match(text):
    from thicket.parse.js_lexer import tokenize_damaged

    kinds, lines, match, offsets = tokenize_damaged(text, False, True)
    assert len(kinds) == len(lines) == len(match) == len(offsets) and offsets == sorted(offsets)
    assert all(m < 0 or match[m] == i for i, m in enumerate(match))


CARD = """/** The file. */
import React, { useState } from 'react';
/** Shows a card.
 * @param {string} title - what it says
 * @returns an element
 * @deprecated use Panel */
export const Card = React.memo(({ title, size = 1, on: handler, ...rest }: CardProps<A, B>) => {
  const [a] = useState(0); const t = useContext(Theme); useOwn(); const [s, d] = useReducer(reduce, {});
  return <Theme.Provider value={t}>{a}{<Inner x={a}/>}<Inner/></Theme.Provider>;
});
export interface CardProps<T, U> extends Base { title: string; size?: number
  on(x: number): void, readonly z: T }
const enum E { A, 'b-c' = 2, D }
type Al<T> = | T
  | { a: 1 };
"""


def test_what_is_told_of_symbols():
    from thicket.parse.extract import extract

    r = extract("src/a.tsx", CARD)
    by = {s.name: s for s in r.symbols}
    assert r.error is None and r.file_doc == "The file."
    assert by["Card"].kind == "component" and by["Card"].meta["props"] == "title,size,on,...rest" and by["Card"].meta["propsType"] == "CardProps<A, B>"
    assert by["Card"].meta["jsxUsage"] == "Inner:2,Theme.Provider:1" and by["Card"].meta["providesContexts"] == "Theme" and by["Card"].meta["consumesContexts"] == "Theme"
    assert by["Card"].meta["hooksUsed"] == "useState,useContext,useOwn,useReducer" and by["Card"].meta["customHooksUsed"] == "useOwn" and by["Card"].meta["reducers"] == "reduce"
    assert by["Card"].meta["params"] == "title: what it says" and by["Card"].meta["returns"] == "an element" and by["Card"].meta["deprecated"] == "use Panel"
    assert by["CardProps"].meta["members"] == "title,size,on,z" and by["E"].meta == {"members": "A,b-c,D", "const": "true"} and by["Al"].signature == "type Al = | T | { a: 1 }"
    assert not [x for x in r.refs if x["name"] == "on"]


def test_large_files_take_time_in_proportion():
    import time

    from thicket.parse.extract import extract

    text = "\n".join(f"/** d{i} */\nexport function f{i}(a) {{ const g = () => {{ h{i}(a); }}; return g(); }}" for i in range(10_000))
    start = time.process_time()
    assert len(extract("a.js", text).symbols) == 20_000 and time.process_time() - start < 10


def test_sample_components(spark):
    """Elements between braces belong to the component around them: uses, routes and their handlers are found."""
    from pyspark.sql import functions as F

    from thicket.plans.codegraph import code_graph

    app = "import { Home } from './Home';\nexport function App() { return <Routes>{flags.map((f) => <Nav key={f}/>)}<Route path=\"/home\" element={<Home/>}/>{ready && <Home/>}</Routes>; }\nfunction Nav() { return <nav>{name}{<b/>}</nav>; }\n"
    rows = [("r", "src/App.tsx", app), ("r", "src/Home.tsx", "export const Home = () => <h1>{title}{<small/>}</h1>;\n")]
    nodes, edges = code_graph(spark.createDataFrame(rows, "repo_id string, path string, source string"))
    assert {r["name"] for r in nodes.filter("label = 'Component'").collect()} == {"App", "Nav", "Home"}
    assert nodes.filter("label = 'Route'").first()["name"] == "ROUTE /home"
    uses = {(r["src"], r["dst"]) for r in edges.filter(F.col("type") == "USES_COMPONENT").collect()}
    assert uses == {("r:src/App.tsx#App", "r:src/App.tsx#Nav"), ("r:src/App.tsx#App", "r:src/Home.tsx#Home")}
    print([tuple(r) for r in edges.filter(F.col("type") == "HANDLES").collect()])
    assert {r["src"] for r in edges.filter(F.col("type") == "HANDLES").collect()} == {"r:src/Home.tsx#Home"}
