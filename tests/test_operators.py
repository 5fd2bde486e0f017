"""Worked examples of the core's operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from thicket.errors import ConflictError, ParseError, ValidationError
from thicket.operators import analysis, bm25, chat, context, edits, fusion, indexing, intents, resolve, vectors
from thicket.plans import rag
from thicket.plans.codegraph import code_graph, parse_sources
from thicket.sources import discover
from thicket.streaming import watch


def test_rrf_by_hand(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "id string, rank int")
    b = spark.createDataFrame([("y", 1)], "id string, rank int")
    got = {r["id"]: r for r in fusion.reciprocal_rank_fusion([("bm25", a), ("vector", b)], "id").collect()}
    assert got["x"]["score"] == 1 / 61 + 1 / 63 and got["y"]["score"] == 1 / 62 + 1 / 61
    assert got["x"]["provenance"] == {"bm25": 1} and got["y"]["provenance"] == {"bm25": 2, "vector": 1}
    assert (got["y"]["rank"], got["x"]["rank"]) == (1, 2) or got["x"]["score"] > got["y"]["score"]
    empty = a.limit(0)
    assert fusion.reciprocal_rank_fusion([("bm25", empty)], "id").isEmpty()


def test_rrf_ties_follow_the_locale(spark):
    a = spark.createDataFrame([("B", 1), ("a", 1), ("b", 1), ("A", 1)], "id string, rank int")
    got = [r["id"] for r in fusion.reciprocal_rank_fusion([("l", a)], "id").orderBy("rank").collect()]
    assert got == ["a", "A", "b", "B"]


def test_bm25_prefers_names_and_knows_empty_tables(spark):
    rows = spark.createDataFrame(
        [("1", "helper mentions fetchUser", "helper", "a.ts", "function"), ("2", "body", "fetchUser", "b.ts", "function"), ("3", None, "Card", "c.tsx", "component"), ("4", "", "x", "d.ts", "variable")],
        "id string, content string, name string, path string, kind string",
    )
    full = bm25.with_tokens_column(rows)
    index, stats = bm25.postings(full, "id", bm25.CHUNK_WEIGHTS), bm25.corpus_stats(full, bm25.CHUNK_WEIGHTS)
    assert [r["id"] for r in bm25.search(index, stats, "fetch user", "id").orderBy("rank").collect()] == ["2", "1"]
    assert bm25.search(index, stats, "()", "id").isEmpty()
    none = full.limit(0)
    assert bm25.search(bm25.postings(none, "id", {"content": 1.0}), bm25.corpus_stats(none, {"content": 1.0}), "a bc", "id").isEmpty()


def test_top_k_edges(spark):
    data = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0]), (6, [1.0])], "id long, v array<float>")
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "query long, v array<float>")
    got = vectors.top_k(data, asked, "id", "v", 3).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0), (5, 1.0), (2, 0.0)]
    assert vectors.top_k(data.limit(0), asked, "id", "v").isEmpty()
    pair = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in pair.select(F.round(vectors.cosine(F.col("a"), F.col("b")), 9)).collect()] == [1.0, 0.0, None]


def test_embedder_plug_in(spark):
    rows = spark.createDataFrame([("a", "x" * 5000), ("b", None)], "id string, text string")
    got = {r["id"]: r["vector"] for r in vectors.embed_with(rows, "id", "text", lambda ts: [[len(t)] for t in ts]).collect()}
    assert got == {"a": [4000.0], "b": [0.0]}


def test_context_budget():
    row = {"symbol_id": "s", "path": "a.ts", "start_line": 1, "end_line": 2, "signature": "f()", "qualified": "f", "doc": None, "code": "x" * 400, "callers": "c" * 40, "callees": None, "related": None}
    blocks, used, truncated = context.assemble([row, {"path": None}, row], 1000)
    assert len(blocks) == 2 and not truncated and "xxx" in blocks[0]["text"] and "xxx" not in blocks[1]["text"] and blocks[1]["mark"] == "S2"
    blocks, used, truncated = context.assemble([row, row], 20)
    assert used <= 20 and "xxx" not in blocks[0]["text"] and "ccc" in blocks[0]["text"] and truncated


def test_intents():
    assert intents.hierarchy_intent("Who calls fetchUser?") == ("callers", ["fetchUser"])
    assert intents.hierarchy_intent("who calls the") is None and intents.hierarchy_intent("hello fetchUser") is None
    assert intents.template_intent("who calls fetchUser()?") == ("who_calls", {"name": "fetchUser()?"})
    assert intents.template_intent("files depending on lodash")[0] == "files_depending_on" and intents.template_intent("list all routes") == ("routes", {})


def test_patches_and_states():
    assert edits.apply_patch("a\nb\nc", 2, 2, "x\ny") == "a\nx\ny\nc" and edits.apply_patch("a\nb", 1, 2, "") == ""
    with pytest.raises(ValidationError):
        edits.apply_patch("a", 1, 2, "")
    assert edits.transition("pending", "applied") == "applied"
    with pytest.raises(ConflictError):
        edits.transition("rejected", "applied")
    assert "+y" in edits.unified_diff("a.ts", "x\n", "y\n")


def test_patch_column(spark):
    df = spark.createDataFrame([("a\nb\nc", 2, 2, "x\ny"), ("a\nb", 1, 2, ""), ("a", 1, 2, "")], "s string, a int, b int, r string")
    assert [r[0] for r in df.select(edits.patched(F.col("s"), F.col("a"), F.col("b"), F.col("r"))).collect()] == ["a\nx\ny\nc", "", None]


RULES = {
    "react-list-key": ("xs.map((x) => <li>{x}</li>)", "xs.map((x) => <li key={x}>{x}</li>)"),
    "perf-array-index-key": ("xs.map((x, i) => <li key={i}/>)", "xs.map((x, i) => <li key={x.id}/>)"),
    "react-memo-inline-prop": ("const Row = memo(R); <Row a={() => 1}/>", "const Row = memo(R); <Row a={b}/>"),
    "ts-any-leak": ("let a: any", "let a: anything"),
    "ts-non-null-assertion": ("a!.b", "a != b"),
    "a11y-img-alt": ("<img src='a'>", "<img alt='' src='a'>"),
    "security-dangerous-html": ("<p dangerouslySetInnerHTML={x}/>", "<p/>"),
    "react-hook-deps": ("useEffect(() => { load(id) }, [load])", "useEffect(() => { load(id) }, [load, id])"),
}


@pytest.mark.parametrize("rule", RULES)
def test_rules(rule):
    bad, good = RULES[rule]
    assert (rule, 2) in {f[:2] for f in analysis.findings("\n" + bad)} and rule not in {f[0] for f in analysis.findings(good)}


def test_alt_patch():
    assert analysis.suggest_alt_patch("a\n<img src='x'>", 2) == "<img alt=\"\" src='x'>" and analysis.suggest_alt_patch("a", 5) is None


def test_diff_keeps_unreadable(spark):
    found = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", None), ("r", "d", "4"), ("r", "d", "4")], "repo_id string, path string, hash string")
    stored = spark.createDataFrame([("r", "a", "1"), ("r", "b", "x"), ("r", "c", "3"), ("r", "e", "5")], "repo_id string, path string, hash string")
    assert {(r["path"], r["state"]) for r in indexing.hash_diff(found, stored).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "unreadable"), ("d", "added"), ("e", "removed")}


@pytest.mark.parametrize("lines,parts", [(1, 1), (120, 1), (121, 2), (230, 2), (231, 3)])
def test_windows(spark, lines, parts):
    df = spark.createDataFrame([("k", "\n".join(map(str, range(lines))))], "k string, t string")
    rows = indexing.chunk_windows(df, "k", "t").orderBy("first_line").collect()
    assert len(rows) == parts and rows[0]["n_lines"] == min(lines, 120) and (rows[0]["part"] is None) == (parts == 1)


def test_chunks_carry_headers(spark):
    symbols = spark.createDataFrame([("r:a.ts#f", "r:a.ts", "r", "function", "f", "function f()", "Does.", 2, 3)], "id string, file_id string, repo_id string, kind string, qualified string, signature string, doc string, start_line int, end_line int")
    sources = spark.createDataFrame([("r:a.ts", "// x\nfunction f() {\n}\n")], "file_id string, source string")
    row = indexing.chunk_symbols(symbols, sources).first()
    assert row["content"] == "// a.ts · function f\n// function f()\n// Does.\nfunction f() {\n}" and row["id"] == "r:a.ts#f"


def test_history_and_citations(spark):
    t = dt.datetime(2024, 1, 1)
    m = spark.createDataFrame([("s", f"m{i}", "user", str(i), t + dt.timedelta(seconds=i // 2)) for i in range(9)] + [(None, "z", "user", "", t)], "session_id string, id string, role string, content string, created_at timestamp")
    assert [r["content"] for r in chat.history(m).orderBy("turn").collect()] == ["3", "4", "5", "6", "7", "8"]
    a = spark.createDataFrame([(1, "x [S2] y [S1] [S2]"), (2, None)], "id int, content string")
    assert [(r["place"], r["mark"]) for r in chat.cited(a).orderBy("place").collect()] == [(1, "S2"), (2, "S1")]


FILES = {
    "src/index.ts": "import { used } from './lib';\nimport express from 'express';\nexport const app = express();\napp.get('/u/:id', handler);\nexport function handler() { used(); }\n",
    "src/lib/index.ts": "export * from './a';\nexport { b as renamed } from './b';\n",
    "src/lib/a.ts": "import { renamed } from '.';\nexport function used() { return renamed(); }\nexport function dead() { return used(); }\n",
    "src/lib/b.ts": "export function b() { return 1; }\n",
    "src/view.tsx": "import * as lib from './lib';\nexport const Ctx = createContext(null);\nexport function useThing() { return useContext(Ctx); }\nfunction Row() { useThing(); return <li/>; }\nexport function List() { lib.used(); return <Ctx.Provider><Row/></Ctx.Provider>; }\n",
    "src/broken.ts": "export function ok() { return 1; }\nfunction bad( {\n",
    "src/notes.txt": "text",
}


@pytest.fixture(scope="module")
def code(spark):
    rows = [("r", p, s) for p, s in FILES.items()]
    return spark.createDataFrame(rows, "repo_id string, path string, source string")


def test_code_graph(spark, code):
    nodes, edges = code_graph(code)
    got = {(r["src"].removeprefix("r:src/"), r["dst"].removeprefix("r:src/"), r["type"]) for r in edges.collect()}
    for edge in [
        ("index.ts#handler", "lib/a.ts#used", "CALLS"),
        ("lib/a.ts#used", "lib/b.ts#b", "CALLS"),
        ("lib/a.ts#dead", "lib/a.ts#used", "CALLS"),
        ("index.ts", "lib/index.ts", "IMPORTS"),
        ("index.ts", "r::dep::express", "IMPORTS"),
        ("index.ts#handler", "index.ts#GET /u/$id", "HANDLES"),
        ("view.tsx#List", "view.tsx#Row", "USES_COMPONENT"),
        ("view.tsx#List", "view.tsx#Ctx", "PROVIDES_CONTEXT"),
        ("view.tsx#useThing", "view.tsx#Ctx", "CONSUMES_CONTEXT"),
        ("view.tsx#Row", "view.tsx#useThing", "USES_HOOK"),
        ("index.ts", "index.ts#app", "DECLARES"),
        ("broken.ts", "broken.ts#ok", "DEFINES"),
    ]:
        assert edge in got, edge
    labels = {r["id"].removeprefix("r:src/"): r["label"] for r in nodes.collect()}
    assert labels["view.tsx#List"] == "Component" and labels["view.tsx#useThing"] == "Hook" and labels["view.tsx#Ctx"] == "Context" and labels["r::dep::express"] == "Dependency"
    roots = analysis.dead_code_roots(nodes, edges)
    assert "r:src/lib/a.ts#dead" in {r["id"] for r in analysis.dead_symbols(nodes, edges, roots).collect()}


def test_parse_errors_stay_with_their_file(code):
    errors = {r["path"]: r["error"] for r in parse_sources(code).collect()}
    assert errors["src/broken.ts"] and errors["src/notes.txt"].startswith(ParseError.__name__) and errors["src/index.ts"] is None


def test_resolution_order_and_aliases(spark):
    known = spark.createDataFrame([("r", p) for p in ("a.ts", "a.js", "a/index.ts", "src/x/index.tsx", "d.ts")], "repo_id string, path string")
    wanted = spark.createDataFrame([("r", "m.ts", s) for s in ("./a", "./a.js", "@/x", "react", "./none", None)], "repo_id string, path string, specifier string")
    got = {r["specifier"]: r["target"] for r in resolve.resolve_modules(wanted, known, [("@/*", ["src/*"])]).collect()}
    assert got == {"./a": "a.ts", "./a.js": "a.js", "@/x": "src/x/index.tsx", "react": None, "./none": None}


def test_export_cycles_end(spark):
    exports = spark.createDataFrame([("a", 0, None, None, "star", "b"), ("b", 0, None, None, "star", "a"), ("b", 1, "x", "x", "named", None)], "file string, ord int, name string, local string, kind string, target string")
    symbols = spark.createDataFrame([("b", "x", "b#x")], "file string, qualified string, id string")
    wanted = spark.createDataFrame([("a", "x"), ("a", "none")], "file string, name string")
    assert {(r["name"], r["symbol_id"]) for r in resolve.resolve_exports(wanted, exports, symbols).collect()} == {("x", "b#x"), ("none", None)}


def test_exports_through_long_chains(spark):
    steps = [(f"f{i}", 0, "x", "x", "reExport", f"f{i + 1}") for i in range(52)] + [("f52", 0, "x", "x", "named", None)]
    exports = spark.createDataFrame(steps, "file string, ord int, name string, local string, kind string, target string")
    symbols = spark.createDataFrame([("f52", "x", "f52#x")], "file string, qualified string, id string")
    wanted = spark.createDataFrame([("f0", "x")], "file string, name string")
    assert [r["symbol_id"] for r in resolve.resolve_exports(wanted, exports, symbols).collect()] == ["f52#x"]


def test_dependencies(spark):
    declared = spark.createDataFrame([("lodash",), ("left-pad",)], "name string")
    imports = spark.createDataFrame([("lodash",), ("fs",), ("node:fs",), ("fs",)], "name string")
    got = {(r["name"], r["kind"], r["import_count"]) for r in analysis.dependency_mismatches(declared, imports).collect()}
    assert got == {("left-pad", "unused", 0), ("fs", "phantom", 2)}


def test_manifests_and_configs(spark):
    files = spark.createDataFrame(
        [("r", "package.json", '{"name":"root","workspaces":["pkgs/*"],"dependencies":{"a":"^1"},"devDependencies":{"b":"2"}}'), ("r", "pkgs/x/package.json", '{"name":"x","peerDependencies":{"c":"3"}}'), ("r", "other/y/package.json", '{"name":"y","dependencies":{"z":"1"}}'), ("r", "pkgs/bad/package.json", "{"), ("q", "pkgs/x/package.json", '{"name":"lost","dependencies":{"z":"1"}}'), ("r", "tsconfig.json", "{}")],
        "repo_id string, path string, source string",
    )
    assert {(r["package"], r["name"], r["kind"]) for r in discover.manifests(files).collect()} == {("root", "a", "prod"), ("root", "b", "dev"), ("x", "c", "peer")}
    assert [r["kind"] for r in discover.config_files(files).collect()] == ["tsconfig"]


def test_discovery(spark, tmp_path):
    for p in ("src/a.ts", "src/b.txt", "node_modules/x/c.js", "dist/d.js", ".hidden/e.mjs"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert sorted(r["path"] for r in discover.discover(spark, str(tmp_path)).collect()) == ["src/a.ts"]


def test_watching(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"repo_id":"r","path":"a","action":"change","hash":"1","at":"2024-01-01T00:00:00Z"}\n{"repo_id":"r","path":"a","action":"change","hash":"2","at":"2024-01-01T00:00:01Z"}\n')
    seen, failed = [], []
    changes = watch.read_changes(spark, str(tmp_path / "in"))
    watch.watch(changes, lambda b, n: seen.extend(r["hash"] for r in b.collect()), str(tmp_path / "c1")).awaitTermination(60)
    assert seen == ["2"]

    def broken(batch, n):
        raise ValueError("no")

    watch.watch(changes, broken, str(tmp_path / "c2"), on_error=failed.append).awaitTermination(60)
    assert len(failed) == 1


def test_pipeline_end_to_end(spark, code):
    from thicket.plans.codegraph import tables

    parsed = parse_sources(code).cache()
    t = tables(parsed)
    nodes, edges = code_graph(code)
    symbols = t["symbols"].withColumn("file_id", F.col("file"))
    chunks = indexing.chunk_symbols(symbols, code.withColumn("file_id", F.concat("repo_id", F.lit(":"), "path")))
    full = bm25.with_tokens_column(chunks.join(symbols.select(F.col("id").alias("symbol_id"), "name", "kind", "path"), "symbol_id"))
    index = rag.Index(full.cache(), symbols.cache(), nodes.cache(), edges.cache())
    assert rag.search(index, "used", "keyword", 5).count() > 0
    answer = rag.ask(index, "Who calls used?", rag.MockModel(["[S1] and [S9]"]))
    assert answer.grounded and [c["mark"] for c in answer.citations] == ["S1"] and answer.intent == ("who_calls", {"name": "used?"})
    with pytest.raises(ValidationError):
        rag.search(index, "x", "fuzzy")
    for mode in ("keyword", "semantic", "hybrid"):
        everywhere = {r["symbol_id"]: r["score"] for r in rag.search(index, "used", mode, 100).collect()}
        kinds = {r["id"]: r["kind"] for r in symbols.collect()}
        only = {r["symbol_id"]: r["score"] for r in rag.search(index, "used", mode, 100, kinds=["Function"]).collect()}
        assert only and {kinds[x] for x in only} == {"function"} and (mode == "hybrid" or all(abs(everywhere[x] - v) < 1e-9 for x, v in only.items()))
        assert rag.search(index, "used", mode, 100, path_prefix="nowhere/").isEmpty()
    assert rag.search(index, "used", "hybrid", 100, language="json").isEmpty() and not rag.search(index, "used", "semantic", 5, language="typescript").isEmpty()
    assert any(c["graph_path"] for c in answer.citations)
    kept = []
    rag.RETRIEVERS["none"] = lambda index, text, k: None
    try:
        plain = rag.ask(index, "used", rag.MockModel(["[S1]"]), rerank=False, count=len, budget=400, remember=lambda role, said: kept.append(role))
    finally:
        del rag.RETRIEVERS["none"]
    assert kept == ["user", "assistant"] and sum(b["tokens"] for b in plain.blocks) <= 400


def test_rewriting_falls_back():
    assert rag.rewrite_queries("q") == ["q"] and rag.rewrite_queries("q", rag.MockModel(["no json"])) == ["q"]
    assert rag.rewrite_queries("q", rag.MockModel(['{"queries": ["a", "b"]}'])) == ["a", "b"]
    assert rag.standalone_question("q", [("user", "x")], rag.MockModel([" r "])) == "r" and rag.standalone_question("q", []) == "q"
