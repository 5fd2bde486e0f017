"""The driver's contract, with and without the subpackage of training data."""

import ast
import pathlib

import __spark_entry__ as driver

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert driver.entry(spark).columns == ["query", "doc_id", "score", "bm25_rank", "vector_rank", "rank"]


def test_sql_belongs_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "thicket").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "thicket").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
