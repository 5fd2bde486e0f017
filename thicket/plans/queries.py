"""The core's queries over the catalog's tables, and their SQL."""

from __future__ import annotations

from thicket.plans import graph_queries, index_queries, text_queries

FLAGSHIP = "hybrid_search"
MODULES = (text_queries, graph_queries, index_queries)
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL

#: Counts and ranks that are 32-bit here and 64-bit in DuckDB: the twins are cast, so that the schemas agree too.
NARROW = {
    "bm25_batch": ["rank"], "bm25_search": ["rank"], "bm25_filtered": ["rank"], "vector_topk": ["rank"], "vector_topk_filtered": ["rank"],
    "hybrid_search": ["bm25_rank", "vector_rank", "rank"], "rerank_overlap": ["rank", "overlap", "reranked"], "run_journal": ["errors"], "key_modules": ["rank"],
    "symbols_by_file": ["place"], "file_listing": ["place"], "chat_history": ["turn"], "citations": ["place"], "stored_citations": ["place"], "line_rule_findings": ["line", "n"],
}
for _name, _columns in NARROW.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in _columns)}) FROM ({SQL[_name]})"
