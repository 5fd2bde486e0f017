"""The queries on the smallest tables: columns as stated, each row once, and the SQL where there is one."""

import duckdb
import pytest

from thicket.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
STATED = {"p1_found": ["session_id"], "p2_found": ["file_id"], "p3_found": ["file_id"], "p4_found": ["symbol_id"], "p5_found": ["chunk_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "subject"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()]
    if name in STATED:
        assert df.columns == STATED[name] and len(set(rows)) == len(rows)
    if name in SQL:
        con = duckdb.connect()
        for t in ("chunks", "chat_messages", "chat_sessions", "documents", "mix_targets"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        assert sorted(rows) == sorted(con.execute(SQL[name]).fetchall())
