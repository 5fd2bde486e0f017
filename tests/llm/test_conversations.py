"""Sessions against a brute-force reading, and each stated case."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from thicket.llm.components import connected_components
from thicket.llm.conversations import conversations, is_placeholder, judge_sessions, message_links

T = dt.datetime(2024, 1, 1)
SCHEMA = "id string, session_id string, role string, content string, citations_json string, created_at timestamp"


def rows(*turns, session="s"):
    """Turns (role, content, second)."""
    return [(f"{session}{n}", session, role, content, None, None if at is None else T + dt.timedelta(seconds=at)) for n, (role, content, at) in enumerate(turns)]


CASES = [
    (True, [("user", "q", 1), ("assistant", "a", 2)]),
    (True, [(" Human", "q", 1), ("AI\n", "a", 1), ("bot", "more", 2), ("User", "q2", 3), ("model", "b", 4)]),
    (True, [("system", "", 0), ("user", "q", 1), ("tool", None, 1), ("assistant", "a", 2)]),
    (True, [("user", "q", 1), ("assistant", "Error: socket hang up", 2), ("assistant", "a", 3)]),
    (True, [("user", "q", 1), ("assistant", "Error: is what f logs when it fails [S1].", 2)]),
    (True, [("user", "q", 1), ("assistant", "I could not find f in the index.", 2)]),
    (False, [("user", "q", 1)]),
    (False, [("assistant", "a", 1), ("user", "q", 2), ("assistant", "a", 3)]),
    (False, [("user", "q", 1), ("user", "q2", 2), ("assistant", "a", 3)]),
    (False, [("user", "q", 1), ("user", "q2", 1), ("assistant", "a", 3)]),
    (False, [("user", "q", 1), ("assistant", "a", 2), ("user", "q2", 3)]),
    (False, [("user", "​ \n", 1), ("assistant", "a", 2)]),
    (False, [("user", "q", 1), ("assistant", "　", 2)]),
    (False, [("user", "q", 1), ("assistant", None, 2)]),
    (False, [("user", "q", 1), ("assistant", "a", 2), ("user", "q", 3), ("assistant", "[request aborted]", 4)]),
    (False, [("user", "q", None), ("assistant", "a", 2)]),
    (False, [("user", "q", 1), ("assistant", "a", 2), ("?", "x", 3)]),
    (False, [("user", "q", 1), ("assistant", "a", 2), (None, "x", 3)]),
    (False, [("system", "s", 1)]),
]


def test_cases(spark):
    data = [r for n, (_, turns) in enumerate(CASES) for r in rows(*turns, session=f"s{n}")]
    m = spark.createDataFrame(data + data + [("z", None, "user", "q", None, T)], SCHEMA).withColumn("conversation", F.lit(1)).withColumn("at", F.lit(2))
    sessions = spark.createDataFrame([("empty",), ("s0",), (None,), ("empty",)], "id string")
    got = {r["session_id"]: r["kept"] for r in judge_sessions(m, sessions).collect()}
    assert got == {**{f"s{n}": kept for n, (kept, _) in enumerate(CASES)}, "empty": False}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    data = []
    for s in range(120):
        data += rows(*[(r.choice(["user", "assistant", "assistant"]), "x", r.randrange(6)) for _ in range(r.randrange(1, 7))], session=f"s{s}")
    # One session with many more messages than the rest, over all ranges.
    data += rows(*[(("user", "assistant")[n % 2], "x", n) for n in range(400)], session="hot")
    import re

    by = {}
    for _, s, role, _, _, at in data:
        by.setdefault(s, []).append((at, role == "assistant"))
    expected = {s: bool(re.fullmatch("(qr+)+", "".join("qr"[w] for _, w in sorted(ts)))) for s, ts in by.items()}
    got = {x["session_id"]: x["kept"] for x in judge_sessions(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == expected and got["hot"]


def test_turns_are_numbered_through(spark):
    data = rows(*[(("user", "assistant")[n % 2], f"c{n}", n) for n in range(100)], session="hot") + rows(("user", "q", 1), session="bad")
    got = conversations(spark.createDataFrame(data + data, SCHEMA)).orderBy("turn").collect()
    assert [(r["turn"], r["content"]) for r in got] == [(n + 1, f"c{n}") for n in range(100)]


def test_links_join_messages_without_session(spark):
    first, second = rows(("user", "q", 1), ("assistant", "a", 2), session="s"), rows(("user", "q", 1), ("assistant", "a", 2), session="lost")
    lost = [(i, None, role, c, f'[{{"replyTo": "{link}"}}]' if link else None, at) for (i, _, role, c, _, at), link in zip(second, (None, "lost0"))]
    reply = ("r", None, "assistant", "b", '[{"quote": "s1"}]', T + dt.timedelta(seconds=5))
    m = spark.createDataFrame([*first, *lost, reply, ("x", None, "user", "alone", "{broken", T)], SCHEMA)
    assert {(r["a"], r["b"]) for r in message_links(m).collect()} == {("lost1", "lost0"), ("r", "s1")}
    got = {}
    for r in conversations(m).collect():
        got.setdefault(r["session_id"], []).append((r["turn"], r["content"]))
    assert {k: sorted(v) for k, v in got.items()} == {"s": [(1, "q"), (2, "a"), (3, "b")], "lost0": [(1, "q"), (2, "a")]}


def test_empty_table(spark):
    m = spark.createDataFrame([], SCHEMA)
    assert judge_sessions(m).isEmpty() and conversations(m).isEmpty()


@pytest.mark.parametrize("text,hit", [("null", True), ("HTTP 502", True), ("504", True), ("data: [DONE]", True), ("ECONNRESET", True), ("Yes.", False), ("`null`, unless it was loaded.", False), ("42", False), ("The request fails with 503 whenever it is locked, see [S1].", False), ("Everything", False), ("EVERYTHING is fine", False)])
def test_placeholders(spark, text, hit):
    assert spark.createDataFrame([(text,)], "c string").select(is_placeholder(F.col("c"))).first()[0] is hit


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(30)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(25)] + [("hub", f"h{i}") for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs + pairs[:5] + [(None, "x"), ("y", None)], "a string, b string")
    got = {x["node"]: x["component"] for x in connected_components(df).collect()}
    assert got == {x: find(x) for p in pairs for x in p}
    assert connected_components(df.limit(0)).isEmpty()
