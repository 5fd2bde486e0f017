import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.errors import ValidationError
from thicket.functions import ids, paths, text

WORD = st.text("abcXYZ09._-", min_size=1, max_size=8)


@given(WORD.filter(lambda s: s[0].isalnum()), st.lists(WORD, min_size=1, max_size=3), WORD, st.none() | st.integers(0, 99))
def test_codec_round_trip(repo, parts, qualified, part):
    symbol = ids.format_symbol_id(repo, "/".join(parts), qualified)
    assert ids.parse_symbol_id(symbol) == (repo, "/".join(parts), qualified)
    assert ids.parse_chunk_id(ids.format_chunk_id(symbol, part)) == (symbol, part)


@pytest.mark.parametrize("bad", ["", "r", "r:p", "r:p#", ":p#q", "r:/p#q", "r:p~#q", "r:p#a:b"])
def test_codec_rejects(bad):
    with pytest.raises(ValidationError):
        ids.parse_symbol_id(bad)


def test_id_columns(spark):
    row = spark.createDataFrame([("r:a/b.ts#C.d~12",), ("r:a.ts",), (None,)], "id string").select(
        ids.repo_of(F.col("id")), ids.path_of(F.col("id")), ids.qualified_of(F.col("id")), ids.part_of(F.col("id")), ids.symbol_of(F.col("id"))
    ).collect()
    assert tuple(row[0]) == ("r", "a/b.ts", "C.d", 12, "r:a/b.ts#C.d")
    assert tuple(row[1])[:4] == ("r", "a.ts", None, None)


def test_split_identifiers(spark):
    got = spark.createDataFrame([("fetchUserHTTPData snake_case_x $el schön",), ("",), (None,)], "t string").select(text.split_identifiers(F.col("t"))).collect()
    assert got[0][0] == ["fetchuserhttpdata", "fetch", "user", "http", "data", "snake_case_x", "snake", "case", "$el", "el", "sch", "n"]
    assert got[1][0] == [] and got[2][0] is None


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c/x.ts",), ("x.ts",), ("../up/x",)], "p string")
    got = df.select(paths.normalized(F.col("p")), paths.dirname(F.col("p")), paths.basename(F.col("p")), paths.ancestor_dirs(F.col("p"))).collect()
    assert tuple(got[0]) == ("a/c/x.ts", "a/./b/../c", "x.ts", ["a", "a/.", "a/./b", "a/./b/..", "a/./b/../c"])
    assert tuple(got[1]) == ("x.ts", "", "x.ts", []) and got[2][0] == "../up/x"


@pytest.mark.parametrize(
    "glob,path,hit",
    [("**/node_modules/**", "a/node_modules/b/c.js", True), ("**/node_modules/**", "node_modules/x", True), ("**/*.test.ts", "a/b.test.ts", True), ("src/*.ts", "src/a/b.ts", False), ("*.{js,ts}", "a.ts", True), ("a?c", "abc", True), ("[!a]x", "ax", False)],
)
def test_globs(glob, path, hit):
    import re

    assert bool(re.match(paths.glob_pattern(glob), path)) is hit


def test_snippet_and_tokens(spark):
    row = spark.createDataFrame([("// path\n// sig\nconst a = 1;\n\nb\nc\nd",)], "c string").select(text.snippet(F.col("c")), text.estimated_tokens(F.col("c"))).first()
    assert row[0] == "const a = 1;\n\nb\nc" and row[1] == 9
