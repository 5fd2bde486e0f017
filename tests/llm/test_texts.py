"""Splitting, tokens, mixing and subjects."""

import random
from unittest import mock

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.llm.mixing import plan_mixture, rake, reached_marginals, reached_shares
from thicket.llm.splitting import own_lines, split_oversized, split_text, token_sums
from thicket.llm.subjects import assign_subjects, subject_scores, subject_shares
from thicket.llm.tokens import coder, encode_tree, token_ids


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\r{};é🏽́", max_size=400), st.integers(20, 60), st.integers(0, 9), st.lists(st.integers(0, 30), max_size=5))
def test_pieces_cover_the_text(text, limit, overlap, starts):
    pieces = split_text(text, starts, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert c == b - overlap and c > a and d > b
    assert all(b - a <= limit for a, b in pieces) and (len(text) > limit) == (len(pieces) > 1)


def test_cuts_at_definitions_then_lines():
    text = "\n".join(f"line {n:03}" for n in range(30))
    a, b = split_text(text, [15], 180, 20)[0]
    assert text[b:].startswith("line 015")
    assert split_text("x" * 100, [], 40, 10) == [(0, 40), (30, 70), (60, 100)]
    with pytest.raises(ValueError):
        split_text("x", [], 10, 5)


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n{};é🏽日́", min_size=30, max_size=400), st.integers(12, 30), st.integers(0, 5))
def test_pieces_by_tokens(text, limit, overlap):
    encode, decode = coder()
    sums = token_sums(text, encode, decode)
    assert sums[0] == 0 and sums[-1] == len(encode(text)) and sums == sorted(sums)
    pieces = split_text(text, [], limit, overlap, sums)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and (sums[b] - sums[c] >= overlap or c == a + 1)
    assert all(sums[b] - sums[a] <= limit or b == a + 1 for a, b in pieces)


def test_parts_know_their_lines():
    body = "// part 2\n" + "\n".join(f"line {n}" for n in range(111, 231))
    assert own_lines("r:a#f~1", body, [120, 230, 231, 5], 111, 230) == [10, 120] and own_lines("r:a#f~1", body + "\nmore", [120], 111, 230) == []
    assert body.split("\n")[10] == "line 120" and own_lines("r:a#f", "// head\nline 7\nline 8", [8], 7, 8) == [2]


def test_split_table(spark):
    big = "\n".join("x" * 50 for _ in range(100))
    chunks = spark.createDataFrame([("r:a#f", "r:a#f", big), ("r:a#f", "r:a#f", big), ("b", "b", "short"), ("c", "c", None), ("d", "d", "🎼" * 4001), ("e", "e", "y" * 4000)], "id string, symbol_id string, content string").withColumn("piece", F.lit("clash"))
    symbols = spark.createDataFrame([("r:a#f", "r:a", 1, 100), ("r:a#f.g", "r:a", 60, 70), ("n", None, None, None)], "id string, file_id string, start_line int, end_line int")
    got = {}
    for r in split_oversized(chunks, symbols).orderBy("piece").collect():
        got.setdefault(r["chunk_id"], []).append(r)
    assert set(got) == {"r:a#f", "d"}
    for chunk, text in (("r:a#f", big), ("d", "🎼" * 4001)):
        joined = got[chunk][0]["content"] + "".join(r["content"][200:] for r in got[chunk][1:])
        assert joined == text and all(len(r["content"]) <= 4000 for r in got[chunk])
    assert got["r:a#f"][1]["start"] + 200 == 51 * 70
    assert split_oversized(chunks.limit(0), symbols).isEmpty() and split_oversized(chunks).count() == 4
    encode, _ = coder()
    by_tokens = split_oversized(chunks, symbols, 300, 20, "byte_bpe_50k").filter("chunk_id = 'r:a#f'").orderBy("start").collect()
    assert len(by_tokens) > 1 and all(len(encode(r["content"])) <= 310 for r in by_tokens) and big.endswith(by_tokens[-1]["content"])


PIECES = st.lists(st.sampled_from(["a", "the ", " the", " ", "  ", "\n", "\n\n", "'s", "'", "é", "日本", "1", "12", "!", "🎼", "\t", "<|endoftext|>", "x" * 40, "abc def ", ".\n"]), max_size=120)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(1, 40))
def test_tree_encodes_like_the_whole(parts, leaf):
    encode, decode = coder()
    text = "".join(parts)
    ids = encode_tree(text, encode, decode, leaf)
    assert ids == encode(text) and decode(ids).decode() == text


def test_same_ids_as_the_other_library(spark):
    from tokenizers import Tokenizer

    from thicket.llm.tokens import TOKENIZERS

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    r = random.Random(5)
    texts = ["", None, " ", "a", "<|endoftext|>", "long " * 40_000, "日" * 9_000, "".join(r.choice("ab \n'é1!") for _ in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {x["doc_id"]: list(x["ids"]) for x in token_ids(df, segment=3_000, leaf=500).collect()}
    assert got == {n: t.encode(x, add_special_tokens=False).ids if x else [] for n, x in enumerate(texts)}
    twice = token_ids(df.unionByName(df), segment=3_000)
    assert twice.count() == 2 * len(texts) and token_ids(df.limit(0)).isEmpty()


def test_raking_meets_sources_and_caps():
    size = np.array([100.0, 300.0, 50.0, 50.0])
    keys = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    w = rake(size, keys, [np.array([200.0, 150.0]), np.array([175.0, 175.0])], np.array([2.0, 2.0, 4.0, 4.0]))
    assert np.allclose(np.bincount(keys[0], w * size), [200, 150]) and (w <= [2, 2, 4, 4]).all()
    assert abs((w * size)[keys[1] == 0].sum() - 175) < 1
    w = rake(size, keys, [np.array([900.0, 150.0]), np.array([500.0, 500.0])], np.array([2.0, 2.0, 4.0, 4.0]))
    assert np.allclose(w[:2], 2) and np.isclose((w * size)[2:].sum(), 150)


def test_mixture(spark):
    r = random.Random(1)
    docs = [(i, ["big", "small", "none"][(i % 20 == 0) + 2 * (i % 20 == 1)], r.choice(["en", "de"]), "none", r.randrange(1, 200)) for i in range(4000)] + [(9000, "big", "en", "none", 0)]
    measured = spark.createDataFrame(docs, "doc_id long, source string, lang string, topic string, tokens long")
    targets = spark.createDataFrame([("Big", 0.7, 2), ("small", 0.25, 4), ("absent", 0.05, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = plan_mixture(measured, targets).cache()
    got = {x["source"]: x for x in reached_shares(mixed, targets).collect()}
    assert abs(got["big"]["actual_share"] - 0.7 / 0.95) < 0.01 and abs(got["small"]["actual_share"] - 0.25 / 0.95) < 0.01
    assert got["absent"]["tokens"] == 0 and got["big"]["most_repeats"] <= 2 and got["small"]["most_repeats"] <= 4
    assert mixed.filter("source = 'none' or tokens = 0").isEmpty() and mixed.count() == mixed.select("doc_id").distinct().count()
    marginals = {(x["dimension"], x["value"]): x for x in reached_marginals(mixed, measured, targets).collect()}
    assert abs(marginals["language", "de"]["actual_share"] - marginals["language", "de"]["target_share"]) < 0.02
    assert abs(marginals["source", "small"]["actual_share"] - 0.25 / 0.95) < 0.01 and set(marginals) == {("source", "big"), ("source", "small"), ("language", "en"), ("language", "de"), ("topic", "none")}
    short = {x["source"]: x["actual_share"] for x in reached_shares(plan_mixture(measured, targets, 3_000_000), targets).collect()}
    many = measured.withColumn("lang", F.concat("lang", (F.col("doc_id") % 50).cast("string")))
    with mock.patch("thicket.llm.mixing.MOST_CELLS", 20):
        coarse = {x["source"]: x["actual_share"] for x in reached_shares(plan_mixture(many, targets), targets).collect()}
    assert abs(coarse["small"] - 0.25 / 0.95) < 0.01
    assert short["small"] < 0.25 / 0.95
    assert plan_mixture(measured.limit(0), targets).isEmpty() and plan_mixture(measured, targets.limit(0)).isEmpty()


def test_mixture_is_the_same_however_many_cells(spark):
    r = random.Random(2)
    docs = [(i, r.choice(["big", "small"]), f"l{chr(97 + min(int(r.expovariate(0.3)), 25))}", r.choice(["law", "none"]), r.randrange(1, 200)) for i in range(3000)]
    measured = spark.createDataFrame(docs, "doc_id long, source string, lang string, topic string, tokens long")
    targets = spark.createDataFrame([("big", 0.8, 2), ("small", 0.2, 4)], "source string, target_share double, max_repeats int")
    few = sorted(tuple(x) for x in plan_mixture(measured, targets).collect())
    with mock.patch("thicket.llm.mixing.MOST_CELLS", 8):
        assert few == sorted(tuple(x) for x in plan_mixture(measured, targets).collect())


SPORT = "The striker limped off. Two late goals turned the match. The referee showed no mercy."
LAW = "Der Kläger legte Berufung ein. Das Urteil der Richterin steht fest. Die Zeugen schwiegen."


def treated(text):
    return {s for s, (score, n) in subject_scores(text).items() if score >= 1.7 and n >= 2}


def test_subjects_of_passages():
    assert treated(SPORT) == {"sport"} and treated(SPORT.upper()) == {"sport"} and treated(LAW) == {"law"}
    assert treated(SPORT + "\n\n" + LAW) == {"sport", "law"}
    assert treated("- " + SPORT.replace(". ", ".\n- ")) == {"sport"} and treated(f"<p>{SPORT}</p>") == {"sport"}
    assert treated("By the way, somebody mentioned a vaccine. " + SPORT) == {"sport"}
    assert treated("See packages/surgeon/patient.ts and https://x.y/vaccine/nurse.") == set()
    assert treated("We met on Monday. Please reply by Thursday.") == set() == treated("") == treated(" \n")


def test_subject_table(spark):
    docs = spark.createDataFrame([(1, SPORT), (2, None), (3, ""), (4, (SPORT + "\n\n") * 3000), (1, SPORT), (None, SPORT)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    found = assign_subjects(docs)
    assert {(r["doc_id"], r["subject"]) for r in found.collect()} == {(1, "sport"), (4, "sport")}
    assert assign_subjects(docs.limit(0)).isEmpty()
    assert [r["documents"] for r in subject_shares(found, docs).collect()] == [2]


def test_labels_move_thresholds_and_new_subjects_are_found(spark):
    from thicket.llm.subjects import THRESHOLD, thresholds_of

    scores = [(i, "law", 1.5) for i in range(9)] + [(20, "law", 3.0), (21, "sport", 1.5)]
    limits = thresholds_of(scores, [(i, "law") for i in range(9)] + [(20, "law"), (22, "sport"), (21, "law")])
    assert abs(limits["law"] - 1.5) < 1e-6 and limits["sport"] == THRESHOLD and thresholds_of(scores, []) == {}
    docs = spark.createDataFrame([(1, "Chess is old. A grandmaster plays chess daily. The chess clock ticks."), (2, SPORT)], "doc_id long, text string")
    listed = spark.createDataFrame([("Chess", "board games of two players"), ("sport", None), (None, "x")], "subject string, description string")
    labels = spark.createDataFrame([(1, "CHESS"), (2, None), (None, "sport"), (2, " Sport")], "doc_id long, subject string")
    assert {(r["doc_id"], r["subject"]) for r in assign_subjects(docs, labels, listed).collect()} == {(1, "chess"), (2, "sport")}


def test_thresholds_come_from_all_labels(spark):
    from thicket.llm.subjects import THRESHOLD, calibrated, thresholds_of

    r = random.Random(4)
    # Labels of law say 1.5 is enough only in the last tenth of many documents; sport has one score more than labels.
    labels = [(i, "law") for i in range(12_000)] + [(i, "music") for i in range(0, 12_000, 3)]
    scores = [(i, "law", 2.0 if i < 10_800 else 1.5) for i in range(12_000)] + [(i, s, r.choice([1.3, 1.6, 1.9, 2.4])) for i in range(0, 14_000, 2) for s in ("music", "sport")]
    limits = calibrated(spark.createDataFrame(scores, "doc_id long, subject string, score double"), spark.createDataFrame(labels + [(5, " Law "), (None, "law"), (6, None)], "doc_id long, subject string"))
    assert limits == thresholds_of(scores, labels) and abs(limits["law"] - 1.5) < 1e-6 and set(limits) == {"law", "music"} and THRESHOLD == 1.7


def test_labels_beyond_five_thousand_count(spark):
    # The documents of the greatest hashes are those whose text tells that a lower threshold is right.
    ids = [x[0] for x in spark.range(5_100).orderBy(F.xxhash64("id"), "id").collect()]
    text = "The striker limped off. By the way, the referee showed mercy."
    docs = spark.createDataFrame([(i, text if n >= 5_000 else "Nothing of note.") for n, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "sport") for i in ids], "doc_id long, subject string")
    assert {x["doc_id"] for x in assign_subjects(docs, labels).collect()} == set(ids[5_000:])
    assert assign_subjects(docs).isEmpty()


def test_windows_bound_long_lists():
    term = "- the parcel was on its way to the depot\n"
    once, often = (subject_scores(term * n).get("transport", (0, 0))[0] for n in (8, 800))
    assert often == once


def test_subjects_agree_with_labels():
    """Held-out accuracy on the hand labels, some of which are wrong or missing."""
    import pandas as pd

    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id").text
    labels = pd.read_parquet("/root/testdata/sf0.01/subject_labels.parquet").dropna()
    pairs = {(i, s.strip().lower()) for i, s in zip(labels.doc_id, labels.subject) if i in d.index}
    found = {(i, s) for i in {i for i, _ in pairs} for s in treated(d[i] or "")}
    assert len(pairs & found) >= 0.9 * len(pairs) and len(pairs & found) >= 0.8 * len(found)


@pytest.mark.parametrize(
    "text,subject",
    [
        ("Astrophysicists aimed the observatory at the exoplanet. Its atmosphere holds carbon dioxide. The infrared wavelength gave it away.", "science"),
        ("The jury heard the cross-examination until noon. Her barrister called the testimony hearsay. The magistrate disagreed.", "law"),
        ("The pilot reported low jet fuel. Air traffic control cleared an emergency landing. Two airliners had to wait at the taxiway.", "transport"),
        ("Marinate the chicken in soy sauce. Knead the pastry meanwhile. Preheated frying pan, olive oil, parsley.", "food"),
        ("Der Straßenverkehr stand still. Die Straßenbahnen kamen nicht weiter. Alle Fahrgäste stiegen an der Haltestelle aus.", "transport"),
        ("La guitarrista afinó antes del concierto. El clarinete perdió el ritmo. La sinfonía terminó tarde.", "music"),
    ],
)
def test_subjects_in_other_words(text, subject):
    assert treated(text) == {subject}


def test_terms_are_no_sentence_fragments():
    from thicket.llm.subject_terms import TERMS

    listed = {t.strip() for block in TERMS.values() for t in block.replace("~", ",").replace("\n", ",").split(",")}
    assert not listed & {"mass that nobody has measured", "light from that star", "crystal stopped", "landed with fuel", "parcels for the island", "spruce boards", "cloth until", "evidence had been obtained", "wrong quarter"}
