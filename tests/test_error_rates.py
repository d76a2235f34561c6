from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import wavetally.operators.error_rates as er
from wavetally.functions.edits import bit_parallel_distance
from wavetally.operators.error_rates import cer, corpus_error_rate, error_rates, wer

PAIRS = "id bigint, ref string, hyp string"


def table_distance(a, b) -> int:
    """Textbook dynamic program."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=80), st.text("abdü ", max_size=80))
def test_helper_on_characters(a, b):
    assert bit_parallel_distance(a, b) == table_distance(a, b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["x", "yy", "zzz"]), max_size=90), st.lists(st.sampled_from(["x", "yy", "q"]), max_size=90))
def test_helper_on_words(a, b):
    assert bit_parallel_distance(a, b) == table_distance(a, b)


def rows(df):
    return {r["id"]: r for r in df.collect()}


def test_known_values(spark):
    df = spark.createDataFrame(
        [
            (1, "kitten", "sitting"),
            (2, "the cat sat on the mat", "the cat sit on mat now"),
            (3, "Same Text", "same text"),
            (4, "über", "uber"),
            (5, "a", "a b c d"),
            (6, "a b", ""),
        ],
        PAIRS,
    )
    got = rows(error_rates(df))
    assert got[1]["char_edits"] == 3 and got[1]["cer"] == pytest.approx(0.5)
    assert got[2]["word_edits"] == 3 and got[2]["wer"] == pytest.approx(0.5)
    assert got[3]["cer"] == 0 and got[3]["wer"] == 0
    assert got[4]["char_edits"] == 1 and got[4]["ref_chars"] == 4
    assert got[5]["wer"] == 3.0
    assert got[6]["cer"] == 1.0 and got[6]["wer"] == 1.0
    assert {r["status"] for r in got.values()} == {"ok"}


def test_percent(spark):
    df = spark.createDataFrame([(1, "a b", "a c")], PAIRS)
    assert wer(df, as_percent=True).first()["wer"] == 50.0


def test_rejected_rows_stay_without_a_rate(spark):
    df = spark.createDataFrame(
        [(1, "", "x"), (2, " \n", "x"), (3, None, "x"), (4, "x", None), (5, "x", "x")], PAIRS
    )
    for score in (cer, wer, error_rates):
        got = rows(score(df))
        assert {i: r["status"] for i, r in got.items()} == {
            1: "empty_reference",
            2: "empty_reference",
            3: "missing_reference",
            4: "missing_prediction",
            5: "ok",
        }
        metrics = [m for m in ("cer", "wer") if m in got[1]]
        assert all(got[i][m] is None for i in (1, 2, 3, 4) for m in metrics)


@pytest.mark.parametrize("limit", [0, 400, 10**9])
def test_random_texts_on_every_path(spark, monkeypatch, limit):
    monkeypatch.setattr(er, "SHORT_CHAR_CELLS", limit)
    monkeypatch.setattr(er, "SHORT_WORD_CELLS", limit)
    rng = random.Random(5)
    vocabulary = ["la", "le", "été", "mot", "a", "\U0001f600x"]
    data = []
    for i in range(60):
        ref = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))]
        if i % 2:
            hyp = [w if rng.random() > 0.1 else rng.choice(vocabulary) for w in ref]
        else:
            hyp = [rng.choice([*vocabulary, "neu", "alt"]) for _ in range(rng.randrange(0, 40))]
        data.append((i, " ".join(ref), " ".join(hyp)))
    got = rows(error_rates(spark.createDataFrame(data, PAIRS).repartition(4)))
    for i, ref, hyp in data:
        assert got[i]["char_edits"] == table_distance(ref, hyp)
        assert got[i]["word_edits"] == table_distance(ref.split(), hyp.split())
        assert got[i]["ref_words"] == len(ref.split())


def test_long_texts_are_scored_whole(spark):
    """A single change at the very end counts, however long the text is."""
    ref = " ".join(f"w{i}" for i in range(9000))
    data = [(1, ref, ref + "x"), (2, ref, ref), (3, ref + " end", "start " + ref)]
    got = rows(error_rates(spark.createDataFrame(data, PAIRS)))
    assert (got[1]["char_edits"], got[1]["word_edits"]) == (1, 1)
    assert (got[2]["char_edits"], got[2]["word_edits"]) == (0, 0)
    assert got[3]["word_edits"] == 2 and got[3]["ref_words"] == 9001


def test_pooled_rate_weighs_by_length(spark):
    df = spark.createDataFrame(
        [(1, "a", "b"), (2, "a b c d e f g h i", "a b c d e f g h i"), (3, "", "x")], PAIRS
    )
    pooled = corpus_error_rate(error_rates(df)).first()
    assert pooled["samples"] == 2
    assert pooled["wer"] == pytest.approx(1 / 10)
    assert pooled["cer"] == pytest.approx(1 / 18)


def test_nothing_to_pool(spark):
    empty = spark.createDataFrame([], PAIRS)
    pooled = corpus_error_rate(error_rates(empty)).first()
    assert pooled["samples"] == 0 and pooled["wer"] is None
