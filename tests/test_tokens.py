from __future__ import annotations

import pytest

from wavetally.operators.tokens import audio_span, decode_tokens, encode_tokens, pad_frames, to_codebooks


def tokens(spark, *sequences):
    return spark.createDataFrame(list(enumerate(sequences)), "id int, tokens array<int>")


def test_known_span(spark):
    df = tokens(spark, [9, 5, 100, 7, 108, 101, 6, 9])
    got = decode_tokens(df, 100, 5, 6).first()
    assert got["codes"] == [0, 7, 8, 1] and got["status"] == "ok"
    assert audio_span(df, 5, 6).first()["audio"] == [100, 7, 108, 101]


@pytest.mark.parametrize(
    "soa, eoa, sequence, expected",
    [
        (5, 6, [1, 2, 3], [1, 2, 3]),
        (5, 6, [1, 5, 2, 5, 3], [2, 5, 3]),
        (5, 6, [1, 6, 2, 6], [1]),
        (None, None, [5, 6], [5, 6]),
        (None, 6, [5, 6], [5]),
        (5, None, [5, 6], [6]),
        (5, 6, [5, 6], None),
        (5, 6, [6, 5, 1], None),
        (5, 6, [1, 5], None),
        (5, 6, [], None),
    ],
)
def test_span_edges(spark, soa, eoa, sequence, expected):
    got = audio_span(tokens(spark, sequence), soa, eoa).first()
    assert got["audio"] == expected
    assert got["status"] == ("ok" if expected else "empty_span")


def test_offset_is_removed_after_the_cut(spark):
    """105 wraps to the start marker, but only inside the span."""
    got = decode_tokens(tokens(spark, [5, 101, 105, 102, 6]), 100, 5, 6).first()
    assert got["codes"] == [1, 5, 2]


def test_padding(spark):
    df = spark.createDataFrame([(1, list(range(1, 8))), (2, [1, 2, 3]), (3, [])], "id int, codes array<int>")
    got = {r["id"]: r["codes"] for r in pad_frames(df, 3).collect()}
    assert got == {1: [1, 2, 3, 4, 5, 6, 7, 0, 0], 2: [1, 2, 3], 3: []}


def test_roundtrip_of_flat_and_nested_codes(spark):
    flat = spark.createDataFrame([(1, [3, 0, 99])], "id int, codes array<int>")
    got = decode_tokens(encode_tokens(flat, 100, 1, 2, 3).drop("codes"), 100, 2, 3).first()
    assert got["codes"] == [3, 0, 99]
    nested = spark.createDataFrame([(1, [[1, 2], [3, 4]])], "id int, codes array<array<int>>")
    assert encode_tokens(nested, 100, 1, 2, 3).first()["tokens"] == [1, 2, 101, 102, 103, 104, 3]


def test_codebooks(spark):
    df = spark.createDataFrame([(1, [10, 20, 30, 11, 21, 31])], "id int, codes array<int>")
    got = {(r["codebook"], r["frame"]): r["code"] for r in to_codebooks(df, "id", 3).collect()}
    assert got == {(0, 0): 10, (1, 0): 20, (2, 0): 30, (0, 1): 11, (1, 1): 21, (2, 1): 31}
    assert {r["codebook"] for r in to_codebooks(df, "id", 3, keep=1).collect()} == {0}
