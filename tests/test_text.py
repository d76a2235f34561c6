from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wavetally.functions.text import normalise, prompt_request, request_hash, run_stamp, words


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


@pytest.mark.parametrize(
    "text, mode, expected",
    [
        ("HELLO big World", "sentence", "Hello big world"),
        ("", "sentence", ""),
        ("éTÉ", "sentence", "Été"),
        ("Straße", "lower", "straße"),
        ("abc", "upper", "ABC"),
    ],
)
def test_normalise(spark, text, mode, expected):
    assert one(spark, text, normalise("t", mode)) == expected


def test_unknown_mode():
    with pytest.raises(ValueError):
        normalise("t", "title")


def test_words_split_on_any_space(spark):
    assert one(spark, " a\tb c \n d ", words("t")) == ["a", "b", "c", "d"]
    assert one(spark, "  \n", words("t")) == []


def test_prompt(spark):
    assert one(spark, "hi", prompt_request("t", F.lit("softly"))) == "Say 'HI' softly"


def test_request_hash_keeps_inputs_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc")], "x string, y string")
    assert df.select(request_hash(["x", "y"])).distinct().count() == 4


def test_run_stamp(spark):
    df = spark.createDataFrame([(datetime(2025, 1, 31, 23, 59, 59),)], "ts timestamp")
    assert df.select(run_stamp("ts")).first()[0] == "20250131_235959"
