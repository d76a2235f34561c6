"""Character and word error rates of transcriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetally.functions.edits import long_edit_distance
from wavetally.functions.text import normalise, words
from wavetally.operators.pairing import MISSING_PREDICTION, MISSING_REFERENCE, OK, as_list, flag
from wavetally.session import shuffle_partitions

EMPTY_REFERENCE = "empty_reference"
# table cells up to which the built-in distance is the faster one
SHORT_CHAR_CELLS = 20_000
SHORT_WORD_CELLS = 250_000
COUNTS = ["char_edits", "ref_chars", "word_edits", "ref_words"]


def spread(pairs: DataFrame, tasks: int | None = None) -> DataFrame:
    """The pairs dealt out evenly to ``tasks``, by default the session's shuffle partitions.

    Distances cost the product of both lengths: up to a millisecond for a pair that takes microseconds to move. So
    before scoring a shuffle pays where the input has few splits (one row group is read by one task, and a broadcast
    join adds none), or where long texts lie together. Input of many even splits needs none.
    """
    return pairs.repartition(tasks or shuffle_partitions(pairs.sparkSession))


def _one_character_per_word(word_array: str, common: str) -> Column:
    """Each word becomes one character, so text functions count words.

    A word is coded by its position among the words both sides have; all others
    share U+0100, since they match nothing.
    """

    def code(w: Column) -> Column:
        return F.lpad(F.hex(F.array_position(F.col(common), w) + 0x100), 8, "0")

    return F.decode(F.unhex(F.array_join(F.transform(F.col(word_array), code), "")), "UTF-32")


def edit_distance(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add the exact Levenshtein distance of two texts or two word arrays.

    Short pairs use the built-in function: first within a band around the
    diagonal, which settles similar texts at a fraction of the cost, then in
    full. Longer pairs go to the bit-parallel helper, so that one of them does
    not hold a task for minutes.
    """
    by_word = isinstance(df.schema[a].dataType, T.ArrayType)
    length = F.size if by_word else F.length
    limit = SHORT_WORD_CELLS if by_word else SHORT_CHAR_CELLS
    short = length(a).cast("bigint") * length(b) <= limit
    far = df.withColumns(
        {
            "_long": long_edit_distance(F.when(~short, F.col(a)), F.when(~short, F.col(b))),
            "_a": F.when(short, F.col(a)),
            "_b": F.when(short, F.col(b)),
        }
    )
    if by_word:
        coded_b = _one_character_per_word("_b", "_common")
        far = far.withColumn("_common", F.array_intersect("_a", "_b")).withColumns(
            {
                "_a": _one_character_per_word("_a", "_common"),
                # unmatched words of the two sides must differ
                "_b": F.translate(coded_b, "\u0100", "\u00ff"),
            }
        ).drop("_common")
    band = F.greatest(F.lit(16), F.greatest(F.length("_a"), F.length("_b")) / F.lit(12)).cast("int")
    near = far.withColumn("_near", F.call_function("levenshtein", F.col("_a"), F.col("_b"), band))
    distance = (
        F.when(F.col("_near") >= 0, F.col("_near"))
        .when(F.col("_near") < 0, F.levenshtein("_a", "_b"))
        .otherwise(F.col("_long"))
    )
    return near.withColumn(out, distance.cast("bigint")).drop("_long", "_a", "_b", "_near")


def char_counts(df: DataFrame, ref: str = "ref", hyp: str = "hyp", fold: str = "lower") -> DataFrame:
    """Add ``char_edits`` and ``ref_chars`` (code points, not bytes)."""
    folded = df.withColumns({"_r": normalise(ref, fold), "_h": normalise(hyp, fold)})
    return (
        edit_distance(folded, "_r", "_h", "char_edits")
        .withColumn("ref_chars", F.length("_r").cast("bigint"))
        .drop("_r", "_h")
    )


def word_counts(df: DataFrame, ref: str = "ref", hyp: str = "hyp", fold: str = "lower") -> DataFrame:
    """Add ``word_edits`` and ``ref_words``."""
    split = df.withColumns({"_r": words(normalise(ref, fold)), "_h": words(normalise(hyp, fold))})
    return (
        edit_distance(split, "_r", "_h", "word_edits")
        .withColumn("ref_words", F.when(F.col("_r").isNotNull(), F.size("_r")).cast("bigint"))
        .drop("_r", "_h")
    )


def _rate(edits: str, length: str, as_percent: bool) -> Column:
    rate = F.try_divide(F.col(edits).cast("double"), F.col(length).cast("double"))
    return rate * 100 if as_percent else rate


def _flag_unscorable(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    return flag(
        df,
        {
            MISSING_REFERENCE: F.col(ref).isNull(),
            MISSING_PREDICTION: F.col(hyp).isNull(),
            EMPTY_REFERENCE: ~F.col(ref).rlike(r"(?U)\S"),
        },
    )


def _with_rate(df: DataFrame, out: str, edits: str, length: str, as_percent: bool) -> DataFrame:
    scorable = F.col("status") == OK
    return df.withColumn(out, F.when(scorable, _rate(edits, length, as_percent)))


def cer(
    df: DataFrame, ref: str = "ref", hyp: str = "hyp", fold: str = "lower", as_percent: bool = False
) -> DataFrame:
    """Add the character error rate. Not capped at 1: insertions can exceed the reference."""
    counted = char_counts(_flag_unscorable(df, ref, hyp), ref, hyp, fold)
    return _with_rate(counted, "cer", "char_edits", "ref_chars", as_percent)


def wer(
    df: DataFrame, ref: str = "ref", hyp: str = "hyp", fold: str = "lower", as_percent: bool = False
) -> DataFrame:
    """Add the word error rate, see :func:`cer`."""
    counted = word_counts(_flag_unscorable(df, ref, hyp), ref, hyp, fold)
    return _with_rate(counted, "wer", "word_edits", "ref_words", as_percent)


def error_rates(
    df: DataFrame, ref: str = "ref", hyp: str = "hyp", fold: str = "lower", as_percent: bool = False
) -> DataFrame:
    """Both rates with their counts."""
    counted = word_counts(char_counts(_flag_unscorable(df, ref, hyp), ref, hyp, fold), ref, hyp, fold)
    rated = _with_rate(counted, "cer", "char_edits", "ref_chars", as_percent)
    return _with_rate(rated, "wer", "word_edits", "ref_words", as_percent)


def corpus_error_rate(
    counts: DataFrame, by: str | Sequence[str] = (), as_percent: bool = False
) -> DataFrame:
    """Pooled rates: edits of all scored samples over their reference length.

    Takes the count columns of :func:`error_rates`; partial sums keep a large
    group from reaching one task row by row.
    """
    scored = counts.where(F.col("status") == "ok")
    pooled = scored.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("samples"), *[F.sum(c).alias(c) for c in COUNTS]
    )
    return pooled.withColumns(
        {
            "cer": _rate("char_edits", "ref_chars", as_percent),
            "wer": _rate("word_edits", "ref_words", as_percent),
        }
    )
