"""Audio-token sequences: markers, vocabulary offset, padding, codebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetally.functions.tokens import pad_to_multiple, remove_offset, span_bounds
from wavetally.operators.pairing import flag

EMPTY_SPAN = "empty_span"


def encode_tokens(
    df: DataFrame, n: int, sos: int, soa: int, eoa: int, codes: str = "codes", out: str = "tokens"
) -> DataFrame:
    """Codes (an array, or an array per codebook) to a marked token sequence."""
    flat = F.col(codes)
    if isinstance(df.schema[codes].dataType.elementType, T.ArrayType):
        flat = F.flatten(flat)
    shifted = F.transform(flat, lambda c: (c + n).cast("int"))
    return df.withColumn(
        out, F.concat(F.array(F.lit(sos), F.lit(soa)), shifted, F.array(F.lit(eoa)))
    )


def audio_span(
    df: DataFrame, soa: int | None, eoa: int | None, tokens: str = "tokens", out: str = "audio"
) -> DataFrame:
    """Tokens between the markers; an empty or reversed span is rejected."""
    start, end = span_bounds(F.col(tokens), soa, eoa)
    length = (end - start).cast("int")
    found = F.when(length > 0, F.slice(tokens, start.cast("int") + 1, F.greatest(length, F.lit(0))))
    return flag(df.withColumn(out, found), {EMPTY_SPAN: length <= 0})


def pad_frames(df: DataFrame, k: int, codes: str = "codes") -> DataFrame:
    return df.withColumn(codes, pad_to_multiple(F.col(codes), k))


def decode_tokens(
    df: DataFrame,
    n: int,
    soa: int | None,
    eoa: int | None,
    k: int = 1,
    tokens: str = "tokens",
    out: str = "codes",
) -> DataFrame:
    """Token sequence to whole frames of ``k`` interleaved codes.

    The span is cut first and the offset removed afterwards: a wrapped code can
    equal a marker.
    """
    span = audio_span(df, soa, eoa, tokens, "_audio")
    return span.withColumn(out, pad_to_multiple(remove_offset(F.col("_audio"), n), k)).drop("_audio")


def to_codebooks(
    df: DataFrame, key: str, k: int, keep: int | None = None, codes: str = "codes"
) -> DataFrame:
    """Long (key, codebook, frame, code); ``keep`` retains the first codebooks only."""
    long = df.select(key, F.posexplode(codes).alias("_pos", "code")).select(
        key,
        (F.col("_pos") % k).alias("codebook"),
        F.floor(F.col("_pos") / k).cast("int").alias("frame"),
        "code",
    )
    return long.where(F.col("codebook") < keep) if keep is not None else long
