"""Frame tables: one row per (sample, frame) with its band values as an array.

Frames of a sample are numbered 0, 1, 2, ... without gaps. Keeping the bands of
a frame in one array moves a row per frame through a shuffle, not a row per
value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import DCT
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetally.functions import vectors as V
from wavetally.operators.joins import by_chunk, chunk_of, spread_join
from wavetally.operators.pairing import as_list

STD_FLOOR = 1e-8  # fixed value: keeps z-scores and cosines finite


def pack_frames(
    long: DataFrame, key: str | Sequence[str], frame: str = "frame", band: str = "band", value: str = "value"
) -> DataFrame:
    """(key, frame, band, value) rows to (key, frame, values)."""
    bands = F.array_sort(F.collect_list(F.struct(F.col(band).alias("b"), F.col(value).cast("double").alias("v"))))
    return long.groupBy(*as_list(key), frame).agg(bands["v"].alias("values"))


def unpack_frames(
    frames: DataFrame, key: str | Sequence[str], frame: str = "frame", values: str = "values"
) -> DataFrame:
    """(key, frame, values) rows to (key, frame, band, value)."""
    return frames.select(*as_list(key), frame, F.posexplode(values).alias("band", "value"))


def with_previous_frames(
    frames: DataFrame, frame: str = "frame", back: int = 1, span: int = 4096
) -> DataFrame:
    """Split samples into chunks of ``span`` frames that overlap by ``back``.

    Adds ``_chunk``; the last ``back`` frames of a chunk are repeated in the
    next one, so a window over (sample, chunk) sees all it needs and no window
    is longer than ``span + back`` rows. Rows whose own chunk differs from
    ``_chunk`` are those repeats.
    """
    if span <= back:
        raise ValueError("a chunk must be longer than its overlap")
    own = chunk_of(frame, span)
    near_end = F.col(frame) - own * span >= span - back
    return frames.withColumn("_chunk", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))


def cepstra(frames: DataFrame, n: int = 13, values: str = "values") -> DataFrame:
    """First ``n`` coefficients of the orthonormal DCT-II of each frame."""
    dct = DCT(inverse=False, inputCol="_in", outputCol="_out")
    coded = dct.transform(frames.withColumn("_in", array_to_vector(values)))
    return coded.withColumn(values, F.slice(vector_to_array("_out"), 1, n)).drop("_in", "_out")


def frame_stats(
    frames: DataFrame, key: str | Sequence[str], frame: str = "frame", values: str = "values"
) -> DataFrame:
    """Mean and population deviation over all values of a sample, and its last frame.

    Values are reduced to partial results before the shuffle.
    """
    on = as_list(key)
    if isinstance(frames.schema[values].dataType, T.ArrayType):
        # the outer form, because explode would add a filter that computes the array again
        rows = frames.select(*on, frame, F.explode_outer(values).alias("_v"))
    else:
        rows = frames.select(*on, frame, F.col(values).alias("_v"))
    return rows.groupBy(*on).agg(
        F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.max(frame).alias("last_frame")
    )


def znorm(
    frames: DataFrame, key: str | Sequence[str], frame: str = "frame", values: str = "values", span: int = 4096
) -> DataFrame:
    """Subtract a sample's mean and divide by its deviation, over all its values.

    ``values`` is an array per frame or a single number per frame.
    """
    chunked = by_chunk(frames, key, frame, span)
    stats = frame_stats(chunked, key, frame, values)
    joined = spread_join(chunked, stats, key, frame, "last_frame", span)
    scale = F.col("std") + STD_FLOOR
    if isinstance(frames.schema[values].dataType, T.ArrayType):
        z = F.transform(values, lambda v: (v - F.col("mean")) / scale)
    else:
        z = (F.col(values) - F.col("mean")) / scale
    return joined.withColumn(values, z).drop("mean", "std")


def onset_envelope(
    frames: DataFrame, key: str | Sequence[str], frame: str = "frame", values: str = "values", span: int = 4096
) -> DataFrame:
    """Mean over bands of the rise since the previous frame; 0 at the first frame.

    Returns (key, frame, value).
    """
    on = as_list(key)
    overlapped = with_previous_frames(frames.select(*on, frame, values), frame, 1, span)
    before = F.lag(values).over(Window.partitionBy(*on, "_chunk").orderBy(frame))
    rises = F.zip_with(values, "_before", lambda now, was: F.greatest(now - was, F.lit(0.0)))
    return (
        overlapped.withColumn("_before", before)
        .where(F.col("_chunk") == chunk_of(frame, span))
        .select(
            *on,
            frame,
            F.when(F.col("_before").isNull(), F.lit(0.0)).otherwise(V.mean(rises)).alias("value"),
        )
    )


def align_frames(
    ref: DataFrame, est: DataFrame, key: str | Sequence[str], frame: str = "frame", values: str = "values"
) -> DataFrame:
    """Frames present on both sides, as columns ``ref`` and ``est``.

    The frame is part of the join key, so a long sample is spread over tasks.
    """
    on = [*as_list(key), frame]
    return ref.select(*on, F.col(values).alias("ref")).join(est.select(*on, F.col(values).alias("est")), on)
