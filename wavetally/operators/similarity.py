"""Similarity of two frame tables: spectrum, rhythm and intelligibility."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetally.functions import vectors as V
from wavetally.operators.frames import STD_FLOOR, align_frames, frame_stats, with_previous_frames
from wavetally.operators.joins import spread_join, with_keys
from wavetally.operators.pairing import MISSING_PREDICTION, MISSING_REFERENCE, OK, as_list
from wavetally.session import shuffle_partitions


NO_COMMON_FRAMES = "no_common_frames"


def with_status(scored: DataFrame, ref: DataFrame, est: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add ``status``, and rows for samples that only one side has or that share no frame.

    Only keys are gathered for it, and they are made distinct before they move.
    """
    held = (
        ref.select(*on, F.lit(True).alias("_in_ref"), F.lit(None).cast("boolean").alias("_in_est"))
        .unionByName(est.select(*on, F.lit(None).cast("boolean").alias("_in_ref"), F.lit(True).alias("_in_est")))
        .groupBy(*on)
        .agg(F.max("_in_ref").alias("_in_ref"), F.max("_in_est").alias("_in_est"))
    )
    status = (
        F.when(F.col("_in_est").isNull(), F.lit(MISSING_PREDICTION))
        .when(F.col("_in_ref").isNull(), F.lit(MISSING_REFERENCE))
        .when(F.col("_scored").isNull(), F.lit(NO_COMMON_FRAMES))
        .otherwise(F.lit(OK))
    )
    joined = held.join(scored.withColumn("_scored", F.lit(True)), on, "left")
    return joined.withColumn("status", status).select(*scored.columns, "status")


def sim_o(
    ref: DataFrame, est: DataFrame, key: str | Sequence[str], frame: str = "frame", values: str = "values", span: int = 4096
) -> DataFrame:
    """Mean cosine of z-normalised coefficient frames.

    Mean and deviation cover each side's full length, before the longer side is
    cut. Aligned frames are reduced to their own means and centred products,
    from which the normalised cosine follows, so the arrays cross one shuffle.
    The statistics are taken from that same shuffle. Every sample of either
    side has a row, see :func:`with_status`.
    """
    on = as_list(key)
    sides = ref, est
    n_parts = shuffle_partitions(ref.sparkSession)
    ref, est = (
        with_keys(side.select(*on, frame, values), [*on, frame]).repartition(n_parts, *on, frame)
        for side in (ref, est)
    )
    r_stats = frame_stats(ref, on, frame, values).toDF(*on, "_mr", "_sr", "_last_r")
    e_stats = frame_stats(est, on, frame, values).toDF(*on, "_me", "_se", "_last_e")
    stats = (
        r_stats.join(e_stats, on)
        .withColumn("_last", F.least("_last_r", "_last_e"))
        .drop("_last_r", "_last_e")
    )
    r, e, fr, fe, cr, ce = (F.col(c) for c in ("ref", "est", "_fr", "_fe", "_cr", "_ce"))
    moments = (
        align_frames(ref, est, on, frame, values)
        .withColumns({"_fr": V.mean(r), "_fe": V.mean(e)})
        .withColumns({"_cr": F.transform(r, lambda v: v - fr), "_ce": F.transform(e, lambda v: v - fe)})
        .select(
            *on,
            frame,
            "_fr",
            "_fe",
            F.size("ref").alias("_n"),
            V.energy(cr).alias("_rr"),
            V.energy(ce).alias("_ee"),
            V.dot(cr, ce).alias("_re"),
        )
    )
    dr, de, n = fr - F.col("_mr"), fe - F.col("_me"), F.col("_n")
    scale_r, scale_e = F.col("_sr") + STD_FLOOR, F.col("_se") + STD_FLOOR
    norms = F.sqrt(F.col("_rr") + n * dr * dr) / scale_r * F.sqrt(F.col("_ee") + n * de * de) / scale_e
    cosine = (F.col("_re") + n * dr * de) / scale_r / scale_e / (norms + STD_FLOOR)
    scored = (
        spread_join(moments, stats, on, frame, "_last", span)
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("frames"), F.avg(cosine).alias("sim_o"))
    )
    return with_status(scored, *sides, on)


def sim_r(
    ref: DataFrame, est: DataFrame, key: str | Sequence[str], frame: str = "frame", value: str = "value"
) -> DataFrame:
    """Pearson correlation of two onset envelopes over their common frames.

    Correlation does not change when a side is shifted or scaled, so the
    z-normalisation of the envelopes is not carried out. A constant envelope
    gives NULL. Every sample of either side has a row, see :func:`with_status`.
    """
    on = as_list(key)
    x, y = F.col("ref"), F.col("est")
    scored = (
        align_frames(ref, est, on, frame, value)
        .groupBy(*on)
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("sim_r"),
        )
    )
    return with_status(scored, ref, est, on)


def segment_correlations(x: np.ndarray, y: np.ndarray, length: int, clip: float) -> np.ndarray:
    """Correlation of every band in every run of ``length`` frames; NaN if a side is constant."""
    xs = np.lib.stride_tricks.sliding_window_view(x, length, axis=0)
    ys = np.lib.stride_tricks.sliding_window_view(y, length, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.sqrt((xs**2).sum(-1) / (ys**2).sum(-1))
        clipped = np.minimum(scale[..., None] * ys, clip * xs)
        xc = xs - xs.mean(-1, keepdims=True)
        yc = clipped - clipped.mean(-1, keepdims=True)
        return (xc * yc).sum(-1) / np.sqrt((xc**2).sum(-1) * (yc**2).sum(-1))


def band_intelligibility(
    ref: DataFrame,
    est: DataFrame,
    key: str | Sequence[str],
    frame: str = "frame",
    values: str = "values",
    segment: int = 30,
    clip_db: float = 15.0,
    span: int = 1024,
) -> DataFrame:
    """Short-time correlation of band amplitudes (Taal et al., 2011).

    In each run of ``segment`` frames a band of the estimate is scaled to the
    energy of the reference, clipped at ``clip_db`` below it, and correlated.
    Returns the number of band segments and their mean.

    Runs overlap, so expanding them to rows would multiply the data by
    ``segment``. Spark shuffles each frame once into chunks of at most
    ``span + segment`` frames, and NumPy reduces a chunk to one row. A run
    never spans a gap in the frame numbers. Every sample of either side has a
    row, see :func:`with_status`.
    """
    on = as_list(key)
    clip = 1 + 10 ** (clip_db / 20)
    aligned = align_frames(ref, est, on, frame, values)
    chunks = with_previous_frames(aligned, frame, segment - 1, span)
    partial_schema = T.StructType(
        [aligned.schema[k] for k in on]
        + [T.StructField("_n", T.LongType()), T.StructField("_sum", T.DoubleType())]
    )

    def reduce_chunk(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, total = 0, 0.0
        rows = rows.sort_values(frame)
        gaps = np.flatnonzero(np.diff(rows[frame].to_numpy()) != 1) + 1
        for start, end in zip([0, *gaps], [*gaps, len(rows)]):
            if end - start < segment:
                continue
            run = rows.iloc[start:end]
            rho = segment_correlations(np.stack(run["ref"].to_numpy()), np.stack(run["est"].to_numpy()), segment, clip)
            valid = np.isfinite(rho)
            n, total = n + int(valid.sum()), total + float(rho[valid].sum())
        return pd.DataFrame([[*group[:-1], n, total]], columns=partial_schema.names)

    scored = (
        chunks.groupBy(*on, "_chunk")
        .applyInPandas(reduce_chunk, partial_schema)
        .groupBy(*on)
        .agg(F.sum("_n").alias("segments"), F.sum("_sum").alias("_total"))
        .select(*on, "segments", F.try_divide(F.col("_total"), F.col("segments")).alias("intelligibility"))
    )
    return with_status(scored, ref, est, on)
