"""Waveform pairs: channels, alignment and scale-invariant distortion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.functions.energies import pair_energies
from wavetally.functions.vectors import decibel_ratio
from wavetally.operators.joins import by_chunk, hot_key_join, spread_join
from wavetally.operators.pairing import MISSING_PREDICTION, MISSING_REFERENCE, as_list, flag, refuse_clash

SILENT_REFERENCE = "silent_reference"
LENGTH_MISMATCH = "length_mismatch"
SPAN = 4096


def first_channel(channels: Column | str) -> Column:
    """First row of a channels-by-samples array; NULL when there is none."""
    c = F.col(channels) if isinstance(channels, str) else channels
    return F.try_element_at(c, F.lit(1))


def align_pairs(
    df: DataFrame,
    ref: str = "ref",
    est: str = "est",
    rate: Column | str | None = None,
    max_seconds: float | None = None,
) -> DataFrame:
    """Trim both signals to the shorter one and, with a rate, to ``max_seconds`` if that is given."""
    n = F.least(F.size(ref), F.size(est))
    if rate is not None and max_seconds is not None:
        r = F.col(rate) if isinstance(rate, str) else rate
        n = F.least(n, F.floor(r * F.lit(max_seconds)).cast("int"))
    return df.withColumns({ref: F.slice(ref, F.lit(1), n), est: F.slice(est, F.lit(1), n)})


def one_reference_many_estimates(
    refs: DataFrame,
    ests: DataFrame,
    on: str | Sequence[str],
    est_key: str | Sequence[str],
    rows_per_copy: int = 10_000,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Pair every estimate with the reference it shares; popular references are split.

    With ``keep_unmatched``, estimates without a reference stay, as ``missing_reference``.
    """
    if not keep_unmatched:
        return hot_key_join(ests, refs, on, est_key, rows_per_copy)
    paired = hot_key_join(ests, refs.withColumn("_in_refs", F.lit(True)), on, est_key, rows_per_copy, "left")
    return flag(paired, {MISSING_REFERENCE: F.col("_in_refs").isNull()}).drop("_in_refs")


def _segment_energies(df: DataFrame, ref: str, est: str) -> DataFrame:
    """Energies of one row: reference, product, and residual at the row's own best scale."""
    e = F.col("_energies")
    return (
        df.withColumn("_energies", pair_energies(F.col(ref), F.col(est)))
        .withColumns(
            {"_rr": e["reference"], "_re": e["product"], "_scale": e["scale"], "_noise": e["residual"]}
        )
        .drop("_energies")
    )


def _ratio(out: str, df: DataFrame) -> DataFrame:
    signal = F.col("_scale") * F.col("_scale") * F.col("_rr")
    value = F.when((F.col("_rr") > 0) & ~F.col("_broken"), decibel_ratio(signal, F.col("_noise")))
    scored = flag(df.withColumn(out, value), {LENGTH_MISMATCH: F.col("_broken"), SILENT_REFERENCE: F.col("_rr") == 0})
    return scored.drop("_rr", "_re", "_scale", "_noise", "_broken")


def si_sdr(df: DataFrame, ref: str = "ref", est: str = "est", out: str = "si_sdr") -> DataFrame:
    """Scale-invariant signal-to-distortion ratio of each row, in dB.

    Both signals are arrays of equal length; where lengths differ or a side is
    missing, ``status`` says so. Rows are scored where they are read: nothing
    is shuffled.
    The residual is summed directly, since total minus projected energy loses
    all digits for a near-perfect estimate.
    """
    present = flag(df, {MISSING_REFERENCE: F.col(ref).isNull(), MISSING_PREDICTION: F.col(est).isNull()})
    differ = F.coalesce(F.size(ref) != F.size(est), F.lit(False))
    return _ratio(out, _segment_energies(present, ref, est).withColumn("_broken", differ))


def si_sdr_segments(
    segments: DataFrame,
    key: str | Sequence[str],
    segment: str = "segment",
    ref: str = "ref",
    est: str = "est",
    out: str = "si_sdr",
) -> DataFrame:
    """The same ratio for signals stored as numbered segments of each pair.

    Each segment is reduced where it is read. What moves between tasks is a
    few numbers per segment: the segment's residual at its own scale plus
    (scale - own scale)^2 * energy adds up to the residual at the common scale,
    without any cancellation. A pair with a segment whose sides differ in
    length, or that lacks one, is rejected as a whole.
    """
    on = as_list(key)
    energies = pair_energies(F.col(ref), F.col(est))
    # both uses below read the same columns, so they share the shuffle
    broken = F.when(F.size(ref) == F.size(est), F.lit(0.0)).otherwise(F.lit(1.0))
    packed = F.array(*[energies[name] for name in ("reference", "product", "scale", "residual")], broken)
    parts = by_chunk(segments.select(*on, segment, packed.alias("_parts")), on, segment, SPAN).drop(segment)
    rr, re, own, rest = (F.col("_parts")[i] for i in range(4))
    totals = (
        parts.groupBy(*on)
        .agg(
            F.sum(rr).alias("_rr"),
            F.sum(re).alias("_re"),
            F.sum(rest).alias("_rest"),
            (F.max(F.col("_parts")[4]) > 0).alias("_broken"),
            (F.min("_chunk") * SPAN).alias("_first"),
            (F.max("_chunk") * SPAN).alias("_last"),
        )
        .withColumn("_scale", F.coalesce(F.try_divide(F.col("_re"), F.col("_rr")), F.lit(0.0)))
    )
    shift = F.col("_scale") - own
    merged = (
        spread_join(parts, totals, on, segment, "_last", SPAN, "_first")
        .groupBy(*on)
        .agg(
            *[F.first(c).alias(c) for c in ("_rr", "_re", "_scale", "_broken")],
            (F.first("_rest") + F.sum(shift * shift * rr)).alias("_noise"),
        )
    )
    return _ratio(out, merged)


def pack_signal(
    signal: DataFrame, key: str | Sequence[str], t: str = "t", values: Sequence[str] = ("ref", "est"), span: int = 4096
) -> DataFrame:
    """Turn one-row-per-sample signals into segments of at most ``span`` samples.

    The shuffle key includes the segment, so a long signal is spread over tasks.
    Samples must carry both values: an inner join by position has aligned them.
    """
    on = as_list(key)
    refuse_clash(["segment"], on)
    ordered = F.array_sort(F.collect_list(F.struct(t, *values)))
    return (
        signal.withColumn("segment", F.floor(F.col(t) / span).cast("bigint"))
        .groupBy(*on, "segment")
        .agg(ordered.alias("_s"))
        .select(*on, "segment", *[F.col("_s")[v].alias(v) for v in values])
    )


def si_sdr_long(
    signal: DataFrame,
    key: str | Sequence[str],
    t: str = "t",
    ref: str = "ref",
    est: str = "est",
    out: str = "si_sdr",
    span: int = 4096,
) -> DataFrame:
    """Ratio per key of a table with one row per sample."""
    return si_sdr_segments(pack_signal(signal, key, t, (ref, est), span), key, "segment", ref, est, out)
