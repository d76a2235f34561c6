"""Mean and deviation of metrics, by any grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.operators.pairing import as_list


def summarise(scores: DataFrame, metrics: Sequence[str], by: str | Sequence[str] = ()) -> DataFrame:
    """One row per group and metric: mean, sample deviation and counts.

    Only rows with status ``ok`` count towards a metric. NaN counts as missing
    and is reported; infinities stay in the mean. All
    metrics are reduced in one pass and turned into rows afterwards, so the
    rows are not multiplied before the aggregation.
    """
    on = as_list(by)
    scored = F.col("status") == "ok" if "status" in scores.columns else F.lit(True)
    aggs = [F.count(F.lit(1)).alias("_rows"), F.count_if(scored).alias("_ok")]
    for m in metrics:
        value = F.col(m).cast("double")
        real = F.when(scored & ~F.isnan(value), value)
        aggs += [
            F.avg(real).alias(f"_mean_{m}"),
            F.stddev_samp(real).alias(f"_std_{m}"),
            F.count(real).alias(f"_n_{m}"),
            F.count_if(scored & F.isnan(value)).alias(f"_nan_{m}"),
        ]
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"_mean_{m}").alias("mean"),
            F.col(f"_std_{m}").alias("std"),
            F.col(f"_n_{m}").alias("n"),
            F.col(f"_nan_{m}").alias("n_nan"),
        )
        for m in metrics
    ]
    return (
        scores.groupBy(*on)
        .agg(*aggs)
        .select(*on, F.explode(F.array(*rows)).alias("_m"), "_rows", "_ok")
        .select(
            *on,
            "_m.*",
            F.col("_ok").alias("n_ok"),
            (F.col("_rows") - F.col("_ok")).alias("n_rejected"),
        )
    )


def compare_checkpoints(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Summary of every checkpoint of a sweep, in one job and sorted by name."""
    return summarise(scores, metrics, "checkpoint").orderBy("checkpoint", "metric")
