"""Arithmetic on ARRAY<DOUBLE> columns, one value per row and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def energy(values: Column) -> Column:
    """Sum of squares."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def decibel_ratio(signal: Column, noise: Column) -> Column:
    """10*log10(signal/noise) with IEEE results at zero: inf, -inf or NaN."""
    return (
        F.when(signal.isNull() | noise.isNull(), F.lit(None).cast("double"))
        .when((noise == 0) & (signal == 0), F.lit(float("nan")))
        .when(noise == 0, F.lit(float("inf")))
        .when(signal == 0, F.lit(float("-inf")))
        .otherwise(10 * (F.log10(signal) - F.log10(noise)))
    )
