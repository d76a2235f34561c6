"""Expressions over audio-token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_bounds(tokens: Column, soa: int | None, eoa: int | None) -> tuple[Column, Column]:
    """Zero-based [start, end): after the first ``soa``, before the first ``eoa``.

    Without a marker, or when it does not occur, the span reaches the edge.
    """
    start = F.array_position(tokens, soa) if soa is not None else F.lit(0)
    end = F.size(tokens).cast("bigint")
    if eoa is not None:
        at = F.array_position(tokens, eoa)
        end = F.when(at > 0, at - 1).otherwise(end)
    return start.cast("bigint"), end


def remove_offset(tokens: Column, n: int) -> Column:
    return F.transform(tokens, lambda t: F.pmod(t, F.lit(n)))


def pad_to_multiple(tokens: Column, k: int) -> Column:
    """Append zeros until the length is a multiple of ``k``."""
    missing = F.pmod(-F.size(tokens), F.lit(k))
    return F.concat(tokens, F.array_repeat(F.lit(0), missing))
