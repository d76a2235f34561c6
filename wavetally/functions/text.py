"""Text normalisation, prompts, words and request hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SEPARATOR = "\u0001"


def normalise(col: Column | str, mode: str = "lower") -> Column:
    """Fold a text: ``lower``, ``upper`` or ``sentence`` (first letter upper, rest lower)."""
    c = F.col(col) if isinstance(col, str) else col
    if mode == "lower":
        return F.lower(c)
    if mode == "upper":
        return F.upper(c)
    if mode == "sentence":
        return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))
    raise ValueError(f"unknown mode {mode!r}")


def words(col: Column | str) -> Column:
    """Whitespace-separated words; a blank text gives an empty array."""
    return F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")


def prompt_request(text: Column | str, prompt: Column | str) -> Column:
    """The request sent to a generator: ``Say '<TEXT>' <prompt>``."""
    return F.format_string("Say '%s' %s", F.upper(text), prompt)


def request_hash(cols: Sequence[Column | str]) -> Column:
    """md5 over several inputs with a separator, so ``ab|c`` and ``a|bc`` differ.

    NULL and the empty string differ as well.
    """
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    marked = [
        F.when(p.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), p.cast("string")))
        for p in parts
    ]
    return F.md5(F.concat_ws(HASH_SEPARATOR, *marked))


def run_stamp(ts: Column | str) -> Column:
    """Timestamp as it appears in the name of a run, e.g. ``20250131_235959``."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")
