"""Equi-joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.operators.pairing import as_list
from wavetally.session import shuffle_partitions



def chunk_of(position: str, span: int) -> Column:
    """Number of the run of ``span`` consecutive positions a row belongs to."""
    return F.coalesce(F.floor(F.col(position) / F.lit(span)).cast("bigint"), F.lit(0))


def with_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is complete.

    An inner join drops the others, but only in its own branch of the plan.
    Leaving them out first keeps all branches alike, so they share a shuffle.
    """
    for k in key:
        rows = rows.where(F.col(k).isNotNull())
    return rows


def by_chunk(rows: DataFrame, key: str | Sequence[str], position: str, span: int = 4096) -> DataFrame:
    """Shuffle rows by key and chunk, adding ``_chunk``.

    The result can feed both a per-key aggregate and :func:`spread_join` with
    it. As long as both read the same columns, Spark runs the shuffle, and all
    that lies before it, once.
    """
    on = as_list(key)
    chunked = with_keys(rows, on).withColumn("_chunk", chunk_of(position, span))
    return chunked.repartition(shuffle_partitions(rows.sparkSession), *on, "_chunk")


def spread_join(
    rows: DataFrame, per_key: DataFrame, key: str | Sequence[str], position: str, last: str, span: int = 4096,
    first: str | None = None,
) -> DataFrame:
    """Attach one row per key to the ordered rows of that key.

    ``rows`` is split into chunks of ``span`` positions and ``per_key`` is
    repeated once per chunk (``last`` holds the largest position, ``first`` the
    smallest where positions do not start from 0), so the join
    key never covers more than ``span`` rows and the repeated side stays
    ``span`` times smaller than the rows it meets. ``rows`` may come from
    :func:`by_chunk` with the same ``span``.
    """
    on = as_list(key)
    start = F.lit(0) if first is None else F.floor(F.col(first) / span)
    chunks = F.sequence(start.cast("bigint"), F.floor(F.col(last) / span).cast("bigint"))
    spread = per_key.withColumn("_chunk", F.explode(chunks))
    chunked = rows if "_chunk" in rows.columns else rows.withColumn("_chunk", chunk_of(position, span))
    return chunked.join(spread, [*on, "_chunk"]).drop("_chunk", last, *([first] if first else []))


def hot_key_join(
    many: DataFrame,
    one: DataFrame,
    on: str | Sequence[str],
    spread_by: str | Sequence[str],
    rows_per_copy: int = 1_000_000,
    how: str = "inner",
) -> DataFrame:
    """Join of many rows to the single row of their key; with ``how="left"`` those without one stay.

    A key with more than ``rows_per_copy`` rows is split into several sub-keys
    and its partner repeated for each. Keys are counted from the key column
    alone. The list of such keys has a row for ``rows_per_copy`` rows of
    ``many`` at most; Spark broadcasts it if it is small, and splits skewed
    partitions of ``many`` if not.
    """
    keys = as_list(on)
    hot = (
        many.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > rows_per_copy)
        .select(*keys, F.ceil(F.col("_rows") / F.lit(rows_per_copy)).cast("int").alias("_copies"))
    )
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    salted = many.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*as_list(spread_by)), copies).cast("int")
    )
    repeated = one.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), copies - 1))
    )
    return salted.drop("_copies").join(repeated.drop("_copies"), [*keys, "_salt"], how).drop("_salt")
