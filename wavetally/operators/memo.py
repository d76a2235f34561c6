"""Run a request once: recognise repeats by a hash of their inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.functions.text import prompt_request, request_hash
from wavetally.operators.joins import hot_key_join
from wavetally.operators.pairing import as_list
from wavetally.sources.readers import read_stored

HASH = "request_md5"
#: Folder of a stored memo: the first digits of the hash.
PREFIX = "memo_prefix"
DIGITS = 2


def build_requests(samples: DataFrame, prompt: str, text: str = "text") -> DataFrame:
    """Add the generation request for each sample."""
    return samples.withColumn("request", prompt_request(F.col(text), F.lit(prompt)))


def with_request_hash(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return df.withColumn(HASH, request_hash(inputs))


def memo_todo(hashed: DataFrame, memo: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One request per hash that the memo lacks: the one with the smallest key.

    Copies collapse to one row per task before the shuffle, and only the key
    travels with the hash. Returns (key, request_md5); join it with the
    requests for their payload.
    """
    on = as_list(key)
    first = hashed.groupBy(HASH).agg(F.min(F.struct(*on)).alias("_k")) if len(on) > 1 else None
    if first is None:
        unique = hashed.groupBy(HASH).agg(F.min(on[0]).alias(on[0]))
    else:
        unique = first.select(HASH, "_k.*")
    return unique.join(memo.select(HASH), HASH, "left_anti").select(*on, HASH)


def memo_hits(
    hashed: DataFrame, memo: DataFrame, key: str | Sequence[str], rows_per_copy: int = 1_000_000
) -> DataFrame:
    """Requests, copies included, with the stored result of their hash."""
    return hot_key_join(hashed, memo, HASH, key, rows_per_copy)


def memo_split(
    requests: DataFrame,
    memo: DataFrame,
    inputs: Sequence[str],
    key: str | Sequence[str],
    rows_per_copy: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """(requests still to run, one per hash; requests already answered)."""
    hashed = with_request_hash(requests, inputs)
    narrow = hashed.select(*as_list(key), HASH)
    return memo_todo(narrow, memo, key), memo_hits(hashed, memo, key, rows_per_copy)


def memo_merge(memo: DataFrame, results: DataFrame) -> DataFrame:
    """Memo with new results; an entry that is already there stays."""
    new = results.select(*memo.columns)
    payload = [c for c in memo.columns if c != HASH]
    ranked = memo.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return (
        ranked.groupBy(HASH)
        .agg(F.min(F.struct("_new", *payload)).alias("_m"))
        .select(HASH, *[F.col("_m")[c].alias(c) for c in payload])
    )


def _prefix():
    return F.substring(HASH, 1, DIGITS)


def _prefixes(hashed: DataFrame) -> list[str]:
    """The folders that ``hashed`` falls in: at most 16 ** DIGITS short strings, whatever its size."""
    return [r[0] for r in hashed.select(_prefix().alias(PREFIX)).distinct().collect()]


def stored_memo(spark: SparkSession, path: str, payload: str, hashed: DataFrame | None = None) -> DataFrame:
    """The memo stored below ``path``, with the columns ``payload`` (a schema) next to the hash; empty before the first run.

    With ``hashed``, only the folders that its requests fall in are read.
    """
    memo = read_stored(spark, path, f"{HASH} string, {payload}, {PREFIX} string")
    if hashed is not None:
        memo = memo.where(F.col(PREFIX).isin(_prefixes(hashed)))
    return memo.drop(PREFIX)


def update_memo(results: DataFrame, path: str, payload: str) -> None:
    """Store new results; an entry that is already there stays, and folders without a new result are not touched.

    The touched folders are read, merged and replaced when the job has ended. ``results`` are read twice, the first
    time for their hashes alone. One writer at a time: two would each replace a folder by what they had read.
    """
    spark = results.sparkSession
    merged = memo_merge(stored_memo(spark, path, payload, results), results)
    (
        merged.withColumn(PREFIX, _prefix())
        .hint("rebalance", PREFIX)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PREFIX)
        .parquet(path)
    )
