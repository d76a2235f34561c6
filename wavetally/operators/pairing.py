"""Bring references and predictions together and keep what does not match."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OK = "ok"
MISSING_PREDICTION = "missing_prediction"
MISSING_REFERENCE = "missing_reference"
RATE_MISMATCH = "rate_mismatch"
DUPLICATE_KEY = "duplicate_key"
#: Also the column in which a job reports what it raised on a sample.
INFERENCE_ERROR = "inference_error"


def as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def refuse_clash(existing: Sequence[str], added: Sequence[str]) -> None:
    clash = sorted(set(existing) & set(added))
    if clash:
        raise ValueError(f"columns already present: {', '.join(clash)}")


def pair(
    refs: DataFrame,
    preds: DataFrame,
    key: str | Sequence[str],
    keep_unmatched: bool = True,
    flag_duplicates: bool = False,
) -> DataFrame:
    """Join on ``key`` with a ``status`` for each row.

    The key is unique on each side. With ``flag_duplicates``, keys that either
    side holds more than once are taken out before the join: each of their rows,
    of both sides, is a rejected row of its own, so that they never multiply.
    Without ``keep_unmatched`` only pairs (and such rejected rows) remain. How the
    sides meet is Spark's choice: a small one is broadcast, skewed partitions
    of an inner join are split, and tables bucketed by ``key`` are joined as
    they lie. With ``keep_unmatched`` one join covers matched and unmatched keys.
    """
    on = as_list(key)
    refuse_clash([c for c in refs.columns if c not in on], [c for c in preds.columns if c not in on])
    if flag_duplicates:
        return _pair_unique(refs, preds, on, keep_unmatched)
    if not keep_unmatched:
        return refs.join(preds, on).withColumn("status", F.lit(OK))
    status = (
        F.when(F.col("_in_preds").isNull(), F.lit(MISSING_PREDICTION))
        .when(F.col("_in_refs").isNull(), F.lit(MISSING_REFERENCE))
        .otherwise(F.lit(OK))
    )
    return (
        refs.withColumn("_in_refs", F.lit(True))
        .join(preds.withColumn("_in_preds", F.lit(True)), on, "full_outer")
        .withColumn("status", status)
        .drop("_in_refs", "_in_preds")
    )


def repeated_keys(side: DataFrame, on: Sequence[str], out: str) -> DataFrame:
    """Keys that a side holds more than once; only keys are read, and counted before they move."""
    counts = side.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return counts.select(*on, F.lit(True).alias(out))


def _pair_unique(refs: DataFrame, preds: DataFrame, on: Sequence[str], keep_unmatched: bool) -> DataFrame:
    # lists of keys have each once: a hot key's rows are spread by the planner, and all joins are by the key alone
    lists = repeated_keys(refs, on, "_ref_again"), repeated_keys(preds, on, "_pred_again")
    marked = [side.join(lists[0], on, "left").join(lists[1], on, "left") for side in (refs, preds)]
    again = F.coalesce("_ref_again", "_pred_again", F.lit(False))
    once, rejected = ([m.where(c).drop("_ref_again", "_pred_again") for m in marked] for c in (~again, again))
    pairs = pair(*once, on, keep_unmatched)
    for side in rejected:
        pairs = pairs.unionByName(side.withColumn("status", F.lit(DUPLICATE_KEY)), allowMissingColumns=True)
    return pairs


def flag(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """Give rows that are still ok the first reason whose condition they meet."""
    before = F.col("status") if "status" in df.columns else F.lit(OK)
    status = F.when(before != OK, before)
    for reason, condition in reasons.items():
        status = status.when(condition, F.lit(reason))
    return df.withColumn("status", status.otherwise(before))


def flag_rate_mismatch(df: DataFrame, ref_sr: str = "ref_sr", est_sr: str = "est_sr") -> DataFrame:
    """Signals of unequal sampling rate are rejected, not compared sample by sample."""
    return flag(df, {RATE_MISMATCH: F.col(ref_sr) != F.col(est_sr)})


def split_status(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to score, rejected rows with their reason)."""
    return df.where(F.col("status") == OK), df.where(F.col("status") != OK)


def validate_samples(
    df: DataFrame, schema: T.StructType, key: str | Sequence[str]
) -> DataFrame:
    """Check names and types, then report keys that occur more than once."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, "
        f"found {actual[f.name].simpleString() if f.name in actual else 'nothing'}"
        for f in schema.fields
        if actual.get(f.name) is None
        or actual[f.name].simpleString() != f.dataType.simpleString()
    ]
    if wrong:
        raise ValueError("; ".join(wrong))
    on = as_list(key)
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def with_sample_metadata(
    scores: DataFrame, meta: DataFrame, key: str | Sequence[str] = "sample_idx"
) -> DataFrame:
    """Add per-sample ids; scores without metadata stay, with NULLs.

    ``meta`` holds one row per key, so no key multiplies or concentrates rows
    beyond the scores that share it.
    """
    on = as_list(key)
    refuse_clash(
        [c for c in scores.columns if c not in on], [c for c in meta.columns if c not in on]
    )
    return scores.join(meta, on, "left")


def with_batch_metadata(df: DataFrame, metadata: Mapping[str, object]) -> DataFrame:
    """Attach the same values to every row."""
    refuse_clash(df.columns, list(metadata))
    return df.withColumns({k: F.lit(v) for k, v in metadata.items()}) if metadata else df


def fill_sentinels(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Failed metrics as numbers: -inf for ``si_sdr``, -1.0 for all others."""
    return df.withColumns(
        {
            m: F.coalesce(F.col(m), F.lit(float("-inf") if m == "si_sdr" else -1.0))
            for m in metrics
        }
    )


def union_runs(**runs: DataFrame) -> DataFrame:
    """Append result tables by column name; each row carries the name of its run."""
    parts = [df.select(F.lit(run).alias("run_id"), "*") for run, df in runs.items()]
    if not parts:
        raise ValueError("no runs given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
