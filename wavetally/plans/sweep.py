"""Evaluate every checkpoint on the same samples, in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.operators.pairing import (
    DUPLICATE_KEY,
    MISSING_PREDICTION,
    MISSING_REFERENCE,
    OK,
    as_list,
    repeated_keys,
    with_batch_metadata,
)
from wavetally.operators.summary import compare_checkpoints
from wavetally.plans.batch import Job
from wavetally.plans.corpus import drawn_keys
from wavetally.sinks.writers import write_sweep
from wavetally.sources.readers import checkpoint_folders, read_predictions, read_stored


def sweep_requests(samples: DataFrame, checkpoints: Sequence[str]) -> DataFrame:
    """Each sample once per checkpoint. The names are a short list of folders."""
    names = F.array(*[F.lit(c) for c in sorted(set(checkpoints))])
    return samples.withColumn("checkpoint", F.explode(names))


def pair_sweep(
    refs: DataFrame, preds: DataFrame, key: str | Sequence[str], checkpoints: Sequence[str] | None = None
) -> DataFrame:
    """Predictions of all checkpoints with their reference, and what is missing.

    References travel once, not once per checkpoint. With the list of
    ``checkpoints``, a (checkpoint, sample) without a prediction gets a row;
    these are found from keys alone, which are multiplied for what is missing
    only. Predictions that a checkpoint holds more than once for a sample, and
    all rows of a sample that ``refs`` holds more than once, are taken out
    before the join and stay as ``duplicate_key`` rows, such references once per
    checkpoint (once, with a NULL checkpoint, where the list is not given).
    """
    on = as_list(key)
    names = F.array(*[F.lit(c) for c in sorted(set(checkpoints or []))]).cast("array<string>")
    ref_again = repeated_keys(refs, on, "_ref_again")
    answers = preds.groupBy(*on, "checkpoint").agg(F.count(F.lit(1)).alias("_n"))
    pred_again = answers.where("_n > 1").select(*on, "checkpoint", F.lit(True).alias("_pred_again"))
    marked_refs = refs.join(ref_again, on, "left")
    marked_preds = preds.join(ref_again, on, "left").join(pred_again, [*on, "checkpoint"], "left")
    again = F.coalesce("_ref_again", "_pred_again", F.lit(False))
    once = marked_refs.where(F.col("_ref_again").isNull()).drop("_ref_again")
    single = marked_preds.where(~again).drop("_ref_again", "_pred_again")
    found = once.withColumn("_in_refs", F.lit(True)).join(single, on, "right")
    status = F.when(F.col("_in_refs").isNull(), F.lit(MISSING_REFERENCE)).otherwise(F.lit(OK))
    paired = found.withColumn("status", status).drop("_in_refs")
    asked = F.explode(names) if checkpoints is not None else F.lit(None).cast("string")
    several = marked_refs.where("_ref_again").withColumn("checkpoint", asked)
    rejected = [several.drop("_ref_again"), marked_preds.where(again).drop("_ref_again", "_pred_again")]
    parts = [r.withColumn("status", F.lit(DUPLICATE_KEY)) for r in rejected]
    if checkpoints is not None:
        # at most one entry per checkpoint
        answered = answers.groupBy(*on).agg(F.collect_set("checkpoint").alias("_answered"))
        none = F.array().cast("array<string>")
        missing = (
            once.select(*on)
            .join(answered, on, "left")
            .select(*on, F.explode(F.array_except(names, F.coalesce("_answered", none))).alias("checkpoint"))
        )
        parts.append(missing.withColumn("status", F.lit(MISSING_PREDICTION)))
    for part in parts:
        paired = paired.unionByName(part, allowMissingColumns=True)
    return paired


def evaluate_sweep(
    refs: DataFrame,
    preds: DataFrame,
    score: Job,
    key: str | Sequence[str],
    metrics: Sequence[str],
    checkpoints: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scores with their checkpoint, comparison of checkpoints).

    A checkpoint whose samples all fail appears with ``n_ok`` = 0.
    """
    scores = score(pair_sweep(refs, preds, key, checkpoints))
    return scores, compare_checkpoints(scores, metrics)


def resume_sweep(
    refs: DataFrame,
    predictions: str,
    directory: str,
    score: Job,
    key: str,
    metrics: Sequence[str],
    n: int | None = None,
    seed: int = 42,
    batch_metadata: Mapping[str, object] | None = None,
    schema: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(stored scores of all checkpoints, their comparison), after scoring the new ones.

    Folders ``checkpoint=<name>`` below ``predictions`` that ``directory`` lacks are read, scored on the same samples
    (a seeded ``n`` of ``refs``, or all) and stored below ``directory``; the others' predictions are not read. Which
    those are is told by the folders of both sides, without reading rows. A checkpoint whose writing was cut short is
    not there and is scored again by the next call; one without predictions is stored as missing. The comparison is taken from the stored rows, so nothing is scored twice.
    """
    spark, on = refs.sparkSession, as_list(key)
    preds = read_predictions(spark, predictions, schema)
    if n is not None:
        keys = drawn_keys(refs, key, n, seed)
        refs, preds = refs.join(keys, on, "left_semi"), preds.join(keys, on, "left_semi")

    def scored(names: Sequence[str]) -> DataFrame:
        chosen = preds.where(F.col("checkpoint").isin(list(names)))
        return with_batch_metadata(score(pair_sweep(refs, chosen, on, names)), batch_metadata or {})

    def stored() -> DataFrame:
        return read_stored(spark, directory, scored([]).schema, "csv", header="true")

    there = set(checkpoint_folders(spark, directory))
    todo = [c for c in checkpoint_folders(spark, predictions) if c not in there]
    if todo:
        write_sweep(scored(todo), directory)
    scores = stored()
    return scores, compare_checkpoints(scores, metrics)
