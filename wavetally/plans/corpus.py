"""Evaluate a seeded sample of a corpus and summarise it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.operators.ordering import sample_keys
from wavetally.operators.summary import summarise
from wavetally.plans.batch import Evaluation, enrich
from wavetally.session import scratch_dir
from wavetally.sinks.writers import write_scores
from wavetally.sources.readers import read_stored


def drawn_keys(corpus: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` keys of a seeded sample, drawn when this is called and read from the shared folder since then."""
    spark = corpus.sparkSession
    path = scratch_dir(spark, "sample")
    sample_keys(corpus, key, n, seed).write.parquet(path)
    return F.broadcast(spark.read.schema(corpus.select(key).schema).parquet(path))


def evaluate_corpus(
    evaluation: Evaluation,
    corpus: DataFrame,
    key: str,
    metrics: Sequence[str],
    n: int = 200,
    seed: int = 42,
    meta: DataFrame | None = None,
    batch_metadata: Mapping[str, object] | None = None,
    predictions: DataFrame | None = None,
    prompt: str = "",
    by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(scores with ids and batch metadata, summary).

    The sample's keys are drawn once, when this is called, and written to the
    shared folder. The corpus, predictions and metadata are reduced to them as
    they are read; ``n`` keys are sent to all tasks.
    """
    keys = drawn_keys(corpus, key, n, seed)
    sample = corpus.join(keys, key, "left_semi")
    if predictions is not None:
        predictions = predictions.join(keys, key, "left_semi")
    if meta is not None:
        meta = meta.join(keys, key, "left_semi")
    scores = evaluation.batch(
        sample, key=key, predictions=predictions, prompt=prompt, batch_metadata=batch_metadata
    )
    scores = enrich(scores, meta, key)
    return scores, summarise(scores, metrics, by)


def store_corpus(
    evaluation: Evaluation,
    corpus: DataFrame,
    key: str,
    metrics: Sequence[str],
    directory: str,
    run_ts: datetime,
    by: Sequence[str] = (),
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(stored scores of this run, their summary): what :func:`evaluate_corpus` gives, scored once.

    The scores are written below ``directory`` when this is called; the rows and the summary come from the files.
    Calling again with the same time replaces the run's rows. ``options`` are those of :func:`evaluate_corpus`.
    """
    scores, _ = evaluate_corpus(evaluation, corpus, key, metrics, by=by, **options)
    write_scores(scores, directory, run_ts)
    stamp = run_ts.strftime("%Y%m%d_%H%M%S")
    fields = scores.withColumn("run_ts", F.lit(stamp)).schema
    stored = read_stored(corpus.sparkSession, directory, fields, "csv", header="true").where(F.col("run_ts") == stamp)
    return stored, summarise(stored, metrics, by)
