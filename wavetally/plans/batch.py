"""Evaluate a batch: predictions for samples, paired, scored and labelled."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.operators.error_rates import error_rates, spread
from wavetally.operators.fused import FRAME_SCORES, frame_scores
from wavetally.operators.memo import build_requests
from wavetally.operators.pairing import (
    INFERENCE_ERROR,
    MISSING_PREDICTION,
    MISSING_REFERENCE,
    as_list,
    flag,
    flag_rate_mismatch,
    pair,
    refuse_clash,
    with_batch_metadata,
    with_sample_metadata,
)
from wavetally.operators.signal import align_pairs, si_sdr

Job = Callable[[DataFrame], DataFrame]

TTS_METRICS = ["pesq", "stoi", "si_sdr", "sim_o", "sim_r"]
ASR_METRICS = ["cer", "wer"]


def score_transcripts(
    pairs: DataFrame, ref: str = "text", hyp: str = "hyp", as_percent: bool = False, tasks: int | None = None
) -> DataFrame:
    """CER and WER with their counts; the texts themselves are not carried on.

    With ``tasks`` the pairs are dealt out evenly to so many before they are scored, see
    :func:`wavetally.operators.error_rates.spread`.
    """
    dealt = pairs if tasks is None else spread(pairs, tasks)
    return error_rates(dealt, ref, hyp, as_percent=as_percent).drop(ref, hyp)


def score_signals(
    pairs: DataFrame,
    extra: Mapping[str | tuple[str, ...], DataFrame] | None = None,
    key: str | Sequence[str] = "sample_idx",
    max_seconds: float | None = None,
) -> DataFrame:
    """Signal metrics of (key, text, ref, ref_sr, est, est_sr, status) rows.

    SI-SDR is computed here. ``extra`` maps a metric name, or several, to a table
    (key, <metrics>): frame-based similarities, or scores made elsewhere.
    Metrics nobody supplied are NULL columns, so the schema is fixed; those of
    rejected rows are NULL. Whole signals are scored unless ``max_seconds`` cuts.
    """
    on = as_list(key)
    present = {MISSING_REFERENCE: F.col("ref").isNull(), MISSING_PREDICTION: F.col("est").isNull()}
    flagged = flag_rate_mismatch(flag(pairs, present))
    usable = F.col("status") == "ok"
    # a rejected pair keeps its row but not its signals
    blanked = flagged.withColumns({c: F.when(usable, F.col(c)) for c in ("ref", "est")})
    scored = si_sdr(align_pairs(blanked, rate="ref_sr", max_seconds=max_seconds)).drop("ref", "est", "ref_sr", "est_sr")
    for names, table in (extra or {}).items():
        metrics = as_list(names)
        values = {m: F.when(F.col("status") == "ok", F.col(m)) for m in metrics}
        scored = scored.join(table.select(*on, *metrics), on, "left").withColumns(values)
    missing = [m for m in TTS_METRICS if m not in scored.columns]
    scored = scored.withColumns({m: F.lit(None).cast("double") for m in missing})
    others = [c for c in scored.columns if c not in [*on, *TTS_METRICS]]
    return scored.select(*on, *TTS_METRICS, *others)


def frame_metrics(
    ref: DataFrame,
    est: DataFrame,
    key: str | Sequence[str] = "sample_idx",
    frame: str = "frame",
    values: str = "values",
    coefficients: int = 13,
) -> dict[tuple[str, ...], DataFrame]:
    """``extra`` of :func:`score_signals` from band frames of both sides: stoi, sim_o and sim_r in one pass."""
    return {FRAME_SCORES: frame_scores(ref, est, key, frame, values, coefficients).drop("status")}


def evaluate_batch(
    samples: DataFrame,
    score: Job,
    infer: Job | None = None,
    decode: Job | None = None,
    predictions: DataFrame | None = None,
    key: str | Sequence[str] = "sample_idx",
    text: str = "text",
    prompt: str = "",
    batch_metadata: Mapping[str, object] | None = None,
) -> DataFrame:
    """Scores of all samples as one plan; rejected ones stay, with a status.

    Predictions are a table, or come from ``infer``: a job from samples (with a
    ``request`` column) to (key, prediction...), e.g. a ``mapInPandas`` around a
    model. ``decode`` does the same for samples without a text. ``score`` turns
    pairs into metric columns. A sample with several predictions, or several
    samples of one key, are rejected as ``duplicate_key``. A job may report in a
    column ``inference_error`` what went wrong with a sample, as those of
    :func:`wavetally.plans.isolation.isolated` do; such samples are rejected under that
    name, and the message stays.
    """
    on = as_list(key)
    if predictions is None:
        predictions = predict(samples, infer, decode, on, text, prompt)
    absent = [k for k in on if k not in predictions.columns]
    if absent:
        raise ValueError(f"predictions lack the key columns {absent}")
    differing = [
        k for k in on if predictions.schema[k].dataType.simpleString() != samples.schema[k].dataType.simpleString()
    ]
    if differing:
        raise ValueError(f"predictions have other types for {differing}")
    pairs = pair(samples, predictions, on, flag_duplicates=True)
    if INFERENCE_ERROR in predictions.columns:
        pairs = flag(pairs, {INFERENCE_ERROR: F.col(INFERENCE_ERROR).isNotNull()})
    return with_batch_metadata(score(pairs), batch_metadata or {})


def predict(
    samples: DataFrame, infer: Job | None, decode: Job | None, key: Sequence[str], text: str = "text", prompt: str = ""
) -> DataFrame:
    """Run the user's jobs: ``infer`` where there is a text, ``decode`` where there is none."""
    if infer is None and decode is None:
        raise ValueError("give predictions, infer or decode")
    refuse_clash(samples.columns, ["request"])
    requests = build_requests(samples, prompt, text)
    parts = []
    if infer is not None:
        parts.append(requests.where(F.col(text).isNotNull()).transform(infer))
    if decode is not None:
        parts.append(requests.where(F.col(text).isNull()).drop("request").transform(decode))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


class Evaluation:
    """A score together with the user's jobs, set at once or later."""

    def __init__(self, score: Job, infer: Job | None = None, decode: Job | None = None):
        self.score = score
        self.infer = infer
        self.decode = decode

    def set_infer(self, infer: Job) -> None:
        self.infer = infer

    def set_decode(self, decode: Job) -> None:
        self.decode = decode

    def batch(self, samples: DataFrame, **options) -> DataFrame:
        return evaluate_batch(samples, self.score, self.infer, self.decode, **options)


def enrich(scores: DataFrame, meta: DataFrame | None, key: str | Sequence[str]) -> DataFrame:
    return scores if meta is None else with_sample_metadata(scores, meta, key)
