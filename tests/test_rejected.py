"""Rejected rows, whole signals and odd checkpoint names."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from wavetally.operators.joins import hot_key_join
from wavetally.operators.pairing import pair
from wavetally.operators.signal import align_pairs, si_sdr, si_sdr_segments
from wavetally.operators.similarity import band_intelligibility, sim_o, sim_r
from wavetally.operators.summary import summarise
from wavetally.sinks.writers import write_scores
from wavetally.plans.batch import TTS_METRICS, evaluate_batch, frame_metrics, score_signals, score_transcripts
from wavetally.sources.readers import read_predictions, rejected_lines
from wavetally.operators.ordering import index_within


def test_rejected_rows_stay_out_of_means(spark):
    rows = [(1, 1.0, "ok"), (2, 100.0, "rate_mismatch"), (3, float("nan"), "rate_mismatch")]
    got = summarise(spark.createDataFrame(rows, "k int, cer double, status string"), ["cer"]).first()
    assert (got["mean"], got.n, got.n_nan, got.n_ok, got.n_rejected) == (1.0, 1, 0, 1, 2)


def test_signals_are_whole_unless_cut(spark):
    df = spark.createDataFrame([([1.0] * 40, [2.0] * 50)], "ref array<double>, est array<double>")
    assert len(align_pairs(df, rate=F.lit(2)).first().est) == 40


def test_checkpoints_stay_text(spark, tmp_path):
    rows = [("0010", 1), ("10", 2), ("1e3", 3)]
    spark.createDataFrame(rows, "checkpoint string, k int").write.partitionBy("checkpoint").parquet(str(tmp_path / "p"))
    assert {tuple(r) for r in read_predictions(spark, str(tmp_path / "p")).select("checkpoint", "k").collect()} == set(rows)


def test_stamp_has_no_zone(spark, tmp_path):
    write_scores(spark.createDataFrame([(1, 0.5)], "k int, cer double"), str(tmp_path / "s"), datetime(2025, 1, 31, 23, 59, 59))
    assert (tmp_path / "s" / "run_ts=20250131_235959").is_dir()


def test_null_key_is_numbered_first(spark):
    rows = spark.createDataFrame([("a", i) for i in range(8)] + [("a", None)], "g string, k int")
    for buckets in (1, 4, 64):
        got = {r.k: r.idx for r in index_within(rows, "g", "k", buckets=buckets).collect()}
        assert got == {None: 0, **{i: i + 1 for i in range(8)}}


SEGMENTS = "id string, segment int, ref array<double>, est array<double>"


def test_unequal_lengths_have_a_status(spark):
    rows = [("bad", 0, [1.0, 2.0], [1.0, 2.5]), ("bad", 1, [1.0, 2.0], [1.0]), ("good", 0, [1.0, 2.0], [1.0, 2.5])]
    df = spark.createDataFrame(rows, SEGMENTS)
    assert sorted(r.status for r in si_sdr(df).collect()) == ["length_mismatch", "ok", "ok"]
    got = {r.id: r for r in si_sdr_segments(df, "id").collect()}
    assert (got["bad"].status, got["bad"].si_sdr) == ("length_mismatch", None)
    assert got["good"].status == "ok" and got["good"].si_sdr is not None


def test_segments_may_have_negative_numbers(spark):
    a, b = ([1.0, 2.0], [1.5, 2.0]), ([3.0, -1.0], [2.0, 0.5])
    for first in (0, -1, 4095):
        df = spark.createDataFrame([("x", first, *a), ("x", first + 1, *b)], SEGMENTS)
        whole = spark.createDataFrame([("x", 0, a[0] + b[0], a[1] + b[1])], SEGMENTS)
        assert abs(si_sdr_segments(df, "id").first().si_sdr - si_sdr(whole).first().si_sdr) < 1e-9


def test_repeated_predictions_are_rejected(spark):
    samples = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d"), (None, "e")], "sample_idx bigint, text string")
    preds = spark.createDataFrame([(1, "a b"), (1, "a x"), (2, "c"), (None, "e")], "sample_idx bigint, hyp string")
    got = sorted((str(r.sample_idx), r.status, r.wer) for r in evaluate_batch(samples, score_transcripts, predictions=preds).collect())
    assert got == [  # each row of a repeated key by itself: one sample, two predictions
        ("1", "duplicate_key", None),
        ("1", "duplicate_key", None),
        ("1", "duplicate_key", None),
        ("2", "ok", 0.0),
        ("3", "missing_prediction", None),
        ("None", "missing_prediction", None),
        ("None", "missing_reference", None),
    ]


def frames_of(spark, ids, n=40):
    rows = [(i, f, [float((f * 7 + b * 3 + i) % 11 + 1) for b in range(16)]) for i in ids for f in range(n)]
    return spark.createDataFrame(rows, "sample_idx bigint, frame bigint, values array<double>")


def test_similarities_keep_samples_of_one_side(spark):
    late = frames_of(spark, [4]).withColumn("frame", F.col("frame") + 100)
    ref = frames_of(spark, [1, 2]).union(frames_of(spark, [4]))
    est = frames_of(spark, [2, 3]).union(late)
    expected = {1: "missing_prediction", 2: "ok", 3: "missing_reference", 4: "no_common_frames"}
    first = F.col("values")[0].alias("value")
    envelopes = [side.select("sample_idx", "frame", first) for side in (ref, est)]
    for got in (sim_o(ref, est, "sample_idx"), sim_r(*envelopes, "sample_idx"), band_intelligibility(ref, est, "sample_idx")):
        assert {r.sample_idx: r.status for r in got.collect()} == expected


def test_runs_stop_at_gaps(spark):
    gappy = frames_of(spark, [1], 70).where("frame <> 34")
    for span in (31, 1024):
        row = band_intelligibility(gappy, gappy, "sample_idx", span=span).first()
        assert row.segments == 16 * ((34 - 29) + (35 - 29))


def test_batch_of_signals_has_all_frame_metrics(spark):
    wave = spark.createDataFrame([(1, [1.0, 2.0, -1.0], 16000)], "sample_idx bigint, ref array<double>, ref_sr int")
    est = wave.toDF("sample_idx", "est", "est_sr")
    extra = frame_metrics(frames_of(spark, [1]), frames_of(spark, [1]))
    row = score_signals(pair(wave, est, "sample_idx"), extra).first()
    assert all(row[m] is not None for m in TTS_METRICS if m != "pesq") and row.pesq is None


def test_every_hot_key_is_split(spark):
    many = spark.range(60_000).select((F.col("id") % 12_000).alias("k"), "id")
    joined = hot_key_join(many, spark.range(12_000).select(F.col("id").alias("k"), F.lit(1).alias("v")), "k", "id", 2)
    assert joined.count() == 60_000


def test_pairs_of_a_hot_key_are_split_and_small_sides_are_not_shuffled(spark):
    small = spark.range(10).select("id", F.lit("a").alias("ref"))
    preds = spark.range(1000).select("id", F.lit("b").alias("hyp"))
    plan = pair(small, preds, "id", keep_unmatched=False)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_lines_of_another_form_are_reported(spark, tmp_path):
    (tmp_path / "a.trans.txt").write_text("1-2-3 WORDS\n\n1-2-4\nno id here\n")
    assert sorted(r.line for r in rejected_lines(spark, str(tmp_path)).collect()) == ["1-2-4", "no id here"]
