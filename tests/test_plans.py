"""Files and whole evaluations."""

from __future__ import annotations

import csv
import glob
import hashlib
import os
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavetally.plans.batch import ASR_METRICS, TTS_METRICS, Evaluation, evaluate_batch, score_signals, score_transcripts
from wavetally.plans.corpus import evaluate_corpus
from wavetally.plans.sweep import evaluate_sweep, sweep_requests
from wavetally.session import scratch_dir
from wavetally.sinks.writers import with_audio_path, write_pairs, write_scores, write_sweep
from wavetally.sources.readers import checkpoints, read_hashed_files, read_manifest, read_predictions


@pytest.fixture
def corpus(tmp_path):
    lines = {
        "84/121123": ["84-121123-0000 GO DO YOU HEAR", "84-121123-0001 BUT IN LESS THAN FIVE MINUTES"],
        "1272/128104": ["1272-128104-0000 MISTER QUILTER  IS", "not a transcript line"],
    }
    for folder, content in lines.items():
        path = tmp_path / "corpus" / folder
        path.mkdir(parents=True)
        (path / f"{folder.replace('/', '-')}.trans.txt").write_text("\n".join(content) + "\n")
        (path / "noise.txt").write_text("9-9-9 IGNORED\n")
    return str(tmp_path / "corpus")


def test_manifest(spark, corpus):
    rows = {(r["speaker_id"], r["chapter_id"], r["utterance_id"]): r for r in read_manifest(spark, corpus).collect()}
    assert set(rows) == {(84, 121123, 0), (84, 121123, 1), (1272, 128104, 0)}
    assert rows[(1272, 128104, 0)]["text"] == "MISTER QUILTER  IS"
    assert rows[(84, 121123, 1)]["path"].endswith("84/121123/84-121123-0001.flac")


def test_file_hashes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x00\xff" * 10)
    (tmp_path / "b.bin").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"other")
    rows = {os.path.basename(r["path"]): r for r in read_hashed_files(spark, str(tmp_path), "*.bin").collect()}
    assert set(rows) == {"a.bin", "b.bin"}
    assert rows["a.bin"]["content_md5"] == hashlib.md5(b"\x00\xff" * 10).hexdigest()
    assert rows["b.bin"]["length"] == 1


def test_scores_of_two_runs_stay_apart(spark, tmp_path):
    path = str(tmp_path / "scores")
    df = spark.createDataFrame([(1, 0.5), (2, None)], "sample_idx bigint, wer double")
    for _ in range(2):  # a repeated run replaces itself
        write_scores(df, path, datetime(2025, 1, 2, 3, 4, 5))
    write_scores(df.limit(1), path, datetime(2025, 1, 2, 3, 4, 6))
    write_scores(df.limit(0), path, datetime(2030, 1, 1))
    assert sorted(os.path.basename(p) for p in glob.glob(path + "/run_ts=*")) == [
        "run_ts=20250102_030405",
        "run_ts=20250102_030406",
    ]
    rows = [r for f in glob.glob(path + "/run_ts=20250102_030405/*.csv") for r in csv.DictReader(open(f))]
    assert sorted((r["sample_idx"], r["wer"]) for r in rows) == [("1", "0.5"), ("2", "")]


def test_sweep_files_and_predictions(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, "x"), ("a", 1, "y"), ("10", 2, "z")], "checkpoint string, sample_idx bigint, hyp string")
    write_sweep(df, str(tmp_path / "sweep"))
    assert {os.path.basename(p) for p in glob.glob(str(tmp_path / "sweep/checkpoint=*"))} == {
        "checkpoint=a",
        "checkpoint=b",
        "checkpoint=10",
    }
    df.write.partitionBy("checkpoint").parquet(str(tmp_path / "preds"))
    preds = read_predictions(spark, str(tmp_path / "preds"))
    assert [r["checkpoint"] for r in checkpoints(preds).collect()] == ["10", "a", "b"]
    pruned = preds.where("checkpoint = 'a'")
    assert [r["hyp"] for r in pruned.collect()] == ["y"]
    df.drop("checkpoint").write.parquet(str(tmp_path / "flat"))
    with pytest.raises(ValueError, match="checkpoint"):
        read_predictions(spark, str(tmp_path / "flat"))


def test_signal_files(spark, tmp_path):
    df = spark.createDataFrame(
        [(7, [1.0, 2.0], [3.0], 16000, 24000), (8, [1.0], None, 16000, None)],
        "sample_idx bigint, ref array<double>, est array<double>, ref_sr int, est_sr int",
    )
    write_pairs(df, str(tmp_path))
    rows = {r["audio_path"]: r for r in spark.read.parquet(str(tmp_path)).collect()}
    assert set(rows) == {"gen_7", "orig_7", "orig_8"}
    assert rows["gen_7"]["signal"] == [3.0] and rows["gen_7"]["sample_rate"] == 24000
    assert with_audio_path(df).where("sample_idx = 7").first()["audio_path"] == "gen_7"


def test_scratch_is_below_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first.startswith(base) and first != second


SAMPLES = "sample_idx bigint, text string"


def echo(requests):
    """Stands for a model: repeats the text, garbling every third."""

    def run(batches):
        for pdf in batches:
            hyp = [t + " extra" if i % 3 == 0 else t for i, t in zip(pdf["sample_idx"], pdf["text"])]
            yield pd.DataFrame({"sample_idx": pdf["sample_idx"], "hyp": hyp})

    return requests.select("sample_idx", "text").mapInPandas(run, "sample_idx bigint, hyp string")


def test_batch_with_a_model_job(spark):
    samples = spark.createDataFrame([(i, f"one two w{i}") for i in range(9)], SAMPLES)
    evaluation = Evaluation(score_transcripts)
    with pytest.raises(ValueError, match="infer"):
        evaluation.batch(samples)
    evaluation.set_infer(echo)
    scores = evaluation.batch(samples, batch_metadata={"dataset": "d"})
    got = {r["sample_idx"]: r["wer"] for r in scores.collect()}
    assert got == {i: pytest.approx(1 / 3 if i % 3 == 0 else 0) for i in range(9)}
    assert {r["dataset"] for r in scores.select("dataset").collect()} == {"d"}


def test_batch_with_predictions_and_failures(spark):
    samples = spark.createDataFrame([(1, "a b"), (2, ""), (3, "c")], SAMPLES)
    preds = spark.createDataFrame([(1, "a b"), (2, "x"), (4, "y")], "sample_idx bigint, hyp string")
    scores = evaluate_batch(samples, score_transcripts, predictions=preds)
    assert {r["sample_idx"]: r["status"] for r in scores.collect()} == {
        1: "ok",
        2: "empty_reference",
        3: "missing_prediction",
        4: "missing_reference",
    }
    with pytest.raises(ValueError, match="key"):
        evaluate_batch(samples, score_transcripts, predictions=preds.select("hyp"))
    with pytest.raises(ValueError, match="types"):
        evaluate_batch(samples, score_transcripts, predictions=preds.withColumn("sample_idx", F.col("sample_idx").cast("int")))


def test_bucketed_tables_are_paired_without_a_shuffle(spark):
    spark.range(100).select(F.col("id").alias("sample_idx"), F.lit("a b").alias("text")).write.bucketBy(
        4, "sample_idx"
    ).sortBy("sample_idx").mode("overwrite").saveAsTable("bucketed_refs")
    spark.range(90).select(F.col("id").alias("sample_idx"), F.lit("a c").alias("hyp")).write.bucketBy(
        4, "sample_idx"
    ).sortBy("sample_idx").mode("overwrite").saveAsTable("bucketed_preds")
    try:
        scores = evaluate_batch(
            spark.table("bucketed_refs"), score_transcripts, predictions=spark.table("bucketed_preds")
        )
        assert "hashpartitioning" not in scores._jdf.queryExecution().executedPlan().toString()
        assert scores.where("wer = 0.5").count() == 90 and scores.where("status = 'missing_prediction'").count() == 10
    finally:
        spark.sql("DROP TABLE bucketed_refs")
        spark.sql("DROP TABLE bucketed_preds")


def test_text_samples_are_inferred_and_others_decoded(spark):
    samples = spark.createDataFrame(
        [(1, "say it", [1.0, 2.0, -1.0], 16000), (2, None, [2.0, 1.0, 0.5], 16000)],
        "sample_idx bigint, text string, ref array<double>, ref_sr int",
    )

    def infer(requests):
        assert "request" in requests.columns
        return requests.select("sample_idx", F.array(F.lit(1.0), F.lit(2.0)).alias("est"), F.lit(16000).alias("est_sr"))

    def decode(requests):
        return requests.select("sample_idx", F.col("ref").alias("est"), F.lit(24000).alias("est_sr"))

    extra = spark.createDataFrame([(1, 0.9)], "sample_idx bigint, stoi double")
    evaluation = Evaluation(lambda pairs: score_signals(pairs, {"stoi": extra}), infer=infer)
    evaluation.set_decode(decode)
    got = {r["sample_idx"]: r for r in evaluation.batch(samples, prompt="softly").collect()}
    assert got[1]["si_sdr"] == float("inf") and got[1]["stoi"] == 0.9 and got[1]["pesq"] is None
    assert got[2]["status"] == "rate_mismatch" and got[2]["si_sdr"] is None
    assert evaluation.batch(samples).columns[:6] == ["sample_idx", *TTS_METRICS]


def test_corpus(spark, corpus):
    manifest = read_manifest(spark, corpus).withColumn("sample_idx", F.col("chapter_id") * 1000 + F.col("utterance_id"))
    preds = manifest.select("sample_idx", F.lower("text").alias("hyp"))
    scores, summary = evaluate_corpus(
        Evaluation(score_transcripts),
        manifest.select("sample_idx", "text"),
        "sample_idx",
        ASR_METRICS,
        n=2,
        meta=manifest.select("sample_idx", "speaker_id", "chapter_id", "utterance_id"),
        batch_metadata={"dataset": "tiny", "subset": "test"},
        predictions=preds,
    )
    rows = scores.collect()
    assert len(rows) == 2 and all(r["wer"] == 0 and r["speaker_id"] and r["status"] == "ok" for r in rows)
    assert {r["metric"]: (r["mean"], r["n"]) for r in summary.collect()} == {"cer": (0.0, 2), "wer": (0.0, 2)}


def test_corpus_sample_bounds_the_work(spark):
    """Predictions outside the sample are dropped."""
    table = spark.range(500).select(F.col("id").alias("sample_idx"), F.lit("a b").alias("text"))
    preds = table.select("sample_idx", F.lit("a c").alias("hyp"))
    scores, summary = evaluate_corpus(
        Evaluation(score_transcripts), table, "sample_idx", ASR_METRICS, n=20, predictions=preds
    )
    assert scores.count() == 20 and scores.where("status = 'ok'").count() == 20
    assert {r["metric"]: r["mean"] for r in summary.collect()}["wer"] == 0.5


def test_sweep(spark):
    refs = spark.createDataFrame([(1, "a b"), (2, "c d")], SAMPLES)
    preds = spark.createDataFrame(
        [("good", 1, "a b"), ("good", 2, "c d"), ("half", 1, "a x"), ("half", 9, "q")],
        "checkpoint string, sample_idx bigint, hyp string",
    )
    scores, comparison = evaluate_sweep(
        refs, preds, score_transcripts, "sample_idx", ASR_METRICS, ["good", "half", "broken"]
    )
    got = {(r["checkpoint"], r["metric"]): r for r in comparison.collect()}
    assert got[("good", "wer")]["mean"] == 0 and got[("good", "wer")]["n_rejected"] == 0
    half = got[("half", "wer")]
    assert half["mean"] == 0.5 and half["n_ok"] == 1 and half["n_rejected"] == 2
    assert got[("broken", "cer")]["n_ok"] == 0 and got[("broken", "cer")]["n_rejected"] == 2
    assert scores.where("status = 'missing_reference'").count() == 1


def test_sweep_requests(spark):
    requests = sweep_requests(spark.range(3), ["b", "a", "b"])
    assert requests.count() == 6
    assert [r["checkpoint"] for r in requests.select("checkpoint").distinct().orderBy("checkpoint").collect()] == ["a", "b"]
