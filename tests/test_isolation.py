"""Failures that stay with their rows: raising jobs and repeated keys."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from wavetally.operators.pairing import pair
from wavetally.plans.batch import Evaluation, score_transcripts
from wavetally.plans.isolation import isolated


def test_raising_rows_stand_alone(spark):
    calls = spark.sparkContext.accumulator(0)

    def work(requests: pa.Table) -> pa.Table:
        calls.add(1)
        if pc.any(pc.equal(pc.bit_wise_and(requests.column("sample_idx"), 63), 7)).as_py():
            raise RuntimeError("seventh")
        return requests.select(["sample_idx"]).append_column("hyp", pc.ascii_lower(requests.column("text")))

    samples = spark.range(1000).select(F.col("id").alias("sample_idx"), F.lit("Some Text").alias("text"))
    evaluation = Evaluation(score_transcripts, infer=isolated(work, "sample_idx bigint, hyp string"))
    rows = {r.sample_idx: r for r in evaluation.batch(samples).collect()}
    assert len(rows) == 1000
    for i, r in rows.items():
        if i % 64 == 7:
            assert (r.status, r.inference_error, r.cer) == ("inference_error", "RuntimeError: seventh", None)
        else:
            assert (r.status, r.inference_error, r.cer, r.wer) == ("ok", None, 0.0, 0.0)
    assert calls.value < 2 * 1000  # halving finds a row in a few calls


def test_wrong_output_is_reported_per_row(spark):
    samples = spark.createDataFrame([(1, "a"), (2, "b")], "sample_idx bigint, text string")
    lacking = isolated(lambda t: t.select(["sample_idx"]), "sample_idx bigint, hyp string")
    rows = Evaluation(score_transcripts, infer=lacking).batch(samples).collect()
    assert [r.status for r in rows] == ["inference_error"] * 2 and all("hyp" in r.inference_error for r in rows)
    assert lacking(samples.where("false")).count() == 0
    with pytest.raises(ValueError):
        isolated(lambda t: t, "hyp string")
    with pytest.raises(ValueError):
        isolated(lambda t: t, "sample_idx bigint, inference_error string")


def test_repeated_keys_do_not_multiply(spark):
    refs = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("text"))
    preds = refs.select("k", F.col("text").alias("hyp"))
    more = spark.createDataFrame([(2, 5), (None, 6), (None, 7)], "k int, text bigint")
    got = pair(refs.unionByName(more), preds.unionByName(more.toDF("k", "hyp")), "k", flag_duplicates=True)
    counts = {(r.status, r.k): r["count"] for r in got.groupBy("status", "k").count().collect()}
    assert counts == {
        ("duplicate_key", 1): 200_000, ("ok", 2): 1, ("missing_prediction", None): 2, ("missing_reference", None): 2,
    }
    only = pair(refs, more.toDF("k", "hyp"), "k", keep_unmatched=False, flag_duplicates=True)
    assert {r.status for r in only.select("status").distinct().collect()} == {"duplicate_key"}
