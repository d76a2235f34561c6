from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.operators.pairing import flag_rate_mismatch
from wavetally.operators.signal import (
    align_pairs,
    first_channel,
    one_reference_many_estimates,
    si_sdr,
    si_sdr_long,
    si_sdr_segments,
)

np.random.seed(0)
R = np.random.randn(100)
# fixed values: published results for this seed
GOLDEN = {
    "same": (R, R, math.inf),
    "double": (R, 2 * R, math.inf),
    "reversed": (R, R[::-1], -25.127672346460717),
    "sum": (R, R + R[::-1], 0.481070445785553),
    "shift": (R, R + 0.5, 6.3704606032577304),
    "scale_shift": (R, 2 * R + 1, 6.3704606032577304),
    "silent_estimate": (np.array([1.0, 0.0]), np.zeros(2), math.nan),
    "orthogonal": (np.array([1.0, 0.0]), np.array([0.0, 1.0]), -math.inf),
}
SIGNALS = "id string, ref array<double>, est array<double>"


@pytest.fixture(scope="module")
def golden(spark):
    data = [(k, r.tolist(), e.tolist()) for k, (r, e, _) in GOLDEN.items()]
    return spark.createDataFrame(data, SIGNALS)


def check(got: dict):
    for name, (_, _, expected) in GOLDEN.items():
        if math.isnan(expected):
            assert math.isnan(got[name])
        else:
            assert got[name] == pytest.approx(expected, abs=1e-10), name


def test_golden_rows(golden):
    check({r["id"]: r["si_sdr"] for r in si_sdr(golden).collect()})


@pytest.mark.parametrize("span", [7, 64, 4096])
def test_golden_sample_rows(golden, span):
    long = golden.select("id", F.posexplode("ref").alias("t", "r"), "est").select(
        "id", "t", F.col("r").alias("ref"), F.col("est")[F.col("t")].alias("est")
    )
    check({r["id"]: r["si_sdr"] for r in si_sdr_long(long.repartition(4), "id", span=span).collect()})


def test_segments_of_a_near_perfect_estimate_keep_their_digits(spark):
    rng = np.random.default_rng(1)
    ref = rng.standard_normal((50, 200))
    est = 3 * ref + 1e-9 * rng.standard_normal(ref.shape)
    r, e = ref.ravel(), est.ravel()
    a = (r @ e) / (r @ r)
    expected = 10 * np.log10(((a * r) ** 2).sum() / ((e - a * r) ** 2).sum())
    data = [("p", i, ref[i].tolist(), est[i].tolist()) for i in range(50)]
    df = spark.createDataFrame(data, "id string, segment int, ref array<double>, est array<double>")
    assert expected > 180
    assert si_sdr_segments(df, "id").first()["si_sdr"] == pytest.approx(expected, abs=1e-4)


def test_two_channels_are_scored_apart(spark):
    data = [(1, 0, R.tolist(), (2 * R + 1).tolist()), (1, 1, R.tolist(), (R + 0.5).tolist())]
    df = spark.createDataFrame(data, "id int, channel int, ref array<double>, est array<double>")
    for r in si_sdr(df).collect():
        assert r["si_sdr"] == pytest.approx(6.3704606032577304)


def test_scaling_the_estimate_changes_nothing(spark):
    noisy = R + 0.3 * R[::-1]
    df = spark.createDataFrame(
        [(str(k), R.tolist(), (k * noisy).tolist()) for k in (0.01, 1.0, -7.0)], SIGNALS
    )
    values = [r["si_sdr"] for r in si_sdr(df).collect()]
    assert max(values) - min(values) < 1e-9


def test_silent_reference_is_rejected(spark):
    df = spark.createDataFrame([("x", [0.0, 0.0], [1.0, 2.0])], SIGNALS)
    for got in (si_sdr(df).first(), si_sdr_segments(df.withColumn("segment", F.lit(0)), "id").first()):
        assert got["si_sdr"] is None and got["status"] == "silent_reference"


def test_missing_empty_and_unequal_signals(spark):
    data = [
        ("null", None, [1.0]),
        ("both", None, None),
        ("empty", [], []),
        ("unequal", [1.0, 2.0], [1.0]),
        ("good", [1.0, 2.0], [1.0, 2.5]),
        ("hole", [1.0, None], [1.0, 2.0]),
    ]
    got = {r["id"]: (r["si_sdr"], r["status"]) for r in si_sdr(spark.createDataFrame(data, SIGNALS).coalesce(1)).collect()}
    assert got["null"][0] is None and got["both"][0] is None and got["unequal"][0] is None
    assert got["empty"] == (None, "silent_reference")
    assert got["good"][0] == pytest.approx(10 * math.log10(7.2 / 0.05))
    assert got["hole"][0] is None or math.isnan(got["hole"][0])


def test_align_trims_to_the_shorter_and_to_the_time_limit(spark):
    df = spark.createDataFrame([("x", [float(i) for i in range(100)], [1.0] * 60)], SIGNALS)
    got = align_pairs(df).first()
    assert len(got["ref"]) == len(got["est"]) == 60
    got = align_pairs(df, rate=F.lit(2), max_seconds=15).first()
    assert len(got["ref"]) == len(got["est"]) == 30 and got["ref"][-1] == 29.0


def test_rate_mismatch(spark):
    df = spark.createDataFrame([(1, 16000, 16000), (2, 16000, 24000), (3, 16000, None)], "id int, ref_sr int, est_sr int")
    got = {r["id"]: r["status"] for r in flag_rate_mismatch(df).collect()}
    assert got == {1: "ok", 2: "rate_mismatch", 3: "ok"}


def test_first_channel(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],), ([],)], "c array<array<double>>")
    assert [r[0] for r in df.select(first_channel("c")).collect()] == [[1.0, 2.0], None]


def test_popular_reference_is_split_and_nothing_is_lost(spark):
    refs = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(10)], "ref_id int, ref array<double>")
    keys = [0] * 500 + [k for k in range(10) for _ in range(10)] + [99]
    ests = spark.createDataFrame([(i, k, [1.0, float(i)]) for i, k in enumerate(keys)], "est_id int, ref_id int, est array<double>")
    joined = one_reference_many_estimates(refs, ests, "ref_id", "est_id", rows_per_copy=50)
    got = sorted((r["est_id"], r["ref_id"], r["ref"][0]) for r in joined.collect())
    assert got == sorted((i, k, float(k)) for i, k in enumerate(keys) if k != 99)
