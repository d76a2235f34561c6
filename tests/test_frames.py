from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.operators.frames import (
    align_frames,
    cepstra,
    onset_envelope,
    pack_frames,
    unpack_frames,
    with_previous_frames,
    znorm,
)
from wavetally.operators.similarity import band_intelligibility, sim_o, sim_r

FRAMES = "s string, frame bigint, values array<double>"


def frame_table(spark, samples: dict[str, np.ndarray]):
    data = [(s, i, row.tolist()) for s, m in samples.items() for i, row in enumerate(m)]
    return spark.createDataFrame(data, FRAMES).repartition(4)


def matrices(df) -> dict[str, np.ndarray]:
    out: dict[str, dict] = {}
    for r in df.collect():
        out.setdefault(r["s"], {})[r["frame"]] = r["values"]
    return {s: np.array([rows[i] for i in sorted(rows)]) for s, rows in out.items()}


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(3)
    return {"a": rng.standard_normal((70, 20)) - 5, "b": rng.standard_normal((33, 20)) * 4 + 2, "c": rng.random((1, 20))}


@pytest.fixture(scope="module")
def others():
    rng = np.random.default_rng(4)
    return {"a": rng.standard_normal((61, 20)) - 4, "b": rng.standard_normal((40, 20)) + 1, "c": rng.random((5, 20))}


def test_pack_and_unpack(spark, samples):
    df = frame_table(spark, samples)
    back = matrices(pack_frames(unpack_frames(df, "s").repartition(3), "s"))
    assert all(np.array_equal(back[s], samples[s]) for s in samples)


def test_cepstra_are_an_orthonormal_cosine_transform(spark, samples):
    got = matrices(cepstra(frame_table(spark, samples), 13))
    k, b = np.arange(13)[:, None], np.arange(20)[None, :]
    basis = np.sqrt(2 / 20) * np.where(k == 0, np.sqrt(0.5), 1) * np.cos(np.pi * k * (2 * b + 1) / 40)
    for s, m in samples.items():
        assert np.allclose(got[s], m @ basis.T, atol=1e-12)


@pytest.mark.parametrize("span", [4, 32, 4096])
def test_znorm_covers_the_whole_matrix(spark, samples, span):
    got = matrices(znorm(frame_table(spark, samples), "s", span=span))
    for s, m in samples.items():
        assert np.allclose(got[s], (m - m.mean()) / (m.std() + 1e-8), atol=1e-9)


def test_znorm_of_one_number_per_frame(spark):
    df = spark.createDataFrame([("x", i, float(i * i)) for i in range(10)], "s string, frame int, value double")
    got = {r["frame"]: r["value"] for r in znorm(df, "s", values="value").collect()}
    v = np.arange(10.0) ** 2
    assert np.allclose([got[i] for i in range(10)], (v - v.mean()) / (v.std() + 1e-8))


def test_constant_sample_gives_zeros(spark):
    got = matrices(znorm(frame_table(spark, {"x": np.full((3, 4), 7.0)}), "s"))
    assert np.array_equal(got["x"], np.zeros((3, 4)))


def envelope(m: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.maximum(np.diff(m, axis=0), 0).mean(axis=1)])


@pytest.mark.parametrize("span", [2, 5, 4096])
def test_onset_envelope_across_chunk_borders(spark, samples, span):
    rows = onset_envelope(frame_table(spark, samples), "s", span=span).collect()
    for s, m in samples.items():
        got = [r["value"] for r in sorted((r for r in rows if r["s"] == s), key=lambda r: r["frame"])]
        assert np.allclose(got, envelope(m))


def test_chunks_are_bounded_and_overlap(spark):
    df = frame_table(spark, {"x": np.zeros((100, 1))})
    sizes = {r["_chunk"]: r["count"] for r in with_previous_frames(df, back=3, span=10).groupBy("_chunk").count().collect()}
    assert sizes[0] == 10 and all(sizes[c] == 13 for c in range(1, 10)) and sizes[10] == 3
    with pytest.raises(ValueError):
        with_previous_frames(df, back=10, span=10)


def test_align_keeps_common_frames(spark, samples, others):
    joined = align_frames(frame_table(spark, samples), frame_table(spark, others), "s")
    assert {r["s"]: r["count"] for r in joined.groupBy("s").count().collect()} == {"a": 61, "b": 33, "c": 1}


@pytest.mark.parametrize("span", [8, 4096])
def test_sim_o(spark, samples, others, span):
    got = {r["s"]: r for r in sim_o(frame_table(spark, samples), frame_table(spark, others), "s", span=span).collect()}
    for s in samples:
        x, y = samples[s], others[s]
        x, y = (x - x.mean()) / (x.std() + 1e-8), (y - y.mean()) / (y.std() + 1e-8)
        n = min(len(x), len(y))
        cos = [x[i] @ y[i] / (np.linalg.norm(x[i]) * np.linalg.norm(y[i]) + 1e-8) for i in range(n)]
        assert got[s]["frames"] == n
        assert got[s]["sim_o"] == pytest.approx(np.mean(cos), abs=1e-10)


def test_sim_o_of_equal_tables_is_one(spark, samples):
    df = frame_table(spark, samples)
    assert all(r["sim_o"] == pytest.approx(1, abs=1e-6) for r in sim_o(df, df, "s").collect())


def test_sim_r(spark, samples, others):
    ref = onset_envelope(frame_table(spark, samples), "s")
    est = onset_envelope(frame_table(spark, others), "s")
    got = {r["s"]: r["sim_r"] for r in sim_r(ref, est, "s").collect()}
    for s in ("a", "b"):
        x, y = envelope(samples[s]), envelope(others[s])
        x, y = (x - x.mean()) / (x.std() + 1e-8), (y - y.mean()) / (y.std() + 1e-8)
        n = min(len(x), len(y))
        assert got[s] == pytest.approx(np.corrcoef(x[:n], y[:n])[0, 1], abs=1e-10)
    assert got["c"] is None  # one frame has no correlation


def loop_intelligibility(x: np.ndarray, y: np.ndarray, n: int, clip: float) -> tuple[int, float]:
    values = []
    for end in range(n, min(len(x), len(y)) + 1):
        for band in range(x.shape[1]):
            xs, ys = x[end - n : end, band], y[end - n : end, band]
            ys = np.minimum(np.linalg.norm(xs) / np.linalg.norm(ys) * ys, clip * xs)
            values.append(np.corrcoef(xs, ys)[0, 1])
    return len(values), float(np.mean(values))


@pytest.mark.parametrize("span", [40, 1024])
def test_band_intelligibility(spark, samples, others, span):
    x, y = {s: np.abs(m) for s, m in samples.items()}, {s: np.abs(m) for s, m in others.items()}
    rows = band_intelligibility(frame_table(spark, x), frame_table(spark, y), "s", span=span).collect()
    got = {r["s"]: r for r in rows}
    for s in ("a", "b"):
        count, value = loop_intelligibility(x[s], y[s], 30, 1 + 10**0.75)
        assert got[s]["segments"] == count
        assert got[s]["intelligibility"] == pytest.approx(value, abs=1e-10)
    assert got["c"]["segments"] == 0 and got["c"]["intelligibility"] is None


def test_silent_estimate_has_no_valid_segment(spark):
    x = {"x": np.random.default_rng(0).random((40, 3))}
    got = band_intelligibility(frame_table(spark, x), frame_table(spark, {"x": np.zeros((40, 3))}), "s").first()
    assert got["segments"] == 0 and got["intelligibility"] is None


def test_scores_do_not_depend_on_partitions(spark, samples, others):
    def scores(n):
        ref, est = frame_table(spark, samples).repartition(n), frame_table(spark, others).repartition(n)
        return {r["s"]: round(r["sim_o"], 10) for r in sim_o(ref, est, "s").collect()}

    assert scores(1) == scores(7)


def test_frame_numbers_may_be_of_any_integer_type(spark, samples):
    df = frame_table(spark, samples).withColumn("frame", F.col("frame").cast("int"))
    assert onset_envelope(df, "s", span=8).count() == sum(len(m) for m in samples.values())
