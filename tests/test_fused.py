"""Frame scores from one pass against the operators that compute them one by one."""

from __future__ import annotations

import numpy as np
import pytest

from wavetally.operators.frames import cepstra, onset_envelope
from wavetally.operators.fused import frame_scores
from wavetally.operators.similarity import band_intelligibility, sim_o, sim_r


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(4)

    def frames(lengths, seed):
        rng = np.random.default_rng(seed)
        rows = [(k, f, rng.random(16).tolist()) for k, n in lengths.items() for f in range(n)]
        return spark.createDataFrame(rows, "k string, frame int, values array<double>").repartition(5)

    ref = frames({"a": 150, "b": 75, "short": 12, "only_ref": 5, "flat": 0}, 1)
    est = frames({"a": 130, "b": 90, "short": 40, "only_est": 50, "flat": 0}, 2)
    apart = spark.createDataFrame([("apart", 3, rng.random(16).tolist())], ref.schema)
    other = spark.createDataFrame([("apart", 9, rng.random(16).tolist())], ref.schema)
    flat = spark.createDataFrame([("flat", f, [1.0] * 16) for f in range(40)], ref.schema)
    return ref.unionByName(apart).unionByName(flat), est.unionByName(other).unionByName(flat)


@pytest.mark.parametrize("span", [31, 50, 1024])
def test_same_scores_as_one_by_one(sides, span):
    ref, est = sides
    got = {r.k: r for r in frame_scores(ref, est, "k", span=span).collect()}
    o = {r.k: (r.sim_o, r.status) for r in sim_o(cepstra(ref), cepstra(est), "k").collect()}
    r_ = {r.k: r.sim_r for r in sim_r(onset_envelope(ref, "k"), onset_envelope(est, "k"), "k").collect()}
    i = {r.k: r.intelligibility for r in band_intelligibility(ref, est, "k").collect()}
    assert got.keys() == o.keys() == {"a", "b", "short", "only_ref", "only_est", "apart", "flat"}
    for k, row in got.items():
        assert row.status == o[k][1]
        for mine, theirs in ((row.sim_o, o[k][0]), (row.sim_r, r_[k]), (row.stoi, i[k])):
            assert mine == (None if theirs is None else pytest.approx(theirs, abs=1e-9)), k
    assert got["a"].stoi is not None and got["short"].stoi is None and got["flat"].sim_r is None


def test_frames_are_shuffled_once(sides):
    """Statistics and scores start from one shuffle of the frames."""
    scored = frame_scores(*sides, "k")
    scored.collect()
    final = scored._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("Exchange hashpartitioning(k#" in line and "_ref#" in line for line in final.splitlines()) == 1
    assert "ReusedExchange" in final


def test_empty_sides(sides):
    ref, est = sides
    assert frame_scores(ref.where("false"), est.where("false"), "k").count() == 0
    assert {r.status for r in frame_scores(ref, est.where("false"), "k").collect()} == {"missing_prediction"}
