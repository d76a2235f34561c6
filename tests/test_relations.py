"""Pairing, ordering, samples, memo and summaries."""

from __future__ import annotations

import hashlib
import math
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetally.operators.joins import hot_key_join, spread_join
from wavetally.operators.memo import HASH, memo_merge, memo_split, with_request_hash
from wavetally.operators.ordering import index_range, index_within, seeded_sample
from wavetally.operators.pairing import (
    fill_sentinels,
    pair,
    split_status,
    union_runs,
    validate_samples,
    with_batch_metadata,
    with_sample_metadata,
)
from wavetally.operators.summary import compare_checkpoints, summarise


def test_pair_reports_both_sides(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b")], "id int, ref string")
    preds = spark.createDataFrame([(2, "x"), (3, "y")], "id int, hyp string")
    got = {r["id"]: r["status"] for r in pair(refs, preds, "id").collect()}
    assert got == {1: "missing_prediction", 2: "ok", 3: "missing_reference"}
    ok, rejected = split_status(pair(refs, preds, "id"))
    assert ok.count() == 1 and rejected.count() == 2
    assert [tuple(r) for r in pair(refs, preds, "id", keep_unmatched=False).collect()] == [(2, "b", "x", "ok")]


def test_clashing_columns_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    with pytest.raises(ValueError, match="v"):
        pair(df, df, "id")
    with pytest.raises(ValueError, match="v"):
        with_batch_metadata(df, {"v": 1})
    with pytest.raises(ValueError, match="v"):
        with_sample_metadata(df, df, "id")


def test_metadata_keeps_scores_without_a_match(spark):
    scores = spark.createDataFrame([(1, 0.5), (2, 0.7)], "sample_idx bigint, wer double")
    meta = spark.createDataFrame([(2, 84)], "sample_idx bigint, speaker_id bigint")
    got = with_sample_metadata(scores, meta)
    assert got.schema["speaker_id"].dataType == T.LongType()
    assert {r["sample_idx"]: r["speaker_id"] for r in got.collect()} == {1: None, 2: 84}
    labelled = with_batch_metadata(got, {"dataset": "d", "n": 3}).first()
    assert labelled["dataset"] == "d" and labelled["n"] == 3


def test_validation(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id bigint, text string")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    assert [(r["id"], r["copies"]) for r in validate_samples(df, schema, "id").collect()] == [(1, 2)]
    with pytest.raises(ValueError, match="audio"):
        validate_samples(df, schema.add("audio", T.StringType()), "id")
    with pytest.raises(ValueError, match="expected int"):
        validate_samples(df, T.StructType([T.StructField("id", T.IntegerType())]), "id")


def test_sentinels(spark):
    df = spark.createDataFrame([(None, None), (1.5, 2.0)], "wer double, si_sdr double")
    assert [tuple(r) for r in fill_sentinels(df, ["wer", "si_sdr"]).collect()] == [(-1.0, -math.inf), (1.5, 2.0)]


def test_union_of_runs(spark):
    a = spark.createDataFrame([(1, "t")], "id int, text string")
    b = spark.createDataFrame([(2, 0.5)], "id int, wer double")
    rows = union_runs(first=a, second=b).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("first", 1, "t", None), ("second", 2, None, 0.5)]


@pytest.mark.parametrize("buckets", [1, 2, 16, 200])
def test_index_within_a_group_that_owns_most_rows(spark, buckets):
    keys = [("hot", i * 7 % 1009) for i in range(1000)] + [("cold", i) for i in range(0, 90, 9)] + [("one", 5)]
    df = spark.createDataFrame(keys, "g string, k bigint").repartition(5)
    got = {(r["g"], r["k"]): r["idx"] for r in index_within(df, "g", "k", buckets=buckets).collect()}
    for group in ("hot", "cold", "one"):
        ordered = sorted(k for g, k in keys if g == group)
        assert [got[(group, k)] for k in ordered] == list(range(len(ordered)))


@pytest.fixture
def fixed_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def largest_share(df) -> float:
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts)


def test_hot_group_is_numbered_by_several_tasks(spark, fixed_partitions):
    df = spark.range(4000).select(F.when(F.col("id") >= 0, F.lit("hot")).alias("g"), F.col("id").alias("k"))
    assert largest_share(index_within(df, "g", "k", buckets=16)) < 0.6


def test_hot_key_is_joined_by_several_tasks(spark, fixed_partitions):
    many = spark.range(4000).select((F.col("id") % 2 * 0).alias("k"), "id")
    one = spark.range(1).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    joined = hot_key_join(many, one, "k", "id", rows_per_copy=100)
    assert joined.count() == 4000
    assert largest_share(joined) < 0.6


def test_long_sample_is_joined_by_several_tasks(spark, fixed_partitions):
    rows = spark.range(4000).select((F.col("id") * 0).alias("k"), F.col("id").alias("pos"))
    per_key = rows.groupBy("k").agg(F.max("pos").alias("last"))
    assert largest_share(spread_join(rows, per_key, "k", "pos", "last", span=100)) < 0.6


def test_index_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "g string, k bigint")
    assert index_within(empty, "g", "k").count() == 0


@pytest.mark.parametrize("n", [0, 1, 50, 999, 1000, 5000])
def test_seeded_sample_is_the_head_of_the_hash_order(spark, n):
    ids = list(range(1000))
    expected = sorted(ids, key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())[:n]
    for parts in (1, 6):
        df = spark.createDataFrame([(i, "x" * 50) for i in ids], "id bigint, t string").repartition(parts)
        assert sorted(r["id"] for r in seeded_sample(df, "id", n, 7).collect()) == sorted(expected)


def test_other_seed_other_rows(spark):
    df = spark.range(1000)
    first = {r["id"] for r in seeded_sample(df, "id", 20, 1).collect()}
    assert len(first) == 20 and first != {r["id"] for r in seeded_sample(df, "id", 20, 2).collect()}


def test_index_range_reaches_the_scan(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = index_range(spark.read.parquet(str(tmp_path / "t")), "id", 600, 801)
    assert df.count() == 201
    assert "GreaterThanOrEqual(id,600)" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("span", [1, 10, 1000])
def test_spread_join_matches_every_row(spark, span):
    rows = spark.createDataFrame([("a", i) for i in range(95)] + [("b", 3)], "k string, pos int")
    per_key = spark.createDataFrame([("a", 1.0, 94), ("b", 2.0, 3)], "k string, v double, last int")
    got = spread_join(rows, per_key, "k", "pos", "last", span)
    assert got.columns == ["k", "pos", "v"]
    assert sorted((r["k"], r["pos"], r["v"]) for r in got.collect()) == [("a", i, 1.0) for i in range(95)] + [("b", 3, 2.0)]


def test_memo(spark):
    texts = ["same"] * 300 + [f"t{i}" for i in range(30)] + [None]
    requests = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string").repartition(6)
    memo = (
        with_request_hash(requests.where("text in ('same', 't3')"), ["text"])
        .select(HASH, F.col("text").alias("result"))
        .distinct()
    )
    todo, hits = memo_split(requests, memo, ["text"], "id", rows_per_copy=20)
    assert sorted(r["id"] for r in todo.collect()) == [i for i, t in enumerate(texts) if t not in ("same", "t3")]
    found = hits.collect()
    assert len(found) == 301 and {r["result"] for r in found} == {"same", "t3"}
    assert sorted(r["id"] for r in found) == [*range(300), 303]


def test_todo_keeps_the_smallest_key_of_equal_requests(spark):
    requests = spark.createDataFrame([(9, 1, "x"), (4, 2, "x"), (4, 1, "x")], "a int, b int, text string")
    memo = spark.createDataFrame([], f"{HASH} string, result string")
    todo, _ = memo_split(requests, memo, ["text"], ["a", "b"])
    assert [(r["a"], r["b"]) for r in todo.collect()] == [(4, 1)]


def test_merge_keeps_old_results(spark):
    memo = spark.createDataFrame([("h1", "old")], f"{HASH} string, result string")
    new = spark.createDataFrame([("new", "h1"), ("b", "h2"), ("a", "h2")], f"result string, {HASH} string")
    got = {r[HASH]: r["result"] for r in memo_merge(memo, new).collect()}
    assert got == {"h1": "old", "h2": "a"}


def test_summary(spark):
    values = [1.0, 2.0, 4.0]
    df = spark.createDataFrame(
        [("x", v, "ok") for v in values] + [("x", math.nan, "ok"), ("x", None, "bad"), ("y", 5.0, "ok")],
        "g string, wer double, status string",
    )
    got = {r["g"]: r for r in summarise(df, ["wer"], "g").collect()}
    x = got["x"]
    assert x["mean"] == pytest.approx(statistics.mean(values)) and x["std"] == pytest.approx(statistics.stdev(values))
    assert (x["n"], x["n_nan"], x["n_ok"], x["n_rejected"]) == (3, 1, 4, 1)
    assert got["y"]["mean"] == 5.0 and got["y"]["std"] is None


def test_infinities_stay_in_the_mean(spark):
    df = spark.createDataFrame([(-math.inf,), (1.0,)], "si_sdr double")
    row = summarise(df, ["si_sdr"]).first()
    assert row["mean"] == -math.inf and math.isnan(row["std"])


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "wer double, cer double")
    rows = summarise(empty, ["wer", "cer"]).collect()
    assert {r["metric"]: r["n"] for r in rows} == {"wer": 0, "cer": 0}


def test_checkpoints_are_sorted(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 3.0), ("b", 2.0)], "checkpoint string, wer double")
    assert [(r["checkpoint"], r["mean"]) for r in compare_checkpoints(df, ["wer"]).collect()] == [("a", 3.0), ("b", 1.5)]
