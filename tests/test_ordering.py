"""Positions and samples read their table once, and nothing runs while the plan is built."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wavetally.operators.ordering import index_within, sample_keys, sample_order, seeded_sample


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ordering") / "t")
    spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("g"), "id"
    ).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def jobs(spark, run) -> int:
    name = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(name, "")
    run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("other", "")
    return n


def test_positions_read_once_and_lazily(spark, stored):
    assert jobs(spark, lambda: index_within(stored, "g", "id")) == 0
    plan = final_plan(index_within(stored, "g", "id"))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("buckets", [1, 2, 7, 64])
def test_positions_across_partitions(spark, buckets):
    """Groups that fill several partitions, single rows, null groups and several group columns."""
    rng = random.Random(buckets)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([1, None]), i) for i in range(500)]
    rows += [("hot", 1, 1000 + i) for i in range(800)] + [("z", 5, -4), ("z", 5, None)]
    df = spark.createDataFrame(rows, "g string, h int, k bigint").repartition(5)
    got = {(r.g, r.h, r.k): r.idx for r in index_within(df, ["g", "h"], "k", buckets=buckets).collect()}
    groups: dict = {}
    for g, h, k in rows:
        groups.setdefault((g, h), []).append(k)
    want = {(*g, k): i for g, ks in groups.items() for i, k in enumerate(sorted(ks, key=lambda k: (k is not None, k or 0)))}
    assert got == want


def test_positions_below_a_union(spark, stored):
    """A union runs its sides in one stage, where tasks of the second side have higher numbers."""
    rows = index_within(stored, "g", "id")
    even, odd = (rows.where(F.col("id") % 2 == i).select("g", "id", "idx") for i in (0, 1))
    want = sorted(map(str, rows.select("g", "id", "idx").collect()))
    assert len(want) == 5000 and sorted(map(str, even.unionByName(odd).collect())) == want


def test_sample_reads_once_and_lazily(spark, stored):
    assert jobs(spark, lambda: seeded_sample(stored, "id", 50)) == 0
    assert final_plan(seeded_sample(stored, "id", 50)).count("FileScan") == 1
    fetched = seeded_sample(stored, "id", 50, fetch=True)
    assert sorted(r.id for r in fetched.collect()) == sorted(r.id for r in seeded_sample(stored, "id", 50).collect())


@pytest.mark.parametrize("n", [0, 1, 30, 4999, 6000])
def test_sample_keys_are_the_head_of_the_hash_order(spark, stored, n):
    want = [r.id for r in stored.orderBy(sample_order("id", 3), "id").limit(n).collect()]
    assert sorted(r.id for r in sample_keys(stored, "id", n, 3).collect()) == sorted(want)
