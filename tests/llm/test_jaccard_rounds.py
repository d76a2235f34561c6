"""Signatures are made once, groups of near copies need no element counts, sketches never hide a link.

Sets that no pair needs stay where they are, and what a comparison wrote goes when it has ended.
"""

from __future__ import annotations

import os
import random

import numpy as np

import corpus_pipeline
from wavetally.llm import jaccard
from wavetally.llm.tables import saved


def spied(monkeypatch):
    names = {}
    real = jaccard.saved

    def spy(df, name):
        names.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(jaccard, "saved", spy)
    return names


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)


def sets_of(texts):
    return [set(jaccard.shingle_set(t.encode()).tolist()) for t in texts]


def plain(texts, percent=85):
    """Component of each text by comparison of all pairs."""
    sets, root = sets_of(texts), list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def test_group_of_near_copies_needs_no_element_counts(spark, monkeypatch):
    rng, names = random.Random(1), spied(monkeypatch)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(60)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(table(spark, texts)).collect()}
    assert set(got.values()) == {0}
    assert "rare" not in names and "hot" not in names
    assert names["buckets"][0].count("MapInArrow") == 1 and "SortMergeJoin" not in names["buckets"][0]


def test_large_buckets_of_several_groups(spark, monkeypatch):
    """Common passages, groups of near copies and chains of them, as in a comparison of all pairs."""
    rng, names = random.Random(2), spied(monkeypatch)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for group in range(50):
        words = [f"g{rng.randrange(10**6)}" for _ in range(rng.choice([4, 12, 30]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(passage + " " + " ".join(words))
    rng.shuffle(texts)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)
    assert "rare" in names


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 300, 5000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n).astype(np.uint64)]))
        bits = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(jaccard.sketch(np.unique(a)), jaccard.sketch(b)))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist())) and bits > 0


def set_table(spark, texts):
    rows = []
    for i, text in enumerate(texts):
        s = jaccard.shingle_set(text.encode())
        fine = jaccard.sketch(s, jaccard.FINE) if len(s) > jaccard.SKETCH else None
        rows.append((i, s.view(np.int64).tolist(), len(s), *jaccard.sketch(s), fine))
    bits = ", ".join(f"{b} bigint" for b in jaccard._BITS)
    return saved(spark.createDataFrame(rows, f"id bigint, elements array<bigint>, size bigint, {bits}, fine array<bigint>"), "sets")


def test_only_sets_of_near_pairs_move(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(6)]
    texts.append(texts[0] + " end")
    sets = set_table(spark, texts)

    def verified(pairs):
        links = jaccard._verified(spark.createDataFrame(pairs, "a bigint, b bigint"), sets, 85)
        return sorted(map(tuple, links.collect())), links._jdf.queryExecution().optimizedPlan().toString()

    links, plan = verified([(0, 1), (0, 6), (2, 3), (4, 5)])
    assert links == [(0, 6)] and plan.count("LeftSemi") == 2
    links, plan = verified([(0, 1), (2, 3), (4, 5)])
    assert links == [] and "elements" not in plan


def test_large_sets_that_are_not_alike_do_not_move(spark):
    """Sketches of 512 bits allow all pairs of sets this large; the finer ones refuse those that are not alike."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    other = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    texts = [" ".join(t) for t in (base, base[:1500] + other, [f"v{w}" for w in base], base[:2950])]
    sets = set_table(spark, texts)
    links = jaccard._verified(spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a bigint, b bigint"), sets, 85)
    assert links.count() == 0 and "elements" not in links._jdf.queryExecution().optimizedPlan().toString()
    links = jaccard._verified(spark.createDataFrame([(0, 1), (0, 3), (2, 3)], "a bigint, b bigint"), sets, 85)
    assert sorted(map(tuple, links.collect())) == [(0, 3)]


def test_similar_stage_leaves_ids_only(spark, tmp_path):
    """Neither sets nor texts stay in the shared folder for the stages that follow."""
    rng, base = random.Random(5), spark.conf.get("spark.checkpoint.dir")
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(40)]
    whole = [None] * 30 + [t + " x" for t in texts[:10]]
    rows = [(i, t, w) for i, (t, w) in enumerate(zip([*texts[:30], *texts[30:]], whole))]
    rows += [(40, texts[0] + " y", None), (7, texts[7], None)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {corpus_pipeline.WHOLE} string")
    before = set(os.listdir(base))
    kept = corpus_pipeline.drop_similar(spark, saved(docs, "given"), str(tmp_path))
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(base)) - before}
    assert left <= {"given", "components", "gone", "repeated", "once"}
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))
    assert kept.columns == ["doc_id", "text"]
