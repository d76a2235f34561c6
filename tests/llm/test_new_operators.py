"""Spelling variants, fingerprints and whitening against brute-force versions on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavetally.llm import fingerprints, variants, whitening

# ---- spelling variants ----------------------------------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    """One inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows: list[tuple]) -> dict[str, tuple]:
    counts: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    out, form = {}, {}
    for w in n:
        around = [v for v in n if near(v, w)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = (form[w], n[w], len(around), n[best] if form[w] else None)
    for w, (f, c, k, fn) in out.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (f, root, c, k, fn)
    return out


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    syllables = ["an", "ber", "tion", "ach", "über", "the", "ré", "ou", "aa", "÷ø"]
    stems = ["".join(rng.choices(syllables, k=rng.randint(2, 5))) for _ in range(60)]

    def slip(w: str) -> str:
        i, c = rng.randrange(len(w)), rng.choice("aeñt")
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]])

    pool = [w for s in stems for w in [s] * 12 + [slip(s) for _ in range(3)] * 2 + [slip(slip(s))]]
    rows = [(i, " ".join(rng.choices(pool, k=150))) for i in range(60)]
    pool += ["chainword"] * 250 + ["chainwordx"] * 36 + ["chainwordxy"] * 2
    long = ", ".join(rng.choices(pool, k=20_000)).upper()
    return [*rows, rows[0], rows[0], (None, rows[1][1]), (70, None), (71, ""), (72, "1 2 … 日本語"), (73, long)]


def test_variants(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, word string, n int")
    got = variants.variants(docs.repartition(3)).collect()
    want = brute_variants(rows)
    assert len(got) == len(want) > 200
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert any(f and r != f for f, r, *_ in want.values()) and any(len(w) > 12 for w in want)
    assert variants.variants(docs.filter("false")).count() == 0
    assert variants.variants(docs.filter("text is null")).count() == 0


words_of = st.text("abc", min_size=6, max_size=16)


@settings(max_examples=400, deadline=None)
@given(words_of, st.integers(0, 16), st.sampled_from("abc"), st.integers(0, 2), st.sets(st.text("abc", min_size=2, max_size=4), max_size=40))
def test_lists_of_near_words_meet(word, place, letter, kind, grams):
    """Whatever grams are frequent, two near words list a gram in common at fitting places."""
    frequent = {g: len(g) for g in grams if len(g) == 2 or g[:-1] in grams}
    place %= len(word)
    other = [word[:place] + word[place + 1 :], word[:place] + letter + word[place + 1 :], word[:place] + letter + word[place:]][kind]
    a, b = sorted((word, other), key=len)
    if a == b or len(a) < 6:
        return
    longest = min(variants.LONGEST, len(a) // 2)
    moves = (0, 1) if len(b) > len(a) else (0,)
    at = set(variants.listed(a, longest, frequent))
    assert any((p - m, g) in at for p, g in variants.listed(b, longest, frequent) for m in moves)


# ---- fingerprints ---------------------------------------------------------------------------------------------------


def plain_prints(texts: list[str], low: float, high: float) -> list[list[str]]:
    """Fingerprints subset by subset, with sets of terms in place of arrays."""
    held = [set(fingerprints.terms(t.encode()).tolist()) for t in texts]
    df = Counter(h for s in held for h in s)
    band = {h for h, n in df.items() if low * len(texts) <= n <= high * len(texts)}

    def of(text: str) -> list[str]:
        out = []
        inside = sorted(set(fingerprints.terms(text.encode()).tolist()) & band)
        for j in range(fingerprints.SUBSETS):
            mask = int(fingerprints._MASK[j]) << int(fingerprints._OFFSET[j])
            seed = fingerprints._SEEDS[fingerprints._WORD[j]]
            drawn = [h for h in inside if not int(fingerprints.mix(np.array([h], np.uint64) ^ seed)[0]) & mask]
            packed = b"".join(h.to_bytes(8, "little") for h in drawn)
            out.append((fingerprints.xxh3_64_intdigest(packed, j) >> 32 or 1) if drawn else 0)
        if not any(out):
            out = [fingerprints.xxh3_64_intdigest(text.encode(), fingerprints.SUBSETS + j) >> 32 or 1 for j in range(64)]
        return [int.to_bytes(h, 4, "little").hex() for h in out]

    return of


def brute_likeness(a: list[str], b: list[str]) -> float:
    held = [(x, y) for x, y in zip(a, b) if x != "0" * 8 or y != "0" * 8]
    return sum(x == y for x, y in held) / len(held)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(3000)]

    def prose(n):
        return " ".join(vocabulary[min(int(rng.paretovariate(0.4)), 2999)] for _ in range(n))

    out = [prose(rng.randint(5, 200)) for _ in range(120)]
    return [*out, out[0], out[0], "", "", "!!", "日本 one", prose(20_000), out[1][:-20]]


def test_fingerprints(spark, texts):
    rows = [(3 * i - 7, t or None if i % 2 else t, i) for i, t in enumerate(texts)]
    rows += [(rows[4][0], texts[4], 0), (None, texts[5], 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part int").repartition(5)
    got = fingerprints.fingerprints(docs, high=0.3).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    of = plain_prints([t or "" for _, t, _ in rows], fingerprints.LOW, 0.3)
    want = []
    for (i, t, _), (_, u, _) in zip(ordered, [*ordered[1:], ordered[0]]):
        t, u = t or "", u or ""
        half = len(t) // 2
        new = t[: len(t) - half] + u[:half]
        own, other, following = of(t), of(new), of(u)
        want.append(
            (i, len(t), hashlib.sha256(new.encode()).hexdigest(), "".join(own), "".join(other),
             brute_likeness(own, other), brute_likeness(own, following))
        )
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    by_text = {}
    for (i, t, _), row in zip(ordered, want):
        assert by_text.setdefault(t or "", row[3]) == row[3]


def test_fingerprints_of_odd_tables(spark, texts):
    docs = spark.createDataFrame([(1, "one single text")], "doc_id int, text string")
    (row,) = fingerprints.fingerprints(docs).collect()
    assert row.near_next == 1.0 and row.n_chars == 15
    assert fingerprints.fingerprints(docs.filter("false")).count() == 0
    same = docs.unionAll(docs).unionAll(docs)
    assert [r.near_next for r in fingerprints.fingerprints(same).collect()] == [1.0] * 3


def test_likeness_tells_versions_from_others(spark, texts):
    """Half of a text is shared with its edited version: closer than to another text, further than an equal one."""
    rows = [(i, t) for i, t in enumerate(texts[:120])]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    long = [r for r in got if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 3 * np.mean([r.near_next for r in long])


# ---- whitening ------------------------------------------------------------------------------------------------------


def dense(x: np.ndarray, k: int = 4):
    """Eigenvectors by a dense solver; x holds each distinct row once."""
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return n, sums, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(500, 12)) * np.linspace(3, 0.2, 12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = [(i, r.tolist(), "x") for i, r in enumerate(v.astype(np.float32))]
    rows += [(600 + i, rows[3][1], "x") for i in range(300)]  # copies count once
    odd = [None, [1.0, None] + [0.0] * 10, [float("nan")] * 12, [float("inf")] * 12, [1.0, 2.0], []]
    table = spark.createDataFrame([*rows, (None, rows[0][1], "y"), *((-1, o, "z") for o in odd)], "vec_id bigint, embedding array<float>, x string")
    got = whitening.whiten(table.repartition(7)).collect()
    x = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(int)
    n, sums, values, vectors, total = dense(np.unique(x, axis=0))
    assert n == 500 and len(got) == 4 * 801 and {r.n for r in got} == {500}
    assert got[0].identity_error < 1e-10
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for (i, *_), r in zip(rows, x)}
    want = (x - sums / n) @ vectors / np.sqrt(values)
    place = {i: j for j, (i, *_) in enumerate(rows)}
    signs = {}
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / total, rel=1e-10)
        j = 0 if r.vec_id is None else place[r.vec_id]
        assert r.deviation == exact[rows[j][0]]
        sign = signs.setdefault(r.component, np.sign(r.whitened * want[j, r.component - 1]))
        assert sign * r.whitened == pytest.approx(want[j, r.component - 1], abs=1e-9)


def test_whitening_of_odd_tables(spark):
    def run(vectors):
        return whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id int, embedding array<double>")).collect()

    assert run([]) == [] and run([None, []]) == [] and run([[1.0, 2.0]] * 9) == []
    two = run([[0.0, 1.0, 5.0], [4.0, 1.0, 5.0], [0.0, 1.0, 5.0]])  # a single direction with variance
    assert [(r.component, r.explained) for r in two] == [(1, 1.0)] * 3
    assert sorted(abs(r.whitened) for r in two) == pytest.approx([1, 1, 1])
    far = run([[1e30, 0.0], [-1e30, 1.0], [0.0, 2.0]])
    assert {r.deviation for r in far if r.vec_id < 2} == {None} and far[0].identity_error < 1e-6
    tied = run(np.vstack([np.eye(5), -np.eye(5)]).tolist())
    assert len(tied) == 40 and tied[0].identity_error < 1e-10


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9), st.integers(0, 10**6), st.sampled_from([1.0, 1e-3, 1e-9, 0.0]))
def test_solver(d, seed, scale):
    rng = np.random.default_rng(seed)
    r = np.triu(rng.integers(-3, 4, (d, d))) * np.where(rng.random(d) < 0.5, scale, 1.0)
    diagonal, above, v = whitening.bidiagonal(r)
    b = np.diag(diagonal) + np.diag(above, 1)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-12) and np.allclose(v @ b.T @ b @ v.T, r.T @ r, atol=1e-10)
    values = whitening.dqds(diagonal, above)
    s = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(np.sqrt(values), s, atol=1e-12 * max(1, s.max()))
    w = whitening.solve(r.astype(float), 1, [0] * d, d)
    at = w.directions
    assert np.allclose(at.T @ at, np.eye(at.shape[1]), atol=1e-8)
    assert np.allclose(r.T @ r @ at, at * w.values, atol=1e-7 * max(1, s.max() ** 2))


def test_small_values_are_accurate():
    """Bidiagonal matrices give their singular values to full relative accuracy, however small."""
    diagonal, above = 10.0 ** -np.arange(0, 30, 2), 10.0 ** -np.arange(1, 29, 2)
    got = np.sqrt(whitening.dqds(diagonal, above))
    assert got.prod() == pytest.approx(diagonal.prod(), rel=1e-12)  # the determinant, 1e-210
