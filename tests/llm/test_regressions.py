"""The two regressions: whole queries against plain versions of rules, features and likelihood, and odd rows."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from xxhash import xxh3_64_intdigest

from wavetally.llm import quality, urls
from wavetally.llm.linear import Rows, fit_ordinal

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fitting = []
    for rule in RULES:
        domain, prefix = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + prefix):
            fitting.append(rule)
    return max(fitting, key=len, default=None)


def chance(model, host, path):
    grams = {k + t[i : i + n] for k, t in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in (3, 4, 5) for i in range(len(t) - n + 1)}
    score = sum(model.weights[i] for i in {xxh3_64_intdigest(g) % 2**urls.BITS for g in grams})
    return 1 / (1 + math.exp(model.bias - score))


def test_whole_url_query_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["example.org", "A.Example.ORG", "evilexample.org", "org", "x.com", "com", "a.b.com", "b.net", "É.net", ""]
    paths = ["", "/", "/es/", "/es/a", "/en/1", "/en/12", "/en/2", "/fr/x", "/de/x", "/de", "//", "/a://b", "/\n/x"]
    tails = ["", "?q=/es/", "#/de/", "?a#b"]
    given = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(400)]
    given += [None, "", "no scheme", "://", "http://b.net/" + "long/" * 20_000] + given[:50]
    rows = [(i if i % 40 else None, u, "clash", 1.0) for i, u in enumerate(given)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, verdict string, p_block double").repartition(3)
    labelled = {(*parsed(u), RULES[r]) for u in given if (r := rule_of(*parsed(u)))}
    model = urls.fit_urls(spark.createDataFrame(sorted(labelled), "host string, path string, verdict string"))
    want = []
    for page_id, url, _, _ in rows:
        host, path = parsed(url)
        rule = rule_of(host, path)
        by_model = "block" if chance(model, host, path) > 0.5 else "allow"
        want.append((str(page_id), host, path, str(rule), RULES[rule] if rule else by_model))
    got = [(str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in urls.judge_urls(pages).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("verdict", ["block", "allow"])
def test_urls_of_one_class(spark, verdict):
    labelled = spark.createDataFrame([("a.net", f"/{i}", verdict) for i in range(20)] * 2 + [(None, "/", "block"), ("b", "/", "?")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/3"), (1, "http://a.net/3")], "page_id bigint, url string")
    assert [r.verdict for r in urls.judge_urls(pages, labelled).collect()] == [verdict] * 2
    nothing = urls.judge_urls(pages, labelled.filter("false")).collect()
    assert [(r.p_block, r.verdict) for r in nothing] == [(0.5, "allow")] * 2


def loss(features, grades, top, weights, thresholds, l2=1e-5):
    """Mean minus log likelihood, a row and a grade at a time."""
    total = 0.0
    for x, grade in zip(features, grades):
        above = [1.0] + [1 / (1 + math.exp(t - sum(weights[i] for i in x))) for t in thresholds] + [0.0]
        total -= math.log(max(above[grade] - above[grade + 1], 1e-12))
    return total / len(grades) + l2 / 2 * float(np.sum(weights**2))


@pytest.mark.parametrize("top", [1, 2, 3])
def test_fit_is_at_the_least_loss(top):
    rng = np.random.default_rng(top)
    features = [np.unique(rng.integers(0, 6, 3)) for _ in range(200)]
    grades = np.array([min(top, max(0, int(x[0] // 2 + rng.integers(-1, 2)))) for x in features])
    weights, thresholds = fit_ordinal(Rows(features, 6), grades, top)
    assert (np.diff(thresholds) > 0).all()
    best = loss(features, grades, top, weights, thresholds)
    for i in range(6 + top):
        for step in (-0.02, 0.02):
            w, t = weights.copy(), thresholds.copy()
            if i < 6:
                w[i] += step
            else:
                t[i - 6] += step
            assert loss(features, grades, top, w, t) > best - 1e-7, (i, step)


def plain_features(text):
    """Hashes of words, of token shapes with their share in tenths, and of how repetitive the text is."""
    data = text.encode()
    tokens = data.split()
    found = [b"w" + w for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), data))]
    shapes = []
    for token in tokens:
        classes = re.sub(rb"[0-9]", b"9", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[A-Z]", b"A", token)))
        shapes.append(re.sub(rb"(?s)(.)\1+", rb"\1", classes) if len(token) < 100 else b"long")
    found += [b"s%d " % (10 * shapes.count(s) // len(tokens)) + s for s in set(shapes)]
    if tokens:
        found.append(b"r%d" % (10 * max(map(tokens.count, tokens)) // len(tokens)))
        found.append(b"n%d" % (10 * sum(tokens[i] == tokens[i - 1] for i in range(1, len(tokens))) // len(tokens)))
    return sorted({xxh3_64_intdigest(f) % 2**quality.BITS for f in found})


def test_whole_quality_query_against_brute_force(spark):
    rng = random.Random(6)
    words = "the of Plain words, don't STOP now! 12 3.5 été 漢字 x__y %%% a\tb".split(" ")
    texts = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(200)]
    texts += [None, "", " \n", "x" * 300, "word " * 30_000, *texts[:20]]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, keep string").repartition(3)
    told = [(i, min(2, (texts[i] or "").count("Plain"))) for i in range(0, 200, 2)]
    labels = spark.createDataFrame([(i, g // 2 + g % 2, int(g < 2)) for i, g in told] + [(None, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit_quality(docs, quality.grades(labels))
    got = {r.doc_id: r for r in quality.graded(docs, model).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        score = sum(model.weights[f] for f in plain_features(text or ""))
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert got[i].expected_grade == pytest.approx(sum(tails), abs=1e-9)
        assert got[i].tail_probability == pytest.approx(tails[-1], abs=1e-9)
        assert got[i].keep == (got[i].tail_probability >= quality.KEEP)
    assert np.abs(model.weights).sum() > 0
