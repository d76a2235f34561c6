"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from wavetally.llm.linear import Rows, fit_ordinal, sigmoid

BITS = 18
NGRAMS = (3, 4, 5)
#: At most so many labelled urls are fitted, those that hash lowest.
SAMPLE = 5_000
#: Rules as (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: str = "url") -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. A rule fits its host and all subdomains."""
    name = verdict = F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        name = F.when(fits, F.lit(domain + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def features(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of characters, of host and path apart, with their ends marked."""
    mask = (1 << BITS) - 1
    found = set()
    for kind, text in (("h", host), ("p", path)):
        text = f"^{text}$"
        for n in NGRAMS:
            found.update(xxh3_64_intdigest(kind + text[i : i + n]) & mask for i in range(len(text) - n + 1))
    return np.fromiter(sorted(found), np.int64, len(found))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def blocked(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that a url is to be blocked."""
        return sigmoid(np.array([self.weights[features(h, p)].sum() for h, p in zip(hosts, paths)]) - self.bias)


def fit_urls(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """Logistic regression on a small labelled table: ``host, path, verdict`` (allow or block).

    Equal rows count once; of more than ``sample`` those of lowest hash are used, so at most so many come to the
    driver. Rows with a null or another verdict are left out. An empty table gives a model that says one half.
    """
    known = labelled.select("host", "path", "verdict").dropna().filter(F.col("verdict").isin("allow", "block"))
    rows = (
        known.distinct().orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(sample).toPandas()
    )
    x = Rows([features(h, p) for h, p in zip(rows["host"], rows["path"])], 1 << BITS)
    weights, thresholds = fit_ordinal(x, (rows["verdict"] == "block").to_numpy(np.int64), 1)
    return UrlModel(weights, float(thresholds[0]))


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict, p_block``.

    The longest fitting rule decides; where none fits, the regression does, and blocks at a probability over one
    half. ``labelled`` is its table (``host, path, verdict``); by default the urls for which there is a rule, with
    the rule's verdict. A null url, or one without ``://``, has an empty host and path. Repeated rows are judged
    alike. Nothing is shuffled but the labelled table.
    """
    parts = pages.select("page_id", host().alias("host"), path().alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "by_rule": verdict})
    if labelled is None:
        labelled = ruled.select("host", "path", F.col("by_rule").alias("verdict"))
    shared = pages.sparkSession.sparkContext.broadcast(fit_urls(labelled))

    @F.pandas_udf("double")
    def blocked(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(shared.value.blocked(list(hosts), list(paths)))

    p = blocked("host", "path")
    by_model = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    return ruled.withColumn("p_block", p).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "p_block"
    )
