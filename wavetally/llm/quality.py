"""Document quality by ordinal regression on graded ratings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from wavetally.llm.linear import Rows, fit_ordinal, sigmoid
from wavetally.llm.tables import in_small_batches
from wavetally.llm.words import alnum_words

BITS = 18
#: The model is fitted on at most so many rated documents, those whose ids hash lowest.
SAMPLE = 20_000
#: Words of fewer rated documents carry no weight.
LEAST_DOCS = 5
#: A feature counts if the mean grade of its documents is so many standard errors off the mean of all.
LEAST_ERRORS = 4.0
#: Documents stay if the top grade is at least so probable.
KEEP = 0.65
#: Grades of a document: 0 and 1, or 2 for one that is good in both ways.
TOP = 2

_SHAPE = bytes(
    ord("A") if 0x41 <= c <= 0x5A else ord("a") if 0x61 <= c <= 0x7A or c >= 0x80 else ord("9") if 0x30 <= c <= 0x39 else c
    for c in range(256)
)


def _shape(token: bytes) -> bytes:
    """Letter, capital and digit classes and the marks themselves, without repeats: ``Don't!!`` is ``Aa'a!``."""
    classes = token.translate(_SHAPE)
    return bytes(c for c, before in zip(classes, b"\0" + classes) if c != before)


def features(text: bytes) -> np.ndarray:
    """Hashed features of a whole text: its words, the shapes of its tokens, and how repetitive it is in tenths."""
    mask = (1 << BITS) - 1
    words, tokens = alnum_words(text), text.split()
    found = {xxh3_64_intdigest(b"w" + w) & mask for w in set(words)}
    counts: dict[bytes, int] = {}
    for t in tokens:
        counts[t] = counts.get(t, 0) + 1
    shapes: dict[bytes, int] = {}
    for t, n in counts.items():
        s = _shape(t) if len(t) < 100 else b"long"
        shapes[s] = shapes.get(s, 0) + n
    for s, n in shapes.items():
        # how common a shape is matters, not how often a long text holds it
        found.add(xxh3_64_intdigest(b"s%d " % int(10 * n / len(tokens)) + s) & mask)
    if tokens:
        found.add(xxh3_64_intdigest(b"r%d" % int(10 * max(counts.values()) / len(tokens))) & mask)
        repeats = sum(a == b for a, b in zip(tokens, tokens[1:]))
        found.add(xxh3_64_intdigest(b"n%d" % int(10 * repeats / len(tokens))) & mask)
    return np.fromiter(sorted(found), np.int32, len(found))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[bytes | None]) -> np.ndarray:
        """P(grade > j) for each text and j."""
        scores = np.array([self.weights[features(t or b"")].sum() for t in texts])
        return sigmoid(scores[:, None] - self.thresholds)


def fit_quality(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> OrdinalModel | None:
    """A model fitted on ``ratings`` (``doc_id, grade`` from 0 to ``TOP``); None if no rated document is there.

    Of larger tables the ``sample`` ratings of lowest hash are used; their number bounds what is broadcast and what
    comes to the driver, namely feature numbers, no texts. Ratings with a null are left out, repeated ones each count.
    """
    rated = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).dropna()
    drawn = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t or b"").tobytes() for t in texts], dtype=object)

    rows = (
        in_small_batches(docs).select("doc_id", "text")
        .join(F.broadcast(drawn), "doc_id")
        .select("doc_id", "grade", hashed(F.col("text").cast("binary")).alias("x"))
        .toPandas()
        .sort_values(["doc_id", "grade", "x"])
    )
    if rows.empty:
        return None
    x = Rows([np.frombuffer(b, np.int32).astype(np.int64) for b in rows["x"]], 1 << BITS)
    grade = rows["grade"].to_numpy(np.int64)
    x.frequent(LEAST_DOCS)
    x.telling(grade.astype(float), LEAST_ERRORS)
    return OrdinalModel(*fit_ordinal(x, grade, TOP))


def graded(
    docs: DataFrame,
    model: OrdinalModel | None,
    names: tuple[str, str, str] = ("expected_grade", "tail_probability", "keep"),
    keep: float = KEEP,
) -> DataFrame:
    """``docs`` with three more columns: expected grade, probability of the top grade, and whether that is at least
    ``keep``. Without a model the first two are null and everything is kept. A null text counts as empty. Columns of
    the same names are replaced."""
    if model is None:
        return docs.withColumns(dict(zip(names, (F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(True)))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<grade:double,tail:double>")
    def grade(texts: pd.Series) -> pd.DataFrame:
        tails = shared.value.tails(list(texts))
        return pd.DataFrame({"grade": tails.sum(axis=1), "tail": tails[:, -1]})

    both = names[0] + "_tail"
    while both in docs.columns:
        both = "_" + both
    out = in_small_batches(docs).withColumn(both, grade(F.col("text").cast("binary")))
    tail = F.col(both)["tail"]
    return out.withColumns(dict(zip(names, (F.col(both)["grade"], tail, tail >= keep)))).drop(both)


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from ``labels``: a point for good quality and one for no toxicity."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
