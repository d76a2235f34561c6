"""Benchmark passages in documents: windows of test words, found by hash and verified word by word."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.tables import fresh, in_small_batches, saved
from wavetally.llm.words import alnum_words, mix

WIDTH = 10
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Benchmark words that one pass over the documents holds in memory (some 100 MB); more take more passes.
PASS_WORDS = 1_000_000


class Windows:
    """The windows of some benchmark items: a vocabulary, a sorted hash list per width, and their exact words."""

    def __init__(self, items: list[tuple[object, bytes]], width: int = WIDTH):
        self.vocabulary: dict[bytes, int] = {}
        self.exact: dict[tuple[int, ...], set[int]] = {}
        self.items: list[object] = []
        for item_id, text in items:
            words = alnum_words(text)
            if not words:
                continue
            self.items.append(item_id)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            for i in range(max(1, len(ids) - width + 1)):
                self.exact.setdefault(tuple(ids[i : i + width]), set()).add(len(self.items) - 1)
        widths: dict[int, list[tuple[int, ...]]] = {}
        for window in self.exact:
            widths.setdefault(len(window), []).append(window)
        self.hashes = {n: np.unique(self._hash(np.array(w, np.int64))) for n, w in widths.items()}

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        """Of windows, one per row."""
        total = np.zeros(len(rows), np.uint64)
        for column in rows.T:
            total = mix(total + column.astype(np.uint64) + np.uint64(1))
        return total

    def find(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, spans of hit words (start, end; they may overlap) and the items with a window here."""
        words = alnum_words(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        spans, found = [], set()
        for n, known in self.hashes.items():
            if len(ids) < n:
                continue
            # starts of n known words on end
            gaps = np.concatenate([[0], np.cumsum(ids < 0)])
            starts = np.flatnonzero(gaps[n:] == gaps[:-n])
            if not len(starts):
                continue
            h = self._hash(ids[starts[:, None] + np.arange(n)])
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in starts[known[at] == h].tolist():
                items = self.exact.get(tuple(ids[i : i + n].tolist()))
                if items:  # the hash hit is verified
                    spans.append((i, i + n))
                    found |= items
        return len(words), sorted(spans), found


def _portions(benchmark: DataFrame, pass_words: int) -> Iterator[list[tuple[object, bytes]]]:
    """Items in portions of bounded size, read from Spark one after the other; an item is never split."""
    portion: list[tuple[object, bytes]] = []
    size = 0
    for row in benchmark.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).toLocalIterator():
        n = len(alnum_words(bytes(row.text)))
        if portion and size + n > pass_words:
            yield portion
            portion, size = [], 0
        portion.append((row.item_id, bytes(row.text)))
        size += n
    yield portion


def _scanner(windows: Broadcast, item_type: str):
    result = f"struct<words:bigint, spans:array<struct<start:int,end:int>>, items:array<{item_type}>>"

    @F.pandas_udf(result)
    def scan(texts: pd.Series) -> pd.DataFrame:
        known = windows.value
        rows = []
        for text in texts:
            n, spans, found = known.find(text or b"")
            rows.append((n, [{"start": a, "end": b} for a, b in spans], [known.items[k] for k in sorted(found)]))
        return pd.DataFrame(rows, columns=["words", "spans", "items"])

    return scan


def find_windows(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, pass_words: int = PASS_WORDS, name: str = "found"
) -> DataFrame:
    """``docs`` and a column ``name`` (underscores lead it where it is taken): ``STRUCT<words, spans, items>``.

    A window is ``width`` consecutive words of an item, or a whole item of fewer. ``words`` counts the document's
    words, ``spans ARRAY<STRUCT<start, end>>`` are word positions of the occurrences (they may overlap), ``items``
    the item ids that occur. The benchmark's windows go to every executor as a hash set. A benchmark beyond
    ``pass_words`` words is taken in portions: each is scanned against all documents, which are saved with what was found,
    and let go before the next is read, so that driver and executors hold one portion at a time. The scan moves no
    document. Null texts have no words, items without words no windows, an empty benchmark hits nothing; of repeated
    item ids each row counts.
    """
    spark = docs.sparkSession
    name = fresh(docs, name)
    item_type = dict(benchmark.dtypes)["item_id"]
    text = F.col("text").cast("binary")
    out, windows = in_small_batches(docs), None
    for portion in _portions(benchmark, pass_words):
        if windows is None:
            windows = spark.sparkContext.broadcast(Windows(portion, width))
            out = out.withColumn(name, _scanner(windows, item_type)(text))
            continue
        out = saved(out, "scanned")
        windows.destroy()
        windows = spark.sparkContext.broadcast(Windows(portion, width))
        more = fresh(out, "more")
        merged = F.struct(
            F.col(name)["words"].alias("words"),
            *[F.concat(F.col(name)[c], F.col(more)[c]).alias(c) for c in ("spans", "items")],
        )
        out = out.withColumn(more, _scanner(windows, item_type)(text)).withColumn(name, merged).drop(more)
    return out


def _covered(spans: pd.Series) -> pd.Series:
    """How many positions lie in at least one of the spans."""
    out = []
    for row in spans:
        end = total = 0
        for a, b in sorted((s["start"], s["end"]) for s in row):
            total += max(0, b - max(a, end))
            end = max(end, b)
        out.append(total)
    return pd.Series(out, dtype="int64")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, pass_words: int = PASS_WORDS) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    covered = F.pandas_udf(_covered, "bigint")
    narrow = docs.select("doc_id", "text")
    found = find_windows(narrow, benchmark, width, pass_words)
    names = F.array_sort(F.transform("found.items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        F.col("found.words").alias("n_words"),
        F.when(F.size("found.spans") > 0, covered("found.spans")).otherwise(F.lit(0)).cast("bigint").alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    found = find_windows(docs, benchmark, width)
    name = next(c for c in found.columns if c not in docs.columns)
    return found.filter(F.size(F.col(name)["spans"]) == 0).drop(name)


def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, cut in zip(texts, spans):
        if text is None or not len(cut):
            out.append(text)
            continue
        data = text.encode()
        at = [m.span() for m in _WORD.finditer(data)]
        kept, end = [], 0
        for a, b in sorted((s["start"], s["end"]) for s in cut):
            start, stop = at[a][0], at[b - 1][1]
            kept.append(data[end:start] if start > end else b"")
            end = max(end, stop)
        out.append((b"".join(kept) + data[end:]).decode())
    return pd.Series(out, dtype=object)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with every hit word, and what stands between hit words of one occurrence, taken out of ``text``."""
    found = find_windows(docs, benchmark, width)
    name = next(c for c in found.columns if c not in docs.columns)
    without = F.pandas_udf(_without, "string")
    return found.withColumn("text", without("text", F.col(name)["spans"])).drop(name)
