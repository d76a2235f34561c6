"""Spelling variants of a corpus' words, joined over an index of variable-length grams.

The gram dictionary is frequency-pruned: it holds all grams of ``SHORTEST`` letters, and a longer one only if the gram
without its last letter is frequent. A word is decomposed from left to right: at each place the longest gram of the
dictionary is taken, unless the gram before it covers it. One edit at a place can change the choice of those grams only
whose surroundings reach that place; their greatest number over all places is the word's affected-gram bound. So two
words one edit apart share all but that many grams of either, and if each word lists its rarest grams, one more than
its bound, their lists meet. Words that meet at fitting places are verified.

Grams are at most half as long as the shorter word of a pair, so that no edit can reach both the first gram and the
last one; therefore every word is decomposed once for partners of its own length or longer, and once for shorter ones.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from wavetally.llm.tables import saved

#: Lengths of grams; the longest is also bounded by half the word.
SHORTEST, LONGEST = 2, 6
#: Words of fewer letters or occurrences are left out.
LEAST_LENGTH, LEAST = 6, 5
#: How many times more frequent a form is than its variant.
RATIO = 5
#: One run in so many loses a letter.
EVERY = 199
#: A gram is frequent beyond this share of the words, which bounds the number of frequent grams by that of the grams of a
#: word times its inverse, however many words there are.
FREQUENT_SHARE = 1 / 4000
#: Words or grams that are counted together before they are shuffled.
_HELD = 100_000

# a Latin-1 text: A-Z lower-cased, letters and U+00C0 to U+00FF kept, all else separates
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in Latin-1, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def misspelt(run: bytes, start: int, every: int = EVERY) -> bytes:
    """The run without one letter if ``every`` divides its CRC-32, which goes on from ``start``; else the run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least_length: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows():
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                start = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
                for r, n in Counter(runs(text.as_py() or "")).items():
                    if len(r) >= least_length:
                        held[misspelt(r, start, every)] += n
                if len(held) > _HELD:
                    yield rows()
                    held.clear()
        yield rows()

    return run


def vocabulary(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST, every: int = EVERY
) -> DataFrame:
    """``word, n``: the words of all texts with at least so many letters and occurrences.

    Counts are combined within a task before they meet. A null text has no words; a null id counts as an empty one.
    """
    parts = docs.select("doc_id", "text").mapInArrow(_counted(least_length, every), "word string, n bigint")
    whole = parts.groupBy("word").agg(F.sum("n").alias("n"))
    return whole.filter((F.col("n") >= least) & (F.length("word") >= least_length))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def rows():
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "n"]
        )

    for batch in batches:
        for word in batch.column("word").to_pylist():
            held.update({word[i : i + q] for q in range(SHORTEST, LONGEST) for i in range(len(word) - q + 1)})
            if len(held) > _HELD:
                yield rows()
                held.clear()
    yield rows()


def frequent_grams(words: DataFrame, n_words: int, share: float = FREQUENT_SHARE) -> dict[str, int]:
    """Grams that more than ``share`` of the words hold, and how many do: the inner nodes of the dictionary's trie."""
    counts = words.select("word").mapInArrow(_gram_counts, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in counts.filter(F.col("n") > max(1, int(n_words * share))).toLocalIterator()}


def decompose(word: str, longest: int, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """First and last place (exclusive) of the word's grams."""
    grams, reach, n = [], 0, len(word)
    for start in range(n - SHORTEST + 1):
        end = start + SHORTEST
        while end < n and end - start < longest and word[start:end] in frequent:
            end += 1
        if end > reach:
            grams.append((start, end))
            reach = end
    return grams


def affected(grams: list[tuple[int, int]], length: int, longest: int) -> int:
    """The most grams that one edit can change.

    What is chosen at a place depends on ``longest`` letters from there on; whether it is covered, on the letters from
    where the longest gram that covers it would start.
    """
    reached = [0] * (length + 2)
    for start, end in grams:
        reached[max(0, end - longest)] += 1
        reached[min(length, start + longest - 1) + 1] -= 1
    most = now = 0
    for change in reached:
        now += change
        most = max(most, now)
    return most


def listed(word: str, longest: int, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """Place and text of the rarest grams, one more different ones than an edit can change."""
    spans = decompose(word, longest, frequent)
    texts = {word[a:b] for a, b in spans}
    rare = sorted(texts, key=lambda g: (frequent.get(g, 0), zlib.crc32(g.encode()), g))
    keep = set(rare[: affected(spans, len(word), longest) + 1])
    return [(a, word[a:b]) for a, b in spans if word[a:b] in keep]


def _entries(frequent):
    """Index entries of each word: for partners as long or longer, and (``longer``) for those one letter shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = frequent.value

        def key(length: int, place: int, gram: str) -> int:
            return xxh3_64_intdigest(f"{length} {place} {gram}") - (1 << 63)

        for batch in batches:
            keys, rows, longer = [], [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                n = len(word)
                own = {key(n, place, g) for place, g in listed(word, min(LONGEST, n // 2), grams)}
                # a letter more before the gram moves it by one place
                other = {
                    key(n - 1, place - moved, g)
                    for place, g in listed(word, min(LONGEST, (n - 1) // 2), grams)
                    for moved in (0, 1)
                }
                keys += [*own, *other]
                rows += [i] * (len(own) + len(other))
                longer += [False] * len(own) + [True] * len(other)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(longer, pa.bool_()), batch.column("word").take(at), batch.column("n").take(at)],
                names=["key", "longer", "word", "n"],
            )

    return run


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every two words one edit apart, both ways.

    ``words`` is a saved table of different words of 4 letters or more, with their counts. The lists of the gram index
    are joined by Spark, verified where they meet, and made distinct afterwards.
    """
    spark = words.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(words, words.count()))
    entries = words.select("word", "n").mapInArrow(_entries(frequent), "key bigint, longer boolean, word string, n bigint")
    entries = saved(entries, "grams")
    a = entries.filter("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("an"))
    b = entries.select("key", F.col("word").alias("b"), F.col("n").alias("bn"), "longer")
    met = a.join(b, "key").filter(F.col("longer") | (F.col("a") < F.col("b")))
    near = met.filter(F.call_function("levenshtein", F.col("a"), F.col("b"), F.lit(1)) == 1).select("a", "an", "b", "bn").distinct()
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("near"), F.col("bn").alias("near_n")),
            F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("near"), F.col("an").alias("near_n")),
        )
    )
    return near.select(both.alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the form's form and so on, in steps that double.

    A form is at least ``RATIO`` times as frequent as its word, so chains are short (13 forms reach 10**9).
    """
    at = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = at.join(on, "root", "left")
        if further.filter("next is not null").isEmpty():
            return at
        at = saved(further.select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of :func:`vocabulary`.

    A word's form is its most frequent near word (of equals the first in code-point order) if that is at least
    ``ratio`` times as frequent; null otherwise. ``root`` is where forms lead to, ``n_near`` the number of near words.
    Of ``docs`` only ``doc_id`` and ``text`` are read. Null and empty texts have no words, an empty table gives an
    empty one; rows that repeat count each.
    """
    words = saved(vocabulary(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    out = saved(
        joined.select(
            "word",
            F.when(is_form, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(out.filter("form is not null"))
    return out.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
