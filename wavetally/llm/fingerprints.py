"""Document fingerprints by I-Match over several randomised lexicons.

The lexicon holds the terms of a band of inverse document frequency: not those of more than ``HIGH`` of the documents,
nor those too rare to be met again. A subset of the lexicon keeps each term with a fixed chance, by a hash of the term,
so all tasks and runs draw alike. Of a document the distinct terms in a subset are sorted and hashed together. Texts
that differ in few terms share the hashes of all subsets that drew none of them; chances fall from 1 in 8 to 1 in 1,024,
so that long texts and distant versions find subsets of a fitting size.

Likeness is the share of equal hashes among the subsets of which either text holds a term.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from wavetally.llm.tables import saved
from wavetally.llm.words import alnum_words, mix, word_hashes
from wavetally.session import shuffle_partitions

#: The band, as shares of the documents that hold a term: IDF from ln 10 to ln 10,000 = 9.2.
LOW, HIGH = 1e-4, 0.1
#: The lexicon has so many terms at most (32 MB of hashes), as the band's lower end is at least the mean number of
#: different terms of a document divided by it. Documents of 400 different terms on average just keep ``LOW``.
LEXICON = 4_000_000
#: Chances of a term: 2**-3 to 2**-10, with so many subsets each.
BITS, PER_LEVEL = range(3, 11), 8
SUBSETS = len(BITS) * PER_LEVEL
# the bits of a term for subset after subset, cut from as many 64-bit hashes as it takes
_MASK = np.repeat([(1 << b) - 1 for b in BITS], PER_LEVEL).astype(np.uint64)
_WORD, _OFFSET = np.divmod(np.arange(SUBSETS), 6)
_OFFSET = (10 * _OFFSET).astype(np.uint64)
_SEEDS = mix(np.arange(1, int(_WORD[-1]) + 2, dtype=np.uint64))
#: Term hashes that are counted together before they are shuffled.
_HELD = 1_000_000


def terms(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct terms: runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return np.unique(word_hashes(list(set(alnum_words(text)))))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def rows():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    for batch in batches:
        for text in batch.column("text"):
            held.append(terms(text.as_py() or b""))
            size += len(held[-1])
            if size > _HELD:
                yield rows()
                held, size = [], 0
    if held:
        yield rows()


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band; all documents are counted, and no more than ``LEXICON`` can be in it."""
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    counts = texts.mapInArrow(_term_counts, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = saved(counts, "terms")
    n_docs, held = docs.count(), counts.agg(F.sum("n")).first()[0] or 0
    least = max(low * n_docs, held / LEXICON)
    inside = counts.filter((F.col("n") >= least) & (F.col("n") <= high * n_docs)).select("term").toPandas()
    return np.sort(inside["term"].to_numpy(np.int64).view(np.uint64))


def fingerprint(text: bytes, known: np.ndarray) -> np.ndarray:
    """A 32-bit hash for each subset, 0 where the text has none of its terms.

    A text of which no subset holds a term is hashed whole instead, so that it is like equal texts only.
    """
    found = terms(text)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        found = found[known[at] == found]
    else:
        found = found[:0]
    drawn = ((mix(found[:, None] ^ _SEEDS)[:, _WORD] >> _OFFSET) & _MASK) == 0
    subset, at = np.nonzero(drawn.T)  # by subset, terms in order
    inside = found[at].tobytes()
    ends = (8 * np.searchsorted(subset, np.arange(SUBSETS + 1))).tolist()
    out = np.zeros(SUBSETS, np.uint32)
    for j, (start, end) in enumerate(zip(ends, ends[1:])):
        if start < end:
            out[j] = (xxh3_64_intdigest(inside[start:end], j) >> 32) or 1
    if not out.any():
        out[:] = [(xxh3_64_intdigest(text, SUBSETS + j) >> 32) or 1 for j in range(SUBSETS)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    held = (a != 0) | (b != 0)
    return float(((a == b) & held).sum() / held.sum())


def edited(text: str, following: str) -> str:
    """The text, its last half (rounded down) replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "n_chars bigint, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double"


class _Row:
    """A document with its fingerprint; the text waits packed."""

    def __init__(self, doc_id, packed: bytes, known: np.ndarray):
        self.doc_id, self.packed, self.known = doc_id, packed, known
        self.print = fingerprint(self.text().encode(), known)

    def text(self) -> str:
        return zstandard.ZstdDecompressor().decompress(self.packed).decode()

    def against(self, other: _Row) -> list:
        """The columns of ``_RESULT``, ``other`` being the next document."""
        text = self.text()
        new = edited(text, other.text()).encode()
        changed = fingerprint(new, self.known)
        return [
            len(text), hashlib.sha256(new).hexdigest(), self.print.tobytes(), changed.tobytes(),
            likeness(self.print, changed), likeness(self.print, other.print),
        ]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([pack.compress(t.as_py()) for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), packed], names=["doc_id", "tie", "packed"])


_KINDS = {"n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64(), "edited_sha256": pa.string()}


def _results(ids: pa.Array, rows: list[list]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _RESULT.split(", ")]
    columns = [pa.array(c, _KINDS.get(n, pa.binary())) for n, c in zip(names, zip(*rows))]
    return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *names])


def _followed(known, kind: pa.DataType):
    """Results of rows whose next one is in the same partition; besides, its first and its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = TaskContext.get().partitionId(), None, None

        def marked(rows: pa.RecordBatch, edge: int, packed: bytes | None = None) -> pa.RecordBatch:
            n = rows.num_rows
            extra = [pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.int32()), pa.array([packed] * n, pa.binary())]
            return pa.RecordBatch.from_arrays([*extra, *rows.columns], names=["part", "edge", "packed", *rows.schema.names])

        for batch in batches:
            ids, out = [], []
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist()):
                row = _Row(doc_id, packed, known.value)
                if last is not None:
                    ids.append(last.doc_id)
                    out.append(last.against(row))
                first, last = first or row, row
            if out:
                yield marked(_results(pa.array(ids, kind), out), 0)
        for edge, row in ((1, first), (2, last)):
            if row is not None:
                blank = [None] * 6
                yield marked(_results(pa.array([row.doc_id], kind), [blank]), edge, row.packed)

    return run


def _joined(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("packed").to_pylist(), batch.column("next_packed").to_pylist())
            rows = [_Row(None, t, known.value).against(_Row(None, following, known.value)) for t, following in both]
            if rows:
                yield _results(batch.column("doc_id"), rows)

    return run


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text is :func:`edited` with the next document by ascending id, after the last with the first. Equal ids
    follow the order of a hash of their texts, null ids come first; a single row follows itself. Null texts count as
    empty; an empty table gives an empty one. Other columns are not read. Fingerprints are ``SUBSETS`` hashes of 8
    hexadecimal digits; equal texts have equal ones.

    Documents are sorted by id over range partitions, and each is compared with the next as partitions are read once.
    Only the first and last row of each partition meet afterwards. Texts move once, compressed.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    known = spark.sparkContext.broadcast(lexicon(docs, low, high))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    # packing is cheap: the search for the ranges runs it too
    packed = rows.mapInArrow(_packed, f"doc_id {kind}, tie bigint, packed binary")
    ranged = packed.repartitionByRange(shuffle_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    arrow = pa.int32() if kind == "int" else pa.string() if kind == "string" else pa.int64()
    schema = f"part int, edge int, packed binary, doc_id {kind}, {_RESULT}"
    done = saved(ranged.mapInArrow(_followed(known, arrow), schema), "fingerprints")
    # a row for each partition, whatever the number of documents
    heads = done.filter("edge = 1").select(F.col("part").alias("next_part"), F.col("packed").alias("next_packed"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("part")
    tails = done.filter("edge = 2").select("part", "doc_id", "packed")
    order = tails.select("part").select(
        "part", F.coalesce(F.lead("part").over(in_order), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next_part")
    )
    ends = tails.join(order, "part").join(heads, "next_part").mapInArrow(_joined(known), f"doc_id {kind}, {_RESULT}")
    whole = done.filter("edge = 0").select(*ends.columns).unionByName(ends)
    return whole.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
