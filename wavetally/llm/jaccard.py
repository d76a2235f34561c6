"""Documents with similar sets of word shingles, joined by PartEnum signatures.

Two sets with a Jaccard similarity of at least the threshold differ in at most ``k`` elements, where ``k`` follows
from their sizes. Sizes are cut into bands; within a band the domain of shingles is cut into ``n1`` parts of two
halves each. Fewer than ``n1`` parts can hold two differences or more if ``2 n1 > k``, so in some part at most one
half differs: the two sets agree on the other half, and share its signature. A signature thus belongs to a subset of
one half of the two, of each part.

Halves that are empty in both sets agree as well but say nothing. Bands have some parts to spare for them; a set with
more empty halves than that has, besides, a signature for each element of its prefix, which any two such sets share.

A signature may be shared by many sets that are not similar, as passages recur. Each bucket is compared with one of
its sets first, which settles groups of near copies. Sets in buckets of which more than ``HOT`` are left then do not
meet there, but by the elements of their prefixes in order of frequency: of similar sets those prefixes have an element
in common, and it is a rare one unless the sets hold little else than what is frequent.

Sets travel for a comparison only if sketches of ``SKETCH`` bits, whether the number of elements with a hash is odd,
allow it: two sets differ in at least as many elements as their sketches in bits. Those of large sets are full and allow
everything, so sets of more than ``SKETCH`` elements have a second sketch of ``FINE`` bits, which travels for pairs that
the first one allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetally.llm.tables import in_small_batches, saved, settled, shuffles_freed, small
from wavetally.llm.words import mix, shingle_hashes, space_words, word_hashes

WORDS = 4
#: The least similarity in percent.
PERCENT = 85
#: How much longer the sets of a band get, from its first size to its last.
GROWTH = 1.3
#: The largest bucket in which sets meet by their signature alone.
HOT = 16
#: Bits of a sketch.
SKETCH = 512
#: Bits of the second sketch of a large set; as bytes an eighth of that, where an element takes 8.
FINE = 8192
#: So many elements at most, the most frequent, count as frequent; they go to every worker (4 MB).
FREQUENT = 250_000


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of the whole sequence if it has fewer words."""
    return np.unique(shingle_hashes(word_hashes(space_words(text)), words))


class Bands:
    """Sizes of the smaller set of a pair, band by band, with the number of parts that suits them."""

    def __init__(self, percent: int = PERCENT, growth: float = GROWTH):
        self.percent, self.growth = percent, growth
        self.first = [1]  # smallest size of each band
        self.shape: list[tuple[int, int]] = []  # differences allowed, parts

    def _extend(self, size: int) -> None:
        while self.first[-1] <= size:
            low = self.first[-1]
            high = max(low, int(low * self.growth))
            self.first.append(high + 1)
            # |a| + |b| - 2 overlap <= (100 - p) (|a| + |b|) / (100 + p)
            k = (100 - self.percent) * (high + high * 100 // self.percent) // (100 + self.percent)
            spare = 0
            for _ in range(3):
                parts = (k + 1 + spare + 1) // 2
                empty = 2 * parts * exp(-low / (2 * parts))
                spare = ceil(empty + 2 * sqrt(empty))
            self.shape.append((k, parts))

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(band, differences, parts) of the bands in which a set of this size may meet a partner.

        Where no difference is allowed only equal sets are similar, and those need no signature.
        """
        self._extend(size)
        least = -(-size * self.percent // 100)
        out = []
        for band in range(int(np.searchsorted(self.first, least, "right")) - 1, len(self.shape)):
            if self.first[band] > size:
                break
            k, parts = self.shape[band]
            if k:
                out.append((band, k, parts))
        return out


_BAND, _HALF = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_PREFIX, _RARE = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of a set given as sorted hashes."""
    size, out, sparse = len(elements), [], False
    weights = mix(elements)
    for band, k, parts in bands.of(size):
        halves = 2 * parts
        half = (mix(elements ^ _BAND) % np.uint64(halves)).astype(np.int64)
        order = np.argsort(half, kind="stable")
        held, starts = np.unique(half[order], return_index=True)
        sums = np.add.reduceat(weights[order], starts)
        tag = mix(np.array([band + 1], np.uint64))
        out.append(mix(mix(sums + held.astype(np.uint64) * _HALF) ^ tag))
        sparse |= halves - len(held) >= halves - k
    if sparse:
        # elements are sorted, which is the order that prefixes need
        prefix = size - -(-size * bands.percent // 100) + 1
        out.append(mix(elements[:prefix] ^ _PREFIX))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        yield doc_id, text.as_py() or b""


def _identities(words: int):
    """Size and two hashes of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, first, second = [], [], [], []
            for doc_id, text in _texts(batch):
                s = shingle_set(text, words)
                ids.append(doc_id)
                sizes.append(len(s))
                h = mix(s)
                first.append(int(h.sum(dtype=np.uint64).view(np.int64)))
                second.append(int(mix(h ^ _HALF).sum(dtype=np.uint64).view(np.int64)))
            columns = [pa.array(c, pa.int64()) for c in (ids, sizes, first, second)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "h1", "h2"])

    return run


def _signature_rows(words: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, held = [], [], 0

            def rows():
                counts = [len(f) for f in found]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(_signed(np.concatenate(found) if found else np.zeros(0, np.uint64))),
                        pa.array(np.repeat(np.array(ids, np.int64), counts)),
                    ],
                    names=["sig", "id"],
                )

            for doc_id, text in _texts(batch):
                s = np.unique(signatures(shingle_set(text, words), bands))
                ids.append(doc_id)
                found.append(s)
                held += len(s)
                if held > 200_000:
                    yield rows()
                    ids, found, held = [], [], 0
            yield rows()

    return run


_BITS = [f"bits{i}" for i in range(SKETCH // 64)]


def sketch(elements: np.ndarray, bits: int = SKETCH) -> list[int]:
    """Whether the number of elements with a hash is odd, for ``bits`` hashes, as 64-bit numbers."""
    odd = np.bincount((mix(elements) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in _texts(batch):
                s = shingle_set(text, words)
                lists = pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(_signed(s)))
                bits = [pa.array([b], pa.int64()) for b in sketch(s)]
                fine = pa.array([sketch(s, FINE) if len(s) > SKETCH else None], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), lists, pa.array([len(s)], pa.int64()), *bits, fine],
                    names=["id", "elements", "size", *_BITS, "fine"],
                )

    return run


def _element_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets hold an element, combined within the task for a million elements at a time."""
    held, size = [], 0

    def rows():
        e, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(e), pa.array(n.astype(np.int64))], names=["e", "n"])

    for batch in batches:
        held.append(batch.column("elements").flatten().to_numpy())
        size += len(held[-1])
        if size > 1_000_000:
            yield rows()
            held, size = [], 0
    if held:
        yield rows()


def _prefixes(percent: int, frequent: Broadcast):
    """A signature for each element of a set's prefix, rare elements first, with the set's size and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = frequent.value
        for batch in batches:
            ids, sizes, places, found = [], [], [], []
            for i, elements in zip(batch.column("id").to_pylist(), batch.column("elements")):
                s = elements.values.to_numpy()
                n = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    n = np.where(known[at] == s, times[at], 0)
                prefix = len(s) - -(-len(s) * percent // 100) + 1
                first = s[np.lexsort((s, n))[:prefix]].view(np.uint64)
                ids += [i] * len(first)
                sizes += [len(s)] * len(first)
                places += range(len(first))
                found.append(_signed(mix(first ^ _RARE)))
            sigs = np.concatenate(found) if found else np.zeros(0, np.int64)
            columns = [pa.array(sigs), *(pa.array(c, pa.int64()) for c in (ids, sizes, places))]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "id", "size", "place"])

    return run


def _shared(rows: DataFrame) -> DataFrame:
    """Signatures of more than one id, with the number of their rows."""
    held = rows.groupBy("sig").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    return held.filter("first < last").select("sig", "n")


def _labelled(buckets: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return buckets.withColumn("component", F.col("id"))
    names = found.select("id", F.col("component").alias("root"))
    return buckets.join(names, "id", "left").select(*buckets.columns, F.coalesce("root", "id").alias("component"))


def _still_open(buckets: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows of buckets that hold sets of more than one component."""
    labelled = _labelled(buckets, found)
    ends = labelled.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    left = labelled.join(ends.filter("low < high").select("sig"), "sig", "left_semi").select(*buckets.columns)
    return saved(left, "open")


def _by_rare_elements(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Buckets ``sig, id, size, place`` in which sets of large buckets meet by their prefixes instead, and the other ones."""
    names = ["sig", "id", "size", "place"]
    large = saved(left.groupBy("sig").count().filter(F.col("count") > HOT).select("sig"), "large")
    if large.isEmpty():
        return left.select(*names)
    hot = saved(left.join(small(large), "sig", "left_semi").select("id").distinct(), "hot")
    hot_sets = sets.join(small(hot), "id", "left_semi").select("id", "elements")
    parts = hot_sets.select("elements").mapInArrow(_element_counts, "e bigint, n bigint")
    often = parts.groupBy("e").agg(F.sum("n").alias("count")).filter(F.col("count") > HOT)
    often = often.orderBy(F.desc("count"), "e").limit(FREQUENT).toPandas().sort_values("e")
    frequent = left.sparkSession.sparkContext.broadcast((often["e"].to_numpy(np.int64), often["count"].to_numpy(np.int64)))
    schema = "sig bigint, id bigint, size bigint, place bigint"
    rare = saved(hot_sets.mapInArrow(_prefixes(percent, frequent), schema), "rare")
    rare = rare.join(_shared(rare).select("sig"), "sig", "left_semi")
    rest = left.join(small(large), "sig", "left_anti").select(*names)
    return rest.unionByName(rare.select(*names))


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every id on an edge ``a, b``: the smallest id that edges lead to.

    Large-star and small-star steps by turns: each is an aggregate and a join, and the edges, saved after every pair of
    steps, shrink to stars around the smallest ids in a number of turns that grows with the logarithm of the size.
    """
    edges = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        state = seen
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        # large star: neighbours above a node move to the smallest around it
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: a node and its neighbours below move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small_star = (
            large.join(least, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        edges = saved(small_star, "edges")


def _beside(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """The saved ``pairs`` with columns of their sets, as ``<column>_a`` and ``<column>_b``; no other sets move.

    The set of ``b`` joins first, as ``a`` may be in very many pairs.
    """
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    held = sets.join(small(wanted), "id", "left_semi")
    for side in "ba":
        pairs = pairs.join(held.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar. Pairs whose sketches differ in too many bits go before their sets are fetched."""

    def allowed(differ):
        return (100 + percent) * differ <= (100 - percent) * (F.col("size_a") + F.col("size_b"))

    sides = [sets.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("size", *_BITS))) for s in "ba"]
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _BITS), F.lit(0))
    near = saved(pairs.join(sides[0], "b").join(sides[1], "a").filter(allowed(differ)).select("a", "b"), "near")
    if near.isEmpty():
        return near
    bits = F.zip_with("fine_a", "fine_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    finely = allowed(F.aggregate(bits, F.lit(0), lambda n, m: n + m))
    near = _beside(near, sets, "size", "fine").filter(F.coalesce(finely, F.lit(True)))
    near = saved(near.select("a", "b"), "nearer")
    if near.isEmpty():
        return near
    both = _beside(near, sets, "elements")
    shared = F.size(F.array_intersect("elements_a", "elements_b"))
    union = F.size("elements_a") + F.size("elements_b") - shared
    return both.filter(100 * shared >= percent * union).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Documents link where ``100 * intersection >= percent * union`` of their sets of ``words``-word shingles; words are
    runs without ASCII white space, A-Z in lower case. ``component_id`` is the smallest id that links lead to. Null and
    empty texts have no shingles and no links. Rows of one ``doc_id`` are one document; rows without an id
    link with nothing and have no component but that of equal sets.

    Equal sets (equal size and 128-bit hash) are found by an aggregate, and one id of each takes part in the join.
    In a bucket of sets with one signature each is verified against a hub, the smallest id; members that are linked
    by then are one component and need no more comparisons. What is left of a bucket, sets in different components,
    goes through further rounds with four times as many hubs each until nothing is left to compare. So no link between
    components is lost, and large groups of near copies cost a comparison each, not one for each pair.
    """
    spark, bands = docs.sparkSession, Bands(percent)
    texts = in_small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint"
    own = saved(texts.mapInArrow(_identities(words), schema), "identities")
    key = ["n_shingles", "h1", "h2"]
    classes = own.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    members = saved(own.join(classes, key, "left").select("doc_id", "n_shingles", "rep"), "members")
    reps = members.select(F.col("rep").alias("doc_id")).distinct()
    copies = members.filter("doc_id <> rep or rep is null").select("doc_id").distinct().join(reps, "doc_id", "left_anti")
    copies = saved(copies, "copies")
    # one text of each class, none without shingles
    distinct = texts.filter("doc_id is not null").join(small(copies), "doc_id", "left_anti")

    rows = distinct.mapInArrow(_signature_rows(words, bands), "sig bigint, id bigint")
    # signatures are made and moved once
    in_bucket = Window.partitionBy("sig")
    held = rows.withColumns({"first": F.min("id").over(in_bucket), "last": F.max("id").over(in_bucket)})
    buckets = saved(held.filter("first < last").select("sig", "id").distinct(), "buckets")
    sizes = members.filter("doc_id = rep").select(F.col("rep").alias("id"), "n_shingles").distinct()
    ids = saved(buckets.select("id").distinct().join(sizes, "id"), "candidates")
    shuffles_freed(spark)  # those of the signatures
    schema = ", ".join(["id bigint", "elements array<bigint>", "size bigint", *(f"{b} bigint" for b in _BITS), "fine array<bigint>"])
    wanted = ids.select(F.col("id").alias("doc_id")).distinct()
    sets = saved(
        distinct.join(small(wanted), "doc_id", "left_semi").mapInArrow(_sets(words), schema),
        "sets",
    )

    buckets = buckets.join(small(ids), "id").select(
        "sig", "id", F.col("n_shingles").alias("size"), F.lit(0).cast("bigint").alias("place")
    )

    found = None  # id, component of ids that have links
    tested = None
    hubs_per_bucket = 1
    while True:
        labelled = _labelled(buckets, found)
        open_ = labelled.groupBy("sig").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.min("size").alias("least")
        )
        # what two sets share follows the first element they share: from there on each must hold enough for the
        # other's size; here for the smallest size that may be met
        met = F.greatest("least", F.ceil(F.col("size") * percent / 100))
        enough = (100 + percent) * (F.col("size") - F.col("place")) >= percent * (F.col("size") + met)
        left = saved(labelled.join(open_.filter("low < high"), "sig").filter(enough).drop("low", "high", "least"), "left")
        if left.isEmpty():
            break
        slot = F.pmod(F.xxhash64("id"), F.lit(hubs_per_bucket))
        hub = F.struct("id", "component", "size", "place")
        hubs = left.groupBy("sig", slot.alias("slot")).agg(F.min_by(hub, "id").alias("hub"))
        hubs = saved(hubs.select("sig", "hub"), "hubs")
        rest = F.least(F.col("size") - F.col("place"), F.col("hub.size") - F.col("hub.place"))
        pairs = (
            left.join(hubs, "sig")
            .filter(F.col("component") != F.col("hub.component"))
            .filter((100 + percent) * rest >= percent * (F.col("size") + F.col("hub.size")))
            .select(F.least("hub.id", "id").alias("a"), F.greatest("hub.id", "id").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        shuffles_freed(spark)
        links = settled(lambda pairs=pairs: _verified(pairs, sets, percent), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not links.isEmpty():
            if found is not None:  # what is known already, and new links between its components
                links = links.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b")))
            found = settled(lambda links=links: components(links), "found")
        buckets = left.drop("component").join(
            hubs.select("sig", F.col("hub.id").alias("id")), ["sig", "id"], "left_anti"
        )
        if hubs_per_bucket == 1:
            still = _still_open(buckets, found)
            buckets = settled(lambda: _by_rare_elements(still, sets, percent), "buckets")
        hubs_per_bucket *= 4

    component = F.col("rep")
    if found is not None:
        members = members.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
        component = F.coalesce("component", "rep")
    own_id = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(component)
    return members.select("doc_id", "n_shingles", own_id.alias("component_id"))


def drop_similar(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one of smallest id, with all columns; documents without words all stay.

    Of rows that repeat an id one stays. Rows without an id stay. What the comparison wrote is deleted, but for ids.
    """
    result = settled(lambda: jaccard_components(docs, words, percent), "components")
    gone = saved(result.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kind = dict(docs.dtypes)["doc_id"]
    kept = docs.join(small(gone.select(F.col("doc_id").cast(kind).alias("doc_id"))), "doc_id", "left_anti")
    kept = kept.select(*docs.columns)
    repeated = saved(result.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    again = repeated.select(F.col("doc_id").cast(kind).alias("doc_id"))
    single = kept.join(small(again), "doc_id", "left_anti").select(*docs.columns)
    # saved, as another run might choose other rows
    once = kept.join(small(again), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return single.unionByName(saved(once, "once"))
