"""Contiguous shards of nearly equal size, cut from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetally.llm.tables import saved
from wavetally.session import shuffle_partitions

OVERHEAD = 8


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and what lies before each row of it: rows and bytes."""
    part, rows, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        ends = size + np.cumsum(sizes)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(rows + np.arange(n)), pa.array(ends - sizes)],
            names=[*batch.schema.names, "part", "rows_before", "bytes_before"],
        )
        rows += n
        size = int(ends[-1]) if n else size


def assign_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shard and slot of every document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Documents are sorted by id over range partitions. Each partition reports its total (one row), the totals are
    summed in order, and the line of all bytes is cut at ``shards`` equal targets; a document goes to the shard that
    holds its middle byte. So shards are contiguous in id order and differ from the target by less than a document.
    ``slot`` counts the rows of a shard from 0. Only ids, sizes and checksums move, never texts.

    A null text has no bytes, a null id sorts first, equal ids are ordered by checksum and size, repeated rows each
    get a slot. An empty table gives an empty one; of further columns none is read. With fewer documents than shards
    some shards stay empty.
    """
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    kind = dict(narrow.dtypes)["doc_id"]
    # the random last key, seeded, lets repeated rows spread over partitions; the table is saved, so it is drawn once
    keys = [*map(F.col, order), F.rand(7)]
    ranged = narrow.repartitionByRange(shuffle_partitions(docs.sparkSession), *keys).sortWithinPartitions(*order)
    schema = f"doc_id {kind}, size bigint, text_crc32 bigint, part int, rows_before bigint, bytes_before bigint"
    numbered = saved(ranged.mapInArrow(_running, schema), "sharding")
    # one row for each partition, however many documents
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select(
        F.col("part"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_ahead"),
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"),
        F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    middle = 2 * (F.col("bytes_ahead") + F.col("bytes_before")) + F.col("size")
    placed = numbered.join(F.broadcast(totals), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("rows_ahead") + F.col("rows_before")).alias("place"),
        middle.alias("middle"),
        "total",
    )
    # whole numbers throughout; the product stays below 2**63 up to 10**17 bytes
    placed = placed.withColumn("shard", F.expr(f"int((middle * {shards}) div (2 * total))"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
