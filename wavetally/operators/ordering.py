"""Positions within groups, index ranges and seeded samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetally.operators.pairing import as_list
from wavetally.session import shuffle_partitions


_RUN = ["_row", "_run"]


def _numbered(group: Sequence[str]):
    """Adds the row's number in its partition, and that of the first row of its run of equal groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, start, last = 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = pa.table([batch.column(g) for g in group], names=list(group))
            before = own.slice(0, 1) if last is None else last
            shifted = pa.concat_tables([before, own.slice(0, n - 1)])
            new = np.zeros(n, bool)
            for g in group:
                x, y = own.column(g), shifted.column(g)
                # unequal, or only one of them null
                differs = pc.fill_null(pc.not_equal(x, y), False).to_numpy()
                new |= differs | (x.is_null().to_numpy() != y.is_null().to_numpy())
            numbers = rows + np.arange(n)
            starts = np.maximum.accumulate(np.where(new, numbers, start))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(numbers), pa.array(starts)],
                names=[*batch.schema.names, *_RUN],
            )
            rows, start, last = rows + n, int(starts[-1]), own.slice(n - 1)

    return run


def index_within(
    df: DataFrame, group: str | Sequence[str], key: str, out: str = "idx", buckets: int | None = None
) -> DataFrame:
    """Zero-based position of each row within its group, ordered by ``key``, nulls first.

    ``key`` is unique within the group. Rows are sorted in one range shuffle by
    group and key, so a large group fills several partitions, and numbered as
    they pass. Every partition reports its rows, its first and its last run of a
    group, a single row each; where a group goes on from the partition before, what
    that held of it is added. Nothing runs when the plan is built.
    """
    on = as_list(group)
    n = buckets or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *on, key).sortWithinPartitions(*on, key)
    # the number in this shuffle; that of the task is another one where a union runs both its sides in one stage
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema, *(T.StructField(c, T.LongType()) for c in _RUN)])
    numbered = ranged.mapInArrow(_numbered(on), schema)
    same = F.struct(*on)
    parts = numbered.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by(same, "_row").alias("_first"),
        F.max_by(same, "_row").alias("_last"),
        F.max("_run").alias("_start"),
    )
    in_order = Window.partitionBy(F.lit(0)).orderBy("_part")  # a row for each partition
    ahead = in_order.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce(F.col("_first").eqNullSafe(F.lag("_last").over(in_order)), F.lit(False))
    placed = parts.select(
        "_part", "_start", goes_on.alias("_goes_on"), F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead")
    )
    # where, over all rows, the partition's last run began; unknown if it has been going on since an earlier partition
    began = F.when(~F.col("_goes_on") | (F.col("_start") > 0), F.col("_ahead") + F.col("_start"))
    carried = placed.withColumn("_began", began).select(
        F.col("_part").alias("_of"),
        F.when(F.col("_goes_on"), F.col("_ahead") - F.last("_began", ignorenulls=True).over(ahead)).alias("_earlier"),
    )
    earlier = F.when(F.col("_run") == 0, F.coalesce("_earlier", F.lit(0))).otherwise(F.lit(0))
    joined = numbered.join(F.broadcast(carried), numbered["_part"] == F.col("_of"))
    return joined.withColumn(out, F.col("_row") - F.col("_run") + earlier).select(*df.columns, out)


def index_range(df: DataFrame, key: str, lo: int, hi: int) -> DataFrame:
    """Rows with ``lo <= key < hi``; the comparison reaches the file scan."""
    return df.where((F.col(key) >= lo) & (F.col(key) < hi))


def sample_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` keys that come first in the order of a seeded hash, from one read of the key column.

    Each task keeps its ``n`` smallest hashes, and so does each of a number of groups of tasks, before the last
    ones meet: nothing but ``n`` rows of a key and a hash leaves a task or a group.
    """
    hashed = df.select(sample_order(key, seed).alias("_h"), key)
    groups = shuffle_partitions(df.sparkSession)
    # the hash's end deals tasks' survivors out; Spark cuts each task's group to n rows before it moves
    place = F.row_number().over(Window.partitionBy("_group").orderBy("_h", key))
    dealt = hashed.withColumn("_group", F.conv(F.right("_h", F.lit(8)), 16, 10).cast("bigint") % groups)
    fewer = dealt.withColumn("_place", place).where(F.col("_place") <= n)
    return fewer.orderBy("_h", key).limit(n).select(key)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42, fetch: bool = False) -> DataFrame:
    """The ``n`` rows that come first in the order of a seeded hash of ``key``.

    The same rows come back for any partitioning, file order or retry; ``key``
    is unique. The table is read once, and each task sends its first ``n`` rows
    at most. Where rows are wide, ``fetch`` ranks keys alone (:func:`sample_keys`)
    and then reads the rows of the ``n`` keys, which are sent to all tasks.
    """
    if fetch:
        return df.join(F.broadcast(sample_keys(df, key, n, seed)), key, "left_semi")
    return df.orderBy(sample_order(key, seed), key).limit(n)
