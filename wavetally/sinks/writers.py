"""Scores, sweeps and signal pairs as partitioned files, texts as a file for each key."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime
from itertools import groupby, islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.session import scratch_dir


def write_scores(scores: DataFrame, directory: str, run_ts: datetime) -> None:
    """CSV below ``run_ts=<yyyyMMdd_HHmmss>``; an empty table leaves no folder.

    Score rows are narrow next to what they were computed from, so they are
    gathered into files of the advisory size instead of one per scoring task.

    The time is an argument: the same run writes to the same place again, and
    other runs stay untouched.
    """
    # formatted here: a literal timestamp would pass through the zones of machine and session
    stamped = scores.withColumn("run_ts", F.lit(run_ts.strftime("%Y%m%d_%H%M%S")))
    (
        stamped.hint("rebalance")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", "true")
        .partitionBy("run_ts")
        .csv(directory)
    )


def write_sweep(scores: DataFrame, directory: str) -> None:
    """One CSV folder per checkpoint, all written by one job.

    The rebalance hint collects a checkpoint's rows into files of the advisory
    size and splits a checkpoint that is larger.
    """
    (
        scores.hint("rebalance", "checkpoint")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", "true")
        .partitionBy("checkpoint")
        .csv(directory)
    )


def with_audio_path(df: DataFrame, key: str = "sample_idx", side: str = "gen") -> DataFrame:
    return df.withColumn("audio_path", F.concat(F.lit(f"{side}_"), F.col(key).cast("string")))


def write_pairs(
    pairs: DataFrame,
    directory: str,
    key: str = "sample_idx",
    ref: str = "ref",
    est: str = "est",
    ref_sr: str = "ref_sr",
    est_sr: str = "est_sr",
) -> None:
    """Signals as Parquet below ``side=orig`` and ``side=gen``, in one pass over the pairs."""

    def signal(side: str, values: str, rate: str):
        return F.struct(
            F.lit(side).alias("side"),
            F.concat(F.lit(f"{side}_"), F.col(key).cast("string")).alias("audio_path"),
            F.col(values).alias("signal"),
            F.col(rate).cast("int").alias("sample_rate"),
        )

    both = F.array(signal("gen", est, est_sr), signal("orig", ref, ref_sr))
    (
        pairs.select(key, F.inline(both))
        .where(F.col("signal").isNotNull())
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("side")
        .parquet(directory)
    )


def filesystem(directory: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder as Python opens it, and the folder's path there."""
    if directory.startswith("file:"):
        directory = "/" + directory.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(directory if ":/" in directory else os.path.abspath(directory))


WRITTEN = "name string, folder string"
NAMES_AT_ONCE = 10_000
#: Rows of an Arrow batch of texts, which is held several times over: by the JVM, as Arrow, and as Python objects.
TEXTS_AT_ONCE = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _write_whole(fs: pafs.FileSystem, folder: str, name: str, pieces: Iterable[bytes]) -> None:
    """A file that appears once it is whole, also on a second attempt: readers pass over names with a dot before."""
    begun = f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(begun, compression=None) as out:
        for piece in pieces:
            out.write(piece)
    fs.move(begun, f"{folder}/{name}")


def _write_each(directory: str, suffix: str):
    """A file for each run of rows with one name, in a folder of the task; names and folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(directory)
        folder = f"part-{TaskContext.get().partitionId():05d}"
        rows = (r for b in batches for r in zip(b.column("name").to_pylist(), b.column("content")))

        def names() -> Iterator[str]:
            for i, (name, texts) in enumerate(groupby(rows, key=lambda r: r[0])):
                if not i:
                    fs.create_dir(f"{top}/{folder}")
                _write_whole(fs, f"{top}/{folder}", f"{name}{suffix}", ((t.as_py() or b"") + b"\n" for _, t in texts))
                yield name

        done = names()
        while some := list(islice(done, NAMES_AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([folder] * len(some))], names=["name", "folder"])

    return run


def _merge_each(directory: str, suffix: str):
    """One file in place of those of a name in several folders; how many fewer they are."""

    def pieces(fs: pafs.FileSystem, paths: list[str]) -> Iterator[bytes]:
        for path in paths:
            with fs.open_input_stream(path, compression=None) as part:
                while block := part.read(1 << 16):
                    yield block

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(directory)
        merged = f"{top}/merged-{TaskContext.get().partitionId():05d}"
        for b in batches:
            fewer = 0
            for name, folders in zip(b.column("name").to_pylist(), b.column("folders").to_pylist()):
                file, parts = f"{name}{suffix}", [f"{top}/{f}/{name}{suffix}" for f in folders]
                fs.create_dir(merged)
                # parts go once the merged file is whole: where it is there, an attempt before this one has made it
                if fs.get_file_info(f"{merged}/{file}").type == pafs.FileType.NotFound:
                    _write_whole(fs, merged, file, pieces(fs, parts))
                for part in fs.get_file_info(parts):
                    if part.type != pafs.FileType.NotFound:
                        fs.delete_file(part.path)
                fewer += len(parts) - 1
            yield pa.RecordBatch.from_arrays([pa.array([fewer], pa.int64())], names=["n"])

    return run


def write_texts(df: DataFrame, directory: str, key: str, text: str, suffix: str = ".txt") -> int:
    """A file ``<key>=<value>.txt`` for each value of a number ``key``, below a folder for each task; their number.

    A row is a line, a null text an empty one; rows of one key share its file, rows without a key the file ``<key>=null``.
    Tasks write the rows they have, so that no text is shuffled; only names are, to find those of several tasks, whose
    files are merged. Spark's own writer makes a folder for each value, and three processes or more for each folder on a
    local disk.
    """
    spark = df.sparkSession
    name = F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("name")
    sorted_ = df.select(key, F.col(text).cast("binary").alias("content")).sortWithinPartitions(key)
    names, batch = scratch_dir(spark, "names"), spark.conf.get(BATCH)
    if not 0 < int(batch) <= TEXTS_AT_ONCE:
        spark.conf.set(BATCH, TEXTS_AT_ONCE)
    try:
        sorted_.select(name, "content").mapInArrow(_write_each(directory, suffix), WRITTEN).write.parquet(names)
    finally:
        spark.conf.set(BATCH, batch)
    written = spark.read.schema(WRITTEN).parquet(names)
    folders = written.groupBy("name").agg(F.sort_array(F.collect_list("folder")).alias("folders"))
    merged = folders.where(F.size("folders") > 1).mapInArrow(_merge_each(directory, suffix), "n bigint")
    return written.count() - (merged.agg(F.sum("n")).first()[0] or 0)


def key_of_path(key: str, path: str = "path") -> Column:
    """The key that :func:`write_texts` put into the name of a file, null for rows without one."""
    return F.nullif(F.regexp_extract(path, rf"{key}=(-?\d+)\.[^/]*$", 1), F.lit("")).cast("bigint").alias(key)
