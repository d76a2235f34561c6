"""Transcripts, content hashes and predictions as DataFrames."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetally.session import scratch_dir, shuffle_partitions
from wavetally.sinks.writers import filesystem

#: Spark's folder of rows without a value.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
UTTERANCE_LINE = r"^(\d+)-(\d+)-(\d+)\s+(.*)$"  # fixed format: speaker-chapter-utterance text


def read_manifest(
    spark: SparkSession,
    directory: str,
    sample_rate: int = 16000,
    suffix: str = ".flac",
    glob: str = "*.trans.txt",
) -> DataFrame:
    """Utterances of a corpus tree ``speaker/chapter/*.trans.txt``.

    One row per line; ``path`` is where the audio of the utterance lies,
    relative to its transcript's folder. :func:`rejected_lines` returns the
    lines that have no row here.
    """
    lines = _transcript_lines(spark, directory, glob).where(F.col("value").rlike(UTTERANCE_LINE))

    def part(i: int):
        return F.regexp_extract("value", UTTERANCE_LINE, i)

    return lines.select(
        part(1).cast("bigint").alias("speaker_id"),
        part(2).cast("bigint").alias("chapter_id"),
        part(3).cast("bigint").alias("utterance_id"),
        part(4).alias("text"),
        F.lit(sample_rate).alias("sample_rate"),
        F.concat(
            F.regexp_replace("_file", r"[^/]+$", ""),
            F.regexp_extract("value", r"^(\S+)", 1),
            F.lit(suffix),
        ).alias("path"),
    )


def _transcript_lines(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(directory)
        .select("value", F.col("_metadata.file_path").alias("_file"))
    )


def rejected_lines(spark: SparkSession, directory: str, glob: str = "*.trans.txt") -> DataFrame:
    """(file, line) of transcript lines that are no utterance: another form, or an id without a text.

    Blank lines are left out.
    """
    lines = _transcript_lines(spark, directory, glob)
    kept = ~F.col("value").rlike(UTTERANCE_LINE) & F.col("value").rlike(r"\S")
    return lines.where(kept).select(F.col("_file").alias("file"), F.col("value").alias("line"))


def _files(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", glob).load(directory)


#: A name below a folder that was asked for; whether it is a folder too, whose names are still to be listed.
FOUND = "root string, name string, folder boolean"
LISTED_AT_ONCE = 10_000
READ_AT_ONCE = 1 << 16


def _folders(spark: SparkSession, directory: str) -> list[str]:
    """The folders that ``directory`` names, which may be a pattern; none where it names a file, or a store that Python cannot open."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(directory)
    found = list(at.getFileSystem(conf).globStatus(at) or [])
    if not all(f.isDirectory() for f in found):
        return []
    folders = [f.getPath().toString().rstrip("/") for f in found]
    try:
        for folder in folders:
            filesystem(folder)
    except (pa.ArrowException, OSError):
        return []
    return folders


def _passed_over(name: str, folder: bool) -> bool:
    """Names that Spark's scan leaves out."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _names(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder and whether they are folders: on a disk one at a time, elsewhere the folder's at once."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder or "/") as entries:
            for e in entries:
                if e.is_dir() or e.is_file():
                    yield e.name, e.is_dir()
    else:
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.type in (pafs.FileType.File, pafs.FileType.Directory):
                yield info.base_name, info.type == pafs.FileType.Directory


def _listing(pattern: str, deep: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts what lies in a folder in its place, with ``deep`` all files below it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, opened = re.compile(pattern, re.DOTALL).fullmatch, cache(filesystem)

        def below(fs: pafs.FileSystem, top: str, root: str, at: str) -> Iterator[tuple[str, str, bool]]:
            for name, folder in _names(fs, f"{top}/{at}" if at else top):
                path = f"{at}/{name}" if at else name
                if _passed_over(name, folder):
                    continue
                if folder and deep:
                    yield from below(fs, top, root, path)
                elif folder or wanted(name):
                    yield root, path, folder

        def found() -> Iterator[tuple[str, str, bool]]:
            for b in batches:
                for root, name, folder in zip(*(c.to_pylist() for c in b.columns)):
                    if folder:
                        yield from below(*opened(root), root, name)
                    else:
                        yield root, name, folder

        rows = found()
        while some := list(islice(rows, LISTED_AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some)], names=["root", "name", "folder"])

    return run


def _hash_each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path, length and md5 of listed files, read in blocks."""
    opened = cache(filesystem)
    for b in batches:
        paths, lengths, digests = [], [], []
        for root, name in zip(b.column("root").to_pylist(), b.column("name").to_pylist()):
            fs, top = opened(root)
            digest, length = hashlib.md5(usedforsecurity=False), 0
            # not unpacked, whatever the name ends in
            with fs.open_input_stream(f"{top}/{name}", compression=None) as file:
                while block := file.read(READ_AT_ONCE):
                    digest.update(block)
                    length += len(block)
            if length:
                paths.append(f"{root}/{name}")
                lengths.append(length)
                digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string())],
            names=["path", "length", "content_md5"],
        )


def read_hashed_files(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """Path, length and md5 of each file's bytes. Empty files are not listed, nor names that Spark's scan passes over.

    Tasks list folders and read files, each as many: one the folder itself, others what lies below its folders. So the
    driver holds no file, and the number of tasks does not grow with theirs. Files are those there when a job runs. Where Python cannot open the store, and
    for paths of single files, Spark's scan does it, with every file in the driver's memory and a task for some.
    """
    folders = _folders(spark, directory)
    if not folders:
        return _files(spark, directory, glob).select("path", "length", F.md5("content").alias("content_md5"))
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    n = shuffle_partitions(spark)
    asked = spark.createDataFrame([(f, "", True) for f in folders], FOUND)
    first = asked.mapInArrow(_listing(pattern, deep=False), FOUND).repartition(n, "root", "name")
    found = first.mapInArrow(_listing(pattern, deep=True), FOUND).repartition(n, "root", "name")
    return found.mapInArrow(_hash_each, "path string, length bigint, content_md5 string")


#: Colliding lengths are told to the scan as ranges: at most so many for each doubling of the length, some 500 in all.
RANGES_PER_DOUBLING = 8


def read_file_identities(
    spark: SparkSession, directory: str, glob: str = "*", known: DataFrame | None = None
) -> DataFrame:
    """Path, length and md5 of files, the md5 only where another file has the same length, else NULL.

    Files of different lengths differ, so bytes are read for lengths that at least two files share, or that
    ``known`` (a column ``length``, of files hashed before) has. Lengths come from the listing, which is saved below the
    shared folder, as a scan of very many files has very many tasks. The scan skips files by ranges of lengths, so that a few more may be read than collide; what it tells of them is NULL all the same. Only
    the bounds of the ranges reach the driver. Empty files are not listed.
    """
    files = _files(spark, directory, glob)
    listing = scratch_dir(spark, "listing")
    files.select("path", "length").write.parquet(listing)
    listed = spark.read.schema("path string, length bigint").parquet(listing)
    again = listed.groupBy("length").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("length")
    if known is not None:
        before = known.select(F.col("length").cast("bigint").alias("length"))
        again = again.unionByName(listed.select("length").join(before, "length", "left_semi"))
    again = again.distinct()
    step = F.floor(F.log2(F.col("length").cast("double")) * RANGES_PER_DOUBLING)
    spans = again.groupBy(step).agg(F.min("length").alias("low"), F.max("length").alias("high")).collect()
    wanted = F.lit(False)
    for span in spans:
        wanted |= (F.col("length") >= span["low"]) & (F.col("length") <= span["high"])
    # hashed before the join: bytes are never shuffled
    hashed = files.where(wanted).select("path", "length", F.md5("content").alias("content_md5"))
    alone = listed.join(again, "length", "left_anti").withColumn("content_md5", F.lit(None).cast("string"))
    names = ["path", "length", "content_md5"]
    return hashed.join(again, "length", "left_semi").select(names).unionByName(alone.select(names))


def read_predictions(spark: SparkSession, directory: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Predictions of all checkpoints below ``checkpoint=<name>/``, as one table.

    A filter on ``checkpoint`` prunes folders. The column is read as text even
    when every name looks like a number.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(directory)
    if "checkpoint" not in df.columns:
        raise ValueError(f"no checkpoint=<name> folders below {directory}")
    if df.schema["checkpoint"].dataType == T.StringType():
        return df
    # folder names that look like numbers: read as text from the start, as 0010 and 10 differ
    fields = [f for f in df.schema if f.name != "checkpoint"]
    text = T.StructType([*fields, T.StructField("checkpoint", T.StringType())])
    return spark.read.schema(text).parquet(directory)


def checkpoints(predictions: DataFrame) -> DataFrame:
    """Names of the checkpoints, sorted."""
    return predictions.select("checkpoint").distinct().orderBy("checkpoint")


def checkpoint_folders(spark: SparkSession, directory: str) -> list[str]:
    """Names of the checkpoints that have a file in ``checkpoint=<name>/`` below ``directory``, sorted.

    Folders are listed and no rows are read, so a checkpoint whose files hold no row is found too. None where
    ``directory`` does not exist. A sweep has as many names as folders, few enough for the driver.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(directory)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return []
    names = []
    for folder in fs.listStatus(at):
        column, _, name = folder.getPath().getName().partition("=")
        if column != "checkpoint" or not folder.isDirectory() or name == NULL_FOLDER:
            continue
        if any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(folder.getPath())):
            names.append(unquote(name))
    return sorted(names)


def read_stored(
    spark: SparkSession, path: str, schema: T.StructType | str, form: str = "parquet", **options: str
) -> DataFrame:
    """What jobs stored below ``path``, an empty table where none has yet. Partition columns are part of ``schema``."""
    try:
        return spark.read.schema(schema).format(form).options(**options).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
