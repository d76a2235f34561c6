"""Tables between the jobs of an operator: saved, reread, and joined by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.session import scratch_dir

#: A table of at most so many bytes may be sent to every executor; larger ones are shuffled.
BROADCAST_BYTES = 16_000_000


#: Rows of an Arrow batch where texts go to Python. A text takes some kilobytes, now and then megabytes, and a batch is
#: held several times over: by the JVM, as Arrow, and as Python objects.
TEXT_ROWS = 1000


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself, whose session from now on sends at most ``TEXT_ROWS`` rows to Python at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, TEXT_ROWS)
    return df


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables saved so far in this process, names only.
_written: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again, so that later jobs do not repeat its work.

    Lost executors cost nothing: the table outlives them.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffles_freed(spark: SparkSession) -> None:
    """Shuffle files that nothing refers to any more are deleted.

    Spark removes them once the driver's garbage is collected, which is asked for here rather than left to the driver's
    need of memory.
    """
    spark.sparkContext._jvm.System.gc()


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The saved result of ``make``; what was saved on the way to it is deleted.

    So are the shuffle files of its jobs, as far as nothing refers to them any more.
    """
    start = len(_written)
    out = saved(make(), name)
    spark = out.sparkSession
    jvm = spark.sparkContext._jvm
    for path in _written[start:-1]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written[start:] = _written[-1:]
    shuffles_freed(spark)
    return out


def small(table: DataFrame, size: int | None = None) -> DataFrame:
    """A saved ``table`` with a broadcast hint if its bytes, measured here as JSON unless given, stay below the bound.

    Either way a join gives the same rows; beyond the bound Spark shuffles both sides.
    """
    if size is None:
        size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
