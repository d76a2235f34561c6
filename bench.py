"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import catalog  # noqa: E402
from wavetally.functions.edits import long_edit_distance  # noqa: E402
from wavetally.session import configure  # noqa: E402

HEADLINE = [
    "cer_turns",
    "wer_turns",
    "corpus_error_rate",
    "wer_summary",
    "batch_eval",
    "corpus_eval",
    "sweep_summary",
    "si_sdr_pairs",
    "si_sdr_long",
    "si_sdr_segments",
    "one_reference_many_estimates",
    "znorm_frames",
    "onset_envelope",
    "cepstra",
    "sim_o",
    "sim_r",
    "band_intelligibility",
    "tts_scores",
    "token_roundtrip",
    "codebooks",
    "index_within",
    "seeded_sample",
    "memo_todo",
    "memo_hits",
    "metadata_join",
    "pair_status",
    "duplicate_keys",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.QUERIES
    # session start: the JVM's first job and the Python workers are not part of a query
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    texts = spark.range(0, 64, 1, int(cpus)).select(F.col("id").cast("string").alias("t"))
    texts.select(long_edit_distance("t", "t")).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
