"""Queries that write through the sinks and read the files back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from catalog.signals import PAIRED_SQL, si_sdr_pairs
from wavetally.functions import vectors as V
from wavetally.session import scratch_dir
from wavetally.sinks.writers import key_of_path, write_pairs, write_scores, write_sweep, write_texts
from wavetally.sources.readers import read_file_identities, read_hashed_files, read_manifest, read_predictions


@query("scores_readback", f"SELECT *, '20250131_235959' AS run_ts FROM ({PAIRED_SQL})")
def scores_readback(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "scores")
    write_scores(si_sdr_pairs(spark, sf), path, datetime(2025, 1, 31, 23, 59, 59))
    schema = "label bigint, frame bigint, si_sdr double, run_ts string"
    return spark.read.schema(schema).option("header", "true").csv(path)


@query(
    "sweep_readback",
    "SELECT conv_id, turn, length(text) AS n_chars, role AS checkpoint FROM conversations",
)
def sweep_readback(spark: SparkSession, sf: str) -> DataFrame:
    """The role of a turn stands for the checkpoint."""
    path = scratch_dir(spark, "sweep")
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.length("text").cast("bigint").alias("n_chars"), F.col("role").alias("checkpoint")
    )
    write_sweep(turns, path)
    schema = "conv_id bigint, turn bigint, n_chars bigint, checkpoint string"
    return spark.read.schema(schema).option("header", "true").csv(path)


@query(
    "pairs_readback",
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
two AS (SELECT vec_id, 'orig' AS side, 16000 AS sample_rate, x FROM s
         UNION ALL SELECT vec_id - 1, 'gen', 24000, x FROM s WHERE vec_id - 1 IN (SELECT vec_id FROM s))
SELECT vec_id AS sample_idx, side, side || '_' || vec_id AS audio_path, sample_rate,
       round(list_sum(list_transform(x, lambda v: v * v)), 6) AS energy FROM two""",
)
def pairs_readback(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "pairs")
    x = F.col("embedding").cast("array<double>")
    vectors = table(spark, sf, "embeddings")
    refs = vectors.select(F.col("vec_id").alias("sample_idx"), x.alias("ref"), F.lit(16000).alias("ref_sr"))
    ests = vectors.select((F.col("vec_id") - 1).alias("sample_idx"), x.alias("est"), F.lit(24000).alias("est_sr"))
    write_pairs(refs.join(ests, "sample_idx", "left"), path)
    saved = spark.read.schema(
        "sample_idx bigint, audio_path string, signal array<double>, sample_rate int, side string"
    ).parquet(path)
    energy = V.dot(F.col("signal"), F.col("signal"))
    return saved.select("sample_idx", "side", "audio_path", "sample_rate", rounded(energy).alias("energy"))


@query(
    "predictions_by_checkpoint",
    """SELECT role AS checkpoint, count(*) AS predictions, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM conversations GROUP BY role""",
)
def predictions_by_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "predictions")
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("hyp"), F.col("role").alias("checkpoint")
    )
    turns.write.partitionBy("checkpoint").parquet(path)
    preds = read_predictions(spark, path, "conv_id bigint, turn bigint, hyp string, checkpoint string")
    return preds.groupBy("checkpoint").agg(
        F.count(F.lit(1)).alias("predictions"), F.sum(F.length("hyp")).alias("n_chars")
    )


@query(
    "manifest",
    """SELECT conv_id AS speaker_id, turn AS chapter_id, CAST(1 AS BIGINT) AS utterance_id,
       trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, 16000 AS sample_rate,
       conv_id || '-' || turn || '-0001.flac' AS file
FROM conversations""",
)
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as transcript lines and read as a corpus."""
    return manifest_corpus(spark, sf).select(
        "speaker_id", "chapter_id", "utterance_id", "text", "sample_rate",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
    )


def manifest_corpus(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "corpus")
    line = F.concat_ws(
        " ",
        F.format_string("%d-%d-0001", "conv_id", "turn"),
        F.trim(F.regexp_replace("text", r"\s+", " ")),
    )
    table(spark, sf, "conversations").select(line.alias("value")).write.text(path)
    return read_manifest(spark, path, glob="*.txt")


@query(
    "hashed_files",
    """WITH t AS (SELECT source || ' ' || count(*) || ' ' || CAST(sum(n_chars) AS BIGINT) || chr(10) AS content
           FROM documents GROUP BY source)
SELECT CAST(length(content) AS BIGINT) AS length, md5(content) AS content_md5 FROM t""",
)
def hashed_files(spark: SparkSession, sf: str) -> DataFrame:
    """One small report file per source of documents."""
    path = scratch_dir(spark, "files")
    per_source = table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )
    line = F.concat_ws(" ", "source", F.col("n").cast("string"), F.col("chars").cast("string"))
    per_source.select(line.alias("value"), "source").write.partitionBy("source").text(path)
    return read_hashed_files(spark, path, "*.txt").select("length", "content_md5")


@query(
    "file_identities",
    """WITH f AS (SELECT page_id, encode(coalesce(html, '')) AS content FROM pages),
n AS (SELECT page_id, octet_length(content) + 1 AS length, md5(coalesce(html, '') || chr(10)) AS h
      FROM f JOIN pages USING (page_id))
SELECT page_id, CAST(length AS BIGINT) AS length,
       CASE WHEN count(*) OVER (PARTITION BY length) > 1 THEN h END AS content_md5 FROM n""",
)
def file_identities(spark: SparkSession, sf: str) -> DataFrame:
    """A file per page; only files whose length another one has are read and hashed."""
    path = scratch_dir(spark, "pages")
    pages = table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("value"))
    write_texts(pages, path, "page_id", "value")
    return read_file_identities(spark, path, "*.txt").select(key_of_path("page_id"), "length", "content_md5")
