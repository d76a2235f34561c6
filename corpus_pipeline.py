"""A corpus pipeline: every stage takes (spark, docs, sf_dir) and returns the documents it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.llm import decontamination, jaccard, linededup, pieces, quality
from wavetally.llm.tables import fresh, given, settled

#: The text before lines were dropped, null where none was; underscores lead it where ``documents`` has such a column.
WHOLE = "text_with_recurring_lines"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, accepts."""
    model = quality.fit_quality(docs, quality.grades(given(spark, sf_dir, "labels")))
    names = tuple(fresh(docs, n) for n in ("expected_grade", "tail_probability", "keep"))
    return quality.graded(docs, model, names).filter(F.col(names[2])).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has, and ``WHOLE``; those of which no word is left by that go."""
    whole = fresh(docs, WHOLE)
    cleaned = linededup.drop_recurring(docs.withColumn(whole, F.col("text")))
    dropped = cleaned.columns[-1]
    emptied = (F.col(dropped) > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    kept = cleaned.filter(~F.coalesce(emptied, F.lit(False)))
    return kept.select(*docs.columns, F.when(F.col(dropped) > 0, F.col(whole)).alias(whole))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, similarity from 0.8.

    Texts are compared as they were before lines were dropped, as fragments hide copies, and then as they are now.
    What ``drop_lines`` added is the last column of the name; a table that has not been through it is compared once.
    """
    added = [c for c in docs.columns if c.lower().lstrip("_") == WHOLE]
    if not added:
        return jaccard.drop_similar(docs)
    whole = max(added, key=len)
    before = docs.withColumns({"text": F.coalesce(whole, "text"), whole: F.col("text")})
    kept = jaccard.drop_similar(before)
    return jaccard.drop_similar(kept.withColumn("text", F.col(whole)).drop(whole))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontamination.drop_contaminated(docs, given(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    encoded = pieces.encode_texts(docs, pieces.read_model())
    return encoded.select("doc_id", "ids", "n_tokens", "n_bytes", "round_trip")


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_similar),
    ("decontamination", drop_leaks),
    ("sentencepiece", to_tokens),
]

#: The classifier and the encoder are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
