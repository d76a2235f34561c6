"""Signal queries. An embedding is a signal of 64 samples, the next of its label an estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from wavetally.functions import vectors as V
from wavetally.operators.ordering import index_within
from wavetally.operators.pairing import pair
from wavetally.operators.signal import (
    align_pairs,
    first_channel,
    one_reference_many_estimates,
    si_sdr,
    si_sdr_long,
    si_sdr_segments,
)

FRAMES_SQL = """
frames AS (
  SELECT CAST(label AS BIGINT) AS label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id,
         list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
fl AS (SELECT label, frame, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM frames)"""

SI_SDR_SQL = """
alpha AS (SELECT label, frame, sum(r * e) / sum(r * r) AS a FROM p GROUP BY label, frame),
ratio AS (SELECT p.label, p.frame, 10 * log10(sum(a * r * a * r) / sum((e - a * r) * (e - a * r))) AS si_sdr
          FROM p JOIN alpha ON p.label = alpha.label AND p.frame = alpha.frame GROUP BY p.label, p.frame)"""

PAIRED_SQL = f"""WITH {FRAMES_SQL},
p AS (SELECT a.label, a.frame, a.v AS r, b.v AS e
      FROM fl a JOIN fl b ON b.label = a.label AND b.frame = a.frame + 1 AND b.i = a.i), {SI_SDR_SQL}
SELECT label, frame, round(si_sdr, 6) + 0.0 AS si_sdr FROM ratio"""

PAIR = ["label", "frame"]


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """(label, frame, vec_id, values): the vectors of a label in id order."""
    vectors = table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("label"),
        "vec_id",
        F.col("embedding").cast("array<double>").alias("values"),
    )
    return index_within(vectors, "label", "vec_id", "frame")


def signal_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(label, frame, ref, est): each vector with the next one of its label."""
    rows = frames(spark, sf)
    refs = rows.select(*PAIR, F.col("values").alias("ref"))
    ests = rows.select("label", (F.col("frame") - 1).alias("frame"), F.col("values").alias("est"))
    return pair(refs, ests, PAIR, keep_unmatched=False)


@query("si_sdr_pairs", PAIRED_SQL)
def si_sdr_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return si_sdr(signal_pairs(spark, sf)).select(*PAIR, rounded("si_sdr").alias("si_sdr"))


@query("si_sdr_long", PAIRED_SQL)
def si_sdr_per_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same pairs stored with one row per sample."""
    long = signal_pairs(spark, sf).select(*PAIR, F.posexplode("ref").alias("t", "r"), "est")
    samples = long.select(*PAIR, "t", F.col("r").alias("ref"), F.col("est")[F.col("t")].alias("est"))
    return si_sdr_long(samples, PAIR, span=16).select(*PAIR, rounded("si_sdr").alias("si_sdr"))


@query(
    "si_sdr_segments",
    f"""WITH {FRAMES_SQL},
p AS (SELECT a.label, 0 AS frame, a.v AS r, b.v AS e
      FROM fl a JOIN fl b ON b.label = a.label + 5 AND b.frame = a.frame AND b.i = a.i), {SI_SDR_SQL}
SELECT label, round(si_sdr, 6) + 0.0 AS si_sdr FROM ratio""",
)
def si_sdr_of_segmented_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Labels 0-4 against 5-9; the vectors of a label are the segments of one long signal."""
    rows = frames(spark, sf)
    refs = rows.where("label < 5").select(*PAIR, F.col("values").alias("ref"))
    ests = rows.where("label >= 5").select(
        (F.col("label") - 5).alias("label"), "frame", F.col("values").alias("est")
    )
    segments = pair(refs, ests, PAIR, keep_unmatched=False)
    return si_sdr_segments(segments, "label", "frame").select("label", rounded("si_sdr").alias("si_sdr"))


@query(
    "si_sdr_unequal",
    f"""WITH {FRAMES_SQL},
cut AS (SELECT label, frame, list_filter(x, lambda v: abs(v) >= 0.02) AS x FROM frames),
cl AS (SELECT label, frame, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM cut),
p AS (SELECT a.label, a.frame, a.v AS r, b.v AS e
      FROM fl a JOIN cl b ON b.label = a.label AND b.frame = a.frame + 1 AND b.i = a.i), {SI_SDR_SQL},
n AS (SELECT label, frame, count(*) AS samples FROM p GROUP BY label, frame)
SELECT label, frame, samples, round(si_sdr, 6) + 0.0 AS si_sdr FROM ratio JOIN n USING (label, frame)""",
)
def si_sdr_unequal(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates without their near-silent samples, so lengths differ."""
    shortened = signal_pairs(spark, sf).withColumn(
        "est", F.filter("est", lambda v: F.abs(v) >= 0.02)
    )
    scored = si_sdr(align_pairs(shortened).withColumn("samples", F.size("ref").cast("bigint")))
    return scored.select(*PAIR, "samples", rounded("si_sdr").alias("si_sdr"))


@query(
    "si_sdr_turns",
    """WITH s AS (SELECT conv_id, turn, unnest(range(1, length(text) + 1)) AS i,
             unnest(list_transform(range(1, length(text) + 1), lambda k: CAST(unicode(substr(text, k, 1)) AS DOUBLE))) AS v
      FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.v AS r, b.v AS e
      FROM s a JOIN s b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.i = a.i),
alpha AS (SELECT conv_id, turn, sum(r * e) / sum(r * r) AS a FROM p GROUP BY conv_id, turn)
SELECT conv_id, turn, count(*) AS samples,
       round(10 * log10(sum(a * r * a * r) / sum((e - a * r) * (e - a * r))), 6) + 0.0 AS si_sdr
FROM p JOIN alpha USING (conv_id, turn) GROUP BY conv_id, turn""",
)
def si_sdr_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The code points of a turn as a signal, the next turn as its estimate: lengths differ as the texts do."""
    text = F.col("text")
    points = F.transform(
        F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substr(text, i, F.lit(1))).cast("double")
    )
    signal = F.when(F.length(text) > 0, points).otherwise(F.array().cast("array<double>"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", signal.alias("ref"))
    ests = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("est"))
    pairs = align_pairs(pair(turns, ests, ["conv_id", "turn"], keep_unmatched=False))
    scored = si_sdr(pairs.withColumn("samples", F.size("ref").cast("bigint"))).where("samples > 0")
    return scored.select("conv_id", "turn", "samples", rounded("si_sdr").alias("si_sdr"))


@query(
    "estimates_without_reference",
    f"""WITH {FRAMES_SQL},
p AS (SELECT b.label, b.frame, a.v AS r, b.v AS e
      FROM fl a JOIN fl b ON b.label = a.label AND b.i = a.i AND a.frame = 0 AND b.frame > 0 AND a.label < 5), {SI_SDR_SQL}
SELECT f.label, f.frame, round(si_sdr, 6) + 0.0 AS si_sdr,
       CASE WHEN f.label < 5 THEN 'ok' ELSE 'missing_reference' END AS status
FROM frames f LEFT JOIN ratio USING (label, frame) WHERE f.frame > 0""",
)
def estimates_without_reference(spark: SparkSession, sf: str) -> DataFrame:
    """As ``one_reference_many_estimates``, but labels from 5 on have no reference."""
    rows = frames(spark, sf)
    refs = rows.where("frame = 0 AND label < 5").select("label", F.col("values").alias("ref"))
    ests = rows.where("frame > 0").select(*PAIR, F.col("values").alias("est"))
    scored = si_sdr(one_reference_many_estimates(refs, ests, "label", "frame", keep_unmatched=True))
    return scored.select(*PAIR, rounded("si_sdr").alias("si_sdr"), "status")


@query(
    "one_reference_many_estimates",
    f"""WITH {FRAMES_SQL},
p AS (SELECT b.label, b.frame, a.v AS r, b.v AS e
      FROM fl a JOIN fl b ON b.label = a.label AND b.i = a.i AND a.frame = 0 AND b.frame > 0), {SI_SDR_SQL}
SELECT label, frame, round(si_sdr, 6) + 0.0 AS si_sdr FROM ratio""",
)
def one_reference(spark: SparkSession, sf: str) -> DataFrame:
    """The first vector of a label is the reference of all others."""
    rows = frames(spark, sf)
    refs = rows.where("frame = 0").select("label", F.col("values").alias("ref"))
    ests = rows.where("frame > 0").select(*PAIR, F.col("values").alias("est"))
    paired = one_reference_many_estimates(refs, ests, "label", "frame")
    return si_sdr(paired).select(*PAIR, rounded("si_sdr").alias("si_sdr"))


@query(
    "first_channel",
    """SELECT vec_id, 32 AS samples,
       round(list_sum(list_transform(embedding[1:32], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))), 6) AS energy
FROM embeddings""",
)
def first_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector read as two channels of 32 samples."""
    x = F.col("embedding").cast("array<double>")
    stereo = table(spark, sf, "embeddings").select(
        "vec_id", F.array(F.slice(x, 1, 32), F.slice(x, 33, 32)).alias("channels")
    )
    mono = stereo.select("vec_id", first_channel("channels").alias("c"))
    return mono.select(
        "vec_id", F.size("c").alias("samples"), rounded(V.dot(F.col("c"), F.col("c"))).alias("energy")
    )
