"""Frame queries. A label is a sample, its vectors in id order are frames of 64 bands.

Labels 0-4 are references, label L+5 is the estimate for label L.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.signals import FRAMES_SQL, frames
from wavetally.operators.frames import (
    align_frames,
    cepstra,
    onset_envelope,
    pack_frames,
    unpack_frames,
    znorm,
)
from wavetally.operators.similarity import band_intelligibility, sim_o, sim_r

CEPSTRA_SQL = """
basis AS (
  SELECT k, b, sqrt(2.0 / 64) * CASE WHEN k = 0 THEN 1 / sqrt(2.0) ELSE 1.0 END
               * cos(pi() * k * (2 * b + 1) / 128) AS w
  FROM range(13) AS ks(k), range(64) AS bs(b)),
cep AS (SELECT fl.label, fl.frame, k, sum(v * w) AS c FROM fl JOIN basis ON basis.b = fl.i - 1
        GROUP BY fl.label, fl.frame, k)"""

ONSET_SQL = """
rise AS (SELECT label, frame, i, greatest(0, v - lag(v) OVER (PARTITION BY label, i ORDER BY frame)) AS d FROM fl),
env AS (SELECT label, frame, CASE WHEN frame = 0 THEN 0.0 ELSE avg(d) END AS value FROM rise GROUP BY label, frame)"""


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ref = df.where(F.col("label") < 5)
    est = df.where(F.col("label") >= 5).withColumn("label", F.col("label") - 5)
    return ref, est


@query(
    "znorm_frames",
    f"""WITH {FRAMES_SQL},
s AS (SELECT label, avg(v) AS m, stddev_pop(v) AS sd FROM fl GROUP BY label)
SELECT fl.label, frame, CAST(i - 1 AS BIGINT) AS band, round((v - m) / (sd + 1e-8), 6) + 0.0 AS value
FROM fl JOIN s USING (label)""",
)
def znorm_frames(spark: SparkSession, sf: str) -> DataFrame:
    z = unpack_frames(znorm(frames(spark, sf), "label"), "label")
    return z.select("label", "frame", F.col("band").cast("bigint").alias("band"), rounded("value").alias("value"))


@query(
    "pack_frames",
    f"""WITH {FRAMES_SQL}
SELECT label, frame, array_to_string(list_transform(x, lambda v: CAST(CAST(floor(v * 1000) AS BIGINT) AS VARCHAR)), ',') AS bands
FROM frames""",
)
def packed_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames stored with one row per band, packed again."""
    long = unpack_frames(frames(spark, sf), "label").withColumn("value", F.floor(F.col("value") * 1000))
    ints = F.transform("values", lambda v: v.cast("bigint").cast("string"))
    return pack_frames(long, "label").select("label", "frame", F.array_join(ints, ",").alias("bands"))


@query(
    "onset_envelope",
    f"WITH {FRAMES_SQL}, {ONSET_SQL} SELECT label, frame, round(value, 6) + 0.0 AS value FROM env",
)
def envelope(spark: SparkSession, sf: str) -> DataFrame:
    return onset_envelope(frames(spark, sf), "label").withColumn("value", rounded("value"))


@query(
    "cepstra",
    f"""WITH {FRAMES_SQL}, {CEPSTRA_SQL}
SELECT label, frame, k, round(c, 6) + 0.0 AS value FROM cep""",
)
def cepstral_frames(spark: SparkSession, sf: str) -> DataFrame:
    long = unpack_frames(cepstra(frames(spark, sf)), "label")
    return long.select(
        "label", "frame", F.col("band").cast("bigint").alias("k"), rounded("value").alias("value")
    )


@query(
    "align_frames",
    f"""WITH {FRAMES_SQL}
SELECT r.label, r.frame, r.vec_id AS ref_id,
       round(list_sum(list_transform(list_zip(r.x, e.x), lambda z: z[1] * z[2])), 6) + 0.0 AS product
FROM frames r JOIN frames e ON e.label = r.label + 5 AND e.frame = r.frame""",
)
def aligned_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames(spark, sf)
    ref, est = sides(rows)
    product = F.aggregate(F.zip_with("ref", "est", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    ids = ref.select("label", "frame", F.col("vec_id").alias("ref_id"))
    return align_frames(ref, est, "label").join(ids, ["label", "frame"]).select(
        "label", "frame", "ref_id", rounded(product).alias("product")
    )


@query(
    "sim_o",
    f"""WITH {FRAMES_SQL}, {CEPSTRA_SQL},
s AS (SELECT label, avg(c) AS m, stddev_pop(c) AS sd FROM cep GROUP BY label),
z AS (SELECT cep.label, frame, k, (c - m) / (sd + 1e-8) AS c FROM cep JOIN s USING (label)),
cosine AS (
  SELECT r.label, r.frame, sum(r.c * e.c) / (sqrt(sum(r.c * r.c)) * sqrt(sum(e.c * e.c)) + 1e-8) AS v
  FROM z r JOIN z e ON e.label = r.label + 5 AND e.frame = r.frame AND e.k = r.k GROUP BY r.label, r.frame)
SELECT label, count(*) AS frames, round(avg(v), 6) + 0.0 AS sim_o, 'ok' AS status FROM cosine GROUP BY label""",
)
def spectral_similarity(spark: SparkSession, sf: str) -> DataFrame:
    ref, est = sides(cepstra(frames(spark, sf)))
    return sim_o(ref, est, "label").withColumn("sim_o", rounded("sim_o"))


@query(
    "sim_r",
    f"""WITH {FRAMES_SQL}, {ONSET_SQL},
s AS (SELECT label, avg(value) AS m, stddev_pop(value) AS sd FROM env GROUP BY label),
z AS (SELECT env.label, frame, (value - m) / (sd + 1e-8) AS v FROM env JOIN s USING (label))
SELECT r.label, count(*) AS frames,
       round(covar_pop(r.v, e.v) / (stddev_pop(r.v) * stddev_pop(e.v)), 6) + 0.0 AS sim_r, 'ok' AS status
FROM z r JOIN z e ON e.label = r.label + 5 AND e.frame = r.frame GROUP BY r.label""",
)
def rhythm_similarity(spark: SparkSession, sf: str) -> DataFrame:
    ref, est = sides(onset_envelope(frames(spark, sf), "label"))
    return sim_r(ref, est, "label").withColumn("sim_r", rounded("sim_r"))


@query(
    "band_intelligibility",
    f"""WITH {FRAMES_SQL},
p AS (SELECT a.label, a.frame, a.i, abs(a.v) AS x, abs(b.v) AS y
      FROM fl a JOIN fl b ON b.label = a.label + 5 AND b.frame = a.frame AND b.i = a.i),
seg AS (SELECT e.label, e.i, e.frame AS last, m.x, m.y
        FROM p e JOIN p m ON m.label = e.label AND m.i = e.i AND m.frame BETWEEN e.frame - 29 AND e.frame
        WHERE e.frame >= 29),
scale AS (SELECT label, i, last, sqrt(sum(x * x)) / sqrt(sum(y * y)) AS a FROM seg GROUP BY label, i, last),
rho AS (SELECT seg.label, seg.i, seg.last,
               covar_pop(x, least(a * y, x * (1 + pow(10, 0.75)))) / nullif(
                 stddev_pop(x) * stddev_pop(least(a * y, x * (1 + pow(10, 0.75)))), 0) AS r
        FROM seg JOIN scale USING (label, i, last) GROUP BY seg.label, seg.i, seg.last)
SELECT label, count(r) AS segments, round(avg(r), 6) + 0.0 AS intelligibility, 'ok' AS status FROM rho GROUP BY label""",
)
def intelligibility(spark: SparkSession, sf: str) -> DataFrame:
    """The magnitudes of all 64 values serve as band amplitudes."""
    amplitudes = frames(spark, sf).withColumn("values", F.transform("values", F.abs))
    ref, est = sides(amplitudes)
    return band_intelligibility(ref, est, "label").withColumn("intelligibility", rounded("intelligibility"))
