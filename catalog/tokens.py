"""Token queries. The magnitudes of an embedding, scaled to integers, are codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, table
from wavetally.operators.tokens import audio_span, decode_tokens, encode_tokens, pad_frames, to_codebooks

VOCABULARY, SOS, SOA, EOA = 5000, 1, 2, 3

CODES_SQL = """
codes AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(abs(CAST(v AS DOUBLE)) * 1000) AS BIGINT) % 4096) AS c
          FROM embeddings)"""


def codes(spark: SparkSession, sf: str) -> DataFrame:
    as_code = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda v: (F.floor(F.abs(v) * 1000) % 4096).cast("int"),
    )
    return table(spark, sf, "embeddings").select("vec_id", as_code.alias("codes"))


def joined(col: str | Column) -> Column:
    """Arrays compare as text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(c.cast("array<string>"), ",")


@query(
    "encode_tokens",
    f"""WITH {CODES_SQL}
SELECT vec_id, '1,2,' || array_to_string(list_transform(c, lambda v: v + 5000), ',') || ',3' AS tokens FROM codes""",
)
def encoded(spark: SparkSession, sf: str) -> DataFrame:
    """Two codebooks of 32 codes each, flattened."""
    books = codes(spark, sf).select(
        "vec_id", F.array(F.slice("codes", 1, 32), F.slice("codes", 33, 32)).alias("codes")
    )
    return encode_tokens(books, VOCABULARY, SOS, SOA, EOA).select("vec_id", joined("tokens").alias("tokens"))


@query(
    "token_roundtrip",
    f"""WITH {CODES_SQL}
SELECT vec_id, array_to_string(c, ',') || ',0,0' AS codes, 'ok' AS status FROM codes""",
)
def roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Encode, decode, pad to whole frames of three (64 leaves one over)."""
    tokens = encode_tokens(codes(spark, sf), VOCABULARY, SOS, SOA, EOA).drop("codes")
    decoded = decode_tokens(tokens, VOCABULARY, SOA, EOA, 3)
    return decoded.select("vec_id", joined("codes").alias("codes"), "status")


@query(
    "audio_span",
    f"""WITH {CODES_SQL},
m AS (SELECT vec_id, c, coalesce(list_position(c, 50), 0) AS s,
             CASE WHEN coalesce(list_position(c, 10), 0) > 0 THEN list_position(c, 10) - 1 ELSE len(c) END AS e FROM codes)
SELECT vec_id, CASE WHEN s < e THEN array_to_string(c[s + 1:e], ',') END AS audio,
       CASE WHEN s < e THEN 'ok' ELSE 'empty_span' END AS status FROM m""",
)
def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Codes 50 and 10 as markers: present, absent and in the wrong order."""
    found = audio_span(codes(spark, sf), 50, 10, "codes")
    return found.select("vec_id", joined("audio").alias("audio"), "status")


CODEBOOKS_SQL = f"""WITH {CODES_SQL},
padded AS (SELECT vec_id, list_concat(c, [0, 0]) AS c FROM codes),
pos AS (SELECT vec_id, unnest(range(0, len(c))) AS i, unnest(c) AS v FROM padded)
SELECT vec_id, CAST(i % 3 AS BIGINT) AS codebook, CAST(i // 3 AS BIGINT) AS frame, v AS code FROM pos"""


def codebook_rows(spark: SparkSession, sf: str, keep: int | None) -> DataFrame:
    long = to_codebooks(pad_frames(codes(spark, sf), 3), "vec_id", 3, keep)
    return long.select("vec_id", *[F.col(c).cast("bigint").alias(c) for c in ("codebook", "frame", "code")])


@query("codebooks", CODEBOOKS_SQL)
def codebooks(spark: SparkSession, sf: str) -> DataFrame:
    return codebook_rows(spark, sf, None)


@query("codebooks_kept", CODEBOOKS_SQL + " WHERE i % 3 < 2")
def codebooks_kept(spark: SparkSession, sf: str) -> DataFrame:
    return codebook_rows(spark, sf, 2)
