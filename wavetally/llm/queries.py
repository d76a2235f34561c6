"""Queries of the operators over the given tables, and SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.llm import (
    decontamination,
    fingerprints,
    jaccard,
    linededup,
    pieces,
    privacy,
    quality,
    sharding,
    topk,
    urls,
    variants,
    warc,
    whitening,
)
from wavetally.llm.tables import given
from wavetally.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


@query("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """SQL states rules, but not the regression's verdicts; tests compare with brute force and held-out urls."""
    return urls.judge_urls(given(spark, sf, "pages"))


@query(
    "op2_topk",
    """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
      FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op2_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = given(spark, sf, "embeddings").select("vec_id", topk.scaled("embedding").alias("vector"))
    return topk.exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


@query("op3_quality")
def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Grades of every document; SQL fits no regression, a test measures held-out accuracy."""
    docs = given(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, quality.grades(given(spark, sf, "labels")))
    return quality.graded(docs, model).drop("text")


@query("op4_pieces")
def op4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document. SQL has no Viterbi; tests compare with brute force and the model's library."""
    encoded = pieces.encode_texts(given(spark, sf, "documents"), pieces.read_model())
    return encoded.select("doc_id", "ids", "n_tokens", "n_bytes", "round_trip")


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without its recurring lines; a test compares with a brute-force version."""
    return linededup.drop_recurring(given(spark, sf, "documents").select("doc_id", "text"), "n_dropped")


@query("op6_privacy")
def op6_privacy(spark: SparkSession, sf: str) -> DataFrame:
    """Places of personal data and of disclosing terms; a test compares with a brute-force version."""
    return privacy.span_digest(privacy.sanitised(given(spark, sf, "documents")))


@query(
    "op7_decontamination",
    r"""WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dp AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d),
widths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM dp JOIN widths ON i + n - 1 <= len(w)),
hits AS (SELECT row, i, bw.n, item, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT row, count(*) AS n_hit
          FROM (SELECT DISTINCT row, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT row, i, n FROM hits)) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT row, item, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)""",
)
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contamination(given(spark, sf, "documents"), given(spark, sf, "benchmark"))


@query(
    "op8_jaccard",
    r"""WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY ALL),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * o.o >= 85 * (x.n + y.n - o.o)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low ON a = doc_id""",
)
def op8_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(given(spark, sf, "documents"))


@query(
    "op9_warc",
    """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f""",
)
def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_archives(given(spark, sf, "pages"), path)
    return warc.page_records(warc.read_archives(spark, path))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """SQL has no CRC-32; a test compares with a brute-force version."""
    return sharding.assign_shards(given(spark, sf, "documents"), shards=24)


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """SQL has no CRC-32; a test compares with all pairs of words."""
    return variants.variants(given(spark, sf, "documents"))


@query("op12_fingerprints")
def op12_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """SQL draws no lexicons; a test compares with a plain version and measures likeness of copies."""
    return fingerprints.fingerprints(given(spark, sf, "documents"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """SQL has no eigenvectors; a test compares with a dense solver."""
    return whitening.whiten(given(spark, sf, "embeddings"))
