"""Pairing, sampling, memo, batch, corpus and sweep queries."""

from __future__ import annotations

from datetime import datetime
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.registry import query, rounded, table
from catalog.storage import manifest_corpus
from catalog.text import BOTH_SQL, PAIRS_SQL, TURN, turn_preds
from wavetally.functions.text import run_stamp
from wavetally.operators.memo import (
    HASH,
    memo_merge,
    memo_split,
    memo_todo,
    stored_memo,
    update_memo,
    with_request_hash,
)
from wavetally.operators.ordering import index_range, index_within, seeded_sample
from wavetally.operators.pairing import (
    pair,
    split_status,
    union_runs,
    validate_samples,
    with_batch_metadata,
    with_sample_metadata,
)
from wavetally.operators.summary import summarise
from wavetally.plans.batch import ASR_METRICS, Evaluation, Job, frame_metrics, score_signals, score_transcripts
from wavetally.plans.isolation import isolated
from wavetally.plans.corpus import evaluate_corpus, store_corpus
from wavetally.plans.sweep import evaluate_sweep, resume_sweep, sweep_requests
from wavetally.session import scratch_dir, shuffle_partitions
from wavetally.sinks.writers import key_of_path, write_texts
from wavetally.sources.readers import read_hashed_files

# ---- identity, sampling -------------------------------------------------


@query(
    "index_within",
    """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents""",
)
def positions(spark: SparkSession, sf: str) -> DataFrame:
    return index_within(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")


@query(
    "seeded_sample",
    """SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100""",
)
def sampled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return seeded_sample(docs, "doc_id", 100)


@query("index_range", "SELECT event_id, user_id, event_type FROM events WHERE event_id >= 600 AND event_id < 801")
def ranged(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return index_range(events, "event_id", 600, 801)


# ---- pairing and metadata -----------------------------------------------


@query(
    "pair_status",
    """SELECT coalesce(page_id, doc_id) AS sample_idx, url, CAST(quality AS BIGINT) AS quality,
       CASE WHEN doc_id IS NULL THEN 'missing_prediction'
            WHEN page_id IS NULL THEN 'missing_reference' ELSE 'ok' END AS status
FROM pages FULL JOIN labels ON page_id = doc_id""",
)
def pair_status(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as references, labels as predictions: some keys on one side only."""
    refs = table(spark, sf, "pages").select(F.col("page_id").alias("sample_idx"), "url")
    preds = table(spark, sf, "labels").select(
        F.col("doc_id").alias("sample_idx"), F.col("quality").cast("bigint").alias("quality")
    )
    return pair(refs, preds, "sample_idx")


@query(
    "pair_repeated",
    """WITH r AS (SELECT l_partkey AS part, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'),
p AS (SELECT l_partkey AS part, l_suppkey FROM lineitem WHERE l_returnflag = 'A'),
again AS (SELECT part FROM r GROUP BY part HAVING count(*) > 1 UNION SELECT part FROM p GROUP BY part HAVING count(*) > 1)
SELECT part, l_orderkey, l_linenumber, l_suppkey,
       CASE WHEN l_suppkey IS NULL THEN 'missing_prediction' WHEN l_orderkey IS NULL THEN 'missing_reference' ELSE 'ok' END AS status
FROM (SELECT * FROM r ANTI JOIN again USING (part)) FULL JOIN (SELECT * FROM p ANTI JOIN again USING (part)) USING (part)
UNION ALL SELECT part, l_orderkey, l_linenumber, NULL, 'duplicate_key' FROM r SEMI JOIN again USING (part)
UNION ALL SELECT part, NULL, NULL, l_suppkey, 'duplicate_key' FROM p SEMI JOIN again USING (part)""",
)
def pair_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Returned and accepted lines of a part as the two sides: most keys repeat, and their rows do not multiply."""
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "part")
    refs = lines.where("l_returnflag = 'R'").select("part", "l_orderkey", "l_linenumber")
    preds = lines.where("l_returnflag = 'A'").select("part", "l_suppkey")
    return pair(refs, preds, "part", flag_duplicates=True)


@query(
    "rejected_samples",
    """SELECT CASE WHEN doc_id IS NULL THEN 'missing_prediction' ELSE 'missing_reference' END AS status, count(*) AS samples
FROM pages FULL JOIN labels ON page_id = doc_id WHERE doc_id IS NULL OR page_id IS NULL GROUP BY 1""",
)
def rejected_samples(spark: SparkSession, sf: str) -> DataFrame:
    rejected = split_status(pair_status(spark, sf))[1]
    return rejected.groupBy("status").agg(F.count(F.lit(1)).alias("samples"))


@query(
    "duplicate_keys",
    "SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
)
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType([T.StructField("l_orderkey", T.LongType())])
    return validate_samples(table(spark, sf, "lineitem").select("l_orderkey"), schema, "l_orderkey")


@query(
    "metadata_join",
    """SELECT d.doc_id, n_chars, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic,
       'corpus' AS dataset, 'test' AS subset
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def metadata_join(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "documents").select("doc_id", "n_chars")
    meta = table(spark, sf, "labels").select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("quality", "toxic")]
    )
    joined = with_sample_metadata(scores, meta, "doc_id")
    return with_batch_metadata(joined, {"dataset": "corpus", "subset": "test"})


@query(
    "union_runs",
    """SELECT 'conversations' AS run_id, conv_id, turn, role, CAST(NULL AS VARCHAR) AS lang FROM conversations
UNION ALL SELECT 'documents', doc_id, NULL, NULL, lang FROM documents""",
)
def unioned(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), "lang")
    return union_runs(conversations=turns, documents=docs)


@query(
    "run_stamps",
    "SELECT strftime(ts, '%Y%m%d_%H%M%S') AS run_ts, count(*) AS events FROM events GROUP BY 1",
)
def run_stamps(spark: SparkSession, sf: str) -> DataFrame:
    stamped = table(spark, sf, "events").select(run_stamp("ts").alias("run_ts"))
    return stamped.groupBy("run_ts").agg(F.count(F.lit(1)).alias("events"))


# ---- memo ---------------------------------------------------------------

HASHED_SQL = """
hashed AS (SELECT doc_id, md5('1' || lang || chr(1) || '1' || text) AS request_md5 FROM documents),
memo AS (SELECT request_md5, 'doc_' || min(doc_id) AS result_path
         FROM hashed WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY request_md5)"""


def memo_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All documents as requests; the labelled ones have been answered."""
    requests = table(spark, sf, "documents").select("doc_id", "lang", "text")
    answered = requests.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    memo = (
        with_request_hash(answered, ["lang", "text"])
        .groupBy(HASH)
        .agg(F.concat(F.lit("doc_"), F.min("doc_id").cast("string")).alias("result_path"))
    )
    return requests, memo


@query(
    "memo_todo",
    f"""WITH {HASHED_SQL}
SELECT min(doc_id) AS doc_id, request_md5 FROM hashed
WHERE request_md5 NOT IN (SELECT request_md5 FROM memo) GROUP BY request_md5""",
)
def todo(spark: SparkSession, sf: str) -> DataFrame:
    requests, memo = memo_inputs(spark, sf)
    return memo_split(requests, memo, ["lang", "text"], "doc_id")[0]


@query(
    "memo_hits",
    f"WITH {HASHED_SQL} SELECT doc_id, request_md5, result_path FROM hashed JOIN memo USING (request_md5)",
)
def hits(spark: SparkSession, sf: str) -> DataFrame:
    requests, memo = memo_inputs(spark, sf)
    return memo_split(requests, memo, ["lang", "text"], "doc_id")[1].select("doc_id", HASH, "result_path")


@query(
    "memo_merge",
    f"""WITH {HASHED_SQL},
fresh AS (SELECT request_md5, 'new_' || min(doc_id) AS result_path FROM hashed GROUP BY request_md5)
SELECT request_md5, coalesce(m.result_path, f.result_path) AS result_path
FROM fresh f LEFT JOIN memo m USING (request_md5)""",
)
def merged(spark: SparkSession, sf: str) -> DataFrame:
    """Results for every request arrive; those the memo already has keep theirs."""
    requests, memo = memo_inputs(spark, sf)
    fresh = (
        with_request_hash(requests, ["lang", "text"])
        .groupBy(HASH)
        .agg(F.concat(F.lit("new_"), F.min("doc_id").cast("string")).alias("result_path"))
    )
    return memo_merge(memo, fresh)


@query(
    "memo_two_runs",
    """WITH hashed AS (SELECT doc_id, md5('1' || lang || chr(1) || '1' || text) AS request_md5, toxic FROM documents JOIN labels USING (doc_id)),
first AS (SELECT request_md5, 'first_' || min(doc_id) AS result_path FROM hashed WHERE toxic = 0 GROUP BY request_md5),
second AS (SELECT request_md5, 'second_' || min(doc_id) AS result_path FROM hashed WHERE toxic = 1 GROUP BY request_md5)
SELECT request_md5, coalesce(f.result_path, s.result_path) AS result_path FROM first f FULL JOIN second s USING (request_md5)""",
)
def memo_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A stored memo after two runs; the second, with the few toxic documents, replaces only folders it has results for."""
    path, payload = scratch_dir(spark, "memo"), "result_path string"
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text").join(labels, "doc_id")
    hashed = with_request_hash(docs, ["lang", "text"])
    for toxic, name in ((0, "first_"), (1, "second_")):
        answer = F.concat(F.lit(name), F.min("doc_id").cast("string")).alias("result_path")
        update_memo(hashed.where(F.col("toxic") == toxic).groupBy(HASH).agg(answer), path, payload)
    return stored_memo(spark, path, payload)


@query(
    "file_memo",
    """WITH files AS (SELECT doc_id, md5(text || chr(10)) AS request_md5 FROM documents),
known AS (SELECT request_md5 FROM files WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT min(doc_id) AS doc_id, request_md5 FROM files ANTI JOIN known USING (request_md5) GROUP BY request_md5""",
)
def file_memo(spark: SparkSession, sf: str) -> DataFrame:
    """A file per document, known by the hash of its bytes: those whose content no labelled one has are still to do."""
    path, memo, payload = scratch_dir(spark, "texts"), scratch_dir(spark, "memo"), "file string"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    write_texts(docs, path, "doc_id", "text")
    files = read_hashed_files(spark, path, "*.txt").select(key_of_path("doc_id"), F.col("content_md5").alias(HASH))
    listing = scratch_dir(spark, "listing")
    files.write.parquet(listing)  # bytes are read and hashed once
    files = spark.read.schema(files.schema).parquet(listing)
    answered = files.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    name = F.min(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("file")
    update_memo(answered.groupBy(HASH).agg(name), memo, payload)
    return memo_todo(files, stored_memo(spark, memo, payload, files), "doc_id")


# ---- batch, corpus, sweep -----------------------------------------------


def dealt_score(spark: SparkSession) -> Job:
    """The transcript score with its pairs dealt out, as all turns lie in one row group."""
    return partial(score_transcripts, tasks=shuffle_partitions(spark))


def turn_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "text")


@query(
    "batch_eval",
    f"""{BOTH_SQL}
SELECT c.conv_id, c.turn, round(cer, 6) AS cer, round(wer, 6) AS wer,
       CASE WHEN r.conv_id IS NULL THEN 'missing_prediction' ELSE 'ok' END AS status, 'next turn' AS experiment
FROM conversations c LEFT JOIN rates r USING (conv_id, turn)""",
)
def batch_eval(spark: SparkSession, sf: str) -> DataFrame:
    """A job from requests to transcriptions, scored as a batch."""

    def infer(requests: DataFrame) -> DataFrame:
        return turn_preds(spark, sf).join(requests.select(*TURN), TURN, "left_semi")

    evaluation = Evaluation(dealt_score(spark))
    evaluation.set_infer(infer)
    scores = evaluation.batch(
        turn_samples(spark, sf), key=TURN, batch_metadata={"experiment": "next turn"}
    )
    return scores.select(
        *TURN, *[rounded(m).alias(m) for m in ASR_METRICS], "status", "experiment"
    )


@query(
    "infer_errors",
    f"""{BOTH_SQL}
SELECT c.conv_id, c.turn, CASE WHEN c.conv_id % 5 = 3 THEN NULL ELSE round(cer, 6) END AS cer,
       CASE WHEN c.conv_id % 5 = 3 THEN NULL ELSE round(wer, 6) END AS wer,
       CASE WHEN c.conv_id % 5 = 3 THEN 'inference_error' WHEN r.conv_id IS NULL THEN 'missing_prediction' ELSE 'ok' END AS status,
       CASE WHEN c.conv_id % 5 = 3 THEN 'ValueError: no audio for ' || c.conv_id || '-' || c.turn END AS inference_error
FROM conversations c LEFT JOIN rates r USING (conv_id, turn)""",
)
def infer_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A job that raises on every fifth conversation; all other turns are scored."""

    def transcribe(requests: pa.Table) -> pa.Table:
        for conv_id, turn in zip(*(requests.column(c).to_pylist() for c in TURN)):
            if conv_id % 5 == 3:
                raise ValueError(f"no audio for {conv_id}-{turn}")
        return requests

    job = isolated(transcribe, "conv_id bigint, turn bigint, hyp string", TURN)

    def infer(requests: DataFrame) -> DataFrame:
        # the model's answer to a turn is the next one; where there is none it still sees the turn and may raise
        heard = requests.select(*TURN).join(turn_preds(spark, sf), TURN, "left")
        return heard.transform(job).where(F.col("hyp").isNotNull() | F.col("inference_error").isNotNull())

    scores = Evaluation(dealt_score(spark), infer=infer).batch(turn_samples(spark, sf), key=TURN)
    return scores.select(*TURN, *[rounded(m).alias(m) for m in ASR_METRICS], "status", "inference_error")


@query(
    "tts_scores",
    """WITH s AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
u AS (SELECT vec_id, label, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM s),
p AS (SELECT a.vec_id, a.i, a.v AS r, b.v AS e FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 AND b.i = a.i),
sdr AS (
  SELECT p.vec_id, 10 * log10(sum(a * r * a * r) / sum((e - a * r) * (e - a * r))) AS si_sdr
  FROM p JOIN (SELECT vec_id, sum(r * e) / sum(r * r) AS a FROM p GROUP BY vec_id) q USING (vec_id) GROUP BY p.vec_id),
f AS (SELECT vec_id, i - 1 AS frame, b, list_aggregate(x[i:i + b], 'sum') / (b + 1) AS v
      FROM s, range(1, 62) AS fs(i), range(4) AS bs(b)),
fp AS (SELECT r.vec_id, r.frame, r.b, r.v AS r, e.v AS e
       FROM f r JOIN f e ON e.vec_id = r.vec_id + 1 AND e.frame = r.frame AND e.b = r.b),
rise AS (SELECT vec_id, frame, b, greatest(0, r - lag(r) OVER w) AS r, greatest(0, e - lag(e) OVER w) AS e
         FROM fp WINDOW w AS (PARTITION BY vec_id, b ORDER BY frame)),
env AS (SELECT vec_id, frame, CASE WHEN frame = 0 THEN 0.0 ELSE avg(r) END AS r,
               CASE WHEN frame = 0 THEN 0.0 ELSE avg(e) END AS e FROM rise GROUP BY vec_id, frame),
rhythm AS (SELECT vec_id, covar_pop(r, e) / (stddev_pop(r) * stddev_pop(e)) AS sim_r FROM env GROUP BY vec_id),
basis AS (SELECT k, b, sqrt(0.5) * CASE WHEN k = 0 THEN sqrt(0.5) ELSE 1.0 END * cos(pi() * k * (2 * b + 1) / 8) AS w
          FROM range(4) AS ks(k), range(4) AS bs(b)),
cep AS (SELECT vec_id, frame, k, sum(v * w) AS c FROM f JOIN basis USING (b) GROUP BY vec_id, frame, k),
z AS (SELECT vec_id, frame, k, (c - avg(c) OVER (PARTITION BY vec_id)) / (stddev_pop(c) OVER (PARTITION BY vec_id) + 1e-8) AS c
      FROM cep),
cosine AS (
  SELECT r.vec_id, r.frame, sum(r.c * e.c) / (sqrt(sum(r.c * r.c)) * sqrt(sum(e.c * e.c)) + 1e-8) AS v
  FROM z r JOIN z e ON e.vec_id = r.vec_id + 1 AND e.frame = r.frame AND e.k = r.k GROUP BY r.vec_id, r.frame),
spectrum AS (SELECT vec_id, avg(v) AS sim_o FROM cosine GROUP BY vec_id),
seg AS (SELECT l.vec_id, l.b, l.frame AS last, abs(m.r) AS x, abs(m.e) AS y
        FROM fp l JOIN fp m ON m.vec_id = l.vec_id AND m.b = l.b AND m.frame BETWEEN l.frame - 29 AND l.frame WHERE l.frame >= 29),
scale AS (SELECT vec_id, b, last, sqrt(sum(x * x)) / sqrt(sum(y * y)) AS a FROM seg GROUP BY vec_id, b, last),
rho AS (SELECT vec_id, b, last, covar_pop(x, least(a * y, x * (1 + pow(10, 0.75)))) / nullif(
                 stddev_pop(x) * stddev_pop(least(a * y, x * (1 + pow(10, 0.75)))), 0) AS r
        FROM seg JOIN scale USING (vec_id, b, last) GROUP BY vec_id, b, last),
clear AS (SELECT vec_id, avg(r) AS stoi FROM rho GROUP BY vec_id)
SELECT a.vec_id AS sample_idx, CAST(NULL AS DOUBLE) AS pesq,
       CASE WHEN a.label % 2 = b.label % 2 THEN round(stoi, 6) + 0.0 END AS stoi,
       CASE WHEN a.label % 2 = b.label % 2 THEN round(si_sdr, 6) + 0.0 END AS si_sdr,
       CASE WHEN a.label % 2 = b.label % 2 THEN round(sim_o, 6) + 0.0 END AS sim_o,
       CASE WHEN a.label % 2 = b.label % 2 THEN round(sim_r, 6) + 0.0 END AS sim_r,
       CASE WHEN b.vec_id IS NULL THEN 'missing_prediction'
            WHEN a.label % 2 <> b.label % 2 THEN 'rate_mismatch' ELSE 'ok' END AS status
FROM s a LEFT JOIN s b ON b.vec_id = a.vec_id + 1 LEFT JOIN sdr ON sdr.vec_id = a.vec_id
         LEFT JOIN rhythm ON rhythm.vec_id = a.vec_id LEFT JOIN spectrum ON spectrum.vec_id = a.vec_id
         LEFT JOIN clear ON clear.vec_id = a.vec_id""",
)
def tts_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector against the next id; odd labels count as 24 kHz, even ones as 16 kHz.

    For the frame scores a vector has 61 frames: the means of one, two, three and four values from there on are its bands.
    """
    x = F.col("embedding").cast("array<double>")
    rate = (16000 + 8000 * (F.col("label") % 2)).cast("int")
    vectors = table(spark, sf, "embeddings")
    samples = vectors.select(
        F.col("vec_id").alias("sample_idx"), F.lit(None).cast("string").alias("text"), x.alias("ref"), rate.alias("ref_sr")
    )
    ests = vectors.select((F.col("vec_id") - 1).alias("sample_idx"), x.alias("est"), rate.alias("est_sr"))

    def decode(requests: DataFrame) -> DataFrame:
        return ests.join(requests.select("sample_idx"), "sample_idx", "left_semi")

    def bands(signal: str, i) -> list:
        sums = [F.get(signal, i + b) for b in range(4)]
        return F.array(*[sum(sums[1 : b + 1], sums[0]) / F.lit(float(b + 1)) for b in range(4)])

    def frames(df: DataFrame, signal: str) -> DataFrame:
        rows = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: bands(signal, i))
        return df.select("sample_idx", F.posexplode(rows).alias("frame", "values"))

    extra = frame_metrics(frames(samples, "ref"), frames(ests, "est"))
    scores = Evaluation(lambda pairs: score_signals(pairs, extra), decode=decode).batch(samples)
    metrics = [rounded(m).alias(m) for m in ("stoi", "si_sdr", "sim_o", "sim_r")]
    return scores.select("sample_idx", "pesq", *metrics, "status")


@query(
    "corpus_eval",
    f"""{BOTH_SQL},
picked AS (SELECT conv_id, turn, role FROM conversations
           ORDER BY md5('7:' || (conv_id * 1000 + turn)), conv_id * 1000 + turn LIMIT 200),
scored AS (SELECT p.role, r.cer, r.wer, r.conv_id IS NOT NULL AS ok
           FROM picked p LEFT JOIN rates r USING (conv_id, turn)),
long AS (SELECT role, 'cer' AS metric, cer AS v, ok FROM scored UNION ALL SELECT role, 'wer', wer, ok FROM scored)
SELECT role, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(v) AS n,
       CAST(0 AS BIGINT) AS n_nan, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_rejected
FROM long GROUP BY role, metric""",
)
def corpus_eval(spark: SparkSession, sf: str) -> DataFrame:
    """200 turns in seeded order, scored, joined with their role and summarised by it."""
    idx = F.col("conv_id") * 1000 + F.col("turn")
    turns = table(spark, sf, "conversations").withColumn("sample_idx", idx)
    preds = turns.select((F.col("sample_idx") - 1).alias("sample_idx"), F.col("text").alias("hyp"))
    _, summary = evaluate_corpus(
        Evaluation(dealt_score(spark)),
        turns.select("sample_idx", "text"),
        "sample_idx",
        ASR_METRICS,
        n=200,
        seed=7,
        meta=turns.select("sample_idx", "role"),
        batch_metadata={"dataset": "conversations"},
        predictions=preds,
        by=["role"],
    )
    return summary.withColumns({c: rounded(c) for c in ("mean", "std")})


def _squeezed(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


@query(
    "corpus_end_to_end",
    f"""{BOTH_SQL.replace("lower(a.text)", f"lower({_squeezed('a.text')})").replace("lower(b.text)", f"lower({_squeezed('b.text')})")},
picked AS (SELECT conv_id, turn, role FROM conversations
           ORDER BY md5('7:' || (conv_id * 1000 + turn)), conv_id * 1000 + turn LIMIT 200)
SELECT p.conv_id * 1000 + p.turn AS sample_idx, round(cer, 6) AS cer, round(wer, 6) AS wer,
       CASE WHEN r.conv_id IS NULL THEN 'missing_prediction' ELSE 'ok' END AS status, p.role,
       'conversations' AS dataset, '20250131_235959' AS run_ts
FROM picked p LEFT JOIN rates r USING (conv_id, turn)""",
)
def corpus_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """From transcript files to score files: 200 samples, predicted, scored, joined with their role, stored, read back."""
    utterances = manifest_corpus(spark, sf)
    idx = (F.col("speaker_id") * 1000 + F.col("chapter_id")).alias("sample_idx")
    corpus = utterances.select(idx, "text")
    preds = corpus.select((F.col("sample_idx") - 1).alias("sample_idx"), F.col("text").alias("hyp"))
    meta = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_idx"), "role")
    stored, _ = store_corpus(
        Evaluation(dealt_score(spark)), corpus, "sample_idx", ASR_METRICS, scratch_dir(spark, "runs"),
        datetime(2025, 1, 31, 23, 59, 59), n=200, seed=7, meta=meta,
        batch_metadata={"dataset": "conversations"}, predictions=preds,
    )
    metrics = [rounded(m).alias(m) for m in ASR_METRICS]
    return stored.select("sample_idx", *metrics, "status", "role", "dataset", "run_ts")


CHECKPOINTS = ["ahead1", "ahead2", "ahead3", "silent"]

SWEEP_SQL = BOTH_SQL.replace(
    PAIRS_SQL,
    """
turn_pairs AS (
  SELECT a.conv_id, a.turn, 'ahead' || k AS role, lower(a.text) AS r, lower(b.text) AS h
  FROM conversations a JOIN range(1, 4) AS ks(k) ON true
  JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + k)""",
)


SUMMARY_SQL = f"""{SWEEP_SQL},
total AS (SELECT count(*) AS refs FROM conversations),
ahead AS (SELECT conv_id, turn - k AS turn, 'ahead' || k AS role FROM conversations, range(1, 4) AS ks(k)),
unasked AS (SELECT p.role, count(*) AS lost FROM ahead p ANTI JOIN conversations c USING (conv_id, turn) GROUP BY p.role),
long AS (SELECT role, 'cer' AS metric, cer AS v FROM rates UNION ALL SELECT role, 'wer', wer FROM rates
         UNION ALL SELECT 'silent', 'cer', NULL UNION ALL SELECT 'silent', 'wer', NULL)
SELECT role AS checkpoint, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(v) AS n,
       CAST(0 AS BIGINT) AS n_nan, count(v) AS n_ok, 
       any_value(refs) - count(v) + coalesce(any_value(lost), 0) AS n_rejected
FROM long CROSS JOIN total LEFT JOIN unasked USING (role) GROUP BY role, metric"""


def predictions_ahead(spark: SparkSession, sf: str) -> DataFrame:
    ahead = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("hyp"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")
    )
    return ahead.select(
        F.concat(F.lit("ahead"), F.col("k").cast("string")).alias("checkpoint"),
        "conv_id",
        (F.col("turn") - F.col("k")).alias("turn"),
        "hyp",
    )


@query(
    "sweep_summary",
    SUMMARY_SQL,
)
def sweep_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Checkpoints predict the turn one, two or three ahead; one predicts nothing. Some predict turns nobody has."""
    refs = turn_samples(spark, sf)
    preds = predictions_ahead(spark, sf)
    _, comparison = evaluate_sweep(refs, preds, dealt_score(spark), TURN, ASR_METRICS, CHECKPOINTS)
    return comparison.withColumns({c: rounded(c) for c in ("mean", "std")})


@query(
    "sweep_end_to_end",
    SUMMARY_SQL.replace("UNION ALL SELECT 'silent', 'cer', NULL UNION ALL SELECT 'silent', 'wer', NULL", "")
    .replace("SELECT role AS checkpoint", "SELECT 'conversations' AS dataset, role AS checkpoint"),
)
def sweep_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Two checkpoints are scored and stored; a third arrives, and only that one is read and scored by the next run."""
    idx = (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_idx")
    refs = turn_samples(spark, sf).select(idx, "text")
    preds = predictions_ahead(spark, sf).select(idx, "hyp", "checkpoint")
    arrived, stored = scratch_dir(spark, "predictions"), scratch_dir(spark, "sweep")
    schema = "sample_idx bigint, hyp string, checkpoint string"
    for there in (["ahead1", "ahead2"], ["ahead3"]):
        preds.where(F.col("checkpoint").isin(there)).write.mode("append").partitionBy("checkpoint").parquet(arrived)
        scores, _ = resume_sweep(
            refs, arrived, stored, dealt_score(spark), "sample_idx", ASR_METRICS,
            batch_metadata={"dataset": "conversations"}, schema=schema,
        )
    summary = summarise(scores, ASR_METRICS, ["dataset", "checkpoint"])
    return summary.withColumns({c: rounded(c) for c in ("mean", "std")})


@query(
    "sweep_requests",
    """SELECT conv_id, turn, role, checkpoint FROM conversations, unnest(['a', 'b', 'c']) AS t(checkpoint)""",
)
def requests_of_sweep(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return sweep_requests(turns, ["b", "a", "c"])
