"""Text queries. A conversation turn is a reference, the next turn its hypothesis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from wavetally.functions.text import normalise
from wavetally.operators.error_rates import cer, corpus_error_rate, error_rates, spread, wer
from wavetally.operators.memo import build_requests
from wavetally.operators.pairing import fill_sentinels, pair
from wavetally.operators.summary import summarise

TURN = ["conv_id", "turn"]

PAIRS_SQL = """
turn_pairs AS (
  SELECT a.conv_id, a.turn, a.role, lower(a.text) AS r, lower(b.text) AS h
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""

# characters become ASCII, because this levenshtein counts bytes
CHARS_SQL = """
char_voc AS (
  SELECT *, list_distinct(string_split(r || h, '')) AS voc FROM turn_pairs),
char_edits AS (
  SELECT conv_id, turn, role,
         CAST(levenshtein(
           array_to_string(list_transform(string_split(r, ''), lambda c: chr(CAST(33 + list_position(voc, c) AS INTEGER))), ''),
           array_to_string(list_transform(string_split(h, ''), lambda c: chr(CAST(33 + list_position(voc, c) AS INTEGER))), '')) AS BIGINT) AS char_edits,
         CAST(length(r) AS BIGINT) AS ref_chars
  FROM char_voc)"""

# one row of the word dynamic program per step; the prefix minimum carries insertions
WORDS_SQL = """
word_lists AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn, role) AS id, conv_id, turn, role,
         list_filter(regexp_split_to_array(r, '\\s+'), lambda w: w <> '') AS rw,
         list_filter(regexp_split_to_array(h, '\\s+'), lambda w: w <> '') AS hw
  FROM turn_pairs),
ref_word AS (SELECT id, unnest(range(1, len(rw) + 1)) AS i, unnest(rw) AS w FROM word_lists),
hyp_word AS (SELECT id, 0 AS j, CAST(NULL AS VARCHAR) AS w FROM word_lists
             UNION ALL SELECT id, unnest(range(1, len(hw) + 1)) AS j, unnest(hw) AS w FROM word_lists),
dp AS (
  SELECT id, CAST(0 AS BIGINT) AS i, j, CAST(j AS BIGINT) AS d FROM hyp_word
  UNION ALL
  SELECT id, i, j, CAST(j + min(t - j) OVER (PARTITION BY id ORDER BY j) AS BIGINT) AS d
  FROM (SELECT dp.id, dp.i + 1 AS i, dp.j,
               CASE WHEN dp.j = 0 THEN dp.i + 1
                    ELSE least(dp.d + 1, lag(dp.d) OVER (PARTITION BY dp.id ORDER BY dp.j)
                                         + CASE WHEN r.w = h.w THEN 0 ELSE 1 END) END AS t
        FROM dp JOIN ref_word r ON r.id = dp.id AND r.i = dp.i + 1
                JOIN hyp_word h ON h.id = dp.id AND h.j = dp.j)),
word_edits AS (
  SELECT l.conv_id, l.turn, l.role, dp.d AS word_edits, CAST(len(l.rw) AS BIGINT) AS ref_words
  FROM word_lists l JOIN dp ON dp.id = l.id AND dp.i = len(l.rw) AND dp.j = len(l.hw))"""

BOTH_SQL = f"""
WITH RECURSIVE {PAIRS_SQL}, {CHARS_SQL}, {WORDS_SQL},
rates AS (
  SELECT c.conv_id, c.turn, c.role, c.char_edits, c.ref_chars, w.word_edits, w.ref_words,
         c.char_edits / CAST(c.ref_chars AS DOUBLE) AS cer,
         w.word_edits / CAST(w.ref_words AS DOUBLE) AS wer
  FROM char_edits c JOIN word_edits w USING (conv_id, turn, role))"""


def turn_refs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("ref"))


def turn_preds(spark: SparkSession, sf: str) -> DataFrame:
    """The next turn, under the key of the turn it is a prediction for."""
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))


def all_turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pair(turn_refs(spark, sf), turn_preds(spark, sf), TURN)


def matched_turns(spark: SparkSession, sf: str) -> DataFrame:
    return pair(turn_refs(spark, sf), turn_preds(spark, sf), TURN, keep_unmatched=False)


@query(
    "cer_turns",
    f"""WITH {PAIRS_SQL}, {CHARS_SQL}
SELECT conv_id, turn, char_edits, ref_chars,
       round(char_edits / CAST(ref_chars AS DOUBLE), 6) AS cer FROM char_edits""",
)
def cer_turns(spark: SparkSession, sf: str) -> DataFrame:
    scored = cer(spread(matched_turns(spark, sf)))
    return scored.select(*TURN, "char_edits", "ref_chars", rounded("cer").alias("cer"))


@query(
    "wer_turns",
    f"""WITH RECURSIVE {PAIRS_SQL}, {WORDS_SQL}
SELECT conv_id, turn, word_edits, ref_words,
       round(word_edits / CAST(ref_words AS DOUBLE), 6) AS wer FROM word_edits""",
)
def wer_turns(spark: SparkSession, sf: str) -> DataFrame:
    scored = wer(spread(matched_turns(spark, sf)))
    return scored.select(*TURN, "word_edits", "ref_words", rounded("wer").alias("wer"))


@query(
    "corpus_error_rate",
    f"""{BOTH_SQL}
SELECT role, count(*) AS samples,
       CAST(sum(char_edits) AS BIGINT) AS char_edits, CAST(sum(ref_chars) AS BIGINT) AS ref_chars,
       CAST(sum(word_edits) AS BIGINT) AS word_edits, CAST(sum(ref_words) AS BIGINT) AS ref_words,
       round(CAST(sum(char_edits) AS DOUBLE) / CAST(sum(ref_chars) AS DOUBLE), 6) AS cer,
       round(CAST(sum(word_edits) AS DOUBLE) / CAST(sum(ref_words) AS DOUBLE), 6) AS wer
FROM rates GROUP BY role""",
)
def corpus_rate(spark: SparkSession, sf: str) -> DataFrame:
    pooled = corpus_error_rate(error_rates(spread(matched_turns(spark, sf))), "role")
    return pooled.withColumns({m: rounded(m) for m in ("cer", "wer")})


@query(
    "wer_summary",
    f"""{BOTH_SQL},
long AS (SELECT role, 'cer' AS metric, cer AS v FROM rates UNION ALL SELECT role, 'wer', wer FROM rates),
last_turns AS (
  SELECT role, count(*) AS n_rejected FROM conversations a
  WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)
  GROUP BY role),
first_turns AS (
  SELECT count(*) AS n_rejected FROM conversations a
  WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1))
SELECT role, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(v) AS n,
       CAST(0 AS BIGINT) AS n_nan, count(v) AS n_ok, CAST(coalesce(any_value(n_rejected), 0) AS BIGINT) AS n_rejected
FROM long LEFT JOIN last_turns USING (role) GROUP BY role, metric
UNION ALL
SELECT NULL, metric, NULL, NULL, 0, 0, 0, n_rejected FROM first_turns, (VALUES ('cer'), ('wer')) AS m(metric)""",
)
def wer_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Turns without a successor are rejected samples of their role, first turns are predictions without a reference."""
    summary = summarise(error_rates(spread(all_turn_pairs(spark, sf))), ["cer", "wer"], "role")
    return summary.withColumns({c: rounded(c) for c in ("mean", "std")})


@query(
    "sentinel_scores",
    f"""WITH RECURSIVE {PAIRS_SQL}, {WORDS_SQL}
SELECT c.conv_id, c.turn,
       round(coalesce(w.word_edits / CAST(w.ref_words AS DOUBLE), -1.0), 6) AS wer,
       CASE WHEN w.conv_id IS NULL THEN 'missing_prediction' ELSE 'ok' END AS status
FROM conversations c LEFT JOIN word_edits w USING (conv_id, turn)
UNION ALL
SELECT conv_id, turn - 1, -1.0, 'missing_reference' FROM conversations a
WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1)""",
)
def sentinel_scores(spark: SparkSession, sf: str) -> DataFrame:
    filled = fill_sentinels(wer(spread(all_turn_pairs(spark, sf))), ["wer"])
    return filled.select(*TURN, rounded("wer").alias("wer"), "status")


@query(
    "sentence_case",
    """SELECT p_partkey, upper(p_name[1:1]) || lower(p_name[2:]) AS sentence,
       lower(p_name) AS folded, upper(p_name) AS loud FROM part""",
)
def sentence_case(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        normalise("p_name", "sentence").alias("sentence"),
        normalise("p_name").alias("folded"),
        normalise("p_name", "upper").alias("loud"),
    )


@query(
    "prompt_requests",
    """SELECT p_partkey, p_name, 'Say ''' || upper(p_name) || ''' with a natural voice' AS request FROM part""",
)
def prompt_requests(spark: SparkSession, sf: str) -> DataFrame:
    samples = table(spark, sf, "part").select("p_partkey", "p_name")
    return build_requests(samples, "with a natural voice", "p_name")
