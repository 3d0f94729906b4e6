"""Queries for single steps of larger operators, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyline.functions import frames as V
from keyline.functions import scalars as C
from keyline.operators import quotas as P
from keyline.operators import selection as S
from keyline.plans.selection import SEQ
from keyline.sources.sequences import event_sequences as seq
from keyline.sources.sequences import seconds, table


def _refilled(k, d):
    taken = S.top_k(seq(k, d), 4).select("video_id", "frame_id")
    return P.refilled(seq(k, d).select("video_id", "frame_id"), taken, 12)


def _subtitle_frames(k, d):
    at = F.col("p_partkey")
    clock = F.format_string("%02d:%02d:%02d,%03d", at % 3, at % 60, at * 7 % 60, at * 37 % 1000)
    rows = table(k, d, "part").select(at.alias("line_id"), clock.alias("clock"))
    return rows.select("line_id", seconds(F.col("clock")).alias("start_s"), (seconds(F.col("clock")) * 29.97).cast("int").alias("frame"))


def _results(k, d):
    rows = table(k, d, "part")
    letter = F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1))
    pred = C.first_letter(F.concat(F.lit("The answer is "), letter, F.lit(".")))
    duration = F.when(F.col("p_size") < 15, "short").when(F.col("p_size") < 30, "medium").otherwise("long")
    made = P.result(F.col("p_partkey").cast("string"), duration, F.col("p_brand"), F.col("p_type"), F.lit("OCR"), pred, F.lit("B"))
    return rows.select(made.alias("r")).select("r.*")


def _images(k, d):
    files = table(k, d, "part").select(F.col("p_brand").alias("folder"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"), (F.col("p_partkey") % 9 != 0).alias("readable"))
    return P.folder_images(files)


QUERIES = {
    "q6_stops": lambda k, d: P.stopped(seq(k, d), 8).select("video_id", "n", F.round("gap", 9).alias("gap"), "stops"),
    "q7_halves": lambda k, d: P.sided(seq(k, d)).groupBy("video_id").agg(F.count_if("left").alias("n_left"), F.count_if(~F.col("left")).alias("n_right")),
    "q8_budget": lambda k, d: P.shared_budget(seq(k, d), 16),
    "q10_refilled": _refilled,
    "f2_f3_subtitle_frames": _subtitle_frames,
    "f12_results": _results,
    "s9_folder_images": _images,
    "h10_video_only": lambda k, d: table(k, d, "part").select("p_partkey", V.video_only(F.lit("video"), F.col("p_name")).alias("value")),
}

_HALF = SEQ + ", h AS (SELECT *, frame_id <= (min(frame_id) OVER (PARTITION BY video_id) + max(frame_id) OVER (PARTITION BY video_id)) / 2.0::DOUBLE AS lft FROM norm)"
_MASS = "coalesce(sum(CASE WHEN {} THEN s END), 0) + 1e-6::DOUBLE"
_CLOCK = "p_partkey % 3 * 3600 + p_partkey % 60 * 60 + CAST(printf('%02d.%03d', p_partkey * 7 % 60, p_partkey * 37 % 1000) AS DOUBLE)"

ORACLES = {
    "q6_stops": f"WITH {SEQ}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s DESC, pos) AS rank FROM norm), g AS (SELECT video_id, count(*) AS n, avg(CASE WHEN rank <= 8 THEN s END) - avg(s) AS gap FROM r GROUP BY video_id) SELECT video_id, n, round(gap, 9) AS gap, n <= 8 OR gap >= 0.5 AS stops FROM g",
    "q7_halves": f"WITH {_HALF} SELECT video_id, count(*) FILTER (lft) AS n_left, count(*) FILTER (NOT lft) AS n_right FROM h GROUP BY video_id",
    "q8_budget": f"WITH {_HALF}, b AS (SELECT video_id, {_MASS.format('lft')} AS l, {_MASS.format('NOT lft')} AS r FROM h GROUP BY video_id), x AS (SELECT video_id, CAST(round_even(16 * l / (l + r), 0) AS INT) AS m_left FROM b) SELECT video_id, m_left, CAST(16 - m_left AS INT) AS m_right FROM x",
    "q10_refilled": f"WITH {SEQ}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos) AS rank FROM fr), a AS (SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS c, 12 - least(4, n) AS need FROM r WHERE rank > 4) SELECT video_id, frame_id FROM a WHERE need > 0 AND list_contains(list_transform(range(0, need), lambda j: CAST(floor(j * greatest(1.0::DOUBLE, c / need::DOUBLE)) AS BIGINT)), i)",
    "f2_f3_subtitle_frames": f"SELECT p_partkey AS line_id, {_CLOCK} AS start_s, CAST(trunc(({_CLOCK}) * 29.97::DOUBLE) AS INT) AS frame FROM part",
    "f12_results": "SELECT CAST(p_partkey AS VARCHAR) AS question_id, CASE WHEN p_size < 15 THEN 'short' WHEN p_size < 30 THEN 'medium' ELSE 'long' END AS duration, p_brand AS category, p_type AS sub_category, 'OCR' AS task_category, substr('ABCD', CAST(p_partkey % 4 + 1 AS INT), 1) AS pred_answer, 'B' AS answer FROM part",
    "s9_folder_images": "WITH f AS (SELECT p_brand AS folder, 'f' || p_partkey || '.jpg' AS path, p_partkey % 9 <> 0 AS readable, row_number() OVER (PARTITION BY p_brand ORDER BY 'f' || p_partkey || '.jpg') - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT folder, CAST(k AS INT) AS nth, path FROM f, range(0, 10) t(k) WHERE readable AND i = CASE WHEN k = 9 THEN n - 1 ELSE CAST(floor(k * ((n - 1)::DOUBLE / 9.0::DOUBLE)) AS BIGINT) END",
    "h10_video_only": "SELECT p_partkey, p_name AS value FROM part",
}
