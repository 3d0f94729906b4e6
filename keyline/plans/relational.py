"""Join, text and accuracy queries, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyline.functions import scalars as C
from keyline.operators import relational as R
from keyline.operators import selection as S
from keyline.plans.selection import SEQ
from keyline.sources import sinks
from keyline.sources.sequences import event_sequences as seq
from keyline.sources.sequences import seconds, table


def _subtitles(k, d) -> DataFrame:
    rows = seq(k, d).where("pos % 5 = 0")
    start = F.col("pos").cast("double")
    return rows.select("video_id", F.col("pos").alias("sub_id"), start.alias("start_s"), (start + 0.5 + F.col("pos") % 7).alias("end_s"))


def _points(k, d) -> DataFrame:
    return S.evenly(seq(k, d), 8).select("video_id", F.col("pos").cast("double").alias("t"))


def _interleaved(k, d):
    subs = _subtitles(k, d).select("video_id", F.col("sub_id").cast("int").alias("ord"), "start_s", "end_s", F.concat(F.lit("line "), F.col("sub_id").cast("string")).alias("text"))
    return R.interleaved(_points(k, d).distinct(), subs)


def _samples(k, d) -> DataFrame:
    return table(k, d, "documents").join(table(k, d, "labels"), "doc_id").select("doc_id", F.col("lang").alias("duration"), F.col("source").alias("category"), F.when(F.col("quality") == 1, "task_a").otherwise("task_b").alias("task"), F.col("toxic").cast("int").alias("correct"))


def _answers(k, d) -> DataFrame:
    rows = table(k, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    lead = F.element_at(F.array(*map(F.lit, ("The answer is (B) ", "A. ", "The best answer is C ", "either (A) or (D) ", "B or C ", ""))), (F.col("turn") % 6 + 1).cast("int"))
    return rows.withColumn("answer", F.concat(lead, F.lower("text"), F.when(F.col("turn") % 2 == 0, ".").otherwise("")))


_ANS = "ans AS (SELECT conv_id, turn, (['The answer is (B) ', 'A. ', 'The best answer is C ', 'either (A) or (D) ', 'B or C ', ''])[turn % 6 + 1] || lower(coalesce(text, '')) || CASE WHEN turn % 2 = 0 THEN '.' ELSE '' END AS answer FROM conversations)"


def _lls(k, d) -> DataFrame:
    return table(k, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx")).agg(F.max(-F.col("l_extendedprice")).alias("ll"), F.max(-F.col("l_tax")).alias("ll_uncond"), F.max("l_quantity").alias("length")).withColumn("gold", F.lit(1))


def _cosines(k, d) -> DataFrame:
    rows = table(k, d, "embeddings")
    one = rows.where("vec_id = 0").select("embedding").limit(1).scalar()
    return rows.withColumn("q", one).select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


def _prompts(k, d) -> DataFrame:
    rows = table(k, d, "part").select(F.col("p_partkey").alias("id"), "p_name", F.array("p_name", "p_brand", "p_type").alias("options"))
    return rows.select("id", C.prompt(F.lit("Select the best answer."), F.col("p_name"), C.lettered(F.col("options")), F.lit("The best answer is:")).alias("text"))


def _clock(k, d) -> DataFrame:
    rows = table(k, d, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("clock"))
    return rows.select("event_id", seconds(F.col("clock")).alias("seconds"), seconds(F.concat("clock", F.lit(",250"))).alias("subtitle_seconds"), (seconds(F.concat("clock", F.lit(",250"))) * 29.97).cast("int").alias("frame"))


def _likeness(k, d) -> DataFrame:
    """Of each frame its likeness to the best one: the row of the matrix that a pick needs, not the matrix."""
    best = S.top_k(S.normalised(seq(k, d)), 1).select("video_id", F.col("pos").alias("p"), F.col("s").alias("b"))
    sim = F.when(F.col("pos") == F.col("p"), 0.0).otherwise(F.exp(-F.abs(F.col("s") - F.col("b")) / 0.1))
    return S.normalised(seq(k, d)).join(best, "video_id").select("video_id", "pos", F.round(sim, 9).alias("sim"))


_SECS = "(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)))::DOUBLE"
_PTS = "c AS (SELECT video_id, max(n) AS n FROM fr GROUP BY video_id), pts AS (SELECT DISTINCT video_id, CAST(CASE WHEN i = 7 THEN n - 1 ELSE floor(i * (CAST(n - 1 AS DOUBLE) / 7.0::DOUBLE)) END AS DOUBLE) AS t FROM c, range(0, 8) r(i)), subs AS (SELECT video_id, pos AS sub_id, pos::DOUBLE AS start_s, pos + 0.5 + pos % 7 AS end_s FROM fr WHERE pos % 5 = 0)"
_OPTIONS = [(336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008)]


def _resolutions(k, d) -> DataFrame:
    rows = table(k, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 20 + 100).cast("long").alias("w"), (F.col("p_partkey") % 50 * 17 + 90).cast("long").alias("h"))
    return rows.withColumn("best", C.best_resolution(F.col("w"), F.col("h"), _OPTIONS)).select("id", "best.w", "best.h").withColumns({"w": F.col("w").cast("int"), "h": F.col("h").cast("int")})


_RES = " UNION ALL ".join(f"SELECT id, {k} AS k, {w} AS w, {h} AS h, least(dw * dh, iw * ih) AS e, least(dw * dh, iw * ih) - {w * h} AS waste FROM (SELECT *, CASE WHEN {w} * ih <= {h} * iw THEN {w} ELSE CAST(floor(iw * {h}.0::DOUBLE / ih) AS BIGINT) END AS dw, CASE WHEN {w} * ih <= {h} * iw THEN CAST(floor(ih * {w}.0::DOUBLE / iw) AS BIGINT) ELSE {h} END AS dh FROM im)" for k, (w, h) in enumerate(_OPTIONS))
_AXES = "SELECT CASE WHEN grouping(category, task) = 3 AND grouping(duration) = 0 THEN 'duration' WHEN grouping(category) = 0 THEN 'category' WHEN grouping(task) = 0 THEN 'task' ELSE 'overall' END AS axis, CASE WHEN grouping(duration) = 0 THEN duration WHEN grouping(category) = 0 THEN category WHEN grouping(task) = 0 THEN task ELSE 'overall' END AS label, count(*) AS n, CAST(coalesce(sum(correct), 0) AS BIGINT) AS correct, CASE WHEN count(*) > 0 THEN coalesce(sum(correct), 0) * 100.0::DOUBLE / count(*) ELSE 0 END AS accuracy FROM smp GROUP BY GROUPING SETS ((duration), (category), (task), ())"
_SMP = "smp AS (SELECT doc_id, lang AS duration, source AS category, CASE WHEN quality = 1 THEN 'task_a' ELSE 'task_b' END AS task, toxic AS correct FROM documents JOIN labels USING (doc_id))"
_STRIP = "answer"
for _c in (",", ".", "!", "?", ";", ":", "'"):
    _STRIP = f"regexp_replace({_STRIP}, '^[{_c * (2 if _c == chr(39) else 1)}]+|[{_c * (2 if _c == chr(39) else 1)}]+$', '', 'g')"
_last = lambda part: f"CASE WHEN instr(reverse(s), reverse('{part}')) = 0 THEN -1 ELSE length(s) - instr(reverse(s), reverse('{part}')) - {len(part)} + 1 END"


def _letters(pattern: str, order: str) -> str:
    lists = ", ".join(f"CASE WHEN contains(s, '{pattern.format(c)}') THEN {{'at': {_last(order.format(c))}, 'i': {-i}, 'c': '{c}'}} END" for i, c in enumerate("ABCDE"))
    return f"list_max(list_filter([{lists}], lambda x: x IS NOT NULL))['c']"


_PREFIXED = "regexp_replace(answer, '^\\s+|\\s+$', '', 'g')"
for _p in C.ANSWER_PREFIXES:
    _PREFIXED = f"replace({_PREFIXED}, '{_p}', '')"

QUERIES = {
    "n9_cosine": _cosines,
    "j1_zip": lambda k, d: seq(k, d).select("video_id", "pos", "score").join(S.strided(seq(k, d), 4).select("video_id", "pos", "frame_id"), ["video_id", "pos"]),
    "j2_annotate": lambda k, d: sinks.annotated(table(k, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("video_id")), S.top_k(seq(k, d), 4), 4, False).select("id", "video_id", F.array_join("frame_idx", ",").alias("frames")),
    "j3_contained": lambda k, d: R.contained(_points(k, d), _subtitles(k, d), width=8.0),
    "j4_interleaved": _interleaved,
    "j6_semi": lambda k, d: table(k, d, "documents").select("doc_id", "lang").join(table(k, d, "labels"), "doc_id", "left_semi"),
    "j7_gathered": lambda k, d: R.gathered(table(k, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("role").alias("resp"))).select("doc_id", F.array_join("resps", "|").alias("resps")),
    "j8_similarity": _likeness,
    "j9_grid": lambda k, d: R.grid(k, max_frames=[8, 16], alpha=[0.75], radius=[1, 2, 3], edge_weight=["temporal", "score_diff"]),
    "j10_few_shot": lambda k, d: R.few_shot(table(k, d, "documents").where("doc_id IS NOT NULL").select("doc_id", "lang"), F.lit(5), 8),
    "h2_shard": lambda k, d: R.sharded(table(k, d, "documents").select("doc_id", "lang"), 1, 4, 500),
    "h4_requests": lambda k, d: R.requests(table(k, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("context"), "p_brand", "p_type"), F.array("p_brand", "p_type"), unconditional=True).withColumn("idx", F.col("idx").cast("int")),
    "h5_first_response": lambda k, d: R.gathered(table(k, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("text").alias("resp"))).select("doc_id", F.get("resps", F.lit(0)).alias("resp")),
    "h6_repeats": lambda k, d: R.repeated(table(k, d, "nation").select("n_nationkey"), 3),
    "k5_submission": lambda k, d: sinks.submission(table(k, d, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("pred"), F.col("turn").alias("ord"))),
    "g3_accuracy_axes": lambda k, d: R.accuracy_by_axis(_samples(k, d), ["duration", "category", "task"]),
    "g4_accuracy_shared": lambda k, d: R.accuracy_shared_labels(_samples(k, d), ["duration", "category"]),
    "g5_gold_list": lambda k, d: _samples(k, d).select("doc_id", R.gold_match(F.col("duration"), F.array(F.lit("en"), F.lit("fr"))).alias("right")),
    "g6_mean_error": lambda k, d: R.mean_error(_samples(k, d), "duration", "correct").withColumns({"mean": F.round("mean", 9), "stderr": F.round("stderr", 9)}),
    "g7_reconciled": lambda k, d: R.reconciled(_samples(k, d).select(F.col("category").alias("group"), (F.col("correct") == 1).alias("higher_is_better"))),
    "g8_choice_metrics": lambda k, d: R.choice_metrics(_lls(k, d)),
    "o2_by_length": lambda k, d: R.by_length(table(k, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select("doc_id", F.col("place").cast("int")),
    "f1_clock": _clock,
    "f5_f6_prompts": _prompts,
    "f8_first_letter": lambda k, d: _answers(k, d).select("conv_id", "turn", C.first_letter(F.col("answer")).alias("letter")),
    "f10_choice": lambda k, d: _answers(k, d).select("conv_id", "turn", C.choice(F.col("answer"), "ABCDE").alias("letter")),
    "f13_name_k": lambda k, d: table(k, d, "part").select(F.col("p_partkey").alias("id"), F.regexp_extract(F.concat(F.lit("run_k"), F.col("p_size").cast("string"), F.lit("_alpha")), "k([0-9]+)", 1).alias("k")),
    "f16_hash": lambda k, d: table(k, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")),
    "f17_frame_times": lambda k, d: S.evenly(seq(k, d), 8).groupBy("video_id").agg(F.array_sort(F.collect_list((F.col("pos") / 30.0))).alias("t")).select("video_id", C.frame_times(F.col("t")).alias("times")),
    "f20_model_name": lambda k, d: table(k, d, "part").select(F.col("p_partkey").alias("id"), C.model_name(F.concat(F.lit("/models/m"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/checkpoint-"), F.col("p_partkey").cast("string"))).otherwise(""))).alias("name")),
    "f21_best_resolution": _resolutions,
}

ORACLES = {
    "n9_cosine": "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q",
    "j1_zip": f"WITH {SEQ} SELECT video_id, pos, score, frame_id FROM fr WHERE pos % 4 = 0 AND pos < 4 * (n // 4)",
    "j2_annotate": f"WITH {SEQ}, sel AS (SELECT video_id, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY frame_id) AS frames FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos) AS rn FROM fr) WHERE rn <= 4 GROUP BY video_id) SELECT event_id AS id, user_id AS video_id, frames FROM events JOIN sel ON user_id = video_id",
    "j3_contained": f"WITH {SEQ}, {_PTS} SELECT DISTINCT p.video_id, sub_id FROM pts p JOIN subs s ON p.video_id = s.video_id AND start_s <= t AND t < end_s",
    "j4_interleaved": f"WITH {SEQ}, {_PTS}, so AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sub_id) - 1 AS j, (start_s + end_s) / 2 AS mid FROM subs), ns AS (SELECT video_id, count(*) AS m FROM so GROUP BY video_id), marks AS (SELECT p.video_id, coalesce((SELECT min(j) FROM so WHERE so.video_id = p.video_id AND mid >= t), m) AS a, 0 AS b, t AS c, '<image>' AS text FROM pts p JOIN ns USING (video_id)), ls AS (SELECT video_id, j AS a, 1 AS b, 0.0 AS c, 'line ' || sub_id AS text FROM so WHERE EXISTS (SELECT 1 FROM pts p WHERE p.video_id = so.video_id AND t > CASE WHEN end_s - start_s < 1 THEN mid - 0.5 ELSE start_s END AND t < CASE WHEN end_s - start_s < 1 THEN mid + 0.5 ELSE end_s END)) SELECT video_id, string_agg(text, chr(10) ORDER BY a, b, c) AS text FROM (SELECT * FROM marks UNION ALL SELECT * FROM ls) GROUP BY video_id",
    "j6_semi": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "j7_gathered": "SELECT conv_id AS doc_id, string_agg(role, '|' ORDER BY turn) AS resps FROM conversations GROUP BY conv_id",
    "j8_similarity": f"WITH {SEQ}, best AS (SELECT video_id, pos AS p, s AS b FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos) AS r FROM norm) WHERE r = 1) SELECT video_id, pos, round(CASE WHEN pos = p THEN 0 ELSE exp(-abs(s - b) / 0.1) END, 9) AS sim FROM norm JOIN best USING (video_id)",
    "j9_grid": "SELECT CAST(a AS BIGINT) AS max_frames, 0.75::DOUBLE AS alpha, CAST(r AS BIGINT) AS radius, e AS edge_weight FROM (VALUES (8), (16)) x(a), (VALUES (1), (2), (3)) y(r), (VALUES ('temporal'), ('score_diff')) z(e)",
    "j10_few_shot": "SELECT doc_id, lang FROM (SELECT * FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('1234:' || doc_id), doc_id) AS r FROM documents WHERE doc_id IS NOT NULL) WHERE r <= 9 AND doc_id <> 5 ORDER BY r LIMIT 8)",
    "h2_shard": "SELECT doc_id, lang FROM documents WHERE doc_id % 4 = 1 AND doc_id < 500",
    "h4_requests": "SELECT p_partkey AS doc_id, c AS context, i AS idx, ([p_brand, p_type])[i + 1] AS choice FROM (SELECT *, unnest([p_name, '']) AS c FROM part), (VALUES (0), (1)) v(i)",
    "h5_first_response": "SELECT conv_id AS doc_id, arg_min(text, turn) AS resp FROM conversations GROUP BY conv_id",
    "h6_repeats": "SELECT n_nationkey, repeat FROM nation, (VALUES (0), (1), (2)) v(repeat)",
    "k5_submission": "SELECT conv_id AS id, arg_max(text, turn) AS pred FROM conversations GROUP BY conv_id",
    "g3_accuracy_axes": f"WITH {_SMP} {_AXES}",
    "g4_accuracy_shared": f"WITH {_SMP}, r AS (SELECT unnest([duration, category]) AS label, correct FROM smp) SELECT label, count(*) AS num, round(avg(correct), 5) AS acc FROM r GROUP BY label UNION ALL SELECT 'Overall', count(*), round(avg(correct), 5) FROM r",
    "g5_gold_list": f"WITH {_SMP} SELECT doc_id, list_contains(['en', 'fr'], duration) AS \"right\" FROM smp",
    "g6_mean_error": f"WITH {_SMP} SELECT duration, round(avg(correct), 9) AS mean, CASE WHEN count(correct) > 1 THEN round(stddev_samp(correct) / sqrt(count(correct)), 9) END AS stderr FROM smp GROUP BY duration",
    "g7_reconciled": f"WITH {_SMP} SELECT category AS \"group\", CASE WHEN count(DISTINCT correct = 1) = 1 THEN bool_and(correct = 1) END AS higher_is_better FROM smp GROUP BY category",
    "g8_choice_metrics": "WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS idx, max(-l_extendedprice) AS ll, max(-l_tax) AS u, max(l_quantity) AS len FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ll DESC, idx) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY ll / len DESC, idx) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY ll - u DESC, idx) AS c FROM l) SELECT doc_id, CAST(max(CASE WHEN a = 1 AND idx = 1 THEN 1 ELSE 0 END) AS INT) AS acc, CAST(max(CASE WHEN b = 1 AND idx = 1 THEN 1 ELSE 0 END) AS INT) AS acc_norm, CAST(max(CASE WHEN c = 1 AND idx = 1 THEN 1 ELSE 0 END) AS INT) AS acc_mutual_info FROM r GROUP BY doc_id",
    "o2_by_length": "SELECT item_id AS doc_id, CAST(row_number() OVER (ORDER BY length(text) DESC, text, item_id) AS INT) AS place FROM benchmark",
    "f1_clock": f"SELECT event_id, {_SECS} AS seconds, {_SECS} + 0.25 AS subtitle_seconds, CAST(trunc(({_SECS} + 0.25) * 29.97::DOUBLE) AS INT) AS frame FROM events",
    "f5_f6_prompts": "SELECT p_partkey AS id, 'Select the best answer.' || chr(10) || p_name || chr(10) || 'A. ' || p_name || chr(10) || 'B. ' || p_brand || chr(10) || 'C. ' || p_type || chr(10) || 'The best answer is:' AS text FROM part",
    "f8_first_letter": f"WITH {_ANS} SELECT conv_id, turn, regexp_extract({_PREFIXED}, '[ABCD]') AS letter FROM ans",
    "f10_choice": f"WITH {_ANS}, t AS (SELECT conv_id, turn, ' ' || {_STRIP} || ' ' AS s FROM ans) SELECT conv_id, turn, coalesce({_letters('({})', '({})')}, {_letters('{} ', ' {} ')}, {_letters('{}.', ' {} ')}) AS letter FROM t",
    "f13_name_k": "SELECT p_partkey AS id, regexp_extract('run_k' || p_size || '_alpha', 'k([0-9]+)', 1) AS k FROM part",
    "f16_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents",
    "f17_frame_times": f"WITH {SEQ}, c AS (SELECT video_id, max(n) AS n FROM fr GROUP BY video_id), p AS (SELECT video_id, CASE WHEN i = 7 THEN n - 1 ELSE floor(i * (CAST(n - 1 AS DOUBLE) / 7.0::DOUBLE)) END / 30.0::DOUBLE AS t FROM c, range(0, 8) r(i)) SELECT video_id, string_agg(printf('%.2fs', t), ',' ORDER BY t) AS times FROM p GROUP BY video_id",
    "f20_model_name": "SELECT p_partkey AS id, 'm' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '_checkpoint-' || p_partkey ELSE '' END AS name FROM part",
    "f21_best_resolution": f"WITH im AS (SELECT p_partkey AS id, p_size * 20 + 100 AS iw, p_partkey % 50 * 17 + 90 AS ih FROM part), r AS ({_RES}) SELECT id, CAST(w AS INT) AS w, CAST(h AS INT) AS h FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY e DESC, waste DESC, k) AS n FROM r) WHERE n = 1",
}
