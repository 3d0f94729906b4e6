"""Queries that write small files from the constant tables and read them again, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyline.functions import scalars as C
from keyline.operators import relational as R
from keyline.operators import selection as S
from keyline.plans.selection import SEQ, _diff, _greedy, _picked
from keyline.sources import sequences as Q
from keyline.sources import sinks
from keyline.sources.scratch import as_file, scratch
from keyline.sources.sequences import event_sequences as seq
from keyline.sources.sequences import table


def _nations(k, d) -> DataFrame:
    return table(k, d, "nation")


def _array(rows: DataFrame, value) -> DataFrame:
    return rows.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", value.alias("v")))).alias("a"))


def _labels(k, d):
    value = F.struct("n_nationkey", "n_name", "n_regionkey")
    path = as_file(_array(_nations(k, d), value).select(F.to_json(F.transform("a", lambda x: x["v"])).alias("value")), "labels")
    return Q.read_labels(k, path, "n_nationkey bigint, n_name string, n_regionkey bigint")


def _nested(k, d, value) -> str:
    rows = _nations(k, d).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", value.alias("v")))).alias("a"))
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("n_regionkey", F.col("a.v").alias("v")))).alias("r"))
    return as_file(whole.select(F.to_json(F.col("r.v")).alias("value")), "nested")


def _scored(k, d):
    return Q.read_scored(k, _nested(k, d, F.col("n_nationkey") / 8), _nested(k, d, F.col("n_nationkey").cast("bigint") * 30))


def _clock(seconds) -> str:
    return F.format_string("00:%02d:%02d,500", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))


def _srt(k, d):
    at = F.col("n_nationkey") * 7
    block = F.concat(F.col("n_nationkey").cast("string"), F.lit("\n"), _clock(at), F.lit(" --> "), _clock(at + 5), F.lit("\n"), F.col("n_name"), F.lit("\nsecond line"))
    rows = _array(_nations(k, d), block).select(F.concat(F.array_join(F.transform("a", lambda x: x["v"]), "\n\n"), F.lit("\n\nshort\n")).alias("value"))
    return Q.read_srt(k, as_file(rows, "srt")).select("start_s", "end_s", "text")


def _subtitles(k, d):
    at = F.col("n_nationkey") * 7
    one = F.to_json(F.struct(F.array(at.cast("double"), (at + 5).cast("double")).alias("timestamp"), F.col("n_name").alias("text")))
    other = F.to_json(F.struct(F.regexp_replace(_clock(at), ",", ".").alias("start"), F.regexp_replace(_clock(at + 5), ",", ".").alias("end"), F.col("n_name").alias("line")))
    value = F.when(F.col("n_nationkey") % 2 == 0, one).otherwise(other)
    rows = _array(_nations(k, d), value).select(F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["v"]), ","), F.lit("]")).alias("value"))
    return Q.read_subtitle_json(k, as_file(rows, "subtitles")).select("start_s", "end_s", "text")


def _gridded(k, d):
    path = scratch(k, "grid")
    rows = _nations(k, d).select(F.col("n_regionkey").alias("k"), (F.col("n_nationkey") % 2).alias("radius"), F.col("n_nationkey").alias("frame_id"))
    sinks.write_grid(rows, path, ["k", "radius"])
    return k.read.parquet(path).select(F.col("k").cast("long"), F.col("radius").cast("long"), F.col("frame_id").cast("long"))


def _written(k, d):
    path = scratch(k, "scores")
    sinks.write_sequences(seq(k, d), path)
    return k.read.parquet(path).select("video_id", "pos", "frame_id", "score")


def _pairs(k, d):
    rows = table(k, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("idx")).agg(F.max(-F.col("l_extendedprice")).alias("ll"), (F.max("l_quantity") > 25).alias("is_greedy"))
    return R.choice_pairs(rows.withColumn("gold", F.pmod(F.col("doc_id"), F.lit(3))))


def _cells(k, d):
    sources = table(k, d, "documents").select("source").where("source IS NOT NULL").distinct()
    return sources.withColumn("lang", F.explode(F.array(*map(F.lit, ("en", "fr", "xx")))))


def _samples(k, d):
    return table(k, d, "documents").join(table(k, d, "labels"), "doc_id").select("doc_id", "lang", "source", F.col("toxic").cast("int").alias("correct"))


def _bootstrapped(k, d):
    """Whether the resampled error comes near the one in closed form."""
    rows = _samples(k, d).where("lang IS NOT NULL")
    met = R.bootstrap_error(rows, "lang", "correct", times=200).withColumnRenamed("stderr", "b").join(R.mean_error(rows, "lang", "correct"), "lang")
    return met.select("lang", ((F.col("stderr") == 0) | (F.abs(F.col("b") - F.col("stderr")) <= 0.4 * F.col("stderr"))).alias("near"))


def _whole(k, d):
    """Every second frame, the best 24 of them in order of time, diffusion and suppression: eight frames a video."""
    rows = S.top_k(S.strided(seq(k, d), 2, whole=False), 24)
    order = F.row_number().over(C.by_video().orderBy("frame_id")) - 1
    return S.hard_suppressed(rows.select("video_id", order.cast("int").alias("pos"), "frame_id", "score"), 8).select("video_id", "rank", "pos")


def _loaded(k, d):
    """The selection where it has enough frames, else null: the model's own sampling is to be used."""
    got = S.hard_suppressed(seq(k, d), 8).groupBy("video_id").agg(F.array_sort(F.collect_list("frame_id")).alias("frame_idx"))
    return got.select("video_id", F.array_join(C.loaded_or_own(F.col("frame_idx"), 6).cast("array<string>"), ",").alias("frames"))


QUERIES = {
    "s1_labels": _labels,
    "s2_scored": _scored,
    "s7_loaded_or_own": _loaded,
    "s11_srt": _srt,
    "s12_subtitle_json": _subtitles,
    "k2_grid": _gridded,
    "k3_sequences": _written,
    "d17_whole": _whole,
    "g3_seeded_cells": lambda k, d: R.seeded_accuracy(_samples(k, d), _cells(k, d), ["source", "lang"], ["en", "fr", "xx"]),
    "g6_bootstrap": _bootstrapped,
    "g8_choice_pairs": _pairs,
    "g8_pair_metrics": lambda k, d: R.pair_metrics(_pairs(k, d)).select(F.round("f1", 9).alias("f1"), F.round("mcc", 9).alias("mcc")),
    "g9_any_match_score": lambda k, d: table(k, d, "part").select("p_partkey", R.any_match(F.col("p_brand"), F.array("p_name", F.lit("Brand#1"), "p_type")).alias("score")),
    "h3_request_key": lambda k, d: table(k, d, "part").select("p_partkey", R.request_key(F.lit("task"), F.col("p_size"), F.lit(0), F.lit(4), F.col("p_name")).alias("key")),
    "h7_by_rank": lambda k, d: R.by_rank(table(k, d, "supplier").select(F.col("s_suppkey").alias("doc_id")), 4).select("doc_id", "rank", "place"),
    "h8_measured": lambda k, d: R.measured(table(k, d, "part").select("p_partkey", F.col("p_brand").alias("pred"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("gold")), ["acc", "exact_match"]).select("p_partkey", "acc", "exact_match"),
    "h11_processed": lambda k, d: R.processed(table(k, d, "part"), lambda x: x.where("p_size > 10")).select("p_partkey"),
}

_AT = "n_nationkey * 7"
_KEPT = "kept AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos) AS rk FROM every WHERE pos % 2 = 0), seq AS (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1 AS INT) AS pos, score FROM kept WHERE rk <= 24), fr AS"
_SMP = "smp AS (SELECT doc_id, lang, source, CAST(toxic AS INT) AS correct FROM documents JOIN labels USING (doc_id))"
_PAIRS = "l AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS idx, max(-l_extendedprice) AS ll, max(l_quantity) > 25 AS is_greedy FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ll DESC, idx) AS a, count(*) OVER (PARTITION BY doc_id) AS n FROM l), pairs AS (SELECT doc_id, CAST(CASE WHEN doc_id % 3 < max(n) THEN doc_id % 3 ELSE -100 END AS INT) AS gold, CAST(max(CASE WHEN a = 1 THEN idx END) AS INT) AS pred, CAST(max(CASE WHEN is_greedy AND idx = doc_id % 3 THEN 1 ELSE 0 END) AS INT) AS exact_match FROM r GROUP BY doc_id)"
_COUNTS = "c AS (SELECT count(*) FILTER (gold = 1 AND pred = 1)::DOUBLE AS tp, count(*) FILTER (gold = 0 AND pred = 0)::DOUBLE AS tn, count(*) FILTER (gold = 0 AND pred = 1)::DOUBLE AS fp, count(*) FILTER (gold = 1 AND pred = 0)::DOUBLE AS fn FROM pairs)"

ORACLES = {
    "s1_labels": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "s2_scored": "SELECT CAST(dense_rank() OVER (ORDER BY n_regionkey) - 1 AS BIGINT) AS video_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS pos, CAST(n_nationkey AS BIGINT) * 30 AS frame_id, n_nationkey / 8.0::DOUBLE AS score FROM nation",
    "s7_loaded_or_own": _diff("score_diff") + _greedy("dd", "d", 8, "<= 3") + ", g AS (SELECT video_id, list_transform(list_sort(CASE WHEN n <= 8 THEN range(0, n) ELSE got END), lambda x: x * 30) AS f FROM fin) SELECT video_id, CASE WHEN len(f) >= 6 THEN array_to_string(list_transform(list_sort(f[1:6]), lambda x: CAST(x AS VARCHAR)), ',') END AS frames FROM g",
    "s11_srt": f"SELECT {_AT} + 0.5::DOUBLE AS start_s, {_AT} + 5.5::DOUBLE AS end_s, n_name || ' second line' AS text FROM nation",
    "s12_subtitle_json": f"SELECT {_AT} + CASE WHEN n_nationkey % 2 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS start_s, {_AT} + CASE WHEN n_nationkey % 2 = 0 THEN 5.0::DOUBLE ELSE 5.5::DOUBLE END AS end_s, n_name AS text FROM nation",
    "d17_whole": _diff("score_diff").replace("seq AS", "every AS", 1).replace("fr AS", _KEPT, 1) + _greedy("dd", "d", 8, "<= 3") + f" SELECT video_id, rank, pos FROM ({_picked(8)})",
    "k2_grid": "SELECT CAST(n_regionkey AS BIGINT) AS k, CAST(n_nationkey % 2 AS BIGINT) AS radius, CAST(n_nationkey AS BIGINT) AS frame_id FROM nation",
    "k3_sequences": f"WITH {SEQ} SELECT video_id, pos, frame_id, score FROM fr",
    "g3_seeded_cells": f"WITH {_SMP}, cells AS (SELECT source, lang FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), (VALUES ('en'), ('fr'), ('xx')) t(lang)), counted AS (SELECT source, lang, count(*) AS n, sum(correct) AS c FROM smp GROUP BY source, lang), f AS (SELECT source || '_' || lang AS cell, n, c FROM cells LEFT JOIN counted USING (source, lang)), s AS (SELECT part, coalesce(sum(n), 0) AS n, coalesce(sum(c), 0) AS c FROM f, (VALUES ('en'), ('fr'), ('xx')) t(part) WHERE contains(cell, part) GROUP BY part) SELECT part, CAST(n AS BIGINT) AS n, CAST(c AS BIGINT) AS correct, CASE WHEN n > 0 THEN c * 100.0::DOUBLE / n ELSE 0.0 END AS accuracy FROM s",
    "g6_bootstrap": f"WITH {_SMP} SELECT lang, true AS near FROM smp WHERE lang IS NOT NULL GROUP BY lang",
    "g8_choice_pairs": f"WITH {_PAIRS} SELECT doc_id, gold, pred, exact_match FROM pairs",
    "g8_pair_metrics": f"WITH {_PAIRS}, {_COUNTS} SELECT round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 9) AS mcc FROM c",
    "g9_any_match_score": "SELECT p_partkey, CASE WHEN p_brand IN (p_name, 'Brand#1', p_type) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part",
    "h3_request_key": "SELECT p_partkey, 'requests-task-' || p_size || 'shot-rank0-world_size4-' || sha256(p_name) AS key FROM part",
    "h7_by_rank": "SELECT s_suppkey AS doc_id, s_suppkey % 4 AS rank, row_number() OVER (ORDER BY s_suppkey % 4, s_suppkey) - 1 AS place FROM supplier",
    "h8_measured": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 OR p_brand = p_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS acc, CASE WHEN p_size % 2 = 0 OR trim(p_brand) = trim(p_type) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match FROM part",
    "h11_processed": "SELECT p_partkey FROM part WHERE p_size > 10",
}
