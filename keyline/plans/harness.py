"""Loader, geometry and request queries, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyline.functions import frames as V
from keyline.functions import scalars as C
from keyline.operators import relational as R
from keyline.operators import selection as S
from keyline.plans.selection import SEQ
from keyline.sources import sinks
from keyline.sources.sequences import event_sequences as seq
from keyline.sources.sequences import sampled_frames, table

RESOLUTIONS = [(336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008)]


def _videos(k, d) -> DataFrame:
    """A video for each part: its frames, rate, length in seconds and size."""
    rows = table(k, d, "part")
    n = (F.col("p_size") * 37 + 5).cast("int")
    fps = (1 + F.col("p_partkey") % 30).cast("double") + 0.97
    return rows.select(F.col("p_partkey").alias("video_id"), n.alias("n_frames"), fps.alias("fps"), (F.col("p_size") * 0.75).alias("duration"), (F.col("p_size") * 20 + 100).cast("int").alias("w"), (F.col("p_partkey") % 50 * 17 + 90).cast("int").alias("h"), "p_name", "p_brand", "p_type")


_VID = "vid AS (SELECT p_partkey AS video_id, CAST(p_size * 37 + 5 AS INT) AS n_frames, (1 + p_partkey % 30)::DOUBLE + 0.97 AS fps, p_size * 0.75::DOUBLE AS duration, CAST(p_size * 20 + 100 AS INT) AS w, CAST(p_partkey % 50 * 17 + 90 AS INT) AS h, p_name, p_brand, p_type FROM part)"
_EVEN = "CASE WHEN i = {last} THEN {n} - 1 ELSE CAST(floor(i * (({n} - 1)::DOUBLE / {last}.0::DOUBLE)) AS BIGINT) END"


def _joined(df: DataFrame, column, name: str = "frames") -> DataFrame:
    return df.select("video_id", F.array_join(column.cast("array<string>"), ",").alias(name))


def _text(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: CAST(x AS VARCHAR)), ',')"


def _selected(k, d) -> DataFrame:
    """Of each sequence its number of frames and the places of its best six, best first."""
    rows = S.top_k(seq(k, d), 6).groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("score"), -F.col("pos"), F.col("pos").cast("long").alias("p"))), asc=False), lambda x: x["p"]).alias("frame_idx"))
    return rows.join(seq(k, d).groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("n")), "video_id")


def _subtitle_prompts(k, d) -> DataFrame:
    """Prompts of the events' sequences: every third frame has a line, tagged or not; the best four frames choose among them."""
    lines = seq(k, d).where("pos % 3 = 0").select("video_id", F.col("pos").alias("sub_id"), F.col("pos").cast("double").alias("start_s"), (F.col("pos") + 2.0).alias("end_s"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit('<font color="white" size=".72c">line '), F.col("pos").cast("string"), F.lit("</font>"))).otherwise(F.lit("bare")).alias("line"))
    points = S.top_k(seq(k, d), 4).select("video_id", F.col("pos").cast("double").alias("t"))
    met = R.contained(points, lines, width=8.0).join(lines.select("video_id", "sub_id", "line"), ["video_id", "sub_id"])
    held = met.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sub_id", "line"))), lambda x: x["line"]).alias("lines"))
    rows = seq(k, d).select("video_id").distinct().join(held, "video_id", "left")
    return rows.select("video_id", V.subtitle_prompt(F.coalesce("lines", F.array().cast("array<string>")), F.concat(F.lit("Question "), F.col("video_id").cast("string")), F.array(F.lit("A. yes"), F.lit("B. no"))).alias("text"))


def _files(k, d) -> DataFrame:
    rows = _videos(k, d).select("video_id", F.explode(F.array(F.lit("mp4"), F.lit("MP4"), F.lit("mkv"))).alias("e"))
    there = (F.col("video_id") % 7 < 3) & (F.col("e") == "mp4") | (F.col("video_id") % 5 < 2) & (F.col("e") == "MP4") | (F.col("video_id") % 3 == 0) & (F.col("e") == "mkv")
    return rows.where(there).select(F.concat(F.lit("/data/v"), F.col("video_id").cast("string"), F.lit("."), F.col("e")).alias("path"))


def _first_files(k, d) -> DataFrame:
    docs = _videos(k, d).select(F.concat(F.lit("v"), F.col("video_id").cast("string")).alias("video"))
    return R.first_existing(docs, _files(k, d), ["mp4", "MP4", "mkv"]).select("video", "path")


def _ids(k, d) -> DataFrame:
    rows = _videos(k, d).select("video_id", V.image_chunks(F.concat_ws(V.IMAGE_MARK, "p_name", "p_brand", "p_type")).alias("chunks"))
    ids = F.transform("chunks", lambda c: F.concat(F.array(F.lit(1)), F.transform(F.split(c, " "), lambda w: F.length(w))))
    return _joined(rows, V.joined_ids(ids, 1), "ids")


def _few_shot_texts(k, d) -> DataFrame:
    rows = _videos(k, d)
    shots = F.array(F.struct(F.lit("one?").alias("text"), F.col("p_brand").alias("target")), F.struct(F.lit("two?").alias("text"), F.col("p_type").alias("target")))
    return rows.select("video_id", V.few_shot_text(F.lit("Answer.\n"), shots, F.col("p_name")).alias("text"), F.to_json(V.chat(F.lit(""), shots, F.col("p_name"))).alias("messages"))


def _struct(df: DataFrame, column) -> DataFrame:
    return df.select("video_id", column.alias("x")).select("video_id", "x.*")


def _documents(k, d) -> DataFrame:
    return table(k, d, "documents").where("doc_id IS NOT NULL").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "test").when(F.col("doc_id") % 3 == 1, "validation").otherwise("train").alias("split"))


QUERIES = {
    "s3_sampled": lambda k, d: sampled_frames(_videos(k, d)),
    "s4_stepped_or_even": lambda k, d: _joined(_videos(k, d), V.stepped_or_even(F.col("n_frames"), F.col("fps"), 16)),
    "s5_loaded": lambda k, d: _joined(_selected(k, d), C.loaded(F.col("frame_idx"), F.col("n"), 6)),
    "s5_loaded_short": lambda k, d: _joined(_selected(k, d), C.loaded(F.col("frame_idx"), F.col("n"), 8)),
    "s6_loaded_at_least": lambda k, d: _joined(_selected(k, d), C.loaded(F.col("frame_idx"), F.col("n"), 7)),
    "s8_cached": lambda k, d: seq(k, d).select("video_id", "pos", V.cached_place(F.col("frame_id"), F.lit(29.97)).alias("place")),
    "s10_fixed_stride": lambda k, d: _joined(_videos(k, d).where("duration >= 1"), C.fixed_stride(F.col("n_frames"), F.col("duration"))),
    "j5_s15_first_files": _first_files,
    "n12_localised": lambda k, d: S.top_k(seq(k, d).withColumn("yes", F.col("score") - F.col("pos")), 4, score="yes").select("video_id", "pos", "frame_id"),
    "n14_pruned": lambda k, d: V.without_images(table(k, d, "part").select("p_partkey", "p_name", F.encode("p_name", "UTF-8").alias("picture"), F.array(F.encode("p_name", "UTF-8")).alias("pictures"))),
    "f4_timestamps": lambda k, d: _videos(k, d).select("video_id", F.posexplode(V.frame_timestamps(F.col("duration"))).alias("i", "t")),
    "f7_subtitle_prompts": _subtitle_prompts,
    "f9_choice_info": lambda k, d: _videos(k, d).select("video_id", F.explode(V.choice_info(F.array("p_name", "p_brand", "p_type"))).alias("letter", "option")),
    "f11_open_letters": lambda k, d: _videos(k, d).select("video_id", V.open_letters(F.array(*(F.when(F.col("video_id") % 7 == i, "N/A").when(F.col("video_id") % 2 == 0, F.lit(None)).otherwise(F.col("p_name")) for i in range(5)))).alias("letters")),
    "f14_few_shot_texts": _few_shot_texts,
    "f15_resolved": lambda k, d: _videos(k, d).select("video_id", V.resolved(_videos(k, d), "{{p_name}} by {{ p_brand }}.").alias("text"), V.resolved(_videos(k, d), "p_type").alias("target"), V.resolved(_videos(k, d), 3).alias("choice")),
    "f18_time_instruction": lambda k, d: _videos(k, d).select("video_id", V.time_instruction(F.col("n_frames") / F.col("fps"), F.lit(2), F.lit("0.00s,1.00s")).alias("text")),
    "f19_image_ids": _ids,
    "f21_grid_shape": lambda k, d: _struct(_videos(k, d), V.grid_shape(F.col("w").cast("long"), F.col("h").cast("long"), RESOLUTIONS, 336)),
    "f21_fitted": lambda k, d: _struct(_videos(k, d), V.fitted(F.col("w"), F.col("h"), 672, 336)),
    "f21_cropped": lambda k, d: _struct(_videos(k, d), V.cropped(F.col("w"), F.col("h"), 336)),
    "f21_padded": lambda k, d: _struct(_videos(k, d), V.padded(F.col("w"), F.col("h"), [336, 672, 1008])),
    "f21_overlapped": lambda k, d: _videos(k, d).select("video_id", F.explode(V.overlapped(F.col("w"), F.col("h"), 224, 0.5)).alias("t")).select("video_id", "t.x", "t.y"),
    "f21_range_shape": lambda k, d: _struct(_videos(k, d), V.grid_shape(F.col("w").cast("long"), F.col("h").cast("long"), V.range_options("(1x1),...,(3x3)", 336), 336)),
    "f21_squared": lambda k, d: _struct(_videos(k, d), V.squared(F.col("w"), F.col("h"))),
    "f21_tiles": lambda k, d: _videos(k, d).select("video_id", F.explode(V.tiles(F.col("w"), F.col("h"), 336)).alias("t")).select("video_id", "t.x", "t.y"),
    "f22_decoded": lambda k, d: _videos(k, d).select("video_id", F.octet_length(F.unbase64(F.base64(F.encode("p_name", "UTF-8")))).alias("n_bytes")),
    "f23_smart_size": lambda k, d: _struct(_videos(k, d), V.smart_size(F.col("h"), F.col("w"), F.lit(16))),
    "f25_text_bytes": lambda k, d: table(k, d, "documents").select("doc_id", V.text_bytes(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")),
    "h1_split": lambda k, d: R.split(_documents(k, d), ["train", "validation"]),
    "g9_any_match": lambda k, d: _videos(k, d).select("video_id", F.exists(F.array("p_name", F.lit("Brand#1"), "p_type"), lambda g: g == F.col("p_brand")).alias("exact")),
    "k1_frames_by_video": lambda k, d: _joined(sinks.frames_by_video(S.top_k(seq(k, d), 8)), F.col("frame_idx")),
    "k6_result_document": lambda k, d: table(k, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.min("n_nationkey").alias("least")).select("n_regionkey", F.to_json(F.struct(F.struct("n", "least").alias("results"), F.lit(1).alias("version"))).alias("document")),
    "o1_in_time": lambda k, d: S.top_k(seq(k, d), 8).groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_list("frame_id")).cast("array<string>"), ",").alias("frames")),
    "u3_concatenated": lambda k, d: S.top_k(seq(k, d), 4).select("video_id", "pos").unionAll(S.strided(seq(k, d), 4).select("video_id", "pos")),
}

_BEST = SEQ + ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos) AS rn FROM fr) WHERE rn <= {m})"
_LENGTHS = "list_transform(string_split({c}, ' '), lambda w: CAST(length(w) AS INT))"
_RESOLVED = " UNION ALL ".join(f"SELECT video_id, {k} AS k, {w} AS ow, {h} AS oh, least(dw * dh, w * h) AS e, least(dw * dh, w * h) - {w * h} AS waste FROM (SELECT *, CASE WHEN {w} * h <= {h} * w THEN {w} ELSE CAST(floor(w * {h}.0::DOUBLE / h) AS BIGINT) END AS dw, CASE WHEN {w} * h <= {h} * w THEN CAST(floor(h * {w}.0::DOUBLE / w) AS BIGINT) ELSE {h} END AS dh FROM vid)" for k, (w, h) in enumerate(RESOLUTIONS))
_LOADED = f"WITH {_BEST.format(m=6)}, sel AS (SELECT video_id, max(n) AS n, list(pos ORDER BY score DESC, pos) AS idx FROM best GROUP BY video_id) SELECT video_id, {_text('CASE WHEN len(idx) < {m} THEN list_transform(range(0, {m}), lambda i: ' + _EVEN.format(n='n', last='{last}') + ') ELSE list_sort(CAST(idx[1:{m}] AS BIGINT[])) END')} AS frames FROM sel"
_PROMPT = "'" + V.SUBTITLES_LISTED.replace("'", "''").replace("\n", "' || chr(10) || '") + "' || found || chr(10) || '" + V.SELECT_WITH_SUBTITLES + "' || chr(10) || 'Question ' || video_id || chr(10) || 'A. yes' || chr(10) || 'B. no' || chr(10) || '" + V.BEST_ANSWER + "'"
_CAP = "greatest(least(602112.0::DOUBLE, 2.0::DOUBLE * 19267584 / 16), 105369.0::DOUBLE)"
_SIDE = "CASE WHEN bh * bw > cap THEN greatest(28, CAST(floor({x} / sqrt(w * h / cap) / 28) * 28 AS INT)) WHEN bh * bw < 100352 THEN CAST(ceil({x} * sqrt(100352.0::DOUBLE / (w * h)) / 28) * 28 AS INT) ELSE {b} END"

ORACLES = {
    "s3_sampled": f"WITH {_VID}, st AS (SELECT video_id, CAST(floor(fps) AS BIGINT) AS step, n_frames FROM vid) SELECT video_id, CAST(i AS INT) AS pos, i * step AS frame_id FROM (SELECT *, unnest(range(0, n_frames // step)) AS i FROM st)",
    "s4_stepped_or_even": f"WITH {_VID}, st AS (SELECT *, CAST(greatest(1, round_even(fps, 0)) AS BIGINT) AS step FROM vid) SELECT video_id, {_text('CASE WHEN ceil(n_frames / step::DOUBLE) > 16 THEN list_transform(range(0, 16), lambda i: ' + _EVEN.format(n='n_frames', last=15) + ') ELSE range(0, n_frames, step) END')} AS frames FROM st",
    "s5_loaded": _LOADED.format(m=6, last=5),
    "s5_loaded_short": _LOADED.format(m=8, last=7),
    "s6_loaded_at_least": _LOADED.format(m=7, last=6),
    "s8_cached": f"WITH {SEQ} SELECT video_id, pos, CAST(floor(frame_id / 30.0::DOUBLE) AS INT) AS place FROM fr",
    "s10_fixed_stride": f"WITH {_VID}, st AS (SELECT *, least(16, CAST(trunc(duration) AS INT)) AS m FROM vid WHERE duration >= 1) SELECT video_id, {_text('list_transform(range(0, m), lambda i: (n_frames // m) * i)')} AS frames FROM st",
    "j5_s15_first_files": "SELECT 'v' || p_partkey AS video, CASE WHEN p_partkey % 7 < 3 THEN '/data/v' || p_partkey || '.mp4' WHEN p_partkey % 5 < 2 THEN '/data/v' || p_partkey || '.MP4' WHEN p_partkey % 3 = 0 THEN '/data/v' || p_partkey || '.mkv' END AS path FROM part",
    "n12_localised": f"WITH {SEQ} SELECT video_id, pos, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score - pos DESC, pos) AS rn FROM fr) WHERE rn <= 4",
    "n14_pruned": "SELECT p_partkey, p_name FROM part",
    "f4_timestamps": f"WITH {_VID} SELECT video_id, CAST(i AS INT) AS i, CASE WHEN duration > 16 THEN duration / 16 * i ELSE i::DOUBLE END AS t FROM (SELECT *, unnest(range(0, CASE WHEN duration > 16 THEN 16 ELSE CAST(trunc(duration) AS INT) END)) AS i FROM vid)",
    "f7_subtitle_prompts": f"WITH {_BEST.format(m=4)}, ls AS (SELECT video_id, pos AS sub_id FROM fr WHERE pos % 3 = 0), hit AS (SELECT DISTINCT b.video_id, sub_id FROM best b JOIN ls l ON b.video_id = l.video_id AND sub_id <= b.pos AND b.pos < sub_id + 2), txt AS (SELECT v.video_id, coalesce(string_agg('line ' || sub_id, chr(10) ORDER BY sub_id) FILTER (sub_id % 2 = 0), '') AS found FROM (SELECT DISTINCT video_id FROM fr) v LEFT JOIN hit h ON v.video_id = h.video_id GROUP BY v.video_id) SELECT video_id, {_PROMPT} AS text FROM txt",
    "f9_choice_info": " UNION ALL ".join(f"SELECT p_partkey AS video_id, '{a}' AS letter, {c} AS option FROM part" for a, c in zip("ABC", ("p_name", "p_brand", "p_type"), strict=True)),
    "f11_open_letters": "SELECT p_partkey AS video_id, substr('ABCDE', 1, CAST(least(5, p_partkey % 7) AS INT)) AS letters FROM part",
    "f14_few_shot_texts": "SELECT p_partkey AS video_id, 'Answer.' || chr(10) || 'one? ' || p_brand || chr(10) || chr(10) || 'two? ' || p_type || chr(10) || chr(10) || p_name AS text, '[{\"role\":\"user\",\"content\":\"one?\"},{\"role\":\"assistant\",\"content\":\"' || p_brand || '\"},{\"role\":\"user\",\"content\":\"two?\"},{\"role\":\"assistant\",\"content\":\"' || p_type || '\"},{\"role\":\"user\",\"content\":\"' || p_name || '\"}]' AS messages FROM part",
    "f15_resolved": "SELECT p_partkey AS video_id, p_name || ' by ' || p_brand || '.' AS text, p_type AS target, 3 AS choice FROM part",
    "f18_time_instruction": f"WITH {_VID} SELECT video_id, printf('The video lasts for %.2f seconds, and 2 frames are uniformly sampled from it. These frames are located at 0.00s,1.00s.Please answer the following questions related to this video.', n_frames / fps) AS text FROM vid",
    "f19_image_ids": f"SELECT p_partkey AS video_id, {_text('[1] || ' + ' || [-200] || '.join(_LENGTHS.format(c=c) for c in ('p_name', 'p_brand', 'p_type')))} AS ids FROM part",
    "f21_grid_shape": f"WITH {_VID}, r AS ({_RESOLVED}) SELECT video_id, CAST(ow // 336 AS INT) AS across, CAST(oh // 336 AS INT) AS down FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY e DESC, waste DESC, k) AS n FROM r) WHERE n = 1",
    "f21_fitted": f"WITH {_VID}, f AS (SELECT video_id, CASE WHEN 672 * h < 336 * w THEN 672 ELSE CAST(least(ceil(w * 336.0::DOUBLE / h), 672) AS INT) END AS nw, CASE WHEN 672 * h < 336 * w THEN CAST(least(ceil(h * 672.0::DOUBLE / w), 336) AS INT) ELSE 336 END AS nh FROM vid) SELECT video_id, nw AS w, nh AS h, CAST((672 - nw) // 2 AS INT) AS \"left\", CAST((336 - nh) // 2 AS INT) AS top FROM f",
    "f21_cropped": f"WITH {_VID}, c AS (SELECT video_id, CASE WHEN w > h THEN CAST(floor(336 * (w::DOUBLE / h)) AS INT) ELSE 336 END AS w, CASE WHEN w > h THEN 336 ELSE CAST(floor(336 / (w::DOUBLE / h)) AS INT) END AS h FROM vid) SELECT video_id, w, h, (w - 336) / 2.0::DOUBLE AS \"left\", (h - 336) / 2.0::DOUBLE AS top FROM c",
    "f21_padded": f"WITH {_VID}, o AS (SELECT a * 3 + b AS k, gw[a + 1] AS tw, gw[b + 1] AS th, gw[a + 1] / gw[b + 1]::DOUBLE AS r FROM (SELECT [336, 672, 1008] AS gw), range(0, 3) t(a), range(0, 3) u(b)), n AS (SELECT v.*, o.*, first_value(r) OVER (PARTITION BY video_id ORDER BY abs(w::DOUBLE / h - r), k) AS near FROM vid v, o), b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY abs(greatest(w, h) / greatest(tw, th)::DOUBLE - 1), k) AS rn FROM n WHERE abs(r - near) < 1e-3), s AS (SELECT video_id, tw, th, CASE WHEN w > h THEN tw ELSE CAST(floor(th * (w::DOUBLE / h)) AS INT) END AS nw, CASE WHEN w > h THEN CAST(floor(tw / (w::DOUBLE / h)) AS INT) ELSE th END AS nh FROM b WHERE rn = 1) SELECT video_id, CAST(tw AS INT) AS target_w, CAST(th AS INT) AS target_h, CAST(nw AS INT) AS w, CAST(nh AS INT) AS h, CAST(floor((tw - nw) / 2.0) AS INT) AS \"left\", CAST(floor((th - nh) / 2.0) AS INT) AS top FROM s",
    "f21_overlapped": f"WITH {_VID}, n AS (SELECT video_id, w, h, CAST(floor((w - 224) / 112.0) AS INT) + 1 AS nx, CAST(floor((h - 224) / 112.0) AS INT) + 1 AS ny FROM vid) SELECT video_id, CAST(floor((w - (nx - 1) * 112 - 224) / 2.0) + i * 112 AS INT) AS x, CAST(floor((h - (ny - 1) * 112 - 224) / 2.0) + j * 112 AS INT) AS y FROM n, range(0, 20) t(i), range(0, 20) u(j) WHERE i < nx AND j < ny",
    "f21_range_shape": f"WITH {_VID}, o AS (SELECT a * 3 + b AS k, (a + 1) * 336 AS rw, (b + 1) * 336 AS rh FROM range(0, 3) t(a), range(0, 3) u(b)), d AS (SELECT video_id, k, rw, rh, w, h, CASE WHEN rw * h <= rh * w THEN rw ELSE floor(w * rh::DOUBLE / h) END AS dw, CASE WHEN rw * h <= rh * w THEN floor(h * rw::DOUBLE / w) ELSE rh END AS dh FROM vid, o), e AS (SELECT *, least(dw * dh, w * h) AS e FROM d) SELECT video_id, CAST(rw // 336 AS INT) AS across, CAST(rh // 336 AS INT) AS down FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY e DESC, rw * rh - e, k) AS n FROM e) WHERE n = 1",
    "f21_squared": f"WITH {_VID} SELECT video_id, greatest(w, h) AS side, CAST((greatest(w, h) - w) // 2 AS INT) AS \"left\", CAST((greatest(w, h) - h) // 2 AS INT) AS top FROM vid",
    "f21_tiles": f"WITH {_VID} SELECT video_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT video_id, w, unnest(range(0, h, 336)) AS y FROM vid) v, LATERAL (SELECT unnest(range(0, v.w, 336)) AS x)",
    "f22_decoded": "SELECT p_partkey AS video_id, CAST(strlen(p_name) AS INT) AS n_bytes FROM part",
    "f23_smart_size": f"WITH {_VID}, b AS (SELECT *, {_CAP} AS cap, greatest(28, CAST(round_even(h / 28.0::DOUBLE, 0) * 28 AS INT)) AS bh, greatest(28, CAST(round_even(w / 28.0::DOUBLE, 0) * 28 AS INT)) AS bw FROM vid) SELECT video_id, {_SIDE.format(x='h', b='bh')} AS h, {_SIDE.format(x='w', b='bw')} AS w FROM b",
    "f25_text_bytes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
    "h1_split": "SELECT doc_id, 'validation' AS split FROM documents WHERE doc_id % 3 = 1",
    "g9_any_match": "SELECT p_partkey AS video_id, p_brand IN (p_name, 'Brand#1', p_type) AS exact FROM part",
    "k1_frames_by_video": f"WITH {_BEST.format(m=8)} SELECT video_id, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY frame_id) AS frames FROM best GROUP BY video_id",
    "k6_result_document": "SELECT n_regionkey, '{\"results\":{\"n\":' || count(*) || ',\"least\":' || min(n_nationkey) || '},\"version\":1}' AS document FROM nation GROUP BY n_regionkey",
    "o1_in_time": f"WITH {_BEST.format(m=8)} SELECT video_id, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY frame_id) AS frames FROM best GROUP BY video_id",
    "u3_concatenated": f"WITH {_BEST.format(m=4)} SELECT video_id, pos FROM best UNION ALL SELECT video_id, pos FROM fr WHERE pos % 4 = 0 AND pos < 4 * (n // 4)",
}
