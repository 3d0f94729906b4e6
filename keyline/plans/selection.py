"""Selection queries on the sequences of ``events``, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyline.functions.scalars import softmax_match
from keyline.operators import selection as S
from keyline.sources import sinks
from keyline.sources.sequences import event_sequences as seq

SEQ = "seq AS (SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos, value AS score FROM events WHERE value IS NOT NULL), fr AS (SELECT *, CAST(pos AS BIGINT) * 30 AS frame_id, count(*) OVER (PARTITION BY video_id) AS n, min(score) OVER (PARTITION BY video_id) AS mn, max(score) OVER (PARTITION BY video_id) AS mx FROM seq), norm AS (SELECT *, CASE WHEN mx > mn THEN (score - mn) / (mx - mn) ELSE 0.5 END AS s FROM fr)"
PACK = SEQ + ", pk AS (SELECT video_id, max(n) AS n, list(s ORDER BY pos) AS s FROM norm GROUP BY video_id)"
_DIFF = (
    ", wt AS (SELECT *, list_transform(raw, lambda x: x / list_max(raw)) AS w FROM (SELECT *, list_transform(range(1, n), lambda i: {edge}) AS raw FROM pk)), "
    "diff AS (SELECT video_id, n, s, w, s AS d, 0 AS it FROM wt UNION ALL SELECT video_id, n, s, w, list_transform(range(1, n + 1), lambda i: 0.75::DOUBLE * d[i] + (1 - 0.75::DOUBLE) * CASE WHEN i = 1 THEN d[2] WHEN i = n THEN d[n - 1] ELSE (w[i - 1] * d[i - 1] + w[i] * d[i + 1]) / (w[i - 1] + w[i]) END), it + 1 FROM diff WHERE it < greatest(1, CAST(floor(log2(n)) AS INT)) AND n > 1), "
    "dd AS (SELECT video_id, n, s, d FROM diff WHERE it = greatest(1, CAST(floor(log2(n)) AS INT)) OR n = 1)"
)
_EDGE = {"score_diff": "1 / (abs(s[i] - s[i + 1]) + 1e-6)", "temporal": "1 / (30.0::DOUBLE + 1)", "uniform": "1.0::DOUBLE"}


def _diff(edge: str) -> str:
    return "WITH RECURSIVE " + PACK + _DIFF.format(edge=_EDGE[edge])


def _greedy(source: str, scores: str, m: int, near: str, order: str = "pos", where: str = "true") -> str:
    """CTEs: candidates in order, then one step each that takes it if it is far enough from those taken."""
    return (
        f", cand AS (SELECT video_id, n, pos, row_number() OVER (PARTITION BY video_id ORDER BY round(x, 12) DESC, {order}) AS k FROM (SELECT video_id, n, unnest(range(0, n)) AS pos, unnest({scores}) AS x, {scores} AS all_ FROM {source}) WHERE {where}), "
        f"step AS (SELECT video_id, n, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS got FROM {source} UNION ALL SELECT t.video_id, t.n, c.k, CASE WHEN len(t.got) < {m} AND len(list_filter(t.got, lambda j: abs(j - c.pos) {near})) = 0 THEN list_append(t.got, c.pos) ELSE t.got END FROM step t JOIN cand c ON c.video_id = t.video_id AND c.k = t.k + 1), "
        "fin AS (SELECT video_id, n, got FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY k DESC) AS r FROM step) WHERE r = 1)"
    )


def _picked(m: int) -> str:
    return f" SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1 AS INT) AS rank, CAST(pos AS INT) AS pos, CAST(pos AS BIGINT) * 30 AS frame_id FROM (SELECT video_id, unnest(CASE WHEN n <= {m} THEN range(0, n) ELSE got END) AS pos FROM fin)"


def _tree(m: int, t1: float) -> str:
    parts, before = [], "SELECT *, 0 AS b0, CAST(n AS INT) AS l0, CASE WHEN mx > mn THEN (score - mn) / (mx - mn) END AS z FROM fr"
    for d in range(1, 6):
        before = f"SELECT *, CASE WHEN pos < b{d - 1} + l{d - 1} // 2 THEN b{d - 1} ELSE b{d - 1} + l{d - 1} // 2 END AS b{d}, CASE WHEN pos < b{d - 1} + l{d - 1} // 2 THEN l{d - 1} // 2 ELSE l{d - 1} - l{d - 1} // 2 END AS l{d} FROM ({before})"
    for d in range(6):
        parts.append(f"SELECT video_id, pos, frame_id, n, z, {d} AS depth, b{d} AS start, l{d} AS size FROM tree")
    return (
        f"WITH {SEQ}, tree AS ({before}), nodes AS ({' UNION ALL '.join(parts)}), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, depth, start ORDER BY z DESC, pos) AS rank FROM nodes), "
        f"stops AS (SELECT *, depth = 5 OR coalesce(avg(CASE WHEN rank <= {m} THEN z END) OVER w - avg(z) OVER w > {t1}, false) AS stop FROM ranked WINDOW w AS (PARTITION BY video_id, depth, start)), "
        "leaf AS (SELECT * FROM (SELECT *, min(CASE WHEN stop THEN depth END) OVER (PARTITION BY video_id, pos) AS leaf_depth FROM stops) WHERE depth = leaf_depth)"
    )


def _halved(m: int, t1: float, floor: int) -> str:
    return _tree(m, t1) + f" SELECT video_id, pos, frame_id, depth FROM leaf WHERE n < {m} OR rank <= greatest({floor}, CAST(floor({m} / pow(2.0, depth)) AS INT))"


def _long(df: DataFrame) -> DataFrame:
    return df.select("video_id", "rank", "pos", "frame_id")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def _diffused(edges):
    def run(k, d):
        rows = S.diffused(seq(k, d), edges=edges).select("video_id", F.posexplode("d").alias("pos", "d"))
        return _rounded(rows.select("video_id", F.col("pos").cast("int"), "d"), "d")

    return run


_LIN = "CASE WHEN i = 7 THEN n - 1 ELSE CAST(floor(i * (CAST(n - 1 AS DOUBLE) / 7.0::DOUBLE)) AS BIGINT) END"
_STATS = "count(*) AS total_videos, CAST(sum(n_in) AS BIGINT) AS total_input_frames, CAST(sum(n_out) AS BIGINT) AS total_output_frames, avg(n_out) AS avg_frames, min(n_out) AS min_frames, max(n_out) AS max_frames, quantile_cont(n_out, 0.5) AS median_frames, round(stddev_pop(n_out), 9) AS std_frames, count(*) FILTER (n_out < 32) AS \"0_32\", count(*) FILTER (n_out >= 32 AND n_out < 64) AS \"33_64\", count(*) FILTER (n_out >= 64 AND n_out < 96) AS \"65_96\", count(*) FILTER (n_out >= 96 AND n_out < 128) AS \"97_128\", count(*) FILTER (n_out >= 128) AS \"128_up\""


def _summary(k, d):
    rows = seq(k, d)
    sizes = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("input_frames"))
    out = S.halved(rows, 32, floor=1, t1=0.2).groupBy("video_id").agg(F.count(F.lit(1)).alias("output_frames"))
    return _rounded(sinks.summary(sizes.join(out, "video_id", "left").fillna(0)), "std_frames")


def _soft(method, mask):
    return lambda k, d: S.soft_suppressed(seq(k, d), m=8, method=method, mask_selected=mask)


_LOSES = {
    "gaussian_soft": "CASE WHEN x > 0 AND j <> i + 1 THEN x * exp(-0.5::DOUBLE * sim[j]) ELSE x END",
    "mmr": "CASE WHEN x > 0 THEN 0.7::DOUBLE * x - (1 - 0.7::DOUBLE) * near[j] ELSE 0 END",
    "temporal_gaussian": "CASE WHEN x > 0 AND j <> i + 1 THEN x * exp(-pow((j - 1 - i) * 30 / 5.0::DOUBLE, 2)) ELSE x END",
    "dpp_multiplicative": "CASE WHEN x > 0 THEN x * rest[j] ELSE x END",
    "power_law": "CASE WHEN x > 0 AND j <> i + 1 THEN x / pow(1 + sim[j], 2) ELSE x END",
}


def _softly(method: str, mask: bool, m: int = 8) -> str:
    """One recursion a frame taken: the best of what is left, then what each other frame loses by the rule."""
    taken = "list_contains(got, j - 1)" if mask else "false"
    return (
        _diff("score_diff")
        + f", st AS (SELECT video_id, n, d, d AS lft, CAST([] AS BIGINT[]) AS got, list_transform(d, lambda x: 0.0::DOUBLE) AS near, list_transform(d, lambda x: 1.0::DOUBLE) AS rest, 0 AS it FROM dd WHERE n > {m} UNION ALL "
        f"SELECT video_id, n, d, list_transform(lft, lambda x, j: {_LOSES[method]}), list_append(got, i), near, rest, it + 1 FROM ("
        "SELECT video_id, n, d, lft, got, i, sim, it, list_transform(near, lambda x, j: greatest(x, sim[j])) AS near, list_transform(rest, lambda x, j: CASE WHEN j = i + 1 THEN x ELSE x * (1 - sim[j]) END) AS rest FROM ("
        "SELECT *, list_transform(d, lambda x, j: CASE WHEN j = i + 1 THEN 0.0::DOUBLE ELSE exp(-abs(x - d[i + 1]) / 0.1::DOUBLE) END) AS sim FROM ("
        f"SELECT *, list_position(free, list_max(free)) - 1 AS i FROM (SELECT *, list_transform(lft, lambda x, j: CASE WHEN {taken} THEN '-inf'::DOUBLE ELSE x END) AS free FROM st WHERE it < {m}) WHERE list_max(free) > 0)))), "
        "fin AS (SELECT video_id, n, got FROM st QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY it DESC) = 1 UNION ALL "
        f"SELECT video_id, n, range(0, n) FROM dd WHERE n <= {m}) "
        "SELECT video_id, CAST(unnest(range(0, len(got))) AS INT) AS rank, CAST(unnest(list_sort(got)) AS BIGINT) * 30 AS frame_id FROM fin"
    )


QUERIES = {
    "n1_minmax": lambda k, d: _rounded(S.normalised(seq(k, d), constant=None), "s").select("video_id", "pos", "s"),
    "n2_minmax_half": lambda k, d: _rounded(S.normalised(seq(k, d)), "s").select("video_id", "pos", "s"),
    "n3_minmax_scrubbed": lambda k, d: _rounded(S.normalised(seq(k, d), constant=0.0, eps=1e-12), "s").select("video_id", "pos", "s"),
    "n4_stride_whole": lambda k, d: S.strided(seq(k, d), 4).select("video_id", "pos", "score"),
    "n5_stride": lambda k, d: S.strided(seq(k, d), 4, whole=False).select("video_id", "pos", "score"),
    "n6_zero_frames": lambda k, d: seq(k, d).select("video_id", "pos", F.lit(0).cast("long").alias("frame_id")),
    "n7_constants": lambda k, d: sinks.annotated(seq(k, d).select("video_id").distinct(), S.top_k(seq(k, d), 8), 8, True).select("video_id", F.size("frame_idx").alias("frames"), "frame_num", "use_topk"),
    "n8_softmax": lambda k, d: seq(k, d).select("video_id", "pos", F.round(softmax_match(F.col("score") / 100, F.col("pos") / 10), 9).alias("p")),
    "t1_topk": lambda k, d: S.top_k(seq(k, d), 8).select("video_id", "pos", "frame_id", "score"),
    "t2_passthrough": lambda k, d: S.top_k(seq(k, d), 60).select("video_id", "pos", "frame_id", "score"),
    "t3_first_videos": lambda k, d: seq(k, d).where("video_id < 3"),
    "t4_uniform": lambda k, d: S.evenly(seq(k, d), 8),
    "t5_random": lambda k, d: S.random_frames(seq(k, d), 8).select("video_id", "pos", "frame_id"),
    "t6_halved_trimmed": lambda k, d: S.halved_trimmed(seq(k, d), 16, t1=0.3),
    "a1_leaves": lambda k, d: S.leaves(seq(k, d), 16, t1=0.3).select("video_id", "pos", "depth", "start", "size"),
    "a2_halved_strict": lambda k, d: S.halved(seq(k, d), 16, t1=0.3),
    "a3_halved_floor": lambda k, d: S.halved(seq(k, d), 8, floor=1, t1=0.3),
    "a4_allocated": lambda k, d: S.allocated(seq(k, d), 10, t1=0.3),
    "a5_summary": _summary,
    "d1_diffused_uniform": _diffused("uniform"),
    "d2_diffused_score": _diffused("score_diff"),
    "d3_diffused_temporal": _diffused("temporal"),
    "d6_hard_suppressed": lambda k, d: _long(S.hard_suppressed(seq(k, d))),
    "d15_thresholded": lambda k, d: _long(S.thresholded(seq(k, d), m=20)),
    "d5_d16_exactly": lambda k, d: S.exactly(seq(k, d), m=16),
    "d8_gaussian": _soft("gaussian_soft", False),
    "d9_mmr": _soft("mmr", False),
    "d10_temporal": _soft("temporal_gaussian", False),
    "d11_dpp": _soft("dpp_multiplicative", False),
    "d12_power_law": _soft("power_law", False),
    "d7_power_law_masked": _soft("power_law", True),
    "d8_gaussian_masked": _soft("gaussian_soft", True),
    "d9_mmr_masked": _soft("mmr", True),
    "d10_temporal_masked": _soft("temporal_gaussian", True),
    "d11_dpp_masked": _soft("dpp_multiplicative", True),
    "p1_seeds": lambda k, d: _rounded(S.seeds(seq(k, d)).select("video_id", "pos", "s"), "s"),
    "p2_seeds_tolerant": lambda k, d: _rounded(S.seeds(seq(k, d), window=8, tolerance=1e-6).select("video_id", "pos", "s"), "s"),
    "p3_ripples": lambda k, d: S.ripples(seq(k, d)),
    "p3_ripples_fading": lambda k, d: S.ripples(seq(k, d), window=8, tau=0.08, beta=0.1, tolerance=1e-6, fading=True),
    "q1_shots": lambda k, d: S.shots(seq(k, d)).select("video_id", "pos", "shot"),
    "q2_densities": lambda k, d: _rounded(S.densities(seq(k, d)), "rho"),
    "q3_shot_densities": lambda k, d: _rounded(S.shot_densities(seq(k, d)), "rho"),
    "q4_spaced": lambda k, d: _long(S.spaced(seq(k, d))),
    "q9_dual_quota": lambda k, d: S.dual_quota(seq(k, d)),
    "q9_dual_quota_per_video": lambda k, d: S.dual_quota(seq(k, d), theta_scope="per_video"),
    "g1_selection_stats": lambda k, d: S.hard_suppressed(seq(k, d)).groupBy("video_id").count().agg(F.count(F.lit(1)).alias("videos"), F.avg("count").alias("mean"), F.min("count").alias("least"), F.max("count").alias("most")),
    "g2_profile": lambda k, d: _rounded(seq(k, d).where("video_id < 3").groupBy("video_id").agg(F.count(F.lit(1)).alias("len"), F.min("score").alias("least"), F.max("score").alias("most"), F.avg("score").alias("mean")), "least", "most", "mean"),
    "u1_union": lambda k, d: S.top_k(seq(k, d), 8).select("video_id", "pos").union(S.seeds(seq(k, d)).select("video_id", "pos")).distinct(),
    "u2_difference": lambda k, d: seq(k, d).select("video_id", "pos").join(S.top_k(seq(k, d), 8).select("video_id", "pos"), ["video_id", "pos"], "left_anti"),
}

_TOP = SEQ + ", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos) AS rn FROM fr) WHERE rn <= {m})"
_SEEDS = SEQ + ", sd AS (SELECT *, max(s) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING) AS peak_here FROM norm)"
_SHOTS = SEQ + ", cuts AS (SELECT *, CASE WHEN n >= 3 AND abs(s - lag(s) OVER (PARTITION BY video_id ORDER BY pos)) / (max(s) OVER (PARTITION BY video_id) + 1e-6) > 0.15 THEN 1 ELSE 0 END AS cut FROM norm), sh AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY video_id ORDER BY pos) AS INT) AS shot FROM cuts)"

ORACLES = {
    "n1_minmax": f"WITH {SEQ} SELECT video_id, pos, round(CASE WHEN mx > mn THEN (score - mn) / (mx - mn) ELSE 'nan'::DOUBLE END, 9) AS s FROM fr",
    "n2_minmax_half": f"WITH {SEQ} SELECT video_id, pos, round(s, 9) AS s FROM norm",
    "n3_minmax_scrubbed": f"WITH {SEQ} SELECT video_id, pos, round(CASE WHEN mx - mn < 1e-12 THEN 0.0 ELSE (score - mn) / (mx - mn) END, 9) AS s FROM fr",
    "n4_stride_whole": f"WITH {SEQ} SELECT video_id, pos, score FROM fr WHERE pos % 4 = 0 AND pos < 4 * (n // 4)",
    "n5_stride": f"WITH {SEQ} SELECT video_id, pos, score FROM fr WHERE pos % 4 = 0",
    "n6_zero_frames": f"WITH {SEQ} SELECT video_id, pos, 0::BIGINT AS frame_id FROM fr",
    "n7_constants": f"WITH {SEQ} SELECT video_id, CAST(least(8, max(n)) AS INT) AS frames, 8::BIGINT AS frame_num, true AS use_topk FROM fr GROUP BY video_id",
    "n8_softmax": f"WITH {SEQ} SELECT video_id, pos, round(1 / (1 + exp(score / 100 - pos / 10)), 9) AS p FROM fr",
    "t1_topk": f"WITH {_TOP.format(m=8)} SELECT video_id, pos, frame_id, score FROM top",
    "t2_passthrough": f"WITH {_TOP.format(m=60)} SELECT video_id, pos, frame_id, score FROM top",
    "t3_first_videos": f"WITH {SEQ} SELECT video_id, pos, frame_id, score FROM fr WHERE video_id < 3",
    "t4_uniform": f"WITH {SEQ}, c AS (SELECT video_id, max(n) AS n FROM fr GROUP BY video_id) SELECT video_id, CAST(i AS INT) AS rank, CAST({_LIN} AS INT) AS pos FROM c, range(0, 8) t(i)",
    "t5_random": f"WITH {SEQ}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN pos = 0 OR pos = n - 1 THEN 0 ELSE 1 END, md5('42:' || video_id || ':' || pos)) AS rn FROM fr) SELECT video_id, pos, frame_id FROM r WHERE n <= 8 OR rn <= 8",
    "t6_halved_trimmed": _tree(16, 0.3) + ", h AS (SELECT video_id, pos, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS rank FROM leaf WHERE n >= 16 AND rank <= greatest(1, CAST(floor(16 / pow(2.0, depth)) AS INT))), c AS (SELECT video_id, max(n) AS n FROM fr GROUP BY video_id HAVING max(n) < 16) SELECT video_id, CAST(rank AS INT) AS rank, pos FROM h WHERE rank <= 16 UNION ALL SELECT video_id, CAST(i + 1 AS INT), CAST(CASE WHEN i = 15 THEN n - 1 ELSE floor(i * (CAST(n - 1 AS DOUBLE) / 15.0::DOUBLE)) END AS INT) FROM c, range(0, 16) t(i)",
    "a1_leaves": _tree(16, 0.3) + " SELECT video_id, pos, depth, start, size FROM leaf",
    "a2_halved_strict": _halved(16, 0.3, 0),
    "a3_halved_floor": _halved(8, 0.3, 1),
    "a4_allocated": _tree(10, 0.3) + ", h AS (SELECT video_id, pos, n, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS rn, count(*) OVER (PARTITION BY video_id) AS k FROM leaf WHERE n < 10 OR rank <= greatest(1, CAST(floor(10 / pow(2.0, depth)) AS INT))), c AS (SELECT DISTINCT video_id, n FROM h WHERE k < 10 AND n >= 10) SELECT video_id, CAST(rn - 1 AS INT) AS rank, pos FROM h WHERE rn <= 10 AND (k >= 10 OR n < 10) UNION ALL SELECT video_id, CAST(i AS INT), CAST(CASE WHEN i = 9 THEN n - 1 ELSE floor(i * (CAST(n - 1 AS DOUBLE) / 9.0::DOUBLE)) END AS INT) FROM c, range(0, 10) t(i)",
    "a5_summary": _tree(32, 0.2) + f", o AS (SELECT video_id, count(*) FILTER (n < 32 OR rank <= greatest(1, CAST(floor(32 / pow(2.0, depth)) AS INT))) AS n_out, max(n) AS n_in FROM leaf GROUP BY video_id) SELECT {_STATS} FROM o",
    **{f"d{i}_diffused_{n}": _diff(e) + " SELECT video_id, CAST(unnest(range(0, n)) AS INT) AS pos, round(unnest(d), 9) AS d FROM dd" for i, n, e in ((1, "uniform", "uniform"), (2, "score", "score_diff"), (3, "temporal", "temporal"))},
    "d6_hard_suppressed": _diff("score_diff") + _greedy("dd", "d", 16, "<= 3") + _picked(16),
    "d15_thresholded": _diff("score_diff") + _greedy("dd", "d", 20, "<= 3", where="x >= list_avg(list_slice(list_reverse_sort(all_), 1, 16)) / 2") + _picked(20),
    **{k: _softly(method, k.endswith("masked")) for k, method in (("d7_power_law_masked", "power_law"), ("d8_gaussian", "gaussian_soft"), ("d8_gaussian_masked", "gaussian_soft"), ("d9_mmr", "mmr"), ("d9_mmr_masked", "mmr"), ("d10_temporal", "temporal_gaussian"), ("d10_temporal_masked", "temporal_gaussian"), ("d11_dpp", "dpp_multiplicative"), ("d11_dpp_masked", "dpp_multiplicative"), ("d12_power_law", "power_law"))},
    "p1_seeds": "WITH " + _SEEDS.format(w=5) + " SELECT video_id, pos, round(s, 9) AS s FROM sd WHERE s >= 0.3 AND s >= peak_here",
    "p2_seeds_tolerant": "WITH " + _SEEDS.format(w=8) + " SELECT video_id, pos, round(s, 9) AS s FROM sd WHERE s >= 0.3 AND s >= peak_here - 1e-6",
    "q1_shots": f"WITH {_SHOTS} SELECT video_id, pos, shot FROM sh",
    "q2_densities": f"WITH {SEQ}, q AS (SELECT video_id, quantile_cont(s, 0.75) AS peak, quantile_cont(s, 0.85) AS act FROM norm GROUP BY video_id), p AS (SELECT video_id, count(*) FILTER (s >= peak) AS peaks, count(*) AS n, max(s) AS top, any_value(act) AS act FROM norm JOIN q USING (video_id) GROUP BY video_id), r AS (SELECT *, peaks / greatest(CAST(n - 1 AS DOUBLE), 1e-6) AS rho FROM p) SELECT video_id, n, peaks, round(rho, 9) AS rho, top >= act OR rho > 0 AS is_active, CAST(least(greatest(CASE WHEN top >= act OR rho > 0 THEN 1 ELSE 0 END + round_even(rho / 0.2, 0), 0), 16) AS INT) AS quota FROM r",
    "q3_shot_densities": f"WITH {_SHOTS}, q AS (SELECT video_id, quantile_cont(s, 0.75) AS peak FROM norm GROUP BY video_id), e AS (SELECT video_id, shot, max(CASE WHEN s >= peak THEN 1 ELSE 0 END) AS has FROM sh JOIN q USING (video_id) GROUP BY video_id, shot) SELECT video_id, round(sum(has) / count(*) * 0.2, 9) AS rho, count(*) AS shots FROM e GROUP BY video_id",
    "q4_spaced": f"WITH RECURSIVE {PACK}" + _greedy("pk", "s", 8, "< 2", order="pos DESC") + " SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1 AS INT) AS rank, CAST(pos AS INT) AS pos, CAST(pos AS BIGINT) * 30 AS frame_id FROM (SELECT video_id, unnest(got) AS pos FROM fin)",
    "g1_selection_stats": _diff("score_diff") + _greedy("dd", "d", 16, "<= 3") + ", c AS (SELECT video_id, len(CASE WHEN n <= 16 THEN range(0, n) ELSE got END) AS c FROM fin) SELECT count(*) AS videos, avg(c) AS mean, min(c) AS least, max(c) AS most FROM c",
    "g2_profile": f"WITH {SEQ} SELECT video_id, count(*) AS len, round(min(score), 9) AS least, round(max(score), 9) AS most, round(avg(score), 9) AS mean FROM fr WHERE video_id < 3 GROUP BY video_id",
    "u1_union": "WITH " + _SEEDS.format(w=5) + ", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos) AS rn FROM fr) WHERE rn <= 8) SELECT video_id, pos FROM top UNION SELECT video_id, pos FROM sd WHERE s >= 0.3 AND s >= peak_here",
    "u2_difference": f"WITH {_TOP.format(m=8)} SELECT video_id, pos FROM fr EXCEPT SELECT video_id, pos FROM top",
}
