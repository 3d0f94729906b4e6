"""Selection of a bounded number of frames per video: top-k, even and random spacing, recursive halving, diffusion with
suppression, ripples around peaks and dual quotas.

Long-form operators use windows over one exchange by video; order-dependent ones fold over a packed row in the JVM or run
grouped by video. Ties follow the rule that each docstring states.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyline.functions.scalars import by_video, halving, linspace, minmax
from keyline.sources.sequences import packed


def _n() -> Column:
    return F.count(F.lit(1)).over(by_video())



def normalised(seq: DataFrame, **how) -> DataFrame:
    return seq.withColumn("s", minmax(**how))


def strided(seq: DataFrame, ratio: int, whole: bool = True) -> DataFrame:
    """Every ``ratio``-th frame; with ``whole``, no frame of a last stride that is not full."""
    keep = F.col("pos") % ratio == 0
    if not whole:
        return seq.where(keep)
    return seq.withColumn("_n", _n()).where(keep & (F.col("pos") < ratio * F.floor(F.col("_n") / ratio))).drop("_n")


def top_k(seq: DataFrame, m: int, score: str = "score") -> DataFrame:
    """The m best frames of each video, earlier ones first among equals; all of a video that has no more."""
    best = Window.partitionBy("video_id").orderBy(F.col(score).desc(), F.col("pos"))
    return seq.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= m).drop("rn")


def evenly(seq: DataFrame, m: int) -> DataFrame:
    """(video_id, rank, pos): m places from first to last; with fewer frames some repeat."""
    n = seq.groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.select("video_id", F.posexplode(linspace(F.col("n"), m)).alias("rank", "pos"))


def random_frames(seq: DataFrame, m: int, seed: int = 42, strict: bool = False) -> DataFrame:
    """First, last and m - 2 others in a seeded order. ``strict`` draws from the second and third frame alone, and fails for m > 4."""
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col("video_id"), F.col("pos")))
    rows = seq.withColumns({"n": _n(), "end": (F.col("pos") == 0) | (F.col("pos") == _n() - 1), "draw": draw})
    if strict:
        rows = rows.where((F.col("n") <= m) | F.col("end") | F.col("pos").isin(1, 2))
        rows = rows.withColumn("n", F.when((F.col("n") > m) & F.lit(m > 4), F.raise_error(F.lit("sample larger than population")).cast("long")).otherwise(F.col("n")))
    order = Window.partitionBy("video_id").orderBy(F.col("end").desc(), "draw")
    return rows.withColumn("rn", F.row_number().over(order)).where((F.col("n") <= m) | (F.col("rn") <= m)).select(*seq.columns)


# ---- recursive halving --------------------------------------------------------------------------


def leaves(seq: DataFrame, m: int, t1: float = 0.8, t2: float = -100.0, depth: int = 5) -> DataFrame:
    """Each frame with the depth and start of its leaf, its rank there and the leaf's size.

    Where to halve depends on the count of frames alone, so every frame knows its node at each depth. A node is a leaf at the
    least depth where its best m scores stand out: mean(best m) - mean > t1 and deviation > t2; or at the last depth.
    """
    rows = seq.withColumns({"n": _n().cast("int"), "s": minmax(constant=None)}).withColumns({"b0": F.lit(0), "l0": F.col("n")})
    for d in range(1, depth + 1):
        half = F.floor(F.col(f"l{d - 1}") / 2).cast("int")
        left = F.col("pos") < F.col(f"b{d - 1}") + half
        rows = rows.withColumns({f"b{d}": F.when(left, F.col(f"b{d - 1}")).otherwise(F.col(f"b{d - 1}") + half), f"l{d}": F.when(left, half).otherwise(F.col(f"l{d - 1}") - half)})
    nodes = rows.select("video_id", "pos", "frame_id", "n", "s", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.col(f"b{d}").alias("start"), F.col(f"l{d}").alias("size")) for d in range(depth + 1)))).alias("at")).select("*", "at.*").drop("at")
    node = Window.partitionBy("video_id", "depth", "start")
    ranked = nodes.withColumn("rank", F.row_number().over(node.orderBy(F.col("s").desc(), "pos")))
    gap = F.avg(F.when(F.col("rank") <= m, F.col("s"))).over(node) - F.avg("s").over(node)
    stops = ((gap > t1) & ~F.isnan(gap) & (F.stddev_pop("s").over(node) > t2)) | (F.col("depth") == depth)
    least = F.min(F.when(F.col("stops"), F.col("depth"))).over(Window.partitionBy("video_id", "pos"))
    return ranked.withColumn("stops", stops).withColumn("leaf", least).where("depth = leaf").select("video_id", "pos", "frame_id", "n", "s", "depth", "start", "size", "rank")


def halved(seq: DataFrame, m: int, floor: int = 0, **how) -> DataFrame:
    """Of each leaf at depth d its best max(floor, m / 2^d) frames: floor 0 may leave a video without any, floor 1 may give
    more than m. Videos of fewer than m frames are taken whole."""
    share = F.greatest(F.lit(floor), F.floor(F.lit(m) / F.pow(F.lit(2.0), F.col("depth"))).cast("int"))
    return leaves(seq, m, **how).where((F.col("n") < m) | (F.col("rank") <= share)).select("video_id", "pos", "frame_id", "depth")


def halved_trimmed(seq: DataFrame, m: int, **how) -> DataFrame:
    """``halved`` with floor 1, cut to its first m frames in time; short videos are evenly spaced instead, repeats included."""
    order = Window.partitionBy("video_id").orderBy("pos")
    longer = halved(seq.withColumn("n", _n()).where(F.col("n") >= m).drop("n"), m, floor=1, **how)
    longer = longer.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= m).select("video_id", F.col("rn").cast("int").alias("rank"), "pos")
    short = seq.withColumn("n", _n()).where(F.col("n") < m).drop("n")
    return longer.unionByName(evenly(short, m).select("video_id", (F.col("rank") + 1).alias("rank"), "pos"))


def allocated(seq: DataFrame, m: int, **how) -> DataFrame:
    """``halved`` with floor 1, cut to its first m frames in time; where it gives fewer, m evenly spaced ones instead. Videos of
    fewer than m frames are taken whole."""
    order = Window.partitionBy("video_id").orderBy("pos")
    got = halved(seq, m, floor=1, **how).withColumns({"k": F.count(F.lit(1)).over(Window.partitionBy("video_id")), "rank": (F.row_number().over(order) - 1).cast("int")})
    sized = seq.withColumn("n", _n())
    got = got.join(sized.select("video_id", "pos", "n"), ["video_id", "pos"])
    few = (F.col("k") < m) & (F.col("n") >= m)
    lacking = seq.join(got.where(few).select("video_id").distinct(), "video_id", "left_semi")
    return got.where(~few & (F.col("rank") < m)).select("video_id", "rank", "pos").unionByName(evenly(lacking, m).select("video_id", "rank", "pos"))


# ---- diffusion and suppression ------------------------------------------------------------------


def edge_weights(kind: str) -> Column:
    """Weights between neighbours (s, f bound as arrays): all one, by nearness of score, or by nearness of frame; the largest is 1."""
    if kind == "uniform":
        return F.expr("array_repeat(1D, greatest(size(s) - 1, 0))")
    by = "1 / (abs(p.s - q.s) + 1e-6)" if kind == "score_diff" else "1 / (CAST(q.f - p.f AS DOUBLE) + 1)"
    pairs = "arrays_zip(s, f)"
    raw = f"zip_with(slice({pairs}, 1, greatest(size(s) - 1, 0)), slice({pairs}, 2, greatest(size(s) - 1, 0)), (p, q) -> {by})"
    return F.expr(f"transform(array({raw}), r -> transform(r, x -> x / array_max(r)))[0]")


def diffused(seq: DataFrame, alpha: float = 0.75, edges: str = "score_diff", rounds: Column | None = None) -> DataFrame:
    """Packed rows (video_id, f, s, d): normalised scores and what is left of them after rounds of
    alpha * own + (1 - alpha) * weighted mean of the neighbours; floor(log2 N) rounds, one at least."""
    rows = packed(normalised(seq).select("video_id", "pos", "frame_id", F.col("s").alias("score"))).select("video_id", F.col("frame_ids").alias("f"), F.col("scores").alias("s"))
    rows = rows.withColumn("w", edge_weights(edges)).withColumn("k", rounds if rounds is not None else F.greatest(F.lit(1), halving(F.size("s"))))
    step = (
        f"transform(a, (x, i) -> {alpha}D * x + (1 - {alpha}D) * CASE WHEN size(a) = 1 THEN 0D "
        "WHEN i = 0 THEN a[1] WHEN i = size(a) - 1 THEN a[i - 1] "
        "ELSE (z.w[i - 1] * a[i - 1] + z.w[i] * a[i + 1]) / (z.w[i - 1] + z.w[i]) END)"
    )
    d = f"transform(array(struct(s, w, k)), z -> CASE WHEN size(z.s) <= 1 THEN z.s ELSE aggregate(sequence(1, z.k), z.s, (a, _) -> {step}) END)[0]"
    return rows.withColumn("d", F.expr(d)).select("video_id", "f", "s", "d")


def apart(scores: str, m: int, radius: float, strict: bool = False, later_first: bool = False, least: str | None = None) -> Column:
    """Places taken greedily by score, each more than ``radius`` from all before it (``strict``: at least), m at most, in order.

    Of scores equal to 12 decimals the earlier place is first, or the later one. ``least`` is a score under which none is taken.
    """
    sign = "-i" if later_first else "i"
    near = "<" if strict else "<="
    ordered = f"transform(array_sort(transform(z.d, (x, i) -> struct(-round(x, 12) AS x, {sign} AS t, i AS i))), p -> p.i)"
    if least:
        ordered = f"filter({ordered}, i -> z.d[i] >= z.least)"
    fold = f"aggregate({ordered}, CAST(array() AS array<int>), (acc, i) -> CASE WHEN size(acc) < {m} AND NOT exists(acc, j -> abs(j - i) {near} {radius}) THEN array_append(acc, i) ELSE acc END)"
    return F.expr(f"transform(array(struct({scores} AS d, {least or '0D'} AS least)), z -> array_sort({fold}))[0]")


def hard_suppressed(seq: DataFrame, m: int = 16, radius: float = 3.0, **how) -> DataFrame:
    """(video_id, rank, pos, frame_id) by diffusion and hard suppression; videos of at most m frames are taken whole."""
    rows = diffused(seq, **how)
    return _placed(rows.withColumn("at", F.when(F.size("s") <= m, F.expr("sequence(0, size(s) - 1)")).otherwise(apart("d", m, radius))))


def thresholded(seq: DataFrame, m: int = 64, target: int = 16, radius: float = 3.0, **how) -> DataFrame:
    """As hard_suppressed, but no frame below half the mean of the ``target`` best diffused scores."""
    rows = diffused(seq, **how)
    half = f"transform(array(slice(sort_array(d, false), 1, {target})), t -> aggregate(t, 0D, (a, x) -> a + x) / size(t) / 2)[0]"
    return _placed(rows.withColumn("at", F.when(F.size("s") <= m, F.expr("sequence(0, size(s) - 1)")).otherwise(apart("d", m, radius, least=half))))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("video_id", "f", F.posexplode("at").alias("rank", "pos")).select("video_id", F.col("rank").cast("int"), F.col("pos").cast("int"), F.expr("f[pos]").alias("frame_id"))


def _by_video(rows: DataFrame, pick, m: int) -> DataFrame:
    """(video_id, rank, frame_id) of ``pick(scores, frames) -> places`` on each packed row; the places' order is kept."""

    def run(frames):
        for pdf in frames:
            out = []
            for v, f, s in zip(pdf["video_id"], pdf["frame_ids"], pdf["scores"], strict=True):
                f, s = np.asarray(f, np.int64), np.asarray(s, float)
                out += [(v, r, int(f[i])) for r, i in enumerate(range(len(f)) if len(f) <= m else pick(s, f))]
            yield pd.DataFrame(out, columns=["video_id", "rank", "frame_id"])

    return rows.mapInPandas(run, "video_id long, rank int, frame_id long")


def soft_suppressed(seq: DataFrame, m: int = 20, method: str = "power_law", beta: float = 0.5, weight: float = 0.7, sigma: float = 5.0, power: float = 2.0, mask_selected: bool = False, **how) -> DataFrame:
    """m times the frame of the best remaining score, after which like frames lose some of theirs.

    Likeness is exp(-|difference of scores| / 0.1). The taken frame itself keeps its score, so that it may be taken again and
    again, unless ``mask_selected``. The temporal kind takes from far frames, not near ones.
    """
    rows = diffused(seq, **how).select("video_id", F.col("f").alias("frame_ids"), F.col("d").alias("scores"))

    def pick(d: np.ndarray, f: np.ndarray) -> list[int]:
        like = lambda i: np.where(np.arange(len(d)) == i, 0.0, np.exp(-np.abs(d - d[i]) / 0.1))
        left, taken, nearest, product = d.copy(), [], np.zeros(len(d)), np.ones(len(d))
        for _ in range(m):
            open_ = left if not mask_selected else np.where(np.isin(np.arange(len(d)), taken), -np.inf, left)
            if open_.max() <= 0:
                break
            i = int(np.argmax(open_))
            taken.append(i)
            sim, others = like(i), np.arange(len(d)) != i
            nearest, product = np.maximum(nearest, sim), product * np.where(others, 1 - sim, 1.0)
            change = (left > 0) & others
            if method == "gaussian_soft":
                left = np.where(change, left * np.exp(-beta * sim), left)
            elif method == "mmr":
                left = np.where(left > 0, weight * left - (1 - weight) * nearest, 0.0)
            elif method == "temporal_gaussian":
                left = np.where(change, left * np.exp(-(((f - f[i]) / sigma) ** 2.0)), left)
            elif method == "dpp_multiplicative":
                left = np.where(left > 0, left * product, left)
            else:
                left = np.where(change, left / (1 + sim) ** power, left)
        return sorted(taken)

    return _by_video(rows, pick, m)


def exactly(seq: DataFrame, m: int = 64, alpha: float = 0.85, beta: float = 5.0, boundary: str = "reflect", radius: int | None = None) -> DataFrame:
    """Diffusion whose weights follow the scores of each round, suppression, and then exactly m frames: the best of more, or
    more by score. ``boundary`` gives an end frame itself ("reflect") or its neighbour ("edge") for the missing side."""
    rows = packed(seq)

    def scaled(x: np.ndarray) -> np.ndarray:
        low, high = x.min(), x.max()
        if not (np.isfinite(low) and np.isfinite(high)):
            x = np.nan_to_num(x, nan=0.0, posinf=1.0, neginf=0.0)
            low, high = x.min(), x.max()
        return np.zeros_like(x) if high - low < 1e-12 else (x - low) / (high - low)

    def pick(s: np.ndarray, f: np.ndarray) -> list[int]:
        d, n = scaled(s), len(s)
        for _ in range(max(3, n.bit_length() - 1 + 2)):
            inner = boundary == "edge" and n > 1
            left = np.append(d[1] if inner else d[0], d[:-1])
            right = np.append(d[1:], d[-2] if inner else d[-1])
            wl, wr = np.exp(-beta * np.abs(d - left)), np.exp(-beta * np.abs(d - right))
            d = alpha * d + (1 - alpha) * (wl * left + wr * right) / (wl + wr + 1e-12)
        d = scaled(scaled(d))
        reach = radius if radius is not None else max(1, round(n / m / 2))
        order = np.lexsort((np.arange(n), -d)).tolist()
        free, taken = np.ones(n, bool), []
        for i in order:
            if free[i]:
                taken.append(i)
                free[max(0, i - reach) : i + reach + 1] = False
        chosen = set(taken[:m])
        for i in order:
            if len(chosen) >= m:
                break
            chosen.add(i)
        return sorted(chosen)

    return _by_video(rows, pick, m)


# ---- ripples ------------------------------------------------------------------------------------


def seeds(seq: DataFrame, window: int = 5, least: float = 0.3, tolerance: float = 0.0) -> DataFrame:
    """Frames whose normalised score is the largest within ``window`` places, up to ``tolerance``, and at least ``least``."""
    around = Window.partitionBy("video_id").orderBy("pos").rowsBetween(-window, window)
    rows = normalised(seq).withColumn("top", F.max("s").over(around))
    return rows.where((F.col("s") >= least) & (F.col("s") >= F.col("top") - tolerance)).drop("top")


def ripples(seq: DataFrame, m: int = 16, window: int = 5, least: float = 0.3, tau: float = 0.01, beta: float = 0.05, gamma: float = 0.1, tolerance: float = 0.0, fading: bool = False) -> DataFrame:
    """Ripples run from each seed, best first, outwards while score * e^(-beta * distance), less a penalty for frames that an
    earlier seed claimed, stays above tau; ``fading`` penalties fade with the distance to that seed. The m best frames of all
    ripples stay, earlier ones first among equals. Without a seed the m best frames, later ones first."""
    rows = packed(normalised(seq).select("video_id", "pos", "frame_id", F.col("s").alias("score")))

    def pick(s: np.ndarray, f: np.ndarray) -> list[int]:
        n = len(s)
        around = [s[max(0, i - window) : i + window + 1].max() for i in range(n)]
        found = sorted((i for i in range(n) if s[i] >= least and s[i] >= around[i] - tolerance), key=lambda i: (-s[i], i))
        if not found:
            return sorted(np.lexsort((np.arange(n), s))[-m:].tolist())
        claims: dict[int, tuple[int, float]] = {}
        reached: set[int] = set()
        for seed in found:
            claims[seed] = (seed, s[seed])
            reached.add(seed)
            for way in (-1, 1):
                i = seed + way
                while 0 <= i < n:
                    gain = s[i] * np.exp(-beta * abs(i - seed))
                    if i in claims:
                        by, strength = claims[i]
                        gain -= gamma * strength * (np.exp(-beta * abs(i - by)) if fading else 1.0)
                    if gain <= tau:
                        break
                    reached.add(i)
                    if i not in claims or s[seed] > claims[i][1]:
                        claims[i] = (seed, s[seed])
                    i += way
        return sorted(sorted(reached, key=lambda i: (-s[i], i))[:m])

    return _by_video(rows, pick, m)


# ---- dual quotas --------------------------------------------------------------------------------


def shots(seq: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Frames with the number of their shot: a new one begins where the score jumps by more than ``threshold`` of the largest."""
    order = Window.partitionBy("video_id").orderBy("pos")
    jump = F.abs(F.col("s") - F.lag("s").over(order)) / (F.max("s").over(by_video()) + 1e-6)
    cut = F.when((_n() >= 3) & (jump > threshold), 1).otherwise(0)
    return normalised(seq).withColumn("cut", cut).withColumn("shot", F.sum("cut").over(order).cast("int")).drop("cut")


def densities(seq: DataFrame, share: float = 0.75, active_share: float = 0.85, beta: float = 1.0, ref: float = 0.2, m: int = 16) -> DataFrame:
    """By video: density of peaks per second, whether it is active, and the quota that follows from both."""
    rows = normalised(seq)
    at = rows.groupBy("video_id").agg(F.percentile("s", share).alias("peak"), F.percentile("s", active_share).alias("active"))
    peaks = rows.join(at, "video_id").groupBy("video_id").agg(F.count_if(F.col("s") >= F.col("peak")).alias("peaks"), F.count(F.lit(1)).alias("n"), F.max("s").alias("top"), F.first("active").alias("active"))
    rho = F.col("peaks") / F.greatest((F.col("n") - 1).cast("double"), F.lit(1e-6))
    out = peaks.withColumn("rho", rho).withColumn("is_active", (F.col("top") >= F.col("active")) | (F.col("rho") > 0))
    quota = F.when(F.col("is_active"), 1).otherwise(0) + F.bround(beta * F.col("rho") / max(ref, 1e-6))
    return out.select("video_id", "n", "peaks", "rho", "is_active", F.least(F.greatest(quota, F.lit(0)), F.lit(m)).cast("int").alias("quota"))


def shot_densities(seq: DataFrame, share: float = 0.75, ref: float = 0.2) -> DataFrame:
    """By video: the share of shots that hold a peak, times the reference density."""
    rows = shots(seq)
    at = rows.groupBy("video_id").agg(F.percentile("s", share).alias("peak"))
    each = rows.join(at, "video_id").groupBy("video_id", "shot").agg(F.max(F.when(F.col("s") >= F.col("peak"), 1).otherwise(0)).alias("has"))
    return each.groupBy("video_id").agg((F.sum("has") / F.count(F.lit(1)) * ref).alias("rho"), F.count(F.lit(1)).alias("shots"))


def spaced(seq: DataFrame, m: int = 8, gap: float = 2.0) -> DataFrame:
    """Greedy by normalised score, later frames first among equals, at least ``gap`` apart."""
    rows = packed(normalised(seq).select("video_id", "pos", "frame_id", F.col("s").alias("score"))).select("video_id", F.col("frame_ids").alias("f"), F.col("scores").alias("s"))
    return _placed(rows.withColumn("at", apart("s", m, gap, strict=True, later_first=True)))


def dual_quota(seq: DataFrame, m: int = 16, levels: int = 5, stop: float = 0.5, gap: float = 2.0, beta: float = 1.0, ref: float = 0.2, share: float = 0.75, theta_scope: str = "first") -> DataFrame:
    """Bins take a quota by activity and density, pass the rest to their halves by mass, and stop where their best stand out;
    what lacks in the end is filled evenly from unused frames.

    The activity threshold is the 85th percentile of the first video that is longer than m, for all videos after it
    (``theta_scope`` "first"), or of each video ("per_video").
    """
    rows = packed(normalised(seq).select("video_id", "pos", "frame_id", F.col("s").alias("score")))
    long_ones = normalised(seq).withColumn("n", _n()).where(F.col("n") > m)
    if theta_scope == "first":
        first = long_ones.groupBy("video_id").agg(F.percentile("s", 0.85).alias("theta")).agg(F.min_by("theta", "video_id")).first()[0]
    else:
        first = None

    def pick(s: np.ndarray, f: np.ndarray) -> list[int]:
        theta = first if first is not None else float(np.percentile(s, 85))
        peak, taken = float(np.percentile(s, share * 100)), set()

        def greedy(lo: int, hi: int, k: int) -> None:
            got: list[int] = []
            for i in np.lexsort((-np.arange(lo, hi), -np.round(s[lo:hi], 12))):
                if len(got) >= k:
                    break
                if all(abs(int(i) - j) >= gap for j in got):
                    got.append(int(i))
            taken.update(lo + i for i in got)

        todo = [(0, len(s), m, 0)]
        while todo:
            lo, hi, k, level = todo.pop()
            if k <= 0 or hi <= lo:
                continue
            part = s[lo:hi]
            if level >= levels or k <= 1 or len(part) <= k or np.sort(part)[-k:].mean() - part.mean() >= stop:
                greedy(lo, hi, k)
                continue
            rho = float((part >= peak).sum()) / max(float(hi - 1 - lo), 1e-6)
            own = max(0, min(k, int(part.max() >= theta or rho > 0) + round(beta * rho / max(ref, 1e-6))))
            if own:
                greedy(lo, hi, own)
            rest, mid = k - own, (lo + hi - 1) // 2 + 1
            left, right = s[lo:mid].sum() + 1e-6, s[mid:hi].sum() + 1e-6
            to_left = round(rest * left / (left + right))
            todo += [(mid, hi, rest - to_left, level + 1), (lo, mid, to_left, level + 1)]
        got = sorted(taken)[:m]
        if len(got) < m:
            free = [i for i in range(len(s)) if i not in taken]
            need = m - len(got)
            step = max(1, len(free) / need)
            got = sorted([*got, *(free[int(i * step)] for i in range(min(need, len(free))))])[:m]
        return got

    return _by_video(rows, pick, m)
