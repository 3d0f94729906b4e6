"""Selections that have no SQL, restated plainly on random sequences: ties, few frames, equal scores, NaN and infinities."""

import math
import random

import pytest

from keyline.operators import selection as S

SCHEMA = "video_id long, pos int, frame_id long, score double"


def sequences(seed, odd=False):
    rnd, out = random.Random(seed), []
    for v in range(200):
        n = rnd.choice((1, 2, 3, 5, 9, 17, 30, 64))
        kind = v % 4
        scores = [round(rnd.random(), 1 if kind == 1 else 6) for _ in range(n)] if kind < 3 else [0.5] * n
        if kind == 2:  # steps, so that shots and leaves are of several sizes
            scores = [round(0.2 * (i // 6 % 4) + 0.01 * rnd.random(), 6) for i in range(n)]
        if odd and v % 10 == 0:
            scores[rnd.randrange(n)] = rnd.choice((math.nan, math.inf, -math.inf))
        out.append(scores)
    return out


def frame(spark, videos):
    return spark.createDataFrame([(v, p, p * 30, float(s)) for v, scores in enumerate(videos) for p, s in enumerate(scores)], SCHEMA).repartition(3)


def chosen(df):
    out: dict[int, list[int]] = {}
    for r in df.orderBy("video_id", "rank").collect():
        out.setdefault(r["video_id"], []).append(r["frame_id"] // 30)
    return out


def unit(scores, constant=0.5):
    low, high = min(scores), max(scores)
    return [(x - low) / (high - low) if high > low else constant for x in scores]


@pytest.mark.parametrize("how", [{}, {"window": 8, "tau": 0.08, "beta": 0.1, "tolerance": 1e-6, "fading": True}])
def test_ripples(spark, how):
    m, window, tau, beta, gamma = 8, how.get("window", 5), how.get("tau", 0.01), how.get("beta", 0.05), 0.1
    videos = sequences(1)
    got = chosen(S.ripples(frame(spark, videos), m=m, **how))
    for v, scores in enumerate(videos):
        s, n = unit(scores), len(scores)
        if n <= m:
            assert got[v] == list(range(n))
            continue
        seeds = [i for i in range(n) if s[i] >= 0.3 and all(s[i] >= s[j] - how.get("tolerance", 0.0) for j in range(n) if abs(i - j) <= window)]
        if not seeds:
            want = sorted(range(n), key=lambda i: (s[i], i))[n - m :]
        else:
            owner = [None] * n  # the seed whose claim on a frame counts
            pool = set()
            for seed in sorted(seeds, key=lambda i: (-s[i], i)):
                owner[seed] = seed
                pool.add(seed)
                for side in (range(seed - 1, -1, -1), range(seed + 1, n)):
                    for i in side:
                        worth = s[i] * math.exp(-beta * abs(seed - i))
                        if owner[i] is not None:
                            worth -= gamma * s[owner[i]] * (math.exp(-beta * abs(i - owner[i])) if how.get("fading") else 1)
                        if worth <= tau:
                            break
                        pool.add(i)
                        if owner[i] is None or s[owner[i]] < s[seed]:
                            owner[i] = seed
            want = sorted(pool, key=lambda i: (-s[i], i))[:m]
        assert got[v] == sorted(want), v


def test_exactly(spark):
    m, alpha, beta = 7, 0.85, 5.0
    videos = sequences(2, odd=True)
    got = chosen(S.exactly(frame(spark, videos), m=m, alpha=alpha, beta=beta))

    def clean(x):
        if not all(map(math.isfinite, x)):
            x = [0.0 if math.isnan(a) else 1.0 if a == math.inf else 0.0 if a == -math.inf else a for a in x]
        low, high = min(x), max(x)
        return [0.0] * len(x) if high - low < 1e-12 else [(a - low) / (high - low) for a in x]

    for v, scores in enumerate(videos):
        n = len(scores)
        if n <= m:
            assert got[v] == list(range(n))
            continue
        d = clean(scores)
        for _ in range(max(3, int(math.log2(n)) + 2)):
            new = []
            for i in range(n):
                a, b = d[i - 1] if i else d[0], d[i + 1] if i + 1 < n else d[-1]
                p, q = math.exp(-beta * abs(d[i] - a)), math.exp(-beta * abs(d[i] - b))
                new.append(alpha * d[i] + (1 - alpha) * (p * a + q * b) / (p + q + 1e-12))
            d = new
        d = clean(clean(d))
        reach = max(1, round(n / m / 2))
        # scores that differ by less than rounding may be taken in either order
        order = sorted(range(n), key=lambda i: (-round(d[i], 10), i))
        taken = []
        for i in order:
            if all(abs(i - j) > reach for j in taken):
                taken.append(i)
        taken = taken[:m]
        taken += [i for i in order if i not in taken][: m - len(taken)]
        assert len(got[v]) == m == len(set(got[v])), v
        assert sorted(round(d[i], 8) for i in got[v]) == sorted(round(d[i], 8) for i in taken) or got[v] == sorted(taken), v


def quantile(values, q):
    x = sorted(values)
    at = (len(x) - 1) * q
    low = math.floor(at)
    return x[low] + (x[min(low + 1, len(x) - 1)] - x[low]) * (at - low)


@pytest.mark.parametrize("scope", ["first", "per_video"])
def test_dual_quota(spark, scope):
    m, levels, stop, gap, ref = 6, 5, 0.5, 2.0, 0.2
    videos = sequences(3)
    got = chosen(S.dual_quota(frame(spark, videos), m, theta_scope=scope))
    first = next(quantile(unit(x), 0.85) for x in videos if len(x) > m)
    for v, scores in enumerate(videos):
        s, n = unit(scores), len(scores)
        if n <= m:
            assert got[v] == list(range(n))
            continue
        theta, peak = first if scope == "first" else quantile(s, 0.85), quantile(s, 0.75)

        def best(lo, hi, k, s=s):
            out = []
            for i in sorted(range(lo, hi), key=lambda i: (-round(s[i], 12), -i)):
                if len(out) < k and all(abs(i - j) >= gap for j in out):
                    out.append(i)
            return set(out)

        def split(lo, hi, k, level, s=s, theta=theta, peak=peak):
            if k <= 0 or lo >= hi:
                return set()
            part = s[lo:hi]
            top = sorted(part)[-k:]
            if level == levels or k == 1 or len(part) <= k or sum(top) / len(top) - sum(part) / len(part) >= stop:
                return best(lo, hi, k)
            rho = sum(x >= peak for x in part) / max(len(part) - 1, 1e-6)
            own = min(k, max(0, (1 if max(part) >= theta or rho > 0 else 0) + round(rho / ref)))
            out, middle = best(lo, hi, own) if own else set(), (lo + hi - 1) / 2
            cut = next((i for i in range(lo, hi) if i > middle), hi)
            a, b = sum(s[lo:cut]) + 1e-6, sum(s[cut:hi]) + 1e-6
            left = round((k - own) * a / (a + b))
            return out | split(lo, cut, left, level + 1) | split(cut, hi, k - own - left, level + 1)

        want = sorted(split(0, n, m, 0))
        taken = set(want)
        want = want[:m]
        if len(want) < m:
            free, need = [i for i in range(n) if i not in taken], m - len(want)
            want = sorted(want + [free[int(j * len(free) / need)] for j in range(need)])[:m]
        assert got[v] == want, v


@pytest.mark.parametrize("method", ["gaussian_soft", "mmr", "temporal_gaussian", "dpp_multiplicative", "power_law"])
@pytest.mark.parametrize("mask", [False, True])
def test_soft_rules(spark, method, mask):
    m, videos = 6, sequences(4)
    got = chosen(S.soft_suppressed(frame(spark, videos), m, method=method, mask_selected=mask))
    for v, scores in enumerate(videos):
        d, n = unit(scores), len(scores)
        if n <= m:
            assert got[v] == list(range(n))
            continue
        w = [1 / (abs(a - b) + 1e-6) for a, b in zip(d, d[1:], strict=False)]
        w = [x / max(w) for x in w]
        for _ in range(max(1, int(math.log2(n)))):
            d = [0.75 * x + 0.25 * (d[1] if i == 0 else d[-2] if i == n - 1 else (w[i - 1] * d[i - 1] + w[i] * d[i + 1]) / (w[i - 1] + w[i])) for i, x in enumerate(d)]
        like = [[0.0 if i == j else math.exp(-abs(d[i] - d[j]) / 0.1) for j in range(n)] for i in range(n)]
        left, taken = list(d), []
        for _ in range(m):
            free = [i for i in range(n) if not (mask and i in taken)]
            # steps of rounding don't decide: of scores alike to ten places the one that was chosen counts
            top = max(left[i] for i in free)
            if top <= 0:
                break
            alike = [i for i in free if left[i] >= top - 1e-10]
            i = next((j for j in alike if got[v].count(j) > taken.count(j)), alike[0])
            taken.append(i)
            for j in range(n):
                if method == "mmr":
                    left[j] = 0.7 * left[j] - 0.3 * max(like[j][t] for t in taken) if left[j] > 0 else 0.0
                elif method == "dpp_multiplicative":
                    left[j] *= math.prod(1 - like[j][t] for t in taken if t != j) if left[j] > 0 else 1
                elif j != i and left[j] > 0:
                    near = like[i][j]
                    left[j] *= {"gaussian_soft": math.exp(-0.5 * near), "temporal_gaussian": math.exp(-(((j - i) * 30 / 5.0) ** 2)), "power_law": (1 + near) ** -2}[method]
        assert got[v] == sorted(taken), v
