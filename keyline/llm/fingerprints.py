"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut at line ends, and inside long lines before words whose hash says so; each part's digest enters three cells
of a sketch, which hold a count, the XOR of digests and the XOR of their checks. A fingerprint is written at the least
size, doubled from CELLS on, at which it gives all its digests back. Sizes are thirds of a power of two cells each, so a
sketch folds to half its size by adding its halves. Two fingerprints, folded to a small size, subtract cell by cell, and
peeling cells that hold one digest recovers what differs; if that fails, it is tried at twice the size, up to the smaller
one's, and then both are read out whole. Likeness is the share of common digests among all, repeats counted; two texts
without any part are alike. So likeness follows from the two written fingerprints: see ``compared``.

Defined cases: a null text is empty; the order is by doc_id, null first, rows of one doc_id by a hash of their text; a
table of one row is its own next document; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyline.llm.common import documents, mix, partitions, prefix, raw, words

CELLS = 12
#: A line is cut before about one word in so many.
CUT = 16
#: Equal rows of one doc_id are spread over several ranges if they are more.
MANY = 10_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHECK = np.uint64(0xC2B2AE3D27D4EB4F)


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the parts of all texts, and the text of each; a part's second occurrence in a text has a digest of its own."""
    data, offsets = raw(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, ends, _ = words(data, offsets)
    sums, down = prefix(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:][data == 0x0A] = True
    hashed = mix((sums[ends] - sums[starts]) * down[starts])
    cut[starts[hashed % np.uint64(CUT) == 0]] = True
    cut[-1] = False
    a = np.flatnonzero(cut)
    b = np.append(a[1:], len(data))
    d = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    owner = np.searchsorted(offsets, a, "right") - 1
    order = np.lexsort((d, owner))
    d, owner = d[order], owner[order]
    new = np.append(True, (d[1:] != d[:-1]) | (owner[1:] != owner[:-1]))
    at = np.flatnonzero(new)
    nth = np.arange(len(d)) - np.repeat(at, np.diff(np.append(at, len(d))))
    return np.where(nth > 0, mix(d + nth.astype(np.uint64) * _STEP), d), owner


def cells_of(d: np.ndarray, m: int) -> np.ndarray:
    """The three cells of each digest, one in each third of a sketch of m = 3 * 2^k cells."""
    third, salts = m // 3, np.arange(1, 4, dtype=np.uint64) * _STEP
    return np.stack([(mix(d + salts[j]) & np.uint64(third - 1)).astype(np.int64) + j * third for j in range(3)])


class Sketches:
    """n sketches of m cells each."""

    def __init__(self, n: int, m: int):
        self.n, self.m = n, m
        self.count, self.key, self.check = np.zeros(n * m, np.int64), np.zeros(n * m, np.uint64), np.zeros(n * m, np.uint64)

    def add(self, d: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = mix(d ^ _CHECK)
        for cell in cells_of(d, self.m):
            at = owner * self.m + cell
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, d)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes all that can be taken: how many digests on the plus and minus side by sketch, and whether it came out empty."""
        sides = np.zeros((2, self.n), np.int64)
        self.out: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[(mix(self.key[pure] ^ _CHECK) ^ self.check[pure]) >> np.uint64(32) == 0]
            if not len(pure):
                break
            owner, d, sign = pure // self.m, self.key[pure], self.count[pure]
            one = np.lexsort((d, owner))
            one = one[np.append(True, (d[one][1:] != d[one][:-1]) | (owner[one][1:] != owner[one][:-1]))]
            owner, d, sign = owner[one], d[one], sign[one]
            np.add.at(sides[0], owner[sign > 0], 1)
            np.add.at(sides[1], owner[sign < 0], 1)
            self.out.append((d, sign))
            self.add(d, owner, -sign)
        empty = ~((self.count != 0) | (self.key != 0)).reshape(self.n, self.m).any(axis=1)
        return sides[0], sides[1], empty

    def taken(self) -> tuple[tuple[np.ndarray, np.ndarray], bool]:
        """Of one sketch: the digests on either side, and whether it came out empty."""
        empty = bool(self.peel()[2][0])
        d, sign = (np.concatenate([np.zeros(0, kind), *(o[i] for o in self.out)]) for i, kind in ((0, np.uint64), (1, np.int64)))
        return (d[sign > 0], d[sign < 0]), empty

    def written(self, used: np.ndarray) -> list[str]:
        packed = np.zeros((self.n, self.m), _CELL)
        packed["count"], packed["key"] = self.count.reshape(self.n, -1), self.key.reshape(self.n, -1)
        packed["check"] = (self.check >> np.uint64(32)).reshape(self.n, -1)
        return [base64.b64encode(row.tobytes()).decode() for row in packed[used]]


_CELL = np.dtype([("count", "u1"), ("key", "<u8"), ("check", "<u4")])


def fingerprints_of(d: np.ndarray, owner: np.ndarray, n: int, cells: int = CELLS) -> tuple[list[str], np.ndarray]:
    """Of each of n texts its sketch at the least size that gives all digests back, and that size."""
    out, size, left, m = [""] * n, np.zeros(n, np.int64), np.arange(n), cells
    many = np.bincount(owner, minlength=n)
    while len(left):
        fits = many[left] <= m
        place = np.full(n, -1)
        place[left] = np.arange(len(left))
        mine = place[owner] >= 0
        s, t = Sketches(len(left), m), Sketches(len(left), m)
        for x in (s, t):
            x.add(d[mine], place[owner[mine]])
        fits &= (s.count.reshape(len(left), m) < 256).all(axis=1) & t.peel()[2]
        for i, text in zip(left[fits].tolist(), s.written(fits), strict=True):
            out[i], size[i] = text, m
        left, m = left[~fits], 2 * m
    return out, size


def _read(fingerprint: str) -> Sketches:
    cells = np.frombuffer(base64.b64decode(fingerprint), _CELL)
    s = Sketches(1, len(cells))
    s.count, s.key, s.check = cells["count"].astype(np.int64), cells["key"].copy(), cells["check"].astype(np.uint64) << np.uint64(32)
    return s


def _folded(s: Sketches, m: int) -> Sketches:
    out = Sketches(1, m)
    for name, add in (("count", np.add), ("key", np.bitwise_xor), ("check", np.bitwise_xor)):
        setattr(out, name, add.reduce(getattr(s, name).reshape(3, -1, m // 3), axis=1).reshape(-1))
    return out


def differing(a: str, b: str, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """The digests that only one of two written fingerprints has."""
    x, y = _read(a), _read(b)
    m = min(cells, x.m, y.m)
    while m <= min(x.m, y.m):
        p, q = _folded(x, m), _folded(y, m)
        p.count, p.key, p.check = p.count - q.count, p.key ^ q.key, p.check ^ q.check
        sides, empty = p.taken()
        if empty:
            return sides
        m *= 2
    own, other = x.taken()[0][0], y.taken()[0][0]
    return np.setdiff1d(own, other), np.setdiff1d(other, own)


def compared(a: str, b: str) -> float:
    """The likeness of two written fingerprints."""
    plus, minus = differing(a, b)
    n = int(_read(a).count.sum()) // 3
    return (n - len(plus)) / (n + len(minus)) if n + len(minus) else 1.0


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> np.ndarray:
    """``compared`` for all pairs of texts at once, from digests (digests, owner) and the sizes of the written fingerprints:
    what the digests give at a smaller size is the written sketch folded."""
    n, most = len(sizes[0]), np.minimum(*sizes)
    many = [np.bincount(x[1], minlength=n) for x in (a, b)]
    out, left, m = np.ones(n), np.arange(n), cells
    while len(left):
        place = np.full(n, -1)
        place[left] = np.arange(len(left))
        s = Sketches(len(left), m)
        for (d, owner), sign in ((a, 1), (b, -1)):
            mine = place[owner] >= 0
            s.add(d[mine], place[owner[mine]], sign)
        plus, minus, empty = s.peel()
        done = left[empty]
        common, every = many[0][done] - plus[empty], many[0][done] + minus[empty]
        out[done] = np.where(every > 0, common / np.maximum(every, 1), 1.0)
        left, m = left[~empty], 2 * m
        whole = left[most[left] < m]
        if len(whole):
            place = np.zeros(n, bool)
            place[whole] = True
            both = [np.stack([x[1][place[x[1]]].astype(np.uint64), x[0][place[x[1]]]]) for x in (a, b)]
            pairs, times = np.unique(np.concatenate(both, axis=1), axis=1, return_counts=True)
            common = np.bincount(pairs[0][times == 2].astype(np.int64), minlength=n)[whole]
            out[whole] = common / np.maximum(many[0][whole] + many[1][whole] - common, 1)
            left = left[most[left] >= m]
    return out


def _fingerprints(cells: int):
    def some(rows: list[tuple[int, str]], after: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        following = [*texts[1:], after]
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
        n = len(rows)
        d, owner = digests(pa.array([*texts, after], pa.large_string()))
        own, nxt = (d[owner < n], owner[owner < n]), (d[owner > 0], owner[owner > 0] - 1)
        changed = digests(pa.array(edited, pa.large_string()))
        (prints, size), (others, resized) = (fingerprints_of(*x, n, cells) for x in (own, changed))
        following_size = fingerprints_of(*nxt, n, cells)[1] if n == 1 else np.append(size[1:], fingerprints_of(nxt[0][nxt[1] == n - 1], nxt[1][nxt[1] == n - 1] - (n - 1), 1, cells)[1])
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
             pa.array(prints), pa.array(others), pa.array(likeness(own, changed, (size, resized), cells)), pa.array(likeness(own, nxt, (size, following_size), cells))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order, those to look ahead to last; a group's last row waits for the row after it."""
        rows: list[tuple[int, str]] = []
        size, group, over = 0, None, False
        for batch in batches:
            for p, flag, i, t in zip(*(batch.column(c).to_pylist() for c in ("p", "ahead", "doc_id", "text")), strict=True):
                if p != group:
                    group, rows, size, over = p, [], 0, False
                if flag:
                    if not over and rows:
                        yield some(rows, t)
                    rows, over = [], True
                    continue
                if size > 1 << 20:
                    yield some(rows, t)
                    rows, size = [], 0
                rows.append((i, t))
                size += len(t)

    return run


def _bounds(keys: DataFrame, parts: int) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
    """Ascending bounds (o, h) of about ``parts`` like ranges, and of pairs with very many equal rows how many more ranges
    each takes. Ids that hold several ranges are parted by the text's hash."""
    shares, fine = ([k / n for k in range(1, n)] for n in (parts, 8 * parts))
    cuts = Counter((keys.agg(F.percentile_approx("o", shares, 10_000)).first()[0] or []) if shares else [])
    bounds, often = {(o, -(1 << 63)) for o in cuts}, Counter()
    hot = [o for o, n in cuts.items() if n > 1]
    if hot:
        for o, by in keys.where(F.col("o").isin(hot)).groupBy("o").agg(F.percentile_approx("h", fine, 10_000)).collect():
            often.update((o, by[round((j + 1) * 8 * parts / (cuts[o] + 1)) - 1]) for j in range(cuts[o]))
    bounds |= set(often) | {(o + 1, -(1 << 63)) for o in hot if o < (1 << 63) - 1}
    again = {k: n for k, n in often.items() if n > 1}
    if again:
        known = keys.sparkSession.createDataFrame(list(again), "o long, h long")
        counts = keys.join(F.broadcast(known), ["o", "h"]).groupBy("o", "h").count().collect()
        again = {(o, h): again[o, h] for o, h, n in counts if n > MANY}
    return sorted(bounds), again


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _place_of(bounds: list[tuple[int, int]], again: dict[tuple[int, int], int]) -> Column:
    """The range of (o, h): how many bounds are at most as great, by halving; very many equal rows are dealt to several by x."""
    if not bounds:
        return F.lit(0)
    o, h = _longs([b[0] for b in bounds]), _longs([b[1] for b in bounds])
    more = [again.get(b, 0) for b in bounds]
    first = _longs(np.cumsum([0, *(1 + m for m in [0, *more[:-1]])]).tolist())
    steps = _longs([1 << k for k in reversed(range(len(bounds).bit_length()))])
    at_most = lambda i: (o[i] < F.col("o")) | ((o[i] == F.col("o")) & (h[i] <= F.col("h")))
    before = F.aggregate(steps, F.lit(0).cast("long"), lambda a, step: F.when((a + step <= len(bounds)) & at_most(F.least(a + step, F.lit(len(bounds))).cast("int") - 1), a + step).otherwise(a))
    place = F.transform(F.array(before), lambda n: first[n.cast("int")])[0]
    for (p, q), m in again.items():
        place = place + F.when((F.col("o") == p) & (F.col("h") == q), F.pmod(F.col("x"), F.lit(m + 1))).otherwise(0)
    return place


def fingerprints(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Each row's fingerprint, and that of its text edited with the next row's; see the module for the order.

    Texts move once: to ranges of (doc_id, hash of the text), which are about as many as the shuffle partitions. The first
    row of a range also goes to the range before it, and that of the first one to the last one; of very many equal rows a
    few hundred do.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("o"), F.xxhash64(text).alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("x"))
    bounds, again = _bounds(keyed.select("o", "h"), partitions(spark))
    placed = keyed.withColumn("p", _place_of(bounds, again).cast("int"))
    firsts = sorted((r["p"], r["k"]["o"], r["k"]["h"]) for r in placed.groupBy("p").agg(F.min(F.struct("o", "h")).alias("k")).collect())
    goes: dict[tuple[int, int], list[int]] = {}
    for k, (_, o, h) in enumerate(firsts):
        goes.setdefault((o, h), []).append(firsts[k - 1][0])
    known = spark.createDataFrame([(*k, v) for k, v in goes.items()], "o long, h long, before array<int>")
    few = F.lit(True)
    for o, h in again:
        few = few & ((F.col("o") != o) | (F.col("h") != h) | (F.pmod(F.xxhash64("x"), F.lit(MANY // 1000)) == 0))
    ahead = F.when(few, F.transform(F.coalesce("before", F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), F.lit(1).alias("ahead")))).otherwise(F.array().cast("array<struct<p:int,ahead:int>>"))
    met = placed.join(F.broadcast(known), ["o", "h"], "left")
    sent = met.withColumn("g", F.explode(F.concat(F.array(F.struct("p", F.lit(0).alias("ahead"))), ahead))).select("g.p", "g.ahead", "o", "h", "doc_id", "text")
    ranged = sent.repartitionById(max([r[0] for r in firsts], default=0) + 1, F.col("p")).sortWithinPartitions("p", "ahead", "o", "h")
    return ranged.select("p", "ahead", "doc_id", "text").mapInArrow(_fingerprints(cells), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text, and their likeness."""
    return fingerprints(documents(spark, sf_dir))
