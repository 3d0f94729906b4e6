"""Suffix-array dedup: a common-prefix-aware distributed merge sort of sparse suffixes finds repeated byte strings.

Of the k-byte strings within any ``length`` bytes, the one with the least hash is its anchor; equal strings have it at the
same place. So only suffixes at anchors need sorting, each for the range of starts whose anchor it is:

1. Anchors are dealt by hash; those whose hash occurs once are dropped. Of a hash that one task has several times only one
   goes out. What is left goes back to its document.
2. Tasks cut the suffixes of these anchors and the bytes before them from the texts, sort them, and send front-coded runs,
   dealt by the anchor's hash. Like contexts in a run go out once.
3. Runs meet in a loser tree, which compares two heads only beyond the prefix that both are known to share with what was
   last put out. From the sorted suffixes, their common prefixes and the bytes before them follows, for each start, whether
   its string has an earlier occurrence.
4. The starts found go back to the documents, whose covered bytes go.

Texts move only for documents that have something to compare or to remove, as far as a bitmap of bounded size can tell.

Defined cases: a null or empty text has no bytes; null doc_ids are the smallest; repeated rows are one document and each
gives its row; rows of one doc_id with unequal texts are documents of their own, where the hash of the text breaks ties;
texts shorter than ``length`` are left whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyline.llm.common import bitmap, dealt, documents, get, least, marked, mix, only_marked, partitions, prefix, put, raw, slices, split_by, stacked, staged

LENGTH = 100
ANCHOR = 32
#: Bytes of text whose anchors leave a task together.
CHUNK = 24 << 20
_LEAST = -(1 << 63)
_SEEN = (np.int64, np.int64, np.uint32, np.uint64, np.uint32, np.uint8, np.uint8)
_FOUND = (np.int64, np.int64, np.uint64, np.uint32, np.uint8, np.uint8)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first start, last start, hash) of each run of starts that share an anchor; places are in ``data``."""
    sizes = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if len(data) < length or not (sizes >= length).any():
        return none, none, none, none, none.astype(np.uint64)
    sums, down = prefix(data)
    hashes = mix((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])
    w = length - k + 1
    n = len(hashes)
    low = np.uint64((1 << 34) - 1)  # places; the hash's upper bits order strings, and of equal ones the leftmost is the anchor
    key = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    anchor = (least(key, w) & low).astype(np.int64)
    starts = len(anchor)
    edge = np.zeros(len(data) + 1, np.int64)
    lasting = sizes >= length
    np.add.at(edge, offsets[:-1][lasting], 1)
    np.add.at(edge, offsets[1:][lasting] - length + 1, -1)
    x = np.flatnonzero(np.cumsum(edge[:starts]) > 0)
    s = anchor[x]
    new = np.append(True, (s[1:] != s[:-1]) | (x[1:] != x[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    at = s[first]
    return np.searchsorted(offsets, at, "right") - 1, at, x[first], x[last], hashes[at]


def _blobs(ids, versions, row, part, *columns) -> Iterator[tuple[int, bytes]]:
    for p, i in split_by(part):
        used, local = np.unique(row[i], return_inverse=True)
        yield p, put(ids[used], versions[used], local.astype(np.uint32), *(c[i] for c in columns))


def _home(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "blob"])


def _anchored(parts: int, length: int, k: int) -> Callable:
    """Kind 0: anchors by hash, one of each hash. Kind 1: anchors of hashes met twice here, by document."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        base, columns = 0, []
        for h in held:
            columns.append((h[0], h[1], h[2] + base, *h[3:]))
            base += len(h[0])
        ids, versions, row, hashes, pos, alo, ahi = (np.concatenate(c) for c in zip(*columns, strict=True))
        _, first, back, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[back] > 1)
        out = [(p, 0, b) for p, b in _blobs(ids, versions, row[first], (hashes[first] % np.uint64(parts)).astype(np.int64), hashes[first], pos[first], alo[first], ahi[first], (times > 1).astype(np.uint8))]
        out += [(p, 1, b) for p, b in _blobs(ids, versions, row[twice], _home(ids, parts)[row[twice]], hashes[twice], pos[twice], alo[twice], ahi[twice], np.ones(len(twice), np.uint8))]
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            data, offsets = raw(batch.column("text"))
            text, at, lo, hi, hashes = anchors(data, offsets, length, k)
            if len(text):
                held.append((batch.column("o").to_numpy(), batch.column("v").to_numpy(), text, hashes, (at - offsets[text]).astype(np.uint32), (at - hi).astype(np.uint8), (at - lo).astype(np.uint8)))
            size += len(data)
            if size > CHUNK and held:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _met(parts: int) -> Callable:
    """Anchors whose hash came from two tasks, or twice from one, go on to their documents."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = list(zip(pdf["part"][pdf["kind"] == 1].tolist(), pdf["blob"][pdf["kind"] == 1], strict=True))
        got = [get(b, *_SEEN, np.uint8) for b in pdf["blob"][pdf["kind"] == 0]]
        if got:
            base = np.cumsum([0, *(len(g[0]) for g in got)])
            ids, versions = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            row = np.concatenate([g[2].astype(np.int64) + b for g, b in zip(got, base, strict=False)])
            hashes, pos, alo, ahi, more = (np.concatenate([g[i] for g in got]) for i in range(3, 8))
            _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
            i = np.flatnonzero((times[back] > 1) & (more == 0))
            out += list(_blobs(ids, versions, row[i], _home(ids, parts)[row[i]], hashes[i], pos[i], alo[i], ahi[i], np.ones(len(i), np.uint8)))
        return pd.DataFrame(out, columns=["home", "blob"])

    return run


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row a document: all of its anchors that occur elsewhere or again."""
    got = [get(b, *_SEEN, np.uint8) for b in pdf["blob"]]
    o, v = (np.concatenate([g[i][g[2]] for g in got]) for i in (0, 1))
    columns = [np.concatenate([g[i] for g in got]) for i in (3, 4, 5, 6)]
    out = []
    order = np.lexsort((columns[1], v, o))
    new = np.append(True, (o[order][1:] != o[order][:-1]) | (v[order][1:] != v[order][:-1]))
    at = [*np.flatnonzero(new).tolist(), len(order)]
    for a, b in zip(at[:-1], at[1:], strict=True):
        i = order[a:b]
        out.append((int(o[i[0]]), int(v[i[0]]), put(*(c[i] for c in columns))))
    return pd.DataFrame(out, columns=["o", "v", "anchors"])


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Common prefix with the string before, length of the rest, and all rests."""
    shared, rest, before = np.zeros(len(strings), np.uint8), np.zeros(len(strings), np.uint8), b""
    out = []
    for i, s in enumerate(strings):
        h = common(before, s)
        shared[i], rest[i] = h, len(s) - h
        out.append(s[h:])
        before = s
    return shared, rest, b"".join(out)


def decoded(shared: np.ndarray, rest: np.ndarray, data: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for h, n in zip(shared.tolist(), rest.tolist(), strict=True):
        before = before[:h] + data[at : at + n]
        at += n
        out.append(before)
    return out


_RUN = (np.int64, np.int64, np.uint32, np.uint32, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8)


def _runs(parts: int, length: int) -> Callable:
    """Kind 0: sorted front-coded runs by hash. Kind 1: starts that a like context earlier in the run settles, by document."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        out, settled = [], []
        held.sort()  # part, suffix, bytes before it (backwards), range, document, place
        at = 0
        while at < len(held):
            to, p = at, held[at][0]
            kept = []
            while to < len(held) and held[to][0] == p:
                if kept and held[to][1:5] == kept[-1][1:5] and held[to][5:] != kept[-1][5:]:
                    settled.append(held[to])
                else:
                    kept.append(held[to])
                to += 1
            ids, versions = np.array([h[5] for h in kept], np.int64), np.array([h[7] for h in kept], np.int64)
            used, local = np.unique(np.stack([ids, versions]), axis=1, return_inverse=True)
            right, left = front_coded([h[1] for h in kept]), front_coded([h[2] for h in kept])
            out.append((p, 0, put(used[0], used[1], local.reshape(-1).astype(np.uint32), np.array([h[6] for h in kept], np.uint32), np.array([h[3] for h in kept], np.uint8), np.array([h[4] for h in kept], np.uint8), right[0], right[1], np.frombuffer(right[2], np.uint8), left[0], left[1], np.frombuffer(left[2], np.uint8))))
            at = to
        if settled:
            o, v = np.array([h[5] for h in settled], np.int64), np.array([h[7] for h in settled], np.int64)
            s, lo, hi = (np.array([h[i] for h in settled], np.int64) for i in (6, 3, 4))
            out += [(p, 1, b) for p, b in _spans(o, v, s - hi, s - lo, parts)]
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in slices(batches):
            for o, v, text, found in zip(*(batch.column(c).to_pylist() for c in ("o", "v", "text", "anchors")), strict=True):
                data = text.encode()
                hashes, pos, alo, ahi = get(found, np.uint64, np.uint32, np.uint8, np.uint8)
                for h, s, lo, hi in zip((hashes % np.uint64(parts)).tolist(), pos.tolist(), alo.tolist(), ahi.tolist(), strict=True):
                    held.append((h, data[s : s + length - lo], data[s - hi : s][::-1], lo, hi, o, s, v))
                if len(held) > 150_000:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return run


def _spans(o, v, lo, hi, parts) -> Iterator[tuple[int, bytes]]:
    """Ranges of starts by the part of their document."""
    for p, i in split_by(_home(o, parts)):
        yield p, put(o[i], v[i], lo[i].astype(np.uint32), hi[i].astype(np.uint32))


def merged(runs: list[list[tuple[int, bytes, int]]]) -> Iterator[tuple[int, int]]:
    """(common prefix with the one before, number) of all strings of the sorted runs [(common prefix, string, number)], in order.

    A loser tree. Each head knows its common prefix with the last string put out: of two heads the one with the longer is
    the smaller; only if they are equal are bytes compared, from there on, and the loser then knows its prefix with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [iter(r) for r in runs]
    known, string, number = [0] * k, [None] * k, [0] * k

    def step(i: int) -> None:
        got = next(heads[i], None) if i < len(heads) else None
        known[i], string[i], number[i] = got if got is not None else (0, None, 0)

    def play(i: int, j: int) -> tuple[int, int]:
        if string[j] is None:
            return i, j
        if string[i] is None:
            return j, i
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        a, b = string[i], string[j]
        h = common(a, b, known[i])
        if a[h:] <= b[h:]:
            known[j] = h
            return i, j
        known[i] = h
        return j, i

    for i in range(k):
        step(i)
        known[i] = 0
    loser = [0] * k
    winners = list(range(k))
    at = k
    while at > 1:
        at //= 2
        nxt = []
        for n in range(at):
            w, lost = play(winners[2 * n], winners[2 * n + 1])
            loser[at + n] = lost
            nxt.append(w)
        winners = nxt
    w = winners[0]
    while string[w] is not None:
        yield known[w], number[w]
        step(w)
        n = (w + k) // 2
        while n >= 1:
            w, loser[n] = play(w, loser[n])
            n //= 2


def earlier(shared: np.ndarray, left: list[bytes], alo: np.ndarray, ahi: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted suffixes, whose string at each start has an earlier occurrence: (suffix, least and most bytes before it).

    Two starts have equal strings if as many bytes go before both anchors, these bytes are equal, and so are the suffixes
    up to the rest of the length. ``order`` ranks suffixes by document and place.
    """
    n, most = len(left), int(ahi.max()) if len(ahi) else 0
    before = np.zeros((n, most), np.uint8)
    sizes = np.array([len(x) for x in left])
    flat = np.frombuffer(b"".join(left), np.uint8)
    rows = np.repeat(np.arange(n), sizes)
    before[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    found = np.zeros((n, most + 2), bool)
    hashed = np.zeros(n, np.uint64)
    for a in range(most + 1):
        if a:
            hashed = mix(hashed * np.uint64(0xD6E8FEB86659FD93) + before[:, a - 1].astype(np.uint64) + np.uint64(1))
        some = np.flatnonzero((alo <= a) & (a <= ahi))
        if len(some) < 2:
            continue
        like = np.cumsum(shared < length - a)[some].astype(np.uint64)
        _, group = np.unique(mix(like * np.uint64(0x9E3779B97F4A7C15)) ^ hashed[some], return_inverse=True)
        first = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, group, order[some])
        found[some, a] = order[some] > first[group]
    step = np.diff(found.astype(np.int8), axis=1, prepend=0)
    row, lo = np.nonzero(step == 1)
    hi = np.nonzero(step == -1)[1] - 1
    return row, lo, hi


def _merged(parts: int, length: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = list(zip(pdf["part"][pdf["kind"] == 1].tolist(), pdf["blob"][pdf["kind"] == 1], strict=True))
        runs, left, o, v, s, alo, ahi, base = [], [], [], [], [], [], [], 0
        for b in pdf["blob"][pdf["kind"] == 0]:
            ids, versions, local, pos, lo, hi, rs, rn, rd, ls, ln, ld = get(b, *_RUN)
            runs.append(list(zip(rs.tolist(), decoded(rs, rn, rd.tobytes()), range(base, base + len(pos)), strict=True)))
            left += decoded(ls, ln, ld.tobytes())
            o.append(ids[local])
            v.append(versions[local])
            s.append(pos.astype(np.int64))
            alo.append(lo)
            ahi.append(hi)
            base += len(pos)
        if runs:
            shared, number = (np.array(x) for x in zip(*merged(runs), strict=True))
            o, v, s, alo, ahi = (np.concatenate(x)[number] for x in (o, v, s, alo, ahi))
            rank = np.lexsort((v, s, o))
            new = np.append(0, np.cumsum((np.diff(o[rank]) != 0) | (np.diff(s[rank]) != 0) | (np.diff(v[rank]) != 0)))
            order = np.empty(len(rank), np.int64)
            order[rank] = new
            row, lo, hi = earlier(shared, [left[i] for i in number.tolist()], alo, ahi, order, length)
            out += list(_spans(o[row], v[row], s[row] - hi, s[row] - lo, parts))
        return pd.DataFrame(out, columns=["home", "blob"])

    return run


def _spans_by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    o, v, lo, hi = stacked(pdf["blob"], np.int64, np.int64, np.uint32, np.uint32)
    order = np.lexsort((lo, v, o))
    new = np.append(True, (np.diff(o[order]) != 0) | (np.diff(v[order]) != 0))
    at = [*np.flatnonzero(new).tolist(), len(order)]
    out = [(int(o[order[a]]), int(v[order[a]]), put(lo[order[a:b]], hi[order[a:b]])) for a, b in zip(at[:-1], at[1:], strict=True)]
    return pd.DataFrame(out, columns=["o", "v", "starts"])


def covered(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by strings that start at lo..hi; ``lo`` ascends."""
    end = np.maximum.accumulate(hi.astype(np.int64) + length)
    new = np.append(True, lo[1:] > end[:-1])
    first = np.flatnonzero(new)
    return lo[first].astype(np.int64), end[np.append(first[1:], len(lo)) - 1]


def _kept(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for i, text, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts")), strict=True):
                data, gone, spans = text.encode(), [], []
                if starts is not None:
                    a, b = covered(*get(starts, np.uint32, np.uint32), length)
                    spans = list(zip(a.tolist(), b.tolist(), strict=True))
                at, kept = 0, []
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                    gone.append(b - a)
                kept.append(data[at:])
                out.append((i, len(data), sum(gone), len(spans), b"".join(kept), [x for span in spans for x in span]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[j] for r in out], pa.int64()) for j in (1, 2, 3)), pa.array([hashlib.sha256(r[4]).hexdigest() for r in out]), pa.array([r[4] for r in out], pa.binary()), pa.array([r[5] for r in out], pa.list_(pa.int64()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return run


def repeated_strings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, content: bool = True) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), with ``content`` also kept (bytes) and spans (ends of removed runs)."""
    parts = partitions(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(_LEAST)).alias("o"), F.xxhash64(text).alias("v"))
    blobs = "part int, kind int, blob binary"
    seen = keyed.select("o", "v", "text").mapInArrow(_anchored(parts, length, anchor), blobs)
    back = dealt(seen, "part", _met(parts), "home int, blob binary")
    wanted = staged(dealt(back, "home", _by_document, "o long, v long, anchors binary"), "suffix-anchors")
    cut = only_marked(keyed.select("o", "v", "text"), "o", bitmap(wanted, "o")).join(wanted, ["o", "v"])
    runs = cut.select("o", "v", "text", "anchors").mapInArrow(_runs(parts, length), blobs)
    spans = dealt(runs, "part", _merged(parts, length), "home int, blob binary")
    starts = staged(dealt(spans, "home", _spans_by_document, "o long, v long, starts binary"), "suffix-starts")
    flagged = marked(keyed, "o", bitmap(starts, "o"))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if content else [])]
    zero = F.lit(0).cast("long")
    whole = flagged.where("NOT _kl_marked").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"), F.array().cast("array<long>").alias("spans"))
    less = flagged.where("_kl_marked").join(starts, ["o", "v"], "left").select("doc_id", "text", "starts")
    less = less.mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<long>")
    return whole.select(columns).unionByName(less.select(columns))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without strings of 100 bytes that start earlier too."""
    return repeated_strings(documents(spark, sf_dir), content=False)
