"""Best-fit packing by minimum bin slack: per bin, bitset subset-sum programming finds the fullest feasible filling.

The fill of a bin depends only on which lengths are left, so the bins are planned on the histogram of lengths: at most
``size`` rows, whatever the input. A filling that is found is taken as often as its lengths last, which is what filling
one bin after another would do, and uses up a length; so there are at most as many programs as lengths.

Defined cases: a null or empty text is one piece that holds only the closing id; repeated rows are packed each; a null
doc_id is packed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyline.llm.common import documents, slices, staged

SIZE = 2048
END_ID = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- ids, word by word ---------------------------------------------------------------------------

#: White space other than single blanks and line ends between words; such texts are encoded in one piece.
_IRREGULAR = "(^|[ \\n])([ \\n]|$)|[\\t\\r\\f\\v\\x01\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _fast(path: str):
    """The same byte-level vocabulary and merges under a faster encoder, where the file is of that kind; else None."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    if held["model"].get("type") != "BPE" or (held.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or held["pre_tokenizer"].get("add_prefix_space") or held.get("normalizer"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"] for x in held.get("added_tokens", [])}
    ranks = {bytes(shown[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("held", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sorted(special)


def _encode_each(texts: list[str], path: str) -> list[np.ndarray]:
    return [np.array(x.ids, np.uint32) for x in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def _encode_words(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of distinct words ``texts``, and the n + 1 bounds of each word's. A word keeps its mark: see encode()."""
    fast, special = _fast(path)
    kept = texts.to_pylist()
    ids, sizes = [], np.zeros(len(kept), np.int64)
    plain = [i for i, w in enumerate(kept) if w[:1] not in ("\n", "\x01")]
    at = {"plain": plain, "other": [i for i, w in enumerate(kept) if w[:1] in ("\n", "\x01")]}
    (newline,) = fast.encode_ordinary("\n")
    order = []
    for lo in range(0, len(plain), 20_000):
        part = plain[lo : lo + 20_000]
        got = fast.encode_to_numpy("".join(f" {kept[i]}\n" for i in part)).astype(np.uint32)
        ends = np.flatnonzero(got == newline)
        sizes[part] = np.diff(ends, prepend=-1) - 1
        ids.append(got[got != newline])
        order += part
    for i in at["other"]:
        got = fast.encode_ordinary(kept[i][1:] if kept[i][0] == "\x01" else kept[i])
        sizes[i] = len(got)
        ids.append(np.array(got, np.uint32))
        order.append(i)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    order = np.array(order, np.int64)
    starts = np.zeros(len(kept), np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    return flat, starts, sizes


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by END_ID, and their n + 1 bounds: what the tokenizer of ``path`` gives for whole texts.

    A text whose words stand one blank or line end apart is the join of its words' ids, so that each distinct word of a
    batch is encoded once. Any other text goes to the tokenizer whole, and so does one that holds a special token's string.
    """
    n, texts = len(texts), texts.fill_null("").cast(pa.large_string())
    odd = np.ones(n, bool)
    if (fast := _fast(path)) is not None:
        odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
        for s in fast[1]:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    counts = np.zeros(n, np.int64)
    even = pa.array(np.flatnonzero(~odd))
    flat, starts, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    which, first = np.zeros(0, np.int64), np.zeros(1, np.int64)
    if len(even):
        marked = pc.binary_join_element_wise(pa.scalar("\x01", pa.large_string()), pc.replace_substring(texts.take(even), "\n", " \n"), pa.scalar("", pa.large_string()))
        parts = pc.split_pattern(marked, " ")
        coded = parts.flatten().dictionary_encode()
        flat, starts, sizes = _encode_words(coded.dictionary, path)
        which = coded.indices.to_numpy()
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
        per_word = sizes[which]
        total = np.concatenate([[0], np.cumsum(per_word)])
        counts[~odd] = total[first[1:]] - total[first[:-1]]
    whole = dict(zip(np.flatnonzero(odd).tolist(), _encode_each(texts.filter(pa.array(odd)).to_pylist(), path), strict=True)) if odd.any() else {}
    for i, x in whole.items():
        counts[i] = len(x)
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(bounds[-1], END_ID, np.uint32)
    places = even.to_numpy()
    for lo in range(0, len(places), 512):
        rows = places[lo : lo + 512]
        a, b = first[lo], first[lo + len(rows)]
        length = sizes[which[a:b]]
        local = np.cumsum(length) - length
        span = int(length.sum())
        got = flat[np.repeat(starts[which[a:b]] - local, length) + np.arange(span)]
        at = 0
        for i in rows.tolist():
            out[bounds[i] : bounds[i + 1] - 1] = got[at : at + counts[i]]
            at += counts[i]
    for i, x in whole.items():
        out[bounds[i] : bounds[i + 1] - 1] = x
    return out, bounds


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in slices(batches, most=6 << 20):
            ids, bounds = encode(batch.column("text"), path)
            total = np.diff(bounds)
            n = np.maximum(1, -(-total // size))
            doc = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            head = total - (n - 1) * size
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * size)
            length = np.where(piece == 0, head[doc], size)
            from_, data = bounds[doc] + start, memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(data[a * 4 : b * 4]) for a, b in zip(from_.tolist(), (from_ + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            place = np.arange(len(order)) - np.searchsorted(ordered, ordered)
            nth = np.empty(len(order), np.int64)
            nth[order] = place + seen[ordered]
            seen += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


# ---- the bins ------------------------------------------------------------------------------------


def fullest(available: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """Of (length, count), longest first, the multiset of the largest sum up to ``capacity``; longer lengths come first.

    One integer is the set of reachable sums; ``length`` copies enter by doubling, and a full sum ends the search.
    """
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    full = 1 << capacity
    for length, count in available:
        if length > capacity:
            continue
        copies, chunk = min(count, capacity // length), 1
        while copies > 0 and not reach & full:
            chunk = min(chunk, copies)
            after = (reach | reach << chunk * length) & mask
            if after != reach:
                steps.append((length, chunk, reach))
                reach = after
            copies -= chunk
            chunk *= 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for length, chunk, before in reversed(steps):
        if not before >> at & 1:
            at -= chunk * length
            used[length] = used.get(length, 0) + chunk
    return used


def fillings(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) until no piece is left: each bin starts with the longest one, and its slack is made least."""
    left, out = {k: v for k, v in histogram.items() if v > 0}, []
    lengths = sorted(left, reverse=True)
    while lengths:
        longest = lengths[0]
        rest = [(k, left[k] - (k == longest)) for k in lengths]
        fill = fullest([x for x in rest if x[1]], size - longest)
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[k] // n for k, n in fill.items())
        out.append((times, fill))
        for k, n in fill.items():
            left[k] -= n * times
        if any(not left[k] for k in fill):
            lengths = [k for k in lengths if left[k]]
    return out


def _places(plan: list[tuple[int, dict[int, int]]], size: int) -> dict[int, tuple]:
    """By length: first rank, first bin, copies a bin and offset of each filling that holds it."""
    by: dict[int, list] = {}
    rank, bin_ = {}, 0
    for times, fill in plan:
        offset = 0
        for length in sorted(fill, reverse=True):
            by.setdefault(length, []).append((rank.get(length, 0), bin_, fill[length], offset))
            rank[length] = rank.get(length, 0) + times * fill[length]
            offset += length * fill[length]
        bin_ += times
    return {k: tuple(np.array(v, np.int64).T) for k, v in by.items()}


def _place(by: dict[int, tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            where, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, bin_, copies, start = by[int(k)]
                f = np.searchsorted(first, rank[at], "right") - 1
                i = rank[at] - first[f]
                where[at], offset[at] = bin_[f] + i // copies[f], start[f] + i % copies[f] * k
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(where), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence and place; see the module for the method."""
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()
    pieces = staged(docs.select("doc_id", "text").mapInArrow(_pieces(path, size), PIECES), "packing-pieces")
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    by = _places(fillings(histogram, size), size)
    earlier = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("earlier"))
    ranked = pieces.join(earlier, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place(by), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids; cases as in the module."""
    return pack(documents(spark, sf_dir))
