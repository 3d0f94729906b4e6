"""Shared pieces: staging in the cluster's folder, vectorised words and hashes, bounded bitmaps, components."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the Bloom bitmap that keeps texts which cannot matter out of a shuffle; its size never follows the data.
BITMAP_BITS = 1 << 23
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_staged: dict[str, SparkSession] = {}
_own: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where it names none, a temporary one if all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='keyline-')}"
    return _own[context.applicationId]


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and every executor can reread it. So the
    shuffle files behind it go as soon as it is written. Who reads rows with one value of ``by`` reads no others."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"keyline-{name}-{uuid.uuid4().hex}")
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    if not _staged:
        atexit.register(_clean)
    _staged[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out._kl_path = path
    return out


def unstaged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        _delete(_staged.pop(df._kl_path), df._kl_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for path, spark in _staged.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the cluster's own clean-up of the folder remains
            return


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# ---- words and hashes, over whole Arrow batches -------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of texts that are hashed at a time.
AT_ONCE = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def released() -> None:
    """Give free memory back to the system: a Python worker stays for the next stage, and should not hold this one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``most`` bytes of text each; a longer text stands alone."""
    released()
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(column).fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(size):
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    released()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of texts in them; a null text is empty."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    up, down = _powers[0][:n], _powers[1][:n]
    if n < 1 << 22 < len(_powers[0]):  # one very long text is no reason to hold its tables for ever
        _powers[0], _powers[1] = up.copy(), down.copy()
    return up, down


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums, and the factors which make spans of them comparable."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the index of each text's first word (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, ~solid[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, ~solid[1:]
    starts = np.flatnonzero(solid & (before | cut[:-1]))
    ends = np.flatnonzero(solid & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the index of each text's first word (n + 1)."""
    data, offsets = raw(texts)
    hashes, firsts, at = [], [np.zeros(1, np.int64)], 0
    while at < len(texts):  # about AT_ONCE bytes at a time, whose arrays stay in the processor's caches
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1)
        some = data[offsets[at] : offsets[to]]
        starts, ends, first = words(some, offsets[at : to + 1] - offsets[at])
        sums, down = prefix(_LOWER[some] if lower else some)
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        firsts.append(first[1:] + firsts[-1][-1])
        at = to
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate(firsts)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive words; runs across two texts are the caller's to skip."""
    n = max(0, len(hashes) - k + 1)
    base, whole = 0xD6E8FEB86659FD93, (1 << 64) - 1
    # sums of hashes times descending powers of the base, of runs that double; those of the bits of k are put end to end
    out, run, length, done = np.full(n, np.uint64(k)), hashes, 1, 0
    while done < k:
        if k & length:
            out = out * np.uint64(pow(base, length, 1 << 64) & whole) + run[done : done + n]
            done += length
        if done < k:
            run = run[: len(run) - length] * np.uint64(pow(base, length, 1 << 64) & whole) + run[length:] if len(run) > length else run[:0]
            length *= 2
    return mix(out)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; of a shorter text its whole sequence as one."""
    hashes, first = word_hashes(texts)
    runs, out = windows(hashes, k), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(windows(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def least(key: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive keys (uint64), by running minima of blocks from both ends."""
    n = len(key)
    rows = -(-n // w) + 1
    table = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    table[:n] = key
    table = table.reshape(rows, w)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = max(0, n - w + 1)
    return np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])


# ---- bounded bitmaps -----------------------------------------------------------------------------


def _bits(key):
    h = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS)).cast("long")
    return (h / 64).cast("long"), h % 64


def bitmap(df: DataFrame, key: str) -> DataFrame:
    """At most BITMAP_BITS / 64 rows (word, bits) that hold a one for each key's hash, built by partial sums."""
    word, bit = _bits(F.col(key))
    return df.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))


def marked(df: DataFrame, key: str, marks: DataFrame) -> DataFrame:
    """``df`` and a boolean _kl_marked: false only if the key is surely not among those of ``marks``. The map is bounded."""
    word, bit = _bits(F.col(key))
    met = df.withColumns({"_kl_w": word, "_kl_bit": bit.cast("int")}).join(F.broadcast(marks.select(F.col("w").alias("_kl_w"), F.col("b").alias("_kl_b"))), "_kl_w", "left")
    return met.withColumn("_kl_marked", F.expr("shiftrightunsigned(coalesce(_kl_b, 0L), _kl_bit) & 1L") == 1).drop("_kl_w", "_kl_bit", "_kl_b")


def only_marked(df: DataFrame, key: str, marks: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among those of ``marks``; no such row is lost."""
    return marked(df, key, marks).where("_kl_marked").drop("_kl_marked")


# ---- packed arrays: what goes through an exchange in one value -----------------------------------


def put(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def get(blob: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    lengths, at, out = np.frombuffer(blob, np.int64, n, 8).tolist(), 8 + 8 * n, []
    for length, kind in zip(lengths, kinds, strict=True):
        out.append(np.frombuffer(blob, kind, length, at))
        at += length * np.dtype(kind).itemsize
    return out


def stacked(blobs, *kinds) -> list[np.ndarray]:
    """The arrays of several values, each kind end to end."""
    got = [get(b, *kinds) for b in blobs]
    return [np.concatenate([g[i] for g in got]) if got else np.zeros(0, k) for i, k in enumerate(kinds)]


def dealt(df: DataFrame, key: str, fn, schema: str) -> DataFrame:
    """``fn`` on all rows of each partition as one frame, which returns one frame or several one by one, rows dealt by ``key`` in 0..partitions - 1; so what a task sends
    on are as many values as there are partitions at most, like the blocks of any exchange."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            made = pd.concat(held, ignore_index=True)
            del held
            out = fn(made)
            yield from (out,) if isinstance(out, pd.DataFrame) else out
            del made, out
        released()

    return df.repartitionById(partitions(df.sparkSession), F.col(key)).mapInPandas(run, schema)


def split_by(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices in order) of each part that occurs."""
    if not len(part):
        return
    order = np.argsort(part.astype(np.uint16) if int(part.max()) < 1 << 16 else part, kind="stable")  # short ones by radix
    ordered = part[order]
    at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)], strict=True):
        yield int(ordered[a]), order[a:b]


# ---- connected components ------------------------------------------------------------------------


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """Rows (node, root) of every node of ``edges`` (u, v): alternating large and small stars until all are stars.

    Nothing is collected but whether a node is left that is neither a root nor a leaf of one root. What is joined to a
    node's rows is written before, so both sides are plain exchanges and Spark splits the rows of a node with very many
    links; aggregates have partial sums.
    """
    e = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("h")), name)
        if not low.where("m < u AND m < h").take(1):
            break
        large = staged(both.join(low.select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        unstaged(e, low, large, least)
        e = new
    return low.select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
