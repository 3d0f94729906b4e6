"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Texts with equal shingle sets are one node. Nodes that share a band are linked to the least of them, which makes stars:
any two nodes that share a band are in one star. The nodes of a star are compared in full, large stars in blocks of bounded
size; neither pairs nor copies are ever listed. In a block only nodes that are not yet linked are compared. Blocks of one
star share a few of its nodes, which link most of the rest; what those leave apart is then compared with all blocks. Bands
are as many as make a miss at the threshold itself rarer than ``miss``.

Defined cases: a null or empty text, or one of white space only, has an empty set and is linked with nothing; repeated rows
are one node and each gives a row; rows of a null doc_id are linked like others, and component_id is the smallest doc_id
that is not null, null if there is none; rows of one doc_id with unequal texts are documents of their own; extra columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyline.llm.common import bitmap, connected_components, documents, mix, only_marked, shingle_sets, slices, staged, unstaged

#: Nodes of one star, and shingles of theirs, that make a block; of so many nodes about, each block of a star has the same.
BLOCK, BLOCK_SHINGLES, PILOTS = 256, 1 << 21, 8
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, rows: int, miss: float = 1e-6) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures of m values for each set, all sets at once.

    In round j each element draws a rank in [j, j + 1) and gives it to slot p[j] of its own random permutation, which is
    dealt out as the rounds go (Fisher-Yates). A set is done, and its elements leave, once no slot of it can still fall:
    when its largest value is below j. Ranks are 48-bit fractions under the round's number.
    """
    n = len(sets)
    out = np.full((n, m), _FAR)
    element = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat, p = out.reshape(-1), None
    for j in range(m):
        if not len(element):
            break
        draw = mix(element + np.array([j + 1], np.uint64) * _STEP)
        value = (np.uint64(j) << np.uint64(48)) | (draw >> np.uint64(16))
        k = (j + ((mix(draw ^ _STEP) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)) if j < m - 1 else np.full(len(element), j)
        if j == 0:
            slot, swapped = k, k
        else:
            rows = np.arange(len(element))
            slot = p[rows, k].astype(np.int64)
            p[rows, k] = p[:, j]
        np.minimum.at(flat, owner * m + slot, value)
        stays = (out.max(axis=1) >= (np.uint64(j + 1) << np.uint64(48)))[owner]
        if j == 0:
            swapped = swapped[stays]
            p = np.tile(np.arange(m, dtype=np.uint16), (len(swapped), 1))
            p[np.arange(len(swapped)), swapped] = 0
        elif not stays.all():
            p = p[stays]
        if not stays.all():
            element, owner = element[stays], owner[stays]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.tile(np.arange(bands, dtype=np.uint64) * _STEP, (len(signatures), 1))
    parts = signatures.reshape(len(signatures), bands, rows)
    for r in range(rows):
        key = mix(key ^ parts[:, :, r]) + _STEP
    return mix(key)


def fingerprint(s: np.ndarray) -> int:
    whole = np.array([np.bitwise_xor.reduce(mix(s)), np.add.reduce(mix(s ^ _STEP))], np.uint64)
    return int(mix(whole[:1] + np.array([len(s)], np.uint64) * _STEP + whole[1:])[0].astype(np.int64))


def _signed(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            sets = shingle_sets(batch.column("text"), k)
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = band_keys(superminhash(sets, bands * rows), bands, rows).astype(np.int64)
            prints = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64())
            filled = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(sizes), prints, filled], ["doc_id", "h", "n_shingles", "print", "bands"])

    return run


def _sets(k: int):
    """Each document's set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            some = [i for i, r in enumerate(batch.column("row").to_pylist()) if r not in seen and not seen.add(r)]
            batch = batch.take(pa.array(some, pa.int64()))
            sets = shingle_sets(batch.column("text"), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(full, pa.int64())), pa.array([sets[i].tobytes() for i in full], pa.binary())], ["row", "members"])

    return run


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def linked(sets: list[np.ndarray], share: tuple[int, int], known: np.ndarray | None = None) -> Union:
    """Joins sets with share[1] * intersection >= share[0] * union, counted in full; ``known`` are classes to begin with.

    One set after the other is met with all others, by the lists of who has each element. It need not be met with its own
    class, so next comes always one outside the class with the most sets still to meet, until those all are of one class.
    """
    need, of = share
    found, sizes = Union(len(sets)), np.array([len(s) for s in sets], np.int64)
    label = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1].reshape(-1)
    _, first = np.unique(label, return_index=True)
    for i in range(len(sets)):
        found.join(i, int(first[label[i]]))
    if len(sets) < 2:
        return found
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if of * both >= need * (sizes.sum() - both):
            found.join(0, 1)
        return found
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(element, return_inverse=True, return_counts=True)
    shared = times[code] > 1  # elements of one set alone need no list
    code, owner = code[shared], owner[shared]
    cut = np.searchsorted(owner, np.arange(len(sets) + 1))
    by = owner[np.argsort(code, kind="stable")]
    begin = np.cumsum(np.where(times > 1, times, 0)) - times
    open_ = np.ones(len(sets), bool)
    while True:
        left = np.flatnonzero(open_)
        most = int(np.bincount(label[left]).argmax()) if len(left) else -1
        others = left[label[left] != most]
        if not len(others):
            return found
        i = int(others[0])
        open_[i] = False
        own = code[cut[i] : cut[i + 1]]
        n = times[own]
        at = np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(by[at], minlength=len(sets))
        for j in np.flatnonzero((of * both >= need * (sizes[i] + sizes - both)) & (label != label[i])).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.join(i, j)


def _grouped(share: tuple[int, int]):
    """Links of the nodes of a block, one for each node that is linked; those that are links already are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("print").sort_values("print", ignore_index=True)
        prints, known = pdf["print"].to_numpy(), pdf["class"].to_numpy()
        found = linked([np.frombuffer(b, np.uint64) for b in pdf["members"]], share, known)
        root = np.array([found.find(i) for i in range(len(prints))])
        other = known[root] != known
        return pd.DataFrame({"u": prints[other], "v": prints[root[other]]})

    return run


def _row(doc_id: str = "doc_id", h: str = "h") -> Column:
    return F.xxhash64(F.col(doc_id).isNull(), doc_id, h)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))


def _outside(members: DataFrame, several: DataFrame, links: DataFrame, placed, grouped) -> DataFrame:
    """Links of stars of several blocks that the blocks themselves could not show: each node outside the largest class of
    its star meets all nodes of the star."""
    classes = connected_components(links, "near-classes")
    large = members.join(several, "low").join(classes, F.col("print") == F.col("node"), "left").select("low", "print", "row", "n", F.coalesce("root", "print").alias("class"))
    large = staged(large, "near-large")
    counts = large.groupBy("low", "class").agg(F.count(F.lit(1)).alias("c"))
    main = staged(counts.groupBy("low").agg(F.max_by("class", F.struct("c", "class")).alias("main"), F.sum("c").alias("c"), F.max("c").alias("most")).where("c > most").withColumn("outer", F.ceil((F.col("c") - F.col("most")) / BLOCK).cast("int")).drop("c", "most"), "near-main")
    sides = large.join(main, "low").withColumn("out", F.col("class") != F.col("main"))
    block, part = F.pmod(F.xxhash64("print"), F.col("n")).cast("int"), F.pmod(F.xxhash64("print", F.lit(1)), F.col("outer")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    grid = F.transform(every("outer"), lambda j: F.struct(block.alias("a"), j.alias("b")))
    met = F.when(F.col("out"), F.array_union(grid, F.transform(every("n"), lambda i: F.struct(i.alias("a"), part.alias("b"))))).otherwise(grid)
    return grouped(placed(sides.select("low", "print", "row", "class", F.explode(met).alias("g")).select("low", "print", "row", "class", "g.a", "g.b")), "low", "a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, share: tuple[int, int] = (80, 100), rows: int = 5) -> DataFrame:
    """Rows (doc_id, h, n_shingles, component_id, kept), one for each row: documents linked from ``share`` = (a, b) with
    b * both >= a * either on. ``h`` is a hash of the text; the kept rows of a component are of one doc_id and h."""
    keyed = _keyed(docs)
    bands = bands_for(share[0] / share[1], rows)
    signed = staged(keyed.mapInArrow(_signed(shingle, bands, rows), "doc_id long, h long, n_shingles long, print long, bands array<long>"), "near-signed")
    some = signed.where("print IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    nodes = staged(some.groupBy("print").agg(first, F.min("n_shingles").alias("n_shingles")), "near-nodes")
    banded = some.select("print", F.explode("bands").alias("key"))
    several = staged(banded.groupBy("key").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low <> high").select("key", "low"), "near-bands")
    stars = staged(only_marked(banded, "key", bitmap(several, "key")).join(several, "key").where("print <> low").select("low", "print").distinct(), "near-stars")
    unstaged(several)
    spokes = stars.unionByName(stars.select("low", F.col("low").alias("print")).distinct())
    members = staged(spokes.join(nodes, "print").select("low", "print", _row("first.doc_id", "first.h").alias("row"), "n_shingles"), "near-members")
    enough = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    large = staged(members.groupBy("low").agg(enough.alias("n"), F.count(F.lit(1)).alias("c")).where("n > 1"), "near-large")
    texts = keyed.select(_row().alias("row"), "text")
    marks = bitmap(members, "row")
    sets = staged(only_marked(texts, "row", marks).mapInArrow(_sets(shingle), "row long, members binary"), "near-sets")
    placed = lambda met: met.join(sets, "row").drop("row")
    grouped = lambda met, *by: met.groupBy(*by).applyInPandas(_grouped(share), "u long, v long")
    pilot = (F.col("print") == F.col("low")) | (F.pmod(F.xxhash64("print", F.lit(2)), F.ceil(F.col("c") / PILOTS)) == 0)
    blocks = F.when(F.col("n").isNull(), F.array(F.lit(0))).when(pilot, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(F.pmod(F.xxhash64("print"), F.col("n")).cast("int")))
    met = members.join(large, "low", "left").select("low", "print", "row", F.col("print").alias("class"), F.explode(blocks).alias("a"))
    links = staged(grouped(placed(met), "low", "a"), "near-links")
    if large.take(1):
        links = links.unionByName(staged(_outside(members, large.select("low", "n"), links, placed, grouped), "near-links"))
    groups = connected_components(links, "near-groups")
    named = nodes.join(groups, nodes["print"] == groups["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = staged(named.groupBy("root").agg(F.min("first").alias("least")), "near-least")
    named = staged(named.join(least, "root").select("print", "least"), "near-named")
    out = signed.select("doc_id", "h", "n_shingles", "print").join(named, "print", "left")
    kept = F.col("print").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("h") == F.col("least.h")))
    return out.select("doc_id", "h", "n_shingles", F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component; rows whose set is empty all stay. Of equal (doc_id, text), any one row."""
    kept = near_duplicates(docs, **options).where("kept").groupBy(F.col("doc_id").alias("_kl_id"), F.col("h").alias("_kl_h")).agg((F.first(F.col("n_shingles") > 0) & (F.count(F.lit(1)) > 1)).alias("_kl_twins"))
    kept = staged(kept, "near-kept")
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    met = docs.withColumn("_kl_h0", h).join(kept, F.col("doc_id").eqNullSafe(F.col("_kl_id")) & (F.col("_kl_h0") == F.col("_kl_h")))
    single = met.where("NOT _kl_twins").select(*docs.columns)
    if not kept.where("_kl_twins").take(1):
        return single
    return single.unionByName(met.where("_kl_twins").dropDuplicates(["doc_id", "_kl_h"]).select(*docs.columns))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from 85 in 100 on shared three-word shingles; kept says whether the row's doc_id is its component's."""
    out = near_duplicates(documents(spark, sf_dir), shingle=3, share=(85, 100), rows=6)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
