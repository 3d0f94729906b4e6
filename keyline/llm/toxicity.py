"""Toxicity: nearest labelled examples by exact TF-IDF cosine, found with block-max inverted indexes.

Terms are words in lower case without marks at their ends; all terms of the examples count. A term's weight in a text is
(1 + log times) * idf * (1 + z * z): z says in standard errors how unequally toxic and other examples have the term, so
the few words that tell outweigh hundreds that don't, and none is left out. Examples lie in blocks, those of like heavy
terms together; for each term and block the index has the postings and the largest weight. A query bounds all blocks,
scores the most promising, and then those whose bound is not below the k-th best; so the nearest, ties included, are
exact. Their votes, weighted by distance and drawn to the sample's share, are the score; the nearest examples themselves
are the evidence. A text that shares no term with any example has the sample's share.

Defined cases: a null or empty text has no terms; a null doc_id is scored and is not held out; labels of null doc_id or
null toxic are ignored, of several labels the highest counts; of several rows of a labelled doc_id the least text is the
example; without usable labels every score is 0; repeated rows are scored alike; labels, lang, source and doc_id are no
inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyline.llm.common import documents, slices

#: Labelled documents that are learned from at most, dealt by a hash of their id. Each is one row of the index.
MOST_EXAMPLES = 5_000
MARKS = ".,;:!?\"'()[]{}#*$%&|<>-_"
NEAREST = 25
BLOCK = 64
#: Blocks that are scored before the others' bounds are looked at.
AHEAD = 4


def term_counts(texts: pa.Array, vocabulary: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Rows (text, term, times) by text, and the terms; with a vocabulary, of its terms and under its numbers."""
    parts = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    coded = parts.flatten().dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), MARKS).cast(pa.large_string())
    if vocabulary is None:
        vocabulary = pc.unique(plain.filter(pc.not_equal(plain, "")))
    code = pc.fill_null(pc.index_in(plain, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    term = code[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    used, width = term >= 0, max(len(vocabulary), 1)
    key, times = np.unique(text[used] * width + term[used], return_counts=True)
    return key // width, key % width, times, vocabulary


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices of the given spans, one span after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


@dataclass
class Index:
    """Weighted examples. An entry is a term's postings in a block; entries are ordered by term, postings by entry."""

    terms: pa.Array
    weight: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    share: float
    entries: np.ndarray
    block: np.ndarray
    largest: np.ndarray
    postings: np.ndarray
    example: np.ndarray
    worth: np.ndarray
    known: dict = field(default_factory=dict)

    @classmethod
    def of(cls, terms: pa.Array, weight: np.ndarray, ids: np.ndarray, toxic: np.ndarray, text: np.ndarray, term: np.ndarray, times: np.ndarray) -> Index:
        """From rows (text, term, times) of the examples, by text."""
        w = (1 + np.log(times)) * weight[term]
        w = w / np.maximum(np.sqrt(np.bincount(text, w * w, len(ids))), 1e-12)[text]
        heavy = np.full((len(ids), 2), -1)  # like examples share a block, so bounds are tight
        order = np.lexsort((-w, text))
        nth = np.arange(len(text)) - np.searchsorted(text, text)
        for k in range(2):
            at = order[nth == k]
            heavy[text[at], k] = term[at]
        place = np.empty(len(ids), np.int64)
        turn = np.lexsort((ids, heavy[:, 1], heavy[:, 0]))
        place[turn] = np.arange(len(ids))
        example = place[text]
        by = np.lexsort((example, term))
        term, example, w = term[by], example[by], w[by]
        block = example // BLOCK
        begin = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))[: len(term)]
        return cls(
            terms, weight, ids[turn], toxic[turn], float(toxic.mean()), np.searchsorted(term[begin], np.arange(len(terms) + 1)), block[begin],
            np.maximum.reduceat(w, begin) if len(begin) else w, np.append(begin, len(term)), example.astype(np.int32), w,
        )

    def vector(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = (1 + np.log(times)) * self.weight[terms]
        return w / max(math.sqrt(float(w @ w)), 1e-12)

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """All examples at least as near as the k-th nearest, with their cosine, nearest first."""
        n = self.entries[terms + 1] - self.entries[terms]
        entry, weight = spans(self.entries[terms], n), np.repeat(q, n)
        block = self.block[entry]
        bounds = np.bincount(block, weight * self.largest[entry], -(-len(self.ids) // BLOCK))
        ahead = np.zeros(len(bounds), bool)
        ahead[np.argpartition(-bounds, min(AHEAD, len(bounds)) - 1)[:AHEAD]] = True
        cosine = np.zeros(len(self.ids))

        def score(blocks: np.ndarray) -> None:
            some = blocks[block]
            e, w = entry[some], weight[some]
            size = self.postings[e + 1] - self.postings[e]
            at = spans(self.postings[e], size)
            cosine[:] += np.bincount(self.example[at], np.repeat(w, size) * self.worth[at], len(cosine))

        def least() -> float:
            return float(np.partition(cosine, len(cosine) - k)[len(cosine) - k]) if len(cosine) >= k else 0.0

        score(ahead)
        score((bounds > 0) & (bounds >= least() - 1e-9) & ~ahead)
        cosine = np.round(cosine, 9)
        at = np.flatnonzero((cosine > 0) & (cosine >= least()))
        at = at[np.lexsort((self.ids[at], -cosine[at]))]
        return at, cosine[at]

    def score(self, terms: np.ndarray, times: np.ndarray) -> tuple[float, list[int]]:
        if not len(terms):
            return self.share, []
        key = hash((terms.tobytes(), times.tobytes()))
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            at, c = self.nearest(terms, self.vector(terms, times))
            w = 1 / (1.05 - np.minimum(c, 1.0))
            self.known[key] = (float(w @ self.toxic[at]) + self.share) / (float(w.sum()) + 1), self.ids[at[:5]].tolist()
        return self.known[key]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        text, term, times, names = term_counts(batch.column("text"))
        cut = pa.array(np.searchsorted(text, np.arange(len(batch) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut, x) for x in (names.take(pa.array(term)).cast(pa.string()), pa.array(times.astype(np.int64)))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *lists], ["doc_id", "toxic", "terms", "times"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def weights(text: np.ndarray, term: np.ndarray, toxic: np.ndarray, n_terms: int) -> np.ndarray:
    """idf * (1 + z * z) of each term, from rows (text, term) of the examples."""
    n, bad = len(toxic), float(toxic.sum())
    has, among = np.bincount(term, minlength=n_terms), np.bincount(term, toxic[text], n_terms)
    pooled = (has + 1) / (n + 2)
    z = ((among + 0.5) / (bad + 1) - (has - among + 0.5) / (n - bad + 1)) / np.sqrt(pooled * (1 - pooled) * (1 / bad + 1 / (n - bad)))
    return np.log((n + 1) / has) * (1 + z * z)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES) -> Index | None:
    """Learns from at most ``most`` labelled documents that are not held out; their ids are broadcast, and one row of terms
    each goes to the driver."""
    some = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    examples = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = examples.mapInArrow(_terms, "doc_id long, toxic long, terms array<string>, times array<long>").toArrow().combine_chunks().sort_by("doc_id")
    ids, toxic = rows["doc_id"].to_numpy(), (rows["toxic"].to_numpy() > 0).astype(float)
    if not 0 < toxic.sum() < len(toxic):
        return None
    coded = pc.list_flatten(rows["terms"]).combine_chunks().dictionary_encode()
    text = np.repeat(np.arange(len(ids)), pc.list_value_length(rows["terms"]).to_numpy())
    term, times = coded.indices.to_numpy().astype(np.int64), pc.list_flatten(rows["times"]).to_numpy()
    return Index.of(coded.dictionary.cast(pa.large_string()), weights(text, term, toxic, len(coded.dictionary)), ids, toxic, text, term, times)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index | None = shared.value
        for batch in slices(batches):
            got = [(0.0, [])] * len(batch)
            if index is not None:
                text, term, times, _ = term_counts(batch.column("text"), index.terms)
                cut = np.searchsorted(text, np.arange(len(batch) + 1)).tolist()
                got = [index.score(term[a:b], times[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, evidence), one for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))  # the terms of MOST_EXAMPLES texts
    out = docs.select("doc_id", "text").mapInArrow(_scored(shared), "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and nearest examples of each document."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
