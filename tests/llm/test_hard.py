"""Exact repeats against brute force, texts longer than a slice, and the pipeline's stages on hard tables."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyline.llm import chaining, near_dedup, pii, suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(3))
def test_exact_repeats_are_covered(spark, seed):
    """Runs of 50 words that an earlier document has lie in the passages found, in a corpus pasted together from a dozen whole
    and half passages. Where the first and the latest document with a run of 36 words lack its end, which a third one has,
    that end is out of reach: no more than one run in a hundred here."""
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(300)]
    some = lambda n: [common[int(300 * rnd.random() ** 2)] for _ in range(n)]
    shared = [some(rnd.randrange(50, 90)) for _ in range(12)]
    rows = []
    for i in range(70):
        words = some(rnd.randrange(5, 80))
        for _ in range(rnd.randrange(0, 4)):
            p = rnd.choice(shared)
            a = rnd.choice((0, 0, len(p) // 2))
            words += p[a : rnd.choice((len(p), len(p), len(p) // 2))] + some(rnd.randrange(1, 60))
        rows.append((i, " ".join(words)))
    spans: dict[int, set[int]] = {}
    for r in chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        assert r["source_id"] < r["doc_id"] and r["identity"] >= 0.8 and r["end_word"] - r["start_word"] >= 50
        spans.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    seen, due, missed = set(), 0, []
    for i, text in rows:
        w = text.split()
        windows = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, window in enumerate(windows):
            if window in seen:
                due += 1
                if not set(range(k, k + 50)) <= spans.get(i, set()):
                    missed.append((i, k, len(set(range(k, k + 50)) & spans.get(i, set()))))
        seen.update(windows)
    assert due > 100 and len(missed) <= 0.01 * due, missed


def test_passages_that_go_on_past_a_stretch(spark):
    """A long passage whose seeds mostly stand elsewhere first is still aligned to its ends."""
    rnd = random.Random(1)
    p = [f"w{rnd.randrange(10**6)}" for _ in range(900)]
    other = lambda k: " ".join(f"x{k}y{i}" for i in range(40))
    rows = [(k, f"{other(k)} {' '.join(p[k * 30 : k * 30 + 34])}") for k in range(30)]  # pieces too short to be passages
    rows += [(100, f"{other(100)} {' '.join(p)}"), (101, f"{other(101)} {' '.join(p)} {other(102)}")]
    got = chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 101").collect()
    assert any(r["source_id"] == 100 and (r["start_word"], r["end_word"]) == (40, 940) for r in got)
    assert not [r for r in got if r["end_word"] - r["start_word"] < 890]


def test_texts_longer_than_a_slice(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400_000)]
    long = " ".join(words)
    assert len(long) > 2 << 20
    near = " ".join("other" if i % 100 == 50 else w for i, w in enumerate(words))
    rows = [(0, "short text"), (1, long), (2, near), (3, " ".join(words[200_000:200_120])), (4, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 3, (85, 100), 6).collect()}
    assert kept == {0: 0, 1: 1, 2: 1, 3: 3, 4: 0}
    found = [(r["doc_id"], r["source_id"], r["start_word"], r["end_word"], r["source_start"]) for r in chaining.shared_passages(docs.where("doc_id <> 2")).collect()]
    assert found == [(3, 1, 0, 120, 200_000)]
    cut = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.repeated_strings(docs.where("doc_id <> 2")).collect()}
    assert cut[3][0] == len(rows[3][1]) and cut[1] == (0, hashlib.sha256(long.encode()).hexdigest())


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_hard_tables(spark, docs, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert run(spark, docs.select(*columns).where("false"), SF).count() == 0
    out = run(spark, docs, SF)
    if stage != "packing":
        assert out.columns == docs.columns
    assert out.count() > 0


def test_pseudonyms_against_plain(spark, docs):
    """The query's rows are those of the function on each text, whatever the batches."""
    want = Counter((r["doc_id"], pii.pseudonymised(r["text"])[0] if r["text"] is not None else None) for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["text"]) for r in pii.pseudonyms(docs).collect()) == want


def test_near_dedup_stage_against_brute_force(spark):
    """Of the rows of sf0.001 and some repeated ones, exactly the brute-force groups' least rows stay."""
    from tests.llm.test_operators import shingles

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.limit(20).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    every = docs.unionByName(docs.limit(20)).unionByName(more)
    rows = every.select("doc_id", "text").collect()
    sets = [shingles(r["text"], 5) for r in rows]
    union = near_dedup.Union(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                union.join(i, j)
    groups: dict[int, list] = {}
    for i, r in enumerate(rows):
        if sets[i]:
            groups.setdefault(union.find(i), []).append(r)
    kept = corpus_pipeline.near_dedup(spark, every, SF).select("doc_id", "text").collect()
    bare = [r for i, r in enumerate(rows) if not sets[i]]
    assert len(kept) == len(groups) + len(bare)
    left = Counter((r["doc_id"], r["text"]) for r in kept)
    for group in groups.values():
        least = min((r["doc_id"] is None, r["doc_id"] or 0) for r in group)
        assert sum(left[k] for k in {(r["doc_id"], r["text"]) for r in group if (r["doc_id"] is None, r["doc_id"] or 0) == least}) == 1
