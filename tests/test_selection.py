"""Small sequences with known results, and edges: none, one, equal and NaN scores."""

import math
import random

import pytest

from keyline.operators import selection as S
from keyline.sources import sequences as Q
from keyline.streaming.top_frames import running_top

SCHEMA = "video_id long, pos int, frame_id long, score double"


def frame(spark, *videos):
    return spark.createDataFrame([(v, p, p * 30, float(s)) for v, scores in enumerate(videos) for p, s in enumerate(scores)], SCHEMA)


def places(df):
    return [r["frame_id"] // 30 for r in df.orderBy("frame_id").collect()]


def test_seeds(spark):
    scores = [0.2, 0.3, 0.9, 0.8, 0.4, 0.1, 0.85, 0.7]
    assert places(S.seeds(frame(spark, scores), window=2, least=0.3)) == [2, 6]


def test_ripple_reaches_all(spark):
    assert places(S.ripples(frame(spark, [0.2, 0.3, 0.9, 0.8, 0.4, 0.15]), m=5)) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("m", [1, 3, 8])
def test_no_rows(spark, m):
    empty = frame(spark)
    for f in (S.top_k, S.halved, S.hard_suppressed, S.soft_suppressed, S.exactly, S.ripples, S.evenly, S.random_frames):
        assert f(empty, m).count() == 0


def test_equal_scores(spark):
    same = frame(spark, [1.0] * 6)
    assert places(S.top_k(same, 3)) == [0, 1, 2]
    assert {r["s"] for r in S.normalised(same).collect()} == {0.5}
    assert all(math.isnan(r["s"]) for r in S.normalised(same, constant=None).collect())
    assert places(S.spaced(same, m=2, gap=2.0)) == [3, 5]


def test_scrubbed(spark):
    rows = S.normalised(frame(spark, [float("nan"), 1.0, float("inf"), 0.5]), constant=0.0, eps=1e-12).orderBy("pos").collect()
    assert [r["s"] for r in rows] == [0.0, 1.0, 1.0, 0.5]


def test_strict_allocation_may_be_empty(spark):
    assert S.halved(frame(spark, [i % 2 for i in range(64)]), 16, t1=0.9).count() == 0
    assert S.halved(frame(spark, [i % 2 for i in range(64)]), 16, floor=1, t1=0.9).count() == 32


def test_greedy_against_plain(spark):
    rnd = random.Random(3)
    videos = [[round(rnd.random(), 3) for _ in range(n)] for n in (1, 2, 17, 40)]
    got = S.hard_suppressed(frame(spark, *videos), m=6, radius=2).collect()
    for v, scores in enumerate(videos):
        low, high = min(scores), max(scores)
        d = [(x - low) / (high - low) if high > low else 0.5 for x in scores]
        w = [1 / (abs(a - b) + 1e-6) for a, b in zip(d, d[1:], strict=False)]
        for _ in range(max(1, int(math.log2(len(d))))):
            if len(d) == 1:
                break
            d = [0.75 * x + 0.25 * (d[1] if i == 0 else d[i - 1] if i == len(d) - 1 else (w[i - 1] * d[i - 1] + w[i] * d[i + 1]) / (w[i - 1] + w[i])) for i, x in enumerate(d)]
        taken = []
        for i in sorted(range(len(d)), key=lambda i: (-round(d[i], 12), i)):
            if len(taken) < 6 and all(abs(i - j) > 2 for j in taken):
                taken.append(i)
        assert sorted(r["pos"] for r in got if r["video_id"] == v) == (list(range(len(d))) if len(d) <= 6 else sorted(taken))


def test_soft_repeats_or_masks(spark):
    rows = frame(spark, [0.1, 0.9, 0.8, 0.3, 0.5, 0.7, 0.2])
    assert len(set(places(S.soft_suppressed(rows, 4)))) == 1
    assert len(set(places(S.soft_suppressed(rows, 4, mask_selected=True)))) == 4


def test_quota_and_exact_sizes(spark):
    rnd = random.Random(5)
    rows = frame(spark, *([rnd.random() for _ in range(50)] for _ in range(3)))
    for scope in ("first", "per_video"):
        assert S.dual_quota(rows, 9, theta_scope=scope).count() == 27
    assert S.exactly(rows, 9).count() == 27


def test_readers(spark, tmp_path):
    (tmp_path / "s.json").write_text("[[0.5, 0.25], [1.0]]")
    (tmp_path / "f.json").write_text("[[0, 30, 60], [0]]")
    rows = Q.read_scored(spark, str(tmp_path / "s.json"), str(tmp_path / "f.json")).orderBy("video_id", "pos").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, 0.5), (0, 1, 30, 0.25), (1, 0, 0, 1.0)]
    (tmp_path / "a.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\none\n\n2\n00:00:01,500 --> 00:00:02,000\ntwo\n\nshort\n")
    assert [(r["start_s"], r["end_s"], r["text"]) for r in Q.read_srt(spark, str(tmp_path / "a.srt")).collect()] == [(1.5, 2.0, "two")]
    (tmp_path / "b.json").write_text('[{"timestamp": [1.0, 2.5], "text": "x"}, {"start": "00:00:03", "end": "00:01:00.5", "line": "y"}]')
    got = sorted((r["start_s"], r["end_s"], r["text"]) for r in Q.read_subtitle_json(spark, str(tmp_path / "b.json")).collect())
    assert got == [(1.0, 2.5, "x"), (3.0, 60.5, "y")]
    frames = Q.sampled_frames(spark.createDataFrame([(0, 95, 29.97)], "video_id long, n_frames long, fps double"))
    assert [r["frame_id"] for r in frames.orderBy("pos").collect()] == [0, 29, 58]


def test_running_top(spark, tmp_path):
    frame(spark, [0.1, 0.9, 0.8, 0.3]).write.parquet(str(tmp_path / "in"))
    stream = running_top(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 2, radius=1)
    q = stream.writeStream.outputMode("update").format("memory").queryName("best").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["pos"] for r in spark.table("best").collect()} == {1, 3}
