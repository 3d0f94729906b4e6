"""Steps of the recursion on small cases: nothing, one frame, halves to even, ties, frames that can't be read."""

from keyline.operators import quotas as P

SEQ = "video_id long, pos int, frame_id long, score double"


def made(spark, *videos):
    return spark.createDataFrame([(v, i, i * 30, float(s)) for v, scores in enumerate(videos) for i, s in enumerate(scores)], SEQ)


def test_stops(spark):
    rows = {r["video_id"]: r["stops"] for r in P.stopped(made(spark, [1], [1, 1, 1, 1], [0, 0, 0, 9], [1, 2, 3, 4]), 2).collect()}
    assert rows == {0: True, 1: False, 2: False, 3: False}
    assert all(r["stops"] for r in P.stopped(made(spark, [1, 2, 3]), 1).collect())
    assert P.stopped(made(spark), 2).collect() == []


def test_left_takes_the_odd_frame(spark):
    left = [(r["pos"], r["left"]) for r in P.sided(made(spark, [1, 2, 3])).orderBy("pos").collect()]
    assert left == [(0, True), (1, True), (2, False)]


def test_budget_goes_to_even_halves(spark):
    got = {r["video_id"]: (r["m_left"], r["m_right"]) for r in P.shared_budget(made(spark, [1, 1], [5], [0, 1]), 5).collect()}
    assert got == {0: (2, 3), 1: (5, 0), 2: (0, 5)}


def test_refill(spark):
    seq = made(spark, range(10), range(3)).select("video_id", "frame_id")
    taken = spark.createDataFrame([(0, 0), (0, 30)], "video_id long, frame_id long")
    got = sorted((r["video_id"], r["frame_id"]) for r in P.refilled(seq, taken, 5).collect())
    assert got == [(0, 60), (0, 120), (0, 210), (1, 0), (1, 30), (1, 60)]
    assert P.refilled(seq, taken, 2).where("video_id = 0").count() == 0
    long = made(spark, range(62)).select("video_id", "frame_id")
    none = taken.where("false")
    assert sorted(r["frame_id"] // 30 for r in P.refilled(long, none, 8).collect()) == [0, 7, 15, 23, 31, 38, 46, 54]


def test_folder_images(spark):
    files = spark.createDataFrame([("a", f"{i:02d}", i != 2) for i in range(5)] + [("b", "x", True)], "folder string, path string, readable boolean")
    got = sorted((r["folder"], r["nth"], r["path"]) for r in P.folder_images(files, 3).collect())
    assert got == [("a", 0, "00"), ("a", 2, "04"), ("b", 0, "x"), ("b", 1, "x"), ("b", 2, "x")]
