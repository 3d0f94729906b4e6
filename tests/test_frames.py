"""Loaders, geometry and request texts on known values and edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from keyline.functions import frames as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("duration", "want"), [(32.0, [2.0 * i for i in range(16)]), (3.9, [0.0, 1.0, 2.0]), (0.5, []), (16.0, [float(i) for i in range(16)])])
def test_timestamps(spark, duration, want):
    assert one(spark, V.frame_timestamps(F.lit(duration))) == want


def test_stepped_or_even(spark):
    at = lambda n, fps, most, **how: one(spark, V.stepped_or_even(F.lit(n), F.lit(fps), most, **how))
    assert at(10, 2.5, 16) == [0, 2, 4, 6, 8]  # halves round to even
    assert at(100, 3.0, 4) == [0, 33, 66, 99]
    assert at(3, 1.0, 4, force=True) == [0, 0, 1, 2]
    assert at(1, 30.0, 4) == [0]


def test_letters_and_choices(spark):
    options = lambda *x: F.array(*(F.lit(v).cast("string") for v in x))
    assert one(spark, V.open_letters(options("a", "b", "N/A", "c", "d"))) == "AB"
    assert one(spark, V.open_letters(options("a", None, None, None, None))) == "ABCDE"
    assert one(spark, V.open_letters(options("N/A", "b"))) == ""
    assert one(spark, V.choice_info(options("x", "y"))) == {"A": "x", "B": "y"}


def test_subtitle_prompt(spark):
    tag = '<font color="white" size=".72c">{}</font>'
    lines = F.array(F.lit(tag.format("one")), F.lit("bare"), F.lit(tag.format("two") + tag.format("three")))
    options = F.array(F.lit("A. x"))
    got = one(spark, V.subtitle_prompt(lines, F.lit("q"), options)).split("\n")
    assert got[1:3] == ["one", "two"] and got[-3:] == ["q", "A. x", V.BEST_ANSWER]
    assert V.NO_SUBTITLES in one(spark, V.subtitle_prompt(F.lit(None).cast("array<string>"), F.lit("q"), options))


def test_joined_ids(spark):
    chunks = lambda *x: F.array(*(F.array(*map(F.lit, c)) if c else F.array().cast("array<int>") for c in x))
    assert one(spark, V.joined_ids(chunks([1, 5], [1, 6, 7]), 1)) == [1, 5, V.IMAGE_ID, 6, 7]
    assert one(spark, V.joined_ids(chunks([5], [6]), 1)) == [5, V.IMAGE_ID, 6]
    assert one(spark, V.joined_ids(chunks([], [6]), 1)) == [V.IMAGE_ID, 6]


def test_texts(spark):
    shots = F.array(F.struct(F.lit("q1").alias("text"), F.lit("a1").alias("target")))
    assert one(spark, V.few_shot_text(F.lit("d "), shots, F.lit("q"))) == "d q1 a1\n\nq"
    assert [tuple(m) for m in one(spark, V.chat(F.lit("d"), shots, F.lit("q")))] == [("system", "d"), ("user", "q1"), ("assistant", "a1"), ("user", "q")]
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(V.resolved(df, "{{a}}-{{b}}!").alias("x")).first()["x"] == "x-!"
    assert df.select(V.resolved(df, lambda d: F.upper("a")).alias("x")).first()["x"] == "X"
    with pytest.raises(Exception, match="not a video"):
        one(spark, V.video_only(F.lit("image"), F.lit(1)))


def test_geometry(spark):
    def plain(h, w, frames):
        cap = max(min(768 * 784, 24576 * 784 / frames * 2), int(128 * 784 * 1.05))
        a, b = max(28, round(h / 28) * 28), max(28, round(w / 28) * 28)
        if a * b > cap:
            by = math.sqrt(h * w / cap)
            return max(28, math.floor(h / by / 28) * 28), max(28, math.floor(w / by / 28) * 28)
        if a * b < 128 * 784:
            by = math.sqrt(128 * 784 / (h * w))
            return math.ceil(h * by / 28) * 28, math.ceil(w * by / 28) * 28
        return a, b

    rnd = random.Random(7)
    sizes = [(rnd.randrange(30, 3000), rnd.randrange(30, 3000), rnd.choice([2, 16, 300])) for _ in range(60)]
    rows = spark.createDataFrame(sizes, "h int, w int, f int").select("h", "w", "f", V.smart_size(F.col("h"), F.col("w"), F.col("f")).alias("s")).collect()
    for r in rows:
        assert tuple(r["s"]) == plain(r["h"], r["w"], r["f"])
    assert tuple(one(spark, V.fitted(F.lit(100), F.lit(50), 672, 672))) == (672, 336, 0, 168)
    assert tuple(one(spark, V.squared(F.lit(5), F.lit(9)))) == (9, 2, 0)
    assert [tuple(t) for t in one(spark, V.tiles(F.lit(3), F.lit(2), 2))] == [(0, 0), (2, 0)]


def test_without_images(spark):
    df = spark.createDataFrame([(1, b"x", [b"y"], ["z"])], "a int, b binary, c array<binary>, d array<string>")
    assert V.without_images(df).columns == ["a", "d"]
