"""Steps of the dual-quota recursion as operators of their own, and the files of an image folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyline.functions.scalars import by_video, linspace
from keyline.operators.selection import normalised

_MASS = 1e-6


def stopped(seq: DataFrame, m: int, stop: float = 0.5) -> DataFrame:
    """(video_id, n, gap, stops): halving stops with one frame to take, with no more than m frames, or where the best m stand out."""
    ranked = normalised(seq).withColumn("rank", F.row_number().over(by_video().orderBy(F.col("s").desc(), "pos")))
    rows = ranked.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.when(F.col("rank") <= m, F.col("s"))) - F.avg("s")).alias("gap"))
    return rows.withColumn("stops", (F.lit(m) <= 1) | (F.col("n") <= m) | (F.col("gap") >= stop))


def sided(seq: DataFrame) -> DataFrame:
    """``seq`` with boolean left: frames up to the middle of the time that the video spans."""
    middle = (F.min("frame_id").over(by_video()) + F.max("frame_id").over(by_video())) / 2
    return seq.withColumn("left", F.col("frame_id") <= middle)


def shared_budget(seq: DataFrame, m: int) -> DataFrame:
    """(video_id, m_left, m_right): m frames split by the mass of normalised scores on both sides, halves to even."""
    mass = lambda left: F.coalesce(F.sum(F.when(F.col("left") == left, F.col("s"))), F.lit(0.0)) + _MASS
    rows = sided(normalised(seq)).groupBy("video_id").agg(mass(True).alias("l"), mass(False).alias("r"))
    return rows.select("video_id", F.bround(m * F.col("l") / (F.col("l") + F.col("r"))).cast("int").alias("m_left")).withColumn("m_right", F.lit(m) - F.col("m_left"))


def refilled(seq: DataFrame, taken: DataFrame, m: int) -> DataFrame:
    """(video_id, frame_id) of what fills ``taken`` (video_id, frame_id) up to m: of the unused frames, in order of time, those
    at the whole part of each multiple of their number over what is needed; all if no more are there."""
    used = taken.groupBy("video_id").agg(F.count(F.lit(1)).alias("k"))
    free = seq.join(taken, ["video_id", "frame_id"], "left_anti").join(used, "video_id", "left").withColumn("need", F.lit(m) - F.coalesce("k", F.lit(0)))
    rows = free.withColumns({"i": F.row_number().over(by_video().orderBy("frame_id")) - 1, "c": F.count(F.lit(1)).over(by_video())}).where("need > 0")
    step = F.greatest(F.lit(1.0), F.col("c") / F.col("need"))
    places = F.transform(F.sequence(F.lit(0), F.col("need").cast("int") - 1), lambda j: F.floor(j * step).cast("int"))
    return rows.where(F.array_contains(places, F.col("i").cast("int"))).select("video_id", "frame_id")


def folder_images(files: DataFrame, m: int = 10) -> DataFrame:
    """(folder, nth, path): of each folder's files (folder, path, readable) in order of name m evenly spaced ones, those that
    can't be read left out; a folder of fewer files repeats some."""
    places = files.withColumns({"i": F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("folder"))})
    spaced = places.withColumn("wanted", F.transform(linspace(F.col("n"), m), lambda x, k: F.struct(x.alias("at"), k.alias("nth"))))
    return spaced.select("folder", "path", "readable", F.explode(F.filter("wanted", lambda x: x["at"] == F.col("i"))).alias("w")).where("readable").select("folder", F.col("w.nth").alias("nth"), "path")


def result(question: Column, duration: Column, domain: Column, sub_category: Column, task: Column, pred: Column, answer: Column) -> Column:
    """What is kept of one answered question for the accuracy axes."""
    names = ("question_id", "duration", "category", "sub_category", "task_category", "pred_answer", "answer")
    return F.struct(*(c.alias(n) for c, n in zip((question, duration, domain, sub_category, task, pred, answer), names, strict=True)))
