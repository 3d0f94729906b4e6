"""Readers: scored sequences in long form (video_id, pos, frame_id, score), labels, nested JSON arrays and subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMES_PER_STEP = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, video: str, order: list, score: str) -> DataFrame:
    """Long form of a table: positions follow ``order`` within each ``video``; frame ids are FRAMES_PER_STEP apart."""
    pos = F.row_number().over(Window.partitionBy(video).orderBy(*order)) - 1
    out = df.where(F.col(score).isNotNull()).select(F.col(video).alias("video_id"), pos.cast("int").alias("pos"), F.col(score).cast("double").alias("score"))
    return out.select("video_id", "pos", (F.col("pos").cast("long") * FRAMES_PER_STEP).alias("frame_id"), "score")


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def packed(seq: DataFrame) -> DataFrame:
    """One row a video: frame_ids and scores in order of position."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "frame_id", "score")))
    return seq.groupBy("video_id").agg(rows.alias("rows")).select("video_id", F.col("rows.frame_id").alias("frame_ids"), F.col("rows.score").alias("scores"))


def unpacked(df: DataFrame, array: str = "frame_idx") -> DataFrame:
    """(video_id, rank, frame_id) of an array column."""
    return df.select("video_id", F.posexplode(array).alias("rank", "frame_id")).select("video_id", F.col("rank").cast("int"), F.col("frame_id").cast("long"))


def read_nested(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """A file that is one JSON array of arrays, as rows (video_id, pos, value). The file is one record: convert it once."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<array<{kind}>>").alias("v"))
    outer = whole.select(F.posexplode("v").alias("video_id", "a"))
    return outer.select(F.col("video_id").cast("long"), F.posexplode("a").alias("pos", "value"))


def read_scored(spark: SparkSession, scores: str, frames: str) -> DataFrame:
    """Score and frame files zipped by place; what one of them lacks is left out."""
    s = read_nested(spark, scores).withColumnRenamed("value", "score")
    return s.join(read_nested(spark, frames, "bigint").withColumnRenamed("value", "frame_id"), ["video_id", "pos"]).select("video_id", "pos", "frame_id", "score")


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects under an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def seconds(hms: Column) -> Column:
    """HH:MM:SS with a decimal comma or point, in seconds."""
    parts = F.split(F.regexp_replace(hms, ",", "."), ":")
    return parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + parts[2].cast("double")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(file, start_s, end_s, text) of SubRip files; blocks of fewer than three lines are skipped, of equal times the last counts."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    blocks = whole.select("file", F.posexplode(F.split("value", "\n\n")).alias("ord", "block")).select("file", "ord", F.split(F.trim("block"), "\n").alias("l")).where(F.size("l") >= 3)
    times = F.split(F.col("l")[1], " --> ")
    rows = blocks.select("file", "ord", seconds(times[0]).alias("start_s"), seconds(times[1]).alias("end_s"), F.array_join(F.slice("l", 3, 1 << 20), " ").alias("text"))
    return rows.groupBy("file", "start_s", "end_s").agg(F.max_by("text", "ord").alias("text"))


def read_subtitle_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, start_s, end_s, text) of both JSON shapes: timestamp pairs with text, or clock times with line."""
    schema = "timestamp array<double>, text string, start string, end string, line string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    pair = F.col("timestamp").isNotNull()
    return rows.select("file", F.when(pair, F.get("timestamp", F.lit(0))).otherwise(seconds(F.col("start"))).alias("start_s"), F.when(pair, F.get("timestamp", F.lit(1))).otherwise(seconds(F.col("end"))).alias("end_s"), F.when(pair, F.col("text")).otherwise(F.col("line")).alias("text"))


def sampled_frames(videos: DataFrame) -> DataFrame:
    """(video_id, pos, frame_id): one frame a second of videos (video_id, n_frames, fps); a rate below one is an error."""
    step = F.when(F.col("fps") < 1, F.raise_error(F.lit("fps below 1"))).otherwise(F.floor("fps")).cast("long")
    n = F.floor(F.col("n_frames") / step).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return videos.select("video_id", step.alias("step"), F.explode(ids).alias("pos")).select("video_id", "pos", (F.col("pos") * F.col("step")).alias("frame_id"))
