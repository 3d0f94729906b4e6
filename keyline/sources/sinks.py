"""Writers: selections, parameter grids, annotations and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frames_by_video(selected: DataFrame) -> DataFrame:
    """(video_id, frame_idx) from (video_id, frame_id), in order of time."""
    return selected.groupBy("video_id").agg(F.array_sort(F.collect_list("frame_id")).alias("frame_idx"))


def write_selection(selected: DataFrame, path: str, kind: str = "json") -> None:
    frames_by_video(selected).write.mode("errorifexists").format(kind).save(path)


def write_grid(selected: DataFrame, path: str, parameters: list[str]) -> None:
    """One folder for each combination of the parameter columns, in place of file names that spell them."""
    selected.write.partitionBy(*parameters).parquet(path)


def write_sequences(seq: DataFrame, path: str) -> None:
    """Scores, frames and whatever else the sequences hold, in long form."""
    seq.write.mode("errorifexists").parquet(path)


def annotated(labels: DataFrame, selected: DataFrame, frame_num: int, use_topk: bool) -> DataFrame:
    """Labels with frame_idx, frame_num and use_topk; a label without a selection is an error. Write it as a new version."""
    met = labels.join(frames_by_video(selected), "video_id", "left")
    checked = F.when(F.col("frame_idx").isNull(), F.raise_error(F.lit("label without selection"))).otherwise(F.col("frame_idx"))
    return met.withColumns({"frame_idx": checked, "frame_num": F.lit(frame_num).cast("long"), "use_topk": F.lit(use_topk)})


def submission(responses: DataFrame) -> DataFrame:
    """(id, pred): of several answers to one id the last counts."""
    return responses.groupBy("id").agg(F.max_by("pred", "ord").alias("pred"))


def summary(counts: DataFrame) -> DataFrame:
    """One row from (video_id, input_frames, output_frames): totals, spread and a histogram of the outputs."""
    out = F.col("output_frames")
    edges = [("0-32", 0, 32), ("33-64", 32, 64), ("65-96", 64, 96), ("97-128", 96, 128), ("128+", 128, None)]
    bands = [F.count_if((out >= lo) & (out < hi) if hi else out >= lo).alias(name.replace("-", "_").replace("+", "_up")) for name, lo, hi in edges]
    return counts.agg(
        F.count(F.lit(1)).alias("total_videos"), F.sum("input_frames").alias("total_input_frames"), F.sum(out).alias("total_output_frames"),
        F.avg(out).alias("avg_frames"), F.min(out).alias("min_frames"), F.max(out).alias("max_frames"),
        F.percentile(out, 0.5).alias("median_frames"), F.stddev_pop(out).alias("std_frames"), *bands,
    )
