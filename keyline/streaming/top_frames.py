"""Structured Streaming: the best frames of each video so far, kept as bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_top(stream: DataFrame, m: int, radius: int = 0) -> DataFrame:
    """After each batch (video_id, pos, score) of the best m frames so far, none within ``radius`` places of a better one.

    State is at most m frames a video. A frame that a later, better one crowds out is gone; one that was refused does not
    come back.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        flat = [(held[i], held[i + 1]) for i in range(0, len(held), 2)]
        for pdf in batches:
            flat += [(float(p), float(s)) for p, s in zip(pdf["pos"], pdf["score"], strict=True)]
        kept: list[tuple[float, float]] = []
        for p, s in sorted(flat, key=lambda x: (-x[1], x[0])):
            if len(kept) < m and all(abs(p - q) > radius for q, _ in kept):
                kept.append((p, s))
        state.update(([x for pair in kept for x in pair],))
        yield pd.DataFrame({"video_id": [key[0]] * len(kept), "pos": [int(p) for p, _ in kept], "score": [s for _, s in kept]})

    return stream.groupBy("video_id").applyInPandasWithState(step, "video_id long, pos int, score double", "held array<double>", "update", GroupStateTimeout.NoTimeout)
