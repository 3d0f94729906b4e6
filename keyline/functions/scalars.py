"""Column builders: normalisation, even spacing, clock times, prompts and answer parsing."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_video() -> WindowSpec:
    return Window.partitionBy("video_id")



def minmax(score: str = "score", constant: float | None = 0.5, eps: float | None = None) -> Column:
    """Scores in 0..1 by video; a constant video gives ``constant``, or NaN for None. With ``eps``, ranges below it are constant
    and NaN, inf and -inf among the scores become 0, 1 and 0 first, if there are any in the video."""
    s = F.col(score)
    if eps is not None:
        bad = F.max(F.when(F.isnan(s) | (F.abs(s) == float("inf")), 1).otherwise(0)).over(by_video()) == 1
        clean = F.when(F.isnan(s), 0.0).when(s == float("inf"), 1.0).when(s == float("-inf"), 0.0).otherwise(s)
        s = F.when(bad, clean).otherwise(s)
    low, high = F.min(s).over(by_video()), F.max(s).over(by_video())
    ranged = high - low >= eps if eps is not None else high > low
    return F.when(ranged, (s - low) / F.when(ranged, high - low)).otherwise(F.lit(float("nan") if constant is None else constant))


def linspace(n: Column, m: int) -> Column:
    """m whole numbers from 0 to n - 1, evenly spaced and floored; fewer places than numbers repeat some."""
    if m == 1:
        return F.array(F.lit(0))
    step = (n - 1).cast("double") / F.lit(float(m - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.when(i == m - 1, (n - 1).cast("int")).otherwise(F.floor(i * step).cast("int")))


def halving(n: Column) -> Column:
    """floor(log2 n) for n >= 1, exact."""
    return F.length(F.bin(n.cast("long"))) - 1


def loaded(frame_idx: Column, n: Column, most: int) -> Column:
    """Frames that a loader reads: the first ``most`` selected ones in order, or evenly spaced ones if there are fewer."""
    return F.when(F.size(frame_idx) < most, linspace(n, most).cast("array<long>")).otherwise(F.array_sort(F.slice(frame_idx, 1, most)))


def loaded_or_own(frame_idx: Column, most: int) -> Column:
    """The first ``most`` selected frames in order, or null if there are fewer: the model's loader then samples by itself."""
    return F.when(F.size(frame_idx) >= most, F.array_sort(F.slice(frame_idx, 1, most)))


def fixed_stride(total: Column, duration: Column, most: int = 16) -> Column:
    """At most one frame a second, ``total / num`` apart, floored before it is multiplied."""
    num = F.least(F.lit(most), duration.cast("int"))
    return F.transform(F.sequence(F.lit(0), num - 1), lambda i: (F.floor(total / num) * i).cast("long"))


def softmax_match(no: Column, yes: Column) -> Column:
    return 1 / (1 + F.exp(no - yes))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    under = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(under > 0, dot(a, b) / F.when(under > 0, under))


def lettered(options: Column) -> Column:
    """"A. first" and so on, one option a line."""
    return F.array_join(F.transform(options, lambda c, i: F.concat(F.chr((i + 65).cast("long")), F.lit(". "), c)), "\n")


def prompt(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


#: The phrases that answers begin with, in this order; the last two are each two phrases run together.
ANSWER_PREFIXES = (
    "The best answer is",
    "The correct answer is",
    "The answer is",
    "The answer",
    "The best option isThe correct option is",
    "Best answer:Best option:",
)


def first_letter(answer: Column) -> Column:
    """The first of A to D after the usual phrases are gone; empty if there is none."""
    s = F.regexp_replace(answer, r"^\s+|\s+$", "")
    for p in ANSWER_PREFIXES:
        s = F.replace(s, F.lit(p), F.lit(""))
    return F.regexp_extract(s, "[ABCD]", 0)


def _last_index(s: Column, part: str) -> Column:
    """Place from 0 of the last occurrence; -1 if there is none."""
    back = F.instr(F.reverse(s), part[::-1])
    return F.when(back == 0, -1).otherwise(F.length(s) - back - len(part) + 1)


def choice(answer: Column, letters: str) -> Column:
    """The chosen letter: in brackets, else before a blank, else before a point; of several the one that comes last.

    An answer without any gives null, where guessing would make reruns disagree.
    """
    stripped = answer
    for c in ",.!?;:'":
        stripped = F.regexp_replace(stripped, rf"^[{c}]+|[{c}]+$", "")
    bound = F.array(F.concat(F.lit(" "), stripped, F.lit(" ")))
    return F.transform(bound, lambda s: _letter_of(s, letters))[0]  # stripped once, not at each use


def _letter_of(s: Column, letters: str) -> Column:
    def of(pattern: str, order: str) -> tuple[Column, Column]:
        found = [F.contains(s, F.lit(pattern.format(c))) for c in letters]
        places = F.array_compact(F.array(*(F.when(f, F.struct(_last_index(s, order.format(c)).alias("at"), F.lit(-i).alias("i"), F.lit(c).alias("c"))) for i, (f, c) in enumerate(zip(found, letters, strict=True)))))
        return F.size(places) > 0, F.array_max(places)["c"]

    brackets, blanks, points = of("({})", "({})"), of("{} ", " {} "), of("{}.", " {} ")
    return F.when(brackets[0], brackets[1]).when(blanks[0], blanks[1]).when(points[0], points[1])


def model_name(path: Column) -> Column:
    """The last part of a path; a checkpoint takes its parent with it."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    last = F.element_at(parts, -1)
    return F.when(last.startswith("checkpoint-") & (F.size(parts) > 1), F.concat(F.try_element_at(parts, F.lit(-2)), F.lit("_"), last)).otherwise(last)


def frame_times(seconds: Column) -> Column:
    return F.array_join(F.transform(seconds, lambda t: F.format_string("%.2fs", t)), ",")


def best_resolution(width: Column, height: Column, options: list[tuple[int, int]]) -> Column:
    """Of (width, height) options the one of most effective pixels, of equals the one of least waste, then the first."""
    ranked = []
    for k, (w, h) in enumerate(options):
        wide = w * height <= h * width  # the width limits the scale: w / width <= h / height
        down_w = F.when(wide, F.lit(w)).otherwise(F.floor(width * F.lit(float(h)) / height)).cast("long")
        down_h = F.when(wide, F.floor(height * F.lit(float(w)) / width)).otherwise(F.lit(h)).cast("long")
        effective = F.least(down_w * down_h, (width * height).cast("long"))
        ranked.append(F.struct(effective.alias("e"), (effective - w * h).alias("waste"), F.lit(-k).alias("k"), F.lit(w).alias("w"), F.lit(h).alias("h")))
    return F.array_max(F.array(*ranked))
