"""Column builders for frame loaders, image geometry and the texts of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyline.functions.scalars import best_resolution, linspace

#: The mark of an image in a text, and the id that stands for it among token ids.
IMAGE_MARK = "<image>"
IMAGE_ID = -200
#: The tag around a line of subtitles, and the sentences of the prompt with subtitles.
SUBTITLE_TAG = r'<font color="white" size=".72c">(.*?)</font>'
SUBTITLES_LISTED = "This video's subtitles are listed below: \n"
NO_SUBTITLES = "No subtitles available"
SELECT_WITH_SUBTITLES = "Select the best answer to the following multiple-choice question based on the video and the subtitles. Respond with only the letter (A, B, C, or D) of the correct option."
BEST_ANSWER = "The best answer is:"


def _upto(n: Column) -> Column:
    """0 to n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def stepped_or_even(n: Column, avg_fps: Column, most: int, fps: float = 1.0, force: bool = False) -> Column:
    """Every round(avg_fps / fps)-th of n frames; if those are more than ``most``, or with ``force``, evenly spaced ones."""
    step = F.greatest(F.bround(avg_fps / fps).cast("int"), F.lit(1))
    count = F.ceil(n / step)
    even = linspace(n, most)
    return even if force else F.when(count > most, even).otherwise(F.transform(_upto(count.cast("int")), lambda i: i * step))


def cached_place(frame: Column, fps: Column) -> Column:
    """Where a cache of one frame a second holds a frame."""
    return F.floor(frame / F.bround(fps)).cast("int")


def frame_timestamps(duration: Column, most: int = 16) -> Column:
    """Seconds of at most ``most`` frames: evenly from 0 on, or each whole second of a shorter video."""
    return F.when(duration > most, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: duration / most * i)).otherwise(_upto(duration.cast("int")).cast("array<double>"))


def choice_info(options: Column) -> Column:
    """A map from letter to option."""
    return F.map_from_entries(F.transform(options, lambda c, i: F.struct(F.chr((i + 65).cast("long")), c)))


def open_letters(options: Column) -> Column:
    """Letters of the options before the first "N/A"; a null option counts, as does every place of an absent one."""
    end = F.array_position(options, F.lit("N/A"))
    n = F.when(end > 0, end - 1).otherwise(F.size(options))
    return F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(1), n.cast("int"))


def tagged(line: Column) -> Column:
    """The first tagged part of a line of subtitles; null without one."""
    return F.when(F.rlike(line, F.lit(SUBTITLE_TAG)), F.regexp_extract(line, SUBTITLE_TAG, 1))


def subtitle_prompt(lines: Column, question: Column, options: Column) -> Column:
    """The question after its subtitles; null ``lines`` say that there is no file of them."""
    found = F.array_join(F.filter(F.transform(lines, tagged), lambda x: x.isNotNull()), "\n")
    asked = F.concat_ws("\n", F.coalesce(found, F.lit(NO_SUBTITLES)), F.lit(SELECT_WITH_SUBTITLES), question, F.array_join(options, "\n"), F.lit(BEST_ANSWER))
    return F.concat(F.lit(SUBTITLES_LISTED), asked)


def time_instruction(video_time: Column, frames: Column, times: Column) -> Column:
    # a fixed value: the sentence that models are asked with
    return F.format_string("The video lasts for %.2f seconds, and %d frames are uniformly sampled from it. These frames are located at %s.Please answer the following questions related to this video.", video_time, frames, times)


def image_chunks(text: Column) -> Column:
    return F.split(text, IMAGE_MARK)


def joined_ids(chunks: Column, first_id: int, mark: int = IMAGE_ID) -> Column:
    """Ids of all chunks with ``mark`` between them; if the first chunk begins with ``first_id``, each chunk's first id goes but that one."""
    head = F.get(F.get(chunks, F.lit(0)), F.lit(0))
    skip = F.when(head == first_id, 1).otherwise(0)
    none = F.array().cast("array<int>")
    parts = F.transform(chunks, lambda c, i: F.concat(F.when(i > 0, F.array(F.lit(mark))).otherwise(none), F.slice(c, skip + 1, F.greatest(F.size(c) - skip, F.lit(0)))))
    return F.concat(F.when(skip == 1, F.array(F.lit(first_id))).otherwise(none), F.flatten(parts))


def few_shot_text(description: Column, shots: Column, question: Column, target_mark: str = " ", between: str = "\n\n") -> Column:
    """Description, then each shot (text, target), then the question."""
    told = F.transform(shots, lambda s: F.concat(s["text"], F.lit(target_mark), s["target"], F.lit(between)))
    return F.concat(description, F.array_join(told, ""), question)


def chat(description: Column, shots: Column, question: Column) -> Column:
    """The same as messages (role, content); an empty description gives none."""
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = F.flatten(F.transform(shots, lambda s: F.array(said("user", s["text"]), said("assistant", s["target"]))))
    system = F.filter(F.array(said("system", description)), lambda m: m["content"] != "")
    return F.concat(system, turns, F.array(said("user", question)))


def resolved(df: DataFrame, how: str | int | Callable[[DataFrame], Column]) -> Column:
    """A column from a number, the name of a column, a template with {{name}}, or a function of the frame."""
    if callable(how):
        return how(df)
    if isinstance(how, int):
        return F.lit(how)
    if how in df.columns:
        return F.col(how)
    parts = [p.split("}}", 1) for p in how.split("{{")]
    pieces = [F.lit(parts[0][0])]
    for p in parts[1:]:
        pieces += [F.coalesce(F.col(p[0].strip()).cast("string"), F.lit("")), F.lit(p[1])]
    return F.concat(*pieces)


def without_images(df: DataFrame) -> DataFrame:
    """``df`` without columns of pictures: binary ones, and arrays of them."""
    picture = lambda t: isinstance(t, T.BinaryType) or (isinstance(t, T.ArrayType) and picture(t.elementType))
    return df.drop(*(f.name for f in df.schema.fields if picture(f.dataType)))


def video_only(kind: Column, value: Column) -> Column:
    """``value`` of a video; any other kind is an error."""
    return F.when(kind == "video", value).otherwise(F.raise_error(F.lit("not a video")))


# ---- geometry ------------------------------------------------------------------------------------


def grid_shape(width: Column, height: Column, options: list[tuple[int, int]], patch: int) -> Column:
    """Patches across and down of the best of the options."""
    best = best_resolution(width, height, options)
    return F.struct(F.floor(best["w"] / patch).cast("int").alias("across"), F.floor(best["h"] / patch).cast("int").alias("down"))


def fitted(width: Column, height: Column, into_w: int, into_h: int) -> Column:
    """Size of an image scaled to fit into a frame, sides rounded up, and the margins left of and above it."""
    wide = into_w * height < into_h * width
    w = F.when(wide, F.lit(into_w)).otherwise(F.least(F.ceil(width * F.lit(float(into_h)) / height), F.lit(into_w))).cast("int")
    h = F.when(wide, F.least(F.ceil(height * F.lit(float(into_w)) / width), F.lit(into_h))).otherwise(F.lit(into_h)).cast("int")
    return F.struct(w.alias("w"), h.alias("h"), F.floor((into_w - w) / 2).cast("int").alias("left"), F.floor((into_h - h) / 2).cast("int").alias("top"))


def squared(width: Column, height: Column) -> Column:
    """Side of the square that an image is padded to, and the margins left of and above it."""
    side = F.greatest(width, height)
    return F.struct(side.cast("int").alias("side"), F.floor((side - width) / 2).cast("int").alias("left"), F.floor((side - height) / 2).cast("int").alias("top"))


def tiles(width: Column, height: Column, patch: int, stride: int | None = None) -> Column:
    """Corners (x, y) of the patches of an image, row by row; the last ones may reach beyond it."""
    step = stride or patch
    xs, ys = _upto(F.ceil(width / step).cast("int")), _upto(F.ceil(height / step).cast("int"))
    return F.flatten(F.transform(ys, lambda j: F.transform(xs, lambda i: F.struct((i * step).alias("x"), (j * step).alias("y")))))


def cropped(width: Column, height: Column, edge: int) -> Column:
    """Size of an image whose shorter side is scaled to ``edge``, the other rounded down, and the corner of its middle square."""
    ratio = width.cast("double") / height
    w = F.when(ratio > 1, F.floor(edge * ratio)).otherwise(edge).cast("int")
    h = F.when(ratio > 1, F.lit(edge)).otherwise(F.floor(edge / ratio)).cast("int")
    return F.struct(w.alias("w"), h.alias("h"), ((w - edge) / 2).alias("left"), ((h - edge) / 2).alias("top"))


def padded(width: Column, height: Column, sides: list[int]) -> Column:
    """Target of an image among all pairs of ``sides``, its size in there and the margins left of and above it.

    Of the pairs whose shape is nearest the image's (to 0.001) the one whose longer side is; of equals the first, widths in
    the given order and heights within.
    """
    ratio, longer = width.cast("double") / height, F.greatest(width, height).cast("double")
    pairs = [(w, h) for w in sides for h in sides]
    near = F.array_min(F.array(*(F.struct(F.abs(ratio - w / h).alias("d"), F.lit(k).alias("k"), F.lit(w / h).alias("r")) for k, (w, h) in enumerate(pairs))))["r"]
    like = [F.when(F.abs(F.lit(w / h) - near) < 1e-3, F.struct(F.abs(longer / max(w, h) - 1).alias("d"), F.lit(k).alias("k"), F.lit(w).alias("tw"), F.lit(h).alias("th"))) for k, (w, h) in enumerate(pairs)]
    best = F.array_min(F.array_compact(F.array(*like)))
    w = F.when(width > height, best["tw"]).otherwise(F.floor(best["th"] * ratio)).cast("int")
    h = F.when(width > height, F.floor(best["tw"] / ratio)).otherwise(best["th"]).cast("int")
    margin = lambda a, b: F.floor((a - b) / 2).cast("int")
    return F.struct(best["tw"].alias("target_w"), best["th"].alias("target_h"), w.alias("w"), h.alias("h"), margin(best["tw"], w).alias("left"), margin(best["th"], h).alias("top"))


def overlapped(width: Column, height: Column, patch: int, overlap: float) -> Column:
    """Corners (x, y) of the whole patches of an image, row by row, centred; each shares ``overlap`` of its side with the next."""
    stride = int(patch * (1 - overlap))

    def starts(side: Column) -> Column:
        n = (F.floor((side - patch) / stride) + 1).cast("int")
        first = F.floor((side - (n - 1) * stride - patch) / 2).cast("int")
        return F.transform(_upto(F.greatest(n, F.lit(0))), lambda i: first + i * stride)

    return F.flatten(F.transform(starts(height), lambda y: F.transform(starts(width), lambda x: F.struct(x.alias("x"), y.alias("y")))))


def range_options(spec: str, patch: int) -> list[tuple[int, int]]:
    """Sizes in patches from the first to the last pair of "(1x1),...,(6x6)", times the patch."""
    pairs = [tuple(map(int, p.split("x"))) for p in spec.replace("(", " ").replace(")", " ").replace(",", " ").split() if "x" in p]
    (a, b), (c, d) = pairs[0], pairs[-1]
    return [(i * patch, j * patch) for i in range(a, c + 1) for j in range(b, d + 1)]


#: The pixel limits of a frame and of a video, in squares of 28.
def smart_size(height: Column, width: Column, frames: Column, factor: int = 28, least: int = 128 * 28 * 28, most: int = 768 * 28 * 28, total: int = 24576 * 28 * 28) -> Column:
    """Sides as multiples of ``factor`` near the given ones, whose product keeps to a frame's share of all pixels."""
    cap = F.greatest(F.least(F.lit(float(most)), F.lit(2.0 * total) / frames), F.lit(float(int(least * 1.05))))
    near = lambda x: F.greatest(F.lit(factor), (F.bround(x / factor) * factor).cast("int"))
    h, w, area = near(height), near(width), (height * width).cast("double")
    down, up = F.sqrt(area / cap), F.sqrt(F.lit(float(least)) / area)
    less = lambda x: F.greatest(F.lit(factor), (F.floor(x / down / factor) * factor).cast("int"))
    more = lambda x: (F.ceil(x * up / factor) * factor).cast("int")
    side = lambda own, x: F.when(h.cast("double") * w > cap, less(x)).when(h.cast("double") * w < least, more(x)).otherwise(own)
    return F.struct(side(h, height).alias("h"), side(w, width).alias("w"))


def text_bytes(text: Column) -> Column:
    return F.octet_length(text)
