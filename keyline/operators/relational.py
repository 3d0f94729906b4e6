"""Joins onto annotations, request building, and accuracy roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contained(points: DataFrame, spans: DataFrame, width: float) -> DataFrame:
    """Distinct (video_id, sub_id) of spans (start <= t < end) that hold a point, met through bins of ``width``.

    A span is listed once for each bin that it touches, a point once; both meet on (video, bin), so neither a nested loop
    nor a whole video in one task is needed.
    """
    bin_of = lambda t: F.floor(F.col(t) / width).cast("long")
    spread = spans.where("end_s > start_s").withColumn("bin", F.explode(F.sequence(bin_of("start_s"), bin_of("end_s"))))
    met = points.withColumn("bin", bin_of("t")).join(spread, ["video_id", "bin"])
    return met.where("start_s <= t AND t < end_s").select("video_id", "sub_id").distinct()


def interleaved(frames: DataFrame, subtitles: DataFrame) -> DataFrame:
    """(video_id, text): an image mark for each frame, and before the first frame past its middle the line of each subtitle
    that has a frame strictly inside, where a subtitle shorter than a second counts as one second about its middle.

    frames (video_id, t), subtitles (video_id, ord, start_s, end_s, text).
    """
    t = frames.groupBy("video_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    subs = subtitles.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start_s", "end_s", "text"))).alias("subs"))
    rows = t.join(subs, "video_id", "left").withColumn("subs", F.expr("coalesce(subs, CAST(array() AS array<struct<ord:int,start_s:double,end_s:double,text:string>>))"))
    marks = "transform(z.ts, (t, i) -> struct(coalesce(get(filter(transform(z.subs, (u, j) -> CASE WHEN (u.start_s + u.end_s) / 2 >= t THEN j END), x -> x IS NOT NULL), 0), size(z.subs)) AS a, 0 AS b, i AS c, '<image>' AS text))"
    wide = "transform(z.subs, (u, j) -> CASE WHEN u.end_s - u.start_s < 1 THEN struct((u.start_s + u.end_s) / 2 - 0.5 AS lo, (u.start_s + u.end_s) / 2 + 0.5 AS hi, j AS j, u.text AS text) ELSE struct(u.start_s AS lo, u.end_s AS hi, j AS j, u.text AS text) END)"
    lines = f"transform(filter({wide}, u -> exists(z.ts, t -> t > u.lo AND t < u.hi)), u -> struct(u.j AS a, 1 AS b, 0 AS c, u.text AS text))"
    return rows.select("video_id", F.expr(f"transform(array(struct(ts, subs)), z -> array_join(transform(array_sort(concat({marks}, {lines})), x -> x.text), '\\n'))[0]").alias("text"))


def first_existing(docs: DataFrame, files: DataFrame, endings: list[str]) -> DataFrame:
    """``docs`` (video) with the path of the first of the endings for which ``files`` (path) has one; null if none."""
    named = files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("video"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ending"))
    ranks = F.create_map(*(F.lit(x) for k, e in enumerate(endings) for x in (e, k)))
    best = named.where(F.col("ending").isin(endings)).groupBy("video").agg(F.min_by("path", F.element_at(ranks, F.col("ending"))).alias("path"))
    return docs.join(best, "video", "left")


def sharded(docs: DataFrame, rank: int, world: int, limit: int | None = None) -> DataFrame:
    """Every ``world``-th document from ``rank`` on, of the first ``limit``."""
    out = docs.where(F.col("doc_id") % world == rank)
    return out if limit is None else out.where(F.col("doc_id") < limit)


def split(docs: DataFrame, available: list[str]) -> DataFrame:
    """The test split, else validation, else an error."""
    chosen = next((s for s in ("test", "validation") if s in available), None)
    if chosen is None:
        raise ValueError("neither a test nor a validation split")
    return docs.where(F.col("split") == chosen)


def requests(docs: DataFrame, choices: Column, unconditional: bool = False) -> DataFrame:
    """One request for each choice, and with ``unconditional`` one more each without context."""
    rows = docs.select("doc_id", "context", F.posexplode(choices).alias("idx", "choice"))
    return rows.unionByName(rows.withColumn("context", F.lit(""))) if unconditional else rows


def repeated(rows: DataFrame, times: int) -> DataFrame:
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def gathered(responses: DataFrame) -> DataFrame:
    """(doc_id, resps): the answers of each document in order of ``idx``."""
    return responses.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "resp"))), lambda x: x["resp"]).alias("resps"))


def accuracy_by_axis(samples: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, label, n, correct, accuracy) along each axis and over all, in one pass by grouping sets; percent, 0 if empty.

    A label of the axis' domain without samples is the caller's to add by a left join.
    """
    sets = samples.groupingSets([[F.col(a)] for a in axes] + [[]], *axes).agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("correct"), F.grouping_id().alias("g"))
    bits = {sum(1 << (len(axes) - 1 - k) for k in range(len(axes)) if k != i): a for i, a in enumerate(axes)}
    axis = F.lit("overall")
    label = F.lit("overall")
    for bit, a in bits.items():
        axis, label = F.when(F.col("g") == bit, F.lit(a)).otherwise(axis), F.when(F.col("g") == bit, F.col(a)).otherwise(label)
    correct = F.coalesce("correct", F.lit(0))
    return sets.select(axis.alias("axis"), label.alias("label"), "n", correct.cast("long").alias("correct"), F.when(F.col("n") > 0, correct * 100.0 / F.greatest("n", F.lit(1))).otherwise(0.0).alias("accuracy"))


def accuracy_shared_labels(samples: DataFrame, axes: list[str]) -> DataFrame:
    """(label, num, acc): every sample counts once for each axis, equal labels of two axes together, and Overall counts them all."""
    rows = samples.select(F.explode(F.array(*axes)).alias("label"), "correct")
    each = rows.groupBy("label").agg(F.count(F.lit(1)).alias("num"), F.round(F.avg("correct"), 5).alias("acc"))
    whole = rows.agg(F.count(F.lit(1)).alias("num"), F.round(F.avg("correct"), 5).alias("acc")).select(F.lit("Overall").alias("label"), "num", "acc")
    return each.unionByName(whole)


def gold_match(pred: Column, gold: Column) -> Column:
    """Right if the answer is any of the gold ones."""
    return F.array_contains(gold, pred)


def any_match(pred: Column, gold: Column, score=lambda p, g: p == g) -> Column:
    """1.0 if ``score`` holds for any of the gold answers, else 0.0; a null answer matches nothing."""
    return F.coalesce(F.exists(gold, lambda g: score(pred, g)), F.lit(False)).cast("double")


#: Stands for a gold choice that isn't among the choices.
NO_CHOICE = -100


def gold_choice(gold: Column, n: Column) -> Column:
    """The gold choice's number from 0, or NO_CHOICE if there are no more than that many."""
    return F.when(gold < n, gold).otherwise(NO_CHOICE)


def choice_pairs(lls: DataFrame) -> DataFrame:
    """(doc_id, gold, pred, exact_match) from (doc_id, idx, ll, is_greedy, gold): the pairs that f1 and mcc are made of, and
    whether the gold choice is what greedy decoding gives; 0 for a gold choice that isn't there."""
    rows = lls.withColumn("i", -F.col("idx")).groupBy("doc_id").agg(
        F.max_by("idx", F.struct("ll", "i")).alias("pred"), F.first("gold").alias("gold"), F.count(F.lit(1)).alias("n"),
        F.collect_set(F.when(F.col("is_greedy"), F.col("idx"))).alias("greedy"),
    )
    gold = gold_choice(F.col("gold"), F.col("n"))
    return rows.select("doc_id", gold.cast("int").alias("gold"), F.col("pred").cast("int").alias("pred"), F.array_contains("greedy", F.col("gold")).cast("int").alias("exact_match"))


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """(f1, mcc) of the pairs (gold, pred), 1 being the positive class; 0 where a denominator is."""
    n = lambda g, p: F.count_if((F.col("gold") == g) & (F.col("pred") == p)).cast("double")
    c = pairs.agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    over = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    return c.select(over(2 * tp, 2 * tp + fp + fn).alias("f1"), over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"))


def bootstrap_error(samples: DataFrame, key: str, value: str, times: int = 100, seed: int = 1234) -> DataFrame:
    """The standard error of the mean by key, from ``times`` resamples: each sample counts in each of them as often as a
    Poisson draw of mean 1, made from a hash of its number, says; so samples stay where they are."""
    draw = lambda b: (F.pmod(F.xxhash64(F.lit(seed), "doc_id", b), F.lit(1 << 32)).cast("double") + 0.5) / (1 << 32)
    cuts, p, total = [], 2.718281828459045**-1, 0.0
    for k in range(1, 12):
        total += p
        cuts.append(total)
        p /= k
    weight = lambda b: sum(((draw(b) > c).cast("int") for c in cuts), F.lit(0))
    rows = samples.select(key, F.col(value).cast("double").alias("x"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda b: F.struct(b.alias("b"), weight(b).alias("w")))).alias("r"))
    means = rows.groupBy(key, "r.b").agg((F.sum(F.col("x") * F.col("r.w")) / F.when(F.sum("r.w") > 0, F.sum("r.w"))).alias("mean"))
    return means.groupBy(key).agg(F.stddev_samp("mean").alias("stderr"))


def seeded_accuracy(samples: DataFrame, cells: DataFrame, axes: list[str], parts: list[str]) -> DataFrame:
    """(part, n, correct, accuracy) of each part of a label: every cell of ``cells`` counts, with none where it has no sample,
    and belongs to a part if its labels, joined by underscores, hold it anywhere; percent, 0 if empty."""
    counted = samples.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("c"))
    full = cells.join(counted, axes, "left").withColumn("cell", F.concat_ws("_", *axes))
    met = full.select("cell", "n", "c", F.explode(F.filter(F.array(*map(F.lit, parts)), lambda p: F.contains(F.col("cell"), p))).alias("part"))
    sums = met.groupBy("part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("correct"))
    return sums.select("part", "n", "correct", F.when(F.col("n") > 0, F.col("correct") * 100.0 / F.greatest("n", F.lit(1))).otherwise(0.0).alias("accuracy"))


#: Metrics by name, each a column of (pred, gold).
METRICS = {"acc": lambda p, g: (p == g).cast("double"), "exact_match": lambda p, g: (F.trim(p) == F.trim(g)).cast("double"), "any_match": any_match}


def measured(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` (pred, gold) with a column for each named metric; an unknown name is an error."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"no such metric: {', '.join(unknown)}")
    return rows.withColumns({n: METRICS[n](F.col("pred"), F.col("gold")) for n in names})


def processed(docs: DataFrame, process=None) -> DataFrame:
    """``docs`` through an optional filter of the task's own."""
    return docs.transform(process) if process is not None else docs


def by_rank(responses: DataFrame, world_size: int) -> DataFrame:
    """``responses`` (doc_id, ...) with their place once each rank's documents, every world_size-th, are put after the other
    rank's: the order in which ranks are gathered."""
    rank = F.pmod(F.col("doc_id"), F.lit(world_size))
    counts = responses.groupBy(rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("rank", (F.sum("n").over(Window.orderBy("rank")) - F.col("n")).alias("before"))  # world_size rows
    within = F.row_number().over(Window.partitionBy("rank").orderBy("doc_id")) - 1
    return responses.withColumn("rank", rank).join(F.broadcast(before), "rank").withColumn("place", F.col("before") + within).drop("before")


def request_key(task: Column, shots: Column, rank: Column, world_size: Column, prompt: Column) -> Column:
    """The key under which built requests are kept: what they depend on, the prompt by its hash."""
    return F.concat_ws("-", F.lit("requests"), task, F.concat(shots.cast("string"), F.lit("shot")), F.concat(F.lit("rank"), rank.cast("string")), F.concat(F.lit("world_size"), world_size.cast("string")), F.sha2(prompt, 256))


def choice_metrics(lls: DataFrame) -> DataFrame:
    """(doc_id, acc, acc_norm, acc_mutual_info) from (doc_id, idx, ll, ll_uncond, length, gold); of equals the lower choice."""
    best = lambda by: F.max_by("idx", F.struct(by.alias("x"), (-F.col("idx")).alias("i")))
    got = lls.groupBy("doc_id").agg(best(F.col("ll")).alias("a"), best(F.col("ll") / F.col("length")).alias("b"), best(F.col("ll") - F.col("ll_uncond")).alias("c"), F.first("gold").alias("gold"))
    return got.select("doc_id", *((F.col(k) == F.col("gold")).cast("int").alias(n) for k, n in (("a", "acc"), ("b", "acc_norm"), ("c", "acc_mutual_info"))))


def reconciled(groups: DataFrame) -> DataFrame:
    """(group, higher_is_better): the members' common value, null if they disagree."""
    return groups.groupBy("group").agg(F.when(F.countDistinct("higher_is_better") == 1, F.first("higher_is_better", ignorenulls=True)).alias("higher_is_better"))


def mean_error(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and its standard error by key, in closed form."""
    return samples.groupBy(key).agg(F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))).alias("stderr"))


def grid(spark, **values) -> DataFrame:
    """All combinations of the parameters' values."""
    out = spark.range(1).drop("id")
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v).cast("long") if isinstance(v, int) else F.lit(v) for v in options))))
    return out


def few_shot(docs: DataFrame, current: Column, k: int, seed: int = 1234) -> DataFrame:
    """k seeded examples that are not the current document: k + 1 are drawn and it is left out."""
    return docs.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), "doc_id").limit(k + 1).where(F.col("doc_id") != current).limit(k)


def by_length(rows: DataFrame, text: str = "text") -> DataFrame:
    """A place for each row, longest text first, equal ones by text and id: the order in which batches are run."""
    size = F.coalesce(F.length(text), F.lit(-1))
    counts = rows.groupBy(size.alias("_size")).agg(F.count(F.lit(1)).alias("_n"))  # as many rows as lengths
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy(F.col("_size").desc())) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy("_size").orderBy(text, "doc_id"))
    return rows.withColumn("_size", size).join(before, "_size").withColumn("place", F.col("_before") + within).drop("_size", "_before")
