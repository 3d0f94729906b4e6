"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. SQL functions only.

Defined cases: a null text has size 0 and is drawn like an empty one; null sources form one source, last in order; a null
doc_id is hashed as an empty string; rows of one doc_id are drawn by their texts; of rows equal in source, doc_id and text as
many are taken once more as the target asks; with no words at all every target is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyline.llm.common import documents, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "keyline"
#: A source's documents are dealt by hash into so many ranges; no window holds more than one range of one source.
HEX_DIGITS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw_of(doc_id: Column, text: Column) -> Column:
    """The document's place in its source's seeded order."""
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """``by_source`` (source, source_size), one row a source, with column target.

    Water-filling to its end in one sort: with sources in order of cap / weight, the level at each place is what is left
    by the full sources before it over the weights from it on; a source is full if that level reaches its cap.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    full_first = Window.orderBy("tight", "rank")
    every = Window.partitionBy()
    return (
        by_source.withColumns({"rank": F.row_number().over(in_order), "w": w, "cap": F.col("source_size").cast("double") * epochs})
        .withColumn("tight", F.col("cap") / F.col("w"))
        .withColumns({
            "before": F.coalesce(F.sum("cap").over(full_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_left": F.sum("w").over(full_first.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double") * share,
        })
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("weight_left"))
        .withColumn("final", F.max(F.when(F.col("w") * F.col("level") < F.col("cap"), F.col("level"))).over(every))
        .select("source", "source_size", F.when(F.col("w") * F.col("level") < F.col("cap"), F.col("w") * F.col("final")).otherwise(F.col("cap")).alias("target"))
    )


def plan(sizes: DataFrame, **options) -> DataFrame:
    """Of each source of ``sizes`` (source, draw, size): source_size, target, whole repetitions, the last draw of which all rows
    are taken once more, and if of one draw only some are, that draw (edge) and how many (some).

    A row is taken once more if its middle, in the seeded order, lies below the fraction's end; so the taken words miss the
    target by half a document at most. Rows of one draw are one here, so no window holds them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = (
        targets(per, **options)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    goal = staged(goal, "mixing-targets")
    dealt = sizes.groupBy("source", "draw").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n")).withColumn("range", F.substring("draw", 1, HEX_DIGITS))
    words = F.col("size") * F.col("n")
    before = dealt.groupBy("source", "range").agg(F.sum(words).alias("t")).select("source", "range", (F.sum("t").over(Window.partitionBy("source").orderBy("range")) - F.col("t")).alias("earlier"))
    inner = Window.partitionBy("source", "range").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("upto", F.sum(words).over(inner) - words).alias("d").join(before.alias("b"), F.expr("d.source <=> b.source AND d.range = b.range")).select("d.source", "draw", "size", "n", (F.col("earlier") + F.col("upto")).alias("start"))
    met = placed.alias("p").join(goal.alias("g"), F.expr("p.source <=> g.source")).select("p.source", "draw", "size", "n", "start", "rest").where("start + size / 2 < rest")
    lies = lambda j: F.col("start") + F.col("size") * (j - 0.5) < F.col("rest")
    near = F.floor((F.col("rest") - F.col("start")) / F.when(F.col("size") > 0, F.col("size")) + 0.5)
    met = met.withColumn("k", F.coalesce(F.least("n", near + lies(near + 1).cast("long") - (~lies(near)).cast("long")), F.col("n")))
    last = met.groupBy("source").agg(F.max(F.when(F.col("k") == F.col("n"), F.col("draw"))).alias("last"), F.max(F.when(F.col("k") < F.col("n"), F.struct("draw", "k"))).alias("part"))
    out = goal.alias("g").join(last.alias("l"), F.expr("g.source <=> l.source"), "left")
    return staged(out.select("g.*", F.coalesce("last", F.lit("")).alias("last"), F.col("part.draw").alias("edge"), F.col("part.k").alias("some")), "mixing-plan")


def drawn(rows: DataFrame, goal: DataFrame, source: str, draw: str, out: str) -> DataFrame:
    """``rows`` and column ``out``: how often each is taken. Only rows of a draw that is taken in part are numbered."""
    names = {c: f"_kl_{c}" for c in ("whole", "last", "edge", "some")}
    met = rows.join(goal.select(F.col("source").alias("_kl_source"), *(F.col(c).alias(n) for c, n in names.items())), F.col(source).eqNullSafe(F.col("_kl_source")))
    n = met.withColumn(out, F.col("_kl_whole") + (F.col(draw) <= F.col("_kl_last")).cast("long")).drop("_kl_source", "_kl_whole", "_kl_last")
    if not goal.where("edge IS NOT NULL").take(1):
        return n.drop("_kl_edge", "_kl_some")
    at = F.col("_kl_edge").eqNullSafe(F.col(draw))
    nth = F.row_number().over(Window.partitionBy(source, draw).orderBy(draw))
    edge = n.where(at).withColumn(out, F.col(out) + (nth <= F.col("_kl_some")).cast("long"))
    return n.where(~at).unionByName(edge).drop("_kl_edge", "_kl_some")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    draw = draw_of(F.col("doc_id"), F.col("text"))
    sizes = staged(docs.select("source", draw.alias("draw"), size_of(F.col("text")).alias("size")), "mixing-sizes")
    met = drawn(docs.withColumn("_kl_draw", draw), plan(sizes, **options), "source", "_kl_draw", "_kl_n")
    return met.withColumn("_kl_n", F.explode(F.array_repeat(F.lit(1), F.col("_kl_n").cast("int")))).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 by code point of the source, 150 % of all words, no document above twice its size."""
    docs = documents(spark, sf_dir)
    sizes = staged(docs.select("doc_id", "source", draw_of(F.col("doc_id"), F.col("text")).alias("draw"), size_of(F.col("text")).alias("size")), "mixing-sizes")
    goal = plan(sizes.select("source", "draw", "size"))
    known = goal.select(F.col("source").alias("_kl_s"), "source_size", "target")
    met = drawn(sizes, goal, "source", "draw", "n")
    return met.join(known, F.col("source").eqNullSafe(F.col("_kl_s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"))


OP4_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS draw,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM per),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
                   2.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goal AS (SELECT source, source_size, CASE WHEN w * level < cap THEN w * max(CASE WHEN w * level < cap THEN level END) OVER () ELSE cap END AS target FROM levels),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goal),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle FROM sizes)
SELECT d.doc_id, d.size, g.source_size, g.target,
       CAST(d.size * (g.whole + CASE WHEN d.middle < g.target - g.whole * g.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed d JOIN whole g ON d.source IS NOT DISTINCT FROM g.source
"""
