"""Quality rules: learned decision lists over text statistics, written out as ordered Spark conditional expressions.

Defined cases: a null or empty text has no words and fails the base rules; a null label is ignored; contradictory labels
of one document count as bad; of several rows of a labelled doc_id the least text is learned from; without usable labels the list is empty and only the base rules decide. Extra columns of the
input pass through unread: internal names start with ``_kl_``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyline.llm.common import documents

WORD = r"[^\\x20\\x09-\\x0D]+"

#: Counts of one text. Three hashes stand for a window of three words; arrays are bound to lambda names, so each is made once.
_WINDOWS = "transform(slice(h, 1, greatest(size(h) - 2, 0)), (x, i) -> xxhash64(x, h[i + 1], h[i + 2]))"
_SORTED = "array_sort(transform(w, (x, i) -> struct(x AS h, i AS i)))"
_FOUND_TWICE = "array_sort(transform(filter(p, (x, j) -> (j > 0 AND p[greatest(j - 1, 0)].h = x.h) OR (j < size(p) - 1 AND p[least(j + 1, size(p) - 1)].h = x.h)), x -> x.i))"
_COVERED = "aggregate(q, struct(0L AS t, 0L AS e), (a, i) -> struct(a.t + i + 3 - greatest(CAST(i AS BIGINT), a.e) AS t, CAST(i + 3 AS BIGINT) AS e), a -> a.t)"
_REPEATED = (
    f"transform(array({_WINDOWS}), w -> CASE WHEN size(array_distinct(w)) = size(w) THEN 0L ELSE "
    f"transform(array({_SORTED}), p -> transform(array({_FOUND_TWICE}), q -> {_COVERED})[0])[0] END)[0]"
)
_WORDS = f"transform(array(transform(regexp_extract_all(_kl_t, '{WORD}', 0), w -> xxhash64(w))), h -> struct(CAST(size(h) AS BIGINT) AS n_words, {_REPEATED} AS n_repeat_words))[0]"
_LINES = r"transform(array(filter(split(_kl_t, '\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]')), l -> CAST(size(l) - size(array_distinct(l)) AS BIGINT))[0]"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_EXTRA = ("n_upper", "n_marks")

#: What the learned conditions may ask about: each is a ratio, so thresholds mean the same for short and long texts.
FEATURES = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
}


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` and a struct column ``_kl_s`` of all counts of the text, computed by SQL functions alone."""
    t = df.withColumn("_kl_t", F.coalesce(F.col(text), F.lit("")))
    counts = {
        "word_chars": f"CAST(char_length(regexp_replace(_kl_t, '[\\\\x20\\\\x09-\\\\x0D]+', '')) AS BIGINT)",
        "n_symbols": r"CAST(regexp_count(_kl_t, '[#*$%&|<>]') AS BIGINT)",
        "n_dup_lines": _LINES,
        "n_upper": r"CAST(regexp_count(_kl_t, '\\p{Lu}') AS BIGINT)",
        "n_marks": r"CAST(regexp_count(_kl_t, '[!?]') AS BIGINT)",
    }
    fields = ", ".join(f"{v} AS {k}" for k, v in counts.items())
    return t.withColumn("_kl_s", F.expr(f"struct({_WORDS} AS w, {fields})")).drop("_kl_t")


def stat(name: str) -> Column:
    return F.col("_kl_s.w." + name) if name in ("n_words", "n_repeat_words") else F.col("_kl_s." + name)


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    return F.when(stat(under) > 0, stat(over) / stat(under)).otherwise(0.0)


def base_failed() -> Column:
    return (stat("n_words") < 50) | (100 * stat("n_repeat_words") > 50 * stat("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold


def grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int) -> list[Condition]:
    """Adds the condition of the largest information gain until the rule covers no good row."""
    rule, inside = [], np.ones(len(x), bool)
    while len(rule) < most and (inside & ~bad).any() and (inside & bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best = (1e-9, None, None)
        for f, name in enumerate(names):
            values = np.unique(x[inside, f])
            cuts = np.unique(np.quantile((values[1:] + values[:-1]) / 2, np.linspace(0, 1, 65))) if len(values) > 1 else []
            for cut in cuts:
                for above in (True, False):
                    now = inside & (x[:, f] > cut if above else x[:, f] <= cut)
                    p, n = (now & bad).sum(), (now & ~bad).sum()
                    if p and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > best[0]:
                        best = (gain, Condition(name, above, float(cut)), now)
        if best[1] is None:
            break
        rule, inside = [*rule, best[1]], best[2]
    return rule


def covers(rule: list[Condition], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Condition]:
    """Drops last conditions while that does not worsen (p - n) / (p + n) on rows that the rule was not grown on."""

    def worth(r):
        c = covers(r, x, names)
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / max(p + n, 1)

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.9, least: int = 4, most_rules: int = 16, most_conditions: int = 3) -> list[list[Condition]]:
    """Sequential covering of the bad rows. Rows alternate between growing (two thirds) and pruning (one third).

    A rule stays only if of the rows that it covers, pruning ones included, the share of bad ones is at least ``precision``
    and at least ``least`` are bad; else learning ends. What no rule covers is kept.
    """
    rules, left = [], np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and (left & bad).sum() >= least:
        g, v = left & ~third, left & third
        if not (g & bad).any():
            break
        rule = prune(grow(x[g], bad[g], names, most_conditions), x[v], bad[v], names)
        c = covers(rule, x, names) & left
        p, n = (c & bad).sum(), (c & ~bad).sum()
        held = covers(rule, x[v], names)
        hp, hn = (held & bad[v]).sum(), (held & ~bad[v]).sum()
        if not rule or p < least or p < precision * (p + n) or hp < precision * (hp + hn):
            break
        rules.append(rule)
        left &= ~c
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one expression: the first rule that holds rejects; true if none does."""
    out = F
    for rule in rules:
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = out.when(holds, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, **options) -> list[list[Condition]]:
    """Learns from at most ``most_rows`` labelled documents, dealt by a hash of their id; the ids are broadcast, never the texts."""
    some = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_kl_q"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    )
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    joined = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_kl_q").alias("_kl_q"))  # one row an id, so most_rows at most
    names = list(FEATURES)
    got = with_statistics(joined).select(base_failed().alias("_kl_failed"), "doc_id", "_kl_q", *(feature(f).alias(f) for f in names)).collect()
    rows = sorted(tuple(r)[1:] for r in got if not r["_kl_failed"])
    if not rows:
        return []
    x = np.array([r[2:] for r in rows], float)
    return learn(x, np.array([r[1] == 0 for r in rows]), names, **options)


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` whole, with struct ``_kl_s`` of counts and booleans ``_kl_failed`` (base rules) and ``_kl_kept``."""
    rules = fit(docs, labels, **options)
    judged = with_statistics(docs)
    return judged.withColumns({"_kl_failed": base_failed(), "_kl_kept": ~base_failed() & verdict(rules)})


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the base rules and the learned list."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *(stat(s).alias(s) for s in STATS), F.col("_kl_failed").alias("base_failed"), F.col("_kl_kept").alias("kept"))
