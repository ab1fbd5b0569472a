"""Operator 5: quality rules learned as a decision list, in DataFrame functions only.

Statistics of each text are array expressions on its own row: one pass, no
shuffle.  The list is learned by sequential covering on labelled rows: a rule grows
threshold by threshold (information gain), is pruned on held-out rows, and what it covers is
set aside before the next one.  Each step is one aggregation of histogram
counts over the staged labelled statistics, so the driver sees a few hundred
counts and never a row.  The list comes out as one ordered conditional expression.

Edge cases: null text has no words, symbols or lines, and fails the base rule; labels
without a document, without a quality, or in conflict (the worse one
counts) are defined so; without labels, or with labels of one kind, the list is
empty and only the base rule speaks; rows that repeat a doc_id or lack one are judged by
their own texts; an empty table gives an empty result; other columns are carried
by ``drop_low_quality`` and otherwise not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WS_CLASS, documents, key_and_text, own_name, stage, text_hash

WS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Labelled rows that are used at most (a hash of doc_id decides which); the only bound, and only on learning.
MAX_LABELLED = 1_000_000
CUTS, MAX_RULES, MAX_CONDITIONS, MIN_COVER, MIN_PRECISION = 32, 8, 3, 5, 0.9
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: Column) -> dict[str, Column]:
    """Names and expressions over a text column that is never null; kept apart by ``measure`` so that arrays are made once."""
    squeezed = F.translate(text, WS, "")
    return {
        "word_chars": F.length(squeezed).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its own columns and the statistics."""
    own = docs.columns
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, WS, "") != "")
    df = docs.withColumn("_trim", F.btrim(text, F.lit(WS)))
    df = df.select(*own, F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", WS_CLASS, -1)).alias("_w"), lines.alias("_l"), *(c.alias(k) for k, c in statistics(F.col(text)).items()))
    several = F.size("_w") >= 3
    triple = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.select(
        *own, "word_chars", "n_symbols", F.size("_w").cast("long").alias("n_words"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(several, triple).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(repeats, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda i, j: F.get("_s", i)["x"] == F.get("_s", j)["x"]
    at = F.transform("_s", lambda s, i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), s["i"]))
    df = df.withColumn("_p", F.array_sort(F.filter(at, lambda p: p.isNotNull())))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")))
    df = df.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select(*own, *BASE, failed.alias("base_failed"))


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "chars_per_word": F.col("word_chars") / words,
        "duplicate_lines_per_word": F.col("n_dup_lines") / words,
        "repeated_share": F.col("n_repeat_words") / words,
        "words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (from 1), 0 for none: an ordered conditional expression."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        holds = F.lit(True)
        for c in rules[k - 1]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(k)).otherwise(out)
    return out


def learn(rows: DataFrame) -> list[Rule]:
    """``rows``: the statistics with ``bad`` (boolean) and ``doc_id``."""
    named = features()
    names = list(named)
    rows = stage(rows.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), *(c.alias(k) for k, c in named.items())), "labelled")
    points = F.array(*(F.lit(i / CUTS) for i in range(CUTS + 1)))
    got = rows.groupBy("bad").agg(*(F.percentile_approx(k, points, 10_000).alias(k) for k in names)).collect()  # two rows
    if len(got) < 2:
        return []
    cuts = {}
    for k in names:
        values = sorted({v for r in got for v in r[k]})
        cuts[k] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]

    def bin_of(k: str) -> Column:
        own = F.array(*map(F.lit, cuts[k])) if cuts[k] else F.array().cast("array<double>")
        return F.size(F.filter(own, lambda t: F.col(k) > t)).alias(k)

    bins = stage(rows.select("bad", "grow", *map(bin_of, names)), "bins")

    def column(c: tuple[str, bool, int]) -> Column:
        return F.col(c[0]) > c[2] if c[1] else F.col(c[0]) <= c[2]

    def counts(df: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        stacked = df.select("bad", F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(k).alias("b")) for k in names))).alias("x"))
        out: dict[str, dict[int, tuple[int, int]]] = {k: {} for k in names}
        for r in stacked.groupBy("x.f", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect():  # bins of all features
            out[r["f"]][r["b"]] = (r["p"], r["n"])
        return out

    def covered(df: DataFrame, rule) -> DataFrame:
        for c in rule:
            df = df.where(column(c))
        return df

    left, rules = bins, []
    while len(rules) < MAX_RULES:
        rule: list[tuple[str, bool, int]] = []
        growing = left.where("grow")
        while len(rule) < MAX_CONDITIONS:
            table = counts(covered(growing, rule))
            p0, n0 = (sum(x[i] for x in table[names[0]].values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for k in names:
                for cut in range(len(cuts[k])):
                    p, n = (sum(x[i] for b, x in table[k].items() if b > cut) for i in (0, 1))
                    for above, p1, n1 in ((True, p, n), (False, p0 - p, n0 - n)):
                        if p1 >= MIN_COVER:
                            gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                            best = max(best, (gain, (k, above, cut)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        # Prune: the leading conditions that do best on held-out rows.
        tested = left.where("not grow").agg(*(x for m in range(1, len(rule) + 1) for holds in [_all(column(c) for c in rule[:m])] for x in (F.count_if(holds & F.col("bad")), F.count_if(holds & ~F.col("bad"))))).first()
        scores = [((p - n) / (p + n) if p + n else -1.0, -m, p, n) for m in range(len(rule)) for p, n in [(tested[2 * m] or 0, tested[2 * m + 1] or 0)]]
        _, m, p, n = max(scores)
        if p + n == 0 or p / (p + n) < MIN_PRECISION:
            break
        rule = rule[: 1 - m]
        rules.append(tuple(Condition(k, above, cuts[k][cut]) for k, above, cut in rule))
        left = left.where(~_all(column(c) for c in rule))
    return rules


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def labelled(stats: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Statistics of labelled rows that the base rule leaves to the list."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    share = min(1.0, most / max(1, marks.count()))
    if share < 1:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return stats.join(marks, "doc_id").where("not base_failed")


def quality_rules(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Statistics, base verdict, first rule that holds and ``kept`` for every row; and the rules."""
    stats = stage(measure(key_and_text(docs)).drop("text"), "statistics")
    rules = learn(labelled(stats, labels))
    first = F.when(F.col("base_failed"), F.lit(None).cast("int")).otherwise(verdict(rules))
    return stats.withColumn("rule", first).withColumn("kept", F.coalesce(F.col("rule") == 0, F.lit(False))), rules


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rule and the learned list keep, all columns.

    Decisions are staged first: a filter over the array expressions would be pushed into
    them and split every text again for each word.
    """
    hashed = key_and_text(docs).withColumn("_key", text_hash())
    stats = stage(measure(hashed).drop("text"), "statistics")
    rules = learn(labelled(stats, labels))
    k, h = own_name(docs, "_k"), own_name(docs, "_h")
    kept = stats.where(~F.col("base_failed") & (verdict(rules) == 0)).select(F.col("doc_id").alias(k), F.col("_key").alias(h)).distinct()
    own = docs["doc_id"].cast("long").eqNullSafe(F.col(k)) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col(h))
    return docs.join(kept, own, "left_semi")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "rule")
