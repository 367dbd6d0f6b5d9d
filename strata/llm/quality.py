"""Quality rules: a learned decision list over text statistics.

Sequential covering in the manner of rule learners: a rule is a conjunction of thresholds on
document statistics. It is grown on two thirds of the labelled documents, one threshold at a
time by information gain, pruned on the other third, and kept while it is precise there; the
documents it covers leave, and the next rule is learned. The list becomes one ordered Spark
``CASE`` expression. Counting is done by Spark over all labelled rows (one grouped count of
quantile bins for each step); the driver only sees bins x statistics.

Everything is built-in functions: statistics, bins, counts and the final expression.

Defined results: a null or empty text has no words (all statistics zero) and fails the base
test; repeated rows are judged alike; a table without labels gives an empty list, so only the
base test decides; columns beside ``doc_id`` and ``text`` are ignored by :func:`quality_table`
and carried unchanged by :func:`keep_quality`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exprs_sum, fresh, let, staged, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _pairwise(a: Column, shift: int, f) -> Column:
    """f(a[i], a[i + shift]) for every i for which both exist."""
    n = F.greatest(F.size(a) - shift, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, shift + 1, n), f)


def _repeated(halves: Column) -> Column:
    """Number of words that lie in a window found twice or more; ``halves`` are the 64-bit
    hashes of the half windows in text order. A text without two equal half windows has no
    repeated window, so only the others pay for the whole windows and their sort."""
    def places(s):  # of neighbours with one hash, in text order
        pairs = _pairwise(s, 1, lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(
            F.array().cast("array<int>")))
        return F.sort_array(F.array_distinct(F.flatten(pairs)))

    def covered(p):
        gaps = _pairwise(p, 1, lambda a, b: F.least(F.lit(WINDOW), b - a).cast("long"))
        return F.when(F.size(p) > 0, exprs_sum(gaps) + WINDOW).otherwise(0).cast("long")

    def count(h):
        whole = _pairwise(h, WINDOW // 2, lambda a, b: F.xxhash64(a, b))
        in_order = F.sort_array(F.transform(whole, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h),
                      let(in_order, lambda s: let(places(s), covered))).otherwise(F.lit(0).cast("long"))
    return let(halves, count)


def counts(text: Column) -> Column:
    """A struct of counts (long) of ``text``. One expression: every value used twice is bound
    once by :func:`let`, so no list of words is copied between plan nodes."""
    def of(t, w, k):
        h = F.transform(w, lambda x: F.xxhash64(x))
        pair = lambda h, shift: _pairwise(h, shift, lambda a, b: F.xxhash64(a, b))
        halves = let(h, lambda h1: let(pair(h1, 1), lambda h2: pair(h2, 2)))
        only = lambda cls: F.length(F.regexp_replace(t, f"[^{cls}]+", "")).cast("long")
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            only("#*$%&|<>").alias("n_symbols"),
            (F.size(k) - F.size(F.array_distinct(k))).cast("long").alias("n_dup_lines"),
            _repeated(halves).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            only("A-Z").alias("n_upper"), only("0-9").alias("n_digits"), F.size(k).cast("long").alias("n_lines"))

    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: let(lines(t), lambda k: of(t, w, k))))


#: The statistics that rules may use: a share of two counts each.
STATISTICS = {"mean_word": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"),
              "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
              "distinct_share": ("n_distinct", "n_words"), "upper_share": ("n_upper", "word_chars"),
              "digit_share": ("n_digits", "word_chars"), "line_words": ("n_words", "n_lines")}


def statistic(s: str, name: str) -> Column:
    """A statistic as a double; 0 where its divisor is 0."""
    a, b = STATISTICS[name]
    x = lambda f: F.col(f"{s}.{f}").cast("double")
    return x(a) / F.greatest(x(b), F.lit(1.0))


def base_failed(s: str) -> Column:
    return ((F.col(f"{s}.n_words") < MIN_WORDS)
            | (F.col(f"{s}.n_repeat_words") * 100 > F.col(f"{s}.n_words") * MAX_REPEAT_PERCENT))


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    cut: float

    def column(self, s: str) -> Column:
        x = statistic(s, self.statistic)
        return x >= F.lit(self.cut) if self.at_least else x < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.cut:.6g}"


def rule_column(rule: list[Condition], s: str) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(s)
    return out


def decision(rules: list[list[Condition]], s: str) -> Column:
    """True where a rule of the list fires: an ordered CASE, first match wins."""
    if not rules:
        return F.lit(False)
    out = F.when(rule_column(rules[0], s), F.lit(True))
    for r in rules[1:]:
        out = out.when(rule_column(r, s), F.lit(True))
    return out.otherwise(F.lit(False))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gain of narrowing a rule from (p0, n0) to (p, n) covered rows."""
    if p <= 0:
        return -1.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn_rules(labelled: DataFrame, bins: int = 64, min_precision: float = 0.95, min_support: int = 5,
                max_conditions: int = 4) -> list[list[Condition]]:
    """Learn an ordered list of rules for the rows with ``bad`` true.

    ``labelled`` has a struct ``s`` of counts, a boolean ``bad`` and an integer ``fold``
    (0, 1: grow, 2: prune). ``bins`` quantile cuts are tried for each statistic over all
    labelled rows. A rule must reach ``min_precision`` and ``min_support`` on the pruning rows,
    where ``min_support`` counts bad rows; rules are added until none does."""
    stats = list(STATISTICS)
    grid = [i / bins for i in range(1, bins)]
    cuts_row = labelled.select(*[F.percentile_approx(statistic("s", x), grid, 10000).alias(x) for x in stats]).first()
    cuts = {x: sorted(set(cuts_row[x] or [])) for x in stats}
    # the extreme classes are small, so quantiles of all rows alone would be too coarse for them
    bad_row = labelled.where("bad").select(*[F.percentile_approx(statistic("s", x), grid, 10000).alias(x)
                                             for x in stats]).first()
    for x in stats:
        cuts[x] = sorted({*cuts[x], *(bad_row[x] or [])})
    if not any(cuts.values()):
        return []

    def bin_of(x):  # the number of cuts at or below the value
        at = F.array(*[F.lit(float(c)) for c in cuts[x]]).cast("array<double>")
        return F.size(F.filter(at, lambda c: c <= statistic("s", x))).alias(x)

    binned = staged(labelled.select("bad", (F.col("fold") == 2).alias("prune"),
                                    F.struct(*[bin_of(x) for x in stats]).alias("b"))
                    .groupBy("b", "bad", "prune").agg(F.count(F.lit(1)).alias("n")), "quality-bins")

    def on_bins(rule):
        out = F.lit(True)
        for x, ge, k in rule:  # x >= cuts[k] holds in bins above k
            out = out & ((F.col(f"b.{x}") > k) if ge else (F.col(f"b.{x}") <= k))
        return out

    def covered(left, rule, prune):
        return left.where(on_bins(rule) & (F.col("prune") == F.lit(prune)))

    def grow(left):
        rule = []
        while len(rule) < max_conditions:
            rows = (covered(left, rule, False)
                    .select("bad", "n", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.col(f"b.{x}").alias("k"))
                                                            for x in stats])).alias("e"))
                    .groupBy("e.x", "e.k").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"),
                                               F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("q"))
                    .collect())
            if not rows:
                break
            some = rows[0]["x"]
            p0 = sum(r["p"] for r in rows if r["x"] == some)
            n0 = sum(r["q"] for r in rows if r["x"] == some)
            if p0 == 0 or n0 == 0:
                break
            best = (1e-9, None)
            for x in stats:
                hist = {r["k"]: (r["p"], r["q"]) for r in rows if r["x"] == x}
                p = n = 0
                for k in range(len(cuts[x])):
                    a, b = hist.get(k, (0, 0))
                    p, n = p + a, n + b
                    for ge, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        g = _gain(pp, nn, p0, n0)
                        if g > best[0]:
                            best = (g, (x, ge, k))
            if best[1] is None:
                break
            rule = [*rule, best[1]]
        return rule

    def prune(left, rule):
        """The prefix of the conditions with the best (p - n) / (p + n) on the pruning rows."""
        aggs = []
        for i in range(len(rule)):
            c = on_bins(rule[:i + 1])
            aggs += [F.sum(F.when(c & F.col("bad"), F.col("n")).otherwise(0)).alias(f"p{i}"),
                     F.sum(F.when(c & ~F.col("bad"), F.col("n")).otherwise(0)).alias(f"n{i}")]
        row = left.where(F.col("prune")).agg(*aggs).first()
        best = (-2.0, None, 0, 0)
        for i in range(len(rule)):
            p, n = row[f"p{i}"] or 0, row[f"n{i}"] or 0
            v = (p - n) / (p + n) if p + n else -1.0
            if v > best[0]:
                best = (v, rule[:i + 1], p, n)
        return best[1:]

    rules, left = [], binned
    while True:
        rule = grow(left)
        if not rule:
            break
        rule, p, n = prune(left, rule)
        if p < min_support or p < min_precision * (p + n):
            break
        rules.append(rule)
        left = left.where(~on_bins(rule))
    return [[Condition(x, ge, float(cuts[x][k])) for x, ge, k in r] for r in rules]


def labelled_statistics(stats: DataFrame, labels: DataFrame, s: str) -> DataFrame:
    """Join counts (``doc_id``, struct ``s``) with labels (``doc_id``, ``quality`` 0 or 1).

    A document labelled more than once counts as bad if one label says so; null labels and
    null ids are left out. Base failures are decided before, so they teach nothing."""
    lab = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
           .groupBy("doc_id").agg((F.min("quality") == 0).alias("bad")))
    return (stats.where(~base_failed(s)).select("doc_id", F.col(s).alias("s")).join(lab, "doc_id")
            .select("s", "bad", F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("fold")))


def quality_table(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row of ``documents``."""
    stats = staged(documents.select("doc_id", counts(F.col("text")).alias("s")), "quality-statistics")
    rules = learn_rules(labelled_statistics(stats, labels, "s"))
    return stats.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words",
                        base_failed("s").alias("base_failed"),
                        (~base_failed("s") & ~decision(rules, "s")).alias("kept"))


def keep_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with their columns as they are."""
    (s,) = fresh(documents, "quality")
    both = staged(documents.withColumn(s, counts(F.col("text"))), "quality-documents")
    rules = learn_rules(labelled_statistics(both.select("doc_id", s), labels, s))
    return both.where(~base_failed(s) & ~decision(rules, s)).select(*[F.col(f"`{c}`") for c in documents.columns])
