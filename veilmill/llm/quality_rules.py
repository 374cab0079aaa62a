"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditionals.

Labelled statistics are cut at quantiles into a few bins per feature and counted by cell. Each rule grows by the
condition with the best information gain on two thirds of the labelled rows, loses conditions again where that helps
on the other third, and is accepted if it is precise there. The rows that it covers leave and the next rule begins.
Every count is a Spark aggregate over all labelled rows; the driver sees a table of features times bins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .textstats import COUNTS, FEATURES, with_features, with_stats

#: Most documents below these are no prose; they fail before any learned rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"f_{self.feature}")
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return "reject if " + " and ".join(map(str, self.conditions))


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def rejected(rules: list[Rule]) -> Column:
    """The 1-based number of the first rule that rejects a row, else 0, as one ordered conditional."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), F.lit(i)).otherwise(out)
    return out


class _Cells:
    """Labelled rows counted by bin of each feature; all questions of the learner go through counts()."""

    def __init__(self, labelled: DataFrame, bins: int):
        self.features = list(FEATURES)
        steps = [i / bins for i in range(1, bins)]
        found = labelled.agg(*(F.percentile_approx(f"f_{f}", steps, 10_000).alias(f) for f in self.features)).first()
        self.cuts = {f: sorted(set(found[f] or [])) for f in self.features}
        binned = [F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in self.cuts[f])}), c -> f_{f} >= c))").alias(f) for f in self.features]
        self.cells = written(labelled.select("bad", "grow", *binned).groupBy("bad", "grow", *self.features).agg(F.count("*").alias("n")), "quality-cells")

    def where(self, c: Condition) -> Column:
        at = self.cuts[c.feature].index(c.threshold) + 1
        return F.col(c.feature) >= at if c.at_least else F.col(c.feature) < at

    def all_of(self, conditions: tuple[Condition, ...]) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & self.where(c)
        return out

    def counts(self, left: Column, grow: bool) -> dict[str, dict[int, tuple[int, int]]]:
        """By feature and bin: rows of the bad and of the good class among those that are left."""
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in self.features)))
        rows = self.cells.where(left & (F.col("grow") == F.lit(grow))).select("bad", "n", pairs.alias("p")).groupBy("p.feature", "p.bin").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("q"))
        out: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in self.features}
        for r in rows.collect():  # features times bins at most
            out[r["feature"]][r["bin"]] = (r["p"], r["q"])
        return out

    def covered(self, left: Column, conditions: tuple[Condition, ...], grow: bool) -> list[tuple[int, int]]:
        """Bad and good rows that the first 1, 2, ... conditions cover."""
        sums = []
        for i in range(len(conditions)):
            hit = self.all_of(conditions[: i + 1])
            sums += [F.sum(F.when(hit & F.col("bad"), F.col("n")).otherwise(0)), F.sum(F.when(hit & ~F.col("bad"), F.col("n")).otherwise(0))]
        got = self.cells.where(left & (F.col("grow") == F.lit(grow))).agg(*(x.alias(f"x{i}") for i, x in enumerate(sums))).first()
        return [(got[2 * i] or 0, got[2 * i + 1] or 0) for i in range(len(conditions))]


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    """First-order information gain of narrowing (p0, n0) to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def _best(cells: _Cells, left: Column) -> tuple[Condition, int, int] | None:
    best = None
    for feature, by_bin in cells.counts(left, True).items():
        p0, n0 = (sum(x[i] for x in by_bin.values()) for i in (0, 1))
        below = [0, 0]
        for at, cut in enumerate(cells.cuts[feature]):
            below = [below[i] + by_bin.get(at, (0, 0))[i] for i in (0, 1)]
            for at_least, (p, n) in ((True, (p0 - below[0], n0 - below[1])), (False, (below[0], below[1]))):
                gain = _gain(p0, n0, p, n)
                if gain > 1e-9 and p + n < p0 + n0 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, Condition(feature, at_least, cut), p, n)
    return best and best[1:]


def learn(stats: DataFrame, labels: DataFrame, bins: int = 32, max_rules: int = 8, max_conditions: int = 4, min_precision: float = 0.9, min_share: float = 0.005) -> list[Rule]:
    """Rules that reject what labels mark as quality 0.

    stats: doc_id with features; labels: doc_id, quality. Rows whose doc_id or quality is null teach nothing. Without
    bad or without good rows there are no rules. A document that is labelled more than once counts once per label.
    A rule stays if at least min_precision of what it covers is bad in either part, and if it covers min_share of the
    labelled rows; repeated runs over the same rows agree.
    """
    labelled = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad")).join(stats, "doc_id")
    labelled = labelled.withColumn("grow", F.expr("pmod(xxhash64(doc_id), 3) > 0"))
    cells = _Cells(labelled, bins)
    total = cells.cells.agg(F.sum("n")).first()[0] or 0
    rules: list[Rule] = []
    left = F.lit(True)
    while total and len(rules) < max_rules:
        conditions: tuple[Condition, ...] = ()
        while len(conditions) < max_conditions and (found := _best(cells, left & cells.all_of(conditions))):
            conditions += (found[0],)
            if found[2] == 0:
                break
        if not conditions:
            break
        on_prune = cells.covered(left, conditions, False)
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in on_prune]
        keep = worth.index(max(worth)) + 1
        on_grow = cells.covered(left, conditions[:keep], True)[-1]
        p, n = (a + b for a, b in zip(on_grow, on_prune[keep - 1], strict=True))
        if p + n == 0 or p < min_precision * (p + n) or on_grow[0] < min_precision * sum(on_grow) or p + n < min_share * total:
            break
        rules.append(Rule(conditions[:keep]))
        left = left & ~cells.all_of(conditions[:keep])
    return rules


def judge(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule for each row of docs.

    rule: number of the learned rule that rejects it, 0 for none. Null and empty texts have no words and so fail the
    base test. Empty docs give an empty result; empty labels leave the base test alone. Further columns of docs are
    ignored.
    """
    stats = written(with_features(with_stats(docs.select("doc_id", "text"), ("doc_id",))), "quality-stats")
    rules = learn(stats, labels, **params)
    return _verdict(stats, rules).select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def _verdict(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rejected(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs, all their columns, that judge() keeps.

    The statistics are written beside the rows, so each text is read once and never shuffled, and the verdict is a
    filter over written columns.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text")
    stats = written(with_features(with_stats(rows, ("doc", "doc_id"))), "quality-rows")
    rules = learn(stats.drop("doc"), labels, **params)
    return _verdict(stats, rules).where("kept").select("doc.*")
