"""A learned decision list over text statistics, as one Spark conditional expression."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import base_statistics, labelled_sample, ratios, without_scratch
from .text import packed, unpacked

_READ = ("doc_id", "text")


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction; texts that meet it are rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def _gain(pos: int, neg: int, before_pos: int, before_neg: int) -> float:
    """FOIL's information gain of a narrower rule."""
    if not pos:
        return 0.0
    return pos * (log2(pos / (pos + neg)) - log2(before_pos / (before_pos + before_neg)))


def _candidates(rows: list[dict], statistics: list[str], cuts: int) -> dict[Condition, int]:
    """Threshold conditions with the rows that meet them, as bits of an integer."""
    out = {}
    for name in statistics:
        values = sorted({r[name] for r in rows})
        step = max(1, len(values) // cuts)
        # midway between neighbours, so that a cut does not hang on one row
        for low, high in list(zip(values, values[1:], strict=False))[::step]:
            at = (low + high) / 2
            above = sum(1 << i for i, r in enumerate(rows) if r[name] > at)
            out[Condition(name, True, at)] = above
            out[Condition(name, False, at)] = ~above & ((1 << len(rows)) - 1)
    return out


def learn_decision_list(
    rows: list[dict], statistics: list[str], weights: dict[int, float], max_conditions: int = 3, max_rules: int = 24, cuts: int = 40, precision: float = 0.8, tries: int = 12
) -> list[Rule]:
    """Sequential covering for class 0 on a bounded sample of statistics.

    A rule grows on two thirds of the rows by the condition of highest information gain and is
    pruned from its end on the other third, by weighted (p - n) / (p + n). It joins the list if it
    covers class 0 with ``precision`` there, and the rows that it covers leave. If it does not, its
    first condition is set aside; after ``tries`` such rules in a row the search ends.
    """
    grow_all = sum(1 << i for i, r in enumerate(rows) if r["order"] % 3)
    prune_all = ((1 << len(rows)) - 1) & ~grow_all
    bad = sum(1 << i for i, r in enumerate(rows) if r["y"] == 0)
    met = _candidates(rows, statistics, cuts)
    w_bad, w_good = weights.get(0, 1.0), weights.get(1, 1.0)

    def worth(cover: int) -> float:
        p, n = (cover & bad).bit_count() * w_bad, (cover & ~bad).bit_count() * w_good
        return (p - n) / (p + n) if p + n else -1.0

    out: list[Rule] = []
    aside: set[Condition] = set()
    while len(out) < max_rules and len(aside) < tries:
        conditions, cover = [], grow_all
        while len(conditions) < max_conditions and cover & ~bad and cover & bad:
            p, n = (cover & bad).bit_count(), (cover & ~bad).bit_count()
            best, gain = None, 0.0
            for c, bits in met.items():
                if not conditions and c in aside:
                    continue
                both = cover & bits
                g = _gain((both & bad).bit_count(), (both & ~bad).bit_count(), p, n)
                if g > gain + 1e-9:
                    best, gain = c, g
            if best is None:
                break
            conditions.append(best)
            cover &= met[best]
        if not conditions:
            break

        def covered(many: int, rows: int, conditions: list[Condition] = conditions) -> int:
            for c in conditions[:many]:
                rows &= met[c]
            return rows

        many = max(range(1, len(conditions) + 1), key=lambda m: (worth(covered(m, prune_all)), -m))
        if worth(covered(many, prune_all)) < 2 * precision - 1:
            aside.add(conditions[0])
            continue
        out.append(Rule(tuple(conditions[:many])))
        aside.clear()
        grow_all &= ~covered(many, grow_all)
        prune_all &= ~covered(many, prune_all)
    return out


def verdict(rules: list[Rule]) -> Column:
    """The first rule that a text meets rejects it; otherwise it is kept."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), False)
    for r in rules[1:]:
        out = out.when(r.column(), False)
    return out.otherwise(True)


def rule_number(rules: list[Rule]) -> Column:
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].column(), 1)
    for i, r in enumerate(rules[1:], 2):
        out = out.when(r.column(), i)
    return out.cast("int")


def fit_quality_rules(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> list[Rule]:
    """Rules from at most ``per_class`` labelled texts of each class, held-out rows excepted.

    Null text counts as empty; labels other than 0 and 1 and null ids are left out; of repeated
    labels of a doc_id the highest counts. Without labels of class 0 there are no rules.
    """
    sample, weights = labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), "quality", per_class)
    rows, names = ratios(base_statistics(sample))
    found = rows.select("y", F.col("__order").alias("order"), *names).orderBy("order", *names).limit(2 * per_class).collect()
    return learn_decision_list([r.asDict() for r in found], names, weights)


def apply_quality_rules(docs: DataFrame, rules: list[Rule], min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Add the base statistics, base_failed, rule (int, the one that rejects) and kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in
    repeated windows. kept is false if base_failed, else the list's verdict. Columns of these
    names are replaced, others stay as they are (names that begin with two underscores are reserved);
    a null or empty text has no words and fails the base rules; an empty table gives no rows.
    """
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    added = [*base, "base_failed", "rule", "kept"]
    clean = docs.drop(*added)
    rows, _ = ratios(base_statistics(packed(clean, _READ)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("rule", rule_number(rules)).withColumn("kept", ~failed & verdict(rules))
    return without_scratch(rows).select(*unpacked(clean.columns, _READ), *added)
