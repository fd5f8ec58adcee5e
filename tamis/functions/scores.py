"""Graded scores: ladders, clamps, fusions. Thresholds are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.text import upper_words

#: Likeness of two texts at least a, relative difference of two amounts at most a, days between two dates at most a.
TEXT_LADDER = ((0.95, 0.0), (0.85, 0.25), (0.70, 0.60))
AMOUNT_LADDER = ((0.02, 0.0), (0.05, 0.25), (0.10, 0.50), (0.20, 0.75))
DATE_LADDER = ((0, 0.0), (31, 0.25), (365, 0.60))
GROUP_LADDER = ((1, 0.0), (2, 0.25), (3, 0.50))
#: Probability of each grade of an anomaly, and of one that isn't known.
GRADES = {"FAIBLE": 0.20, "MOYENNE": 0.40, "FORTE": 0.70, "TRES_FORTE": 0.90}
UNKNOWN_GRADE = 0.40
#: Weights of the signals, and the least fused scores of an extra check and of an escalation.
FUSION_WEIGHTS = {"business": 0.2028, "intra": 0.2551, "inter": 0.1769, "llm": 0.1625, "visual": 0.2027}
FUSION_BANDS = ((0.0243, "EXTRA_CHECK"), (0.0456, "ESCALATE"))


def at_least(c: Column, ladder=TEXT_LADDER, otherwise: float = 1.0) -> Column:
    """The score of the first step that the value reaches; null stays null."""
    return _steps(c, [(c >= t, s) for t, s in ladder], otherwise)


def at_most(c: Column, ladder, otherwise: float = 1.0) -> Column:
    return _steps(c, [(c <= t, s) for t, s in ladder], otherwise)


def _steps(c: Column, steps: list[tuple[Column, float]], otherwise: float) -> Column:
    head = F.when(c.isNull(), F.lit(None).cast("double"))
    return reduce(lambda e, s: e.when(s[0], F.lit(float(s[1]))), steps, head).otherwise(F.lit(float(otherwise)))


def relative_difference(value: Column, reference: Column) -> Column:
    return F.abs(value - reference) / F.greatest(F.abs(reference), F.lit(1.0))


def grade_probability(c: Column, grades: dict[str, float] = GRADES, unknown: float = UNKNOWN_GRADE) -> Column:
    """The probability of a grade, in any case, with or without accents and with any sign between its words."""
    word = lambda x: F.replace(upper_words(x), F.lit(" "), F.lit("_"))
    return F.coalesce(F.create_map(*[x for k, v in grades.items() for x in (F.lit(k.upper()), F.lit(v))])[word(c)], F.lit(unknown))


def noisy_or(p: Column) -> Column:
    """1 minus the product of what each leaves, as an aggregate; 0 for no rows."""
    clamped = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return 1 - F.coalesce(F.product(1 - clamped), F.lit(1.0))


def weighted_sum(weights: dict[str, float]) -> Column:
    """The weighted sum of score columns; a score that is null counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()])


def band(score: Column, steps: list[tuple[float, str]], lowest: str) -> Column:
    """The name of the highest step that the score reaches; steps ascending."""
    return reduce(lambda e, s: e.when(score >= s[0], F.lit(s[1])), list(reversed(steps))[1:], F.when(score >= steps[-1][0], F.lit(steps[-1][1]))).otherwise(F.lit(lowest))


def anchored(raw: Column, low: Column, high: Column, threshold: Column) -> Column:
    """A raw score between two anchors as 0 to 1; where the anchors are missing or not in order, raw / (raw + threshold)."""
    linear = F.least(F.greatest((raw - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    ratio = F.when(raw <= 0, 0.0).otherwise(raw / (raw + threshold))
    return F.when(raw.isNotNull(), F.when(F.coalesce(high > low, F.lit(False)), linear).otherwise(ratio))


def top_mean(values: Column, k: int) -> Column:
    """The mean of the k largest elements of an array."""
    top = F.slice(F.sort_array(values, False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)


def unit_score(c: Column) -> Column:
    """A score outside 0 to 1 is no score."""
    return F.round(F.when(c.between(0, 1), c), 6)
