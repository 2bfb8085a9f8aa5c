"""Evidence combination: noisy-OR, fusion, override ladder, decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import refdata


def noisy_or(weights: Column) -> Column:
    """1 - product of (1 - w) over an array of weights; 0 for an empty one."""
    return F.lit(1.0) - F.aggregate(weights, F.lit(1.0), lambda a, w: a * (F.lit(1.0) - w))


def fuse(scores: dict[str, Column]) -> Column:
    """Weighted mean of the scores that exist, weights renormalised and rounded to 4 digits; a strong peak is kept at 85 %."""
    base = dict(refdata.FUSION_WEIGHTS)
    total = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), base[n]).otherwise(0.0) for n, c in scores.items()])
    linear = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.round(F.lit(base[n]) / total, 4) * c).otherwise(0.0) for n, c in scores.items()])
    linear = F.when(total > 0, linear).otherwise(0.0)
    peak = F.coalesce(F.greatest(*scores.values()), F.lit(0.0))
    return F.when(peak >= 85, F.greatest(linear, peak * 0.85)).otherwise(linear)


def override(final: Column, nlp: Column, meta: Column, hard_bad: Column, strong_brand: Column, trusted: Column, evasion: Column, families: Column, verified: Column, guard: Column) -> Column:
    """The ladder of floors, caps and discounts; its order is its meaning.

    Each step names the score so far once (the one for evasion twice), so the expression stays as long as the ladder;
    a condition that doesn't hold gives null, which neither greatest nor least looks at.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    soft = ~hard_bad & ~strong_brand
    final = F.greatest(final, F.when(hard_bad, 92.0), F.when(strong_brand & (zero(nlp) >= 40), 85.0))
    final = F.least(F.lit(100.0), final + F.when(evasion & (final >= 30), 8.0).otherwise(0.0))
    final = F.least(final, F.when(trusted & soft & (zero(meta) < 40), F.when(zero(nlp) >= 70, 45.0).otherwise(30.0)), F.when(soft & (families == 0), 40.0).when(soft & (families == 1), 55.0))
    final = final * F.when(verified & soft, 0.6).otherwise(1.0)
    final = F.greatest(final, F.when(guard, refdata.THRESHOLDS[0] + 5))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), final))


def conflict(nlp: Column, url: Column, ti: Column, graph: Column, clean_votes: Column) -> Column:
    """Whether threat intelligence and the other sources contradict each other."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.coalesce(ti.isNotNull() & (((clean_votes > 0) & (zero(graph) >= 60)) | ((ti >= 70) & (zero(nlp) < 20) & (zero(url) < 30))), F.lit(False))


def decision(score: Column) -> Column:
    """ALLOW, FLAG, QUARANTINE or BLOCK; lower bounds belong to the higher one."""
    flag, hold, block = refdata.THRESHOLDS
    return F.when(score >= block, "BLOCK").when(score >= hold, "QUARANTINE").when(score >= flag, "FLAG").otherwise("ALLOW")


def text_score(model: Column, intent: Column, has_intent: Column) -> Column:
    """Model probability and intents as one score of 0 to 1; without a model the intents alone."""
    return F.when(model.isNull(), intent).when(~has_intent, model * 0.6).otherwise(1 - (1 - model) * (1 - intent * 0.75))
