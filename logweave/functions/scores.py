"""Scores, losses and decays as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECAY_HOURS = (1, 6, 24)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + e^x), without overflow for large x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce(logit: Column, label: Column) -> Column:
    """Binary cross-entropy of a logit and a 0/1 label."""
    return softplus(logit) - logit * label.cast("double")


def focal_bce(logit: Column, label: Column, gamma: float = 2.0) -> Column:
    """Cross-entropy that counts what is already right less."""
    p, y = sigmoid(logit), label.cast("double")
    right = p * y + (1 - p) * (1 - y)
    return F.pow(F.greatest(1 - right, F.lit(1e-6)), gamma) * bce(logit, label)


def slot_nll(logits: Column, target: Column) -> Column:
    """Negative log-likelihood of entry `target` under a softmax of an array; null if the target is -100 or null, which are ignored."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.when(target != -100, F.log(total) + top - F.get(logits, target.cast("int")))


def decays(delta_seconds: Column, hours: tuple[float, ...] = DECAY_HOURS) -> Column:
    """e^(-Δ/h) for each h; a negative Δ counts as 0."""
    delta = F.greatest(delta_seconds.cast("double"), F.lit(0.0)) / 3600
    return F.array(*[F.exp(-delta / h) for h in hours])
