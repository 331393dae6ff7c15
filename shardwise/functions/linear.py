"""Column expressions of the linear models: scores, loss gradients and the weight step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to this width a score is written out term by term and stays in generated code.
UNROLL = 32


def decision(x: Column, coef: Column, intercept: Column, width: int | None = None) -> Column:
    """w . x + b; a missing intercept counts as 0."""
    bias = F.coalesce(intercept, F.lit(0.0))
    if width is not None and width <= UNROLL:
        total = bias
        for i in range(width):
            total = total + F.get(x, F.lit(i)) * F.get(coef, F.lit(i))
        return total
    return F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), bias, lambda acc, v: acc + v)


def predicted_class(f: Column) -> Column:
    """1 where the decision value is positive."""
    return (f > 0).cast("int")


def sigmoid(f: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-f))


def probability(f: Column, loss: str) -> Column:
    """Probability of class 1; the hinge model gives none."""
    if loss == "hinge":
        return F.lit(None).cast("double")
    if loss == "modified_huber":
        return (F.least(F.greatest(f, F.lit(-1.0)), F.lit(1.0)) + 1.0) / 2.0
    return sigmoid(f)


def residual(label: Column, f: Column, loss: str) -> Column:
    """Derivative of the row loss by the decision value."""
    z = F.lit(2.0) * label - F.lit(1.0)
    if loss == "hinge":
        return F.when(z * f < 1, -z).otherwise(F.lit(0.0))
    if loss == "modified_huber":
        inner = -2.0 * z * (1.0 - z * f)
        return F.when(z * f >= 1, F.lit(0.0)).when(z * f > -1, inner).otherwise(-4.0 * z)
    return sigmoid(f) - label


def penalty_parts(penalty: str | None, l1_ratio: float) -> tuple[float, float]:
    """Shares of the strength that act as l1 and as l2."""
    if penalty in (None, "none"):
        return 0.0, 0.0
    if penalty == "l1":
        return 1.0, 0.0
    if penalty == "l2":
        return 0.0, 1.0
    if penalty == "elasticnet":
        return l1_ratio, 1.0 - l1_ratio
    raise ValueError(f"unknown penalty: {penalty}")


def stepped_weight(w: Column, gradient: Column, step: Column, strength: Column, penalty: str | None, l1_ratio: float = 0.15) -> Column:
    """One penalised gradient step of one weight: soft threshold for l1, shrink for l2."""
    l1, l2 = penalty_parts(penalty, l1_ratio)
    moved = w - step * gradient
    if l1:
        moved = F.signum(moved) * F.greatest(F.abs(moved) - step * strength * F.lit(l1), F.lit(0.0))
    if l2:
        moved = moved / (F.lit(1.0) + step * strength * F.lit(l2))
    return moved
