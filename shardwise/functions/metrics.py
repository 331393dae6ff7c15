"""Binary classification metrics as expressions over the four confusion counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardwise.config import IMBALANCE

# Fixed value: probabilities are kept this far from 0 and 1 (double precision epsilon).
CLIP = 2.220446049250313e-16


def confusion_counts(label: Column, pred: Column) -> dict[str, Column]:
    """Aggregates for TN, FP, FN and TP; classes are fixed to 0 and 1."""
    return {
        "tn": F.count_if((label == 0) & (pred == 0)),
        "fp": F.count_if((label == 0) & (pred == 1)),
        "fn": F.count_if((label == 1) & (pred == 0)),
        "tp": F.count_if((label == 1) & (pred == 1)),
    }


def _ratio(top: str, bottom: str) -> str:
    """A quotient that is 0 where the denominator is."""
    return f"CASE WHEN {bottom} > 0 THEN ({top}) / ({bottom}) ELSE 0D END"


def metric_columns(average: str = "auto") -> dict[str, Column]:
    """Accuracy, precision, recall, F1 and error rates from columns tn, fp, fn, tp.

    `average`: "binary" rates class 1, "weighted" averages both classes by support, "auto" weights
    only where one class holds more than the imbalance share of the labels.
    """
    total, negative, positive = "tn + fp + fn + tp", "tn + fp", "fn + tp"

    def averaged(of_negative: str, of_positive: str) -> str:
        weighted = _ratio(f"({negative}) * ({of_negative}) + ({positive}) * ({of_positive})", total)
        skewed = f"greatest({negative}, {positive}) / ({total}) > {IMBALANCE}D"
        forms = {"binary": of_positive, "weighted": weighted, "auto": f"CASE WHEN {skewed} THEN {weighted} ELSE {of_positive} END"}
        return forms[average]

    columns = {
        "accuracy": _ratio("tn + tp", total),
        "precision": averaged(_ratio("tn", "tn + fn"), _ratio("tp", "tp + fp")),
        "recall": averaged(_ratio("tn", negative), _ratio("tp", positive)),
        "f1_score": averaged(_ratio("2 * tn", "2 * tn + fn + fp"), _ratio("2 * tp", "2 * tp + fp + fn")),
        "false_positive_rate": _ratio("fp", negative),
        "false_negative_rate": _ratio("fn", positive),
    }
    return {name: F.expr(sql) for name, sql in columns.items()}


def hinge_row(label: Column, decision: Column, signed: bool = False) -> Column:
    """Hinge loss of a row; by default with labels 0 and 1, so a negative row always costs 1."""
    y = F.lit(2.0) * label - F.lit(1.0) if signed else label.cast("double")
    return F.greatest(F.lit(0.0), F.lit(1.0) - y * decision)


def log_loss_row(label: Column, proba: Column) -> Column:
    """Log loss of a row; null where there is no finite probability."""
    p = F.least(F.greatest(proba, F.lit(CLIP)), F.lit(1.0 - CLIP))
    cost = F.when(label == 1, -F.log(p)).otherwise(-F.log(F.lit(1.0) - p))
    return F.when(proba.isNotNull() & ~F.isnan(proba), cost)
