"""Run parameters of the three training jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Metric names and their order in every log and report.
METRICS = ("accuracy", "precision", "recall", "f1_score", "false_positive_rate", "false_negative_rate")
LOG_METRICS = ("loss", *METRICS)

# A class share above this makes a label set "imbalanced".
IMBALANCE = 0.7


# The defaults of the jobs below.


@dataclass(frozen=True)
class LinearConfig:
    """One federated linear run; the defaults are those of the logistic job."""

    rounds: int = 10
    clients: int = 25
    loss: str = "log_loss"
    penalty: str | None = "l2"
    local_epochs: int = 20
    balance: str | None = "undersample"
    ratio: float = 1.0
    fit_fraction: float = 0.6
    evaluate_fraction: float = 0.8
    min_clients: int = 2
    min_available: int = 2
    test_fraction: float = 0.2
    central_clients: tuple[int, ...] = (0, 1, 2)
    scaler_scope: str = "first"
    l1_ratio: float = 0.15
    fit_intercept: bool = True
    learner: str = "batch"
    schedule: str = "optimal"
    tol: float | None = 1e-4
    seed: int = 42
    accept_failures: bool = True
    on_incomplete: str = "fail"
    on_round: Callable[[int], dict] | None = field(default=None, compare=False)
    #: (test rows of the central clients, global models with the starting one as round 0) to a table with a round column.
    central_fn: Callable[[DataFrame, DataFrame], DataFrame] | None = field(default=None, compare=False)
    #: (metrics per client and round) to a table with a round column.
    aggregate_fn: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)

    @classmethod
    def svm(cls, **changes) -> "LinearConfig":
        """The defaults of the linear SVM job."""
        base = dict(clients=10, loss="hinge", local_epochs=15, ratio=2.0, fit_fraction=0.5, evaluate_fraction=1.0)
        return cls(**{**base, **changes})


@dataclass(frozen=True)
class ForestConfig:
    """One federated forest run."""

    rounds: int = 5
    clients: int = 10
    trees: int = 10
    depth: int = 3
    fit_fraction: float = 1.0
    evaluate_fraction: float = 1.0
    min_clients: int = 2
    min_available: int = 2
    train_fraction: float = 0.8
    cold_start: bool = True
    legacy_test: bool = False
    seed: int = 42
    on_incomplete: str = "fail"
    on_round: Callable[[int], dict] | None = field(default=None, compare=False)
