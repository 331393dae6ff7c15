"""Per-round scalars. Each takes a column or a plain number and returns a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Learning rate start and decay, the round after which epochs double,
# and the tree target by first round it holds from.
ETA_START = 0.01
ETA_DECAY = 0.1
DOUBLE_AFTER_ROUND = 5
TREE_STEPS = ((1, 10), (2, 15), (4, 20))
SGD_LOSSES = ("hinge", "modified_huber")


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def eta0(round_no):
    """Step size of a round; takes and gives a column or a number."""
    return ETA_START / (1.0 + ETA_DECAY * round_no)


def epochs_for(round_no, local_epochs: int, loss: str) -> Column:
    """Local epochs of a round; only the SGD losses double them in late rounds."""
    if loss not in SGD_LOSSES:
        return F.lit(local_epochs)
    late = _column(round_no) > DOUBLE_AFTER_ROUND
    return F.when(late, F.lit(2 * local_epochs)).otherwise(F.lit(local_epochs))


def epochs_in_round(round_no: int, local_epochs: int, loss: str) -> int:
    """`epochs_for` for the driver's round loop."""
    doubled = loss in SGD_LOSSES and round_no > DOUBLE_AFTER_ROUND
    return local_epochs * (2 if doubled else 1)


def trees_for(round_no) -> Column:
    """Tree target of a round."""
    target = F.lit(TREE_STEPS[0][1])
    for first_round, trees in TREE_STEPS[1:]:
        target = F.when(_column(round_no) >= first_round, F.lit(trees)).otherwise(target)
    return target


def trees_in_round(round_no: int) -> int:
    """`trees_for` for the driver's round loop."""
    return max(trees for first_round, trees in TREE_STEPS if round_no >= first_round)
