"""Element-wise loss terms on scaled ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lobbylens.functions import ladder

# Rating scale and the weights of the composite loss.
MMR_SCALE = 2500.0
HUBER_DELTA = 1.0
PINBALL_QUANTILES = (0.1, 0.25, 0.75, 0.9)
PINBALL_THRESHOLD = 1400.0
PINBALL_HIGH_WEIGHT = 0.3
PINBALL_ALL_WEIGHT = 0.06
ORDINAL_WEIGHT = 0.2
PAIRWISE_WEIGHT = 0.1
SPREAD_WEIGHT = 0.2
SPREAD_FLOOR = 1.0e-5
PAIR_MARGIN = 50.0
PAIR_MIN_GAP = 25.0
LOGIT_LIMIT = 40.0


def is_known(target: Column) -> Column:
    """Unknown targets are NULL inside and 0 at the edges; neither counts."""
    return F.coalesce(target > 0, F.lit(False))


def scaled_error(pred: Column, target: Column) -> Column:
    return pred / F.lit(MMR_SCALE) - target / F.lit(MMR_SCALE)


def huber(diff: Column, delta: float = HUBER_DELTA) -> Column:
    inner = F.least(F.abs(diff), F.lit(delta))
    return F.lit(0.5) * inner * inner + (F.abs(diff) - inner) * F.lit(delta)


def pinball(diff: Column, quantiles: Sequence[float] = PINBALL_QUANTILES) -> Column:
    """Mean pinball loss over the quantiles. The quantile weights only need their mean."""
    mean = sum(quantiles) / len(quantiles)
    under, over = F.greatest(-diff, F.lit(0.0)), F.greatest(diff, F.lit(0.0))
    return under * F.lit(mean) + over * F.lit(1.0 - mean)


def pinball_term(diff: Column, target: Column) -> Column:
    high = F.when(target > PINBALL_THRESHOLD, F.lit(PINBALL_HIGH_WEIGHT)).otherwise(F.lit(0.0))
    return pinball(diff) * (high + F.lit(PINBALL_ALL_WEIGHT))


def _boundaries() -> Column:
    return F.expr("array(" + ",".join(f"{b}D" for b in ladder.ORDINAL_BOUNDARIES) + ")")


def ordinal_targets(target: Column) -> Column:
    """21 flags: target strictly above each boundary."""
    return F.transform(_boundaries(), lambda b: F.when(target > b, F.lit(1)).otherwise(F.lit(0)))


def ordinal_rank(logits: Column) -> Column:
    """Number of positive logits -> rank index 1..22."""
    positive = F.size(F.filter(logits, lambda x: x > 0))
    return (F.least(positive, F.lit(len(ladder.ORDINAL_BOUNDARIES))) + 1).cast("int")


def ordinal_bce(logits: Column, target: Column) -> Column:
    """Sum of binary cross-entropies over the boundaries, logits held to +-40."""

    def log_sigmoid(x: Column) -> Column:
        return -F.log1p(F.exp(-x))

    held = F.transform(logits, lambda x: F.greatest(F.lit(-LOGIT_LIMIT), F.least(x, F.lit(LOGIT_LIMIT))))
    terms = F.zip_with(
        ordinal_targets(target), held, lambda y, x: -F.when(y == 1, log_sigmoid(x)).otherwise(log_sigmoid(-x))
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def pair_hinges(lobby: Column) -> Column:
    """Hinge of every ordered pair of a lobby whose targets differ by more than 25.

    `lobby` is an array of at most six (target, pred) structs, so pairs never
    become rows.
    """
    return F.flatten(
        F.transform(
            lobby,
            lambda i: F.transform(
                F.filter(lobby, lambda j: i["target"] - j["target"] > PAIR_MIN_GAP),
                lambda j: F.greatest(
                    F.lit(0.0),
                    F.lit(PAIR_MARGIN / MMR_SCALE) - (i["pred"] / F.lit(MMR_SCALE) - j["pred"] / F.lit(MMR_SCALE)),
                ),
            ),
        )
    )


def spread_gap(std_target: Column, std_pred: Column) -> Column:
    gap = F.greatest(F.lit(0.0), std_target - std_pred)
    return gap * gap
