"""Per-segment loss series over epochs: moving average, outliers, best so far.

Rows are keyed by a segment and ordered by a dense, unique 0-based epoch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobbylens.operators.scan import CHUNK, ROW_CHUNK, Fold, attach_group, order_statistics, prefix_scan, scatter, span
from lobbylens.session import materialize

# Smoothing, threshold and streak of the outlier rule.
EMA_ALPHA = 0.3
TOP_FRACTION = 0.99
SUSTAIN = 3
# Longest chunk of the moving average.
EMA_CHUNK = 1 << 16
# Largest exponent (base e) of the rescaling inside a chunk.
RESCALE = 230.0


def _recurrence(df: DataFrame, keys: Sequence[str], order: str, value: str, decay: float, name: str) -> DataFrame:
    """Running y(t) = value(t) + decay * y(t - 1) over a dense whole-number order, from 0.

    Within a chunk y is a running sum of rescaled values; the chunk is as long as the
    rescaling stays far from overflow, whatever the decay. What the chunks before it
    add is the same recurrence over the chunk ends, with decay ** length: four chunks reach
    the end of double precision where that is tiny, else the ends are scanned alike.
    """
    keys = list(keys)
    length = int(max(2, min(EMA_CHUNK, RESCALE // max(-math.log(decay), 1e-300))))
    place = F.pmod(F.col(order), F.lit(length))
    chunked = df.withColumn(CHUNK, span(order, length))
    part = W.partitionBy(*keys, CHUNK).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    base = F.lit(decay)
    local = chunked.withColumn("_local", F.sum(F.col(value) * F.pow(base, -place)).over(part) * F.pow(base, place))
    ends = chunked.groupBy(*keys, CHUNK).agg(F.sum(F.col(value) * F.pow(base, F.lit(length - 1) - place)).alias("_end"))
    step = decay**length
    if step < 1e-80:
        near = W.partitionBy(*keys).orderBy(CHUNK).rangeBetween(-4, -1)
        weighted = F.transform(
            F.collect_list(F.struct(CHUNK, "_end")).over(near),
            lambda e: e["_end"] * F.pow(F.lit(step), F.col(CHUNK) - e[CHUNK] - 1),
        )
        ends = ends.select(*keys, CHUNK, F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x).alias("_carried"))
    else:
        ends = materialize(ends)  # one row per key and chunk, read by each level
        whole = _recurrence(ends.withColumnRenamed(CHUNK, "_to"), keys, "_to", "_end", step, "_carried")
        moved = whole.select(*keys, (F.col("_to") + 1).alias(CHUNK), "_carried")
        ends = ends.select(*keys, CHUNK).join(moved, [*keys, CHUNK], "left")
    joined = local.join(ends, [*keys, CHUNK], "left")
    carried = F.coalesce("_carried", F.lit(0.0)) * F.pow(base, place + 1)
    return joined.select(*df.columns, (F.col("_local") + carried).alias(name))


def moving_average(
    df: DataFrame, keys: Sequence[str], epoch: str, value: str, alpha: float = EMA_ALPHA, name: str = "ema"
) -> DataFrame:
    """Exponential moving average that starts at 0, at every epoch, for any alpha in (0, 1]."""
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must lie in (0, 1]")
    if alpha == 1.0:
        return df.withColumn(name, F.col(value).cast("double"))
    scaled = df.withColumn("_x", F.lit(alpha) * F.col(value))
    return _recurrence(scaled, keys, epoch, "_x", 1.0 - alpha, name).drop("_x")


def top_flags(df: DataFrame, epoch: str, value: str, fraction: float = TOP_FRACTION) -> DataFrame:
    """Mark values at or above the epoch's threshold, sorted[floor(fraction * n)].

    An epoch has one row per segment, so it is as large as the data; its
    threshold comes from the order statistic over ranges and is spread back by
    (epoch, row hash), in as many parts as the largest epoch needs.
    """
    cut = materialize(order_statistics(df, [epoch], value, {"_threshold": lambda n: F.floor(n * F.lit(fraction))}))
    parts = (cut.agg(F.max("n")).first()[0] or 0) // ROW_CHUNK + 1
    joined = attach_group(df, cut.drop("n"), [epoch], scatter(*df.columns, parts=parts))
    return joined.withColumn("is_high", F.col(value) >= F.col("_threshold")).drop("_threshold")


def sustained(df: DataFrame, keys: Sequence[str], epoch: str, flag: str = "is_high", runs: int = SUSTAIN) -> DataFrame:
    """Add the current streak of flagged epochs and whether the row is masked by then.

    A streak is the distance to the newest unflagged epoch; masking is permanent.
    """
    at = F.col(epoch)
    streaks = prefix_scan(df, keys, [epoch], [Fold("_off", "max", F.when(~F.col(flag), at))]).withColumn(
        "streak", (at - F.coalesce("_off", F.lit(-1))).cast("int")
    ).drop("_off")
    streaks = materialize(streaks)
    masked = Fold("_hit", "max", (F.col("streak") >= runs).cast("int"))
    return prefix_scan(streaks, keys, [epoch], [masked]).withColumn("is_masked", F.col("_hit") == 1).drop("_hit")


def best_so_far(df: DataFrame, keys: Sequence[str], epoch: str, value: str) -> DataFrame:
    """Running best, whether this epoch improved it (strictly), and epochs since."""
    pair = F.struct(F.col(value).alias("v"), F.col(epoch).alias("at"))
    scanned = prefix_scan(df, keys, [epoch], [Fold("_best", "min", pair)])
    since = F.col(epoch) - F.col("_best.at")
    return scanned.select(
        *df.columns,
        F.col("_best.v").alias("best"),
        (since == 0).alias("improved"),
        since.cast("int").alias("epochs_since"),
    )


def mask_outliers(
    df: DataFrame, keys: Sequence[str], epoch: str, value: str, fraction: float = TOP_FRACTION, runs: int = SUSTAIN
) -> DataFrame:
    """Flags, streaks and masks of a loss series.

    Every step scans its input more than once, so the narrow results in between
    are written out and the work stays linear in the number of steps.
    """
    flagged = materialize(top_flags(materialize(df), epoch, value, fraction))
    return sustained(flagged, keys, epoch, runs=runs)
