"""A linear probe over segments: features, ridge fit, scoring and verdict."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobbylens.operators.metrics import pearson

# Positions read by default: five cumulative values of the last frame and the
# segment mean of three instantaneous ones.
LAST_INDICES = (22, 23, 24, 25, 26)
MEAN_INDICES = (18, 19, 20)


def segment_features(
    vectors: DataFrame,
    keys: Sequence[str],
    length: int,
    last: Sequence[int] = LAST_INDICES,
    mean: Sequence[int] = MEAN_INDICES,
) -> DataFrame:
    """x0.. per segment of `length` frames; the bias is left to the fit.

    The one segment of a shorter game counts its last frame as often as it takes.
    """
    value = [F.get("features", F.lit(i)) for i in (*last, *mean)]
    missing = F.lit(length) - F.count(F.lit(1))
    aggregates = [F.max_by(x, "rn") for x in value[: len(last)]] + [
        (F.sum(x) + missing * F.max_by(x, "rn")) / length for x in value[len(last):]
    ]
    return vectors.groupBy(*keys).agg(*(a.alias(f"x{i}") for i, a in enumerate(aggregates)))


def normal_equations(df: DataFrame, xs: Sequence[Column], y: Column, ridge: float) -> DataFrame:
    """One row: `xtx` (row-major, ridge on every diagonal cell) and `xty`. NULL counts as 0.

    Each task multiplies its rows in blocks and sends a fixed number of sums.
    """
    n = len(xs)
    zero = F.lit(0.0)
    rows = df.select(
        F.array(*(F.coalesce(x.cast("double"), zero) for x in (*xs, y))).alias("row")
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n + 1))
        for batch in batches:
            block = batch.column("row").flatten().to_numpy().reshape(-1, n + 1)
            total += block[:, :n].T @ block
        yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size, dtype=np.int32), "value": total.ravel()})

    sums = rows.mapInArrow(partial, "cell int, value double")
    none = df.sparkSession.range(n * (n + 1)).select(F.col("id").cast("int").alias("cell"), zero.alias("value"))
    sums = sums.unionByName(none).groupBy("cell").agg(F.sum("value").alias("value"))
    # n * (n + 1) cells, whatever the rows.
    cells = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda c: c["value"]).alias("m"))
    diagonal = f"CASE WHEN k DIV {n} = k % {n} THEN {float(ridge)!r}D ELSE 0.0D END"
    return cells.select(
        F.expr(f"transform(sequence(0, {n * n - 1}), k -> m[cast(k DIV {n} AS int) * {n + 1} + k % {n}] + {diagonal})").alias("xtx"),
        F.expr(f"transform(sequence(0, {n - 1}), k -> m[k * {n + 1} + {n}])").alias("xty"),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve(xtx: pd.Series, xty: pd.Series) -> pd.Series:
    """Solve each small system; a singular one gets the least-squares answer."""

    def one(a, b):
        b = np.asarray(b, dtype=float)
        a = np.asarray(a, dtype=float).reshape(len(b), len(b))
        try:
            return np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(a, b, rcond=None)[0]

    return pd.Series([one(a, b) for a, b in zip(xtx, xty)])


def ridge_fit(df: DataFrame, xs: Sequence[Column], y: Column, ridge: float) -> DataFrame:
    """One row with the weights, in the order of `xs`."""
    return normal_equations(df, xs, y, ridge).select(solve("xtx", "xty").alias("weights"))


def ridge_score(df: DataFrame, weights: DataFrame, xs: Sequence[Column], name: str = "pred") -> DataFrame:
    """Add the prediction. `weights` is a single row of fixed width."""
    terms = [F.get("weights", F.lit(i)) * x for i, x in enumerate(xs)]
    scored = sum(terms[1:], terms[0])
    return df.withColumn("weights", weights.scalar()).withColumn(name, scored).drop("weights")


def verdict(rows: DataFrame, pred: str, y: str, train_mean: Column) -> DataFrame:
    """RMSE, Pearson r and gain over the constant predictor on held-out rows."""
    err = F.col(pred) - F.col(y)
    base = train_mean - F.col(y)
    measured = rows.agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sqrt(F.avg(base * base)).alias("constant_rmse"),
        F.covar_samp(pred, y).alias("_cov"),
        F.stddev_samp(pred).alias("_sp"),
        F.stddev_samp(y).alias("_sy"),
    ).withColumn("pearson_r", pearson(F.col("_cov"), F.col("_sp"), F.col("_sy"))).drop("_cov", "_sp", "_sy")
    return measured.select(
        "*",
        (F.lit(100.0) * (1.0 - F.try_divide("rmse", "constant_rmse"))).alias("gain_pct"),
        (F.col("rmse") < F.col("constant_rmse") * 0.95).alias("carries_signal"),
    )


# (n, slots, frames, features) -> (n, slots): all players of a lobby at once.
Scorer = Callable[[np.ndarray], np.ndarray]
# Lobby segments of one call of the scorer: about 60 MB at 300 frames and 106 features.
SCORE_BATCH = 32


def linear_scorer(
    weights: Sequence[float],
    last: Sequence[int] = LAST_INDICES,
    mean: Sequence[int] = MEAN_INDICES,
    lobby_share: float = 0.0,
) -> Scorer:
    """The probe as a scorer; each score is drawn to the lobby's mean by lobby_share."""
    w = np.asarray(weights, dtype=float)

    def score(block: np.ndarray) -> np.ndarray:
        ones = np.ones((*block.shape[:2], 1))
        own = np.concatenate([block[:, :, -1, list(last)], block[:, :, :, list(mean)].mean(axis=2), ones], axis=2) @ w
        return own + lobby_share * (own.mean(axis=1, keepdims=True) - own)

    return score


def score_lobbies(segments: DataFrame, scorer: Scorer, keys: Sequence[str], slots: int = 6) -> DataFrame:
    """Score packed segments, the slots of a lobby together; one row per key and slot.

    `segments` has keys, slot and frames, at most one row per slot; a missing slot is all zeros and
    gets no row. A lobby segment is one block of bounded size; a call of the scorer sees
    SCORE_BATCH of them.
    """
    keys = list(keys)
    lobbies = segments.groupBy(*keys).agg(F.collect_list(F.struct("slot", "frames")).alias("players"))
    fields = ", ".join(f"{c} {t}" for c, t in segments.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SCORE_BATCH):
                part = batch.slice(lo, SCORE_BATCH)
                players = part.column("players")
                rows = players.flatten()
                lobby = players.value_parent_indices().to_numpy()
                slot = rows.field("slot").to_numpy()
                frames = rows.field("frames")
                width = len(frames[0][0]) if len(frames) else 0
                length = len(frames[0]) if len(frames) else 0
                if frames.flatten().flatten().null_count or len(frames.flatten().flatten()) != len(rows) * length * width:
                    raise ValueError("segments must have the same numbers of frames and features")
                block = np.zeros((part.num_rows, slots, length, width))
                block[lobby, slot] = frames.flatten().flatten().to_numpy().reshape(len(rows), length, width)
                scores = scorer(block)[lobby, slot]
                head = [part.column(k).take(pa.array(lobby)) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [*head, pa.array(slot, pa.int32()), pa.array(scores, pa.float64())], names=[*keys, "slot", "pred_mmr"]
                )

    return lobbies.mapInArrow(run, f"{fields}, slot int, pred_mmr double")
