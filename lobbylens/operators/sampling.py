"""Limits, balanced samples, splits and repeatable randomness.

Random order means the order of a hash of (seed, id): it repeats on any cluster
and needs no sequential shuffle. Positions in that order come from per-bucket
counts, so no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobbylens.functions import ladder
from lobbylens.operators.catalog import DOWNLOADED, PENDING
from lobbylens.operators.scan import numbered
from lobbylens.session import materialize

RANKED = ladder.RANK_COUNT - 1
# Limits up to this are left to Spark's limit below the shuffle.
FEW_ROWS = 100
SEGMENTS_PER_REPLAY = 3
SEGMENTS_PER_RANK = 15


def oldest_pending(replays: DataFrame, n: int, rank: str | None = None) -> DataFrame:
    queue = replays.where(F.col("download_status") == PENDING)
    if rank is not None:
        queue = queue.where(F.col("rank") == rank)
    return queue.orderBy("created_at", "id").limit(n)


def first_k(
    rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], k: int
) -> DataFrame:
    """First k rows of each group, for any k, group size and type of order.

    A row_number limit of few rows runs before the shuffle as well, so a group sends at most k
    rows per task. For larger k positions come from ranges of (group, order), so neither
    a large group nor a large k meets in one task. Both give the same rows.
    """
    if k <= FEW_ROWS:
        ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
        return ranked.where(F.col("_n") <= k).drop("_n")
    return numbered(rows, group, order, "_n").where(F.col("_n") < k).drop("_n")


def stratified_sample(replays: DataFrame, n: int) -> DataFrame:
    """The lowest ids of downloaded replays, the same number from each ranked tier, n in all."""
    per_rank = -(-n // RANKED)
    ranked = replays.where(
        (F.col("rank_index") >= 1) & (F.col("rank_index") <= RANKED) & (F.col("download_status") == DOWNLOADED)
    )
    return first_k(ranked, ["rank_index"], ["id"], per_rank).orderBy("id").limit(n)


def longest_groups(segments: DataFrame) -> DataFrame:
    """Per rank the replay with most segments, ties to the lower id. Combines map-side."""
    counted = segments.groupBy("rank_index", "replay_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("rank_index").agg(F.min(F.struct(-F.col("n"), F.col("replay_id"))).alias("b")).select(
        "rank_index", F.col("b.replay_id").alias("replay_id"), (-F.col("b.col1")).alias("n")
    )


def capped_sample(
    segments: DataFrame,
    order: Sequence[str],
    per_replay: int = SEGMENTS_PER_REPLAY,
    per_rank: int = SEGMENTS_PER_RANK,
) -> DataFrame:
    """Up to per_replay segments of a replay; a rank takes replays until it holds per_rank.

    Each replay adds at least one segment, so only the first per_rank replays of
    a rank can ever be taken.
    """
    sizes = segments.groupBy("rank_index", "replay_id").agg(
        F.least(F.count(F.lit(1)), F.lit(per_replay)).alias("_take")
    )
    candidates = first_k(sizes, ["rank_index"], ["replay_id"], per_rank)
    before = W.partitionBy("rank_index").orderBy("replay_id").rowsBetween(W.unboundedPreceding, -1)
    taken = candidates.withColumn("_before", F.coalesce(F.sum("_take").over(before), F.lit(0))).where(
        F.col("_before") < per_rank
    )
    chosen = segments.join(taken.select("rank_index", "replay_id"), ["rank_index", "replay_id"], "left_semi")
    return first_k(chosen, ["rank_index", "replay_id"], order, per_replay)


def order_hash(seed: int, row_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), row_id.cast("string")))


def shuffled(rows: DataFrame, row_id: str, seed: int, position: str = "position") -> DataFrame:
    """Position of each row in the hash order. Ids are unique."""
    hashed = rows.withColumn("_hash", order_hash(seed, F.col(row_id)))
    return numbered(hashed, [], ["_hash", row_id], position).drop("_hash")


def oversample(rows: DataFrame, factors: DataFrame, row_id: str, seed: int) -> DataFrame:
    """Repeat each row by the factor of its rank, then shuffle. The table has 23 rows."""
    table = F.broadcast(factors.select("rank_index", "factor"))
    repeated = (
        rows.join(table, "rank_index")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("factor", F.lit(1)))))
        .where(F.col("copy") <= F.col("factor"))
    )
    named = repeated.withColumn("_copy_id", F.concat_ws("/", F.col(row_id).cast("string"), F.col("copy").cast("string")))
    # Range partitioning reads its input twice; the input is costlier than writing it once.
    return shuffled(materialize(named), "_copy_id", seed).drop("_copy_id", "factor")


def sticky_split(replays: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Give unassigned downloaded replays a split: round(n * ratio) of them train.

    Assigned replays keep theirs, others stay unassigned.
    """
    open_rows = replays.where(F.col("dataset_split").isNull() & (F.col("download_status") == DOWNLOADED))
    hashed = open_rows.select("id").withColumn("_hash", order_hash(seed, F.col("id")))
    placed = numbered(hashed, [], ["_hash", "id"], "_position", total="_total")
    quota = F.round(F.col("_total") * F.lit(float(ratio)))
    fresh = placed.select(
        "id", F.when(F.col("_position") < quota, F.lit("training")).otherwise(F.lit("evaluation")).alias("_new")
    )
    kept = [c for c in replays.columns if c != "dataset_split"]
    return replays.join(fresh, "id", "left").select(*kept, F.coalesce("dataset_split", "_new").alias("dataset_split"))


def tail_split(rows: DataFrame, order: str, fraction: float, flag: str = "is_validation") -> DataFrame:
    """The last floor(n * fraction) rows, at least one, are held out. NULL orders come first."""
    scanned = numbered(rows, [], [order], "_i", total="_n")
    held = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(fraction)))
    return scanned.withColumn(flag, F.col("_i") >= F.col("_n") - held).drop("_i", "_n")


def mixed_lobbies(
    rows: DataFrame, order: str, ranks: Sequence[int], lobbies: int, pick: Column | None = None, seed: int = 42
) -> DataFrame:
    """Synthetic lobbies: one row of each of the given ranks, drawn by hash.

    Rows get an ordinal within their rank; draws meet them by (rank, ordinal).
    `pick` may use the columns lobby and rank_index. Fewer than two ranks give
    no lobbies.
    """
    wanted = rows.where(F.col("rank_index").isin(*ranks))
    placed = numbered(wanted, ["rank_index"], [order], "_ordinal")
    sizes = wanted.groupBy("rank_index").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.withColumn("_ranks", F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))).where(F.col("_ranks") >= 2)
    slots = F.array(*(F.lit(r) for r in ranks))
    draws = rows.sparkSession.range(lobbies).select(
        F.col("id").alias("lobby"), F.explode(slots).alias("rank_index")
    )
    number = F.xxhash64(F.lit(seed), "lobby", "rank_index") if pick is None else pick
    drawn = draws.join(F.broadcast(sizes), "rank_index").select(
        "lobby", "rank_index", F.pmod(number, F.col("_size")).cast("bigint").alias("_ordinal")
    )
    return drawn.join(
        placed, ["rank_index", "_ordinal"]
    ).drop("_ordinal").withColumn("canonical_mmr", ladder.canonical_mmr(F.col("rank_index")))


# --- 64-bit hashes: unsigned wrap-around needs numpy, so these run in Arrow batches -------------

_U = np.uint64
# Multipliers of the two 64-bit mixers and of the cell key.
COIN_A, COIN_B = _U(6364136223846793005), _U(1442695040888963407)
COIN_MIX = _U(0xFF51AFD7ED558CCD)
JITTER_STEP = _U(0x9E3779B97F4A7C15)
JITTER_MIX_1, JITTER_MIX_2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
JITTER_SECOND = _U(0x123456789ABCDEF0)
CELL_EPOCH, CELL_BATCH = _U(0xD6E8FEB86659FD93), _U(0x9E3779B97F4A7C15)
CELL_ROW, CELL_SLOT = _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
JITTER_STD = 40.0
UNIT_EDGE = 1.0e-12


def _words(values: pd.Series) -> np.ndarray:
    return values.to_numpy(dtype=np.int64).view(np.uint64)


def hash_unit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two unsigned seeds -> float32 in [0, 1)."""
    with np.errstate(over="ignore"):
        x = a * COIN_A + (b * COIN_B + _U(1))
        x = (x ^ (x >> _U(33))) * COIN_MIX
        x = x ^ (x >> _U(33))
    return (x >> _U(11)).astype(np.float32) / np.float32(2**53)


def _mixed_unit(x: np.ndarray) -> np.ndarray:
    """Unsigned words -> floats strictly inside (0, 1)."""
    with np.errstate(over="ignore"):
        x = x + JITTER_STEP
        x = (x ^ (x >> _U(30))) * JITTER_MIX_1
        x = (x ^ (x >> _U(27))) * JITTER_MIX_2
        x = x ^ (x >> _U(31))
    return np.clip((x >> _U(11)).astype(np.float64) / 2.0**53, UNIT_EDGE, 1.0 - UNIT_EDGE)


def cell_normal(epoch: np.ndarray, batch: np.ndarray, row: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Standard normal number of one label cell (Box-Muller on two mixed words)."""
    with np.errstate(over="ignore"):
        key = epoch * CELL_EPOCH + batch * CELL_BATCH + row * CELL_ROW + slot * CELL_SLOT
    radius = np.sqrt(-2.0 * np.log(_mixed_unit(key)))
    return radius * np.cos(2.0 * np.pi * _mixed_unit(key ^ JITTER_SECOND))


def hash_uniform(a: Column, b: Column) -> Column:
    @F.pandas_udf("float")
    def unit(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(hash_unit(_words(x), _words(y)))

    return unit(a.cast("bigint"), b.cast("bigint"))


def hash_coin(epoch: Column, batch: Column, fraction: float) -> Column:
    """True for about `fraction` of the batches, the same ones in every run."""
    return hash_uniform(epoch, batch) < F.lit(fraction)


def label_jitter(rows: DataFrame, epoch: int, batch: str, row: str, std: float = JITTER_STD) -> DataFrame:
    """Seeded label noise with mean zero over the known players of each lobby.

    A lobby has at most six rows.
    """

    @F.pandas_udf("double")
    def normal(e: pd.Series, b: pd.Series, r: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(cell_normal(_words(e), _words(b), _words(r), _words(s)))

    cell = normal(F.lit(epoch).cast("bigint"), F.col(batch).cast("bigint"), F.col(row).cast("bigint"),
                  F.col("slot").cast("bigint"))
    noisy = rows.withColumn("_noise", cell * F.lit(std))
    known = F.col("target_mmr") > 0
    mean = F.avg(F.when(known, F.col("_noise"))).over(W.partitionBy("replay_id"))
    return noisy.withColumn(
        "jitter", F.when(known, F.col("_noise") - mean).otherwise(F.lit(0.0))
    ).drop("_noise")
