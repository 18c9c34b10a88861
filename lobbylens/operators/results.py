"""Result tables: medians, outliers, scores and timeline rows per lobby."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobbylens.functions import labels, ladder
from lobbylens.operators.scan import lobby_list

# Margin of suspicion, default prediction, players of a lobby.
SUSPICION_MARGIN = 200.0
NO_PREDICTION = 1000.0
LANES = 6


def _members(*columns: str) -> Column:
    """At most six players of a lobby in slot order."""
    return F.array_sort(lobby_list(F.struct("slot", *columns)))


def padded_lanes(players: DataFrame, lanes: int = LANES) -> DataFrame:
    """Timeline lanes: players in slot order, filled up with `Player n` on blue.

    With a column actor_id, a car without a name is called after its actor.
    """
    if "actor_id" in players.columns:
        players = players.withColumn("player_name", labels.placeholder_name(F.col("player_name"), F.col("actor_id")))
    members = players.groupBy("replay_id").agg(_members("player_name", "team").alias("m"))

    def lane(i: Column) -> Column:
        p = F.get(F.col("m"), i)
        spare = F.concat(F.lit("Player "), (i + 1).cast("string"))
        return F.struct(
            i.alias("lane"),
            F.coalesce(p["player_name"], spare).alias("player_name"),
            F.coalesce(p["team"], F.lit(0)).alias("team"),
        )

    all_lanes = F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lane)
    return members.select("replay_id", F.explode(all_lanes).alias("l")).select("replay_id", "l.*")


def segment_means(predictions: DataFrame, players: DataFrame) -> DataFrame:
    """Mean prediction per player; the default where nothing was predicted."""
    means = predictions.groupBy("replay_id", "slot").agg(F.avg("pred_mmr").alias("mean_mmr"))
    joined = players.join(means, ["replay_id", "slot"], "left")
    return joined.withColumn("mean_mmr", F.coalesce("mean_mmr", F.lit(NO_PREDICTION)))


def segment_medians(predictions: DataFrame) -> DataFrame:
    """Midpoint median over a player's segments: those of one match, so one shuffle does."""
    medians = predictions.where(F.col("pred_mmr").isNotNull()).groupBy("replay_id", "slot").agg(
        F.median("pred_mmr").alias("median_mmr"), F.count(F.lit(1)).alias("n")
    )
    return medians.withColumn("division_idx", ladder.band_index(F.col("median_mmr")))


def lobby_outliers(players: DataFrame, value: str, margin: float = SUSPICION_MARGIN) -> DataFrame:
    """Every player with the lobby median and whether they lie above it by the margin.

    `players` has one row per replay and slot, so a lobby window holds six rows.
    """
    lobby = W.partitionBy("replay_id")
    return players.withColumn("lobby_median", F.median(value).over(lobby)).withColumn(
        "is_suspect", F.col(value) > F.col("lobby_median") + margin
    )


def smurf_scores(predictions: DataFrame, labelled: DataFrame) -> DataFrame:
    """Mean prediction minus label midpoint; players without a label are dropped."""
    means = predictions.groupBy("replay_id", "player_name").agg(F.avg("pred_mmr").alias("mean_mmr"))
    return means.join(labelled, ["replay_id", "player_name"]).withColumn(
        "smurf_score", F.col("mean_mmr") - ladder.division_middle(F.col("division_idx"))
    )


def team_averages(predictions: DataFrame) -> DataFrame:
    """Mean over a team per segment, then over its segments."""
    per_segment = predictions.groupBy("replay_id", "team", "segment").agg(F.avg("pred_mmr").alias("m"))
    return per_segment.groupBy("replay_id", "team").agg(F.avg("m").alias("team_mmr"))


def segment_rows(predictions: DataFrame) -> DataFrame:
    """One row per segment: number, six ratings and their divisions."""
    slots = range(LANES)
    ratings = predictions.groupBy("replay_id", "segment").agg(
        *(
            F.coalesce(F.avg(F.when(F.col("slot") == s, F.col("pred_mmr"))), F.lit(NO_PREDICTION)).alias(f"m{s}")
            for s in slots
        )
    )
    return ratings.select(
        "replay_id",
        (F.col("segment") + 1).alias("segment_number"),
        *(f"m{s}" for s in slots),
        *(ladder.band_index(F.col(f"m{s}")).alias(f"d{s}") for s in slots),
    )


def prediction_results(predictions: DataFrame, players: DataFrame) -> DataFrame:
    """Name, team, segment count, median, division and outlier flag per player."""
    medians = segment_medians(predictions).withColumnRenamed("n", "segments")
    rows = medians.join(players.select("replay_id", "slot", "player_name", "team"), ["replay_id", "slot"])
    flagged = lobby_outliers(rows, "median_mmr")
    return flagged.withColumn("division", ladder.division_label(F.col("division_idx")))


def verdicts(players: DataFrame, value: str) -> DataFrame:
    """One verdict line per lobby."""
    flagged = lobby_outliers(players, value)
    suspects = F.array_sort(
        lobby_list(F.when(F.col("is_suspect"), F.struct("slot", "player_name")))
    )
    return flagged.groupBy("replay_id").agg(
        suspects.alias("s"), F.first("lobby_median").alias("lobby_median")
    ).select(
        "replay_id",
        labels.verdict_line(
            F.transform("s", lambda p: p["player_name"]), F.col("lobby_median"), F.col("replay_id")
        ).alias("verdict"),
    )
