"""Fixed-length segments: packing, storage, incremental builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lobbylens.functions import labels
from lobbylens.operators.telemetry import segment_count
from lobbylens.plans.features import FEATURES, SLOTS, feature_vectors, training_frames, zeros

CACHE_VERSION = "v6"
SEGMENT_FRAMES = 300
PARTITIONS = ["cache_version", "game_mode", "rank"]


def pad_last(values: Column, length: int) -> Column:
    """Repeat the last element up to the length; an empty array stays empty."""
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(values))
    return F.when(F.size(values) > 0, F.concat(values, F.array_repeat(F.element_at(values, -1), missing))).otherwise(
        values
    )


def pack(features: DataFrame, length: int) -> DataFrame:
    """One row per (game, segment, slot) with `length` feature rows.

    Frames after the last whole segment go; a short game is padded to one
    segment. A group holds at most `length` rows, and features that come from
    the feature plan already lie together, so this adds no shuffle.
    """
    whole = features.where(F.col("segment") < segment_count(F.col("n_kept"), length))
    # Stored numbers are float32; narrowed before they are gathered, half as much is sorted and spilled.
    narrow = whole.select("game_id", "segment", "slot", "rn", F.col("features").cast("array<float>").alias("features"))
    ordered = F.array_sort(F.collect_list(F.struct("rn", "features")))
    packed = narrow.groupBy("game_id", "segment", "slot").agg(
        pad_last(F.transform(ordered, lambda r: r["features"]), length).alias("frames")
    )
    return packed.withColumn("start", F.col("segment") * length).withColumn("end", F.col("start") + length)


def empty_games(games: DataFrame, packed: DataFrame, length: int) -> DataFrame:
    """One all-zero segment for games that left no frames at all."""
    blank = F.array_repeat(F.expr(zeros(FEATURES)).cast("array<float>"), length)
    return games.join(packed.select("game_id"), "game_id", "left_anti").select(
        "game_id",
        F.lit(0).cast("bigint").alias("segment"),
        F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"),
        blank.alias("frames"),
        F.lit(0).cast("bigint").alias("start"),
        F.lit(length).cast("bigint").alias("end"),
    )


def write_segments(packed: DataFrame, path: str, version: str = CACHE_VERSION, mode: str = "append") -> None:
    """Store segments by version, mode and rank.

    Packing has left them spread by game and segment, so they are written where they lie:
    no second shuffle of whole blocks, and one open file per task at a time.
    """
    packed.withColumn("cache_version", F.lit(version)).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def read_segments(spark: SparkSession, path: str, length: int, version: str = CACHE_VERSION) -> DataFrame:
    """Segments of one version with the requested length; the version prunes folders.

    The length comes from the narrow bounds, so a caller that wants ids reads no blocks.
    """
    stored = spark.read.parquet(path).where(F.col("cache_version") == version)
    return stored.where(F.col("end") - F.col("start") == length)


def parse_segment_names(names: DataFrame, name: str, length: int) -> DataFrame:
    """Legacy block names `start-end` with the requested length."""
    span = labels.frame_range(F.col(name))
    parsed = names.withColumn("start", span["start"]).withColumn("end", span["end"])
    return parsed.where(F.col("end") - F.col("start") == length)


#: What a build run does with a replay, in the order of the checks.
OUTCOMES = ["no_players", "cached", "read_error", "parse_error", "no_frames", "built"]


def build_outcomes(
    replays: DataFrame, players: DataFrame, stored: DataFrame, files: DataFrame, parsed: DataFrame, frames: DataFrame
) -> DataFrame:
    """Each replay of the catalogue with its outcome, by one chain of outer joins.

    replays: id, file_path, game_mode, rank; players: rating rows by replay_id; stored: game_id of
    segments at hand; files: listed paths; parsed: id, is_bad; frames: by game_id. A replay without
    ratings is skipped before its file is looked at; a file that nothing could parse is an error.
    """
    def known(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.select(F.col(key).alias("_key")).distinct().withColumn(name, F.lit(True))

    def there(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    out = replays.select("id", "file_path", "game_mode", "rank")
    for rows, column in (
        (known(players, "replay_id", "_rated"), "id"),
        (known(stored, "game_id", "_stored"), "id"),
        (known(files, "path", "_listed"), "file_path"),
        (known(parsed.where("NOT is_bad"), "id", "_parsed"), "id"),
        (known(frames, "game_id", "_framed"), "id"),
    ):
        out = out.join(rows, F.col(column) == F.col("_key"), "left").drop("_key")
    outcome = (
        F.when(~there("_rated"), F.lit("no_players")).when(there("_stored"), F.lit("cached"))
        .when(~there("_listed"), F.lit("read_error")).when(~there("_parsed"), F.lit("parse_error"))
        .when(~there("_framed"), F.lit("no_frames")).otherwise(F.lit("built"))
    )
    return out.select("id", "game_mode", "rank", outcome.alias("outcome"))


def write_outcomes(outcomes: DataFrame, path: str) -> dict[str, int]:
    """Write the plan of a build run and return how many replays have each outcome, from the same pass."""
    seen = Observation()
    counted = outcomes.observe(seen, *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))
    counted.write.parquet(path)
    return {o: seen.get[o] for o in OUTCOMES}


def build(spark: SparkSession, outcomes_path: str, marked: DataFrame, rosters: DataFrame, path: str, length: int) -> None:
    """Store the segments of the replays that the plan says to build; the others' frames are left out first."""
    todo = spark.read.parquet(outcomes_path).where("outcome = 'built'").select(F.col("id").alias("game_id"), "game_mode", "rank")
    frames = marked.join(todo.select("game_id"), "game_id", "left_semi")
    rows = pack(feature_vectors(training_frames(frames, rosters, length)), length)
    write_segments(rows.join(todo, "game_id"), path)


def missing_games(games: DataFrame, stored: DataFrame) -> DataFrame:
    """Games without a stored segment: the ones still to compute."""
    return games.join(stored.select("game_id").distinct(), "game_id", "left_anti")
