"""Catalogue of replays, players and models: appends, filters, counts, status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lobbylens.functions import labels, ladder

DOWNLOADED, PENDING, FAILED, RUNNING = "downloaded", "not_downloaded", "failed", "in_progress"


def new_rows(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key.

    Repeats are combined before the join, so a key that fills the input does not
    gather on one task; both steps share one partitioning.
    """
    keys = list(keys)
    return incoming.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti")


def append_new(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], path: str, **options) -> int:
    """Append to a table, leave rows that are already there untouched, return the number inserted."""
    written = Observation()
    rows = new_rows(incoming, stored, keys).observe(written, F.count(F.lit(1)).alias("inserted"))
    writer = rows.write.mode("append")
    if options.get("partition_by"):
        writer = writer.partitionBy(*options["partition_by"])
    writer.parquet(path)
    return written.get["inserted"]


def existing(df: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(stored.select(*keys).distinct(), list(keys), "left_semi")


def with_file_path(replays: DataFrame) -> DataFrame:
    return replays.withColumn(
        "file_path", labels.replay_path(F.col("game_mode"), F.col("rank"), F.col("id"))
    )


def select_replays(
    replays: DataFrame,
    rank: str | None = None,
    status: str | None = None,
    split: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """The catalogue filters; each stays a plain predicate and reaches the scan."""
    for column, wanted in (
        ("rank", rank), ("download_status", status), ("dataset_split", split), ("file_path", path),
    ):
        if wanted is not None:
            replays = replays.where(F.col(column) == wanted)
    return replays


def matches_rank(min_division: Column, requested_rank: Column) -> Column:
    """Keep a listing whose lower bound is unknown or lies in the requested rank."""
    return min_division.isNull() | (ladder.division_rank(min_division) == requested_rank)


def register_model(registry: DataFrame, models: DataFrame) -> DataFrame:
    """Append models with the next free version of their name (first is 1)."""
    return registry.unionByName(
        models.join(next_version(registry, models.select("name").distinct()), "name").withColumnRenamed(
            "next_version", "version"
        )
    )


def latest_models(registry: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct(*[c for c in registry.columns if c not in ("name", "version")]), "version")
    return registry.groupBy("name").agg(F.max("version").alias("version"), newest.alias("m")).select(
        "name", "version", "m.*"
    )


def find_model(registry: DataFrame, name: str, version: int) -> DataFrame:
    return registry.where((F.col("name") == name) & (F.col("version") == version))


def list_models(registry: DataFrame, name: str | None = None) -> DataFrame:
    """Models by name, newest version first."""
    chosen = registry if name is None else registry.where(F.col("name") == name)
    return chosen.orderBy("name", F.desc("version"))


def next_version(registry: DataFrame, names: DataFrame) -> DataFrame:
    newest = registry.groupBy("name").agg(F.max("version").alias("v"))
    return names.join(newest, "name", "left").select(
        "name", (F.coalesce("v", F.lit(0)) + 1).cast("int").alias("next_version")
    )


def count_by_rank_status(replays: DataFrame) -> DataFrame:
    return replays.groupBy("rank", "download_status").agg(F.count(F.lit(1)).alias("n"))


def pending_by_rank(replays: DataFrame) -> DataFrame:
    return replays.groupBy("rank").agg(F.count_if(F.col("download_status") == PENDING).alias("pending"))


def status_report(replays: DataFrame) -> DataFrame:
    """Downloaded, failed, pending per rank and a TOTAL row, with progress in percent."""
    status = F.col("download_status")
    counted = replays.rollup("rank").agg(
        F.count_if(status == DOWNLOADED).alias("downloaded"),
        F.count_if(status == FAILED).alias("failed"),
        F.count_if(status == PENDING).alias("pending"),
        F.grouping("rank").alias("_all"),
    )
    done, waiting = F.col("downloaded"), F.col("pending")
    return counted.select(
        F.when(F.col("_all") == 1, F.lit("TOTAL")).otherwise(F.col("rank")).alias("rank"),
        "downloaded",
        "failed",
        (done + F.col("failed")).alias("total"),
        "pending",
        F.coalesce(F.try_divide(done, done + waiting) * 100.0, F.lit(0.0)).alias("progress_pct"),
    )


def split_counts(replays: DataFrame) -> DataFrame:
    mine = F.col("download_status") == DOWNLOADED
    return replays.agg(
        F.count_if(mine & (F.col("dataset_split") == "training")).alias("training"),
        F.count_if(mine & (F.col("dataset_split") == "evaluation")).alias("evaluation"),
    )


def reconciled_status(status: Column, file_present: Column) -> Column:
    """Status after failed rows are reset and the file decides."""
    reset = F.when(status == FAILED, F.lit(PENDING)).otherwise(status)
    return (
        F.when((reset == DOWNLOADED) & ~file_present, F.lit(PENDING))
        .when((reset == PENDING) & file_present, F.lit(DOWNLOADED))
        .otherwise(reset)
    )


def reconcile(replays: DataFrame, files: DataFrame, key: str = "file_path") -> DataFrame:
    """Compare the catalogue with the file listing; files without a row are ignored."""
    seen = files.select(F.col("path").alias(key)).distinct().withColumn("_there", F.lit(True))
    joined = replays.join(seen, key, "left")
    there = F.coalesce(F.col("_there"), F.lit(False))
    return joined.select(
        *replays.columns,
        there.alias("on_disk"),
        reconciled_status(F.col("download_status"), there).alias("new_status"),
    )


def reconcile_counters(reconciled: DataFrame) -> DataFrame:
    """The seven counters of one reconciliation run."""
    status, there = F.col("download_status"), F.col("on_disk")
    reset = F.when(status == FAILED, F.lit(PENDING)).otherwise(status)
    return reconciled.agg(
        F.count_if(status == FAILED).alias("failed_reset"),
        F.count_if(status == DOWNLOADED).alias("downloaded_checked"),
        F.count_if((status == DOWNLOADED) & there).alias("downloaded_on_disk"),
        F.count_if((status == DOWNLOADED) & ~there).alias("missing_reset"),
        # A downloaded row whose file is gone was reset above, so it is checked again here.
        F.count_if((reset == PENDING) | ((status == DOWNLOADED) & ~there)).alias("pending_checked"),
        F.count_if((reset == PENDING) & there).alias("found_marked_downloaded"),
        F.count_if(
            ((reset == PENDING) | (status == DOWNLOADED)) & ~there
        ).alias("pending_still_missing"),
    )


def latest_status(events: DataFrame, key: str, status: str, order: Sequence[str]) -> DataFrame:
    """Current status per replay: the newest event wins. Combines map-side."""
    return events.groupBy(key).agg(
        F.max_by(F.col(status), F.struct(*order)).alias(status), F.max(F.col(order[0])).alias("changed_at")
    )


def release_stuck(current: DataFrame, now: Column, timeout_seconds: int, status: str) -> DataFrame:
    """Return replays that stayed in progress for too long to the queue."""
    stuck = (F.col(status) == RUNNING) & (now - F.col("changed_at") > timeout_seconds)
    return current.withColumn(status, F.when(stuck, F.lit(PENDING)).otherwise(F.col(status)))


def player_count_mismatch(replays: DataFrame, players: DataFrame, expected: int = 6) -> DataFrame:
    """Replays whose counted or stored number of players is not the expected one."""
    stored = players.groupBy("replay_id").agg(
        F.count(F.lit(1)).alias("stored_rows"), F.countDistinct("player_name").alias("effective_count")
    )
    joined = replays.select("id").join(stored, replays["id"] == stored["replay_id"], "left")
    filled = joined.select(
        "id",
        F.coalesce("stored_rows", F.lit(0).cast("bigint")).alias("stored_rows"),
        F.coalesce("effective_count", F.lit(0).cast("bigint")).alias("effective_count"),
    )
    return filled.where((F.col("stored_rows") != expected) | (F.col("effective_count") != expected))


def effective_player_count(rows: DataFrame, key: str, name: str, platform_id: str) -> DataFrame:
    """Largest of three signals: rows, distinct non-empty names, distinct platform ids."""
    counted = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(F.nullif(F.col(name), F.lit(""))).alias("n_names"),
        F.countDistinct(platform_id).alias("n_platform_ids"),
    )
    return counted.withColumn("effective_count", F.greatest("n_rows", "n_names", "n_platform_ids"))


def update_scores(players: DataFrame, scores: DataFrame, column: str = "smurf_score") -> DataFrame:
    """Write scores back by (replay, name); rows without a new score keep theirs."""
    fresh = scores.select("replay_id", "player_name", F.col(column).alias("_new"))
    joined = players.join(fresh, ["replay_id", "player_name"], "left")
    kept = [F.col(c) for c in players.columns if c != column]
    return joined.select(*kept, F.coalesce("_new", F.col(column)).alias(column))


def import_counts(rows: DataFrame, outcome: str) -> DataFrame:
    """Import progress: processed, and each outcome, with the percentage imported."""
    flag = F.col(outcome)
    return rows.agg(
        F.count(F.lit(1)).alias("processed"),
        *(F.count_if(flag == o).alias(o) for o in ("imported", "already_exists", "no_file", "error")),
    ).withColumn(
        "imported_pct",
        F.coalesce(F.try_divide(F.col("imported") * F.lit(100.0), F.col("processed")), F.lit(0.0)),
    )
