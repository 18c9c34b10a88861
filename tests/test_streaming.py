import json

import numpy as np
import pytest
from helpers import FRAME, frame, frames_df, rosters_df, six
from pyspark.sql import Row
from pyspark.sql import functions as F

from lobbylens.plans import features as ft
from lobbylens.streaming import live
from lobbylens.streaming.store import BatchStore, newest

LENGTH = 3


def land(spark, folder, batches):
    """Each batch becomes one file; the stream reads one file per trigger."""
    for rows in batches:
        frames_df(spark, rows).withColumn("at", F.timestamp_seconds(F.col("frame_idx") + 1_700_000_000)).coalesce(1).write.mode("append").parquet(f"{folder}/frames")


def stream(spark, folder, lateness=3600):
    schema = spark.read.parquet(f"{folder}/frames").schema
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/frames")
    return live.segment_frames(frames, rosters_df(spark, [1]), LENGTH, "at", lateness)


def run(spark, folder, assemble_live):
    assembled = live.assemble(stream(spark, folder), LENGTH, live=assemble_live)
    live.live_features(assembled, f"{folder}/out", f"{folder}/check").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return {(r.rn, r.slot): r.features for r in out.collect()}, out.count()


def rows(indices):
    return [frame(1, i, six({"Player1": (i * 7 % 50) / 100})) for i in indices]


def batch_features(spark, indices):
    segmented = ft.inference_frames(frames_df(spark, rows(indices)), rosters_df(spark, [1]), LENGTH)
    return {(r.rn, r.slot): r.features for r in ft.feature_vectors(segmented, with_context=False).collect()}


def test_live_frames_match_the_batch_plan_in_any_order(spark, folder):
    land(spark, folder, [rows([0, 1, 2]), rows([6, 7]), rows([4, 5, 2]), rows([8, 10, 12])])
    got, n = run(spark, folder, True)
    assert got == batch_features(spark, range(13)) and n == 7 * 6


def test_only_whole_segments_come_out(spark, folder):
    land(spark, folder, [rows([0, 2]), rows([4, 2, 6, 8]), rows([4, 0])])
    got, n = run(spark, folder, False)
    assert got == {k: x for k, x in batch_features(spark, range(9)).items() if k[0] < 3} and n == 18


def test_fold_in_any_pieces():
    """Sums carried from batch to batch are those of the whole segment, absent and demolished cars too."""
    rng = np.random.default_rng(2)
    inputs = rng.integers(0, 2, (40, 6, 5)).astype(float)
    inputs[:, :, 0] = rng.integers(0, 100, (40, 6))
    inputs = (inputs * inputs[:, :, 4:]).reshape(40, 30)
    whole, _ = ft.fold_segment(inputs)
    carry, parts, at = None, [], 0
    for size in (1, 5, 3, 20, 11):
        part, carry = ft.fold_segment(inputs[at : at + size], carry)
        parts.append(part)
        at += size
    assert np.array_equal(np.concatenate(parts), whole)


def test_progress_windows_update(spark, folder):
    for rows_ in ([("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:29", "a")], [("2024-01-01 00:00:05", "a"), ("2024-01-01 00:00:31", "b")]):
        spark.createDataFrame(rows_, "ts string, s string").select(F.col("ts").cast("timestamp").alias("ts"), "s").coalesce(
            1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("ts timestamp, s string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    counts = live.progress_counts(stream, "ts", "s", "30 seconds", "10 minutes")
    live.track_progress(counts, f"{folder}/out", f"{folder}/check").awaitTermination()
    got = sorted((r.status, r.n) for r in live.progress_store(spark, f"{folder}/out").read().collect())
    assert got == [("a", 3), ("b", 1)]


@pytest.mark.parametrize("assemble_live", [True, False])
def test_state_expires_with_the_watermark(spark, folder, assemble_live):
    def land_at(indices, second):
        frames_df(spark, rows(indices)).withColumn("at", F.timestamp_seconds(F.lit(second))).coalesce(1).write.mode(
            "append").parquet(f"{folder}/frames")

    land_at([2, 4], 1000)
    land_at([102], 5000)
    land_at([104], 9000)
    land_at([0], 20)  # too late: the segment's state is gone
    assembled = live.assemble(stream(spark, folder, 60), LENGTH, live=assemble_live, lateness_seconds=60)
    query = live.live_features(assembled, f"{folder}/out", f"{folder}/check")
    query.awaitTermination()
    assert spark.read.parquet(f"{folder}/out").where("rn < 3").count() == 0


def statuses(spark, folder, batches):
    for rows_ in batches:
        spark.createDataFrame(rows_, "replay_id long, status string, at long, event_id long").select(
            "replay_id", "status", F.timestamp_seconds("at").alias("ts"), F.col("at").alias("changed_at"), "event_id"
        ).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    schema = "replay_id long, status string, ts timestamp, changed_at long, event_id long"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("ts", "10 seconds")
    query = live.track_status(events, "replay_id", 100, f"{folder}/out", f"{folder}/check", compact_every=2)
    query.awaitTermination()
    got = {r.replay_id: (r.status, r.changed_at, r.released) for r in live.status_store(spark, f"{folder}/out", "replay_id").read().collect()}
    return got, query


def test_stuck_downloads_are_released_by_a_timer(spark, folder):
    got, query = statuses(spark, folder, [
        [(1, "in_progress", 1000, 1), (2, "in_progress", 1000, 2), (3, "in_progress", 1001, 3), (4, "failed", 1000, 4)],
        [(2, "downloaded", 1050, 5), (3, "in_progress", 1060, 6), (1, "not_downloaded", 995, 0)],
        [(5, "downloaded", 1150, 7)],
        [(3, "downloaded", 1200, 8), (6, "in_progress", 1200, 9)],
        [(7, "failed", 5000, 10)],
    ])
    assert got == {
        1: ("not_downloaded", 1000, True), 2: ("downloaded", 1050, False), 3: ("downloaded", 1200, False), 4: ("failed", 1000, False),
        5: ("downloaded", 1150, False), 6: ("not_downloaded", 1200, True), 7: ("failed", 5000, False),
    }
    # Every replay is settled: neither values nor timers are left.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_a_replay_not_in_progress_costs_one_state_call():
    calls = []

    class State:
        def __init__(self, held=None):
            self.held = held

        def __getattr__(self, name):
            def call(*args):
                calls.append((name, *args))
                return self.held if name == "get" else None

            return call

    def handled(held, *rows_):
        calls.clear()
        downloads = live.Downloads("replay_id", 100)
        downloads._handle, downloads._running = State(), State(held)
        made = [Row("status", "changed_at", "event_id")(*r) for r in rows_]
        return [tuple(r) for r in downloads.handleInputRows((7,), iter(made), None)]

    assert handled(None, ("failed", 5, 1), ("downloaded", 6, 2), ("in_progress", 6, 1)) == [(7, "downloaded", 6, 2, False)]
    assert calls == [("get",)]
    assert handled((6, 2), ("failed", 6, 1)) == [] and calls == [("get",)]
    assert handled((6, 2), ("in_progress", 7, 0)) == [(7, "in_progress", 7, 0, False)]
    assert calls == [("get",), ("deleteTimer", 106000), ("update", (7, 0)), ("registerTimer", 107000)]


def test_store_before_and_after_a_merge(spark, folder):
    store = BatchStore(spark, folder, "k long, v long", newest(["k"], ["v"]))
    assert store.read().count() == 0

    def batch(*rows_):
        return spark.createDataFrame(rows_, "k long, v long")

    def values(before=None):
        return sorted(map(tuple, store.read(before).collect()))

    store.write(batch((1, 1), (2, 5)), 0)
    store.write(batch((1, 3)), 1)
    listed = store.read()
    assert values() == [(1, 3), (2, 5)] and values(1) == [(1, 1), (2, 5)]
    store.compact(1)
    store.write(batch((1, 99)), 1)  # run again: the snapshot has it
    assert values() == [(1, 3), (2, 5)] and store.numbers("snapshot") == [1]
    store.write(batch((2, 6), (3, 0)), 2)
    store.write(batch((3, 1)), 3)
    store.write(batch((3, 2)), 3)  # run again before it was merged
    assert values() == [(1, 3), (2, 6), (3, 2)] and sorted(map(tuple, listed.collect())) == [(1, 3), (2, 5)]
    store.compact(3)
    assert values() == [(1, 3), (2, 6), (3, 2)] and store.numbers("batch") == [2, 3]
    store.compact(3)
    store.write(batch(), 4)
    store.compact(4)
    assert values() == [(1, 3), (2, 6), (3, 2)] and store.numbers("snapshot") == [3, 4]


def lines(ids, rank=None):
    """Lobbies of six whose players all have the rank, or none."""
    given = {"rank": {"id": "gold-1", "tier": 7, "division": 1, "name": "Gold I Division 1"}} if rank else {}
    team = [[{"name": f"p{i}", **given} for i in range(s, s + 3)] for s in (0, 3)]
    out = []
    for i in ids:
        name = f"00000000-0000-0000-0000-{i:012d}"
        out.append((json.dumps({"id": name, "data": {"id": name, "blue": {"players": team[0]}, "orange": {"players": team[1]}}}),))
    return out


def ingested(spark, folder, batches, **options):
    for asked, rows_ in batches:
        spark.createDataFrame(rows_, "line string").coalesce(1).write.mode("append").text(f"{folder}/bundle/requested_rank={asked}")
    live.ingest(spark, f"{folder}/bundle", f"{folder}/out", f"{folder}/check", files_per_batch=1, **options).awaitTermination()
    stores = live.IngestStores(spark, f"{folder}/out")
    kept = sorted((int(r.replay_id[-12:]), r.rank) for r in stores.replays.read().collect())
    return stores, kept


def test_ranks_take_replays_until_they_hold_their_target(spark, folder):
    batches = [("gold-1", lines([5, 3, 3], True)), ("silver-2", lines([7, 8])), ("silver-2", lines([1, 2, 3, 9], True)), ("gold-1", lines([4, 7])),
               ("silver-2", lines([6, 5]))]
    stores, kept = ingested(spark, folder, batches, target=3, compact_every=2)
    assert kept == [(1, "gold-1"), (3, "gold-1"), (5, "gold-1"), (6, "silver-2"), (7, "silver-2"), (8, "silver-2")]
    held = {r.rank: r.n for r in stores.held.read().collect()}
    assert held == {"gold-1": 3, "silver-2": 3}
    # Lobbies without any known rank have no labelled players.
    assert stores.players.read().groupBy("replay_id").count().where("count = 6").count() == 3


def test_replays_of_full_ranks_are_not_moved(spark, folder, monkeypatch):
    """Before, every batch moved, compared and wrote all its replays, whatever the ranks held already."""
    moved, materialize = [], live.materialize

    def seen(df):
        made = materialize(df)
        if "players" in made.columns:
            moved.append(made.count())
        return made

    monkeypatch.setattr(live, "materialize", seen)
    batches = [("gold-1", lines(range(6), True)), ("gold-1", lines(range(4, 12), True)), ("silver-2", lines([20, 21])), ("gold-1", lines([20, 30, 3], True))]
    stores, kept = ingested(spark, folder, batches, target=4)
    assert kept == [(i, "gold-1") for i in range(4)] + [(20, "silver-2"), (21, "silver-2")]
    # All lines of a batch, then those that its ranks take; nothing of the second and fourth.
    assert moved == [6, 4, 0, 2, 2, 0]
    assert stores.replays.numbers("batch") == [0, 2]


def test_a_batch_reads_its_partitions_only(spark, folder):
    stores, _ = ingested(spark, folder, [("gold-1", lines(range(40), True))])
    plan = live.known_replays(stores, [3, 9])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    read = live.known_replays(stores, [3, 9])
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in read.inputFiles()} >= {r.bucket for r in read.collect()}
    assert read.count() < 40


def test_merges_double(spark, folder, monkeypatch):
    """Before, everything was merged again at every other batch."""
    store, made = BatchStore(spark, folder, "k long, v long"), []
    monkeypatch.setattr(store, "numbers", lambda kind: made)
    for n in range(16):
        if store.due(n, 2):
            made.append(n)
    assert made == [1, 3, 7, 15] and not store.due(15, 0)


def test_sums_go_on_from_batch_to_batch(spark):
    """A batch goes on from the table of the one before, with the sums of the whole segment to the last bit."""
    rng = np.random.default_rng(5)
    inputs = rng.integers(0, 2, (6, 6, 5)).astype(float)
    inputs[:, :, 0] = rng.random((6, 6)) * 100
    inputs = (inputs * inputs[:, :, 4:]).reshape(6, 30)

    def arrived(places):
        return spark.createDataFrame([(1, 0, i, 1000, [float(i)], inputs[i].tolist()) for i in places],
                                     "game_id long, segment long, rn long, event_ms long, numbers array<double>, inputs array<double>")

    held, got = spark.createDataFrame([], live.OPEN), {}
    for places in ([0, 1, 3], [2, 3, 1], [5, 4]):
        rows = live.advance(arrived(places), held, live.Assembly(None, 10, True, 60_000), 0).collect()
        out = {r.rn: r.sums for r in rows if r.ready}
        assert not set(out) & set(got)
        got |= out
        held = spark.createDataFrame(rows, live.OPEN)
    assert [got[i] for i in range(6)] == ft.fold_segment(inputs)[0].tolist()


def test_lines_come_from_one_pass_over_the_summaries(spark, folder):
    """Before, the summaries were a union of four."""
    from lobbylens.queries.streams import bundle_lines

    spark.range(12).selectExpr(
        "id % 3 AS l_orderkey", "cast(id / 3 AS int) + 1 AS l_linenumber", "id * 10D AS l_extendedprice", "id AS l_suppkey",
        "id + 1D AS l_quantity", "'N' AS l_returnflag").write.parquet(f"{folder}/lineitem.parquet")
    lines = bundle_lines(spark, folder)
    assert "Union" not in lines._jdf.queryExecution().optimizedPlan().toString()
    counts = lines.groupBy("replay_id").agg(F.count("*").alias("n"), F.countDistinct("line").alias("m")).collect()
    assert sorted(map(tuple, counts)) == [(i, 4, 3) for i in range(3)]
