"""Streaming jobs: metadata ingest, download status with timers, progress, live segments and features.

Every job takes its checkpoint and output folders from the caller and runs until its input is used
up. Outputs are `BatchStore`s: a batch that is run again replaces its own rows, sealed
batches are merged into snapshots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lobbylens.functions import ladder
from lobbylens.operators import catalog, labelling
from lobbylens.operators.scan import numbered
from lobbylens.plans import features as ft
from lobbylens.session import materialize
from lobbylens.sources import bundle
from lobbylens.streaming.store import NUMBER, BatchStore, newest

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BATCH = "batch_id"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep typed state and timers, which need this store."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _run(rows: DataFrame, sink, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        rows.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


# --- metadata ingest ---------------------------------------------------------------------

#: Hash partitions of the stored replays and players.
BUCKETS = 32


class IngestStores:
    """What the ingest keeps: replays and players by hash partition of the id, and rows per rank."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        by = {"partition_by": ["bucket"]}
        self.replays = BatchStore(spark, f"{path}/replays", "replay_id string, rank string, bucket int", **by)
        self.players = BatchStore(
            spark, f"{path}/players",
            "replay_id string, player_name string, team int, division_idx int, rank_known boolean, folder_rank int, bucket int", **by,
        )
        self.held = BatchStore(spark, f"{path}/held", "rank string, n bigint", lambda rows: rows.groupBy("rank").agg(F.sum("n").alias("n")))

    def all(self) -> tuple[BatchStore, ...]:
        return self.replays, self.players, self.held


def bucket_of(replay_id: str) -> F.Column:
    return F.pmod(F.xxhash64(replay_id), F.lit(BUCKETS)).cast("int")


def known_replays(stores: IngestStores, buckets: Sequence[int], before: int | None = None) -> DataFrame:
    """Stored ids of some partitions; the others are not listed or read."""
    return stores.replays.stored(before).where(F.col("bucket").isin(list(buckets))).select("bucket", "replay_id")


def admit(fresh: DataFrame, held: DataFrame, target: int) -> DataFrame:
    """Of new replays (replay_id, rank) the first by id that a rank takes until it holds its target."""
    placed = numbered(fresh.select("replay_id", "rank"), ["rank"], ["replay_id"], "_place")
    # One row per rank of the ladder.
    room = placed.join(F.broadcast(held), "rank", "left").where(F.col("_place") + F.coalesce("n", F.lit(0)) < target)
    return fresh.join(room.select("replay_id"), "replay_id", "left_semi")


def ingest(
    spark: SparkSession, bundle_path: str, path: str, checkpoint: str,
    target: int | None = None, files_per_batch: int = 4, compact_every: int = 0,
) -> StreamingQuery:
    """JSON-lines bundles -> replays and players, each stored once (see IngestStores).

    A replay is filed under the average rank of its lobby, or, where none is known, under the rank
    that was asked for: the folder `requested_rank=...` of its bundle. With `target` a rank takes
    replays until it holds so many; a batch's are taken in the order of their ids.
    Duplicates are found within the batch and against the stored partitions that its ids fall into,
    however late a line is repeated; no state needs to be kept. A batch that is run again sees the
    store as it was before and writes the same rows.
    """
    stores = IngestStores(spark, path)
    lines = (
        spark.readStream.schema(f"{bundle.LABEL_LINE}, {bundle.BAD} string, requested_rank string")
        .option("columnNameOfCorruptRecord", bundle.BAD)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(bundle_path)
    )

    def store(batch: DataFrame, number: int) -> None:
        good = bundle.line_class(batch).where("line_class = 'ok'").select(
            F.col("id").alias("replay_id"), F.col("data").alias("doc"), "requested_rank")
        rank = F.coalesce(ladder.rank_name(ladder.division_rank(F.col("average_division"))), F.col("requested_rank"))
        # Labels are smaller than the summaries, so they are what is shuffled and sorted.
        labelled = labelling.with_labels(good).select(
            "replay_id", rank.alias("rank"), "average_division", "players", bucket_of("replay_id").alias("bucket"))
        if target is not None:
            # A rank that holds its target takes no more, so its replays need not be moved or compared.
            full = [r["rank"] for r in stores.held.read(number).where(F.col("n") >= target).collect()]  # the ladder at most
            labelled = labelled.where(F.col("rank").isNull() | ~F.col("rank").isin(full))
        labelled = materialize(labelled.dropDuplicates(["replay_id"]).where("rank IS NOT NULL"))
        buckets = [r["bucket"] for r in labelled.select("bucket").distinct().collect()]  # BUCKETS at most
        if buckets:
            keep(labelled, buckets, number)
        for each in stores.all():
            if each.due(number, compact_every):
                each.compact(number)

    def keep(labelled: DataFrame, buckets: list[int], number: int) -> None:
        fresh = labelled.join(known_replays(stores, buckets, number), ["bucket", "replay_id"], "left_anti")
        if target is not None:
            fresh = admit(fresh, stores.held.read(number), target)
        fresh = materialize(fresh)
        players = fresh.select("replay_id", "bucket", "average_division", F.explode("players").alias("p")).select(
            "replay_id", "bucket", "average_division", "p.*").dropDuplicates(["replay_id", "player_name"])
        players = labelling.impute_lobby_average(players).withColumn("bucket", bucket_of("replay_id"))
        stores.players.write(players, number)
        stores.held.write(fresh.groupBy("rank").agg(F.count(F.lit(1)).alias("n")), number)
        stores.replays.write(fresh, number)

    return _run(lines, store, checkpoint)


# --- status and progress -----------------------------------------------------------------


class Downloads(StatefulProcessor):
    """The newest status of a replay, and its way back into the queue when it stays in progress.

    State is held for replays in progress only: when the status came, and a timer in event time. A
    later status ends both; when the timer fires the replay is released.
    """

    def __init__(self, key: str, timeout_seconds: int) -> None:
        self._row, self._timeout = Row(key, "status", "changed_at", "event_id", "released"), timeout_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._running = handle.getValueState("running", "changed_at bigint, event_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda row: (row["changed_at"], row["event_id"]))
        best = int(newest["changed_at"]), int(newest["event_id"])
        # Each call of the state is a round trip to the JVM, so there is one where nothing is held or to be held.
        held = self._running.get()
        if held is not None and tuple(held) >= best:
            return
        if held is not None:
            self._handle.deleteTimer(self._fires(held[0]))
        if newest["status"] == catalog.RUNNING:
            self._running.update(best)
            self._handle.registerTimer(self._fires(best[0]))
        elif held is not None:
            self._running.clear()
        yield self._row(key[0], newest["status"], *best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._running.get()
        self._running.clear()
        yield self._row(key[0], catalog.PENDING, held[0], held[1], True)

    def _fires(self, changed_at: int) -> int:
        return (changed_at + self._timeout) * 1000

    def close(self) -> None:
        pass


def status_store(spark: SparkSession, path: str, key: str) -> BatchStore:
    """Newest status per replay; a release is newer than the status it ends."""
    schema = f"{key} bigint, status string, changed_at bigint, event_id bigint, released boolean"
    return BatchStore(spark, path, schema, newest([key], ["changed_at", "event_id", "released"]))


def track_status(
    events: DataFrame, key: str, timeout_seconds: int, path: str, checkpoint: str, compact_every: int = 0
) -> StreamingQuery:
    """Follow (key, status, changed_at, event_id), a stream with a watermark; replays in progress for
    more than the timeout, by the watermark, go back to the queue."""
    spark = events.sparkSession
    changes = events.groupBy(key).transformWithState(
        Downloads(key, timeout_seconds),
        outputStructType=f"{key} bigint, status string, changed_at bigint, event_id bigint, released boolean",
        outputMode="append",
        timeMode="EventTime",
    )
    with keyed_state(spark):
        return _run(changes, status_store(spark, path, key).sink(compact_every=compact_every), checkpoint)


def progress_counts(events: DataFrame, time: str, status: str, window: str, lateness: str) -> DataFrame:
    """Tumbling-window counts per status; rows later than the watermark are dropped."""
    return (
        events.withWatermark(time, lateness)
        .groupBy(F.window(time, window), status)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_timestamp("window.start").alias("window_start"), F.col(status).alias("status"), "n")
    )


def progress_store(spark: SparkSession, path: str) -> BatchStore:
    """The newest batch of a window and status is its value."""
    return BatchStore(spark, path, "window_start bigint, status string, n bigint", newest(["window_start", "status"], [NUMBER]))


def track_progress(counts: DataFrame, path: str, checkpoint: str, compact_every: int = 0) -> StreamingQuery:
    store = progress_store(counts.sparkSession, path)
    return _run(counts, store.sink(compact_every=compact_every), checkpoint, "update")


# --- live segments -----------------------------------------------------------------------

#: Seconds of event time that an unfinished segment is waited for.
LATENESS = 3600
#: Copies of a roster, so that the frames of a hot game meet theirs on several tasks.
ROSTER_COPIES = 8
#: What is kept between batches: frames that wait, and the state of each segment on its last row.
OPEN = (
    "game_id bigint, segment bigint, rn bigint, numbers array<double>, inputs array<double>, sums array<double>, "
    "ready boolean, open boolean, is_end boolean, seen_ms bigint, done bigint, carry array<double>"
)


def segment_frames(
    frames: DataFrame, rosters: DataFrame, length: int, event_time: str, lateness_seconds: int = LATENESS
) -> DataFrame:
    """Subsampled frames with their position and segment, cars in roster order, as two arrays of numbers.

    `event_time` carries the watermark by which the state of unfinished segments ends. Without goal
    trimming the position follows from the frame number, so the stream can be keyed by
    (game, segment): state per key is at most one segment, and a long game spreads over its segments.
    """
    rn = F.floor(F.col("frame_idx") / 2)
    kept = frames.where(F.pmod(F.col("frame_idx"), F.lit(2)) == 0).withColumns(
        {"rn": rn, "segment": F.floor(rn / length), "event_time": F.col(event_time)})
    kept = kept.withWatermark("event_time", f"{lateness_seconds} seconds").withColumn("_copy", F.pmod("segment", F.lit(ROSTER_COPIES)))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ROSTER_COPIES - 1).cast("bigint")))
    # Each batch reads the rosters; they are made once.
    placed = ft.with_slots(kept.join(materialize(rosters).withColumn("_copy", copies), ["game_id", "_copy"], "left"))
    return placed.selectExpr(
        "game_id", "segment", "rn", "event_time", f"{ft.frame_numbers()} AS numbers", f"{ft.fold_inputs()} AS inputs")


class Assembly(NamedTuple):
    """Frames of a stream and how their segments are put together."""

    frames: DataFrame
    length: int
    live: bool
    lateness_ms: int


def assemble(frames: DataFrame, length: int, live: bool = False, lateness_seconds: int = LATENESS) -> Assembly:
    """Frames in the order of their segment, with running sums, each once.

    Complete segments come out whole; with `live`, frames come out as soon as all earlier frames of
    their segment are there. Files may arrive in any order, and repeated frames are ignored. The state of a
    segment goes once nothing has arrived for it for `lateness_seconds` of event time.
    """
    return Assembly(frames, length, live, lateness_seconds * 1000)


_GROUP = "PARTITION BY game_id, segment"
_SO_FAR = f"OVER ({_GROUP} ORDER BY rn, fresh ROWS UNBOUNDED PRECEDING)"
_BEFORE = f"OVER ({_GROUP} ORDER BY rn, fresh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _folded(rows: DataFrame) -> DataFrame:
    """Add the running sums, and `after`: the sums and boosts that later frames go on from.

    The state of a segment is its first row (rn is null) and starts the sums.
    """
    width = len(ft.SUMS) + 1
    known = [f"CASE WHEN rn IS NULL THEN carry[{s * width + width - 1}] WHEN inputs[{s * 5 + 4}] > 0 THEN inputs[{s * 5}] END"
             for s in range(ft.SLOTS)]
    rows = rows.selectExpr("*", *(f"coalesce(last({k}, true) {_BEFORE}, 0.0D) AS _b{s}" for s, k in enumerate(known)))
    sums, after = [], []
    for s in range(ft.SLOTS):
        now, here = f"inputs[{s * 5}]", f"inputs[{s * 5 + 4}] > 0"
        gained = f"{now} > _b{s} + {ft.BOOST_GAIN_STEP}D"
        steps = [
            f"CASE WHEN {here} AND {gained} THEN {now} - _b{s} ELSE 0.0D END",
            f"CASE WHEN {here} AND NOT ({gained}) AND {now} < _b{s} - {ft.BOOST_SPEND_STEP}D THEN _b{s} - {now} ELSE 0.0D END",
            *(f"inputs[{s * 5 + i}]" for i in range(1, 5)),
        ]
        names = [f"_s{s}_{i}" for i in range(len(steps))]
        sums += [f"sum(if(rn IS NULL, coalesce(carry[{s * width + i}], 0.0D), {step})) {_SO_FAR} AS {name}"
                 for i, (step, name) in enumerate(zip(steps, names))]
        sums.append(f"coalesce(last({known[s]}, true) {_SO_FAR}, 0.0D) AS _k{s}")
        after += [*names, f"_k{s}"]
    own = [n for n in after if n.startswith("_s")]
    kept = [c for c in rows.columns if not c.startswith("_b")]
    return rows.selectExpr(*rows.columns, *sums).selectExpr(
        *kept, f"array({', '.join(own)}) AS sums", f"array({', '.join(after)}) AS after")


def advance(fresh: DataFrame, held: DataFrame, assembled: Assembly, watermark: int) -> DataFrame:
    """One batch: rows OPEN from the frames that arrived and the rows that the batch before left open.

    Windows over one segment only; a segment's rows are its state, if any, the frames that waited and the new ones.
    """
    late = f"event_ms <= {watermark}L"
    nothing = "cast(NULL AS array<double>)"
    new = fresh.where(f"NOT ({late})").selectExpr(
        "game_id", "segment", "rn", "1 AS fresh", "event_ms AS seen_ms", "numbers", "inputs", "cast(NULL AS bigint) AS done", f"{nothing} AS carry")
    held = held.where("open")
    waiting = held.where("NOT ready AND rn IS NOT NULL").selectExpr(
        "game_id", "segment", "rn", "0 AS fresh", "seen_ms", "numbers", "inputs", "cast(NULL AS bigint) AS done", f"{nothing} AS carry")
    state = held.where("is_end").selectExpr(
        "game_id", "segment", "cast(NULL AS bigint) AS rn", "0 AS fresh", "seen_ms", f"{nothing} AS numbers", f"{nothing} AS inputs", "done", "carry")
    first = f"segment * {assembled.length} + was_done"
    rows = new.unionByName(waiting).unionByName(state).selectExpr(
        "*", f"coalesce(max(done) OVER ({_GROUP}), 0L) AS was_done", f"max(seen_ms) OVER ({_GROUP}) AS last_ms",
        f"lag(rn) OVER ({_GROUP} ORDER BY rn, fresh) AS rn_before")
    rows = rows.where(f"rn IS NULL OR (rn >= {first} AND NOT (rn <=> rn_before))")
    if assembled.live:
        ready = f"coalesce(rn = {first} + count(rn) {_SO_FAR} - 1, false)"
    else:
        ready = f"rn IS NOT NULL AND count(rn) OVER ({_GROUP}) = {assembled.length}"
    rows = _folded(rows.selectExpr("*", f"{ready} AS ready"))
    rows = rows.selectExpr("*", f"lead(1) OVER ({_GROUP} ORDER BY rn, fresh) IS NULL AS is_end", f"was_done + count_if(ready) {_SO_FAR} AS now_done",
                           f"last(CASE WHEN ready THEN after WHEN rn IS NULL THEN carry END, true) {_SO_FAR} AS now_carry")
    # Sums of a whole segment are not gone on from.
    goes_on = f"is_end AND now_done < {assembled.length}" if assembled.live else "false"
    return rows.selectExpr(
        "game_id", "segment", "rn", "numbers", "if(ready, NULL, inputs) AS inputs", "if(ready, sums, NULL) AS sums", "ready",
        f"last_ms + {assembled.lateness_ms}L > {watermark}L AS open", "is_end", "last_ms AS seen_ms", "if(is_end, now_done, NULL) AS done",
        f"if({goes_on}, now_carry, NULL) AS carry")


def live_features(
    assembled: Assembly, path: str, checkpoint: str, finish: Callable[[DataFrame], DataFrame] = lambda vectors: vectors
) -> StreamingQuery:
    """Feature vectors of each batch, then `finish` (such as a scorer), written under the batch number.

    The sums arrive with the frames, so vectors are expressions of one row: no window, no shuffle. What
    stays open is a table per batch, beside the output, made from that of the batch before; a batch that is run
    again makes the same. The clock is the newest event time up to a batch.
    """
    spark = assembled.frames.sparkSession
    opened, clocks = (BatchStore(spark, f"{path}/_{name}", schema) for name, schema in (("open", OPEN), ("clock", "at bigint")))

    def write(batch: DataFrame, number: int) -> None:
        at = clocks.batch(number - 1).first()
        clock = at["at"] if at else 0
        watermark = max(clock - assembled.lateness_ms, 0)
        fresh = batch.withColumn("event_ms", F.unix_millis("event_time"))
        opened.write(advance(fresh, opened.batch(number - 1), assembled, watermark), number)
        rows = opened.batch(number)
        newest_ms = rows.agg(F.max("seen_ms").alias("at")).select(F.greatest("at", F.lit(clock).cast("bigint")).alias("at"))
        vectors = ft.vectors_of(ft.restore_slots(rows.where("ready")), with_context=False)
        finish(vectors).write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
        clocks.write(newest_ms, number)
        opened.drop(number - 2)

    return _run(assembled.frames, write, checkpoint)
