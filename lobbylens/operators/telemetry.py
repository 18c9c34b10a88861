"""Frames, goals and kickoffs: trimming, scores, clocks and timelines.

Frames are keyed by (game_id, frame_idx); frame_idx is unique within a game.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobbylens.functions import vectors as v
from lobbylens.operators.scan import Fold, attach_group, prefix_scan, span

# Every second frame counts, goals hide ten seconds, a match lasts five minutes.
SUBSAMPLE = 2
GOAL_TRIM_FRAMES = 600
REGULATION_SECONDS = 300
KEY = ["game_id"]
ORDER = ["frame_idx"]


def subsample(frames: DataFrame, step: int = SUBSAMPLE) -> DataFrame:
    """Every step-th frame by its original index."""
    return frames.where(F.pmod(F.col("frame_idx"), F.lit(step)) == 0)


def mark_frames(frames: DataFrame, goals: DataFrame, kickoffs: DataFrame) -> DataFrame:
    """Add goals per team and a kickoff flag to each frame. Frame 0 is always a kickoff."""
    scored = goals.groupBy("game_id", F.col("frame").alias("frame_idx")).agg(
        F.count_if(F.col("player_team") == 0).alias("goal_blue"),
        F.count_if(F.col("player_team") == 1).alias("goal_orange"),
    )
    kicked = (
        kickoffs.select("game_id", F.col("frame").alias("frame_idx")).distinct().withColumn("_kick", F.lit(True))
    )
    key = KEY + ORDER
    return (
        frames.join(scored, key, "left")
        .join(kicked, key, "left")
        .withColumn("goal_blue", F.coalesce("goal_blue", F.lit(0)))
        .withColumn("goal_orange", F.coalesce("goal_orange", F.lit(0)))
        .withColumn("is_kickoff", F.coalesce("_kick", F.col("frame_idx") == 0))
        .drop("_kick")
    )


def _is_goal() -> Column:
    return F.col("goal_blue") + F.col("goal_orange") > 0


def score_folds() -> list[Fold]:
    return [Fold("blue", "sum", F.col("goal_blue")), Fold("orange", "sum", F.col("goal_orange"))]


def trim_folds() -> list[Fold]:
    at = F.col("frame_idx")
    return [
        Fold("_last_goal", "max", F.when(_is_goal(), at), exclusive=True),
        Fold("_last_kickoff", "max", F.when(F.col("is_kickoff"), at)),
    ]


def is_trimmed() -> Column:
    """Between a goal and the next kickoff, at most GOAL_TRIM_FRAMES - 1 frames.

    A frame lies inside some goal's window exactly if it lies inside the window
    of the newest goal before it, so two running maxima decide.
    """
    last, kickoff = F.col("_last_goal"), F.coalesce("_last_kickoff", F.lit(-1))
    inside = (kickoff <= last) & (F.col("frame_idx") < last + GOAL_TRIM_FRAMES)
    return F.coalesce(inside, F.lit(False))


def trim_goal_windows(marked: DataFrame) -> DataFrame:
    """Drop replay footage after goals; the goal frame itself stays."""
    scanned = prefix_scan(marked, KEY, ORDER, trim_folds())
    return scanned.where(~is_trimmed()).select(*marked.columns)


def running_score(marked: DataFrame) -> DataFrame:
    """Score at each frame, counting a goal from its own frame on."""
    return prefix_scan(marked, KEY, ORDER, score_folds())


def next_kickoff(marked: DataFrame) -> DataFrame:
    """Goal frames with the first kickoff strictly after them, NULL if none."""
    fold = Fold("next_kickoff", "min", F.when(F.col("is_kickoff"), F.col("frame_idx")), exclusive=True)
    return prefix_scan(marked, KEY, ORDER, [fold], reverse=True).where(_is_goal())


def goal_markers(goals: DataFrame, frames: DataFrame) -> DataFrame:
    """Goal time and the scorer's lane in the first frame; goals without a frame are dropped."""
    lanes = frames.groupBy("game_id").agg(F.min_by("players", "frame_idx").alias("_players"))
    times = frames.select("game_id", F.col("frame_idx").alias("frame"), "time")
    timed = goals.join(times, ["game_id", "frame"])
    placed = attach_group(timed, lanes, KEY, span("frame"))
    names = F.transform(F.slice("_players", 1, 6), lambda p: p["name"])
    lane = F.nullif(F.array_position(names, F.col("player_name")), F.lit(0).cast("bigint")) - 1
    return placed.select(*goals.columns, "time", lane.cast("int").alias("lane"))


def score_timeline(markers: DataFrame, order: list[str]) -> DataFrame:
    """Goals in time order with the score after each as `blue-orange`."""
    folds = [
        Fold("_b", "sum", (F.col("player_team") == 0).cast("int")),
        Fold("_o", "sum", (F.col("player_team") == 1).cast("int")),
    ]
    scored = prefix_scan(markers, KEY, order, folds)
    return scored.withColumn(
        "score_label", F.concat(F.col("_b").cast("string"), F.lit("-"), F.col("_o").cast("string"))
    ).drop("_b", "_o")


def roster(cars: DataFrame) -> DataFrame:
    """The first three names of each team by bytes; slots 0-2 blue, 3-5 orange.

    Names are made distinct map-side, and the limit of three per team is applied
    before the shuffle, so a long game costs no more than a short one.
    """
    names = cars.select("game_id", "team", "name").distinct()
    by_name = W.partitionBy("game_id", "team").orderBy("name")
    slotted = names.withColumn("_n", F.row_number().over(by_name)).where(F.col("_n") <= 3)
    slot = F.col("team") * 3 + F.col("_n") - 1
    return slotted.groupBy("game_id").agg(
        F.array(
            *(F.coalesce(F.max(F.when(slot == s, F.col("name"))), F.lit("")) for s in range(6))
        ).alias("roster")
    )


def play_time(frames: DataFrame) -> DataFrame:
    """Seconds of play at each frame, running on past the end of the clock."""
    remaining = F.col("seconds_remaining")
    clock = frames.groupBy("game_id").agg(
        F.min_by(remaining, "frame_idx").cast("double").alias("_regulation"),
        F.min_by("time", F.when(remaining <= 0, F.col("frame_idx"))).alias("_zero_time"),
    )
    joined = attach_group(frames, clock, KEY, span("frame_idx"))
    over = F.greatest(F.lit(0.0), F.col("time") - F.col("_zero_time"))
    seconds = F.when(remaining > 0, F.col("_regulation") - remaining).otherwise(
        F.col("_regulation") + F.coalesce(over, F.lit(0.0))
    )
    return joined.withColumn("play_time", seconds).drop("_regulation", "_zero_time")


def segment_count(kept_frames: Column, length: int) -> Column:
    """Whole segments; a short game still has one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(kept_frames / length))


def original_bounds(start: Column, end: Column, frame_count: Column, step: int = SUBSAMPLE):
    """Subsampled half-open bounds -> original half-open bounds, at least one frame long."""
    first = F.least(start * step, frame_count - 1)
    last = F.least(end * step, frame_count)
    return first, F.when(last <= first, F.least(first + 1, frame_count)).otherwise(last)


def segment_bounds(frames: DataFrame, length: int) -> DataFrame:
    """Start and end frame and time of every segment on the original frame axis."""
    counted = frames.groupBy("game_id").agg(F.count(F.lit(1)).alias("frame_count"))
    kept = F.ceil(F.col("frame_count") / SUBSAMPLE)
    numbered = counted.withColumn(
        "segment", F.explode(F.sequence(F.lit(0).cast("bigint"), segment_count(kept, length) - 1))
    )
    start = F.col("segment") * length
    first, last = original_bounds(start, F.least(start + length, kept), F.col("frame_count"))
    bounded = numbered.select("game_id", "segment", first.alias("start_frame"), last.alias("end_frame"))

    def time_at(df: DataFrame, frame: Column, name: str) -> DataFrame:
        times = frames.select("game_id", F.col("frame_idx").alias("_at"), F.col("time").alias(name))
        return df.withColumn("_at", frame).join(times, ["game_id", "_at"], "left").drop("_at").withColumn(
            name, F.coalesce(name, F.lit(0.0))
        )

    return time_at(time_at(bounded, F.col("start_frame"), "start_time"), F.col("end_frame") - 1, "end_time")


def game_context(seconds_remaining: str, own: str, other: str) -> tuple[str, str, str]:
    """Expression texts: scaled score difference, scaled time left, overtime flag."""
    return (
        v.clamp(f"(({own}) - ({other})) / 5.0D", -1.0, 1.0),
        v.clamp(f"({seconds_remaining}) / {float(REGULATION_SECONDS)}D", 0.0, 1.0),
        f"if(({seconds_remaining}) <= 0, 1.0D, 0.0D)",
    )


def rising_edges(frames: DataFrame, condition: Column, keys=KEY, order=ORDER) -> DataFrame:
    """Frames where the condition turns true, plus frame 0, which always counts."""
    flagged = frames.withColumn("_on", F.coalesce(condition, F.lit(False)))
    scanned = prefix_scan(flagged, keys, order, [Fold("_was", "last", F.col("_on"), exclusive=True)])
    edge = F.col("_on") & ~F.coalesce("_was", F.lit(False)) & (F.col(order[0]) > 0)
    return scanned.where(edge | (F.col(order[0]) == 0)).drop("_on", "_was")


def ball_kickoffs(log: DataFrame) -> DataFrame:
    """Kick-off frames (game_id, frame) from the log of ball actors: frame 0, and every later frame in
    which some ball comes to lie at the centre after a frame in which none did.

    log: game_id, actor_id, frame_idx, seq (a whole number, unique in the game), kind (new, update,
    delete), position and velocity; NULL leaves them as they were, and a new actor starts at rest at the centre.
    State is carried along each actor; a frame then adds up how many actors enter and leave the
    centre, so the running sum is the number of balls there and frames are never paired with actors.
    """
    actor, at = ["game_id", "actor_id"], F.col("seq")

    def newest(value: Column) -> Column:
        return F.when(value.isNotNull() & (F.col("kind") != "delete"), F.struct(at.alias("at"), value.alias("v")))

    folds = [
        Fold("_born", "max", F.when(F.col("kind") == "new", at)),
        Fold("_died", "max", F.when(F.col("kind") == "delete", at)),
        Fold("_pos", "last", newest(F.col("position"))),
        Fold("_vel", "last", newest(F.col("velocity"))),
    ]
    scanned = prefix_scan(log, actor, ["seq"], folds)

    def carried(name: str) -> Column:
        rest = F.struct(*(F.lit(0.0).alias(axis) for axis in "xyz"))
        return F.when(F.col(f"{name}.at") >= F.col("_born"), F.col(f"{name}.v")).otherwise(rest)

    alive = F.col("_born").isNotNull() & (F.coalesce("_died", F.lit(-1)) < F.col("_born"))
    centred = alive & F.coalesce(ball_at_centre(carried("_pos"), carried("_vel")), F.lit(False))
    ends = scanned.groupBy(*actor, "frame_idx").agg(F.max_by(centred, "seq").alias("_now"))
    moves = prefix_scan(ends, actor, ORDER, [Fold("_was", "last", F.col("_now"), exclusive=True)])
    change = F.col("_now").cast("int") - F.coalesce("_was", F.lit(False)).cast("int")
    changes = moves.groupBy(*KEY, *ORDER).agg(F.sum(change).alias("_change"))
    here = prefix_scan(changes, KEY, ORDER, [Fold("_balls", "sum", F.col("_change"))])
    starts = here.where((F.col("_balls") > 0) & (F.col("_balls") == F.col("_change")) & (F.col("frame_idx") > 0))
    first = log.select("game_id", F.lit(0).cast("bigint").alias("frame")).distinct()
    return starts.select("game_id", F.col("frame_idx").alias("frame")).union(first)


def ball_at_centre(position: Column, velocity: Column) -> Column:
    near = (F.abs(position["x"]) < 10.0) & (F.abs(position["y"]) < 10.0)
    return near & (F.abs(velocity["x"]) < 1.0) & (F.abs(velocity["y"]) < 1.0)


