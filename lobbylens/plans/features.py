"""Player-centric feature vectors: 106 numbers per frame and roster slot.

A frame stays one row with its cars nested until the very end, so team-mates
and opponents are array picks and not joins. The wide rows are shuffled twice:
by (game, chunk) for the running score and the renumbering, and by
(game, segment) for the statistics that restart with each segment. Both keys
have a bounded number of rows, so a hot game spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobbylens.functions import vectors as v
from lobbylens.operators import telemetry as tel
from lobbylens.operators.scan import Fold, prefix_scan

# Sizes and thresholds of the feature layout.
SLOTS = 6
TEAM = 3
FEATURES = 106
STATE_WIDTH = 13
OPPONENT_WIDTH = 12
SEGMENT_BOOST = 300.0
AIRBORNE_HEIGHT = 25.0
SUPERSONIC_SPEED = 2200.0
BOOST_GAIN_STEP = 5.0
BOOST_SPEND_STEP = 1.0
ABSENT_DISTANCE = 3.4028234663852886e38

# Positions of the focal player's cumulative and instantaneous features.
CUMULATIVE = range(22, 27)
SPEED, BOOST, DEMOLISHED, BALL_DISTANCE = 17, 18, 19, 20


def zeros(n: int) -> str:
    return f"array_repeat(0.0D, {n})"


def _numbers(*values: str) -> str:
    return "array(" + ", ".join(f"cast({x} AS double)" for x in values) + ")"


def with_slots(frames: DataFrame) -> DataFrame:
    """Six car columns in roster order; NULL when absent, the last one on a repeated name."""
    kept = [c for c in frames.columns if c not in ("players", "roster")]
    places = frames.selectExpr("*", "reverse(players.name) AS _names").selectExpr(
        "*", *(f"size(players) - array_position(_names, get(roster, {s})) AS _i{s}" for s in range(SLOTS))
    )
    return places.selectExpr(*kept, *(f"get(players, cast(_i{s} AS int)) AS p{s}" for s in range(SLOTS)))


def _numbered(frames: DataFrame, length: int, attach: DataFrame | None = None) -> DataFrame:
    one = F.lit(1)
    folds = [Fold("rn", "count", one, exclusive=True), Fold("n_kept", "count", one, whole=True)]
    numbered = prefix_scan(frames, tel.KEY, tel.ORDER, folds, attach=attach)
    return numbered.withColumn("rn", F.col("rn").cast("bigint")).withColumn(
        "segment", F.floor(F.col("rn") / length)
    )


def training_frames(marked: DataFrame, rosters: DataFrame, length: int) -> DataFrame:
    """Marked frames -> subsampled frames without goal footage, renumbered, with score and segment."""
    folds = tel.score_folds() + tel.trim_folds()
    scanned = prefix_scan(marked, tel.KEY, tel.ORDER, folds, attach=rosters, keep_chunk=True)
    kept = tel.subsample(scanned.where(~tel.is_trimmed()))
    dropped = ("goal_blue", "goal_orange", "is_kickoff", "_last_goal", "_last_kickoff")
    return with_slots(_numbered(kept.drop(*dropped), length))


def inference_frames(frames: DataFrame, rosters: DataFrame, length: int) -> DataFrame:
    """Subsampled frames as they come; the score is not known while a game runs."""
    return with_slots(_numbered(tel.subsample(frames), length, attach=rosters))


def with_cumulative(segmented: DataFrame) -> DataFrame:
    """Per slot c0..c5: boost gained and spent, airborne, supersonic and demolished
    frames, and frames present, since the start of the segment.

    Windows run over one segment. An absent car leaves its state as it was.
    """
    over = "OVER (PARTITION BY game_id, segment ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND"
    previous = segmented.selectExpr(
        "*",
        *(
            f"coalesce(last(p{s}.boost * 100.0D, true) {over} 1 PRECEDING), 0.0D) AS _b{s}"
            for s in range(SLOTS)
        ),
    )

    def run(condition: str, value: str) -> str:
        return f"coalesce(sum(CASE WHEN {condition} THEN {value} END) {over} CURRENT ROW), 0.0D)"

    def state(s: int) -> str:
        now, was, alive = f"p{s}.boost * 100.0D", f"_b{s}", f"NOT p{s}.is_demolished"
        gained = f"{now} > {was} + {BOOST_GAIN_STEP}D"
        fields = {
            "gained": run(gained, f"{now} - {was}"),
            "spent": run(f"NOT ({gained}) AND {now} < {was} - {BOOST_SPEND_STEP}D", f"{was} - {now}"),
            "airborne": run(f"{alive} AND p{s}.pos.z > {AIRBORNE_HEIGHT}D", "1.0D"),
            "supersonic": run(f"{alive} AND {v.magnitude(f'p{s}.vel')} > {SUPERSONIC_SPEED}D", "1.0D"),
            "demolished": run(f"p{s}.is_demolished", "1.0D"),
            "present": f"count(p{s}.boost) {over} CURRENT ROW)",
        }
        return "named_struct(" + ", ".join(f"'{n}', {x}" for n, x in fields.items()) + f") AS c{s}"

    return previous.selectExpr(*segmented.columns, *(state(s) for s in range(SLOTS)))


# The same sums, folded frame by frame as they arrive. A frame is two arrays of numbers: what the
# vectors need, and per slot what the sums need.
CAR_NUMBERS = ["pos.x", "pos.y", "pos.z", "vel.x", "vel.y", "vel.z", "rot.x", "rot.y", "rot.z", "rot.w", "boost"]
CAR_WIDTH = len(CAR_NUMBERS) + 2  # and: demolished, present
BALL_NUMBERS = ["ball_pos.x", "ball_pos.y", "ball_pos.z", "ball_vel.x", "ball_vel.y", "ball_vel.z"]
SUMS = ("gained", "spent", "airborne", "supersonic", "demolished", "present")


def frame_numbers() -> str:
    """Ball and slotted cars of a frame as one array; restore_slots turns it back."""
    cars = [
        value
        for s in range(SLOTS)
        for value in (
            *(f"coalesce(p{s}.{n}, 0.0D)" for n in CAR_NUMBERS),
            f"if(p{s}.is_demolished, 1.0D, 0.0D)", f"if(p{s} IS NULL, 0.0D, 1.0D)",
        )
    ]
    return _numbers(*BALL_NUMBERS, *cars)


def fold_inputs() -> str:
    """Per slot: boost of 100, airborne, supersonic and demolished (1 or 0), present (1 or 0)."""
    values = []
    for s in range(SLOTS):
        alive = f"NOT p{s}.is_demolished"
        values += [
            f"coalesce(p{s}.boost * 100.0D, 0.0D)", f"if({alive} AND p{s}.pos.z > {AIRBORNE_HEIGHT}D, 1.0D, 0.0D)",
            f"if({alive} AND {v.magnitude(f'p{s}.vel')} > {SUPERSONIC_SPEED}D, 1.0D, 0.0D)",
            f"if(p{s}.is_demolished, 1.0D, 0.0D)", f"if(p{s} IS NULL, 0.0D, 1.0D)",
        ]
    return _numbers(*values)


def fold_segment(inputs: np.ndarray, carry: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums at each of the next frames of a segment, and what the frames after them need.

    inputs: fold_inputs of the frames, in order. carry: of the frames before, none at the start.
    """
    n = len(inputs)
    boost, *flags, present = np.moveaxis(np.asarray(inputs, np.float64).reshape(n, SLOTS, 5), 2, 0)
    state = np.zeros((SLOTS, len(SUMS) + 1)) if carry is None else np.asarray(carry, np.float64).reshape(SLOTS, len(SUMS) + 1)
    here = present > 0
    # Boost of the last frame before in which the car was there.
    known = np.vstack([state[:, -1], boost])
    at = np.maximum.accumulate(np.where(np.vstack([np.ones(SLOTS, bool), here]), np.arange(n + 1)[:, None], 0))
    was = np.take_along_axis(known, at[:-1], 0)
    gained = here & (boost > was + BOOST_GAIN_STEP)
    spent = here & ~gained & (boost < was - BOOST_SPEND_STEP)
    steps = [np.where(gained, boost - was, 0.0), np.where(spent, was - boost, 0.0), *flags, present]
    sums = np.stack([np.cumsum(np.vstack([state[:, i], step]), axis=0)[1:] for i, step in enumerate(steps)], axis=2)
    last = np.take_along_axis(known, at[-1:], 0)[0]
    return sums.reshape(n, -1), np.column_stack([sums[-1], last]).ravel()


def restore_slots(frames: DataFrame) -> DataFrame:
    """Frames as numbers and sums -> slotted frames with their cumulative state."""

    def vec(base: int, name: str) -> str:
        axes = "xyzw" if name == "rot" else "xyz"
        first = base + CAR_NUMBERS.index(f"{name}.x")
        return "named_struct(" + ", ".join(f"'{a}', numbers[{first + i}]" for i, a in enumerate(axes)) + ")"

    def car(s: int) -> str:
        base = len(BALL_NUMBERS) + s * CAR_WIDTH
        fields = [f"'{name}', {vec(base, name)}" for name in ("pos", "vel", "rot")]
        fields += [f"'boost', numbers[{base + CAR_NUMBERS.index('boost')}]", f"'is_demolished', numbers[{base + CAR_WIDTH - 2}] = 1"]
        return f"if(numbers[{base + CAR_WIDTH - 1}] = 0, NULL, named_struct({', '.join(fields)})) AS p{s}"

    def state(s: int) -> str:
        return "named_struct(" + ", ".join(f"'{n}', sums[{s * len(SUMS) + i}]" for i, n in enumerate(SUMS)) + f") AS c{s}"

    balls = [
        f"named_struct('x', numbers[{i}], 'y', numbers[{i + 1}], 'z', numbers[{i + 2}]) AS {name}"
        for i, name in ((0, "ball_pos"), (3, "ball_vel"))
    ]
    keys = ["game_id", "segment", "rn", f"rn * {tel.SUBSAMPLE} AS frame_idx", "0 AS n_kept"]
    return frames.selectExpr(*keys, *balls, *(car(s) for s in range(SLOTS)), *(state(s) for s in range(SLOTS)))


def fraction(slot: int, name: str) -> str:
    return f"c{slot}.{name} / greatest(c{slot}.present, 1)"


def team_slots(slot: int) -> range:
    return range(0, TEAM) if slot < TEAM else range(TEAM, SLOTS)


def mates(slot: int) -> list[int]:
    return [s for s in team_slots(slot) if s != slot]


def opponents(slot: int) -> list[int]:
    return [s for s in range(SLOTS) if s not in team_slots(slot)]


def out_of_play(slot: int) -> str:
    return f"coalesce(p{slot}.is_demolished, true)"


def with_ball_distances(df: DataFrame) -> DataFrame:
    """d0..d5: distance to the ball, the largest float when absent or demolished."""
    return df.selectExpr(
        "*",
        *(
            f"if({out_of_play(s)}, {ABSENT_DISTANCE}D, {v.distance(f'p{s}.pos', 'ball_pos')}) AS d{s}"
            for s in range(SLOTS)
        ),
    )


def role_rank(slot: int) -> str:
    """0 closest .. 2 third of the team; ties go to the lower slot."""
    return " + ".join(
        f"if(d{s} {'<=' if s < slot else '<'} d{slot}, 1, 0)" for s in mates(slot)
    )


def player_block(p: str) -> str:
    """13 numbers of a player; zeros and a flag when demolished, zeros when absent."""
    values = [
        *v.scaled_position(f"{p}.pos"),
        *v.scaled_velocity(f"{p}.vel", v.MAX_CAR_SPEED),
        *(f"{p}.rot.{axis}" for axis in "xyzw"),
        f"least({v.magnitude(f'{p}.vel')} / {v.MAX_CAR_SPEED}D, 1.0D)",
        f"{p}.boost",
        "0.0D",
    ]
    gone = f"concat({zeros(STATE_WIDTH - 1)}, array(1.0D))"
    return (
        f"CASE WHEN {p} IS NULL THEN {zeros(STATE_WIDTH)} WHEN {p}.is_demolished THEN {gone} "
        f"ELSE {_numbers(*values)} END"
    )


def opponent_block(block: str) -> str:
    """The 12 numbers of a player block that an opponent may see: all but the boost."""
    return f"concat(slice({block}, 1, {OPPONENT_WIDTH - 1}), slice({block}, {STATE_WIDTH}, 1))"


def _ball_block() -> str:
    speed = f"least({v.magnitude('ball_vel')} / {v.MAX_BALL_SPEED}D, 1.0D)"
    return _numbers(*v.scaled_position("ball_pos"), *v.scaled_velocity("ball_vel", v.MAX_BALL_SPEED), speed)


# Slots seen from each focal slot: two mates, then three opponents.
VIEW = [mates(s) + opponents(s) for s in range(SLOTS)]


def _near(distance: str) -> str:
    return f"least({distance} / {v.DIAGONAL}D, 1.0D)"


def _relations(n: int) -> str:
    """Distance of the n-th other car to the ball and to the focal car."""
    gap = v.scaled_distance(f"q{n}.pos", "me.pos")
    return f"if(coalesce(q{n}.is_demolished, true), {zeros(2)}, array({_near(f'd[v{n}]')}, {gap}))"


def _vector(with_context: bool) -> str:
    """The 106 numbers of the focal car `me` in `slot`."""
    facing = v.facing("me.pos", "me.rot", "ball_pos", "d[slot]")
    own_ball = f"if(me.is_demolished, {zeros(2)}, array({_near('d[slot]')}, {facing}))"
    cumulative = _numbers(
        f"least(mine.gained / {SEGMENT_BOOST}D, 1.0D)",
        f"least(mine.spent / {SEGMENT_BOOST}D, 1.0D)",
        *(f"mine.{name} / greatest(mine.present, 1)" for name in ("airborne", "supersonic", "demolished")),
    )
    if with_context:
        lead, left, over = tel.game_context("seconds_remaining", "blue", "orange")
        context = _numbers(f"if(slot < {TEAM}, {lead}, -({lead}))", left, over)
    else:
        context = zeros(3)
    parts = [
        "ball",
        "s[slot]",
        own_ball,
        cumulative,
        "s[v0]",
        "s[v1]",
        _relations(0),
        _relations(1),
        *(opponent_block(f"s[v{n}]") for n in (2, 3, 4)),
        *(_relations(n) for n in (2, 3, 4)),
        "array(goal_distance)",
        context,
        # A lambda keeps the projection out of whole-stage code, in which all 106 numbers would be one method
        # too long for the JVM to compile, whatever the session says; by itself it is split into short ones.
        f"transform(sequence(0, {TEAM - 1}), k -> if(roles[slot] = k, 1.0D, 0.0D))",
    ]
    return f"if(me IS NULL, {zeros(FEATURES)}, concat({', '.join(parts)}))"


def feature_vectors(segmented: DataFrame, with_context: bool = True) -> DataFrame:
    """(game, frame, rn, segment, slot, features) from training or inference frames."""
    return vectors_of(with_cumulative(segmented), with_context)


def vectors_of(summed: DataFrame, with_context: bool = True) -> DataFrame:
    """The vectors of slotted frames with their cumulative state.

    Slot columns become arrays before the frame is repeated per slot, so one
    vector expression serves all six and stays small enough to be compiled.
    """
    near = with_ball_distances(summed)
    keys = ["game_id", "frame_idx", "rn", "segment", "n_kept"]
    context = ["seconds_remaining", "blue", "orange"] if with_context else []

    def slots(name: str) -> str:
        return "array(" + ", ".join(f"{name}{s}" for s in range(SLOTS)) + ")"

    blocks = near.selectExpr(
        "*",
        f"{_ball_block()} AS ball",
        f"{v.scaled_distance('ball_pos', v.vec3(*v.BLUE_GOAL))} AS goal_distance",
        *(f"{player_block(f'p{s}')} AS s{s}" for s in range(SLOTS)),
        "array(" + ", ".join(role_rank(s) for s in range(SLOTS)) + ") AS roles",
    )
    gathered = blocks.selectExpr(
        *keys, *context, "ball_pos", "ball", "goal_distance", "roles",
        *(f"{slots(n)} AS {n}" for n in "pscd"),
    )
    views = ", ".join("array(" + ", ".join(map(str, view)) + ")" for view in VIEW)
    focal = gathered.selectExpr("*", f"posexplode(array({views})) AS (slot, view)").selectExpr(
        "*", *(f"view[{n}] AS v{n}" for n in range(5))
    )
    seen = focal.selectExpr("*", "p[slot] AS me", "c[slot] AS mine", *(f"p[v{n}] AS q{n}" for n in range(5)))
    return seen.selectExpr(*keys, "slot", f"{_vector(with_context)} AS features")


def by_slot(df: DataFrame, keep: list[str], **values: Callable[[int], str]) -> DataFrame:
    """Slot-wise columns -> one row per slot: name -> expression text of the slot."""
    rows = ", ".join(
        "named_struct(" + ", ".join([f"'slot', {s}", *(f"'{n}', {f(s)}" for n, f in values.items())]) + ")"
        for s in range(SLOTS)
    )
    return df.selectExpr(*keep, f"explode(array({rows})) AS x").selectExpr(*keep, "x.*")
