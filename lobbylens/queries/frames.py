"""Checked queries: telemetry, features and segments. Segments are ten frames long."""

from __future__ import annotations

from pyspark.sql import functions as F

from lobbylens.functions import labels
from lobbylens.functions import vectors as v
from lobbylens.operators import labelling, probe
from lobbylens.operators import telemetry as tel
from lobbylens.operators.scan import FRAME_CHUNK, attach_group, row_index, span
from lobbylens.plans import features as ft
from lobbylens.plans import segments as sg
from lobbylens.queries import sqltext as q
from lobbylens.queries.registry import Registry, num, num_text
from lobbylens.session import run_folder
from lobbylens.sources import tables as t

R = Registry()
L = 10


def marked(spark, sf):
    return t.marked_events(spark, sf)


def rosters(spark, sf):
    return tel.roster(t.car_names(spark, sf))


def training(spark, sf):
    return ft.training_frames(t.marked_frames(spark, sf), rosters(spark, sf), L)


def inference(spark, sf):
    return ft.inference_frames(t.frames(spark, sf), rosters(spark, sf), L)


# --- check SQL for the telemetry chain ----------------------------------------------------

CHAIN = {
    "windows": """SELECT g.game_id, g.frame, MIN(k.frame) AS next_kickoff FROM goals g
  LEFT JOIN kickoffs k ON k.game_id = g.game_id AND k.frame > g.frame GROUP BY g.game_id, g.frame""",
    "kept": """SELECT f.* FROM fr f WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE w.game_id = f.game_id
  AND f.frame_idx > w.frame AND f.frame_idx < LEAST(COALESCE(w.next_kickoff, 9223372036854775807), w.frame + 600))""",
    "score": """SELECT f.game_id, f.frame_idx, CAST(COUNT(g.frame) FILTER (g.player_team = 0) AS BIGINT) AS blue,
  CAST(COUNT(g.frame) FILTER (g.player_team = 1) AS BIGINT) AS orange FROM ef f
  LEFT JOIN goals g ON g.game_id = f.game_id AND g.frame <= f.frame_idx GROUP BY f.game_id, f.frame_idx""",
    "numbered": """SELECT *, rn // 10 AS segment, COUNT(*) OVER (PARTITION BY game_id) AS n_kept FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY frame_idx) - 1 AS BIGINT) AS rn
  FROM kept WHERE frame_idx % 2 = 0) x""",
    "inf": """SELECT *, rn // 10 AS segment, COUNT(*) OVER (PARTITION BY game_id) AS n_kept FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY frame_idx) - 1 AS BIGINT) AS rn
  FROM fr WHERE frame_idx % 2 = 0) x""",
    "roster": """SELECT game_id, name, team, CAST(team*3 + ROW_NUMBER() OVER (PARTITION BY game_id, team ORDER BY name) - 1 AS INT) AS slot
  FROM (SELECT DISTINCT game_id, team, name FROM pf) x""",
}


def cars_sql(frames: str) -> dict:
    """Slotted cars of the given frames with distances, roles and cumulative state."""
    return {
        "ps": f"""SELECT n.rn, n.segment, n.n_kept, r.slot, p.*,
  SQRT((px-bx)*(px-bx) + (py-by_)*(py-by_) + (pz-bz)*(pz-bz)) AS ball_dist,
  SQRT(vx*vx + vy*vy + vz*vz) AS speed, boost*100.0E0 AS b100 FROM pf p
  JOIN roster r ON r.game_id = p.game_id AND r.name = p.name AND r.team = p.team
  JOIN (SELECT game_id, frame_idx, rn, segment, n_kept FROM {frames}) n
    ON n.game_id = p.game_id AND n.frame_idx = p.frame_idx""",
        "lagged": """SELECT *, COALESCE(LAG(b100) OVER (PARTITION BY game_id, segment, slot ORDER BY rn), 0.0E0) AS was FROM ps""",
        "cum": """SELECT *, COALESCE(SUM(CASE WHEN b100 > was + 5 THEN b100 - was END) OVER w, 0) AS gained,
  COALESCE(SUM(CASE WHEN b100 <= was + 5 AND b100 < was - 1 THEN was - b100 END) OVER w, 0) AS spent,
  SUM(CASE WHEN pz > 25 AND NOT is_demolished THEN 1.0E0 ELSE 0.0E0 END) OVER w AS airborne,
  SUM(CASE WHEN speed > 2200 AND NOT is_demolished THEN 1.0E0 ELSE 0.0E0 END) OVER w AS supersonic,
  SUM(CASE WHEN is_demolished THEN 1.0E0 ELSE 0.0E0 END) OVER w AS demolished, COUNT(*) OVER w AS present
  FROM lagged WINDOW w AS (PARTITION BY game_id, segment, slot ORDER BY rn ROWS UNBOUNDED PRECEDING)""",
        "roles": f"""SELECT n.game_id, n.frame_idx, s.slot, CAST(ROW_NUMBER() OVER (PARTITION BY n.game_id, n.frame_idx, s.slot // 3
  ORDER BY CASE WHEN p.slot IS NULL OR p.is_demolished THEN 3.4028234663852886E38 ELSE p.ball_dist END, s.slot) - 1 AS INT) AS role
  FROM {frames} n CROSS JOIN (SELECT UNNEST([0,1,2,3,4,5]) AS slot) s
  LEFT JOIN ps p ON p.game_id = n.game_id AND p.frame_idx = n.frame_idx AND p.slot = s.slot""",
    }


def _clamp(x: str, lo: str = "-1.0E0") -> str:
    return f"GREATEST({lo}, LEAST({x}, 1.0E0))"


def _list(*xs: str) -> str:
    return "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in xs) + "]"


def _zeros(n: int) -> str:
    return _list(*["0.0E0"] * n)


POS = [_clamp("px/5120.0E0"), _clamp("py/5120.0E0"), _clamp("pz/2044.0E0", "0.0E0")]
VEL = [_clamp(f"v{a}/2300.0E0") for a in "xyz"]
ROT = ["qx", "qy", "qz", "qw"]
FORWARD = ["(1.0E0 - 2.0E0*(qy*qy + qz*qz))", "(2.0E0*(qx*qy + qw*qz))", "(2.0E0*(qx*qz - qw*qy))"]
CAR_SPEED = "LEAST(speed/2300.0E0, 1.0E0)"
GONE13, GONE12 = _list(*["0.0E0"] * 12, "1.0E0"), _list(*["0.0E0"] * 11, "1.0E0")
STATE = f"CASE WHEN is_demolished THEN {GONE13} ELSE {_list(*POS, *VEL, *ROT, CAR_SPEED, 'boost', '0.0E0')} END"
OPP = f"CASE WHEN is_demolished THEN {GONE12} ELSE {_list(*POS, *VEL, *ROT, CAR_SPEED, '0.0E0')} END"
NEAR = "LEAST(ball_dist/7245.0E0, 1.0E0)"
FACING = f"CASE WHEN ball_dist < 0.0001E0 THEN 0.0E0 ELSE ({FORWARD[0]}*(bx-px) + {FORWARD[1]}*(by_-py) + {FORWARD[2]}*(bz-pz))/ball_dist END"
BALL = _list(_clamp("bx/5120.0E0"), _clamp("by_/5120.0E0"), _clamp("bz/2044.0E0", "0.0E0"),
             _clamp("bvx/6000.0E0"), _clamp("bvy/6000.0E0"), _clamp("bvz/6000.0E0"),
             "LEAST(SQRT(bvx*bvx+bvy*bvy+bvz*bvz)/6000.0E0, 1.0E0)")
GOAL = "LEAST(SQRT(bx*bx + (by_+5120)*(by_+5120) + bz*bz)/7245.0E0, 1.0E0)"


def vector_sql(frames: str, context: bool) -> dict:
    """One row per frame with the six cars side by side, then one list of 106 per slot."""
    picks = ",\n".join(
        f"MAX({expr}) FILTER (c.slot = {s}) AS {name}{s}"
        for s in range(6)
        for name, expr in (
            ("st", STATE), ("op", OPP), ("x", "px"), ("y", "py"), ("z", "pz"),
            ("dm", "CASE WHEN is_demolished THEN 1 ELSE 0 END"), ("nr", NEAR),
            ("qb", f"CASE WHEN is_demolished THEN {_zeros(2)} ELSE {_list(NEAR, FACING)} END"),
            ("cu", _list("LEAST(gained/300.0E0, 1.0E0)", "LEAST(spent/300.0E0, 1.0E0)", "airborne/present",
                         "supersonic/present", "demolished/present")),
        )
    )

    def rel(focal: int, other: int) -> str:
        gap = " + ".join(f"({a}{other}-{a}{focal})*({a}{other}-{a}{focal})" for a in "xyz")
        return (f"CASE WHEN st{other} IS NULL OR dm{other} = 1 THEN {_zeros(2)} "
                f"ELSE {_list(f'nr{other}', f'LEAST(SQRT({gap})/7245.0E0, 1.0E0)')} END")

    def vec(s: int) -> str:
        team = [0, 1, 2] if s < 3 else [3, 4, 5]
        mate = [m for m in team if m != s]
        opp = [m for m in range(6) if m not in team]
        own, other = ("blue", "orange") if s < 3 else ("orange", "blue")
        ctx = _list(_clamp(f"({own} - {other})/5.0E0"), _clamp("seconds_remaining/300.0E0", "0.0E0"),
                    "CASE WHEN seconds_remaining <= 0 THEN 1.0E0 ELSE 0.0E0 END") if context else _zeros(3)
        parts = [
            BALL, f"st{s}", f"qb{s}", f"cu{s}", *(f"COALESCE(st{m}, {_zeros(13)})" for m in mate),
            *(rel(s, m) for m in mate), *(f"COALESCE(op{m}, {_zeros(12)})" for m in opp),
            *(rel(s, m) for m in opp), _list(GOAL), ctx,
            _list(*(f"CASE WHEN rl{s} = {k} THEN 1.0E0 ELSE 0.0E0 END" for k in range(3))),
        ]
        return f"CASE WHEN st{s} IS NULL THEN {_zeros(106)} ELSE {' || '.join(f'({p})' for p in parts)} END"

    slots = ", ".join(f"{{'slot': {s}, 'vec': {vec(s)}}}" for s in range(6))
    role = ", ".join(f"MAX(role) FILTER (slot = {s}) AS rl{s}" for s in range(6))
    return {
        "side": f"SELECT c.game_id, c.frame_idx, {picks} FROM cum c GROUP BY c.game_id, c.frame_idx",
        "rolled": f"SELECT game_id, frame_idx, {role} FROM roles GROUP BY game_id, frame_idx",
        "wide": f"""SELECT n.*, side.* EXCLUDE (game_id, frame_idx), rolled.* EXCLUDE (game_id, frame_idx), blue, orange
  FROM {frames} n LEFT JOIN side ON side.game_id = n.game_id AND side.frame_idx = n.frame_idx
  JOIN rolled ON rolled.game_id = n.game_id AND rolled.frame_idx = n.frame_idx
  JOIN score ON score.game_id = n.game_id AND score.frame_idx = n.frame_idx""",
        "vecs": f"""SELECT game_id, frame_idx, rn, segment, n_kept, CAST(u.slot AS INT) AS slot, u.vec AS vec
  FROM (SELECT game_id, frame_idx, rn, segment, n_kept, UNNEST([{slots}]) AS u FROM wide) x""",
    }


OWN_GOALS = """SELECT game_id, frame_idx AS frame, CAST(event_id % 2 AS INT) AS player_team FROM ef
  WHERE event_type = 'purchase' AND event_id % 13 <> 0"""


def chain(body: str, *names: str, **extra: str) -> str:
    """The named steps and their relations; scores and windows use the goals of the frames themselves."""
    picked = {n: CHAIN[n] for n in CHAIN if n in names}
    if names and {"windows", "score"} & set(names):
        return q.with_ctes("ef fr pf kickoffs", body, **{"goals": OWN_GOALS, **picked, **extra})
    return q.with_ctes("ef fr pf goals kickoffs", body, **picked, **extra)


TRAIN = ("windows", "kept", "score", "numbered", "roster")
INFER = ("score", "inf", "roster")


def vector_columns_sql() -> str:
    return ", ".join(f"{q.r6(f'vec[{i + 1}]')} AS f{i}" for i in range(106))


def vector_columns():
    return [f"{num_text(f'features[{i}]')} AS f{i}" for i in range(106)]


# --- frames, goals, clocks ------------------------------------------------------------------

@R.add("frame_subsample", q.with_ctes("fr", "SELECT game_id, frame_idx, time FROM fr WHERE frame_idx % 2 = 0"))
def frame_subsample(spark, sf):
    return tel.subsample(t.frames(spark, sf)).select("game_id", "frame_idx", "time")


@R.add("next_event_asof", chain("SELECT game_id, frame AS frame_idx, next_kickoff FROM windows SEMI JOIN ef "
                                "ON ef.game_id = windows.game_id AND ef.frame_idx = windows.frame", "windows"))
def next_event_asof(spark, sf):
    return tel.next_kickoff(marked(spark, sf)).select("game_id", "frame_idx", "next_kickoff")


@R.add("goal_window_exclusion", chain("SELECT game_id, frame_idx FROM kept", "windows", "kept"))
def goal_window_exclusion(spark, sf):
    return tel.trim_goal_windows(marked(spark, sf)).select("game_id", "frame_idx")


@R.add("running_score", chain("SELECT * FROM score", "score"))
def running_score(spark, sf):
    return tel.running_score(marked(spark, sf)).select("game_id", "frame_idx", "blue", "orange")


# Three games over all events, with rare goals and kickoffs: windows reach the frame limit.
LONG = {
    "ef": """SELECT user_id % 3 AS game_id, event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS BIGINT)
  AS frame_idx FROM events""",
    "goals": "SELECT game_id, frame_idx AS frame, CAST(event_id % 2 AS INT) AS player_team FROM ef WHERE event_id % 1500 = 7",
    "kickoffs": "SELECT game_id, frame_idx AS frame FROM ef WHERE event_id % 4000 = 0 OR frame_idx = 0",
}


def long_marked(spark, sf):
    events = t.table(spark, sf, "events").select((F.col("user_id") % 3).alias("game_id"), "event_id")
    rows = row_index(events, ["game_id"], ["event_id"], "frame_idx", span("event_id", FRAME_CHUNK))
    goals = rows.where("event_id % 1500 = 7").select(
        "game_id", F.col("frame_idx").alias("frame"), (F.col("event_id") % 2).cast("int").alias("player_team"))
    kickoffs = rows.where("event_id % 4000 = 0 OR frame_idx = 0").select("game_id", F.col("frame_idx").alias("frame"))
    return tel.mark_frames(rows, goals, kickoffs)


@R.add("long_game_trimming", q.with_ctes("", "SELECT game_id, frame_idx FROM kept", **LONG, windows=CHAIN["windows"],
                                         kept=CHAIN["kept"].replace("FROM fr f", "FROM ef f")))
def long_game_trimming(spark, sf):
    return tel.trim_goal_windows(long_marked(spark, sf)).select("game_id", "frame_idx")


@R.add("long_game_score", q.with_ctes("", "SELECT * FROM score", **LONG, score=CHAIN["score"]))
def long_game_score(spark, sf):
    return tel.running_score(long_marked(spark, sf)).select("game_id", "frame_idx", "blue", "orange")


MARKERS = """SELECT g.game_id, g.frame, g.event_id, g.player_name, g.player_team, f.time, CAST(l.lane AS INT) AS lane FROM goals g
  JOIN fr f ON f.game_id = g.game_id AND f.frame_idx = g.frame LEFT JOIN (SELECT game_id, name,
   ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY lane) - 1 AS lane FROM pf WHERE frame_idx = 0) l
  ON l.game_id = g.game_id AND l.name = g.player_name"""


@R.add("goal_markers", chain(MARKERS))
def goal_markers(spark, sf):
    return tel.goal_markers(t.goals(spark, sf), t.frames(spark, sf))


@R.add("score_timeline", chain("""SELECT game_id, time, event_id, COUNT(*) FILTER (player_team = 0) OVER w || '-' ||
  COUNT(*) FILTER (player_team = 1) OVER w AS score_label FROM m
  WINDOW w AS (PARTITION BY game_id ORDER BY frame, event_id ROWS UNBOUNDED PRECEDING)""", m=MARKERS))
def score_timeline(spark, sf):
    markers = tel.goal_markers(t.goals(spark, sf), t.frames(spark, sf))
    return tel.score_timeline(markers, ["frame", "event_id"]).select("game_id", "time", "event_id", "score_label")


@R.add("roster", chain("SELECT game_id, string_agg(name, '|' ORDER BY slot) AS names FROM roster GROUP BY game_id", "roster"))
def roster(spark, sf):
    return rosters(spark, sf).select("game_id", F.array_join("roster", "|").alias("names"))


PLAY = """SELECT f.game_id, f.frame_idx, f.time, CASE WHEN seconds_remaining > 0 THEN reg - seconds_remaining
  ELSE reg + GREATEST(0, COALESCE(time - zero, 0)) END AS play_time FROM fr f JOIN (
  SELECT game_id, CAST(MIN_BY(seconds_remaining, frame_idx) AS DOUBLE) AS reg,
   MIN_BY(time, frame_idx) FILTER (seconds_remaining <= 0) AS zero FROM fr GROUP BY game_id) c ON c.game_id = f.game_id"""


@R.add("play_time", chain(f"SELECT game_id, frame_idx, play_time FROM ({PLAY}) x"))
def play_time(spark, sf):
    return tel.play_time(t.frames(spark, sf)).select("game_id", "frame_idx", "play_time")


@R.add("time_label", chain(f"""SELECT game_id, frame_idx, s // 60 || ':' || LPAD(CAST(s % 60 AS VARCHAR), 2, '0') AS label,
  LPAD(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || LPAD(CAST(s % 60 AS VARCHAR), 2, '0') AS long_label
  FROM (SELECT game_id, frame_idx, CAST(FLOOR(GREATEST(play_time - 20, 0)) AS BIGINT) AS s FROM ({PLAY}) x) y"""))
def time_label(spark, sf):
    shifted = F.col("play_time") - 20
    return tel.play_time(t.frames(spark, sf)).select(
        "game_id", "frame_idx", labels.clock_label(shifted).alias("label"),
        labels.clock_label(shifted, 2).alias("long_label"))


@R.add("segment_bounds", chain("""SELECT s.game_id, s.segment, s.start_frame, s.end_frame, a.time AS start_time, b.time AS end_time
  FROM (SELECT game_id, segment, LEAST(segment*20, n - 1) AS start_frame, CASE WHEN LEAST(LEAST(segment*10 + 10, (n + 1)//2)*2, n) <= LEAST(segment*20, n - 1)
   THEN LEAST(segment*20, n - 1) + 1 ELSE LEAST(LEAST(segment*10 + 10, (n + 1)//2)*2, n) END AS end_frame
   FROM (SELECT game_id, n, UNNEST(range(GREATEST(1, ((n + 1)//2)//10))) AS segment FROM (
    SELECT game_id, COUNT(*) AS n FROM ef GROUP BY game_id) x) y) s
  JOIN fr a ON a.game_id = s.game_id AND a.frame_idx = s.start_frame
  JOIN fr b ON b.game_id = s.game_id AND b.frame_idx = s.end_frame - 1"""))
def segment_bounds(spark, sf):
    return tel.segment_bounds(t.frames(spark, sf), L)


# Kick-offs read off the ball actors: each frame and actor with its newest creation, deletion and movements.
BALLS = {
    "ba": """SELECT game_id, frame_idx, event_id % 2 AS actor, CASE event_type WHEN 'signup' THEN 'new' WHEN 'error' THEN 'delete' ELSE 'update' END AS kind,
  event_type NOT IN ('signup', 'error') AND event_id % 7 <> 3 AS has_pos, event_type NOT IN ('signup', 'error') AND event_id % 5 <> 2 AS has_vel,
  event_id*7 % 31 - 15 AS x, event_id*11 % 25 - 12 AS y, (event_id*13 % 5 - 2)*0.6E0 AS vx, (event_id*17 % 3 - 1)*0.9E0 AS vy FROM ef""",
    "st": """SELECT b.game_id, b.frame_idx, a.a, MAX(CASE WHEN actor = a.a AND kind = 'new' THEN frame_idx END) OVER w AS born,
  MAX(CASE WHEN actor = a.a AND kind = 'delete' THEN frame_idx END) OVER w AS died,
  MAX(CASE WHEN actor = a.a AND has_pos THEN frame_idx END) OVER w AS pos_at, MAX(CASE WHEN actor = a.a AND has_vel THEN frame_idx END) OVER w AS vel_at
  FROM ba b CROSS JOIN (SELECT UNNEST([0, 1]) AS a) a WINDOW w AS (PARTITION BY b.game_id, a.a ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)""",
    "ct": """SELECT st.game_id, st.frame_idx, bool_or(born IS NOT NULL AND COALESCE(died, -1) < born
   AND ABS(CASE WHEN pos_at > born THEN p.x ELSE 0 END) < 10 AND ABS(CASE WHEN pos_at > born THEN p.y ELSE 0 END) < 10
   AND ABS(CASE WHEN vel_at > born THEN v.vx ELSE 0 END) < 1 AND ABS(CASE WHEN vel_at > born THEN v.vy ELSE 0 END) < 1) AS centred
  FROM st LEFT JOIN ba p ON p.game_id = st.game_id AND p.frame_idx = pos_at LEFT JOIN ba v ON v.game_id = st.game_id AND v.frame_idx = vel_at
  GROUP BY st.game_id, st.frame_idx""",
    "bk": """SELECT game_id, frame_idx AS frame FROM (SELECT *, COALESCE(LAG(centred) OVER (PARTITION BY game_id ORDER BY frame_idx), FALSE) AS was FROM ct) x
  WHERE frame_idx = 0 OR (COALESCE(centred, FALSE) AND NOT was)""",
}


def ball_kickoff_frames(spark, sf):
    return tel.ball_kickoffs(t.ball_log(spark, sf))


@R.add("ball_kickoffs", q.with_ctes("ef", "SELECT game_id, frame FROM bk", **BALLS))
def ball_kickoffs(spark, sf):
    """Frames in which a ball comes to rest at the centre, from the log of the ball actors."""
    return ball_kickoff_frames(spark, sf)


@R.add("ball_goal_windows", q.with_ctes("ef", "SELECT f.game_id, f.frame_idx FROM kept f", goals=OWN_GOALS, **BALLS,
                                        windows=CHAIN["windows"].replace("kickoffs", "bk"),
                                        kept=CHAIN["kept"].replace("FROM fr f", "FROM ef f")))
def ball_goal_windows(spark, sf):
    """Goal footage up to the kick-off that the ball itself shows."""
    goals = t.goals(spark, sf).where("event_id % 13 <> 0")
    frames = tel.mark_frames(t.event_frames(spark, sf), goals, ball_kickoff_frames(spark, sf))
    return tel.trim_goal_windows(frames).select("game_id", "frame_idx")


# --- per-frame geometry -----------------------------------------------------------------------

@R.add("normalise", chain("SELECT game_id, frame_idx, lane, " + ", ".join(
    f"{q.r6(x)} AS {n}" for x, n in zip(POS + VEL, ("px", "py", "pz", "vx", "vy", "vz"))) + " FROM pf"))
def normalise(spark, sf):
    values = [*v.scaled_position("pos"), *v.scaled_velocity("vel", v.MAX_CAR_SPEED)]
    return t.player_frames(spark, sf).select(
        "game_id", "frame_idx", "lane",
        *(num(F.expr(x)).alias(n) for x, n in zip(values, ("px", "py", "pz", "vx", "vy", "vz"))))


@R.add("vector_math", chain(f"""SELECT game_id, frame_idx, lane, {q.r6('SQRT(vx*vx+vy*vy+vz*vz)')} AS speed, {q.r6('d')} AS ball_distance,
  {q.r6('CASE WHEN d < 0.0001E0 THEN 0 ELSE (bx-px)/d END')} AS dir_x,
  {q.r6('CASE WHEN d < 0.0001E0 THEN 0 ELSE (vx*(bx-px) + vy*(by_-py) + vz*(bz-pz))/d END')} AS closing_speed
  FROM (SELECT *, SQRT((px-bx)*(px-bx) + (py-by_)*(py-by_) + (pz-bz)*(pz-bz)) AS d FROM pf) x"""))
def vector_math(spark, sf):
    rows = t.player_frames(spark, sf).selectExpr("*", f"{v.direction('pos', 'ball_pos')} AS to_ball")
    return rows.select(
        "game_id", "frame_idx", "lane", num(F.expr(v.magnitude("vel"))).alias("speed"),
        num(F.expr(v.distance("pos", "ball_pos"))).alias("ball_distance"),
        num(F.col("to_ball.x")).alias("dir_x"), num(F.expr(v.dot("vel", "to_ball"))).alias("closing_speed"))


@R.add("quaternion_forward", chain(f"""SELECT game_id, frame_idx, lane, {q.r6(FORWARD[0])} AS fx, {q.r6(FORWARD[1])} AS fy,
  {q.r6(FORWARD[2])} AS fz FROM pf"""))
def quaternion_forward(spark, sf):
    f = F.expr(v.quaternion_forward("rot"))
    return t.player_frames(spark, sf).select(
        "game_id", "frame_idx", "lane", num(f["x"]).alias("fx"), num(f["y"]).alias("fy"), num(f["z"]).alias("fz"))


@R.add("game_context", chain(f"""SELECT s.game_id, s.frame_idx, {q.r6(_clamp('(blue - orange)/5.0E0'))} AS blue_lead,
  {q.r6(_clamp('(orange - blue)/5.0E0'))} AS orange_lead, {q.r6(_clamp('seconds_remaining/300.0E0', '0.0E0'))} AS time_left,
  CASE WHEN seconds_remaining <= 0 THEN 1.0E0 ELSE 0.0E0 END AS overtime FROM score s JOIN fr f
  ON f.game_id = s.game_id AND f.frame_idx = s.frame_idx""", "score"))
def game_context(spark, sf):
    blue, left, over = tel.game_context("300 - frame_idx * 5", "blue", "orange")
    orange = tel.game_context("300 - frame_idx * 5", "orange", "blue")[0]
    return tel.running_score(marked(spark, sf)).select(
        "game_id", "frame_idx", num(F.expr(blue)).alias("blue_lead"), num(F.expr(orange)).alias("orange_lead"),
        num(F.expr(left)).alias("time_left"), F.expr(over).alias("overtime"))


# --- slotted frames, roles, cumulative state -----------------------------------------------------

@R.add("role_rank", chain("""SELECT game_id, frame_idx, CAST(slot AS INT) AS slot, role, role = 0 AS closest, role = 1 AS second, role = 2 AS third FROM roles""",
                          *INFER, **cars_sql("inf")))
def role_rank(spark, sf):
    slotted = ft.with_ball_distances(inference(spark, sf))
    rows = ft.by_slot(slotted, ["game_id", "frame_idx"], role=ft.role_rank)
    return rows.select("*", *((F.col("role") == k).alias(n) for k, n in enumerate(("closest", "second", "third"))))


MATES_SQL = """SELECT a.game_id, a.frame_idx, a.slot, {gap} AS nearest_mate, {gap2} AS nearest_opponent
  FROM ps a LEFT JOIN ps b ON b.game_id = a.game_id AND b.frame_idx = a.frame_idx AND b.slot <> a.slot AND NOT b.is_demolished
  GROUP BY a.game_id, a.frame_idx, a.slot"""
GAP = "LEAST(SQRT((a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py) + (a.pz-b.pz)*(a.pz-b.pz))/7245.0E0, 1.0E0)"


@R.add("teammate_distance", chain(MATES_SQL.format(
    gap=q.r6(f"COALESCE(MIN({GAP}) FILTER (b.team = a.team), 0)"),
    gap2=q.r6(f"COALESCE(MIN({GAP}) FILTER (b.team <> a.team), 0)")), *INFER, ps=cars_sql("inf")["ps"]))
def teammate_distance(spark, sf):
    """Nearest mate and opponent still in play, from the same frame row (no self-join)."""
    def nearest(slot, others):
        gaps = [f"if({ft.out_of_play(s)}, NULL, {v.scaled_distance(f'p{s}.pos', f'p{slot}.pos')})" for s in others]
        return f"coalesce(least({', '.join(gaps)}), 0.0D)"

    rows = ft.by_slot(
        inference(spark, sf), ["game_id", "frame_idx"], present=here,
        nearest_mate=lambda s: nearest(s, ft.mates(s)), nearest_opponent=lambda s: nearest(s, ft.opponents(s)))
    return rows.where("present").select(
        "game_id", "frame_idx", "slot", num(F.col("nearest_mate")).alias("nearest_mate"),
        num(F.col("nearest_opponent")).alias("nearest_opponent"))


def here(slot):
    return f"p{slot} IS NOT NULL"


@R.add("segment_assign", chain("SELECT game_id, frame_idx, rn, segment, n_kept FROM numbered", *TRAIN))
def segment_assign(spark, sf):
    return training(spark, sf).select("game_id", "frame_idx", "rn", "segment", "n_kept")


CUM = {**cars_sql("numbered")}


@R.add("cumulative_boost", chain(f"""SELECT game_id, rn, slot, {q.r6('gained')} AS gained, {q.r6('spent')} AS spent FROM cum""",
                                 *TRAIN, **{k: CUM[k] for k in ("ps", "lagged", "cum")}))
def cumulative_boost(spark, sf):
    rows = ft.by_slot(ft.with_cumulative(training(spark, sf)), ["game_id", "rn"], here=here,
                      gained=lambda s: f"c{s}.gained", spent=lambda s: f"c{s}.spent")
    return rows.where("here").select(
        "game_id", "rn", "slot", num(F.col("gained")).alias("gained"), num(F.col("spent")).alias("spent"))


@R.add("cumulative_fractions", chain(f"""SELECT game_id, rn, slot, {q.r6('airborne/present')} AS airborne,
  {q.r6('supersonic/present')} AS supersonic, {q.r6('demolished/present')} AS demolished FROM cum""",
                                     *TRAIN, **{k: CUM[k] for k in ("ps", "lagged", "cum")}))
def cumulative_fractions(spark, sf):
    names = ("airborne", "supersonic", "demolished")
    rows = ft.by_slot(ft.with_cumulative(training(spark, sf)), ["game_id", "rn"], here=here,
                      **{n: (lambda s, n=n: ft.fraction(s, n)) for n in names})
    return rows.where("here").select("game_id", "rn", "slot", *(num(F.col(n)).alias(n) for n in names))


@R.add("player_block", chain("SELECT game_id, frame_idx, lane, " + ", ".join(
    f"{q.r6(f's[{i + 1}]')} AS s{i}" for i in range(13)) + ", " + ", ".join(
    f"{q.r6(f'o[{i + 1}]')} AS o{i}" for i in range(12)) +
    f" FROM (SELECT game_id, frame_idx, lane, {STATE} AS s, {OPP} AS o FROM (SELECT *, SQRT(vx*vx+vy*vy+vz*vz) AS speed FROM pf) y) x"))
def player_block(spark, sf):
    rows = t.player_frames(spark, sf).selectExpr(
        "game_id", "frame_idx", "lane", "struct(pos, vel, rot, boost, is_demolished) AS p").selectExpr(
        "game_id", "frame_idx", "lane", f"{ft.player_block('p')} AS s").selectExpr("*", f"{ft.opponent_block('s')} AS o")
    return rows.selectExpr(
        "game_id", "frame_idx", "lane", *(f"{num_text(f's[{i}]')} AS s{i}" for i in range(13)),
        *(f"{num_text(f'o[{i}]')} AS o{i}" for i in range(12)))


# --- feature vectors and segments ------------------------------------------------------------------

TRAIN_VECTORS = {**cars_sql("numbered"), **vector_sql("numbered", True)}
INFER_VECTORS = {**cars_sql("inf"), **vector_sql("inf", False)}


@R.add("feature_vector", chain(f"SELECT game_id, frame_idx, rn, segment, slot, {vector_columns_sql()} FROM vecs", *TRAIN, **TRAIN_VECTORS))
def feature_vector(spark, sf):
    vectors = ft.feature_vectors(training(spark, sf))
    return vectors.selectExpr("game_id", "frame_idx", "rn", "segment", "slot", *vector_columns())


@R.add("feature_vector_inference", chain(f"SELECT game_id, frame_idx, rn, segment, slot, {vector_columns_sql()} FROM vecs",
                                         *INFER, **INFER_VECTORS))
def feature_vector_inference(spark, sf):
    vectors = ft.feature_vectors(inference(spark, sf), with_context=False)
    return vectors.selectExpr("game_id", "frame_idx", "rn", "segment", "slot", *vector_columns())


RATINGS = """SELECT replay_id, team, player_name, target_mmr FROM (SELECT g.game_id AS replay_id, CAST((lane % 6) // 3 AS INT) AS team,
  CASE WHEN g.game_id % 4 = 1 AND lane = 2 THEN 'ghost' WHEN g.game_id % 3 = 0 AND lane = 1 THEN 'p' || (g.game_id % 6) || '_' || g.game_id
   WHEN lane = 6 THEN 'extra' ELSE 'p' || ((lane*5 + g.game_id) % 6) || '_' || g.game_id END AS player_name,
  CAST(lane*100 + g.game_id % 50 AS DOUBLE) AS target_mmr, lane, g.game_id FROM (SELECT DISTINCT game_id FROM ef) g
  CROSS JOIN (SELECT UNNEST([0,1,2,3,4,5,6]) AS lane) l) x
  WHERE NOT (game_id % 5 = 2 AND lane = 4) AND (lane < 6 OR game_id % 7 = 3)"""
RATED = {
    "ratings": RATINGS,
    "roster": """SELECT replay_id AS game_id, player_name AS name, team, target_mmr, CAST(team*3 + n - 1 AS INT) AS slot FROM (SELECT *,
  ROW_NUMBER() OVER (PARTITION BY replay_id, team ORDER BY player_name, target_mmr) AS n FROM ratings) x WHERE n <= 3""",
}
RATED_CARS = {**TRAIN_VECTORS, "ps": TRAIN_VECTORS["ps"].replace(" AND r.team = p.team", "").replace("r.slot, p.*", "r.slot, p.*")}


@R.add("feature_vector_rated", q.with_ctes("ef fr pf kickoffs", f"""SELECT v.game_id, v.rn, v.slot, COALESCE(r.target_mmr, 0.0E0) AS target, {vector_columns_sql()}
  FROM vecs v LEFT JOIN roster r ON r.game_id = v.game_id AND r.slot = v.slot""", goals=OWN_GOALS,
                                           **{n: CHAIN[n] for n in TRAIN if n != "roster"}, **RATED, **RATED_CARS))
def feature_vector_rated(spark, sf):
    """Training vectors whose slots are those of the rating rows, next to the slots' targets."""
    ratings = t.rating_rows(spark, sf)
    rosters = labelling.rating_roster(ratings).withColumnRenamed("replay_id", "game_id")
    vectors = ft.feature_vectors(ft.training_frames(t.marked_frames(spark, sf), rosters, L))
    targets = labelling.target_slots(ratings).select(
        F.col("replay_id").alias("game_id"), F.array(*(f"t{s}" for s in range(ft.SLOTS))).alias("targets"))
    rows = attach_group(vectors, targets, ["game_id"], F.col("segment"))
    return rows.selectExpr("game_id", "rn", "slot", "targets[slot] AS target", *vector_columns())


def packed(spark, sf, length=L):
    return sg.pack(ft.feature_vectors(training(spark, sf)), length)


WHOLE = "segment < GREATEST(1, n_kept // 10)"
PACKED = f"""SELECT game_id, segment, slot, segment*10 AS start, COUNT(*) AS n, MAX_BY(vec, rn) AS last_vec, MIN_BY(vec, rn) AS first_vec
  FROM vecs WHERE {WHOLE} GROUP BY game_id, segment, slot"""


@R.add("segment_pack", chain("""SELECT game_id, segment, slot, start, start + 10 AS end_, CAST(10 AS INT) AS n_frames,
  CAST(first_vec[1] AS FLOAT) AS first_ball_x, CAST(last_vec[24] AS FLOAT) AS last_spent FROM p""",
                              *TRAIN, **TRAIN_VECTORS, p=PACKED))
def segment_pack(spark, sf):
    return packed(spark, sf).select(
        "game_id", "segment", "slot", "start", F.col("end").alias("end_"), F.size("frames").alias("n_frames"),
        F.get(F.get("frames", F.lit(0)), F.lit(0)).alias("first_ball_x"),
        F.get(F.element_at("frames", -1), F.lit(23)).alias("last_spent"))


@R.add("pad_last", chain("""SELECT game_id, segment, COUNT(*) AS kept, CAST(10 AS INT) AS padded, MAX(frame_idx) AS last_frame,
  CAST(SUM(frame_idx) + (10 - COUNT(*))*MAX(frame_idx) AS BIGINT) AS frame_sum FROM inf GROUP BY game_id, segment""", "inf"))
def pad_last(spark, sf):
    """The frame numbers of every segment, the short last one padded."""
    groups = inference(spark, sf).groupBy("game_id", "segment").agg(
        F.array_sort(F.collect_list("frame_idx")).alias("f"))
    padded = sg.pad_last(F.col("f"), L)
    total = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return groups.select("game_id", "segment", "f", padded.alias("p")).select(
        "game_id", "segment", F.size("f").cast("bigint").alias("kept"), F.size("p").alias("padded"),
        F.element_at("p", -1).alias("last_frame"), total.alias("frame_sum"))


@R.add("segment_scan_filter", chain(f"""SELECT game_id, segment*10 AS start, segment*10 + 10 AS end_ FROM numbered
  WHERE {WHOLE} GROUP BY game_id, segment HAVING COUNT(*) = 10""", *TRAIN))
def segment_scan_filter(spark, sf):
    """Legacy block names of all segments, whole or not; the whole ones are kept."""
    counted = training(spark, sf).groupBy("game_id", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.max("n_kept").alias("n_kept"))
    start = F.col("segment") * L
    stem = F.concat(start.cast("string"), F.lit("-"), (start + F.col("n")).cast("string"))
    names = counted.where(F.col("segment") < tel.segment_count(F.col("n_kept"), L)).select("game_id", stem.alias("stem"))
    return sg.parse_segment_names(names, "stem", L).select("game_id", "start", F.col("end").alias("end_"))


def stored_segments(spark, sf, folder):
    rank = F.concat(F.lit("gold-"), (F.col("game_id") % 3 + 1).cast("string"))
    rows = packed(spark, sf).withColumn("rank", rank).withColumn("game_mode", F.lit("ranked-standard"))
    sg.write_segments(rows, folder)
    return sg.read_segments(spark, folder, L)


@R.add("segment_write", chain(f"""SELECT 'gold-' || (game_id % 3 + 1) AS rank, COUNT(*)*6 AS rows_, COUNT(DISTINCT game_id) AS games FROM
  (SELECT DISTINCT game_id, segment FROM numbered WHERE {WHOLE}) x GROUP BY 1""", *TRAIN))
def segment_write(spark, sf):
    stored = stored_segments(spark, sf, run_folder(spark, "segments"))
    return stored.groupBy("rank").agg(
        F.count(F.lit(1)).alias("rows_"), F.countDistinct("game_id").alias("games"))


@R.add("incremental_segments", chain(f"""SELECT game_id, segment, slot FROM (SELECT DISTINCT game_id, segment FROM numbered WHERE {WHOLE}) x
  CROSS JOIN (SELECT CAST(UNNEST([0,1,2,3,4,5]) AS INT) AS slot) s""", *TRAIN))
def incremental_segments(spark, sf):
    """Two runs: the first stores some games, the second only the missing ones."""
    folder = run_folder(spark, "incremental")
    base = training(spark, sf).withColumn("rank", F.lit("gold-1")).withColumn("game_mode", F.lit("ranked-standard"))

    def store(frames):
        rows = sg.pack(ft.feature_vectors(frames), L)
        sg.write_segments(rows.withColumn("rank", F.lit("gold-1")).withColumn("game_mode", F.lit("ranked-standard")), folder)

    frames = base.drop("rank", "game_mode")
    store(frames.where(F.col("game_id") % 2 == 0))
    games = t.event_frames(spark, sf).select("game_id").distinct()
    todo = sg.missing_games(games, sg.read_segments(spark, folder, L))
    store(frames.join(todo, "game_id", "left_semi"))
    return sg.read_segments(spark, folder, L).select("game_id", "segment", "slot")


def probe_sql(cell: str) -> str:
    last = ", ".join(f"MAX_BY({cell.format(i + 1)}, rn) AS x{n}" for n, i in enumerate(range(22, 27)))
    mean = ", ".join(
        f"(SUM({cell.format(i + 1)}) + (10 - COUNT(*))*MAX_BY({cell.format(i + 1)}, rn))/10 AS x{n + 5}"
        for n, i in enumerate((18, 19, 20)))
    return f"""SELECT game_id, segment, slot, {last}, {mean} FROM vecs
  WHERE {WHOLE} GROUP BY game_id, segment, slot"""


PROBE = probe_sql("vec[{}]")
PROBE32 = probe_sql("CAST(CAST(vec[{}] AS FLOAT) AS DOUBLE)")


@R.add("probe_features", chain("SELECT game_id, segment, slot, " + ", ".join(
    f"{q.r6(f'x{i}')} AS x{i}" for i in range(8)) + " FROM pr", *TRAIN, **TRAIN_VECTORS, pr=PROBE))
def probe_features(spark, sf):
    vectors = ft.feature_vectors(training(spark, sf))
    rows = vectors.where(F.col("segment") < tel.segment_count(F.col("n_kept"), L))
    return probe.segment_features(rows, ["game_id", "segment", "slot"], L).select(
        "game_id", "segment", "slot", *(num(F.col(f"x{i}")).alias(f"x{i}") for i in range(8)))


WEIGHTS = [120.0, -80.0, 240.0, 310.0, -150.0, 95.0, -60.0, 45.0, 700.0]


@R.add("batch_score", chain(f"SELECT game_id, segment, slot, {q.r6('own + 0.25E0*(AVG(own) OVER (PARTITION BY game_id, segment) - own)')} AS pred_mmr FROM (SELECT *, 700.0E0 + "
                            + " + ".join(f"({w}E0)*x{i}" for i, w in enumerate(WEIGHTS[:8])) + " AS own FROM pr) s",
                            *INFER, **INFER_VECTORS, pr=PROBE32))
def batch_score(spark, sf):
    """Any scorer with the signature (n, 6, L, 106) -> (n, 6); here a linear probe drawn to the lobby's mean."""
    rows = sg.pack(ft.feature_vectors(inference(spark, sf), with_context=False), L)
    scored = probe.score_lobbies(rows, probe.linear_scorer(WEIGHTS, lobby_share=0.25), ["game_id", "segment"])
    return scored.withColumn("pred_mmr", num(F.col("pred_mmr")))
