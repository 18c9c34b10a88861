"""Small builders shared by the tests."""

from pyspark.sql import functions as F

VEC = "struct<x:double,y:double,z:double>"
CAR = (
    f"struct<name:string,team:int,pos:{VEC},vel:{VEC},rot:struct<x:double,y:double,z:double,w:double>,"
    "boost:double,is_demolished:boolean>"
)
FRAME = (
    f"game_id bigint, frame_idx bigint, time double, seconds_remaining int, ball_pos {VEC}, ball_vel {VEC}, "
    f"players array<{CAR}>"
)
# name, team, pos, vel, boost of the one-frame fixture
SIX = [
    ("Player1", 0, (-1000.0, -2000.0, 17.0), (500.0, 200.0, 0.0), 0.3),
    ("Player2", 0, (-500.0, -1000.0, 17.0), (800.0, 400.0, 0.0), 0.7),
    ("Player3", 0, (-2000.0, -3000.0, 17.0), (200.0, 100.0, 0.0), 0.5),
    ("Player4", 1, (1000.0, 2000.0, 17.0), (-500.0, -200.0, 0.0), 0.9),
    ("Player5", 1, (500.0, 1000.0, 17.0), (-800.0, -400.0, 0.0), 0.1),
    ("Player6", 1, (2000.0, 3000.0, 17.0), (-200.0, -100.0, 0.0), 0.6),
]
NAMES = [row[0] for row in SIX]


def car(name, team, pos, vel, boost, rot=(0.0, 0.0, 0.0, 1.0), demolished=False):
    return (name, team, pos, vel, rot, boost, demolished)


def six(boosts=None, absent=(), demolished=()):
    cars = []
    for name, team, pos, vel, boost in SIX:
        if name in absent:
            continue
        rot = (0.0, 0.0, 0.70711, 0.70711) if name == "Player4" else (0.0, 0.0, 0.0, 1.0)
        cars.append(car(name, team, pos, vel, (boosts or {}).get(name, boost), rot, name in demolished))
    return cars


def frame(game, index, cars=None, remaining=250):
    return (game, index, 100.0 + index * 0.03, remaining, (0.0, 0.0, 100.0), (1000.0, 500.0, 0.0),
            six() if cars is None else cars)


def frames_df(spark, rows):
    return spark.createDataFrame(rows, FRAME)


def rosters_df(spark, games, names=NAMES):
    return spark.createDataFrame([(g, names) for g in games], "game_id bigint, roster array<string>")


def values(spark, column):
    """Evaluate one column expression."""
    return spark.range(1).select(column.alias("v")).first()["v"]


def column(spark, data, kind, expression):
    """Evaluate an expression over a list of inputs, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {kind}")
    return [r["v"] for r in df.select("i", expression(F.col("x")).alias("v")).orderBy("i").collect()]
