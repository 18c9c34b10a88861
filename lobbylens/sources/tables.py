"""Domain relations derived from the star-schema and event tables.

Every function reads whole tables with an explicit column list and stays lazy.
`events` plays the telemetry (one game per user, one frame per event),
`lineitem` the per-segment predictions, `orders` the replay catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lobbylens.functions import labels, ladder
from lobbylens.operators.scan import ROW_CHUNK, row_index, span

SLOTS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(ts: str) -> Column:
    """A zoneless timestamp as the instant it names in UTC, whatever the session zone."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts}))")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with its position in the user's game."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("game_id"), "event_id", "event_type", "value"
    )
    return row_index(events, ["game_id"], ["event_id"], "frame_idx", span("event_id", ROW_CHUNK))


PRESENT = "(event_id + {l}) % 17 <> 0"
NAME = "concat('p', cast(({l} * 5 + game_id) % 6 AS string), '_', cast(game_id AS string))"
CAR = """named_struct(
  'lane', {l},
  'name', {name},
  'team', {team},
  'pos', named_struct(
    'x', cast((event_id * 7919 + {l} * 104729) % 10240 - 5120 AS double),
    'y', cast((event_id * 6007 + {l} * 50021) % 10240 - 5120 AS double),
    'z', cast((event_id * 31 + {l} * 997) % 2044 AS double)),
  'vel', named_struct(
    'x', cast((event_id * 4001 + {l} * 811) % 4601 - 2300 AS double),
    'y', cast((event_id * 3307 + {l} * 613) % 4601 - 2300 AS double),
    'z', cast((event_id * 101 + {l} * 37) % 301 - 150 AS double)),
  'rot', named_struct('x', {rot[0]}D, 'y', {rot[1]}D, 'z', {rot[2]}D, 'w', {rot[3]}D),
  'boost', ((event_id * 13 + {l} * 29) % 101) / 100.0D,
  'is_demolished', event_type = 'error' AND event_id % 6 = {l})"""


# Unit quaternions (x, y, z, w) of the six lanes.
ROTATIONS = [
    (0.0, 0.0, 0.0, 1.0), (0.5, 0.5, 0.5, 0.5), (0.1, -0.7, 0.1, 0.7), (-0.5, 0.5, 0.5, 0.5), (0.7, 0.1, -0.7, 0.1), (0.0, 0.0, 0.8, 0.6),
]


def _cars(template: str) -> str:
    """The cars present in a frame, written out per lane so that it compiles to straight code."""
    lanes = ", ".join(
        f"if({PRESENT.format(l=lane)}, "
        + template.format(l=lane, team=lane // 3, name=NAME.format(l=lane), rot=ROTATIONS[lane])
        + ", NULL)"
        for lane in range(SLOTS)
    )
    return f"array_compact(array({lanes}))"


def car_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Game, team and name of every car in every frame."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("game_id"), "event_id")
    cars = _cars("named_struct('team', {team}, 'name', {name})")
    return events.selectExpr("game_id", f"explode({cars}) AS c").selectExpr("game_id", "c.team", "c.name")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested telemetry: one row per frame with the ball and the cars present."""
    return event_frames(spark, sf_dir).selectExpr(
        "game_id",
        "frame_idx",
        "event_id",
        "event_type",
        "frame_idx * 0.25D AS time",
        "cast(300 - frame_idx * 5 AS int) AS seconds_remaining",
        """named_struct('x', cast(event_id * 2203 % 10240 - 5120 AS double),
  'y', cast(event_id * 1709 % 10240 - 5120 AS double), 'z', cast(event_id * 97 % 2044 AS double)) AS ball_pos""",
        """named_struct('x', cast(event_id * 1511 % 9001 - 4500 AS double),
  'y', cast(event_id * 1129 % 9001 - 4500 AS double), 'z', cast(event_id * 17 % 501 AS double)) AS ball_vel""",
        f"{_cars(CAR)} AS players",
    )


def player_name(game_id: Column, lane: Column) -> Column:
    """Six names per game whose byte order differs from the lane order."""
    return F.concat(
        F.lit("p"), ((lane * 5 + game_id) % 6).cast("string"), F.lit("_"), game_id.cast("string")
    )


def marked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose goals and kickoffs are read off the event of the frame itself."""
    goal = "event_type = 'purchase' AND event_id % 13 <> 0"
    return frames(spark, sf_dir).selectExpr(
        "*",
        f"if({goal} AND event_id % 2 = 0, 1, 0) AS goal_blue",
        f"if({goal} AND event_id % 2 = 1, 1, 0) AS goal_orange",
        "event_type = 'signup' OR frame_idx = 0 AS is_kickoff",
    )


def marked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks alone, without cars, from one scan of the events."""
    goal = "event_type = 'purchase' AND event_id % 13 <> 0"
    return event_frames(spark, sf_dir).selectExpr(
        "*",
        "frame_idx * 0.25D AS time",
        f"if({goal} AND event_id % 2 = 0, 1, 0) AS goal_blue",
        f"if({goal} AND event_id % 2 = 1, 1, 0) AS goal_orange",
        "event_type = 'signup' OR frame_idx = 0 AS is_kickoff",
    )


def ball_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ball actors per game: every event creates, moves or deletes one of them.

    Some updates hold a position or a velocity only.
    """
    def vec(*axes: str) -> str:
        return "named_struct(" + ", ".join(f"'{n}', cast({x} AS double)" for n, x in zip("xyz", axes)) + ")"

    moved = "event_type NOT IN ('signup', 'error')"
    return event_frames(spark, sf_dir).selectExpr(
        "game_id", "frame_idx", "event_id AS seq", "event_id % 2 AS actor_id",
        "CASE event_type WHEN 'signup' THEN 'new' WHEN 'error' THEN 'delete' ELSE 'update' END AS kind",
        f"if({moved} AND event_id % 7 <> 3, {vec('event_id * 7 % 31 - 15', 'event_id * 11 % 25 - 12', '93')}, NULL) AS position",
        f"if({moved} AND event_id % 5 <> 2, {vec('(event_id * 13 % 5 - 2) * 0.6D', '(event_id * 17 % 3 - 1) * 0.9D', '0')}, NULL) AS velocity",
    )


def rating_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of the games' players: some are missing, unknown to the frames, repeated or too many."""
    lane, g = F.col("lane"), F.col("game_id")
    name = (
        F.when((g % 4 == 1) & (lane == 2), F.lit("ghost"))
        .when((g % 3 == 0) & (lane == 1), player_name(g, F.lit(0)))
        .when(lane == 6, F.lit("extra"))
        .otherwise(player_name(g, lane))
    )
    games = table(spark, sf_dir, "events").select(F.col("user_id").alias("game_id")).distinct()
    lanes = games.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(6))))
    given = lanes.where(~((g % 5 == 2) & (lane == 4)) & ((lane < 6) | (g % 7 == 3)))
    return given.select(
        g.alias("replay_id"), F.floor(lane % 6 / 3).cast("int").alias("team"), name.alias("player_name"),
        (lane * 100 + g % 50).cast("double").alias("target_mmr"),
    )


def player_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame and car."""
    return frames(spark, sf_dir).select("*", F.explode("players").alias("car")).select(
        "game_id", "frame_idx", "event_id", "event_type", "time", "seconds_remaining",
        "ball_pos", "ball_vel", "car.*",
    )


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals by frame. Some scorers are unknown and some frames do not exist."""
    e, g = F.col("event_id"), F.col("game_id")
    team = (e % 2).cast("int")
    scorer = F.when(e % 4 == 3, F.lit("ghost")).otherwise(player_name(g, (e % 2) * 3 + e % 4))
    return (
        event_frames(spark, sf_dir)
        .where(F.col("event_type") == "purchase")
        .select(
            "game_id",
            (F.col("frame_idx") + F.when(e % 13 == 0, F.lit(1000)).otherwise(F.lit(0))).alias("frame"),
            scorer.alias("player_name"),
            team.alias("player_team"),
            "event_id",
        )
    )


def kickoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        event_frames(spark, sf_dir)
        .where((F.col("event_type") == "signup") | (F.col("frame_idx") == 0))
        .select("game_id", F.col("frame_idx").alias("frame"))
    )


def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per lineitem: replay, segment, slot and rating."""
    slot = F.col("l_linenumber") % 6
    price = F.floor("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("replay_id"),
        slot.cast("int").alias("slot"),
        F.floor(slot / 3).cast("int").alias("team"),
        lobby_player_name(F.col("l_orderkey"), slot).alias("player_name"),
        (F.col("l_suppkey") % 4).cast("int").alias("segment"),
        F.col("l_suppkey").alias("platform_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.col("l_returnflag") != "R").alias("known_here"),
        price.alias("price"),
        (price / F.lit(42.0)).alias("pred_mmr"),
    )


def lobby_player_name(replay_id: Column, slot: Column) -> Column:
    return F.concat(F.lit("p"), ((replay_id * 31 + slot * 7) % 9973).cast("string"))


def lobby_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most six players per replay, with label, known flag and mean prediction.

    Sums are whole numbers, so the result does not depend on row order.
    """
    division = ((F.sum("quantity") * 37 + F.col("slot")) % ladder.DIVISION_COUNT).cast("int")
    return (
        segment_scores(spark, sf_dir)
        .groupBy("replay_id", "slot")
        .agg(
            division.alias("division_idx"),
            F.min("known_here").alias("rank_known"),
            (F.sum("price") / (F.lit(42.0) * F.count(F.lit(1)))).alias("pred_mmr"),
            F.count(F.lit(1)).alias("n_segments"),
        )
        .select(
            "replay_id",
            "slot",
            F.floor(F.col("slot") / 3).cast("int").alias("team"),
            lobby_player_name(F.col("replay_id"), F.col("slot")).alias("player_name"),
            "division_idx",
            "rank_known",
            "pred_mmr",
            "n_segments",
            F.when(
                F.col("rank_known"), ladder.division_middle(F.col("division_idx")).cast("double")
            ).alias("target_mmr"),
        )
    )


def replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay catalogue."""
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("downloaded"))
        .when(F.col("o_orderstatus") == "O", F.lit("not_downloaded"))
        .otherwise(F.lit("failed"))
    )
    playlist = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("ranked_standard"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("Ranked-Doubles"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("hoops"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("unknown_mode"))
    )
    split = F.when(F.col("o_orderkey") % 3 == 0, F.lit("training")).when(
        F.col("o_orderkey") % 3 == 1, F.lit("evaluation")
    )
    rank = (F.floor("o_totalprice") % 23).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        status.alias("download_status"),
        playlist.alias("playlist_raw"),
        labels.game_mode_or_default(playlist).alias("game_mode"),
        rank.alias("rank_index"),
        ladder.rank_name(rank).alias("rank"),
        split.alias("dataset_split"),
        (F.col("o_orderkey") % 7 != 0).alias("file_present"),
    )


def match_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header facts of each replay, as the acceptance policy reads them."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(c % 11 == 0, F.lit("TAGame.Replay_Hoops_TA"))
        .when(c % 11 == 1, F.lit("TAGame.Replay_Other_TA"))
        .otherwise(F.lit(labels.SOCCER_GAME_TYPE))
        .alias("game_type"),
        F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, F.lit(2)).when(k % 10 == 2, F.lit(5))
        .otherwise(F.lit(3)).cast("int").alias("team_size"),
        F.when(k % 13 == 0, F.lit(5)).otherwise(F.lit(6)).alias("player_count"),
        F.when(c % 3 == 0, F.lit(None)).when(c % 3 == 1, F.lit(13)).otherwise((c % 40).cast("int"))
        .cast("int").alias("playlist"),
        F.when(c % 5 == 0, F.lit(None)).when(c % 5 == 1, F.lit("TAGame.MatchType_PublicRanked_TA"))
        .when(c % 5 == 2, F.lit("TAGame.MatchType_Private_TA"))
        .when(c % 5 == 3, F.lit("TAGame.MatchType_Public_TA"))
        .otherwise(F.lit("TAGame.MatchType_Season_TA")).alias("match_type"),
    )


def _rank_record(division: Column) -> Column:
    rank = ladder.division_rank(division)
    return F.struct(
        ladder.rank_name(rank).alias("id"),
        rank.alias("tier"),
        F.when(rank < 22, (division % 4 + 1).cast("int")).alias("division"),
        ladder.division_label(division).alias("name"),
    )


def replay_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lobbies as nested JSON documents, one per replay."""
    player = F.struct(
        F.col("slot").alias("slot"),
        F.col("player_name").alias("name"),
        F.when(F.col("rank_known"), _rank_record(F.col("division_idx"))).alias("rank"),
    )
    members = F.array_sort(F.collect_list(F.struct(F.col("team").alias("team"), player.alias("p"))))

    def side(team: int) -> Column:
        mine = F.transform(
            F.filter(F.col("members"), lambda m: m["team"] == team), lambda m: m["p"].dropFields("slot")
        )
        color = F.lit("blue" if team == 0 else "orange")
        return F.when(F.size(mine) > 0, F.struct(color.alias("color"), mine.alias("players")))

    bounded = F.col("replay_id") % 5 != 0
    return (
        lobby_players(spark, sf_dir)
        .groupBy("replay_id")
        .agg(
            members.alias("members"),
            F.min("division_idx").alias("low"),
            F.max("division_idx").alias("high"),
        )
        .select(
            "replay_id",
            F.to_json(
                F.struct(
                    F.col("replay_id").cast("string").alias("id"),
                    F.when(bounded, _rank_record(F.col("low"))).alias("min_rank"),
                    F.when(bounded, _rank_record(F.col("high"))).alias("max_rank"),
                    side(0).alias("blue"),
                    side(1).alias("orange"),
                )
            ).alias("metadata"),
        )
    )
