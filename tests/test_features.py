import re

import numpy as np
import pytest
from helpers import NAMES, frame, frames_df, rosters_df, six
from pyspark.sql import functions as F

from lobbylens.operators import telemetry as tel
from lobbylens.plans import features as ft
from lobbylens.plans import segments as sg


def marked(spark, rows, goals=(), kicks=()):
    goals_df = spark.createDataFrame(list(goals), "game_id bigint, frame bigint, player_name string, player_team int")
    kicks_df = spark.createDataFrame(list(kicks), "game_id bigint, frame bigint")
    return tel.mark_frames(frames_df(spark, rows), goals_df, kicks_df)


def vectors(spark, rows, length=4, **marks):
    games = {r[0] for r in rows}
    segmented = ft.training_frames(marked(spark, rows, **marks), rosters_df(spark, games), length)
    out = ft.feature_vectors(segmented).collect()
    return {(r["game_id"], r["frame_idx"], r["slot"]): r["features"] for r in out}


def test_one_frame(spark):
    got = vectors(spark, [frame(1, 0)])
    assert len(got) == 6 and all(len(v) == 106 for v in got.values())
    by_name = {name: got[(1, 0, slot)] for slot, name in enumerate(NAMES)}
    assert by_name["Player1"][18] == 0.3 and by_name["Player2"][18] == 0.7 and by_name["Player4"][18] == 0.9
    assert len({tuple(v[:7]) for v in got.values()}) == 1
    roles = {n: v[103:106].index(1.0) for n, v in by_name.items()}
    assert roles == {"Player2": 0, "Player1": 1, "Player3": 2, "Player5": 0, "Player4": 1, "Player6": 2}
    # Standing boost counts as collected on the first frame of a segment.
    assert by_name["Player1"][22] == pytest.approx(0.1)
    assert by_name["Player1"][101] == pytest.approx(250 / 300)


def test_block_positions_against_hand_values(spark):
    v = vectors(spark, [frame(1, 0)])[(1, 0, 0)]
    assert v[7:10] == pytest.approx([-1000 / 5120, -2000 / 5120, 17 / 2044])
    assert v[10:13] == pytest.approx([500 / 2300, 200 / 2300, 0.0])
    assert v[13:17] == [0.0, 0.0, 0.0, 1.0]
    assert v[27:30] == pytest.approx([-500 / 5120, -1000 / 5120, 17 / 2044])
    gap = (500**2 + 1000**2) ** 0.5 / 7245
    assert v[54] == pytest.approx(gap)
    assert v[57:60] == pytest.approx([1000 / 5120, 2000 / 5120, 17 / 2044])
    assert v[68] == 0.0 and v[99] == pytest.approx(min((5120**2 + 100**2) ** 0.5 / 7245, 1.0))


def test_demolished_and_absent(spark):
    rows = [frame(1, 0, six(absent=("Player3",), demolished=("Player2",)))]
    got = vectors(spark, rows)
    assert got[(1, 0, 2)] == [0.0] * 106
    focal = got[(1, 0, 0)]
    assert focal[27:40] == [0.0] * 12 + [1.0] and focal[40:53] == [0.0] * 13 and focal[53:57] == [0.0] * 4
    assert got[(1, 0, 1)][7:20] == [0.0] * 12 + [1.0] and got[(1, 0, 1)][20:22] == [0.0, 0.0]
    orange = got[(1, 0, 3)]
    assert orange[57 + 12:57 + 24] == [0.0] * 11 + [1.0] and orange[57 + 24:57 + 36] == [0.0] * 12
    # Nobody else is in play, so Player1 is closest; Player2 ranks by slot before Player3.
    assert focal[103:106] == [1.0, 0.0, 0.0] and got[(1, 0, 1)][103:106] == [0.0, 1.0, 0.0]


def test_boost_bookkeeping_and_segment_reset(spark):
    boosts = [0.34, 0.34, 0.20, 1.00]
    rows = [frame(1, 2 * i, six({"Player1": b})) for i, b in enumerate(boosts)]
    whole = vectors(spark, rows, length=4)
    assert [whole[(1, 2 * i, 0)][22] * 300 for i in range(4)] == pytest.approx([34, 34, 34, 114])
    assert [whole[(1, 2 * i, 0)][23] * 300 for i in range(4)] == pytest.approx([0, 0, 14, 14])
    split = vectors(spark, rows, length=2)
    assert split[(1, 4, 0)][22] * 300 == pytest.approx(20) and split[(1, 6, 0)][22] * 300 == pytest.approx(100)
    assert split[(1, 6, 0)][23] == 0.0


def test_missing_player_keeps_state(spark):
    rows = [frame(1, 0, six({"Player1": 0.5})), frame(1, 2, six(absent=("Player1",))),
            frame(1, 4, six({"Player1": 0.5}, demolished=("Player1",)))]
    got = vectors(spark, rows, length=4)
    assert got[(1, 4, 0)][22] * 300 == pytest.approx(50)
    assert got[(1, 4, 0)][26] == pytest.approx(0.5)


def test_repeated_name_last_one_counts(spark):
    cars = six() + [six({"Player1": 0.9})[0]]
    assert vectors(spark, [frame(1, 0, cars)])[(1, 0, 0)][18] == 0.9


def test_goal_window_edges(spark):
    rows = [frame(1, i) for i in range(0, 1700)]
    kept = tel.trim_goal_windows(marked(
        spark, rows, goals=[(1, 100, "Player1", 0), (1, 900, "Player4", 1)], kicks=[(1, 0), (1, 180)]))
    left = {r.frame_idx for r in kept.select("frame_idx").collect()}
    assert left == set(range(0, 101)) | set(range(180, 901)) | set(range(1500, 1700))


def test_score_counts_goal_frame(spark):
    rows = [frame(1, i) for i in range(0, 12)]
    got = vectors(spark, rows, length=4, goals=[(1, 4, "Player1", 0)], kicks=[(1, 6)])
    assert got[(1, 2, 0)][100] == 0.0
    assert got[(1, 4, 0)][100] == pytest.approx(0.2) and got[(1, 4, 3)][100] == pytest.approx(-0.2)


def test_inference_has_no_context(spark):
    rows = [frame(1, i) for i in range(0, 8)]
    segmented = ft.inference_frames(frames_df(spark, rows), rosters_df(spark, [1]), 2)
    out = ft.feature_vectors(segmented, with_context=False).collect()
    assert len(out) == 24 and all(r["features"][100:103] == [0.0] * 3 for r in out)


def test_packing(spark):
    def packed(n_frames, length):
        rows = [frame(1, i, six({"Player1": i / 100})) for i in range(n_frames)]
        segmented = ft.inference_frames(frames_df(spark, rows), rosters_df(spark, [1]), length)
        return sg.pack(ft.feature_vectors(segmented, with_context=False), length)

    short = packed(10, 6)
    assert short.count() == 6 and short.where(F.size("frames") != 6).count() == 0
    last = short.where("slot = 0").first()["frames"]
    assert last[5] == last[4] != last[3]
    assert {r.segment for r in packed(26, 6).select("segment").collect()} == {0, 1}


def test_empty_game_gets_a_blank_segment(spark):
    segmented = ft.inference_frames(frames_df(spark, [frame(1, 0)]), rosters_df(spark, [1]), 2)
    packed = sg.pack(ft.feature_vectors(segmented, with_context=False), 2)
    games = spark.createDataFrame([(1,), (2,)], "game_id bigint")
    blank = sg.empty_games(games, packed, 2)
    assert blank.count() == 6 and blank.select("game_id").distinct().first()[0] == 2
    assert blank.first()["frames"] == [[0.0] * 106] * 2


def test_segment_counts(spark):
    counts = {1000: 3, 299: 1, 300: 1, 301: 1, 600: 2, 0: 1}
    df = spark.createDataFrame([(n,) for n in counts], "n bigint")
    got = {r.n: r.c for r in df.select("n", tel.segment_count(F.col("n"), 300).alias("c")).collect()}
    assert got == counts


def test_segment_store_round_trip(spark, folder):
    rows = [frame(g, i) for g in (1, 2) for i in range(8)]
    segmented = ft.inference_frames(frames_df(spark, rows), rosters_df(spark, [1, 2]), 2)
    packed = sg.pack(ft.feature_vectors(segmented, with_context=False), 2).withColumn(
        "game_mode", F.lit("ranked-standard")).withColumn("rank", F.lit("gold-1"))
    sg.write_segments(packed.where("game_id = 1"), folder)
    games = spark.createDataFrame([(1,), (2,)], "game_id bigint")
    assert [r.game_id for r in sg.missing_games(games, sg.read_segments(spark, folder, 2)).collect()] == [2]
    sg.write_segments(packed.where("game_id = 2"), folder)
    assert sg.read_segments(spark, folder, 2).count() == packed.count()
    assert sg.read_segments(spark, folder, 3).count() == 0


def test_hot_game_equals_small_games(spark):
    """One game with most of the frames gives the same vectors as each part alone."""
    rows = [frame(1, i, six({"Player1": (i % 50) / 100})) for i in range(400)] + [frame(2, i) for i in range(20)]
    together = vectors(spark, rows, length=10)
    alone = vectors(spark, [r for r in rows if r[0] == 2], length=10)
    assert {k: v for k, v in together.items() if k[0] == 2} == alone
    assert len(together) == 6 * (200 + 10)


def test_slots_of_rating_rows(spark):
    """Names in the order of the targets, whoever is in the frames: absent, unknown, repeated and surplus ones."""
    from lobbylens.operators import labelling

    rows = [(1, 0, "b", 5.0), (1, 0, "a", 9.0), (1, 0, "a", 3.0), (1, 0, "c", 1.0), (1, 1, "z", 7.0), (2, 1, "y", None)]
    players = spark.createDataFrame(rows, "replay_id long, team int, player_name string, target_mmr double")
    names = {r.replay_id: r.roster for r in labelling.rating_roster(players).collect()}
    targets = {r[0]: list(r[1:]) for r in labelling.target_slots(players).collect()}
    assert names == {1: ["a", "a", "b", "z", "", ""], 2: ["", "", "", "y", "", ""]}
    assert targets == {1: [3.0, 9.0, 5.0, 7.0, 0.0, 0.0], 2: [0.0] * 6}


def test_kickoffs_of_ball_actors(spark):
    """Two balls: one at rest at the centre is enough; state is carried, and ends with the actor."""
    from lobbylens.operators import telemetry as tel

    far, slow, fast = (500.0, 0.0, 93.0), (0.0, 0.0, 0.0), (0.0, 40.0, 0.0)
    rows = [
        (1, 1, 0, 10, "new", far, fast), (1, 1, 1, 11, "update", (0.0, 9.9, 93.0), None), (1, 1, 2, 12, "update", None, slow),
        (1, 2, 3, 13, "new", None, None), (1, 1, 4, 14, "update", far, None), (1, 2, 5, 15, "delete", None, None),
        (1, 2, 6, 16, "update", (0.0, 0.0, 0.0), slow), (1, 2, 7, 17, "new", None, None), (1, 2, 8, 18, "update", far, None),
        (1, 1, 8, 19, "update", (0.0, 0.0, 0.0), None), (2, 1, 4, 1, "update", (0.0, 0.0, 0.0), slow),
    ]
    vec = "struct<x:double,y:double,z:double>"
    log = spark.createDataFrame(rows, f"game_id long, actor_id long, frame_idx long, seq long, kind string, position {vec}, velocity {vec}")
    got = sorted((r.game_id, r.frame) for r in tel.ball_kickoffs(log).collect())
    assert got == [(1, 0), (1, 2), (1, 7), (2, 0)]


@pytest.mark.parametrize("with_context", [True, False])
def test_no_method_too_long_to_compile(spark, folder, capsys, with_context):
    """The JVM leaves methods above 8000 bytes uncompiled; the limit of the session must not be what prevents them."""
    rows = [frame(1, i, six({"Player1": 0.5})) for i in range(6)]
    frames = ft.inference_frames(frames_df(spark, rows), rosters_df(spark, [1]), 3)
    context = ("0 AS seconds_remaining", "0L AS blue", "0L AS orange")
    ft.with_cumulative(frames).selectExpr(*([c for c in frames.columns if c not in ("seconds_remaining", "blue", "orange")]),
                                          *(f"c{s}" for s in range(6)), *context).write.parquet(f"{folder}/summed")
    ft.vectors_of(spark.read.parquet(f"{folder}/summed"), with_context).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_packing_gathers_float32(spark):
    """The rows that are sorted and spilled hold the stored numbers, not doubles narrowed afterwards."""
    rows = spark.createDataFrame([(1, 0, 0, i, 2, [0.1 * i] * 3) for i in range(2)],
                                 "game_id bigint, segment bigint, slot int, rn bigint, n_kept bigint, features array<double>")
    packed = sg.pack(rows, 2)
    gather = [line for line in packed._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list" in line]
    assert gather and "array<float>" not in gather[0]
    want = np.float32([[0.0] * 3, [0.1] * 3])
    assert np.array_equal(np.float32(packed.first()["frames"]), want)
