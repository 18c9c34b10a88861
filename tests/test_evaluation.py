import math

import numpy as np
import pytest
from helpers import column
from pyspark.sql import functions as F

from lobbylens.functions import ladder, losses
from lobbylens.operators import metrics, probe, results, series

PLAYERS = "replay_id bigint, slot int, target_mmr double, pred_mmr double"


def players(spark, rows):
    return spark.createDataFrame(rows, PLAYERS)


def test_ordinal_targets(spark):
    flags = column(spark, [194.0, 966.0, 2200.0], "double", losses.ordinal_targets)
    assert sum(flags[0]) == 0 and sum(flags[2]) == 20
    assert flags[1][11] == 1 and flags[1][12] == 0 and len(flags[1]) == 21
    assert column(spark, [[1.0] * 21, [-1.0] * 21, [1.0] * 5 + [-1.0] * 16], "array<double>", losses.ordinal_rank) == [22, 1, 6]


@pytest.mark.parametrize("pred, fires", [((900.1, 900.0), True), ((1000.0, 900.0), False), ((950.0, 900.0), False)])
def test_pair_hinge(spark, pred, fires):
    rows = [(1, 0, 1000.0, pred[0]), (1, 1, 900.0, pred[1])]
    row = metrics.lobby_hinges(players(spark, rows)).first()
    assert row.pairs == 1 and (row.hinge_sum > 1e-12) == fires


def test_close_targets_make_no_pair(spark):
    assert metrics.lobby_hinges(players(spark, [(1, 0, 925.0, 1.0), (1, 1, 900.0, 2.0)])).first().pairs == 0


def test_huber_and_pinball(spark):
    assert column(spark, [0.5, 2.0, -2.0], "double", losses.huber) == [0.125, 1.5, 1.5]
    want = [np.mean([max(q * -d, (1 - q) * d) for q in (0.1, 0.25, 0.75, 0.9)]) for d in (0.3, -0.4)]
    assert column(spark, [0.3, -0.4], "double", losses.pinball) == pytest.approx(want)


def test_rank_balance(spark):
    rows = [(r,) for r, n in {1: 1, 2: 3, 3: 8, 4: 40}.items() for _ in range(n)]
    histogram = metrics.rank_histogram(spark.createDataFrame(rows, "rank_index int"))
    assert histogram.count() == 23
    assert metrics.upper_median(histogram).first()[0] == 8
    factors = {r.rank_index: r.factor for r in metrics.oversample_factors(histogram).collect()}
    assert [factors[r] for r in (0, 1, 2, 3, 4)] == [0, 4, 2, 1, 1]
    weights = {r.rank_index: r.weight for r in metrics.inverse_frequency_weights(histogram).collect()}
    raw = [5.0, 5.0, 5.0, 1.0] + [1.0] * 19
    assert weights[1] == pytest.approx(5.0 / np.mean(raw)) and np.mean(list(weights.values())) == pytest.approx(1.0)


def test_collapse(spark):
    rng = np.random.default_rng(3)
    t, p = rng.uniform(200, 1800, 60), rng.uniform(200, 1800, 60)
    rows = [(i // 6, i % 6, float(t[i]) if i % 7 else None, float(p[i])) for i in range(60)]
    got = metrics.collapse_metrics(players(spark, rows)).first()
    known = [i for i in range(60) if i % 7]
    tk, pk = t[known], p[known]
    lobby = np.array([np.mean([t[j] for j in known if j // 6 == i // 6]) for i in known])
    assert got.n == len(known)
    assert got.pred_std == pytest.approx(pk.std(ddof=1)) and got.pearson_r == pytest.approx(np.corrcoef(pk, tk)[0, 1])
    assert got.constant_rmse == pytest.approx(tk.std()) and got.lobby_mean_rmse == pytest.approx(math.sqrt(np.mean((lobby - tk) ** 2)))
    flat = metrics.collapse_metrics(players(spark, [(1, 0, 500.0, 700.0), (1, 1, 900.0, 700.0)])).first()
    assert flat.pearson_r == 0.0 and flat.collapse_alert
    assert metrics.collapse_metrics(players(spark, [(1, 0, 500.0, 700.0)])).count() == 0


def test_validation_loss_is_a_mean_of_batch_means(spark):
    rows = [(1, 0, 1000.0, 1250.0), (2, 0, 1000.0, 1000.0), (2, 1, 1000.0, 1000.0), (3, 0, None, 5.0)]
    got = metrics.validation_loss(players(spark, rows), 1).first()
    assert got.batches == 3 and got.loss == pytest.approx(0.01 / 3)


def test_rank_tables_and_tail_guard(spark):
    top = [(i, 0, 2200.0, 2000.0) for i in range(3)]
    worse = [(i, 0, 2200.0, 1900.0) for i in range(3)]
    base, now = metrics.rank_rmse(players(spark, top)), metrics.rank_rmse(players(spark, worse))
    row = metrics.tail_guard(now, base).first()
    assert row["rank"] == "supersonic-legend" and row.rise == pytest.approx(0.5) and row.alert
    confusion = {r.rank_index: r for r in metrics.rank_confusion(players(spark, top + [(9, 0, 2200.0, 100.0)])).collect()}
    assert (confusion[22].targets, confusion[22].predicted, confusion[22].correct) == (4, 3, 3)
    assert (confusion[1].targets, confusion[1].predicted, confusion[1].correct) == (0, 1, 0)


def test_composite_matches_its_terms(spark):
    rng = np.random.default_rng(4)
    rows = [(i // 6, i % 6, float(rng.uniform(100, 2000)) if i % 5 else None, float(rng.uniform(100, 2000))) for i in range(48)]
    boundaries = ",".join(f"{b}D" for b in ladder.ORDINAL_BOUNDARIES)
    weighted = players(spark, rows).withColumn("weight", F.lit(1.5)).withColumn(
        "logits", F.expr(f"transform(array({boundaries}), b -> (pred_mmr - b) / 100D)"))
    got = metrics.composite_loss(weighted).first()
    assert got.regression == pytest.approx(metrics.regression_loss(weighted).first()[0])
    assert got.ordinal == pytest.approx(metrics.ordinal_loss(weighted).first()[0])
    assert got.pairwise == pytest.approx(metrics.pairwise_loss(weighted).first()[0])
    assert got.spread == pytest.approx(metrics.spread_loss(weighted).first()[0], abs=1e-12)


def test_outliers_are_strictly_above(spark):
    rows = [(1, s, None, float(p)) for s, p in enumerate((1000, 1000, 1000, 1000, 1200, 1201))]
    flags = {r.slot: r.is_suspect for r in results.lobby_outliers(players(spark, rows), "pred_mmr").collect()}
    assert flags == {0: False, 1: False, 2: False, 3: False, 4: False, 5: True}


def test_hot_player_median(spark):
    rng = np.random.default_rng(6)
    preds = rng.uniform(0, 2500, 501)
    rows = [(1, 0, None, float(p)) for p in preds] + [(2, s, None, 700.0) for s in range(6)]
    got = {(r.replay_id, r.slot): r.median_mmr for r in results.segment_medians(players(spark, rows)).collect()}
    assert got[(1, 0)] == pytest.approx(np.median(preds)) and got[(2, 3)] == 700.0


def test_moving_average(spark):
    losses_in = spark.createDataFrame([(1, i, 1.0) for i in range(3)], "s int, e bigint, v double")
    got = [r.ema for r in series.moving_average(losses_in, ["s"], "e", "v").orderBy("e").collect()]
    assert got == pytest.approx([0.3, 0.51, 0.657])


@pytest.mark.parametrize(("alpha", "chunk"), [
    (0.3, 1 << 16), (0.01, 1 << 16), (0.99, 1 << 16), (1.0, 7), (1e-5, 1 << 16), (0.3, 7), (0.01, 64), (1e-5, 256)])
def test_moving_average_across_chunks(spark, monkeypatch, alpha, chunk):
    """Small chunks carry the whole history, level by level, for any alpha."""
    monkeypatch.setattr(series, "EMA_CHUNK", chunk)
    rng = np.random.default_rng(8)
    values = rng.uniform(0, 50, 1500)
    rows = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(values)], "s int, e bigint, v double")
    want, state = [], 0.0
    for x in values:
        state = alpha * x + (1.0 - alpha) * state
        want.append(state)
    got = [r.ema for r in series.moving_average(rows, ["s"], "e", "v", alpha).orderBy("e").collect()]
    assert np.allclose(got, want, rtol=1e-10)


def test_lobby_scorer_sees_all_slots(spark):
    rows = [(g, s, [[float(g * 10 + s + f)] * 30 for f in range(4)]) for g in range(70) for s in range(6) if (g, s) != (3, 5)]
    df = spark.createDataFrame(rows, "game_id int, slot int, frames array<array<float>>")
    out = probe.score_lobbies(df, lambda block: block.sum(axis=(2, 3)) - block.sum(axis=(1, 2, 3))[:, None], ["game_id"])
    got = {(r.game_id, r.slot): r.pred_mmr for r in out.collect()}
    own = {(g, s): float(np.sum(f)) for g, s, f in rows}
    assert len(got) == len(rows)
    assert all(v == own[k] - sum(own.get((k[0], s), 0.0) for s in range(6)) for k, v in got.items())


def test_sustained_outliers(spark):
    rows = []
    for epoch in range(6):
        for segment in range(100):
            high = segment == 7 and epoch != 2
            rows.append((segment, epoch, 100.0 + segment if high else float(segment % 10)))
    df = spark.createDataFrame(rows, "segment int, epoch bigint, loss double")
    got = {(r.segment, r.epoch): r for r in series.mask_outliers(df, ["segment"], "epoch", "loss").collect()}
    assert [got[(7, e)].streak for e in range(6)] == [1, 2, 0, 1, 2, 3]
    assert [got[(7, e)].is_masked for e in range(6)] == [False] * 5 + [True]
    assert not any(r.is_masked for (s, _), r in got.items() if s != 7 and s % 10 != 9)


def test_all_equal_epoch_marks_everything(spark):
    df = spark.createDataFrame([(s, 0, 1.0) for s in range(10)], "segment int, epoch bigint, loss double")
    assert series.top_flags(df, "epoch", "loss").where("is_high").count() == 10


def test_best_so_far(spark):
    rows = [(1, i, x) for i, x in enumerate([5.0, 4.0, 4.0, 6.0, 3.0])]
    got = series.best_so_far(spark.createDataFrame(rows, "s int, e bigint, v double"), ["s"], "e", "v").orderBy("e").collect()
    assert [(r.best, r.improved, r.epochs_since) for r in got] == [
        (5.0, True, 0), (4.0, True, 0), (4.0, False, 1), (4.0, False, 2), (3.0, True, 0)]
