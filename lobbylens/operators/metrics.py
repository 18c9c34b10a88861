"""Evaluation of predictions: per-rank errors, collapse diagnostics, loss reports.

Inputs are player rows (replay_id, slot, target_mmr, pred_mmr); unknown targets
are left out everywhere. All metrics are combining aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobbylens.functions import ladder, losses
from lobbylens.operators.scan import lobby_list, numbered

# Watched ranks and thresholds of the reports.
WATCHED_RANKS = ("bronze-1", "grand-champion-3", "supersonic-legend")
ALERT_RISE = 0.25
COLLAPSE_STD = 50.0
MIN_STD = 1.0e-8


def known_rows(players: DataFrame) -> DataFrame:
    return players.where(losses.is_known(F.col("target_mmr")))


def with_ranks(players: DataFrame) -> DataFrame:
    """True and predicted rank, both through the band of the rating."""
    return known_rows(players).select(
        "*",
        ladder.rating_rank(F.col("target_mmr")).alias("true_rank"),
        ladder.rating_rank(F.col("pred_mmr")).alias("pred_rank"),
    )


def _error() -> Column:
    return F.col("pred_mmr") - F.col("target_mmr")


def rank_rmse(players: DataFrame) -> DataFrame:
    return (
        with_ranks(players)
        .groupBy(F.col("true_rank").alias("rank_index"))
        .agg(F.sqrt(F.avg(_error() * _error())).alias("rmse"), F.count(F.lit(1)).alias("n"))
    )


def rank_confusion(players: DataFrame) -> DataFrame:
    """Per rank: targets with RMSE, predictions and correct predictions.

    One pass: each row counts once under its true and once under its predicted rank.
    """
    rows = with_ranks(players)
    hit = (F.col("true_rank") == F.col("pred_rank")).cast("int")
    both = rows.select(
        F.explode(
            F.array(
                F.struct(F.col("true_rank").alias("rank_index"), (_error() * _error()).alias("sq"),
                         F.lit(None).cast("int").alias("hit")),
                F.struct(F.col("pred_rank").alias("rank_index"), F.lit(None).cast("double").alias("sq"),
                         hit.alias("hit")),
            )
        ).alias("x")
    ).select("x.*")
    return both.groupBy("rank_index").agg(
        F.coalesce(F.sqrt(F.avg("sq")), F.lit(0.0)).alias("rmse"),
        F.count("sq").alias("targets"),
        F.count("hit").alias("predicted"),
        F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("correct"),
    )


def tail_guard(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Watched ranks whose RMSE rose; an alert above 25 percent. Both sides are 23 rows at most."""
    before = baseline.select("rank_index", F.col("rmse").alias("baseline_rmse"))
    joined = current.join(before, "rank_index").where(F.col("baseline_rmse") > 0)
    rise = (F.col("rmse") - F.col("baseline_rmse")) / F.col("baseline_rmse")
    return joined.withColumn("rank", ladder.rank_name(F.col("rank_index"))).where(
        F.col("rank").isin(*WATCHED_RANKS)
    ).select("rank", "rmse", "baseline_rmse", rise.alias("rise"), (rise > ALERT_RISE).alias("alert"))


def lobby_index(players: DataFrame) -> DataFrame:
    """0-based position of each lobby in replay order, without a global sort."""
    lobbies = players.select("replay_id").distinct()
    return numbered(lobbies, [], ["replay_id"], "lobby")


def validation_loss(players: DataFrame, batch_size: int) -> DataFrame:
    """Masked scaled MSE per batch of lobbies, then the plain mean over batches."""
    batches = lobby_index(players).select(
        "replay_id", F.floor(F.col("lobby") / batch_size).alias("batch")
    )
    known = losses.is_known(F.col("target_mmr"))
    diff = losses.scaled_error(F.col("pred_mmr"), F.col("target_mmr"))
    per_batch = players.join(batches, "replay_id").groupBy("batch").agg(
        (
            F.coalesce(F.sum(F.when(known, diff * diff)), F.lit(0.0)) / F.greatest(F.count_if(known), F.lit(1))
        ).alias("mse")
    )
    return per_batch.agg(F.avg("mse").alias("loss"), F.count(F.lit(1)).alias("batches"))


def pearson(covariance: Column, std_a: Column, std_b: Column) -> Column:
    """Correlation held to [-1, 1]; 0 when either side hardly varies."""
    flat = (F.coalesce(std_a, F.lit(0.0)) <= MIN_STD) | (F.coalesce(std_b, F.lit(0.0)) <= MIN_STD)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(covariance, std_a * std_b)))
    return F.when(flat, F.lit(0.0)).otherwise(r)


def collapse_metrics(players: DataFrame) -> DataFrame:
    """Signs of a model stuck at the mean, against two constant baselines."""
    rows = known_rows(players)
    # A lobby has at most six rows.
    off = F.avg("target_mmr").over(W.partitionBy("replay_id")) - F.col("target_mmr")
    return (
        rows.select("pred_mmr", "target_mmr", (off * off).alias("off2"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.stddev_samp("pred_mmr").alias("pred_std"),
            F.stddev_samp("target_mmr").alias("target_std"),
            F.covar_samp("pred_mmr", "target_mmr").alias("covariance"),
            F.sqrt(F.var_pop("target_mmr")).alias("constant_rmse"),
            F.sqrt(F.avg("off2")).alias("lobby_mean_rmse"),
        )
        .where(F.col("n") >= 2)
        .select(
            "n",
            "pred_std",
            pearson(F.col("covariance"), F.col("pred_std"), F.col("target_std")).alias("pearson_r"),
            "constant_rmse",
            "lobby_mean_rmse",
            (F.col("pred_std") < COLLAPSE_STD).alias("collapse_alert"),
        )
    )


# --- rank balance ------------------------------------------------------------------------


def rank_histogram(rows: DataFrame, rank: str = "rank_index") -> DataFrame:
    """Rows per rank with empty ranks as zero: always 23 rows."""
    spark = rows.sparkSession
    every = spark.range(ladder.RANK_COUNT).select(F.col("id").cast("int").alias(rank))
    counted = rows.groupBy(rank).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, rank, "left").select(rank, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def upper_median(histogram: DataFrame) -> DataFrame:
    """Upper median of the non-empty counts, 1 if all are empty."""
    filled = F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.col("n"))))
    return histogram.agg(filled.alias("c")).select(
        F.coalesce(F.get("c", F.floor(F.size("c") / 2).cast("int")), F.lit(1)).cast("bigint").alias("median")
    )


def oversample_factors(histogram: DataFrame) -> DataFrame:
    """How often to repeat the rows of a rank: median / count held to 1..4, 0 when empty."""
    with_median = histogram.withColumn("median", upper_median(histogram).scalar())
    factor = F.greatest(F.lit(1), F.least(F.lit(4), F.expr("median div n")))
    return with_median.select(
        "rank_index", "n", F.when(F.col("n") > 0, factor).otherwise(F.lit(0)).cast("int").alias("factor")
    )


def inverse_frequency_weights(histogram: DataFrame) -> DataFrame:
    """max/count held to 0.5..5, empty ranks 1.0, scaled to mean 1 over all 23 ranks."""
    every = W.partitionBy(F.lit(0))
    top = F.greatest(F.max("n").over(every), F.lit(1))
    raw = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.5), F.least(F.lit(5.0), top / F.col("n")))
    )
    return histogram.select("rank_index", "n", raw.alias("raw")).select(
        "rank_index", "n", (F.col("raw") / F.avg("raw").over(every)).alias("weight")
    )


def with_weights(players: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight of each player's own rank, 1.0 for unknown targets. The table has 23 rows."""
    table = weights.select(F.col("rank_index").alias("_r"), "weight")
    rank = F.when(losses.is_known(F.col("target_mmr")), ladder.rating_rank(F.col("target_mmr")))
    return (
        players.withColumn("_r", rank)
        .join(F.broadcast(table), "_r", "left")
        .withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        .drop("_r")
    )


# --- losses ---------------------------------------------------------------------------------


def _masked_mean(value: Column) -> Column:
    """Sum over known rows divided by their number, which counts as at least 1."""
    known = losses.is_known(F.col("target_mmr"))
    return F.coalesce(F.sum(F.when(known, value)), F.lit(0.0)) / F.greatest(F.count_if(known), F.lit(1))


def huber_metric(weighted: DataFrame) -> DataFrame:
    diff = losses.scaled_error(F.col("pred_mmr"), F.col("target_mmr"))
    return weighted.agg(
        _masked_mean(losses.huber(diff)).alias("huber"),
        _masked_mean(losses.huber(diff) * F.col("weight")).alias("weighted_huber"),
    )


def pinball_metric(players: DataFrame) -> DataFrame:
    diff = losses.scaled_error(F.col("pred_mmr"), F.col("target_mmr"))
    return players.agg(
        _masked_mean(losses.pinball(diff)).alias("pinball"),
        _masked_mean(losses.pinball_term(diff, F.col("target_mmr"))).alias("pinball_term"),
    )


def regression_loss(weighted: DataFrame) -> DataFrame:
    diff = losses.scaled_error(F.col("pred_mmr"), F.col("target_mmr"))
    element = losses.huber(diff) + losses.pinball_term(diff, F.col("target_mmr"))
    return weighted.agg(_masked_mean(element * F.col("weight")).alias("regression"))


def ordinal_loss(players: DataFrame, logits: str = "logits") -> DataFrame:
    per_row = losses.ordinal_bce(F.col(logits), F.col("target_mmr")) / F.lit(
        float(len(ladder.ORDINAL_BOUNDARIES))
    )
    return players.agg(_masked_mean(per_row).alias("ordinal"))


def lobby_hinges(players: DataFrame) -> DataFrame:
    """Pairs and hinge sum per lobby of at most six players."""
    lobby = lobby_list(F.struct(F.col("target_mmr").alias("target"), F.col("pred_mmr").alias("pred")))
    hinges = known_rows(players).groupBy("replay_id").agg(losses.pair_hinges(lobby).alias("h"))
    return hinges.select(
        "replay_id",
        F.size("h").cast("bigint").alias("pairs"),
        F.aggregate("h", F.lit(0.0), lambda acc, x: acc + x).alias("hinge_sum"),
    )


def pairwise_loss(players: DataFrame) -> DataFrame:
    return lobby_hinges(players).agg(
        (
            F.coalesce(F.sum("hinge_sum"), F.lit(0.0))
            / F.greatest(F.coalesce(F.sum("pairs"), F.lit(0)), F.lit(1))
        ).alias("pairwise")
    )


def spread_loss(players: DataFrame) -> DataFrame:
    """Squared shortfall of the spread of predictions against targets."""
    scale = F.lit(losses.MMR_SCALE)

    def std(column: str) -> Column:
        return F.sqrt(F.greatest(F.coalesce(F.var_pop(F.col(column) / scale), F.lit(0.0)), F.lit(losses.SPREAD_FLOOR)))

    return known_rows(players).agg(std("target_mmr").alias("t"), std("pred_mmr").alias("p")).select(
        losses.spread_gap(F.col("t"), F.col("p")).alias("spread")
    )


def composite_loss(weighted: DataFrame, logits: str = "logits") -> DataFrame:
    """The four terms and their weighted total, in one pass over the players.

    Each lobby folds its element losses and pair hinges; the lobbies then add up. Its players, six
    at most, come along for the variances, whose moments Spark merges without cancellation.
    """
    pred, target = F.col("pred_mmr"), F.col("target_mmr")
    diff = losses.scaled_error(pred, target)
    element = (losses.huber(diff) + losses.pinball_term(diff, target)) * F.col("weight")
    bce = losses.ordinal_bce(F.col(logits), target) / F.lit(float(len(ladder.ORDINAL_BOUNDARIES)))
    sums = {"element": element, "bce": bce}
    lobby = lobby_list(F.struct(target.alias("target"), pred.alias("pred")))
    folded = known_rows(weighted).groupBy("replay_id").agg(
        *(F.sum(x).alias(n) for n, x in sums.items()),
        F.count(F.lit(1)).alias("n"),
        losses.pair_hinges(lobby).alias("h"),
        lobby.alias("lobby"),
    )
    rows = folded.select(
        *sums, "n", F.size("h").alias("pairs"), F.aggregate("h", F.lit(0.0), lambda acc, x: acc + x).alias("hinge"),
        F.posexplode("lobby").alias("_i", "_player"),
    )

    def variance(name: str) -> Column:
        return F.coalesce(F.var_pop(F.col(f"_player.{name}") / F.lit(losses.MMR_SCALE)), F.lit(0.0))

    once = F.col("_i") == 0
    totals = rows.agg(
        *(F.coalesce(F.sum(F.when(once, F.col(c))), F.lit(0.0)).alias(c) for c in (*sums, "n", "pairs", "hinge")),
        variance("target").alias("t"), variance("pred").alias("p"),
    )
    n = F.greatest(F.col("n"), F.lit(1.0))

    def std(moment: str) -> Column:
        return F.sqrt(F.greatest(F.col(moment), F.lit(losses.SPREAD_FLOOR)))

    parts = totals.select(
        (F.col("element") / n).alias("regression"),
        (F.col("bce") / n).alias("ordinal"),
        (F.col("hinge") / F.greatest(F.col("pairs"), F.lit(1.0))).alias("pairwise"),
        losses.spread_gap(std("t"), std("p")).alias("spread"),
    )
    total = (
        F.col("regression")
        + F.lit(losses.ORDINAL_WEIGHT) * F.col("ordinal")
        + F.lit(losses.PAIRWISE_WEIGHT) * F.col("pairwise")
        + F.lit(losses.SPREAD_WEIGHT) * F.col("spread")
    )
    return parts.withColumn("total", total)


def boosted_mse(players: DataFrame, threshold: float, boost: float) -> DataFrame:
    """Scaled MSE in which lobbies with a high mean target count `boost` times."""
    diff = losses.scaled_error(F.col("pred_mmr"), F.col("target_mmr"))
    lobby = known_rows(players).groupBy("replay_id").agg(
        F.avg("target_mmr").alias("mean_target"), F.sum(diff * diff).alias("sq"), F.count(F.lit(1)).alias("n")
    )
    factor = F.when(F.col("mean_target") > threshold, F.lit(boost)).otherwise(F.lit(1.0))
    return lobby.agg(
        (F.coalesce(F.sum(F.col("sq") * factor), F.lit(0.0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)))
        .alias("boosted_mse")
    )


def slot_rmse(lobbies: DataFrame, limit: float = 400.0) -> DataFrame:
    """RMSE per slot of synthetic lobbies; the top slot must stay under the limit."""
    err = F.col("pred_mmr") - F.col("canonical_mmr")
    measured = lobbies.groupBy("rank_index").agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), F.count(F.lit(1)).alias("n")
    )
    top = F.col("rank_index") == ladder.RANK_COUNT - 1
    return measured.withColumn("passed", F.when(top, F.col("rmse") < limit))


def metrics_document(config: DataFrame, loss: DataFrame, by_rank: DataFrame) -> DataFrame:
    """Merge the validation figures into the configuration JSON: one row of text.

    `by_rank` holds 23 rows at most.
    """
    entries = F.array_sort(F.collect_list(F.struct("rank_index", "rank", "rmse_mmr", "sample_count")))
    named = by_rank.where(F.col("rank_index") > 0).select(
        "rank_index", ladder.rank_name(F.col("rank_index")).alias("rank"), F.col("rmse").alias("rmse_mmr"),
        F.col("n").alias("sample_count"),
    )
    ranks = named.agg(
        F.transform(entries, lambda e: e.dropFields("rank_index")).alias("validation_rmse_by_rank")
    )
    merged = config.select(
        "config", loss.scalar().alias("loss"), ranks.scalar().alias("validation_rmse_by_rank")
    )
    names = "'validation_loss', 'validation_approx_rmse_mmr', 'validation_rmse_by_rank'"
    document = f"""to_json(map_concat(
      map_filter(from_json(config, 'map<string,variant>'), (k, v) -> k NOT IN ({names})),
      map('validation_loss', cast(loss AS variant),
          'validation_approx_rmse_mmr', cast(sqrt(loss) * {losses.MMR_SCALE}D AS variant),
          'validation_rmse_by_rank', to_variant_object(validation_rmse_by_rank))))"""
    return merged.select(F.expr(document).alias("document"))
