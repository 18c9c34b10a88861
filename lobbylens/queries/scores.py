"""Checked queries: result tables, evaluation, losses and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lobbylens.functions import labels, ladder, losses
from lobbylens.operators import catalog, metrics, probe, results, sampling
from lobbylens.queries import sqltext as q
from lobbylens.queries.registry import Registry, num
from lobbylens.sources import tables as t

R = Registry()


def rounded(df, *names):
    return df.select(*(num(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns))


# --- results ---------------------------------------------------------------------------------

MEDIANS = """SELECT replay_id, MEDIAN(pred_mmr) AS lobby_median FROM lp GROUP BY replay_id"""


@R.add("lobby_outlier", q.with_ctes("lp", f"""SELECT lp.replay_id, slot, player_name, {q.r6('pred_mmr')} AS pred_mmr,
  {q.r6('lobby_median')} AS lobby_median, {q.division_label(q.band('pred_mmr'))} AS division,
  {q.division_label(q.band('lobby_median'))} AS lobby_division FROM lp JOIN m ON m.replay_id = lp.replay_id
  WHERE pred_mmr > lobby_median + 200""", m=MEDIANS))
def lobby_outlier(spark, sf):
    flagged = results.lobby_outliers(t.lobby_players(spark, sf), "pred_mmr").where("is_suspect")
    return flagged.select(
        "replay_id", "slot", "player_name", num(F.col("pred_mmr")).alias("pred_mmr"),
        num(F.col("lobby_median")).alias("lobby_median"),
        ladder.division_label(ladder.band_index(F.col("pred_mmr"))).alias("division"),
        ladder.division_label(ladder.band_index(F.col("lobby_median"))).alias("lobby_division"))


@R.add("segment_mean", q.with_ctes("sp lp", f"""SELECT lp.replay_id, lp.slot, {q.r6('COALESCE(AVG(sp.pred_mmr), 1000)')} AS mean_mmr
  FROM lp LEFT JOIN sp ON sp.replay_id = lp.replay_id AND sp.slot = lp.slot AND sp.known_here GROUP BY lp.replay_id, lp.slot"""))
def segment_mean(spark, sf):
    """Segments flagged as returned carry no prediction, so some players get the default."""
    predictions = t.segment_scores(spark, sf).where("known_here")
    players = t.lobby_players(spark, sf).select("replay_id", "slot")
    return rounded(results.segment_means(predictions, players), "mean_mmr")


SEGMENT_MEDIANS = f"""SELECT replay_id, slot, MEDIAN(pred_mmr) AS median_mmr, COUNT(*) AS n FROM sp GROUP BY replay_id, slot"""


@R.add("segment_median", q.with_ctes("sp", f"""SELECT replay_id, slot, n, {q.r6('median_mmr')} AS median_mmr,
  {q.band('median_mmr')} AS division_idx FROM m""", m=SEGMENT_MEDIANS))
def segment_median(spark, sf):
    return rounded(results.segment_medians(t.segment_scores(spark, sf)), "median_mmr")


@R.add("team_average", q.with_ctes("sp", f"""SELECT replay_id, team, {q.r6('AVG(m)')} AS team_mmr FROM (
  SELECT replay_id, team, segment, AVG(pred_mmr) AS m FROM sp GROUP BY replay_id, team, segment) x GROUP BY replay_id, team"""))
def team_average(spark, sf):
    return rounded(results.team_averages(t.segment_scores(spark, sf)), "team_mmr")


@R.add("segment_result", q.with_ctes("sp", "SELECT replay_id, CAST(segment + 1 AS INT) AS segment_number, " + ", ".join(
    f"{q.r6(f'm{s}')} AS m{s}, {q.band(f'm{s}')} AS d{s}" for s in range(6)) + " FROM x", x="SELECT replay_id, segment, " + ", ".join(
    f"COALESCE(AVG(pred_mmr) FILTER (slot = {s}), 1000) AS m{s}" for s in range(6)) + " FROM sp GROUP BY replay_id, segment"))
def segment_result(spark, sf):
    return rounded(results.segment_rows(t.segment_scores(spark, sf)), *(f"m{s}" for s in range(6)))


@R.add("smurf_score", q.with_ctes("sp lp", f"""SELECT replay_id, player_name, {q.r6(f"m - {q.mid('division_idx')}")} AS smurf_score FROM (
  SELECT replay_id, player_name, AVG(pred_mmr) AS m FROM sp GROUP BY replay_id, player_name) x
  JOIN lp USING (replay_id, player_name) WHERE rank_known"""))
def smurf_score(spark, sf):
    labelled = t.lobby_players(spark, sf).where("rank_known").select("replay_id", "player_name", "division_idx")
    scored = results.smurf_scores(t.segment_scores(spark, sf), labelled)
    return scored.select("replay_id", "player_name", num(F.col("smurf_score")).alias("smurf_score"))


@R.add("prediction_results", q.with_ctes("sp lp", f"""SELECT r.replay_id, r.slot, player_name, team, n AS segments, {q.r6('median_mmr')} AS median_mmr,
  {q.division_label(q.band('median_mmr'))} AS division, median_mmr > lobby_median + 200 AS is_suspect FROM m r
  JOIN lp ON lp.replay_id = r.replay_id AND lp.slot = r.slot
  JOIN (SELECT replay_id, MEDIAN(median_mmr) AS lobby_median FROM m GROUP BY replay_id) l ON l.replay_id = r.replay_id""",
                                         m=SEGMENT_MEDIANS))
def prediction_results(spark, sf):
    rows = results.prediction_results(t.segment_scores(spark, sf), t.lobby_players(spark, sf))
    return rounded(rows, "median_mmr").select(
        "replay_id", "slot", "player_name", "team", "segments", "median_mmr", "division", "is_suspect")


# The texts by tier of the lobby median: bands 0-11, 12-23, ... and 84.
EVEN = """([['An even {tier} lobby, all of them still learning.', 'Nobody stood out: plain {tier}.'], ['An even {tier} lobby.', 'Six honest {tier} players.'],
   ['An even {tier} lobby, no hidden talent.', 'Everyone here is as {tier} as it says.'], ['A fair {tier} match.', 'Nobody rose above {tier} in this one.'],
   ['A fair {tier} match, close all the way.', 'Sharp, but {tier} throughout.'], ['A clean {tier} match.', 'All six belong in {tier}.'],
   ['A clean {tier} match, fast and fair.', 'High level, and {tier} on every seat.'],
   ['Nowhere left to hide: all {tier}.', 'The top of the ladder, {tier} for everyone.']])"""


@R.add("verdict_line", q.with_ctes("lp", f"""SELECT replay_id, CASE len(s) WHEN 0 THEN REPLACE({EVEN}[{q.band('lobby_median')} // 12 + 1][replay_id % 2 + 1], '{{tier}}',
   split_part({q.division_label(q.band('lobby_median'))}, ' Division ', 1))
  WHEN 1 THEN REPLACE(['{{name}} played well above this lobby.', 'Keep an eye on {{name}}: the numbers belong to a higher rank.',
   '{{name}} made this lobby look slow.'][replay_id % 3 + 1], '{{name}}', s[1])
  ELSE REPLACE(['{{names}} played well above this lobby.', 'Keep an eye on {{names}}: their numbers belong to a higher rank.'][replay_id % 2 + 1],
   '{{names}}', CASE len(s) WHEN 2 THEN s[1] || ' and ' || s[2]
   ELSE array_to_string(s[1:len(s)-1], ', ') || ', and ' || s[len(s)] END) END AS verdict FROM (
  SELECT lp.replay_id, MAX(lobby_median) AS lobby_median, COALESCE(LIST(player_name ORDER BY slot) FILTER (pred_mmr > lobby_median + 200), []) AS s
  FROM lp JOIN m ON m.replay_id = lp.replay_id GROUP BY lp.replay_id) x""", m=MEDIANS))
def verdict_line(spark, sf):
    return results.verdicts(t.lobby_players(spark, sf), "pred_mmr")


# --- evaluation ---------------------------------------------------------------------------------

RMSE = """SELECT true_rank AS rank_index, SQRT(AVG((pred_mmr - target_mmr)*(pred_mmr - target_mmr))) AS rmse, COUNT(*) AS n
  FROM known {} GROUP BY true_rank"""


@R.add("rank_rmse", q.with_ctes("known", f"SELECT rank_index, {q.r6('rmse')} AS rmse, n FROM r", r=RMSE.format("")))
def rank_rmse(spark, sf):
    return rounded(metrics.rank_rmse(t.lobby_players(spark, sf)), "rmse")


@R.add("rank_confusion_summary", q.with_ctes("known", f"""SELECT COALESCE(a.rank_index, b.pred_rank) AS rank_index,
  {q.r6('COALESCE(rmse, 0)')} AS rmse, COALESCE(n, 0) AS targets, COALESCE(predicted, 0) AS predicted, COALESCE(correct, 0) AS correct FROM a FULL JOIN (
  SELECT pred_rank, COUNT(*) AS predicted, COUNT(*) FILTER (pred_rank = true_rank) AS correct FROM known GROUP BY pred_rank) b
  ON a.rank_index = b.pred_rank""", a=RMSE.format("")))
def rank_confusion_summary(spark, sf):
    return rounded(metrics.rank_confusion(t.lobby_players(spark, sf)), "rmse")


@R.add("tail_guard", q.with_ctes("known", f"""SELECT {q.rank_name('a.rank_index')} AS rank, {q.r6('a.rmse')} AS rmse, {q.r6('b.rmse')} AS baseline_rmse,
  {q.r6('(a.rmse - b.rmse)/b.rmse')} AS rise, (a.rmse - b.rmse)/b.rmse > 0.25 AS alert FROM a JOIN b ON a.rank_index = b.rank_index
  WHERE b.rmse > 0 AND a.rank_index IN (1, 21, 22)""", a=RMSE.format("WHERE team = 1"), b=RMSE.format("WHERE team = 0")))
def tail_guard(spark, sf):
    """Blue's errors as the baseline of orange's."""
    players = t.lobby_players(spark, sf)
    guard = metrics.tail_guard(
        metrics.rank_rmse(players.where("team = 1")), metrics.rank_rmse(players.where("team = 0")))
    return rounded(guard, "rmse", "baseline_rmse", "rise")


def with_logits(players):
    """Ordinal logits that follow the prediction."""
    boundaries = ",".join(f"{b}D" for b in ladder.ORDINAL_BOUNDARIES)
    return players.withColumn("logits", F.expr(f"transform(array({boundaries}), b -> (pred_mmr - b) / 100D)"))


BOUNDS = q.text_list(f"{b}E0" for b in ladder.ORDINAL_BOUNDARIES).replace("'", "")


@R.add("ordinal_rank", q.with_ctes("lp", f"""SELECT replay_id, slot, CAST(LEAST(21, len(list_filter({BOUNDS}, lambda b: (pred_mmr - b)/100.0E0 > 0))) + 1 AS INT)
  AS rank_index FROM lp"""))
def ordinal_rank(spark, sf):
    return with_logits(t.lobby_players(spark, sf)).select(
        "replay_id", "slot", losses.ordinal_rank(F.col("logits")).alias("rank_index"))


@R.add("ordinal_targets", q.with_ctes("lp", f"""SELECT replay_id, slot, CAST(len(list_filter({BOUNDS}, lambda b: target_mmr > b)) AS INT) AS above,
  array_to_string(list_transform({BOUNDS}, lambda b: CASE WHEN target_mmr > b THEN '1' ELSE '0' END), '') AS flags FROM lp WHERE rank_known"""))
def ordinal_targets(spark, sf):
    flags = t.lobby_players(spark, sf).where("rank_known").select(
        "replay_id", "slot", losses.ordinal_targets(F.col("target_mmr")).alias("f"))
    return flags.select(
        "replay_id", "slot", F.size(F.filter("f", lambda x: x == 1)).alias("above"),
        F.array_join(F.transform("f", lambda x: x.cast("string")), "").alias("flags"))


LOBBY = "SELECT replay_id, ROW_NUMBER() OVER (ORDER BY replay_id) - 1 AS lobby FROM (SELECT DISTINCT replay_id FROM lp) x"


@R.add("validation_loss", q.with_ctes("lp", f"""SELECT {q.r6('AVG(mse)')} AS loss, COUNT(*) AS batches FROM (
  SELECT lobby // 32 AS batch, COALESCE(SUM((pred_mmr/2500.0E0 - target_mmr/2500.0E0)*(pred_mmr/2500.0E0 - target_mmr/2500.0E0)), 0)/GREATEST(COUNT(target_mmr), 1) AS mse
  FROM lp JOIN lob ON lob.replay_id = lp.replay_id GROUP BY lobby // 32) b""", lob=LOBBY))
def validation_loss(spark, sf):
    return rounded(metrics.validation_loss(t.lobby_players(spark, sf), 32), "loss")


@R.add("collapse_metrics", q.with_ctes("known", f"""SELECT COUNT(*) AS n, {q.r6('STDDEV_SAMP(pred_mmr)')} AS pred_std,
  {q.r6('CORR(pred_mmr, target_mmr)')} AS pearson_r, {q.r6('SQRT(VAR_POP(target_mmr))')} AS constant_rmse,
  {q.r6('SQRT(AVG((lm - target_mmr)*(lm - target_mmr)))')} AS lobby_mean_rmse, STDDEV_SAMP(pred_mmr) < 50 AS collapse_alert
  FROM known JOIN (SELECT replay_id, AVG(target_mmr) AS lm FROM known GROUP BY replay_id) l USING (replay_id)"""))
def collapse_metrics(spark, sf):
    return rounded(metrics.collapse_metrics(t.lobby_players(spark, sf)),
                   "pred_std", "pearson_r", "constant_rmse", "lobby_mean_rmse")


HIST = """SELECT rank_index, COUNT(true_rank) AS n FROM ranks LEFT JOIN known ON true_rank = rank_index GROUP BY rank_index"""
MEDIAN = "SELECT COALESCE(list_sort(LIST(n) FILTER (n > 0))[len(LIST(n) FILTER (n > 0)) // 2 + 1], 1) AS median FROM h"
FACTOR = """SELECT rank_index, n, CAST(CASE WHEN n = 0 THEN 0 ELSE GREATEST(1, LEAST(4, median // n)) END AS INT) AS factor FROM h CROSS JOIN md"""
WEIGHT = """SELECT rank_index, n, raw/AVG(raw) OVER () AS weight FROM (SELECT rank_index, n, CASE WHEN n = 0 THEN 1.0E0
  ELSE GREATEST(0.5E0, LEAST(5.0E0, MAX(n) OVER ()/n)) END AS raw FROM h) x"""


def histogram(spark, sf):
    """Known players by true rank."""
    rows = metrics.with_ranks(t.lobby_players(spark, sf))
    return metrics.rank_histogram(rows.withColumnRenamed("true_rank", "rank_index"))


@R.add("rank_histogram", q.with_ctes("ranks known", "SELECT * FROM h", h=HIST))
def rank_histogram(spark, sf):
    return histogram(spark, sf)


@R.add("upper_median", q.with_ctes("ranks known", "SELECT CAST(median AS BIGINT) AS median FROM md", h=HIST, md=MEDIAN))
def upper_median(spark, sf):
    return metrics.upper_median(histogram(spark, sf))


@R.add("oversample_factor", q.with_ctes("ranks known", "SELECT * FROM f", h=HIST, md=MEDIAN, f=FACTOR))
def oversample_factor(spark, sf):
    return metrics.oversample_factors(histogram(spark, sf))


@R.add("inverse_freq_weights", q.with_ctes("ranks known", f"SELECT rank_index, n, {q.r6('weight')} AS weight FROM w", h=HIST, w=WEIGHT))
def inverse_freq_weights(spark, sf):
    return rounded(metrics.inverse_frequency_weights(histogram(spark, sf)), "weight")


WEIGHTED = f"""SELECT lp.*, COALESCE(w.weight, 1.0E0) AS weight FROM lp LEFT JOIN w ON w.rank_index = {q.rank_of_rating('target_mmr')}"""


def weighted(spark, sf):
    return metrics.with_weights(
        t.lobby_players(spark, sf), metrics.inverse_frequency_weights(histogram(spark, sf)))


def losses_sql(body, **extra):
    return q.with_ctes("ranks known", body, h=HIST, w=WEIGHT, wl=WEIGHTED, **extra)


@R.add("weight_lookup", losses_sql(f"SELECT replay_id, slot, {q.r6('weight')} AS weight FROM wl"))
def weight_lookup(spark, sf):
    return weighted(spark, sf).select("replay_id", "slot", num(F.col("weight")).alias("weight"))


DIFF = "(pred_mmr/2500.0E0 - target_mmr/2500.0E0)"
HUBER = f"(0.5E0*POW(LEAST(ABS{DIFF}, 1), 2) + ABS{DIFF} - LEAST(ABS{DIFF}, 1))"
PIN = f"((0.1E0 + 0.25E0 + 0.75E0 + 0.9E0)/4*GREATEST(-{DIFF}, 0) + (0.9E0 + 0.75E0 + 0.25E0 + 0.1E0)/4*GREATEST({DIFF}, 0))"
PIN_TERM = f"({PIN}*(0.06E0 + CASE WHEN target_mmr > 1400 THEN 0.3E0 ELSE 0 END))"


@R.add("huber_metric", losses_sql(f"""SELECT {q.r6(f'SUM({HUBER})/GREATEST(COUNT(target_mmr), 1)')} AS huber,
  {q.r6(f'SUM({HUBER}*weight)/GREATEST(COUNT(target_mmr), 1)')} AS weighted_huber FROM wl"""))
def huber_metric(spark, sf):
    return rounded(metrics.huber_metric(weighted(spark, sf)), "huber", "weighted_huber")


@R.add("pinball_metric", q.with_ctes("lp", f"""SELECT {q.r6(f'SUM({PIN})/GREATEST(COUNT(target_mmr), 1)')} AS pinball,
  {q.r6(f'SUM({PIN_TERM})/GREATEST(COUNT(target_mmr), 1)')} AS pinball_term FROM lp"""))
def pinball_metric(spark, sf):
    return rounded(metrics.pinball_metric(t.lobby_players(spark, sf)), "pinball", "pinball_term")


HINGES = """SELECT i.replay_id, COUNT(j.slot) AS pairs, COALESCE(SUM(GREATEST(0, 0.02E0 - (i.pred_mmr/2500.0E0 - j.pred_mmr/2500.0E0))
   * CASE WHEN j.slot IS NULL THEN NULL ELSE 1 END), 0.0E0) AS hinge_sum
  FROM known i LEFT JOIN known j ON j.replay_id = i.replay_id AND i.target_mmr - j.target_mmr > 25 GROUP BY i.replay_id"""


@R.add("pairwise_hinge", q.with_ctes("known", f"SELECT replay_id, pairs, {q.r6('hinge_sum')} AS hinge_sum FROM hg", hg=HINGES))
def pairwise_hinge(spark, sf):
    return rounded(metrics.lobby_hinges(t.lobby_players(spark, sf)), "hinge_sum")


SPREAD = """SELECT POW(GREATEST(0, SQRT(GREATEST(VAR_POP(target_mmr/2500.0E0), 1E-5)) - SQRT(GREATEST(VAR_POP(pred_mmr/2500.0E0), 1E-5))), 2) AS spread FROM known"""


@R.add("spread_penalty", q.with_ctes("known", f"SELECT {q.r6('spread*1000')} AS spread FROM s", s=SPREAD))
def spread_penalty(spark, sf):
    return metrics.spread_loss(t.lobby_players(spark, sf)).select(num(F.col("spread") * 1000).alias("spread"))


BCE = f"""SELECT AVG(b)/21 AS ordinal FROM (SELECT list_sum(list_transform({BOUNDS}, lambda b: CASE WHEN target_mmr > b
   THEN LN(1 + EXP(-GREATEST(-40, LEAST(40, (pred_mmr - b)/100.0E0)))) ELSE LN(1 + EXP(GREATEST(-40, LEAST(40, (pred_mmr - b)/100.0E0)))) END)) AS b FROM known) x"""
PAIRWISE = "SELECT SUM(hinge_sum)/GREATEST(SUM(pairs), 1) AS pairwise FROM hg"
REGRESSION = f"SELECT SUM(({HUBER} + {PIN_TERM})*weight)/GREATEST(COUNT(target_mmr), 1) AS regression FROM wl"


@R.add("composite_loss", losses_sql(f"""SELECT {q.r6('regression')} AS regression, {q.r6('ordinal')} AS ordinal, {q.r6('pairwise')} AS pairwise,
  {q.r6('spread')} AS spread, {q.r6('regression + 0.2E0*ordinal + 0.1E0*pairwise + 0.2E0*spread')} AS total FROM rg, oc, pw, s""",
                                    rg=REGRESSION, oc=BCE, hg=HINGES, pw=PAIRWISE, s=SPREAD))
def composite_loss(spark, sf):
    return rounded(metrics.composite_loss(with_logits(weighted(spark, sf))),
                   "regression", "ordinal", "pairwise", "spread", "total")


@R.add("boosted_mse", q.with_ctes("known", f"""SELECT {q.r6('SUM(e*CASE WHEN mt > 1000 THEN 3.0E0 ELSE 1.0E0 END)/COUNT(*)')} AS boosted_mse FROM (
  SELECT {DIFF}*{DIFF} AS e, AVG(target_mmr) OVER (PARTITION BY replay_id) AS mt FROM known) x"""))
def boosted_mse(spark, sf):
    return rounded(metrics.boosted_mse(t.lobby_players(spark, sf), 1000.0, 3.0), "boosted_mse")


@R.add("metrics_json", q.with_ctes("known", f"""SELECT 10 AS sequence_length, {q.rank_name('rank_index')} AS rank, {q.r6('rmse')} AS rmse_mmr, n AS sample_count,
  {q.r6('loss')} AS loss, {q.r6('SQRT(loss)*2500.0E0')} AS approx_rmse FROM r CROSS JOIN (
  SELECT AVG({DIFF}*{DIFF}) AS loss FROM known) l WHERE rank_index > 0""", r=RMSE.format("")))
def metrics_json(spark, sf):
    """Write the document, then read its figures back."""
    players = t.lobby_players(spark, sf)
    config = spark.createDataFrame([('{"sequence_length": 10, "validation_loss": 9.5}',)], "config string")
    loss = metrics.validation_loss(players, 1 << 40).select("loss")
    documents = metrics.metrics_document(config, loss, metrics.rank_rmse(players))
    schema = ("sequence_length int, validation_loss double, validation_approx_rmse_mmr double, "
              "validation_rmse_by_rank array<struct<rank:string,rmse_mmr:double,sample_count:bigint>>")
    d = documents.select(F.from_json("document", schema).alias("d")).select("d.*")
    return d.select("*", F.explode("validation_rmse_by_rank").alias("e")).select(
        "sequence_length", "e.rank", num(F.col("e.rmse_mmr")).alias("rmse_mmr"), "e.sample_count",
        num(F.col("validation_loss")).alias("loss"), num(F.col("validation_approx_rmse_mmr")).alias("approx_rmse"))


# --- samples and splits -------------------------------------------------------------------------------

@R.add("pending_topk", q.with_ctes("rp", """SELECT id, rank FROM rp WHERE download_status = 'not_downloaded' ORDER BY created_at, id LIMIT 100"""))
def pending_topk(spark, sf):
    return sampling.oldest_pending(t.replays(spark, sf), 100).select("id", "rank")


@R.add("stratified_sample", q.with_ctes("rp", """SELECT id, rank_index FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rank_index ORDER BY id) AS n
  FROM rp WHERE rank_index > 0 AND download_status = 'downloaded') x WHERE n <= 46 ORDER BY id LIMIT 1000"""))
def stratified_sample(spark, sf):
    return sampling.stratified_sample(t.replays(spark, sf), 1000).select("id", "rank_index")


SEGMENTS = f"""SELECT replay_id, division_idx, slot, replay_id*6 + slot AS segment_id, {q.rank_of('division_idx')} AS rank_index FROM lp"""


def segments(spark, sf):
    return t.lobby_players(spark, sf).select(
        "replay_id", "slot", (F.col("replay_id") * 6 + F.col("slot")).alias("segment_id"), "pred_mmr",
        (F.col("replay_id") % 22 + 1).cast("int").alias("replay_rank"),
        ladder.division_rank(F.col("division_idx")).alias("rank_index"))


@R.add("balanced_k", q.with_ctes("lp", """SELECT segment_id, rank_index FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rank_index
  ORDER BY segment_id) AS n FROM sg) x WHERE n <= 50""", sg=SEGMENTS))
def balanced_k(spark, sf):
    return sampling.first_k(segments(spark, sf), ["rank_index"], ["segment_id"], 50).select("segment_id", "rank_index")


@R.add("first_replays_per_rank", q.with_ctes("rp", """SELECT id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rank
  ORDER BY created_at, id) AS n FROM rp WHERE download_status = 'downloaded') x WHERE n <= 20"""))
def first_replays_per_rank(spark, sf):
    ready = catalog.select_replays(t.replays(spark, sf), status="downloaded")
    return sampling.first_k(ready, ["rank"], ["created_at", "id"], 20).select("id", "rank")


BY_REPLAY = "SELECT replay_id, segment_id, CAST(replay_id % 22 + 1 AS INT) AS rank_index FROM sg"


def by_replay(spark, sf):
    return segments(spark, sf).select("replay_id", "segment_id", F.col("replay_rank").alias("rank_index"))


@R.add("longest_group", q.with_ctes("lp", """SELECT rank_index, replay_id, n FROM (SELECT rank_index, replay_id, COUNT(*) AS n,
  ROW_NUMBER() OVER (PARTITION BY rank_index ORDER BY COUNT(*) DESC, replay_id) AS i FROM br GROUP BY rank_index, replay_id) x WHERE i = 1""",
                                    sg=SEGMENTS, br=BY_REPLAY))
def longest_group(spark, sf):
    return sampling.longest_groups(by_replay(spark, sf))


LONGEST = """SELECT rank_index, replay_id FROM (SELECT rank_index, replay_id,
  ROW_NUMBER() OVER (PARTITION BY rank_index ORDER BY COUNT(*) DESC, replay_id) AS i FROM br GROUP BY rank_index, replay_id) x
  WHERE i = 1 AND rank_index IN (1, 22)"""


@R.add("sample_union", q.with_ctes("lp", """SELECT b.replay_id, b.segment_id, b.rank_index FROM br b JOIN lg USING (rank_index, replay_id)""",
                                   sg=SEGMENTS, br=BY_REPLAY, lg=LONGEST))
def sample_union(spark, sf):
    """All segments of the longest replay of the lowest and of the highest rank."""
    rows = by_replay(spark, sf)
    picks = sampling.longest_groups(rows)
    low, high = (
        rows.join(picks.where(F.col("rank_index") == r), ["rank_index", "replay_id"], "left_semi") for r in (1, 22))
    return low.unionByName(high).select("replay_id", "segment_id", "rank_index")


@R.add("capped_sample", q.with_ctes("lp", """SELECT segment_id, rank_index FROM (SELECT b.*, ROW_NUMBER() OVER (PARTITION BY b.replay_id ORDER BY segment_id) AS i
  FROM br b JOIN (SELECT replay_id, SUM(take) OVER (PARTITION BY rank_index ORDER BY replay_id) - take AS before FROM (
   SELECT rank_index, replay_id, LEAST(COUNT(*), 3) AS take FROM br GROUP BY rank_index, replay_id) c) d USING (replay_id) WHERE before < 15) x WHERE i <= 3""",
                                    sg=SEGMENTS, br=BY_REPLAY))
def capped_sample(spark, sf):
    return sampling.capped_sample(by_replay(spark, sf), ["segment_id"]).select("segment_id", "rank_index")


@R.add("hash_shuffle", q.with_ctes("rp", "SELECT id, ROW_NUMBER() OVER (ORDER BY md5('7-' || id), id) - 1 AS position FROM rp"))
def hash_shuffle(spark, sf):
    return sampling.shuffled(t.replays(spark, sf).select("id"), "id", 7)


@R.add("oversample", q.with_ctes("ranks lp known", """SELECT segment_id, rank_index, CAST(copy AS INT) AS copy,
  ROW_NUMBER() OVER (ORDER BY md5('5-' || segment_id || '/' || copy), segment_id || '/' || copy) - 1 AS position FROM (
  SELECT segment_id, rank_index, UNNEST(range(1, factor + 1)) AS copy FROM sg JOIN f USING (rank_index)) x""",
                                 h=HIST, md=MEDIAN, f=FACTOR, sg=SEGMENTS))
def oversample(spark, sf):
    factors = metrics.oversample_factors(histogram(spark, sf))
    rows = segments(spark, sf).select("segment_id", "rank_index")
    return sampling.oversample(rows, factors, "segment_id", 5).select("segment_id", "rank_index", "copy", "position")


@R.add("sticky_split", q.with_ctes("rp", """SELECT rp.id, COALESCE(dataset_split, CASE WHEN p IS NULL THEN NULL WHEN p < ROUND(total*0.9E0) THEN 'training'
  ELSE 'evaluation' END) AS dataset_split FROM rp LEFT JOIN (SELECT id, ROW_NUMBER() OVER (ORDER BY md5('11-' || id), id) - 1 AS p,
  COUNT(*) OVER () AS total FROM rp WHERE dataset_split IS NULL AND download_status = 'downloaded') o ON o.id = rp.id"""))
def sticky_split(spark, sf):
    return sampling.sticky_split(t.replays(spark, sf), 0.9, 11).select("id", "dataset_split")


@R.add("tail_split", q.with_ctes("lp", """SELECT replay_id, slot, ROW_NUMBER() OVER (ORDER BY segment_id) - 1
  >= COUNT(*) OVER () - GREATEST(1, FLOOR(COUNT(*) OVER ()*0.2E0)) AS is_validation FROM sg""", sg=SEGMENTS))
def tail_split(spark, sf):
    return sampling.tail_split(segments(spark, sf), "segment_id", 0.2).select("replay_id", "slot", "is_validation")


MIXED_RANKS = [1, 4, 7, 10, 13, 22]
MIXED = """SELECT d.lobby, d.rank_index, segment_id, pred_mmr, canonical_mmr FROM (SELECT CAST(l AS BIGINT) AS lobby, rank_index,
   (l*48271 + rank_index*16807 + 42) % size AS o FROM range(2000) g(l) CROSS JOIN (SELECT rank_index, COUNT(*) AS size FROM sg
    WHERE rank_index IN (1, 4, 7, 10, 13, 22) GROUP BY rank_index) c) d
  JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY rank_index ORDER BY segment_id) - 1 AS o FROM sg JOIN lp USING (replay_id, slot)) s
  ON s.rank_index = d.rank_index AND s.o = d.o JOIN ranks r ON r.rank_index = d.rank_index"""


def mixed(spark, sf):
    rows = segments(spark, sf).select("segment_id", "rank_index", "pred_mmr")
    pick = F.col("lobby") * 48271 + F.col("rank_index") * 16807 + 42
    return sampling.mixed_lobbies(rows, "segment_id", MIXED_RANKS, 2000, pick)


@R.add("mixed_lobby", q.with_ctes("ranks lp", "SELECT lobby, rank_index, segment_id, canonical_mmr FROM mx", sg=SEGMENTS, mx=MIXED))
def mixed_lobby(spark, sf):
    return mixed(spark, sf).select("lobby", "rank_index", "segment_id", "canonical_mmr")


@R.add("mixed_lobby_rmse", q.with_ctes("ranks lp", f"""SELECT rank_index, {q.r6('rmse')} AS rmse, n, CASE WHEN rank_index = 22 THEN rmse < 400 END AS passed FROM (
  SELECT rank_index, SQRT(AVG((pred_mmr - canonical_mmr)*(pred_mmr - canonical_mmr))) AS rmse, COUNT(*) AS n FROM mx GROUP BY rank_index) x""",
                                       sg=SEGMENTS, mx=MIXED))
def mixed_lobby_rmse(spark, sf):
    return rounded(metrics.slot_rmse(mixed(spark, sf)), "rmse")


TWO64 = "18446744073709551616::UHUGEINT"


def _u(x: str) -> str:
    return f"CAST({x} AS UHUGEINT)"


def _mix(x: str, shift: int, factor: int) -> str:
    return f"((xor({x}, {x} >> {shift}) * {factor}::UHUGEINT) % {TWO64})"


@R.add("hash_coin", f"""SELECT id, CAST(u AS DOUBLE) AS u, u < 0.2::FLOAT AS dropped FROM (SELECT id, CAST((xor(c, c >> 33) >> 11) AS FLOAT)/9007199254740992::FLOAT AS u FROM (
  SELECT id, {_mix('b', 33, 0xFF51AFD7ED558CCD)} AS c FROM (SELECT id, (a + (k * 1442695040888963407::UHUGEINT + 1::UHUGEINT)) % {TWO64} AS b FROM (
  SELECT o_orderkey AS id, ({_u('o_custkey')} * 6364136223846793005::UHUGEINT) % {TWO64} AS a, {_u('o_orderkey')} AS k FROM orders) x) y) z) w""")
def hash_coin(spark, sf):
    unit = sampling.hash_uniform(F.col("o_custkey"), F.col("o_orderkey"))
    rows = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), unit.alias("u"))
    return rows.select("id", F.col("u").cast("double").alias("u"), (F.col("u") < F.lit(0.2).cast("float")).alias("dropped"))


def _unit_sql(x: str, source: str) -> str:
    """Steps of the mixer as nested selects, keeping all other columns."""
    steps = f"SELECT *, ({x} + {0x9E3779B97F4A7C15}::UHUGEINT) % {TWO64} AS z0 FROM {source}"
    steps = f"SELECT * EXCLUDE (z0), {_mix('z0', 30, 0xBF58476D1CE4E5B9)} AS z1 FROM ({steps})"
    steps = f"SELECT * EXCLUDE (z1), {_mix('z1', 27, 0x94D049BB133111EB)} AS z2 FROM ({steps})"
    return f"""SELECT * EXCLUDE (z2), GREATEST(1E-12, LEAST(1 - 1E-12, CAST(xor(z2, z2 >> 31) >> 11 AS DOUBLE)/9007199254740992.0E0)) AS u FROM ({steps})"""


NOISE = {
    "cells": f"""SELECT replay_id, slot, target_mmr, (3::UHUGEINT*{0xD6E8FEB86659FD93}::UHUGEINT + {_u('lobby // 32')}*{0x9E3779B97F4A7C15}::UHUGEINT
   + {_u('lobby % 32')}*{0xC2B2AE3D27D4EB4F}::UHUGEINT + {_u('slot')}*{0x165667B19E3779F9}::UHUGEINT) % {TWO64} AS key
   FROM lp JOIN lob USING (replay_id)""",
    "first_": _unit_sql("key", "cells"),
    "second_": _unit_sql("xor(key, %d::UHUGEINT)" % 0x123456789ABCDEF0, "cells"),
    "noise": """SELECT a.replay_id, a.slot, a.target_mmr, 40*SQRT(-2*LN(a.u))*COS(2*PI()*b.u) AS z FROM first_ a JOIN second_ b USING (replay_id, slot)""",
}


@R.add("label_jitter", q.with_ctes("lp", f"""SELECT n.replay_id, slot, {q.r6('CASE WHEN target_mmr > 0 THEN z - m ELSE 0 END')} AS jitter FROM noise n
  JOIN (SELECT replay_id, AVG(z) FILTER (target_mmr > 0) AS m FROM noise GROUP BY replay_id) g USING (replay_id)""", lob=LOBBY, **NOISE))
def label_jitter(spark, sf):
    players = t.lobby_players(spark, sf)
    placed = players.join(metrics.lobby_index(players), "replay_id").withColumn(
        "batch", F.floor(F.col("lobby") / 32)).withColumn("row", F.col("lobby") % 32)
    return sampling.label_jitter(placed, 3, "batch", "row").select(
        "replay_id", "slot", num(F.col("jitter")).alias("jitter"))


# --- ridge probe on embeddings ------------------------------------------------------------------------

LAMBDA = 0.5
DIMS = 64
BIAS = DIMS
N = DIMS + 1
X_SQL = f"""SELECT vec_id, list_append(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), 1.0E0) AS x,
  CAST(label AS DOUBLE) AS y FROM embeddings"""
XS = [f"x{i}" for i in range(N)]
# All cells of the normal equations as rows (i, j, value); column N is the right-hand side.
CELLS = f"""SELECT i, j, SUM(x[i + 1]*CASE WHEN j = {N} THEN y ELSE x[j + 1] END) + CASE WHEN i = j THEN 0.5E0 ELSE 0 END AS value
  FROM {{source}}, range({N}) a(i), range({N + 1}) b(j) GROUP BY i, j"""


def design(spark, sf):
    return t.table(spark, sf, "embeddings").selectExpr(
        "vec_id", *(f"cast(embedding[{i}] AS double) AS x{i}" for i in range(DIMS)), f"1.0D AS x{BIAS}",
        "cast(label AS double) AS y")


@R.add("ridge_normal_equations", f"""WITH d AS ({X_SQL}), c AS ({CELLS.format(source='d')})
  SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, {q.r6('value')} AS value FROM c""")
def ridge_normal_equations(spark, sf):
    system = probe.normal_equations(design(spark, sf), [F.col(x) for x in XS], F.col("y"), LAMBDA)
    cells = F.concat(
        F.transform("xtx", lambda v, k: F.struct(F.floor(k / N).cast("int").alias("i"), (k % N).alias("j"), v.alias("v"))),
        F.transform("xty", lambda v, k: F.struct(k.alias("i"), F.lit(N).alias("j"), v.alias("v"))))
    return system.select(F.explode(cells).alias("c")).select("c.i", "c.j", num(F.col("c.v")).alias("value"))


def _eliminate(source: str) -> str:
    """Gauss-Jordan on the system, one pivot per level (the matrix is positive definite)."""
    return f"""WITH RECURSIVE d AS ({X_SQL}), train AS ({source}),
  cells AS ({CELLS.format(source='train')}),
  sys AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(value ORDER BY j) AS r FROM cells GROUP BY i) x),
  g AS (SELECT 1 AS k, m FROM sys UNION ALL SELECT k + 1, list_transform(range(1, {N + 1}), lambda r: CASE WHEN r = k
    THEN list_transform(m[k], lambda v: v/m[k][k])
    ELSE list_transform(range(1, {N + 2}), lambda c: m[r][c] - m[r][k]/m[k][k]*m[k][c]) END) FROM g WHERE k <= {N}),
  sol AS (SELECT list_transform(m, lambda r: r[{N + 1}]) AS w FROM g WHERE k = {N + 1})"""


@R.add("ridge_weights", _eliminate("SELECT * FROM d") + f" SELECT CAST(i AS INT) AS i, {q.r6('w[i + 1]')} AS weight FROM sol, range(65) r(i)")
def ridge_weights(spark, sf):
    fitted = probe.ridge_fit(design(spark, sf), [F.col(x) for x in XS], F.col("y"), LAMBDA)
    return fitted.select(F.posexplode("weights").alias("i", "w")).select("i", num(F.col("w")).alias("weight"))


@R.add("ridge_eval", _eliminate("SELECT * FROM d WHERE vec_id < (SELECT COUNT(*) - GREATEST(1, FLOOR(COUNT(*)*0.2E0)) FROM d)") + f""",
  v AS (SELECT y, list_dot_product(w, x) AS p, (SELECT AVG(y) FROM train) AS mu FROM d, sol
   WHERE vec_id >= (SELECT COUNT(*) - GREATEST(1, FLOOR(COUNT(*)*0.2E0)) FROM d)),
  s AS (SELECT SQRT(AVG((p - y)*(p - y))) AS rmse, SQRT(AVG((mu - y)*(mu - y))) AS cr, CORR(p, y) AS r FROM v)
  SELECT {q.r6('rmse')} AS rmse, {q.r6('cr')} AS constant_rmse, {q.r6('r')} AS pearson_r, {q.r6('100*(1 - rmse/cr)')} AS gain_pct,
  rmse < 0.95E0*cr AS carries_signal FROM s""")
def ridge_eval(spark, sf):
    rows = sampling.tail_split(design(spark, sf), "vec_id", 0.2)
    train, held = rows.where("NOT is_validation"), rows.where("is_validation")
    xs = [F.col(x) for x in XS]
    scored = probe.ridge_score(held, probe.ridge_fit(train, xs, F.col("y"), LAMBDA), xs)
    scored = scored.withColumn("train_mean", train.agg(F.avg("y")).scalar())
    measured = probe.verdict(scored, "pred", "y", F.col("train_mean"))
    return rounded(measured, "rmse", "constant_rmse", "pearson_r", "gain_pct")
