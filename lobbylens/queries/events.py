"""Checked queries: actor logs, loss series and status over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lobbylens.operators import actors, series
from lobbylens.operators import telemetry as tel
from lobbylens.queries import sqltext as q
from lobbylens.queries.registry import Registry, num
from lobbylens.sources import tables as t

R = Registry()
KIND = "CASE event_type WHEN 'signup' THEN 'new' WHEN 'error' THEN 'delete' ELSE 'update' END"


@R.add("rising_edge", q.with_ctes("ef", """SELECT game_id, frame_idx FROM (SELECT *, COALESCE(LAG(value < 20) OVER
  (PARTITION BY game_id ORDER BY frame_idx), FALSE) AS was FROM ef) x WHERE frame_idx = 0 OR (value < 20 AND NOT was)"""))
def rising_edge(spark, sf):
    return tel.rising_edges(t.event_frames(spark, sf), F.col("value") < 20).select("game_id", "frame_idx")


def actor_log(spark, sf):
    return t.event_frames(spark, sf).withColumn("kind", F.expr(KIND))


LIVES = f"""SELECT *, SUM(CASE WHEN kind = 'new' THEN 1 ELSE 0 END) OVER w AS lifetime,
  MAX(CASE WHEN kind = 'new' THEN frame_idx END) OVER w AS born, MAX(CASE WHEN kind = 'delete' THEN frame_idx END) OVER w AS died,
  MAX(CASE WHEN kind = 'update' THEN frame_idx END) OVER w AS seen
  FROM (SELECT *, {KIND} AS kind FROM ef) k WINDOW w AS (PARTITION BY game_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)"""


@R.add("lifetime_sessions", q.with_ctes("ef", """SELECT game_id, CAST(lifetime AS BIGINT) AS lifetime, COUNT(*) AS n_frames,
  MIN(frame_idx) AS first_frame, MAX(frame_idx) AS last_frame FROM l WHERE born IS NOT NULL AND COALESCE(died, -1) < born
  GROUP BY game_id, lifetime""", l=LIVES))
def lifetime_sessions(spark, sf):
    alive = actors.lifetimes(actor_log(spark, sf), ["game_id"], "frame_idx").where("is_alive")
    return alive.groupBy("game_id", F.col("lifetime").cast("bigint").alias("lifetime")).agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("frame_idx").alias("first_frame"),
        F.max("frame_idx").alias("last_frame"))


@R.add("locf", q.with_ctes("ef", """SELECT l.game_id, l.frame_idx, CASE WHEN l.seen > l.born THEN e.value ELSE 0.0E0 END AS state FROM l
  LEFT JOIN ef e ON e.game_id = l.game_id AND e.frame_idx = l.seen WHERE born IS NOT NULL AND COALESCE(died, -1) < born""", l=LIVES))
def locf(spark, sf):
    return actors.carry_forward(actor_log(spark, sf), ["game_id"], "frame_idx", "value", 0.0).select(
        "game_id", "frame_idx", "state")


@R.add("coalesce_chain", q.with_ctes("ef", """SELECT game_id, frame_idx, CAST(COALESCE(
  LAST_VALUE(team IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING),
  CASE game_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END, CASE WHEN value - 20 > 0 THEN 1 ELSE 0 END) AS INT) AS resolved_team
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 END AS team FROM ef) x"""))
def coalesce_chain(spark, sf):
    log = t.event_frames(spark, sf).withColumn(
        "team", F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 END")).withColumn(
        "header_team", F.expr("CASE game_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END"))
    return actors.resolve_team(log, ["game_id"], "frame_idx", "team", "header_team", F.col("value") - 20).select(
        "game_id", "frame_idx", "resolved_team")


EMA = """SELECT a.game_id, a.frame_idx, SUM(0.3E0*POW(0.7E0, a.frame_idx - b.frame_idx)*b.value) AS ema FROM ef a
  JOIN ef b ON b.game_id = a.game_id AND b.frame_idx <= a.frame_idx GROUP BY a.game_id, a.frame_idx"""


@R.add("ema", q.with_ctes("ef", f"SELECT game_id, frame_idx, {q.r6('ema')} AS ema FROM e", e=EMA))
def ema(spark, sf):
    rows = t.event_frames(spark, sf).select("game_id", "frame_idx", "value")
    return series.moving_average(rows, ["game_id"], "frame_idx", "value").select(
        "game_id", "frame_idx", num(F.col("ema")).alias("ema"))


@R.add("sustained_outlier", q.with_ctes("ef", """SELECT game_id, frame_idx, is_high, CAST(streak AS INT) AS streak,
  MAX(CASE WHEN streak >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY game_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) = 1 AS is_masked
  FROM (SELECT *, frame_idx - COALESCE(MAX(CASE WHEN NOT is_high THEN frame_idx END) OVER (PARTITION BY game_id ORDER BY frame_idx
   ROWS UNBOUNDED PRECEDING), -1) AS streak FROM (SELECT m.*, ema >= threshold AS is_high FROM m JOIN (
   SELECT frame_idx, MAX(CASE WHEN i = CAST(FLOOR(n*0.9E0) AS BIGINT) THEN ema END) AS threshold FROM (
    SELECT frame_idx, ema, ROW_NUMBER() OVER (PARTITION BY frame_idx ORDER BY ema) - 1 AS i, COUNT(*) OVER (PARTITION BY frame_idx) AS n FROM m) s
   GROUP BY frame_idx) c ON c.frame_idx = m.frame_idx) x) y""", e=EMA, m=f"SELECT game_id, frame_idx, {q.r6('ema')} AS ema FROM e"))
def sustained_outlier(spark, sf):
    masked = series.mask_outliers(ema(spark, sf), ["game_id"], "frame_idx", "ema", fraction=0.9)
    return masked.select(
        "game_id", "frame_idx", "is_high", "streak", "is_masked")


@R.add("best_so_far", q.with_ctes("ef", """SELECT game_id, frame_idx, best, was IS NULL OR value < was AS improved,
  CAST(frame_idx - MAX(CASE WHEN was IS NULL OR value < was THEN frame_idx END) OVER (PARTITION BY game_id ORDER BY frame_idx
   ROWS UNBOUNDED PRECEDING) AS INT) AS epochs_since FROM (SELECT *,
   MIN(value) OVER (PARTITION BY game_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS best,
   MIN(value) OVER (PARTITION BY game_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM ef) x"""))
def best_so_far(spark, sf):
    rows = t.event_frames(spark, sf).select("game_id", "frame_idx", "value")
    return series.best_so_far(rows, ["game_id"], "frame_idx", "value").drop("value")


# --- actor links -----------------------------------------------------------------------------------

LINKS = """SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem"""
RECORDS = "SELECT 's' || s_suppkey AS id FROM supplier WHERE s_nationkey < 3"


# Each step repeats all settled nodes and adds those the last ones lead to, until there are none.
@R.add("link_resolve", f"""WITH RECURSIVE links AS ({LINKS}), records AS ({RECORDS}),
  d1 AS (SELECT dst AS node, 2 AS distance, MIN(rec) AS record FROM links JOIN (SELECT src, MIN(dst) AS rec FROM links
   WHERE dst IN (SELECT id FROM records) GROUP BY src) r USING (src) WHERE dst NOT IN (SELECT id FROM records) GROUP BY dst),
  b AS (SELECT 1 AS step, TRUE AS fresh, node, distance, record FROM d1 UNION ALL (
   WITH nxt AS (SELECT dst AS node, MAX(d) + 2 AS distance, MIN(rec) AS record, MAX(step) AS step FROM links JOIN (
     SELECT src, MIN(record) AS rec, MAX(distance) AS d, MAX(step) AS step FROM links JOIN b ON b.node = links.dst AND b.fresh GROUP BY src) r
     USING (src) WHERE dst NOT IN (SELECT id FROM records) AND dst NOT IN (SELECT node FROM b) GROUP BY dst)
   SELECT step + 1, TRUE, node, distance, record FROM nxt
   UNION ALL SELECT step + 1, FALSE, node, distance, record FROM b WHERE EXISTS (SELECT 1 FROM nxt)))
  SELECT c.car, CAST(x.distance AS INT) AS distance, x.record FROM (SELECT 'p' || p_partkey AS car FROM part) c
  LEFT JOIN (SELECT * FROM b WHERE step = (SELECT MAX(step) FROM b)) x ON x.node = c.car""")
def link_resolve(spark, sf):
    """Parts as cars, orders as components, some suppliers as player records."""
    line = t.table(spark, sf, "lineitem")
    source = F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src")
    links = line.select(source, F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).union(
        line.select(source, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))))
    cars = t.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    records = t.table(spark, sf, "supplier").where("s_nationkey < 3").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return actors.resolve_links(links, cars, records)
