"""Checked queries: scans, catalogue, joins on the catalogue, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lobbylens.functions import labels, ladder
from lobbylens.operators import catalog, labelling, results, telemetry
from lobbylens.plans import segments
from lobbylens.queries import sqltext as q
from lobbylens.queries.registry import OFF_TIE, Registry, num
from lobbylens.session import run_folder
from lobbylens.sources import blocks, bundle, inventory
from lobbylens.sources import tables as t

R = Registry()


# --- scans and documents -------------------------------------------------------------

@R.add("jsonl_scan", q.with_ctes("", """SELECT event_id,
  CASE WHEN event_id % 37 = 0 THEN NULL ELSE CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) END AS k,
  event_id % 37 = 0 AS is_bad FROM events WHERE event_id % 41 <> 0"""))
def jsonl_scan(spark, sf):
    """Lines as a bundle would hold them: some blank, some cut off."""
    e = F.col("event_id")
    line = F.when(e % 41 == 0, F.lit("  ")).when(e % 37 == 0, F.substr("props", F.lit(1), F.lit(4))).otherwise(
        F.col("props"))
    lines = t.table(spark, sf, "events").select("event_id", line.alias("line"))
    return bundle.parse_lines(lines, "line", "k bigint").select("event_id", "doc.k", "is_bad")


SUMMARY_SQL = f"""SELECT l.replay_id,
  CAST(COUNT(*) FILTER (team = 0) AS BIGINT) AS n_blue, CAST(COUNT(*) FILTER (team = 1) AS BIGINT) AS n_orange,
  CAST(COUNT(*) FILTER (rank_known) AS BIGINT) AS n_ranked,
  MAX(CASE WHEN l.replay_id % 5 <> 0 THEN {q.rank_of('low')} END) AS min_tier,
  MAX(CASE WHEN l.replay_id % 5 <> 0 THEN {q.division_label('high')} END) AS max_name
  FROM lp l JOIN bounds b ON l.replay_id = b.replay_id GROUP BY l.replay_id"""


def summaries(spark, sf):
    return t.replay_summaries(spark, sf).select("replay_id", bundle.parse_summary(schema=bundle.LABELS).alias("doc"))


@R.add("json_struct_parse", q.with_ctes("lp bounds", SUMMARY_SQL))
def json_struct_parse(spark, sf):
    players = labelling.all_players(F.col("doc"))
    return summaries(spark, sf).select(
        "replay_id",
        F.size(F.filter(players, lambda p: p["team"] == 0)).cast("bigint").alias("n_blue"),
        F.size(F.filter(players, lambda p: p["team"] == 1)).cast("bigint").alias("n_orange"),
        F.size(F.filter(players, lambda p: p["rank"].isNotNull())).cast("bigint").alias("n_ranked"),
        F.col("doc.min_rank.tier").alias("min_tier"),
        F.col("doc.max_rank.name").alias("max_name"),
    )


@R.add("json_explode", q.with_ctes("lp", "SELECT replay_id, team, player_name, rank_known FROM lp"))
def json_explode(spark, sf):
    return labelling.player_rows(summaries(spark, sf)).select(
        "replay_id", "team", "player_name", F.col("known_division").isNotNull().alias("rank_known"))


@R.add("team_union", q.with_ctes("lp", """SELECT replay_id, CAST(COUNT(*) AS INT) AS n_players,
  string_agg(player_name, '|' ORDER BY team, player_name) AS names FROM lp GROUP BY replay_id"""))
def team_union(spark, sf):
    players = labelling.all_players(F.col("doc"))
    ordered = F.transform(F.array_sort(F.transform(players, lambda p: F.struct(p["team"], p["name"]))),
                          lambda p: p["name"])
    return summaries(spark, sf).select(
        "replay_id", F.size(players).alias("n_players"), F.array_join(ordered, "|").alias("names"))


@R.add("json_not_exists", q.with_ctes("lp", "SELECT replay_id, player_name FROM lp WHERE NOT rank_known"))
def json_not_exists(spark, sf):
    return labelling.without_known_rank(t.lobby_players(spark, sf), summaries(spark, sf)).select(
        "replay_id", "player_name")


# Replay files of the catalogue, files it does not know, and paths of another form.
LISTED = """SELECT path, length FROM (
  SELECT 'replays/' || game_mode || '/' || rank || '/' || id || '.replay' AS path, id*3 AS length FROM rp WHERE file_present
  UNION ALL SELECT 'replays/hoops/gold-1/orphan-' || id || '.replay', 1 FROM rp WHERE id % 7 = 0
  UNION ALL SELECT 'replays/' || rank || '/' || id || '.replay', 2 FROM rp WHERE id % 11 = 0
  UNION ALL SELECT 'replays/' || game_mode || '/' || rank || '/' || id || '.replay.bak', 3 FROM rp WHERE id % 13 = 0) x"""


def listed_files(spark, sf):
    replays = catalog.with_file_path(t.replays(spark, sf))
    size = lambda n: F.lit(n).cast("bigint").alias("length")
    known = replays.where("file_present").select(F.col("file_path").alias("path"), (F.col("id") * 3).alias("length"))
    orphan = replays.where("id % 7 = 0").select(
        F.concat(F.lit("replays/hoops/gold-1/orphan-"), F.col("id").cast("string"), F.lit(".replay")), size(1))
    shallow = replays.where("id % 11 = 0").select(
        F.concat(F.lit("replays/"), "rank", F.lit("/"), F.col("id").cast("string"), F.lit(".replay")), size(2))
    other = replays.where("id % 13 = 0").select(F.concat("file_path", F.lit(".bak")), size(3))
    return known.union(orphan).union(shallow).union(other)


@R.add("file_inventory", q.with_ctes("rp", """SELECT path, length, split_part(path, '/', 2) AS game_mode, split_part(path, '/', 3) AS rank,
  replace(split_part(path, '/', 4), '.replay', '') AS id FROM l WHERE len(string_split(path, '/')) = 4 AND path LIKE '%.replay'""", l=LISTED))
def file_inventory(spark, sf):
    return inventory.replay_parts(listed_files(spark, sf))


@R.add("replay_listing", q.with_ctes("rp", """SELECT path, id % 50 + 1 AS length, split_part(path, '/', 2) AS game_mode, split_part(path, '/', 3) AS rank,
  replace(split_part(path, '/', 4), '.replay', '') AS id FROM (SELECT id, 'replays/' || game_mode || '/' || rank || '/' || id || '.replay' AS path
   FROM rp WHERE file_present) x"""))
def replay_listing(spark, sf):
    """Replay files and others are written, then listed, portion by portion; no content is read."""
    root = run_folder(spark, "files")
    body = F.to_binary(F.repeat(F.lit("x"), (F.col("id") % 50 + 1).cast("int")), F.lit("utf-8")).alias("content")
    replays = catalog.with_file_path(t.replays(spark, sf))
    known = replays.where("file_present").select(F.col("file_path").alias("path"), body)
    other = replays.where("id % 13 = 0").select(F.concat("file_path", F.lit(".bak")), body)
    shallow = replays.where("id % 11 = 0").select(F.concat(F.lit("replays/"), "rank", F.lit("/"), F.col("id").cast("string"), F.lit(".replay")), body)
    listed = inventory.in_portions(known.union(other).union(shallow), root, inventory.list_replay_files)
    return listed.withColumn("path", F.regexp_extract("path", "/(replays/.*)$", 1))


@R.add("block_files", f"""SELECT vec_id, CAST(64 AS INT) AS n, FLOOR(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))*10000.0E0 + {OFF_TIE}E0)/10000.0E0 AS total,
  CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last_ FROM embeddings WHERE vec_id % 5 <> 3""")
def block_files(spark, sf):
    """Block files, some of them cut short, are written and read back; short ones are left out by their length."""
    root = run_folder(spark, "blocks")
    whole = blocks.encode_block("embedding")
    raw = t.table(spark, sf, "embeddings").select("vec_id", whole.alias("whole")).select(
        F.concat(F.lit("segments/v6/"), F.col("vec_id").cast("string"), F.lit("/0-1.features")).alias("path"),
        F.when(F.col("vec_id") % 5 == 3, F.expr("substring(whole, 1, 253)")).otherwise(F.col("whole")).alias("content"))
    inventory.write_files(raw, root)
    v = F.col("values")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return blocks.read_blocks(spark, root, 64).select(
        F.regexp_extract("path", "/v6/([0-9]+)/", 1).cast("bigint").alias("vec_id"), F.size(v).alias("n"), num(total, 4).alias("total"),
        F.get(v, F.lit(0)).cast("double").alias("first"), F.get(v, F.lit(63)).cast("double").alias("last_"))


@R.add("blob_decode", f"""SELECT vec_id, CASE WHEN fits THEN CAST(len(embedding) AS INT) ELSE -1 END AS n, CASE WHEN fits THEN
  FLOOR(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))*10000.0E0 + {OFF_TIE}E0)/10000.0E0 END AS total,
  CASE WHEN fits THEN CAST(embedding[1] AS DOUBLE) END AS first, CASE WHEN fits THEN CAST(embedding[64] AS DOUBLE) END AS last_,
  NOT fits AS is_bad FROM (SELECT *, vec_id % 5 <> 3 AS fits FROM embeddings) x""")
def blob_decode(spark, sf):
    """Blocks of 64 numbers; some have lost their last bytes."""
    whole = blocks.encode_block("embedding")
    raw = t.table(spark, sf, "embeddings").select("vec_id", whole.alias("whole")).select(
        "vec_id", F.when(F.col("vec_id") % 5 == 3, F.expr("substring(whole, 1, 253)")).otherwise(F.col("whole")).alias("content"))
    v = F.col("values")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return blocks.decode_blocks(raw, "content", 64).select(
        "vec_id", F.coalesce(F.size(v), F.lit(-1)).alias("n"), num(total, 4).alias("total"),
        F.get(v, F.lit(0)).cast("double").alias("first"), F.get(v, F.lit(63)).cast("double").alias("last_"), "is_bad")


@R.add("team_code", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 2 AS INT) AS team, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def team_code(spark, sf):
    return t.table(spark, sf, "lineitem").groupBy(
        "l_orderkey", "l_linenumber", labels.team_code(F.col("l_linenumber")).cast("int").alias("team")).agg(
        F.count(F.lit(1)).alias("n"))


@R.add("registry_register", """SELECT p_brand AS name, CAST(p_partkey AS INT) AS version FROM part
  UNION ALL SELECT n.name, CAST(COALESCE(MAX(p_partkey), 0) + 1 AS INT) FROM (SELECT DISTINCT p_brand AS name FROM part WHERE p_size = 1
  UNION SELECT 'new') n LEFT JOIN part ON p_brand = n.name GROUP BY n.name""")
def registry_register(spark, sf):
    """Another model for some names and for one that is new; all versions of all names."""
    registry = model_registry(spark, sf)
    names = t.table(spark, sf, "part").where("p_size = 1").select(F.col("p_brand").alias("name")).distinct()
    models = names.union(spark.range(1).select(F.lit("new"))).select(
        "name", F.lit("models/next").alias("checkpoint_path"), F.lit("{}").alias("training_config"))
    return catalog.list_models(catalog.register_model(registry, models)).select("name", "version")


@R.add("registry_find", "SELECT p_brand AS name, CAST(p_partkey AS INT) AS version, 'models/' || p_partkey AS checkpoint_path FROM part WHERE p_partkey = 7")
def registry_find(spark, sf):
    brand = t.table(spark, sf, "part").where("p_partkey = 7").select("p_brand").scalar()
    return catalog.find_model(model_registry(spark, sf), brand, 7).select("name", "version", "checkpoint_path")


@R.add("append_skip_existing", q.with_ctes("rp", """SELECT id, rank,
  'replays/' || game_mode || '/' || rank || '/' || id || '.replay' AS file_path
  FROM rp WHERE dataset_split IS DISTINCT FROM 'training'"""))
def append_skip_existing(spark, sf):
    replays = t.replays(spark, sf)
    stored = replays.where(F.col("dataset_split") == "training").select("id")
    incoming = replays.unionByName(replays.where(F.col("download_status") == "failed")).select(
        "id", "game_mode", "rank")
    return catalog.with_file_path(catalog.new_rows(incoming, stored, ["id"])).select("id", "rank", "file_path")


@R.add("append_skip_existing_composite", q.with_ctes(
    "sp", "SELECT DISTINCT replay_id, player_name, team FROM sp WHERE team = 1"))
def append_skip_existing_composite(spark, sf):
    incoming = t.segment_scores(spark, sf).select("replay_id", "player_name", "team")
    stored = t.lobby_players(spark, sf).where(F.col("team") == 0)
    return catalog.new_rows(incoming, stored, ["replay_id", "player_name"])


def model_registry(spark, sf):
    size = F.col("p_size")
    return t.table(spark, sf, "part").select(
        F.col("p_brand").alias("name"),
        F.col("p_partkey").cast("int").alias("version"),
        F.concat(F.lit("models/"), F.col("p_partkey").cast("string")).alias("checkpoint_path"),
        F.to_json(F.struct(F.when(size % 2 == 0, size * 10).alias("sequence_length"))).alias("training_config"),
    )


@R.add("registry_latest", """SELECT p_brand AS name, CAST(MAX(p_partkey) AS INT) AS version,
  'models/' || MAX(p_partkey) AS checkpoint_path,
  CAST(COALESCE(MAX_BY(CASE WHEN p_size % 2 = 0 THEN p_size*10 ELSE 150 END, p_partkey), 150) AS INT) AS sequence_length
  FROM part GROUP BY p_brand""")
def registry_latest(spark, sf):
    return catalog.latest_models(model_registry(spark, sf)).select(
        "name", "version", "checkpoint_path",
        labels.json_number(F.col("training_config"), "$.sequence_length", 150).alias("sequence_length"))


@R.add("registry_next_version", """SELECT n.name, CAST(COALESCE(MAX(p_partkey), 0) + 1 AS INT) AS next_version
  FROM (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part) n
  LEFT JOIN part ON p_brand = n.name GROUP BY n.name""")
def registry_next_version(spark, sf):
    part = t.table(spark, sf, "part")
    names = part.select(F.col("p_brand").alias("name")).union(part.select("p_type")).distinct()
    return catalog.next_version(model_registry(spark, sf), names)


@R.add("rank_from_path", q.with_ctes("rp", "SELECT id, rank_index FROM rp"))
def rank_from_path(spark, sf):
    return catalog.with_file_path(t.replays(spark, sf)).select(
        "id", labels.rank_in_path(F.col("file_path")).alias("rank_index"))


@R.add("proxy_label", q.with_ctes("rp ranks", """SELECT id, canonical_mmr, folder_mmr FROM rp JOIN ranks USING (rank_index)
  WHERE folder_mmr > 0"""))
def proxy_label(spark, sf):
    rank = ladder.parse_rank(F.col("rank"))
    return t.replays(spark, sf).select(
        "id", ladder.canonical_mmr(rank).alias("canonical_mmr"), ladder.folder_proxy_mmr(rank).alias("folder_mmr"),
    ).where(F.col("folder_mmr") > 0)


@R.add("json_default", """SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) AS k, 150 AS sequence_length
  FROM events""")
def json_default(spark, sf):
    return t.table(spark, sf, "events").select(
        "event_id", labels.json_number(F.col("props"), "$.k", 150).alias("k"),
        labels.json_number(F.col("props"), "$.sequence_length", 150).alias("sequence_length"))


# --- filters and policies ------------------------------------------------------------

@R.add("catalog_filter", q.with_ctes("rp", """SELECT id, rank, download_status FROM rp
  WHERE (dataset_split = 'training' AND download_status = 'downloaded')
     OR (rank = 'gold-2' AND download_status = 'not_downloaded')"""))
def catalog_filter(spark, sf):
    replays = t.replays(spark, sf)
    training = catalog.select_replays(replays, split="training", status="downloaded")
    queue = catalog.select_replays(replays, rank="gold-2", status="not_downloaded")
    return training.unionByName(queue).select("id", "rank", "download_status")


@R.add("coarse_rank_match", q.with_ctes("bounds", f"""SELECT replay_id FROM bounds
  WHERE replay_id % 5 = 0 OR {q.rank_of('low')} = replay_id % 5"""))
def coarse_rank_match(spark, sf):
    d = F.col("doc.min_rank")
    low = F.when(d.isNotNull(), ladder.rank_info_division(d["id"], d["tier"], d["division"]))
    return summaries(spark, sf).where(
        catalog.matches_rank(low, (F.col("replay_id") % 5).cast("int"))).select("replay_id")


def _playlist_sql(x: str) -> str:
    return f"""CASE {x} WHEN 1 THEN 'casual 1v1' WHEN 2 THEN 'casual 2v2' WHEN 3 THEN 'casual 3v3 standard'
      WHEN 10 THEN 'ranked 1v1 (duels)' WHEN 11 THEN 'ranked 2v2 (doubles)' WHEN 12 THEN 'ranked solo standard 3v3'
      WHEN 15 THEN 'Snow Day' WHEN 16 THEN 'Snow Day' WHEN 17 THEN 'Rocket Labs' WHEN 18 THEN 'Rocket Labs'
      WHEN 25 THEN 'Hoops' WHEN 26 THEN 'Hoops' WHEN 27 THEN 'Rumble' WHEN 28 THEN 'Rumble'
      WHEN 29 THEN 'Dropshot' WHEN 30 THEN 'Dropshot' WHEN 31 THEN 'Heatseeker' WHEN 32 THEN 'Heatseeker'
      ELSE 'this playlist (id ' || {x} || ')' END"""


HEADERS = """SELECT o_orderkey AS id, o_custkey AS c, o_orderkey AS k,
  CASE o_custkey % 11 WHEN 0 THEN 'TAGame.Replay_Hoops_TA' WHEN 1 THEN 'TAGame.Replay_Other_TA' ELSE 'TAGame.Replay_Soccar_TA' END AS game_type,
  CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 3 END AS team_size,
  CASE WHEN o_orderkey % 13 = 0 THEN 5 ELSE 6 END AS player_count,
  CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 13 ELSE o_custkey % 40 END AS playlist,
  CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'TAGame.MatchType_PublicRanked_TA' WHEN 2 THEN 'TAGame.MatchType_Private_TA'
   WHEN 3 THEN 'TAGame.MatchType_Public_TA' ELSE 'TAGame.MatchType_Season_TA' END AS match_type FROM orders"""
REASON = f"""CASE WHEN game_type LIKE '%Hoops%' THEN 'Hoops' WHEN game_type <> 'TAGame.Replay_Soccar_TA' THEN game_type
  WHEN team_size IS NULL THEN 'missing team size in replay header' WHEN team_size = 2 THEN '2v2' WHEN team_size = 5 THEN 'team size 5'
  WHEN player_count <> 6 THEN 'this lobby (5 players; expected 6 for 3v3)' WHEN playlist = 13 THEN NULL
  WHEN playlist IS NOT NULL THEN {_playlist_sql('playlist')}
  WHEN match_type IS NULL THEN 'this match (ranked standard 3v3 could not be confirmed in the replay header)'
  WHEN match_type LIKE '%PublicRanked%' THEN NULL WHEN match_type LIKE '%Private%' THEN 'private matches or custom games'
  WHEN match_type LIKE '%Public%' THEN 'casual or unranked online play' ELSE 'this match type (' || match_type || ')' END"""


def _reason():
    return labels.reject_reason(*map(F.col, ("game_type", "team_size", "player_count", "playlist", "match_type")))


@R.add("acceptance_policy", f"""WITH h AS ({HEADERS}), r AS (SELECT id, {REASON} AS reject_reason FROM h)
  SELECT id, reject_reason, 'We currently do not support ' || reject_reason
  || ' — only ranked 3v3 standard is supported at this time.' AS message FROM r""")
def acceptance_policy(spark, sf):
    return t.match_headers(spark, sf).select("id", _reason().alias("reject_reason")).withColumn(
        "message", labels.rejection_message(F.col("reject_reason")))


@R.add("skip_counts", f"""WITH h AS ({HEADERS}) SELECT COALESCE({REASON}, 'accepted') AS outcome, COUNT(*) AS n FROM h GROUP BY 1""")
def skip_counts(spark, sf):
    return t.match_headers(spark, sf).groupBy(F.coalesce(_reason(), F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))


def parse_results(spark, sf):
    """Replays whose document parses; every thirteenth is cut off."""
    cut = F.when(F.col("replay_id") % 13 == 0, F.substr("metadata", F.lit(1), F.lit(9))).otherwise(F.col("metadata"))
    parsed = bundle.parse_lines(t.replay_summaries(spark, sf).withColumn("metadata", cut), "metadata", "id string")
    return parsed.select(F.col("replay_id").alias("id"), "is_bad")


# Every game with players, a file, a readable document and frames is built; games of the first users have frames.
SKIPPED = """SELECT outcome, COUNT(*) AS n FROM (SELECT CASE WHEN id NOT IN (SELECT replay_id FROM lp) THEN 'no_players' WHEN id % 17 = 0 THEN 'cached'
  WHEN NOT file_present THEN 'read_error' WHEN id % 13 = 0 THEN 'parse_error' WHEN id NOT IN (SELECT game_id FROM ef) THEN 'no_frames'
  ELSE 'built' END AS outcome FROM rp) x GROUP BY outcome"""


@R.add("skip_classes", q.with_ctes("rp lp ef", f"SELECT c.outcome, COALESCE(s.n, 0) AS n FROM ({SKIPPED}) s RIGHT JOIN (SELECT UNNEST(["
                                   "'no_players', 'cached', 'read_error', 'parse_error', 'no_frames', 'built']) AS outcome) c USING (outcome)"))
def skip_classes(spark, sf):
    """What a build run does with each replay of the catalogue, counted while the outcomes are written."""
    replays = catalog.with_file_path(t.replays(spark, sf))
    outcomes = segments.build_outcomes(
        replays, t.lobby_players(spark, sf), replays.where("id % 17 = 0").select(F.col("id").alias("game_id")),
        listed_files(spark, sf), parse_results(spark, sf), t.event_frames(spark, sf))
    counts = segments.write_outcomes(outcomes, run_folder(spark, "outcomes"))
    return spark.createDataFrame(sorted(counts.items()), "outcome string, n bigint")


@R.add("built_segments", q.with_ctes("rp lp ef", """SELECT id AS game_id, rank, game_mode, CAST(GREATEST(1, (COUNT(*) + 1) // 2 // 10) AS BIGINT)*6 AS n_rows
  FROM rp JOIN ef ON game_id = id WHERE id IN (SELECT replay_id FROM lp) AND id % 17 <> 0 AND file_present AND id % 13 <> 0 GROUP BY ALL"""))
def built_segments(spark, sf):
    """The segments that the same run stores: those of the replays it builds."""
    replays = catalog.with_file_path(t.replays(spark, sf))
    outcomes = segments.build_outcomes(
        replays, t.lobby_players(spark, sf), replays.where("id % 17 = 0").select(F.col("id").alias("game_id")),
        listed_files(spark, sf), parse_results(spark, sf), t.event_frames(spark, sf))
    folder = run_folder(spark, "built")
    segments.write_outcomes(outcomes, f"{folder}/outcomes")
    frames = t.marked_frames(spark, sf).withColumns({"goal_blue": F.lit(0), "goal_orange": F.lit(0)})
    segments.build(spark, f"{folder}/outcomes", frames, telemetry.roster(t.car_names(spark, sf)), f"{folder}/segments", 10)
    return segments.read_segments(spark, f"{folder}/segments", 10).groupBy("game_id", "rank", "game_mode").agg(
        F.count(F.lit(1)).alias("n_rows"))


@R.add("mode_label", f"""SELECT o_orderkey AS id, {_playlist_sql('(o_custkey % 40)')} AS playlist_label,
  CASE o_orderkey % 6 WHEN 0 THEN 'team size 0' WHEN 1 THEN '1v1' WHEN 2 THEN '2v2' WHEN 3 THEN 'team size 3'
   WHEN 4 THEN '4v4' ELSE 'team size 5' END AS size_label FROM orders""")
def mode_label(spark, sf):
    return t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        labels.playlist_label((F.col("o_custkey") % 40).cast("int")).alias("playlist_label"),
        labels.team_size_label((F.col("o_orderkey") % 6).cast("int")).alias("size_label"))


# --- joins on the catalogue -----------------------------------------------------------

@R.add("replay_players_join", q.with_ctes("rp lp", """SELECT id, rank, slot, player_name, division_idx FROM rp
  JOIN lp ON id = replay_id"""))
def replay_players_join(spark, sf):
    players = t.lobby_players(spark, sf)
    return t.replays(spark, sf).join(players, F.col("id") == F.col("replay_id")).select(
        "id", "rank", "slot", "player_name", "division_idx")


@R.add("anti_dedup", q.with_ctes("rp", """SELECT DISTINCT l_orderkey AS id FROM lineitem
  WHERE l_orderkey NOT IN (SELECT id FROM rp WHERE download_status = 'downloaded')"""))
def anti_dedup(spark, sf):
    fetched = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    stored = t.replays(spark, sf).where(F.col("download_status") == "downloaded")
    return catalog.new_rows(fetched, stored, ["id"])


@R.add("semi_exists", q.with_ctes("rp", """SELECT id, rank FROM rp WHERE EXISTS
  (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_returnflag = 'R')"""))
def semi_exists(spark, sf):
    returned = t.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("id"))
    return catalog.existing(t.replays(spark, sf), returned, ["id"]).select("id", "rank")


@R.add("id_except", """SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem""")
def id_except(spark, sf):
    stored = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    return catalog.new_rows(t.replays(spark, sf).select("id"), stored, ["id"])


@R.add("update_join", q.with_ctes("lp", f"""SELECT replay_id, player_name,
  CASE WHEN rank_known THEN {q.r6('pred_mmr - target_mmr')} ELSE CAST(slot AS DOUBLE) END AS smurf_score FROM lp"""))
def update_join(spark, sf):
    players = t.lobby_players(spark, sf)
    stored = players.select("replay_id", "player_name", F.col("slot").cast("double").alias("smurf_score"))
    scores = players.where("rank_known").select(
        "replay_id", "player_name", num(F.col("pred_mmr") - F.col("target_mmr")).alias("smurf_score"))
    return catalog.update_scores(stored, scores)


RECONCILED = """SELECT id, download_status, file_present AS on_disk,
  CASE WHEN file_present THEN 'downloaded' ELSE 'not_downloaded' END AS new_status FROM rp"""


def _reconciled(spark, sf):
    replays = catalog.with_file_path(t.replays(spark, sf))
    return catalog.reconcile(replays, listed_files(spark, sf).select("path"))


@R.add("status_reconcile", q.with_ctes("rp", RECONCILED))
def status_reconcile(spark, sf):
    return _reconciled(spark, sf).select("id", "download_status", "on_disk", "new_status")


@R.add("status_reconcile_counters", q.with_ctes("rp", """SELECT COUNT(*) FILTER (download_status = 'failed') AS failed_reset,
  COUNT(*) FILTER (download_status = 'downloaded') AS downloaded_checked,
  COUNT(*) FILTER (download_status = 'downloaded' AND file_present) AS downloaded_on_disk,
  COUNT(*) FILTER (download_status = 'downloaded' AND NOT file_present) AS missing_reset,
  COUNT(*) FILTER (download_status <> 'downloaded' OR NOT file_present) AS pending_checked,
  COUNT(*) FILTER (download_status <> 'downloaded' AND file_present) AS found_marked_downloaded,
  COUNT(*) FILTER (NOT file_present) AS pending_still_missing FROM rp"""))
def status_reconcile_counters(spark, sf):
    return catalog.reconcile_counters(_reconciled(spark, sf))


@R.add("player_count_mismatch", q.with_ctes("rp lp", """SELECT id, COUNT(lp.replay_id) AS stored_rows,
  COUNT(DISTINCT player_name) AS effective_count FROM rp LEFT JOIN lp ON id = lp.replay_id GROUP BY id
  HAVING COUNT(lp.replay_id) <> 6 OR COUNT(DISTINCT player_name) <> 6"""))
def player_count_mismatch(spark, sf):
    return catalog.player_count_mismatch(t.replays(spark, sf), t.lobby_players(spark, sf))


@R.add("effective_player_count", q.with_ctes("sp", """SELECT replay_id, COUNT(*) AS n_rows,
  COUNT(DISTINCT player_name) AS n_names, COUNT(DISTINCT platform_id) AS n_platform_ids,
  GREATEST(COUNT(*), COUNT(DISTINCT player_name), COUNT(DISTINCT platform_id)) AS effective_count
  FROM sp GROUP BY replay_id"""))
def effective_player_count(spark, sf):
    return catalog.effective_player_count(t.segment_scores(spark, sf), "replay_id", "player_name", "platform_id")


# --- catalogue aggregates --------------------------------------------------------------

@R.add("count_by_rank_status", q.with_ctes("rp", "SELECT rank, download_status, COUNT(*) AS n FROM rp GROUP BY 1, 2"))
def count_by_rank_status(spark, sf):
    return catalog.count_by_rank_status(t.replays(spark, sf))


@R.add("pending_by_rank", q.with_ctes("rp", """SELECT rank, COUNT(*) FILTER (download_status = 'not_downloaded') AS pending
  FROM rp GROUP BY rank"""))
def pending_by_rank(spark, sf):
    return catalog.pending_by_rank(t.replays(spark, sf))


@R.add("status_rollup", q.with_ctes("rp", f"""SELECT CASE WHEN GROUPING(rank) = 1 THEN 'TOTAL' ELSE rank END AS rank,
  COUNT(*) FILTER (download_status = 'downloaded') AS downloaded, COUNT(*) FILTER (download_status = 'failed') AS failed,
  COUNT(*) FILTER (download_status IN ('downloaded', 'failed')) AS total,
  COUNT(*) FILTER (download_status = 'not_downloaded') AS pending,
  {q.r6("COALESCE(COUNT(*) FILTER (download_status = 'downloaded')*100.0E0/NULLIF(COUNT(*) FILTER (download_status IN ('downloaded', 'not_downloaded')), 0), 0)")} AS progress_pct
  FROM rp GROUP BY ROLLUP (rank)"""))
def status_rollup(spark, sf):
    return catalog.status_report(t.replays(spark, sf)).withColumn("progress_pct", num(F.col("progress_pct")))


@R.add("split_counts", q.with_ctes("rp", """SELECT COUNT(*) FILTER (dataset_split = 'training') AS training,
  COUNT(*) FILTER (dataset_split = 'evaluation') AS evaluation FROM rp WHERE download_status = 'downloaded'"""))
def split_counts(spark, sf):
    return catalog.split_counts(t.replays(spark, sf))


@R.add("import_progress", q.with_ctes("rp", f"""SELECT COUNT(*) AS processed,
  COUNT(*) FILTER (o = 'imported') AS imported, COUNT(*) FILTER (o = 'already_exists') AS already_exists,
  COUNT(*) FILTER (o = 'no_file') AS no_file, COUNT(*) FILTER (o = 'error') AS error,
  {q.r6("COUNT(*) FILTER (o = 'imported')*100.0E0/COUNT(*)")} AS imported_pct
  FROM (SELECT CASE WHEN dataset_split = 'training' THEN 'already_exists' WHEN NOT file_present THEN 'no_file'
   WHEN playlist_raw IS NULL THEN 'error' ELSE 'imported' END AS o FROM rp) x"""))
def import_progress(spark, sf):
    outcome = (
        F.when(F.col("dataset_split") == "training", F.lit("already_exists"))
        .when(~F.col("file_present"), F.lit("no_file"))
        .when(F.col("playlist_raw").isNull(), F.lit("error"))
        .otherwise(F.lit("imported"))
    )
    rows = t.replays(spark, sf).select(outcome.alias("outcome"))
    return catalog.import_counts(rows, "outcome").withColumn("imported_pct", num(F.col("imported_pct")))


# --- labels ----------------------------------------------------------------------------

@R.add("avg_rating", q.with_ctes("rp lp", f"""SELECT id AS replay_id, {q.r6(f"AVG({q.mid('division_idx')})")} AS avg_mmr
  FROM rp LEFT JOIN lp ON id = replay_id GROUP BY id"""))
def avg_rating(spark, sf):
    return labelling.average_rating(t.replays(spark, sf), t.lobby_players(spark, sf)).withColumn(
        "avg_mmr", num(F.col("avg_mmr")))


AVERAGE = """SELECT l.replay_id, CAST(COALESCE(SUM(division_idx) FILTER (rank_known) // COUNT(*) FILTER (rank_known),
  MAX(CASE WHEN l.replay_id % 5 <> 0 THEN (low + high) // 2 END)) AS INT) AS average_division
  FROM lp l JOIN bounds b ON l.replay_id = b.replay_id GROUP BY l.replay_id"""


@R.add("avg_division", q.with_ctes("lp bounds", AVERAGE))
def avg_division(spark, sf):
    return labelling.average_division(summaries(spark, sf))


@R.add("impute_midpoint", q.with_ctes("lp bounds", """SELECT l.replay_id, player_name, team, rank_known,
  CAST(CASE WHEN rank_known THEN division_idx ELSE (low + high) // 2 END AS INT) AS division_idx
  FROM lp l JOIN bounds b ON l.replay_id = b.replay_id WHERE rank_known OR l.replay_id % 5 <> 0"""))
def impute_midpoint(spark, sf):
    return labelling.impute_midpoint(labelling.player_rows(summaries(spark, sf)))


@R.add("impute_lobby_average", q.with_ctes("lp bounds", f"""SELECT l.replay_id, player_name, team, rank_known,
  CAST(CASE WHEN rank_known THEN division_idx ELSE average_division END AS INT) AS division_idx,
  {q.rank_of('average_division')} AS folder_rank FROM lp l JOIN av ON l.replay_id = av.replay_id
  WHERE rank_known OR average_division IS NOT NULL""", av=AVERAGE))
def impute_lobby_average(spark, sf):
    return labelling.impute_lobby_average(labelling.player_rows(summaries(spark, sf)))


SLOTS_SQL = """SELECT *, team*3 + ROW_NUMBER() OVER (PARTITION BY replay_id, team ORDER BY player_name) - 1 AS s FROM lp"""


@R.add("target_vector", q.with_ctes("lp", "SELECT replay_id, " + ", ".join(
    f"COALESCE(MAX(CASE WHEN s = {i} THEN target_mmr END), 0.0E0) AS t{i}" for i in range(6)
) + " FROM sl GROUP BY replay_id", sl=SLOTS_SQL))
def target_vector(spark, sf):
    return labelling.target_slots(t.lobby_players(spark, sf))


@R.add("primary_rank", q.with_ctes("lp", f"""SELECT replay_id, COALESCE({q.rank_of_rating('m')}, 0) AS rank_index
  FROM (SELECT replay_id, AVG(target_mmr) AS m FROM lp GROUP BY replay_id) x"""))
def primary_rank(spark, sf):
    return labelling.primary_rank(t.lobby_players(spark, sf))


# --- ladder and text functions ----------------------------------------------------------

@R.add("mmr_band_lookup", q.with_ctes("lp", f"""SELECT replay_id, slot, {q.band('pred_mmr')} AS division_idx,
  {q.division_name(q.band('pred_mmr'))} AS division, {q.rank_of_rating('pred_mmr')} AS rank_index FROM lp"""))
def mmr_band_lookup(spark, sf):
    band = ladder.band_index(F.col("pred_mmr"))
    return t.lobby_players(spark, sf).select("replay_id", "slot", band.alias("division_idx")).select(
        "*", ladder.division_name(F.col("division_idx")).alias("division"),
        ladder.division_rank(F.col("division_idx")).alias("rank_index"))


@R.add("mmr_middle", q.with_ctes("lp", f"""SELECT replay_id, slot, CAST({q.mid('division_idx')} AS INT) AS mmr_middle,
  CAST(({q.text_list(ladder.BAND_MIN)}[division_idx + 1]) AS INT) AS mmr_min,
  CAST(({q.text_list(ladder.BAND_MAX)}[division_idx + 1]) AS INT) AS mmr_max FROM lp"""))
def mmr_middle(spark, sf):
    d = F.col("division_idx")
    return t.lobby_players(spark, sf).select(
        "replay_id", "slot", ladder.division_middle(d).alias("mmr_middle"),
        ladder.division_min(d).alias("mmr_min"), ladder.division_max(d).alias("mmr_max"))


@R.add("division_to_rank", q.with_ctes("lp", f"""SELECT replay_id, slot, {q.rank_of('division_idx')} AS rank_index,
  {q.rank_name(q.rank_of('division_idx'))} AS rank FROM lp"""))
def division_to_rank(spark, sf):
    rank = ladder.division_rank(F.col("division_idx"))
    return t.lobby_players(spark, sf).select(
        "replay_id", "slot", rank.alias("rank_index"), ladder.rank_name(rank).alias("rank"))


@R.add("division_label", q.with_ctes("lp", f"""SELECT replay_id, slot, {q.division_label('division_idx')} AS label FROM lp"""))
def division_label(spark, sf):
    return t.lobby_players(spark, sf).select(
        "replay_id", "slot", ladder.division_label(F.col("division_idx")).alias("label"))


@R.add("division_parse", q.with_ctes("lp", """SELECT replay_id, slot,
  CASE WHEN division_idx % 3 = 2 AND slot = 5 THEN NULL ELSE division_idx END AS division_idx FROM lp"""))
def division_parse(spark, sf):
    """Each division spelled in one of three ways, and some spelled wrongly."""
    d = F.col("division_idx")
    prefix = F.get(F.array(*map(F.lit, ("b", "s", "g", "p", "d", "c", "gc", "ssl"))), F.floor(d / 12).cast("int"))
    short = F.when(d == 84, F.lit("SSL")).otherwise(F.concat(
        prefix, (F.floor(d % 12 / 4) + 1).cast("string"), F.lit("d"), (d % 4 + 1).cast("string")))
    text = (
        F.when((d % 3 == 2) & (F.col("slot") == 5), F.lit("no such rank"))
        .when(d % 3 == 0, ladder.division_name(d))
        .when(d % 3 == 1, ladder.division_label(d))
        .otherwise(short)
    )
    return t.lobby_players(spark, sf).select("replay_id", "slot", text.alias("text")).select(
        "replay_id", "slot", ladder.parse_division(F.col("text")).cast("int").alias("division_idx"))


@R.add("rank_parse", q.with_ctes("rp", "SELECT id, rank_index, NULL::INT AS unknown FROM rp"))
def rank_parse(spark, sf):
    spelled = F.replace(F.upper("rank"), F.lit("-"), F.lit("_"))
    return t.replays(spark, sf).select(
        "id", ladder.parse_rank(spelled).alias("rank_index"),
        ladder.parse_rank(F.col("playlist_raw")).alias("unknown"))


@R.add("rank_arith", q.with_ctes("rp", """SELECT id, CAST(GREATEST(0, LEAST(22, rank_index + 5)) AS INT) AS up,
  CAST(GREATEST(0, LEAST(22, rank_index - 3)) AS INT) AS down,
  CAST(rank_index - id % 23 AS INT) AS steps FROM rp"""))
def rank_arith(spark, sf):
    rank = F.col("rank_index")
    return t.replays(spark, sf).select(
        "id", ladder.rank_shift(rank, 5).alias("up"), ladder.rank_shift(rank, -3).alias("down"),
        (rank - F.col("id") % 23).cast("int").alias("steps"))


TIERED = """SELECT o_orderkey AS id, CAST(o_custkey % 25 AS INT) AS tier,
  CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE CAST(o_orderkey % 7 AS INT) END AS division FROM orders"""
TIER_DIVISION = """CASE WHEN tier = 22 THEN 84 WHEN tier BETWEEN 1 AND 21
  THEN (tier - 1)*4 + GREATEST(1, LEAST(4, COALESCE(division, 1))) - 1 END"""


def _tiered(spark, sf):
    return t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).cast("int").alias("tier"),
        F.when(F.col("o_orderkey") % 7 != 6, (F.col("o_orderkey") % 7).cast("int")).alias("division"))


@R.add("tier_division_lookup", f"""WITH x AS ({TIERED}), y AS (SELECT id, CAST({TIER_DIVISION} AS INT) AS division_idx FROM x)
  SELECT id, division_idx, {q.division_label('division_idx')} AS label FROM y""")
def tier_division_lookup(spark, sf):
    return _tiered(spark, sf).select(
        "id", ladder.tier_division(F.col("tier"), F.col("division")).alias("division_idx")).withColumn(
        "label", ladder.division_label(F.col("division_idx")))


@R.add("rank_info_resolve", f"""WITH x AS ({TIERED}), y AS (SELECT *, CASE id % 6 WHEN 0 THEN 'grand-champion' WHEN 1 THEN 'grand-champion-2'
  WHEN 2 THEN 'supersonic-legend' WHEN 3 THEN 'gold-1' ELSE '' END AS rid, CASE WHEN id % 4 = 0 THEN NULL ELSE tier END AS ti FROM x)
  SELECT id, CAST(COALESCE({TIER_DIVISION.replace('tier', 'ti')}, CASE WHEN rid = 'grand-champion' THEN 73
   WHEN rid = 'grand-champion-2' THEN 76 + GREATEST(1, LEAST(4, COALESCE(division, 1))) - 1
   WHEN rid = 'supersonic-legend' THEN 84 END,
   CASE WHEN ti IS NULL THEN GREATEST(1, LEAST(4, COALESCE(division, 1))) - 1 END, 0) AS INT) AS division_idx FROM y""")
def rank_info_resolve(spark, sf):
    k = F.col("id") % 6
    rank_id = (
        F.when(k == 0, F.lit("grand-champion")).when(k == 1, F.lit("grand-champion-2"))
        .when(k == 2, F.lit("supersonic-legend")).when(k == 3, F.lit("gold-1")).otherwise(F.lit(""))
    )
    tier = F.when(F.col("id") % 4 != 0, F.col("tier"))
    return _tiered(spark, sf).select(
        "id", ladder.rank_info_division(rank_id, tier, F.col("division")).alias("division_idx"))


@R.add("game_mode_parse", q.with_ctes("rp", """SELECT id, game_mode, CASE WHEN playlist_raw IS NULL
  OR playlist_raw = 'unknown_mode' THEN NULL ELSE game_mode END AS parsed FROM rp"""))
def game_mode_parse(spark, sf):
    raw = F.col("playlist_raw")
    return t.replays(spark, sf).select(
        "id", labels.game_mode_or_default(raw).alias("game_mode"), labels.game_mode(raw).alias("parsed"))


@R.add("path_build", q.with_ctes("rp", """SELECT id,
  'replays/' || game_mode || '/' || rank || '/' || id || '.replay' AS file_path,
  'segments/v6/' || game_mode || '/' || rank || '/' || id AS segment_folder, id*300 || '-' || (id*300 + 300) || '.features' AS segment_file FROM rp"""))
def path_build(spark, sf):
    i = F.col("id")
    return catalog.with_file_path(t.replays(spark, sf)).select(
        "id", "file_path",
        labels.segment_folder(F.lit("v6"), F.col("game_mode"), F.col("rank"), i).alias("segment_folder"),
        labels.segment_file(i * 300, i * 300 + 300).alias("segment_file"))


@R.add("parse_frame_range", """SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey*300 END AS start,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey*300 + 300 END AS end_,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey AS INT) END AS epoch FROM orders""")
def parse_frame_range(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stem = F.when(k % 5 == 0, F.lit("abc-def")).otherwise(F.concat((k * 300).cast("string"), F.lit("-"), (k * 300 + 300).cast("string")))
    name = F.when(k % 4 == 0, F.lit("models/checkpoint_best")).otherwise(
        F.concat(F.lit("models/checkpoint_epoch"), c.cast("string"), F.when(k % 4 == 1, F.lit(".mpk")).otherwise(F.lit(""))))
    span = labels.frame_range(F.col("stem"))
    return t.table(spark, sf, "orders").select(k.alias("id"), stem.alias("stem"), name.alias("name")).select(
        "id", span["start"].alias("start"), span["end"].alias("end_"),
        labels.checkpoint_epoch(F.col("name")).alias("epoch"))


@R.add("url_set_param", """SELECT page_id, regexp_replace(regexp_replace(b, '(^|&)page=[^&]*', '', 'g'), '^&', '') AS kept_query,
  s || '?' || CASE WHEN k = '' THEN '' ELSE k || '&' END || 'page=' || page_id || f AS url FROM (
  SELECT page_id, s, b, f, regexp_replace(regexp_replace(b, '(^|&)page=[^&]*', '', 'g'), '^&', '') AS k FROM (
  SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS s, split_part(split_part(url, '#', 1), '?', 2) AS b,
   CASE WHEN strpos(url, '#') > 0 THEN '#' || split_part(url, '#', 2) ELSE '' END AS f FROM pages) x) y""")
def url_set_param(spark, sf):
    out = labels.url_set_param(F.col("url"), "page", F.col("page_id").cast("string"))
    kept = F.regexp_replace(F.regexp_extract("url2", r"\?([^#]*)", 1), r"&?page=\d+$", "")
    return t.table(spark, sf, "pages").select("page_id", out.alias("url2")).select(
        "page_id", kept.alias("kept_query"), F.col("url2").alias("url"))


@R.add("name_list", q.with_ctes("lp", """SELECT replay_id, CASE len(n) WHEN 1 THEN n[1] WHEN 2 THEN n[1] || ' and ' || n[2]
  ELSE array_to_string(n[1:len(n)-1], ', ') || ', and ' || n[len(n)] END AS names
  FROM (SELECT replay_id, list(player_name ORDER BY slot) AS n FROM lp GROUP BY replay_id) x"""))
def name_list(spark, sf):
    names = F.transform(F.array_sort(F.collect_list(F.struct("slot", "player_name"))), lambda p: p["player_name"])
    return t.lobby_players(spark, sf).groupBy("replay_id").agg(labels.name_list(names).alias("names"))


@R.add("slot_padding", q.with_ctes("lp", """SELECT r.replay_id, CAST(g.i AS INT) AS lane,
  COALESCE(p.name, 'Player ' || (g.i + 1)) AS player_name, COALESCE(p.team, 0) AS team
  FROM (SELECT DISTINCT replay_id FROM lp) r CROSS JOIN (SELECT UNNEST([0,1,2,3,4,5]) AS i) g
  LEFT JOIN (SELECT *, CASE WHEN (replay_id + slot) % 9 < 2 THEN 'Player_' || (replay_id % 90 * 10 + slot) ELSE player_name END AS name,
    ROW_NUMBER() OVER (PARTITION BY replay_id ORDER BY slot) - 1 AS i FROM lp) p ON p.replay_id = r.replay_id AND p.i = g.i"""))
def slot_padding(spark, sf):
    """Some cars have lost their name, or have an empty one."""
    rest = (F.col("replay_id") + F.col("slot")) % 9
    name = F.when(rest == 0, F.lit("")).when(rest != 1, F.col("player_name"))
    players = t.lobby_players(spark, sf).withColumn("player_name", name).withColumn(
        "actor_id", F.col("replay_id") % 90 * 10 + F.col("slot"))
    return results.padded_lanes(players)
