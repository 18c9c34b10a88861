from pyspark.sql import functions as F

from lobbylens.functions import ladder
from lobbylens.operators import catalog, labelling
from lobbylens.sources import bundle


def test_status_against_files(spark):
    rows = [(s, there) for s in ("downloaded", "not_downloaded", "failed", "in_progress") for there in (True, False)]
    replays = spark.createDataFrame([(i, f"f{i}", s) for i, (s, _) in enumerate(rows)], "id int, file_path string, download_status string")
    files = spark.createDataFrame([(f"f{i}",) for i, (_, there) in enumerate(rows) if there], "path string")
    done = catalog.reconcile(replays, files)
    got = {(r.download_status, r.on_disk): r.new_status for r in done.collect()}
    assert got == {
        ("downloaded", True): "downloaded", ("downloaded", False): "not_downloaded",
        ("not_downloaded", True): "downloaded", ("not_downloaded", False): "not_downloaded",
        ("failed", True): "downloaded", ("failed", False): "not_downloaded",
        ("in_progress", True): "in_progress", ("in_progress", False): "in_progress",
    }
    assert catalog.reconcile_counters(done).first().asDict() == {
        "failed_reset": 2, "downloaded_checked": 2, "downloaded_on_disk": 1, "missing_reset": 1,
        "pending_checked": 5, "found_marked_downloaded": 2, "pending_still_missing": 3,
    }


def test_append_keeps_stored_rows(spark, folder):
    def rows(*ids):
        return spark.createDataFrame([(i, f"v{n}") for n, i in enumerate(ids)], "id int, v string")

    rows(1, 2).write.mode("append").parquet(folder)
    assert catalog.append_new(rows(9, 2, 3, 3), spark.read.parquet(folder), ["id"], folder) == 2
    got = {r.id: r.v for r in spark.read.parquet(folder).collect()}
    assert sorted(got) == [1, 2, 3, 9] and got[2] == "v1"


def test_model_versions(spark):
    registry = spark.createDataFrame([("a", 1, "p1"), ("a", 3, "p3")], "name string, version int, checkpoint_path string")
    fresh = spark.createDataFrame([("a", "p4"), ("b", "q1")], "name string, checkpoint_path string")
    grown = catalog.register_model(registry, fresh)
    assert {(r.name, r.version) for r in grown.collect()} == {("a", 1), ("a", 3), ("a", 4), ("b", 1)}
    assert {r.name: r.checkpoint_path for r in catalog.latest_models(grown).collect()} == {"a": "p4", "b": "q1"}


def test_report_and_updates(spark):
    replays = spark.createDataFrame(
        [("gold-1", "downloaded"), ("gold-1", "failed"), ("gold-2", "not_downloaded")], "rank string, download_status string")
    total = catalog.status_report(replays).where("rank = 'TOTAL'").first()
    assert (total.downloaded, total.failed, total.total, total.pending, total.progress_pct) == (1, 1, 2, 1, 50.0)
    players = spark.createDataFrame([(1, "a", 0.5), (1, "b", None)], "replay_id int, player_name string, smurf_score double")
    scores = spark.createDataFrame([(1, "b", 7.0)], "replay_id int, player_name string, smurf_score double")
    assert {r.player_name: r.smurf_score for r in catalog.update_scores(players, scores).collect()} == {"a": 0.5, "b": 7.0}


SUMMARY = (
    '{"id":"%s","link":"l","created":"c","min_rank":%s,"max_rank":%s,'
    '"blue":{"players":[{"name":"known","rank":{"id":"gold-1","tier":7,"division":1}},{"name":"guess"},{"rank":null}]},'
    '"orange":%s,"extra":1}'
)
RANK = '{"id":"gold-3","tier":9,"division":2}'


def documents(spark):
    rows = [
        (1, SUMMARY % (1, RANK, RANK, "null")),
        (2, SUMMARY.replace('"rank":{"id":"gold-1","tier":7,"division":1}', '"rank":null') % (2, RANK, RANK, "null")),
        (3, SUMMARY.replace('"rank":{"id":"gold-1","tier":7,"division":1}', '"rank":null') % (3, "null", "null", "null")),
    ]
    raw = spark.createDataFrame(rows, "replay_id bigint, metadata string")
    return raw.select("replay_id", bundle.parse_summary().alias("doc"))


def test_both_imputations(spark):
    players = labelling.player_rows(documents(spark))
    gold1, gold3 = ladder.DIVISION_NAMES.index("GoldIDivision1"), ladder.DIVISION_NAMES.index("GoldIIIDivision2")
    middle = {(r.replay_id, r.player_name): (r.division_idx, r.rank_known) for r in labelling.impute_midpoint(players).collect()}
    assert middle == {(1, "known"): (gold1, True), (1, "guess"): (gold3, False), (2, "known"): (gold3, False), (2, "guess"): (gold3, False)}
    average = {(r.replay_id, r.player_name): (r.division_idx, r.rank_known) for r in labelling.impute_lobby_average(players).collect()}
    assert average == {(1, "known"): (gold1, True), (1, "guess"): (gold1, False), (2, "known"): (gold3, False), (2, "guess"): (gold3, False)}
    averages = {r.replay_id: r.average_division for r in labelling.average_division(documents(spark)).collect()}
    assert averages == {1: gold1, 2: gold3, 3: None}


def test_target_slots_sort_by_name(spark):
    rows = [(1, "b", 0, 10.0), (1, "a", 0, None), (1, "Z", 0, 30.0), (1, "q", 1, 40.0), (1, "c", 0, 99.0)]
    df = spark.createDataFrame(rows, "replay_id int, player_name string, team int, target_mmr double")
    got = labelling.target_slots(df).first()
    assert [got[f"t{i}"] for i in range(6)] == [30.0, 0.0, 10.0, 40.0, 0.0, 0.0]


def test_bundle_lines(spark, folder):
    good = '{"id":"11111111-2222-3333-4444-555555555555","data":' + SUMMARY % (1, RANK, RANK, "null") + "}"
    lines = [good, "", '{"id":"nope","data":{}}', '{"id": broken']
    bundle.write_bundle(spark.createDataFrame([(x,) for x in lines], "line string"), folder)
    counts = {r.line_class: r["count"] for r in bundle.line_class(bundle.read_bundle(spark, folder)).groupBy("line_class").count().collect()}
    assert counts == {"ok": 1, "bad_id": 1, "bad_json": 1}
    row = bundle.read_bundle(spark, folder).where("_bad IS NULL AND data.id = '1'").first()
    assert row.data.blue.players[0].rank.tier == 7 and row.data.orange is None


def test_average_rating_without_players(spark):
    replays = spark.createDataFrame([(1,), (2,)], "id bigint")
    players = spark.createDataFrame([(1, 0), (1, 84)], "replay_id bigint, division_idx int")
    got = {r.replay_id: r.avg_mmr for r in labelling.average_rating(replays, players).collect()}
    assert got == {1: (58 + 2200) / 2, 2: None}
    assert catalog.player_count_mismatch(replays, players.withColumn("player_name", F.lit("x"))).count() == 2
