"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from lobbylens.plans import segments as sg
from lobbylens.queries import collect
from lobbylens.queries import frames as fq
from lobbylens.sources import tables as t

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def queries():
    return collect()[0]


def test_feature_plan_has_only_equi_joins(spark, queries):
    text = plan(queries["feature_vector"](spark, SF))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text and "Python" not in text


def test_wide_frames_are_shuffled_twice(spark, queries):
    """`players`, or the six cars made of it, pass two exchanges: by chunk and by segment."""
    import re

    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        execution = queries["feature_vector"](spark, SF)._jdf.queryExecution()
        text = execution.explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    exchanges = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: (.*)", text)
    wide = [how for columns, how in exchanges if "players#" in columns or "p0#" in columns]
    assert len(exchanges) > 5 and len(wide) == 2
    assert "_chunk" in wide[1] and "segment" in wide[0] or "_chunk" in wide[0] and "segment" in wide[1]
    assert "SinglePartition" not in text


def test_band_lookup_needs_no_join(spark, queries):
    assert "Join" not in plan(queries["mmr_band_lookup"](spark, SF))


@pytest.mark.parametrize("name", ["balanced_k", "roster", "first_replays_per_rank", "capped_sample"])
def test_group_limits_run_before_the_shuffle(spark, queries, name):
    assert "WindowGroupLimit" in plan(queries[name](spark, SF))


def test_scans_are_pruned(spark, queries):
    text = plan(queries["catalog_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull" in text
    assert "o_custkey" not in plan(queries["count_by_rank_status"](spark, SF))


def test_lobby_outliers_scan_once(spark, queries):
    assert plan(queries["lobby_outlier"](spark, SF)).count("FileScan parquet") == 1


def test_labels_need_no_join(spark, queries):
    assert "Join" not in plan(queries["impute_lobby_average"](spark, SF))


@pytest.mark.parametrize("name", ["running_score", "goal_window_exclusion", "ema", "locf", "sticky_split", "tail_split", "segment_median"])
def test_scans_never_partition_rows_by_the_bare_key(spark, queries, name):
    """Windows over a bare key (or over everything) only see per-chunk totals."""
    import re

    text = plan(queries[name](spark, SF))
    for line in re.findall(r"Window \[.*", text):
        if "_chunk" not in line and "_t_" not in line and "_range" not in line:
            raise AssertionError(line[:200])


def test_no_cross_joins_anywhere(spark, queries):
    skip = {"stream_ingest", "stream_ingest_quota", "status_latest", "stream_progress", "stream_segments", "stream_features",
            "segment_write", "incremental_segments", "link_resolve", "sustained_outlier", "oversample"}
    bad = [n for n, q in queries.items() if n not in skip
           and any(w in plan(q(spark, SF)) for w in ("NestedLoopJoin", "CartesianProduct"))]
    assert not bad


def test_missing_games_reads_no_blocks(spark, folder):
    import re

    rows = [(1, 0, 0, [[0.5]] * 3, 0, 3, "ranked-standard", "gold-1")]
    packed = spark.createDataFrame(rows, "game_id long, segment long, slot int, frames array<array<float>>, start long, end long, game_mode string, rank string")
    sg.write_segments(packed, f"{folder}/store")
    todo = sg.missing_games(spark.range(3).withColumnRenamed("id", "game_id"), sg.read_segments(spark, f"{folder}/store", 3))
    assert "frames" not in "".join(re.findall("ReadSchema: .*", plan(todo))) and sorted(r.game_id for r in todo.collect()) == [0, 2]


def test_frames_are_bounded_per_chunk(spark):
    counted = t.event_frames(spark, SF).groupBy("game_id").agg(F.max("frame_idx").alias("m"), F.count("*").alias("n"))
    assert counted.where("m + 1 <> n").count() == 0 and fq.L == 10


def test_listings_read_no_content(spark, folder):
    """The listing reads names and lengths; blocks of another length are left out before they are read."""
    from lobbylens.sources import blocks, inventory

    rows = spark.createDataFrame([("replays/m/r/a.replay", bytearray(b"123")), ("replays/m/r/b.features", bytearray(8))], "path string, content binary")
    assert inventory.write_files(rows, folder) == 2
    text = plan(inventory.list_replay_files(spark, folder))
    assert "content" not in text.split("ReadSchema")[1]
    assert "EqualTo(length,8)" in plan(blocks.read_blocks(spark, folder, 2))


def test_build_outcomes(spark, folder):
    """Each class in the order of its checks; the counts come from the write itself."""
    replays = spark.createDataFrame([(i, f"p{i}", "m", "r") for i in range(7)], "id long, file_path string, game_mode string, rank string")
    ids = lambda name, *xs: spark.createDataFrame([(x,) for x in xs], f"{name} long")
    files = spark.createDataFrame([(f"p{i}",) for i in (0, 1, 3, 4, 5, 5, 6)], "path string")
    parsed = spark.createDataFrame([(3, True), (4, False), (5, False), (5, False), (0, False)], "id long, is_bad boolean")
    out = sg.build_outcomes(replays, ids("replay_id", 1, 2, 3, 4, 5, 5, 6), ids("game_id", 1, 0), files, parsed, ids("game_id", 5, 5, 0))
    counts = sg.write_outcomes(out, f"{folder}/plan")
    assert counts == {"no_players": 1, "cached": 1, "read_error": 1, "parse_error": 2, "no_frames": 1, "built": 1}
    got = {r.id: r.outcome for r in spark.read.parquet(f"{folder}/plan").collect()}
    assert got == {0: "no_players", 1: "cached", 2: "read_error", 3: "parse_error", 4: "no_frames", 5: "built", 6: "parse_error"}
