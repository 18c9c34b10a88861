"""A cross-section of the registered queries against their check SQL (all: tools/check.py)."""

import duckdb
import pytest

import __spark_entry__ as entry
from lobbylens.queries import collect

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
PICKED = [
    "lobby_outlier", "json_struct_parse", "acceptance_policy", "rank_info_resolve", "status_reconcile_counters",
    "impute_lobby_average", "goal_window_exclusion", "next_event_asof", "feature_vector", "segment_pack",
    "sustained_outlier", "link_resolve", "segment_median", "composite_loss", "capped_sample", "sticky_split",
    "label_jitter", "hash_coin", "ridge_eval", "metrics_json", "stream_ingest", "stream_features", "stream_ingest_quota",
    "status_latest", "skip_classes", "built_segments", "ball_goal_windows", "feature_vector_rated", "block_files", "replay_listing",
]


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return db


def by_name(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert by_name([tuple(r) for r in df.collect()], df.columns) == by_name(cursor.fetchall(), names)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(collect()[0]) <= set(entry.queries())
    queries, oracles = collect()
    assert set(oracles) <= set(queries) and len(queries) >= 130
    assert set(queries) == set(oracles)
