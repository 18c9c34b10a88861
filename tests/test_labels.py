from helpers import column
from pyspark.sql import functions as F

from lobbylens.functions import labels


def test_game_mode(spark):
    texts = ["ranked_standard", "Ranked-Doubles", "nope", None]
    assert column(spark, texts, "string", labels.game_mode) == ["ranked-standard", "ranked-doubles", None, None]
    assert column(spark, texts, "string", labels.game_mode_or_default)[2:] == ["ranked-standard"] * 2


def test_acceptance_order(spark):
    soccer = labels.SOCCER_GAME_TYPE
    rows = [
        (soccer, 3, 6, 13, None, None),
        (soccer, 3, 6, None, "TAGame.MatchType_PublicRanked_TA", None),
        ("TAGame.Replay_Hoops_TA", 2, 6, 13, None, "Hoops"),
        (soccer, None, 6, 13, None, "missing team size in replay header"),
        (soccer, 2, 6, 13, None, "2v2"),
        (soccer, 5, 6, 13, None, "team size 5"),
        (soccer, 3, 5, 13, None, "this lobby (5 players; expected 6 for 3v3)"),
        (soccer, 3, 6, 11, None, "ranked 2v2 (doubles)"),
        (soccer, 3, 6, 77, None, "this playlist (id 77)"),
        (soccer, 3, 6, None, "TAGame.MatchType_Private_TA", "private matches or custom games"),
        (soccer, 3, 6, None, "TAGame.MatchType_Public_TA", "casual or unranked online play"),
        (soccer, 3, 6, None, None, labels.UNCONFIRMED_MATCH),
    ]
    df = spark.createDataFrame(rows, "g string, s int, n int, p int, m string, want string")
    got = df.select("want", labels.reject_reason(*map(F.col, "gsnpm")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_url_parameter_is_replaced_once(spark):
    url = "https://x.example/api?after=cursor&max-rank=&min-rank=top&playlist=ranked"
    out = column(spark, [url], "string", lambda c: labels.url_set_param(c, "max-rank", F.lit("gold-1")))[0]
    assert out == "https://x.example/api?after=cursor&min-rank=top&playlist=ranked&max-rank=gold-1"
    bare = column(spark, ["https://x.example/a#top"], "string", lambda c: labels.url_set_param(c, "k", F.lit("v")))[0]
    assert bare == "https://x.example/a?k=v#top"
    twice = column(spark, ["http://x/y?a=1#b#c"], "string", lambda c: labels.url_set_param(c, "page", F.lit("2")))[0]
    assert twice == "http://x/y?a=1&page=2#b#c"


def test_names_ranges_epochs(spark):
    ranges = column(spark, ["150-300", "invalid", "abc-def"], "string", labels.frame_range)
    assert [r and (r["start"], r["end"]) for r in ranges] == [(150, 300), None, None]
    paths = ["checkpoint_epoch5", "checkpoint_epoch10.mpk", "/path/to/checkpoint_epoch25.mpk", "checkpoint_best"]
    assert column(spark, paths, "string", labels.checkpoint_epoch) == [5, 10, 25, None]
    assert column(spark, [0], "int", lambda c: labels.segment_file(c, c + 150)) == ["0-150.features"]


def test_clock_labels(spark):
    assert column(spark, [-3.0, 5.9, 65.0, 600.0], "double", labels.clock_label) == ["0:00", "0:05", "1:05", "10:00"]
    assert column(spark, [65.0], "double", lambda c: labels.clock_label(c, 2)) == ["01:05"]


def test_name_lists(spark):
    lists = [[], ["a"], ["a", "b"], ["a", "b", "c"]]
    assert column(spark, lists, "array<string>", labels.name_list) == ["", "a", "a and b", "a, b, and c"]


def test_rank_in_path(spark):
    paths = ["replays/ranked-standard/gold-2/x.replay", "a/b/c", "bronze-1/gold-2"]
    assert column(spark, paths, "string", labels.rank_in_path) == [8, None, 1]


def test_json_number_and_placeholder(spark):
    documents = ['{"sequence_length": 300}', "{}", "broken", None]
    assert column(spark, documents, "string", lambda c: labels.json_number(c, "$.sequence_length", 150)) == [300, 150, 150, 150]
    assert column(spark, ["", None, "Al"], "string", lambda c: labels.placeholder_name(c, F.lit(7))) == ["Player_7", "Player_7", "Al"]


def test_verdict(spark):
    df = spark.createDataFrame([([], 1), (["Al"], 0), (["Al", "Bo"], 0)], "n array<string>, k int")
    lines = [r.v for r in df.select(labels.verdict_line(F.col("n"), F.lit(58.0), F.col("k")).alias("v")).collect()]
    assert lines == ["Nobody stood out: plain Bronze I.", "Al played well above this lobby.",
                     "Al and Bo played well above this lobby."]


def test_verdict_pools_by_tier(spark):
    df = spark.createDataFrame([(50.0, 0), (1000.0, 0), (1600.0, 1), (1900.0, 0)], "m double, k long")
    names = F.array().cast("array<string>")
    lines = [r.v for r in df.select(labels.verdict_line(names, F.col("m"), F.col("k")).alias("v")).collect()]
    assert lines == ["An even Bronze I lobby, all of them still learning.", "A fair Diamond III match, close all the way.",
                     "High level, and Grand Champion II on every seat.", "Nowhere left to hide: all Supersonic Legend."]
