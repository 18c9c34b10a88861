from helpers import column
from pyspark.sql import functions as F

from lobbylens.functions import ladder


def division(name):
    return ladder.DIVISION_NAMES.index(name)


def scan_bands(rating):
    """Brute force: walk the bands in order; below a band's minimum the previous one holds."""
    last = 0
    for i, (low, high) in enumerate(zip(ladder.BAND_MIN, ladder.BAND_MAX)):
        if rating < low:
            return last
        if rating <= high:
            return i
        last = i
    return len(ladder.BAND_MIN) - 1


def test_band_lookup_matches_the_scan_everywhere(spark):
    ratings = list(range(-100, 3001))
    found = column(spark, [float(r) for r in ratings], "double", ladder.band_index)
    assert found == [scan_bands(max(r, 0)) for r in ratings]
    assert all(a <= b for a, b in zip(found, found[1:]))


def test_band_lookup_named_values(spark):
    inputs = [-100.0, 0.0, 100.0, 1200.0, 1395.0, 1489.0, 1500.0, 1900.0, 2000.0, 3000.0, float("nan"), 1e12]
    names = [
        "BronzeIDivision1", "BronzeIDivision1", "BronzeIDivision1", "ChampionIIDivision1",
        "ChampionIIIDivision3", "GrandChampionIDivision2", "GrandChampionIDivision3",
        "SupersonicLegend", "SupersonicLegend", "SupersonicLegend", "BronzeIDivision1", "SupersonicLegend",
    ]
    assert column(spark, inputs, "double", ladder.band_index) == [division(n) for n in names]


def test_ratings_truncate_before_banding(spark):
    assert column(spark, [120.99, 121.0, None], "double", ladder.band_index) == [0, 1, None]


def test_min_max_middle(spark):
    d = [division(n) for n in ("BronzeIDivision1", "GrandChampionIIIDivision1", "SupersonicLegend")]
    assert column(spark, d, "int", ladder.division_min) == [0, 1706, 1883]
    assert column(spark, d, "int", ladder.division_max) == [117, 1739, 2000]
    assert column(spark, d, "int", ladder.division_middle) == [58, 1722, 2200]


def test_ladder_size_and_ranks(spark):
    assert len(ladder.DIVISION_NAMES) == len(ladder.BAND_MIN) == len(ladder.BAND_MAX) == 85
    assert len(ladder.RANK_NAMES) == 23
    ranks = column(spark, list(range(85)), "int", ladder.division_rank)
    assert ranks == [ladder.division_rank_index(i) for i in range(85)]
    assert ladder.division_dim(spark).count() == 85 and ladder.rank_dim(spark).count() == 23


def test_tier_and_division(spark):
    rows = [(22, None), (21, 1), (21, 2), (1, 1), (0, 1), (23, 1), (5, 9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t int, d int")
    got = [r.v for r in df.select("i", ladder.tier_division(F.col("t"), F.col("d")).alias("v")).orderBy("i").collect()]
    assert got == [84, 80, 81, 0, None, None, 19]


def test_rank_record(spark):
    rows = [
        ("supersonic-legend", 22, None), ("grand-champion-3", 21, 1), ("bronze-1", 1, 1),
        ("grand-champion", None, 3), ("grand-champion-2", None, 4), ("gold-1", 40, 1), ("?", None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, t int, d int")
    value = ladder.rank_info_division(F.col("n"), F.col("t"), F.col("d"))
    assert [r.v for r in df.select("i", value.alias("v")).orderBy("i").collect()] == [84, 80, 0, 73, 79, 0, 0]


def test_division_parse(spark):
    texts = ["SupersonicLegend", "Supersonic Legend", "Grand Champion III Division 1", "ssl", "gc3d1", "c2d3",
             "d1d4", "b1d1", "grandchampion3division1", "invalid_rank", "", None, "gc4d1"]
    want = [84, 84, 80, 84, 80, division("ChampionIIDivision3"), division("DiamondIDivision4"), 0, 80, None, None, None, None]
    assert column(spark, texts, "string", ladder.parse_division) == want


def test_every_division_spelling_round_trips(spark):
    everything = list(range(85))
    assert column(spark, ladder.DIVISION_NAMES, "string", ladder.parse_division) == everything
    assert column(spark, ladder.DIVISION_LABELS, "string", ladder.parse_division) == everything
    assert ladder.DIVISION_LABELS[84] == "Supersonic Legend"
    assert ladder.DIVISION_LABELS[80] == "Grand Champion III Division 1"
    assert ladder.DIVISION_LABELS[0] == "Bronze I Division 1"


def test_rank_parse(spark):
    texts = ["Bronze_1", "GRAND-CHAMPION-3", "supersonic_legend", "unranked", "grand_champion", "wood-1"]
    assert column(spark, texts, "string", ladder.parse_rank) == [1, 21, 22, 0, 19, None]


def test_rank_arithmetic(spark):
    def shift(name, k):
        return column(spark, [ladder.RANK_NAMES.index(name)], "int", lambda c: ladder.rank_name(ladder.rank_shift(c, k)))[0]

    assert [shift("bronze-1", k) for k in (3, 1, 5, 6)] == ["silver-1", "bronze-2", "silver-3", "gold-1"]
    assert shift("supersonic-legend", 1) == shift("champion-3", 5) == "supersonic-legend"
    assert shift("silver-1", -3) == "bronze-1" and shift("bronze-1", -5) == "unranked"
    assert column(spark, [-5, 0, 1, 4, 22, 100], "int", ladder.rank_from_index) == [0, 0, 1, 4, 22, 22]


def test_proxy_tables_differ_by_a_tier(spark):
    ranks = list(range(23))
    assert column(spark, ranks, "int", ladder.canonical_mmr)[:3] == [100.0, 130.0, 194.0]
    assert column(spark, ranks, "int", ladder.folder_proxy_mmr)[:3] == [0.0, 194.0, 257.0]
    assert column(spark, [21, 22, None], "int", ladder.folder_proxy_mmr) == [1913.0, 2200.0, 0.0]
