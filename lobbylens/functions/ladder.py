"""The skill ladder: 85 divisions, 23 ranks and the rating bands behind them.

Every lookup is a literal array or map inside the expression, so a rating
column is labelled in the scan stage without any join.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lower bound of each division band, lowest division first.
BAND_MIN = [
    0, 121, 138, 157, 175, 180, 203, 217, 234, 240, 261, 277,
    280, 300, 318, 337, 340, 360, 378, 397, 400, 419, 438, 457,
    460, 479, 498, 517, 520, 539, 558, 577, 580, 580, 580, 637,
    640, 659, 640, 640, 715, 719, 738, 757, 760, 760, 760, 760,
    835, 820, 820, 892, 915, 924, 900, 972, 980, 980, 980, 980,
    1075, 1095, 1128, 1162, 1195, 1215, 1248, 1282, 1315, 1335, 1369, 1402,
    1436, 1460, 1498, 1537, 1575, 1600, 1645, 1677, 1706, 1746, 1794, 1810,
    1883,
]
# Upper bound of each division band.
BAND_MAX = [
    117, 130, 156, 174, 178, 194, 215, 234, 238, 257, 275, 294,
    298, 317, 336, 354, 358, 377, 396, 415, 418, 437, 456, 474,
    478, 497, 516, 534, 538, 557, 576, 590, 598, 617, 636, 654,
    658, 677, 696, 714, 718, 737, 756, 774, 778, 797, 816, 834,
    843, 867, 891, 914, 923, 947, 971, 994, 1003, 1027, 1051, 1074,
    1093, 1127, 1160, 1180, 1213, 1247, 1271, 1300, 1333, 1366, 1401, 1419,
    1458, 1497, 1535, 1561, 1598, 1636, 1660, 1708, 1739, 1780, 1809, 1882,
    2000,
]
# Fixed value: the open-ended top band has no meaningful midpoint of its own.
TOP_MIDDLE = 2200

# Canonical rating per rank index 0..22 (unranked first).
CANONICAL_MMR = [
    100.0, 130.0, 194.0, 257.0, 321.0, 386.0, 451.0, 516.0, 580.0, 644.0, 709.0, 773.0,
    837.0, 902.0, 966.0, 1030.0, 1127.0, 1258.0, 1388.0, 1520.0, 1651.0, 1782.0, 2200.0,
]
# Thresholds between the 22 ranked tiers, lowest first.
ORDINAL_BOUNDARIES = [
    194.0, 257.0, 321.0, 386.0, 451.0, 516.0, 580.0, 644.0, 709.0, 773.0, 837.0,
    902.0, 966.0, 1030.0, 1127.0, 1258.0, 1388.0, 1520.0, 1651.0, 1782.0, 2200.0,
]
# Folder-name proxy ratings, one per ranked tier, lowest first.
FOLDER_PROXY_MMR = [
    194.0, 257.0, 321.0, 386.0, 451.0, 516.0, 580.0, 644.0, 709.0, 773.0, 837.0,
    902.0, 966.0, 1030.0, 1127.0, 1258.0, 1388.0, 1520.0, 1651.0, 1782.0, 1913.0, 2200.0,
]

TIERS = ["bronze", "silver", "gold", "platinum", "diamond", "champion", "grand-champion"]
ROMAN = ["I", "II", "III"]
TOP_RANK = "supersonic-legend"
DIVISION_COUNT = 85
RANK_COUNT = 23

RANK_NAMES = ["unranked"] + [f"{t}-{n}" for t in TIERS for n in (1, 2, 3)] + [TOP_RANK]
RANK_LABELS = (
    ["Unranked"]
    + [f"{t.replace('-', ' ').title()} {n}" for t in TIERS for n in (1, 2, 3)]
    + ["Supersonic Legend"]
)


def _camel(tier: str) -> str:
    return tier.replace("-", " ").title().replace(" ", "")


DIVISION_NAMES = [
    f"{_camel(t)}{r}Division{d}" for t in TIERS for r in ROMAN for d in (1, 2, 3, 4)
] + ["SupersonicLegend"]
DIVISION_LABELS = [
    f"{t.replace('-', ' ').title()} {r} Division {d}" for t in TIERS for r in ROMAN for d in (1, 2, 3, 4)
] + ["Supersonic Legend"]

# Bands overlap and leave gaps, so the effective start of a band is the end of
# the one below plus one, or its own minimum if that lies higher.
BAND_START = [BAND_MIN[0]] + [max(lo, hi + 1) for lo, hi in zip(BAND_MIN[1:], BAND_MAX)]
BAND_MIDDLE = [(lo + hi) // 2 for lo, hi in zip(BAND_MIN, BAND_MAX)][:-1] + [TOP_MIDDLE]

TOP_START = BAND_START[-1]


def division_rank_index(division: int) -> int:
    return division // 4 + 1 if division < DIVISION_COUNT - 1 else RANK_COUNT - 1


def _sql_array(values, suffix: str = "") -> str:
    quoted = [f"'{v}'" if isinstance(v, str) else f"{v}{suffix}" for v in values]
    return f"array({','.join(quoted)})"


@lru_cache(maxsize=1)
def _band_by_rating_sql() -> str:
    """Division index for every whole rating 0..TOP_START, built from BAND_START."""
    band, out = 0, []
    for rating in range(TOP_START + 1):
        while band + 1 < DIVISION_COUNT and BAND_START[band + 1] <= rating:
            band += 1
        out.append(band)
    return _sql_array(out)


def _pick(values, index: Column, suffix: str = "") -> Column:
    """values[index]; NULL when the index is NULL or outside the list."""
    return F.get(F.expr(_sql_array(values, suffix)), index)


def whole_rating(mmr: Column) -> Column:
    """Truncate a rating toward zero, with NaN as 0 and out-of-range values held
    at the ends of the ladder (an ANSI cast would raise on them)."""
    value = F.nanvl(mmr.cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(value, F.lit(float(TOP_START)))).cast("int")


def band_index(mmr: Column) -> Column:
    """Rating -> division index 0..84. One array access, no range join."""
    found = F.get(F.expr(_band_by_rating_sql()), whole_rating(mmr))
    return F.when(mmr.isNotNull(), found)


def division_min(division: Column) -> Column:
    return _pick(BAND_MIN, division)


def division_max(division: Column) -> Column:
    return _pick(BAND_MAX, division)


def division_middle(division: Column) -> Column:
    return _pick(BAND_MIDDLE, division)


def division_name(division: Column) -> Column:
    return _pick(DIVISION_NAMES, division)


def division_label(division: Column) -> Column:
    return _pick(DIVISION_LABELS, division)


def division_rank(division: Column) -> Column:
    """Division index -> rank index 1..22."""
    top = DIVISION_COUNT - 1
    return F.when(division < top, F.floor(division / 4).cast("int") + 1).when(
        division >= top, F.lit(RANK_COUNT - 1)
    )


def rating_rank(mmr: Column) -> Column:
    """Rating -> rank index, always through the band so that metrics and labels agree."""
    return division_rank(band_index(mmr))


def rank_name(rank: Column) -> Column:
    return _pick(RANK_NAMES, rank)


def rank_label(rank: Column) -> Column:
    return _pick(RANK_LABELS, rank)


def canonical_mmr(rank: Column) -> Column:
    return _pick(CANONICAL_MMR, rank, "D")


def folder_proxy_mmr(rank: Column) -> Column:
    """Proxy rating of a rank folder; 0.0 marks an unknown or unranked folder."""
    ranked = F.when(rank > 0, _pick(FOLDER_PROXY_MMR, rank - 1, "D"))
    return F.coalesce(ranked, F.lit(0.0))


def _rank_map() -> Column:
    pairs = ",".join(f"'{name}',{i}" for i, name in enumerate(RANK_NAMES))
    # The stored enum still knows an undivided grand champion.
    return F.expr(f"map({pairs},'grand-champion',{RANK_NAMES.index('grand-champion-1')})")


def parse_rank(text: Column) -> Column:
    """Any spelling of a rank name -> rank index, NULL when it is not one."""
    return F.try_element_at(_rank_map(), F.replace(F.lower(text), F.lit("_"), F.lit("-")))


_SHORT = r"^(gc|c|d|p|g|s|b)([1-3])d([1-4])$"
_LONG = r"^(grandchampion|champion|diamond|platinum|gold|silver|bronze)(iii|ii|i|[123])division([1-4])$"


def parse_division(text: Column) -> Column:
    """Division spelling, short (`gc3d1`) or long, -> division index or NULL."""
    plain = F.translate(F.lower(text), " -_", "")
    shorts = {"b": 0, "s": 1, "g": 2, "p": 3, "d": 4, "c": 5, "gc": 6}
    longs = {t.replace("-", ""): i for i, t in enumerate(TIERS)}
    steps = {"1": 0, "2": 1, "3": 2, "i": 0, "ii": 1, "iii": 2}

    def position(pattern, names):
        tier = F.try_element_at(_text_map(names), F.regexp_extract(plain, pattern, 1))
        step = F.try_element_at(_text_map(steps), F.regexp_extract(plain, pattern, 2))
        return tier * 12 + step * 4 + F.regexp_extract(plain, pattern, 3).try_cast("int") - 1

    return F.coalesce(
        F.when(plain.isin("ssl", "supersoniclegend"), F.lit(DIVISION_COUNT - 1)),
        F.when(plain.rlike(_SHORT), position(_SHORT, shorts)),
        F.when(plain.rlike(_LONG), position(_LONG, longs)),
    )


def _text_map(mapping: dict) -> Column:
    return F.expr("map(" + ",".join(f"'{k}',{v}" for k, v in mapping.items()) + ")")


def tier_division(tier: Column, division: Column) -> Column:
    """Tier 1..22 and division (missing = 1, held to 1..4) -> division index."""
    step = F.greatest(F.lit(1), F.least(F.coalesce(division, F.lit(1)), F.lit(4)))
    return F.when(tier == 22, F.lit(DIVISION_COUNT - 1)).when(
        (tier >= 1) & (tier <= 21), (tier - 1) * 4 + step - 1
    )


def rank_info_division(rank_id: Column, tier: Column, division: Column) -> Column:
    """A rank record {id, tier, division} -> division index, never NULL."""
    grand = [
        (rank_id == f"grand-champion-{n}", tier_division(F.lit(18 + n), division)) for n in (1, 2, 3)
    ]
    by_id = F.when(rank_id == "grand-champion", F.lit(DIVISION_NAMES.index("GrandChampionIDivision2")))
    for condition, value in grand:
        by_id = by_id.when(condition, value)
    by_id = by_id.when(rank_id == TOP_RANK, F.lit(DIVISION_COUNT - 1))
    fallback = tier_division(F.coalesce(tier, F.lit(1)), division)
    return F.coalesce(tier_division(tier, division), by_id, fallback, F.lit(0)).cast("int")


def rank_from_index(index: Column) -> Column:
    """Any integer -> rank index, held to 0..22."""
    return F.greatest(F.lit(0), F.least(index, F.lit(RANK_COUNT - 1)))


def rank_shift(rank: Column, offset) -> Column:
    return rank_from_index(rank + offset)


def division_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (i, DIVISION_NAMES[i], DIVISION_LABELS[i], BAND_MIN[i], BAND_MAX[i], BAND_START[i],
         BAND_MIDDLE[i], division_rank_index(i))
        for i in range(DIVISION_COUNT)
    ]
    return spark.createDataFrame(
        rows,
        "division_idx int, division_name string, division_label string, mmr_min int, mmr_max int, "
        "mmr_start int, mmr_middle int, rank_index int",
    )


def rank_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (i, RANK_NAMES[i], RANK_LABELS[i], CANONICAL_MMR[i], FOLDER_PROXY_MMR[i - 1] if i else 0.0)
        for i in range(RANK_COUNT)
    ]
    return spark.createDataFrame(
        rows,
        "rank_index int, rank_name string, rank_label string, canonical_mmr double, folder_mmr double",
    )
