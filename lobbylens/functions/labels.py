"""Text rules: mode names, match acceptance, paths, clocks, names and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lobbylens.functions import ladder

# Playlist names.
GAME_MODES = [
    "unranked-duels", "unranked-doubles", "unranked-standard", "unranked-chaos", "private",
    "season", "offline", "ranked-duels", "ranked-doubles", "ranked-solo-standard",
    "ranked-standard", "snowday", "rocketlabs", "hoops", "rumble", "tournament", "dropshot",
    "ranked-hoops", "ranked-rumble", "ranked-dropshot", "ranked-snowday", "dropshot-rumble",
    "heatseeker",
]
DEFAULT_GAME_MODE = "ranked-standard"

# Label of a header without a game type.
UNKNOWN_GAME_TYPE = "unknown game type"
# The one accepted game type and playlist, and the labels shown for others.
SOCCER_GAME_TYPE = "TAGame.Replay_Soccar_TA"
RANKED_STANDARD_PLAYLIST = 13
GAME_TYPE_LABELS = [
    ("Hoops", "Hoops"), ("Dropshot", "Dropshot"), ("Snow", "Snow Day"), ("Rumble", "Rumble"),
    ("Heatseeker", "Heatseeker"), ("Breakout", "Breakout"),
]
PLAYLIST_LABELS = {
    1: "casual 1v1", 2: "casual 2v2", 3: "casual 3v3 standard", 10: "ranked 1v1 (duels)",
    11: "ranked 2v2 (doubles)", 12: "ranked solo standard 3v3", 15: "Snow Day", 16: "Snow Day",
    17: "Rocket Labs", 18: "Rocket Labs", 25: "Hoops", 26: "Hoops", 27: "Rumble", 28: "Rumble",
    29: "Dropshot", 30: "Dropshot", 31: "Heatseeker", 32: "Heatseeker",
}
UNCONFIRMED_MATCH = "this match (ranked standard 3v3 could not be confirmed in the replay header)"

UUID_PATTERN = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID_PATTERN), F.lit(False))


def game_mode(text: Column) -> Column:
    """Playlist spelling -> canonical name, NULL when unknown."""
    name = F.replace(F.lower(text), F.lit("_"), F.lit("-"))
    return F.when(name.isin(GAME_MODES), name)


def game_mode_or_default(text: Column) -> Column:
    return F.coalesce(game_mode(text), F.lit(DEFAULT_GAME_MODE))


def game_type_label(game_type: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for part, label in GAME_TYPE_LABELS:
        chain = chain.when(game_type.contains(part), F.lit(label))
    return chain.otherwise(game_type)


def team_size_label(size: Column) -> Column:
    return (
        F.when(size.isin(1, 2, 4), F.concat(size.cast("string"), F.lit("v"), size.cast("string")))
        .otherwise(F.concat(F.lit("team size "), size.cast("string")))
    )


def playlist_label(playlist: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for number, label in PLAYLIST_LABELS.items():
        chain = chain.when(playlist == number, F.lit(label))
    return chain.otherwise(F.concat(F.lit("this playlist (id "), playlist.cast("string"), F.lit(")")))


def match_type_label(match_type: Column) -> Column:
    """Label of a match whose type does not mark it as ranked."""
    return (
        F.when(match_type.isNull(), F.lit(UNCONFIRMED_MATCH))
        .when(match_type.contains("Private"), F.lit("private matches or custom games"))
        .when(match_type.contains("Public"), F.lit("casual or unranked online play"))
        .otherwise(F.concat(F.lit("this match type ("), match_type, F.lit(")")))
    )


def reject_reason(game_type, team_size, player_count, playlist, match_type) -> Column:
    """Ordered acceptance checks; NULL accepts the match."""
    wrong_count = F.concat(
        F.lit("this lobby ("), player_count.cast("string"), F.lit(" players; expected 6 for 3v3)")
    )
    ranked = F.coalesce(match_type.contains("PublicRanked"), F.lit(False))
    return (
        F.when(game_type.isNull(), F.lit(UNKNOWN_GAME_TYPE))
        .when(game_type != SOCCER_GAME_TYPE, game_type_label(game_type))
        .when(team_size.isNull(), F.lit("missing team size in replay header"))
        .when(team_size != 3, team_size_label(team_size))
        .when(player_count != 6, wrong_count)
        .when(playlist == RANKED_STANDARD_PLAYLIST, F.lit(None).cast("string"))
        .when(playlist.isNotNull(), playlist_label(playlist))
        .when(~ranked, match_type_label(match_type))
    )


def rejection_message(reason: Column) -> Column:
    # The sentence around the reason.
    return F.concat(
        F.lit("We currently do not support "),
        reason,
        F.lit(" — only ranked 3v3 standard is supported at this time."),
    )


def replay_path(mode: Column, rank_folder: Column, replay_id: Column) -> Column:
    return F.concat(
        F.concat_ws("/", F.lit("replays"), mode, rank_folder, replay_id.cast("string")), F.lit(".replay")
    )


def segment_folder(version: Column, mode: Column, rank_folder: Column, replay_id: Column) -> Column:
    return F.concat_ws("/", F.lit("segments"), version, mode, rank_folder, replay_id.cast("string"))


def segment_file(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), end.cast("string"), F.lit(".features"))


def frame_range(stem: Column) -> Column:
    """`a-b` -> struct<start,end>, NULL for anything else."""
    start = F.regexp_extract(stem, r"^(\d+)-(\d+)$", 1).try_cast("bigint")
    end = F.regexp_extract(stem, r"^(\d+)-(\d+)$", 2).try_cast("bigint")
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def checkpoint_epoch(path: Column) -> Column:
    return F.regexp_extract(path, r"checkpoint_epoch(\d+)(?:\.[A-Za-z0-9]+)?$", 1).try_cast("int")


def rank_in_path(path: Column) -> Column:
    """Rank index of the first path component that names a rank, else NULL."""
    ranks = F.filter(
        F.transform(F.split(path, "/"), lambda part: ladder.parse_rank(part)), lambda r: r.isNotNull()
    )
    return F.get(ranks, F.lit(0))


def _whole_seconds(seconds: Column) -> Column:
    return F.floor(F.greatest(seconds, F.lit(0.0))).cast("bigint")


def clock_label(seconds: Column, minute_digits: int = 1) -> Column:
    """Seconds -> m:ss (or mm:ss); negative times read as zero."""
    whole = _whole_seconds(seconds)
    return F.format_string(
        f"%0{minute_digits}d:%02d", F.floor(whole / 60).cast("bigint"), F.pmod(whole, F.lit(60))
    )


def url_set_param(url: Column, key: str, value: Column) -> Column:
    """Drop every `key` pair of the query, append one, keep the rest in order."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    fragment = F.when(F.instr(url, "#") > 0, F.substr(url, F.length(bare) + 2))
    base = F.split_part(bare, F.lit("?"), F.lit(1))
    query = F.substr(bare, F.length(base) + 2)
    kept = F.filter(
        F.split(query, "&"), lambda pair: (pair != "") & (F.split_part(pair, F.lit("="), F.lit(1)) != key)
    )
    pairs = F.array_append(kept, F.concat(F.lit(key + "="), value))
    return F.concat(
        base, F.lit("?"), F.array_join(pairs, "&"), F.coalesce(F.concat(F.lit("#"), fragment), F.lit(""))
    )


def json_number(document: Column, path: str, default) -> Column:
    return F.coalesce(F.get_json_object(document, path).try_cast("int"), F.lit(default))


def placeholder_name(name: Column, actor_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Player_"), actor_id.cast("string")))


def team_code(number: Column) -> Column:
    """0 blue, 1 orange; larger numbers alternate."""
    return F.pmod(number, F.lit(2)).cast("int")


def name_list(names: Column) -> Column:
    """`a`, `a and b`, `a, b, and c`; empty text for no names."""
    n = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    tail = F.get(names, n - 1)
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.get(names, F.lit(0)))
        .when(n == 2, F.concat(head, F.lit(" and "), tail))
        .otherwise(F.concat(head, F.lit(", and "), tail))
    )


# Verdict templates are free text; pass other pools to verdict_line as needed.
ONE_SUSPECT = [
    "{name} played well above this lobby.",
    "Keep an eye on {name}: the numbers belong to a higher rank.",
    "{name} made this lobby look slow.",
]
MANY_SUSPECTS = [
    "{names} played well above this lobby.",
    "Keep an eye on {names}: their numbers belong to a higher rank.",
]
# By the tier that the lobby median falls into.
NO_SUSPECT = {
    "Bronze": ["An even {tier} lobby, all of them still learning.", "Nobody stood out: plain {tier}."],
    "Silver": ["An even {tier} lobby.", "Six honest {tier} players."],
    "Gold": ["An even {tier} lobby, no hidden talent.", "Everyone here is as {tier} as it says."],
    "Platinum": ["A fair {tier} match.", "Nobody rose above {tier} in this one."],
    "Diamond": ["A fair {tier} match, close all the way.", "Sharp, but {tier} throughout."],
    "Champion": ["A clean {tier} match.", "All six belong in {tier}."],
    "Grand Champion": ["A clean {tier} match, fast and fair.", "High level, and {tier} on every seat."],
    "Supersonic Legend": ["Nowhere left to hide: all {tier}.", "The top of the ladder, {tier} for everyone."],
}


def _template(pool: list[str], pick: Column) -> Column:
    quoted = ",".join("'" + t.replace("'", "\\'") + "'" for t in pool)
    return F.get(F.expr(f"array({quoted})"), F.pmod(pick, F.lit(len(pool))).cast("int"))


def verdict_line(names: Column, lobby_median: Column, pick: Column) -> Column:
    """One line per lobby: the pool comes from the suspects and the band of the median, the template
    from a number, not from a dice roll."""
    tier = F.element_at(
        F.split(ladder.division_label(ladder.band_index(lobby_median)), " Division "), 1
    )
    even = F.lit(None).cast("string")
    for start, pool in NO_SUSPECT.items():
        even = F.when(F.startswith(tier, F.lit(start)), _template(pool, pick)).otherwise(even)
    n = F.size(names)
    return (
        F.when(n == 0, F.replace(even, F.lit("{tier}"), tier))
        .when(n == 1, F.replace(_template(ONE_SUSPECT, pick), F.lit("{name}"), F.get(names, F.lit(0))))
        .otherwise(F.replace(_template(MANY_SUSPECTS, pick), F.lit("{names}"), name_list(names)))
    )
