"""Check SQL building blocks: the domain relations again, for the checking database."""

from __future__ import annotations

from lobbylens.functions import ladder
from lobbylens.queries.registry import OFF_TIE


def text_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


LO = text_list(ladder.BAND_START)
MID = text_list(ladder.BAND_MIDDLE)
DIVISION_NAMES = text_list(ladder.DIVISION_NAMES)
DIVISION_LABELS = text_list(ladder.DIVISION_LABELS)
RANK_NAMES = text_list(ladder.RANK_NAMES)


def r6(x: str) -> str:
    return f"FLOOR(({x})*1000000.0E0 + {OFF_TIE}E0)/1000000.0E0"


def band(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN CAST(len(list_filter({LO}, lambda z: z <= TRUNC(GREATEST({x}, 0)))) - 1 AS INT) END)"


def rank_of(d: str) -> str:
    return f"CAST(CASE WHEN {d} < 84 THEN ({d}) // 4 + 1 WHEN {d} >= 84 THEN 22 END AS INT)"


def rank_of_rating(x: str) -> str:
    return rank_of(band(x))


def mid(d: str) -> str:
    return f"({MID}[{d} + 1])"


def division_name(d: str) -> str:
    return f"({DIVISION_NAMES}[{d} + 1])"


def division_label(d: str) -> str:
    return f"({DIVISION_LABELS}[{d} + 1])"


def rank_name(r: str) -> str:
    return f"({RANK_NAMES}[{r} + 1])"


def _literal(v) -> str:
    return f"'{v}'" if isinstance(v, str) else f"{v}E0" if isinstance(v, float) else str(v)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


MODES = "'ranked-standard','ranked-doubles','hoops'"

CTES = {
    "ranks": "SELECT * FROM (VALUES "
    + _values(
        (i, ladder.RANK_NAMES[i], ladder.CANONICAL_MMR[i], ladder.FOLDER_PROXY_MMR[i - 1] if i else 0.0)
        for i in range(ladder.RANK_COUNT)
    )
    + ") t(rank_index, rank_name, canonical_mmr, folder_mmr)",
    "ef": """SELECT user_id AS game_id, event_id, event_type, value,
  CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS frame_idx FROM events""",
    "fr": """SELECT game_id, frame_idx, event_id, event_type, frame_idx*0.25E0 AS time,
  CAST(300 - frame_idx*5 AS INT) AS seconds_remaining,
  CAST(event_id*2203 % 10240 - 5120 AS DOUBLE) AS bx, CAST(event_id*1709 % 10240 - 5120 AS DOUBLE) AS by_,
  CAST(event_id*97 % 2044 AS DOUBLE) AS bz, CAST(event_id*1511 % 9001 - 4500 AS DOUBLE) AS bvx,
  CAST(event_id*1129 % 9001 - 4500 AS DOUBLE) AS bvy, CAST(event_id*17 % 501 AS DOUBLE) AS bvz FROM ef""",
    "pf": """SELECT f.*, CAST(lane AS INT) AS lane, 'p' || ((lane*5 + game_id) % 6) || '_' || game_id AS name,
  CAST(lane // 3 AS INT) AS team,
  CAST((event_id*7919 + lane*104729) % 10240 - 5120 AS DOUBLE) AS px,
  CAST((event_id*6007 + lane*50021) % 10240 - 5120 AS DOUBLE) AS py,
  CAST((event_id*31 + lane*997) % 2044 AS DOUBLE) AS pz,
  CAST((event_id*4001 + lane*811) % 4601 - 2300 AS DOUBLE) AS vx,
  CAST((event_id*3307 + lane*613) % 4601 - 2300 AS DOUBLE) AS vy,
  CAST((event_id*101 + lane*37) % 301 - 150 AS DOUBLE) AS vz,
  ([0.0E0, 0.5E0, 0.1E0, -0.5E0, 0.7E0, 0.0E0])[CAST(lane AS INT) + 1] AS qx,
  ([0.0E0, 0.5E0, -0.7E0, 0.5E0, 0.1E0, 0.0E0])[CAST(lane AS INT) + 1] AS qy,
  ([0.0E0, 0.5E0, 0.1E0, 0.5E0, -0.7E0, 0.8E0])[CAST(lane AS INT) + 1] AS qz,
  ([1.0E0, 0.5E0, 0.7E0, 0.5E0, 0.1E0, 0.6E0])[CAST(lane AS INT) + 1] AS qw,
  ((event_id*13 + lane*29) % 101)/100.0E0 AS boost,
  (event_type = 'error' AND event_id % 6 = lane) AS is_demolished
  FROM fr f CROSS JOIN (SELECT UNNEST([0,1,2,3,4,5]) AS lane) s WHERE (event_id + lane) % 17 <> 0""",
    "goals": """SELECT game_id, frame_idx + CASE WHEN event_id % 13 = 0 THEN 1000 ELSE 0 END AS frame,
  CASE WHEN event_id % 4 = 3 THEN 'ghost' ELSE 'p' || ((((event_id % 2)*3 + event_id % 4)*5 + game_id) % 6) || '_' || game_id END AS player_name,
  CAST(event_id % 2 AS INT) AS player_team, event_id FROM ef WHERE event_type = 'purchase'""",
    "kickoffs": "SELECT game_id, frame_idx AS frame FROM ef WHERE event_type = 'signup' OR frame_idx = 0",
    "sp": """SELECT l_orderkey AS replay_id, CAST(l_linenumber % 6 AS INT) AS slot,
  CAST((l_linenumber % 6) // 3 AS INT) AS team,
  'p' || ((l_orderkey*31 + (l_linenumber % 6)*7) % 9973) AS player_name,
  CAST(l_suppkey % 4 AS INT) AS segment, l_suppkey AS platform_id, CAST(l_quantity AS BIGINT) AS quantity,
  l_returnflag <> 'R' AS known_here, CAST(FLOOR(l_extendedprice) AS BIGINT) AS price,
  CAST(FLOOR(l_extendedprice) AS BIGINT)/42.0E0 AS pred_mmr FROM lineitem""",
    "lp": f"""SELECT *, CASE WHEN rank_known THEN CAST({MID}[division_idx + 1] AS DOUBLE) END AS target_mmr FROM (
  SELECT replay_id, slot, CAST(slot // 3 AS INT) AS team,
  'p' || ((replay_id*31 + slot*7) % 9973) AS player_name,
  CAST((SUM(quantity)*37 + slot) % 85 AS INT) AS division_idx, MIN(known_here) AS rank_known,
  CAST(SUM(price) AS BIGINT)/(42.0E0*COUNT(*)) AS pred_mmr, COUNT(*) AS n_segments
  FROM sp GROUP BY replay_id, slot) t""",
    "known": f"""SELECT *, {rank_of_rating('target_mmr')} AS true_rank, {rank_of_rating('pred_mmr')} AS pred_rank
  FROM lp WHERE target_mmr > 0""",
    "rp": f"""SELECT id, created_at, download_status, playlist_raw,
  CASE WHEN REPLACE(LOWER(playlist_raw), '_', '-') IN ({MODES}) THEN REPLACE(LOWER(playlist_raw), '_', '-')
       ELSE 'ranked-standard' END AS game_mode,
  rank_index, {rank_name('rank_index')} AS rank, dataset_split, file_present FROM (
  SELECT o_orderkey AS id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'downloaded' WHEN 'O' THEN 'not_downloaded' ELSE 'failed' END AS download_status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ranked_standard' WHEN '2-HIGH' THEN 'Ranked-Doubles'
       WHEN '3-MEDIUM' THEN 'hoops' WHEN '5-LOW' THEN 'unknown_mode' END AS playlist_raw,
  CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 23 AS INT) AS rank_index,
  CASE WHEN o_orderkey % 3 = 0 THEN 'training' WHEN o_orderkey % 3 = 1 THEN 'evaluation' END AS dataset_split,
  o_orderkey % 7 <> 0 AS file_present FROM orders) t""",
    "bounds": """SELECT replay_id, MIN(division_idx) AS low, MAX(division_idx) AS high FROM lp GROUP BY replay_id""",
}
NEEDS = {
    "fr": ["ef"], "pf": ["fr"], "goals": ["ef"], "kickoffs": ["ef"], "lp": ["sp"], "known": ["lp"],
    "bounds": ["lp"],
}


def with_ctes(names: str, body: str, **extra: str) -> str:
    """`WITH` the named relations (and what they need), then extra ones, then the body."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body
