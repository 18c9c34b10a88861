"""The document operators as checked queries: thin columns over the operators' results."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

import corpus_pipeline
from lobbylens.llm.decontaminate import contamination
from lobbylens.llm.exact import exact_groups
from lobbylens.llm.jaccard import near_duplicates
from lobbylens.llm.language import identify_languages
from lobbylens.llm.manifest import merkle_manifest
from lobbylens.llm.packing import pack
from lobbylens.llm.quality import quality_scores
from lobbylens.llm.repeats import without_repeats
from lobbylens.llm.search import ranked_search
from lobbylens.llm.shards import hilbert_shards
from lobbylens.llm.suffixes import without_repeated_bytes
from lobbylens.llm.tokenfiles import token_files
from lobbylens.llm.viterbi import token_counts
from lobbylens.queries.registry import Registry
from lobbylens.sources.tables import table

R = Registry()

ASCII_LOWER = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# CRC-32 byte by byte over a table made by its rule, and the curve as list folds.
CRC_TABLE = """SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)) x"""
STEPS = [(1 << b, i + 1) for b in range(5, 0, -1) for i in range(3)]
TURN = "CASE WHEN x[s[2]] & s[1] <> 0 THEN s[1] - 1 ELSE xor(x[1], x[s[2]]) & (s[1] - 1) END"
UNDO = f"""list_reduce(list_prepend(cells, {[list(s) for s in STEPS]}), lambda x, s: list_transform(x, lambda v, k:
  CASE WHEN k = 1 OR (k = s[2] AND x[s[2]] & s[1] = 0) THEN xor(v, {TURN}) ELSE v END))"""
FLIP = " ".join(f"xor(CASE WHEN g3 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END," for b in range(5, 0, -1)) + " 0" + ")" * 5
WOVEN = " + ".join(
    f"(CASE WHEN xor(g{i}, flip) & {1 << b} <> 0 THEN {1 << (3 * b + 3 - i)} ELSE 0 END)" for b in range(5, -1, -1) for i in (1, 2, 3)
)


def cell_sql(column: str) -> str:
    return f"""SELECT {column} AS value, CAST(least(floor((sum(n) OVER (ORDER BY {column} NULLS FIRST) - n + n/2)*64/sum(n) OVER ()), 63) AS BIGINT)
      AS cell FROM (SELECT {column}, count(*) AS n FROM documents GROUP BY {column}) x"""


@R.add(
    "op1_hilbert_shards",
    f"""
    WITH t AS ({CRC_TABLE}), lc AS ({cell_sql('lang')}), sc AS ({cell_sql('source')}),
    d AS (SELECT doc_id, lang, source, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
    b AS (SELECT d.*, list_transform(range(size - 1), lambda i: CAST('0x' || h[2*i + 1:2*i + 2] AS BIGINT)) AS bytes FROM d),
    c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes),
            lambda c, v: xor(c >> 8, tab[(xor(c, v) & 255) + 1])), 4294967295) AS text_crc32,
          [lc.cell, sc.cell, CAST(floor(ln(size)/ln(2)*2) AS BIGINT)] AS cells
          FROM b, t, lc, sc WHERE b.lang IS NOT DISTINCT FROM lc.value AND b.source IS NOT DISTINCT FROM sc.value),
    u AS (SELECT *, {UNDO} AS x FROM c),
    g AS (SELECT *, x[1] AS g1, xor(x[1], x[2]) AS g2, xor(xor(x[1], x[2]), x[3]) AS g3 FROM u),
    f AS (SELECT *, {FLIP} AS flip FROM g),
    w AS (SELECT *, {WOVEN} AS hilbert FROM f),
    r AS (SELECT *, row_number() OVER (ORDER BY hilbert, doc_id, text_crc32, size) - 1 AS rank, count(*) OVER () AS total FROM w)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, CAST(hilbert AS BIGINT) AS hilbert, 'rows' AS law,
           CAST(rank*16 // total AS INT) AS shard, rank - (CAST(rank*16 // total AS BIGINT)*total + 15) // 16 AS slot, CAST(NULL AS INT) AS grown_shard
    FROM r
    """,
)
def op1(spark, sf_dir):
    return hilbert_shards(table(spark, sf_dir, "documents"))


@R.add("op2_neighbour_quality")
def op2(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")


@R.add(
    "op3_ngram_jaccard_join",
    rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '{WORD}') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[a:a + 4], ' ') AS g
          FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS a FROM d WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
    FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
    """,
)
def op3(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("key", "kept")


@R.add(
    "op4_lempel_ziv_repeats",
    rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
    w AS (SELECT doc_id, a, md5(array_to_string(ws[a:a + 49], ' ')) AS t
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS a FROM d)),
    f AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
    h AS (SELECT DISTINCT doc_id, unnest(range(a, a + 50)) AS p FROM w JOIN f USING (t) WHERE first < doc_id),
    v AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
    k AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept FROM v ANTI JOIN h USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """,
)
def op4(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"))


@R.add(
    "op5_winnowing_decontamination",
    rf"""
    WITH i AS (SELECT item_id, regexp_extract_all({ASCII_LOWER}, '{ALNUM}') AS ws FROM benchmark),
    k AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM i WHERE len(ws) > 0),
    iw AS (SELECT DISTINCT item_id, k, ws[a:a + k - 1] AS w FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS a FROM k)),
    d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '{ALNUM}') AS ws FROM documents),
    dw AS (SELECT doc_id, s.k AS k, a, ws[a:a + s.k - 1] AS w
           FROM (SELECT doc_id, ws, s, unnest(range(1, len(ws) - s.k + 2)) AS a
                 FROM d, (SELECT DISTINCT {{'k': k}} AS s FROM k))),
    m AS (SELECT doc_id, a, k, item_id FROM dw JOIN iw USING (k, w)),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + k)) AS p FROM m) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
)
def op5(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@R.add("op6_viterbi_token_counts")
def op6(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


@R.add("op7_token_files")
def op7(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"))


@R.add(
    "op8_exact_dedup",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    n AS (SELECT doc_id, length(t) AS n, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS bare FROM d),
    r AS (SELECT *, sha256(bare) AS text_sha256 FROM n)
    SELECT doc_id, first(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
           row_number() OVER g = 1 AS kept, text_sha256
    FROM r WINDOW g AS (PARTITION BY bare ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    """,
)
def op8(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents")).drop("key")


@R.add("op9_histogram_packing")
def op9(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@R.add("op10_ecoc_language")
def op10(spark, sf_dir):
    return identify_languages(table(spark, sf_dir, "documents"))


CRC_ID = f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(doc_id::VARCHAR)),
  lambda i: ord(substr(doc_id::VARCHAR, i + 1, 1)))), lambda c, v: xor(c >> 8, tab[(xor(c, v) & 255) + 1])), 4294967295)"""


def leaf_sql(text: str) -> str:
    columns = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns) + ")"


def tree_sql(nodes: str) -> str:
    """All nodes above those of a relation (tree, pos, h): level by level, threes and what is left."""
    return f"""SELECT 0 AS lv, tree, pos, h, count(*) OVER (PARTITION BY tree) AS m FROM {nodes}
      UNION ALL SELECT lv + 1, tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(m) + 2) // 3
      FROM {{0}} WHERE m > 1 GROUP BY lv, tree, pos // 3"""


def walk_sql(start: str, runs: str) -> str:
    """Up from (doc, tree, pos, node, proof): siblings are appended, the node is put into its run."""
    return f"""SELECT 0 AS lv, * FROM {start} UNION ALL
      SELECT w.lv + 1, w.doc, w.tree, w.pos // 3, sha256(array_to_string(list_transform(hs, lambda h, k: CASE WHEN k = pos % 3 + 1 THEN node ELSE h END), '')),
        proof || array_to_string(list_filter(hs, lambda h, k: k <> pos % 3 + 1), '')
      FROM {{0}} w JOIN {runs} u ON u.lv = w.lv AND u.tree = w.tree AND u.run = w.pos // 3"""


@R.add(
    "op11_merkle_manifest",
    f"""
    WITH RECURSIVE t AS ({CRC_TABLE}),
    d AS (SELECT row_number() OVER () AS doc, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf_sql('text')} AS leaf,
            CASE WHEN {CRC_ID} % 2 = 0 THEN {leaf_sql("replace(text, chr(10), '')")} ELSE {leaf_sql('text')} END AS seen FROM documents, t),
    l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h FROM d),
    r AS ({tree_sql('l').format('r')}),
    s AS (SELECT 0 AS tree, tree AS pos, h FROM r WHERE m = 1),
    q AS ({tree_sql('s').format('q')}),
    ru AS (SELECT lv, tree, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM r WHERE m > 1 GROUP BY ALL),
    qu AS (SELECT lv, tree, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM q WHERE m > 1 GROUP BY ALL),
    ls AS (SELECT doc, tree, pos, seen AS node, '' AS proof FROM l),
    f AS ({walk_sql('ls', 'ru').format('f')}),
    ss AS (SELECT doc, 0 AS tree, f.tree AS pos, node, proof FROM f JOIN r ON r.tree = f.tree AND r.lv = f.lv AND r.m = 1),
    g AS ({walk_sql('ss', 'qu').format('g')}),
    e AS (SELECT doc, node AS folded_root, proof, h AS root FROM g JOIN q ON q.lv = g.lv AND q.m = 1)
    SELECT l.doc_id, leaf, s.h AS subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM l JOIN s ON s.pos = l.tree JOIN e USING (doc)
    """,
)
def op11(spark, sf_dir):
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    return merkle_manifest(table(spark, sf_dir, "documents"), F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))))


@R.add(
    "op12_nra_search",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({ASCII_LOWER}, '{ALNUM}') AS ws FROM documents),
    p AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
    s AS (SELECT count(*) AS n, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
    v AS (SELECT w, floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS weight
          FROM (SELECT w, count(*) AS df FROM p GROUP BY w), s),
    m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(ws) * n) // l) AS m FROM d, s WHERE len(ws) > 0),
    i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({ASCII_LOWER}, '{ALNUM}')) AS w FROM benchmark),
    x AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
          FROM i JOIN v USING (w) JOIN p USING (w) JOIN m USING (r) GROUP BY item_id, r),
    o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 50
    """,
)
def op12(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@R.add(
    "op13_radix_suffix_repeats",
    """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    w AS (SELECT r, doc_id, a, md5_number(substr(x, 2*a + 1, 100)) AS t
          FROM (SELECT r, doc_id, x, unnest(range(strlen(x) // 2 - 49)) AS a FROM d)),
    f AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
    h AS (SELECT r, a, a - coalesce(lag(a) OVER (PARTITION BY r ORDER BY a), -51) > 50 AS fresh FROM w JOIN f USING (t) WHERE first < doc_id),
    g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY r ORDER BY a) AS span FROM h),
    s AS (SELECT r, span, min(a) AS lo, max(a) + 50 AS hi FROM g GROUP BY r, span),
    e AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM s),
    k AS (SELECT r, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, max(hi) AS rest,
          string_agg(substr(x, 2*before + 1, 2*(lo - before)), '' ORDER BY lo) AS kept FROM e JOIN d USING (r) GROUP BY r)
    SELECT doc_id, strlen(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept, '') || substr(x, 2*coalesce(rest, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN k USING (r)
    """,
)
def op13(spark, sf_dir):
    return without_repeated_bytes(table(spark, sf_dir, "documents"))


@R.add("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def collect() -> tuple[dict, dict]:
    return R.queries, R.oracles
