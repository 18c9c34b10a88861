"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobbylens.llm.common import sized, stash

#: Words of a window that counts as contamination.
WINDOW = 10
#: Words of a fingerprinted gram. Of the WINDOW - GRAM + 1 grams of a window the one with the
#: smallest hash is kept, on both sides, so every shared window shares a kept gram.
GRAM = 5
SEPARATORS = "[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+"


def words_of(text: str = "text") -> Column:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; null has none."""
    lower = f"translate(coalesce({text}, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
    return F.expr(f"array_remove(split({lower}, '{SEPARATORS}'), '')")


def _grams(k: int) -> Column:
    """Hashes of all k-grams of the word hashes in column h."""
    parts = ", ".join(f"get(h, i + {j})" for j in range(k))
    return F.expr(f"if(size(h) < {k}, array(), transform(sequence(0, size(h) - {k}), i -> xxhash64({k}, {parts})))").cast(
        "array<bigint>"
    )


def _winnowed(grams: str, slack: int) -> Column:
    """Smallest hash of each run of slack + 1 grams, each once."""
    return F.array_distinct(_lows(grams, slack))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.expr("transform(words, w -> xxhash64(w))"))


def _families(sizes: list[int], window: int, gram: int) -> list[tuple[int, int]]:
    """(gram words, slack): one for whole windows, one for each size of shorter items."""
    return [(gram, window - gram)] * any(n >= window for n in sizes) + [(n, 0) for n in sizes if 0 < n < window]


def _lows(grams: str, slack: int) -> Column:
    """The smallest hash of each run of slack + 1 grams."""
    if not slack:
        return F.col(grams)
    span = ", ".join(f"get({grams}, i + {j})" for j in range(slack + 1))
    lows = f"transform(sequence(0, size({grams}) - {slack + 1}), i -> least({span}))"
    return F.expr(f"if(size({grams}) <= {slack}, cast(array() AS array<bigint>), {lows})")


def _kept_places(grams: str, lows: str, slack: int) -> Column:
    """Places of the grams that winnowing keeps: those that are the smallest of some run.

    The runs that hold place i start at i - slack to i; a gram is the low of one of them if it
    equals the largest of their lows.
    """
    around = ", ".join(f"if(i >= {j}, get({lows}, i - {j}), NULL)" for j in range(slack + 1))
    largest = f"greatest({around})" if slack else f"{lows}[i]"
    return F.expr(f"if(size({lows}) = 0, array(), filter(sequence(0, size({grams}) - 1), i -> {grams}[i] = {largest}))")


def _places(df: DataFrame, families: list[tuple[int, int]]) -> DataFrame:
    """Every gram of each row with its place: the row's columns but the words, and k, slack, at, fp."""
    out = []
    for k, slack in families:
        part = df.withColumn("g", _grams(k)).select(
            *[c for c in df.columns if c not in ("words", "h")], F.lit(k).alias("k"), F.lit(slack).alias("slack"), F.posexplode_outer("g").alias("at", "fp"))
        out.append(part.where("fp IS NOT NULL"))
    return reduce(DataFrame.unionByName, out)


def _surroundings(df: DataFrame, most: int) -> DataFrame:
    """The words at a gram's place: lefts (nearest first), middle, rights; at most `most` on each side."""
    return df.select(
        *[c for c in df.columns if c not in ("words", "h")],
        F.expr(f"reverse(slice(words, greatest(at - {most}, 0) + 1, least(at, {most})))").alias("lefts"),
        F.expr("slice(words, at + 1, k)").alias("middle"),
        F.expr(f"slice(words, at + k + 1, {most})").alias("rights"),
    )


def _agreeing(a: str, b: str, most: int) -> str:
    """How many leading words of two short arrays agree."""
    if not most:
        return "0"
    cases = " ".join(f"WHEN NOT coalesce(get({a}, {i}) = get({b}, {i}), false) THEN {i}" for i in range(most))
    return f"CASE {cases} ELSE {most} END"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Which words of each document lie in a window of a benchmark item.

    A window is `window` consecutive words of an item; a shorter item (not an empty one) is one
    window. Returns one row per input row: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated. A word inside any occurrence of a window is hit; items_sha256 is over the
    item_ids with an occurring window, sorted as strings and joined by commas.
    Kept grams are joined by hash, then extended over the words themselves: equal grams whose
    neighbours agree to `window` words in all are occurrences, so hash collisions cannot hit.
    Shorter items take all grams of their own size. Empty and null texts have no words and hit
    nothing; empty tables and repeated rows are fine; a null item_id hits but is not listed;
    further columns are not read. A gram or passage in a third of the documents is one row of
    the benchmark side; where that is too large to broadcast the adaptive skew join splits it.
    """
    items = _hashed(benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of().alias("words")))
    sizes = items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()  # window + 1 at most
    families = _families(sorted(r["n"] for r in sizes), window, gram)
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), words_of().alias("words")
    )
    if not families:
        return base.select(
            "doc_id", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
            F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256"),
            F.lit(False).alias("contaminated"),
        )
    # Items of a window and more are found by their winnowed grams, each shorter one as a whole.
    reach = max(slack for _, slack in families)
    fitting = []
    for k, slack in families:
        part = items.where(F.size("words") >= window if slack else F.size("words") == k).withColumn("g", _grams(k))
        # Written, so that no array is worked out again for each of its elements.
        part = stash(part.select("item_id", "words", "g", _lows("g", slack).alias("lows")), "benchmark-words")
        part = part.withColumn("at", F.explode_outer(_kept_places("g", "lows", slack))).where("at IS NOT NULL")
        part = part.select("item_id", "words", F.lit(k).alias("k"), F.lit(slack).alias("slack"), "at", F.expr("g[at]").alias("fp"))
        fitting.append(_surroundings(part, reach).drop("at"))
    known = stash(reduce(DataFrame.unionByName, fitting).distinct(), "benchmark-grams")

    # One pass over all texts: of each document its word count and its kept grams that the
    # benchmark has too. The null gram carries the row itself. Sides are broadcast where the
    # planner finds their files small enough.
    hashed = _hashed(base.withColumn("n_words", F.size("words").cast("long")))
    for i, (k, slack) in enumerate(families):
        hashed = hashed.withColumn(f"g{i}", _grams(k)).withColumn(f"f{i}", _winnowed(f"g{i}", slack))
    kept = F.concat(F.expr("array(cast(null AS bigint))"), *[F.col(f"f{i}") for i in range(len(families))])
    rows = hashed.select("doc_id", "key", "n_words", F.explode_outer(kept).alias("fp"))
    fps = stash(known.select(F.col("fp").alias("known")).distinct(), "known-grams")
    rows = rows.join(fps, F.col("fp") == F.col("known"), "left")
    rows = stash(rows.where("known IS NOT NULL OR fp IS NULL").drop("known"), "document-grams")

    # The few documents with such grams again: first the places of the known grams, then the
    # words around these places only.
    found = stash(rows.where("fp IS NOT NULL").select(F.col("doc_id").alias("f_id"), F.col("key").alias("f_key")).distinct(), "document-hits")
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key"))
    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    again = again.join(sized(found), same, "left_semi").dropDuplicates(["doc_id", "key"]).select("doc_id", "key", words_of().alias("words"))
    again = stash(again, "documents-again")
    places = _places(_hashed(again), families).join(fps, F.col("fp") == F.col("known"), "left_semi")
    places = places.groupBy("doc_id", "key").agg(F.collect_list(F.struct("k", "slack", "at", "fp")).alias("places"))
    places = stash(places.select(F.col("doc_id").alias("f_id"), F.col("key").alias("f_key"), "places"), "gram-places")
    here = again.join(places, same).select("doc_id", "key", "words", F.explode("places").alias("p")).select("doc_id", "key", "words", "p.*")
    here = _surroundings(here, reach)
    theirs = known.select(*[F.col(c).alias(f"b_{c}") for c in ("item_id", "fp", "k", "lefts", "middle", "rights")])
    match = here.join(theirs, (F.col("fp") == F.col("b_fp")) & (F.col("k") == F.col("b_k")) & (F.col("middle") == F.col("b_middle")))
    match = match.withColumns(
        {"l": F.expr(_agreeing("lefts", "b_lefts", reach)), "r": F.expr(_agreeing("rights", "b_rights", reach))}
    ).where("l + r >= slack")
    spans = match.select(
        "doc_id", "key", (F.col("at") - F.col("l")).alias("lo"), (F.col("at") + F.col("k") + F.col("r")).alias("hi"),
        F.col("b_item_id").alias("item_id"),
    )
    spans = stash(spans.distinct(), "document-spans")
    hits = spans.select("doc_id", "key", "lo", "hi").distinct()
    hits = hits.select("doc_id", "key", F.explode(F.expr("sequence(lo, hi - 1)")).alias("at")).distinct()
    hits = hits.groupBy("doc_id", "key").agg(F.count("*").alias("n_hit"))
    listed = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    per_doc = hits.join(listed, hits["doc_id"].eqNullSafe(listed["doc_id"]) & (hits["key"] == listed["key"]))
    per_doc = per_doc.select(hits["doc_id"].alias("f_id"), hits["key"].alias("f_key"), "n_hit", "items")
    out = rows.where("fp IS NULL").join(per_doc, same, "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        "key",
    )
