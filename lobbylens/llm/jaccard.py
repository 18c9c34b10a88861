"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobbylens.llm.common import filter_bits, gram_hashes, in_filter, null_last, released, signed, stash, texts, word_hashes
from lobbylens.llm.graph import components

#: Words of a shingle; the similarity is at least PART / WHOLE.
SHINGLE = 5
PART, WHOLE = 4, 5
#: Shingle frequencies are counted in 2^SKETCH_BITS cells, whatever the corpus: they only
#: choose the common order of shingles, which may be any order without losing a link.
SKETCH_BITS = 18
#: Bits of the parity vector that the suffix filter compares, as 64-bit words.
PARITY_WORDS = 8
#: Classes of shingles that it counts once the texts of a pair are at hand.
CLASSES = 1024
#: Nodes whose ids are broadcast to pick their sets; more are picked by the join itself.
BROADCAST_NODES = 200_000
#: Rows that an Arrow batch of prefixes is cut to.
BATCH = 1 << 18


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle."""
    words = word_hashes(text, lower=True)
    if 0 < words.size < k:
        return gram_hashes(words, words.size, seed=100 + words.size)
    return np.unique(gram_hashes(words, k))


def _fingerprint(shingles: np.ndarray) -> np.uint64:
    """64 bits for a whole set; documents with the same set are one node of the join."""
    with np.errstate(over="ignore"):
        mixed = (shingles ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xDA942042E4DD58B5)
        mixed ^= mixed >> np.uint64(29)
        total = mixed.sum(dtype=np.uint64) + np.uint64(shingles.size) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xD6E8FEB86659FD93)
        return total ^ (total >> np.uint64(32))


def _least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any partner: n * PART / WHOLE, rounded up."""
    return -(-n * PART // WHOLE)


PROFILE = "doc_id long, key long, fp long, n int, parity array<bigint>, cell int, seen long"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, then the partition's shingle counts per cell of the sketch."""
    cells = np.zeros(1 << SKETCH_BITS, np.int64)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("parity", pa.list_(pa.int64())),
         ("cell", pa.int32()), ("seen", pa.int64())]
    )
    for batch in batches:
        fps, sizes, parities = [], [], []
        for text in texts(batch):
            shingles = shingle_set(text)
            np.add.at(cells, (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            fps.append(int(_fingerprint(shingles).view(np.int64)))
            sizes.append(shingles.size)
            counts = np.bincount((shingles & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS)
            parities.append(np.packbits((counts & 1).astype(np.uint8)).view(np.int64))
        n = batch.num_rows
        columns = [batch.column("doc_id"), batch.column("key"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()),
                   pa.array(parities, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
    full = np.flatnonzero(cells)
    columns = [pa.nulls(full.size, f.type) for f in schema]
    columns[5], columns[6] = pa.array(full, pa.int32()), pa.array(cells[full], pa.int64())
    yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _prefix_rows(sketch, bits):
    """Map function: the rarest shingles of each set, as (h, fp, n, pos) or, unfiltered, (h, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = sketch.value, set()
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            h, fp, n, pos = (np.concatenate(c) for c in zip(*held))
            arrays, names = [signed(h), signed(fp)], ["h", "fp"]
            if bits is not None:
                arrays, names = [*arrays, pa.array(n), pa.array(pos)], [*names, "n", "pos"]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for text in texts(batch):
                shingles = shingle_set(text)
                fp = _fingerprint(shingles)
                if not shingles.size or int(fp) in seen:
                    continue
                seen.add(int(fp))
                # Rare first: by the frequency of the shingle's cell, then by hash.
                order = np.lexsort((shingles, cells[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                prefix = shingles[order[: shingles.size - _least_overlap(shingles.size) + 1]]
                pos = np.arange(prefix.size, dtype=np.int32)
                if bits is not None:
                    keep = in_filter(bits.value, prefix)
                    prefix, pos = prefix[keep], pos[keep]
                    if not prefix.size:
                        continue
                size = prefix.size
                held.append((prefix, np.full(size, fp), np.full(size, shingles.size, np.int32), pos))
                rows += size
                if rows >= BATCH:
                    yield flush()
                    held, rows = [], 0
        if held:
            yield flush()

    return run


def _sets(bits):
    """Map function: the whole sets of documents that pass the filter on `code`, and their sizes per class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.flatnonzero(in_filter(bits.value, batch.column("code").to_numpy().view(np.uint64)))
            for lo in range(0, wanted.size, 256):
                some = [shingle_set(t) for t in texts(batch.take(pa.array(wanted[lo : lo + 256])))]
                some = [s for s in some if s.size]
                if some:
                    fps = pa.array([int(_fingerprint(s).view(np.int64)) for s in some], pa.int64())
                    counts = [np.bincount((s >> np.uint64(40) & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES) for s in some]
                    counts = pa.array([np.minimum(c, 32767).astype(np.int16) for c in counts], pa.list_(pa.int16()))
                    shingles = pa.array([s.view(np.int64) for s in some], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([fps, counts, shingles], names=["fp", "counts", "shingles"])

    return run


def _passing(a: str, b: str) -> str:
    """Length and positional filter for one shared prefix shingle of sets a and b.

    The shorter set needs the shingle within its shorter index prefix; a set of n shares at
    least 4 (a + b) / 9 with its partner, and after positions i, j at most the rests are common.
    """
    least = f"({a}.n + {b}.n) * {PART}L"
    return (
        f"{a}.n * {WHOLE}L >= {b}.n * {PART}L AND {b}.n * {WHOLE}L >= {a}.n * {PART}L"
        f" AND (1 + least({a}.n - {a}.pos - 1, {b}.n - {b}.pos - 1)) * {PART + WHOLE}L >= {least}"
    )


def _near(a: str, b: str, na: str, nb: str) -> str:
    """Suffix filter: a lower bound of what the sets differ in, from their parity vectors.

    Each shingle flips one bit of its set's vector, so bits that differ are shingles that differ.
    Of a + b shingles 8 (a + b) / 9 at least are common to similar sets, the rest may differ.
    """
    apart = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(PARITY_WORDS))
    return f"({na} + {nb}) * {WHOLE - PART}L >= ({apart}) * {PART + WHOLE}L"


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v) among candidate pairs (u, v), each pair compared once over the whole sets.

    Sets that the suffix filter tells apart are not fetched: first by their parity vectors, then by
    their counts per class, which differ by no more than the sets do. Repeated rows may give a
    link twice.
    """
    spark = docs.sparkSession
    for side in ("u", "v"):
        named = nodes.select(
            F.col("fp").alias(side), F.col("n").alias(f"n_{side}"), F.col("code").alias(f"code_{side}"),
            F.col("parity").alias(f"p_{side}"),
        )
        pairs = pairs.join(named, side)
    pairs = pairs.where(F.expr(_near("p_u", "p_v", "n_u", "n_v")))
    pairs = stash(pairs.drop("p_u", "p_v"), "pairs")
    if pairs.isEmpty():
        return pairs.select("u", "v")
    codes = pairs.select(F.explode(F.array("code_u", "code_v")).alias("code")).distinct()
    bits = spark.sparkContext.broadcast(filter_bits(codes, "code"))
    coded = docs.select("text", F.xxhash64("doc_id").alias("code"))
    sets = stash(coded.mapInArrow(released(_sets(bits)), "fp long, counts array<smallint>, shingles array<long>"), "sets")
    for side in ("v", "u"):
        pairs = pairs.join(sets.select(F.col("fp").alias(side), F.col("counts").alias(f"c_{side}")), side)
    apart = F.expr("aggregate(zip_with(c_u, c_v, (x, y) -> abs(cast(x AS int) - y)), 0, (s, d) -> s + d)")
    pairs = pairs.where((F.col("n_u") + F.col("n_v")) * (WHOLE - PART) >= apart * (PART + WHOLE))
    pairs = stash(pairs.select("u", "v", "n_u", "n_v").distinct(), "near-pairs")
    wanted = stash(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "near-nodes")
    if wanted.count() <= BROADCAST_NODES:
        sets = sets.join(F.broadcast(wanted), F.col("fp") == F.col("node"), "left_semi")
    for side in ("v", "u"):
        pairs = pairs.join(sets.select(F.col("fp").alias(side), F.col("shingles").alias(f"s_{side}")), side)
    common = F.size(F.array_intersect("s_u", "s_v"))
    return pairs.where(common * (PART + WHOLE) >= (F.col("n_u") + F.col("n_v")) * PART).select("u", "v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Component of each document under links of Jaccard similarity 0.8 and more.

    Sets are the distinct 5-word shingles (words of [^\\x20\\x09-\\x0D]+, A-Z lower-cased) of
    the whole text; a text of fewer words is one shingle, one without words has none and is
    linked with nothing. Returns one row per input row: doc_id, n_shingles, component_id
    (smallest doc_id reachable by links, itself included), key (xxhash64 of the text) and kept
    (one document of each component; rows equal in doc_id and text share the mark). Null texts are empty; repeated rows
    and equal sets share a node; null doc_ids count last (null only if all are); an empty table
    gives an empty result; further columns are not read.

    1. Equal sets become one node, and shingle frequencies are counted in a fixed-size sketch.
    2. Prefix shingles, rarest first, are aggregated by hash: those of one node only are out.
    3. Every remaining node is compared with one leader per shingle; links give components.
    4. Where a shingle still holds several components, all pairs across components
       are compared that pass the length, positional and suffix filter. Pairs inside a
       component cannot change it. So a large group of near copies costs one comparison per
       member and leader, and no link between components is missed.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    profiles = stash(docs.mapInArrow(released(_profiles), PROFILE), "profiles")
    classes = profiles.where("n IS NOT NULL").select("doc_id", "key", "fp", "n", "parity")
    counted = profiles.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("seen").alias("seen")).toArrow()
    cells = np.zeros(1 << SKETCH_BITS, np.int64)
    cells[counted["cell"].to_numpy()] = counted["seen"].to_numpy()
    sketch = spark.sparkContext.broadcast(cells)
    nodes = classes.where("n > 0").groupBy("fp").agg(
        F.first("n").alias("n"), F.first("parity").alias("parity"), F.xxhash64(F.min("doc_id")).alias("code")
    )
    nodes = stash(nodes, "nodes")

    text = docs.select("text")
    shared = text.mapInArrow(released(_prefix_rows(sketch, None)), "h long, fp long")
    shared = shared.groupBy("h").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    shared = stash(shared.select("h"), "shared-shingles")
    bits = spark.sparkContext.broadcast(filter_bits(shared, "h"))
    members = text.mapInArrow(released(_prefix_rows(sketch, bits)), "h long, fp long, n int, pos int")
    members = stash(members.join(shared, "h", "left_semi"), "members")

    # The leader has fewest rarer shingles before this one: of near copies, the least edited.
    leaders = members.groupBy("h").agg(F.min(F.struct("pos", "n", "fp")).alias("b"))
    leaders = stash(leaders.select("h", "b.*"), "leaders").alias("b")
    stars = members.alias("a").join(leaders, (F.col("a.h") == F.col("b.h")) & (F.col("a.fp") != F.col("b.fp")))
    stars = stars.where(_passing("a", "b"))
    stars = stars.select(F.greatest("a.fp", "b.fp").alias("u"), F.least("a.fp", "b.fp").alias("v")).distinct()
    stars = stash(stars, "star-pairs")
    links = stash(_verified(docs, stars, nodes), "star-links")
    comps = stash(components(links), "star-components")

    # What is left: shingles that hold several components.
    placed = members.select("h", "fp", "n", "pos").distinct()
    placed = placed.join(comps, F.col("fp") == F.col("node"), "left")
    placed = stash(placed.select("h", "fp", "n", "pos", F.coalesce("comp", "fp").alias("comp")), "placed")
    sizes = placed.groupBy("h", "comp").agg(F.count("*").alias("size")).groupBy("h")
    sizes = sizes.agg(F.max_by("comp", "size").alias("main"), F.count("*").alias("comps")).where("comps > 1")
    sizes = stash(sizes.select("h", "main"), "mixed-shingles")
    rest = placed.join(sizes, "h").join(nodes.select("fp", "parity"), "fp")
    rest = stash(rest, "rest")
    minor = rest.where("comp <> main").alias("a")
    across = minor.join(
        rest.alias("b"),
        (F.col("a.h") == F.col("b.h")) & (F.col("a.comp") != F.col("b.comp"))
        & ((F.col("b.comp") == F.col("b.main")) | (F.col("a.fp") < F.col("b.fp")))
        & F.expr(_passing("a", "b")) & F.expr(_near("a.parity", "b.parity", "a.n", "b.n")),
    )
    across = across.select(F.greatest("a.fp", "b.fp").alias("u"), F.least("a.fp", "b.fp").alias("v")).distinct()
    across = stash(across.join(stars, ["u", "v"], "left_anti"), "cross-pairs")
    more = stash(_verified(docs, across, nodes), "cross-links")
    if not more.isEmpty():
        comps = stash(components(links.union(more)), "components")

    # Smallest doc_id of each component, by way of its nodes.
    whole = classes.select("doc_id", "key", "fp", F.col("n").cast("long").alias("n_shingles"))
    filled = whole.where("n_shingles > 0").join(comps, F.col("fp") == F.col("node"), "left")
    filled = stash(filled.select("doc_id", "key", "n_shingles", F.coalesce("comp", "fp").alias("comp")), "classes")
    low = F.min(F.struct(null_last("doc_id").alias("ord"), F.col("key").alias("low_key"), F.col("doc_id").alias("low_id")))
    lowest = stash(filled.groupBy("comp").agg(low.alias("low"), F.count("*").alias("docs")).select("comp", "low.*"), "lowest")
    linked = filled.join(lowest, "comp").select(
        "doc_id", "n_shingles", F.col("low_id").alias("component_id"), "key",
        (F.col("doc_id").eqNullSafe(F.col("low_id")) & (F.col("key") == F.col("low_key"))).alias("kept"),
    )
    empty = whole.where("n_shingles = 0")
    return linked.union(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "key", F.lit(True)))
