"""Substring dedup: documents are factored greedily against indexed reference blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobbylens.llm.common import filter_bits, gram_hashes, in_filter, mix, null_last, signed, stash, texts, word_hashes

#: Words of the shortest factor that is removed.
WINDOW = 50
#: Words of an anchor. A window is filed under the smallest hash of its anchors.
ANCHOR = 8
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
PIECES = "ord long, doc_id long, key long, anchor long, body long, start int, windows int"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the word sequences [start, end), from one running sum."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(_R, words.size), dtype=np.uint64)))
        body = (total[ends] - total[starts]) * _powers(_R_INVERSE, words.size + 1)[starts]
        return mix(body + (ends - starts).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: x.size - step], x[step:])
        done += step
    return x


def pieces_of(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut the windows of a document into runs with the same anchor.

    Returns anchors, hashes of the run's words, first windows and numbers of windows. Equal
    windows have equal anchors wherever they occur, so all their occurrences meet in one
    reference block, that of the anchor.
    """
    if words.size < window:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    lowest = _sliding_min(gram_hashes(words, ANCHOR), window - ANCHOR + 1)
    starts = np.concatenate(([0], np.flatnonzero(lowest[1:] != lowest[:-1]) + 1))
    counts = np.diff(np.concatenate((starts, [lowest.size])))
    return lowest[starts], span_hashes(words, starts, starts + counts + window - 1), starts, counts


def _code(anchor, body, order):
    """Names a piece of a document in the filter; the same in SQL."""
    return anchor ^ body ^ (order << np.int64(17)) ^ order


def _map_pieces(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in enumerate(texts(batch)):
                anchors, bodies, starts, counts = pieces_of(word_hashes(text), window)
                if anchors.size:
                    rows.append((np.full(anchors.size, i), anchors, bodies, starts, counts))
            if rows:
                at, anchors, bodies, starts, counts = (np.concatenate(c) for c in zip(*rows))
                head = batch.select(["ord", "doc_id", "key"]).take(pa.array(at))
                columns = [signed(anchors), signed(bodies), pa.array(starts, pa.int32()), pa.array(counts, pa.int32())]
                yield pa.RecordBatch.from_arrays([*head.columns, *columns], names=[f.split()[0] for f in PIECES.split(", ")])

    return run


def _map_windows(bits, window: int):
    """Windows of the pieces in the filter: what the reference blocks hold and what is looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = batch.column("ord").to_numpy()
            for i, text in enumerate(texts(batch)):
                words = word_hashes(text)
                anchors, bodies, starts, counts = pieces_of(words, window)
                code = _code(anchors.view(np.int64), bodies.view(np.int64), orders[i])
                keep = np.flatnonzero(in_filter(bits.value, code.view(np.uint64)))
                if not keep.size:
                    continue
                counts = counts[keep]
                first = np.repeat(starts[keep] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
                at = first + np.arange(counts.sum())
                head = batch.select(["ord", "doc_id", "key"]).take(pa.array(np.full(at.size, i)))
                columns = [signed(np.repeat(anchors[keep], counts)), signed(span_hashes(words, at, at + window))]
                yield pa.RecordBatch.from_arrays(
                    [*head.columns, *columns, pa.array(at, pa.int32())], names=["ord", "doc_id", "key", "anchor", "body", "start"]
                )

    return run


def parse(lo: np.ndarray, hi: np.ndarray, ref: np.ndarray, ref_lo: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, ref, ref_start) of a document, given its matches.

    A match says that words lo to hi are those of document ref from ref_lo on. Matches with the
    same ref on one diagonal that meet are extended to one. Then, from left to right, the factor at
    a place is the match that reaches farthest from there, and the parse jumps to its end; a match
    that straddles this boundary is taken up there. Words outside all matches are literals.
    """
    if not lo.size:
        return []
    order = np.lexsort((lo, ref_lo - lo, ref))
    lo, hi, ref, ref_lo = lo[order], hi[order], ref[order], ref_lo[order]
    same = (ref[1:] == ref[:-1]) & ((ref_lo - lo)[1:] == (ref_lo - lo)[:-1])
    # The farthest end so far, within a diagonal.
    past = np.cumsum(np.concatenate(([False], ~same))) * (int(hi.max()) + 1)
    ends = np.maximum.accumulate(hi + past) - past
    fresh = np.concatenate(([True], ~same | (lo[1:] > ends[:-1])))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [lo.size])) - 1
    lo, hi, ref, ref_lo = lo[first], ends[last], ref[first], ref_lo[first]
    out, at, best = [], 0, None
    for i in np.argsort(lo, kind="stable").tolist():
        # Factors end before the next match begins beyond them.
        while best is not None and lo[i] > at:
            out.append((at, int(hi[best]), int(ref[best]), int(ref_lo[best] + at - lo[best])))
            at, best = int(hi[best]), None
        if hi[i] > at and (best is None or hi[i] > hi[best]):
            if best is None:
                at = max(at, int(lo[i]))
            best = i
    if best is not None:
        out.append((at, int(hi[best]), int(ref[best]), int(ref_lo[best] + at - lo[best])))
    return out


def _parsed(hits: pa.ListScalar) -> list[tuple[int, int, int, int]]:
    if not hits.is_valid:
        return []
    return parse(*(hits.values.field(name).to_numpy() for name in ("lo", "hi", "ref", "ref_lo")))


def _map_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_parsed(hits) for hits in batch.column("hits")]
        at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
        start, end, ref, ref_start = (np.asarray(c, np.int64) for c in zip(*[x for f in found for x in f])) if len(at) else [np.empty(0, np.int64)] * 4
        head = batch.select(["s_id", "s_key"]).take(at)
        columns = [pa.array(start), pa.array(end - start), pa.array(ref, mask=ref == (1 << 63) - 1), pa.array(ref_start)]
        yield pa.RecordBatch.from_arrays([*head.columns, *columns], names=[f.split()[0] for f in FACTORS.split(", ")])


FACTORS = "doc_id long, key long, start long, length long, ref_id long, ref_start long"


def _map_kept(with_text: bool):
    """Remove the words under the factors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, digests, kept_texts = [], [], [], []
            for text, hits in zip(texts(batch), batch.column("hits")):
                words = text.split()  # of bytes: at [\x20\x09-\x0D]
                n, kept, at = len(words), [], 0
                for start, end, _, _ in _parsed(hits):
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                joined = b" ".join(kept)
                sizes.append(n)
                removed.append(n - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept_texts.append(joined.decode())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept_texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def matches(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document (s_id, s_key) its matches with earlier ones: hits, an array of (lo, hi, ref, ref_lo).

    s_key is xxhash64 of the text, to tell rows with the same doc_id apart; ref is the earliest
    document (null_last of its doc_id) that holds the words.
    1. Every document is cut into pieces, runs of windows with the same anchor. The pieces of
       an anchor are its reference block; only anchors of two and more documents matter.
    2. A piece that is the same, as a whole, in an earlier document is one match.
    3. Other pieces of blocks with several different pieces are looked up in the block window
       by window, which covers the matches that begin or end inside a piece, so none is lost at a
       boundary.
    Equal copies are one reference; what is compared grows with the different pieces, and a
    window is looked up by hash, so no block is gathered in one task. What is gathered per document are its
    own matches, at most one per word.
    """
    spark = docs.sparkSession
    rows = docs.select(
        null_last("doc_id").cast("long").alias("ord"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("key"), "text",
    )
    pieces = stash(rows.mapInArrow(_map_pieces(window), PIECES), "pieces")
    blocks = pieces.groupBy("anchor").agg(
        F.min("ord").alias("lowest"), F.max("ord").alias("highest"), F.min("body").alias("b0"), F.max("body").alias("b1")
    )
    blocks = blocks.where("lowest < highest").select("anchor", (F.col("b0") < F.col("b1")).alias("several"))
    blocks = stash(blocks, "blocks")
    shared = stash(pieces.join(blocks, "anchor"), "shared-pieces")
    earliest = F.min(F.struct("ord", "start"))
    firsts = shared.groupBy("anchor", "body").agg(earliest.alias("f")).select("anchor", "body", F.col("f.ord").alias("ref"), F.col("f.start").alias("ref_lo"))
    placed = stash(shared.join(stash(firsts, "first-pieces"), ["anchor", "body"]), "placed-pieces")
    end = F.col("start") + F.col("windows") + window - 1
    whole = placed.where("ord > ref").select("doc_id", "key", F.col("start").alias("lo"), end.alias("hi"), "ref", "ref_lo")

    code = F.expr("anchor ^ body ^ shiftleft(ord, 17) ^ ord")
    parsed = placed.where("ord = ref AND several").select(code.alias("code")).distinct()
    bits = spark.sparkContext.broadcast(filter_bits(parsed, "code"))
    looked = rows.mapInArrow(_map_windows(bits, window), "ord long, doc_id long, key long, anchor long, body long, start int")
    looked = stash(looked, "windows")
    index = looked.groupBy("anchor", "body").agg(earliest.alias("f"), F.max("ord").alias("last")).where("f.ord < last")
    index = stash(index.select("anchor", "body", F.col("f.ord").alias("ref"), F.col("f.start").alias("ref_lo")), "window-index")
    inside = looked.join(index, ["anchor", "body"]).where("ord > ref")
    inside = inside.select("doc_id", "key", F.col("start").alias("lo"), (F.col("start") + window).alias("hi"), "ref", "ref_lo")
    found = whole.union(inside).distinct().groupBy(F.col("doc_id").alias("s_id"), F.col("key").alias("s_key"))
    return found.agg(F.collect_list(F.struct("lo", "hi", "ref", "ref_lo")).alias("hits"))


def factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The factors of each document in earlier ones: doc_id, key, start, length, ref_id, ref_start (in words).

    Factors of a document do not overlap; each is part of a match of at least `window` words, and all
    windows that occur earlier lie inside runs of adjoining factors.
    """
    return matches(docs, window).mapInArrow(_map_factors, FACTORS)


def without_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Remove repeated windows of words from every document but the one with the smallest id.

    A window is `window` consecutive words of [^\\x20\\x09-\\x0D]+, unchanged. Each word
    goes that a window covers whose words also start a window of a document with a smaller
    doc_id, that is every word inside a factor; windows are judged on the input. Returns doc_id, n_words,
    n_removed, kept_sha256
    (of the kept words joined by a space) and, if asked for, kept_text, one row per input row.
    Null texts have no words; texts shorter than a window stay; repeats inside one document
    and between rows with the same doc_id stay; a null doc_id comes after all others; an empty
    table gives an empty result; further columns are not read.
    """
    hits = stash(matches(docs, window), "matches")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("s_key"))
    # The matches are the hashed side, so that whole texts move once and need no sort.
    joined = rows.join(hits.hint("shuffle_hash"), same, "left").select("doc_id", "text", "hits")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(_map_kept(with_text), out)
