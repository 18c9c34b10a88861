"""Packing of tokenised documents into sequences, shortest pack first over a length histogram."""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobbylens.llm.common import ranked, released, stash
from lobbylens.llm.tokens import CACHE_WORDS, encoder, vocabulary

SEQUENCE = 4096
END_ID = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SLOTS = "slot_length long, lo long, hi long, first_sequence long, offset long"
#: Slots are broadcast up to this many rows (40 bytes each), else joined by a shuffle.
BROADCAST_SLOTS = 200_000


def _document_ids(text: bytes, path: str, end_id: int, cache_words: int = CACHE_WORDS) -> np.ndarray:
    ids = encoder(path, True, cache_words).ids(text.decode())
    return np.frombuffer(ids + int(end_id).to_bytes(4, "little"), "<u4")


def pieces_of(
    docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, cache_words: int = CACHE_WORDS
) -> DataFrame:
    """Tokenise and cut: full pieces of `sequence` ids and one shorter rest per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = _document_ids((text or "").encode(), path, end_id, cache_words)
                for at in range(0, ids.size, sequence):
                    part = ids[at : at + sequence]
                    rows.append((doc_id, at, part.size, zlib.crc32(part.tobytes()), ids.size))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(released(run), PIECES)


def plan_slots(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Place all pieces, given how many there are of each length.

    Lengths are taken longest first. The pieces of a length go to the shortest pack they fit
    in, as many at once as there are packs of that fill; what fits nowhere opens packs.
    Sequences with the same pattern stay together as ranges, so a slot (length, lo, hi,
    first_sequence, offset) places the pieces with rank lo to hi - 1 of the global order by
    length. Work and result depend on the number of distinct lengths, not on the pieces.
    """
    # By fill: ranges of sequence ids; fills in order.
    open_packs: dict[int, list[tuple[int, int]]] = {}
    fills: list[int] = []
    slots, opened = [], 0
    base = 0
    ranks = {}
    for length in sorted(histogram):
        ranks[length] = base
        base += histogram[length]
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], ranks[length]
        while left:
            fill = fills[0] if fills else None
            if fill is None or fill + length > sequence:
                new = [(0, opened, opened + left)]
                opened += left
            else:
                ranges, new, need = open_packs[fill], [], left
                while ranges and need:
                    lo, hi = ranges.pop()
                    take = min(need, hi - lo)
                    new.append((fill, lo, lo + take))
                    if take < hi - lo:
                        ranges.append((lo + take, hi))
                    need -= take
                if not ranges:
                    del open_packs[fill]
                    fills.pop(0)
            for fill, lo, hi in new:
                slots.append((length, rank, rank + hi - lo, lo, fill))
                rank += hi - lo
                left -= hi - lo
                if fill + length < sequence:
                    if fill + length not in open_packs:
                        open_packs[fill + length] = []
                        insort(fills, fill + length)
                    open_packs[fill + length].append((lo, hi))
    return slots


def slot_table(spark: SparkSession, slots: list[tuple]) -> DataFrame:
    table = pa.table(
        {f.split()[0]: pa.array([s[i] for s in slots], pa.int64()) for i, f in enumerate(SLOTS.split(", "))}
    )
    return spark.createDataFrame(table)


def pack(
    docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, cache_words: int = CACHE_WORDS
) -> DataFrame:
    """Pack every document into sequences of at most `sequence` ids.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A document is its ids and end_id; null and empty texts are end_id alone. Longer
    documents are cut into full pieces and a rest. Pieces of equal length are interchangeable:
    they take the slots of their length in the order of doc_id (null first), start and crc, so
    repeated rows and ties are defined. An empty table packs into nothing. Only doc_id and text
    are read.
    A Python worker keeps the ids of so many words as cache_words says, twice at most; results do not depend on it.
    The driver holds the histogram (at most `sequence` rows) and the slots made from it.
    """
    spark = docs.sparkSession
    # Written before they are ordered: range partitioning reads its input twice.
    pieces = stash(pieces_of(docs, path or vocabulary("word_bpe_49k.json"), sequence, end_id, cache_words), "pieces")
    pieces = ranked(pieces, ["length", "doc_id", "start", "ids_crc32", "doc_tokens"], "ranked-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan_slots(histogram, sequence)
    table = slot_table(spark, slots)
    if len(slots) <= BROADCAST_SLOTS:
        table = F.broadcast(table)
    inside = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return pieces.join(table, inside).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset",
    )


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), ids in offset order.

    Documents are tokenised again and cut alike; doc_id must be unique here. A sequence holds
    at most `sequence` ids, so its pieces meet in one row.
    """
    path = path or vocabulary("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = _document_ids((text or "").encode(), path, end_id)
                for at in range(0, ids.size, sequence):
                    for column, value in zip(out, (doc_id, at, ids[at : at + sequence].astype(np.int32))):
                        column.append(value)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_doc", "_start", "_ids"])

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "_doc long, _start long, _ids array<int>")
    joined = packed.join(parts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("start") == F.col("_start")))
    rows = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "_ids"))).alias("_parts"))
    return rows.select("sequence_id", F.flatten(F.transform("_parts", lambda p: p["_ids"])).alias("ids"))
