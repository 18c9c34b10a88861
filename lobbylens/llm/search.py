"""Ranked lexical search: NRA, sequential reads of impact-sorted lists without random access."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobbylens.llm.common import SLICE_BYTES, ranked, stash, texts

TOP = 50
#: Distinct terms of the items that are searched in one pass; more items take more passes.
PASS_TERMS = 1 << 19
#: Postings of an index block, in which lists are sorted and read. One document may exceed it.
BLOCK_POSTINGS = 1 << 20
#: Cells of the table of seen terms that a search keeps (terms of the item x documents of the block).
SEEN_CELLS = 1 << 26
#: Postings that the first round reads of every list; each round reads as many as all before.
FIRST_READ = 32

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def term_counts(text: bytes) -> Counter:
    """Terms [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with A-Z lower-cased and how often they occur."""
    text = text.lower()  # of bytes: A-Z only
    if len(text) <= SLICE_BYTES:
        return Counter(_TERM.findall(text))
    out, at = Counter(), 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE_BYTES)
        end = gap.start() if gap else len(text)
        out.update(_TERM.findall(text, at, end))
        at = end
    return out


def _map_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(texts(batch)):
            found = list(term_counts(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array([i] * len(found), pa.int64())), pa.array(found, pa.binary())], names=["item", "term"]
            )


def _map_index(vocabulary):
    """Per document with terms its length and its postings for the terms that are searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = vocabulary.value
        for batch in batches:
            rows, sizes, offsets, terms, counts = [], [], [0], [], []
            for i, text in enumerate(texts(batch)):
                found = term_counts(text)
                if not found:
                    continue
                rows.append(i)
                sizes.append(sum(found.values()))
                for term, count in found.items():
                    at = place.get(term)
                    if at is not None:
                        terms.append(at)
                        counts.append(count)
                offsets.append(len(terms))
            offsets = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    return run


def _map_frequencies(size: int):
    """Documents per term, added up per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df = np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            held = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["term", "df"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search_block(lists: list[tuple[np.ndarray, np.ndarray]], size: int, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block that may be among the best, with their exact scores.

    lists: per term of the item impacts (falling) and documents (0 to size - 1). All lists are read
    from the front in rounds. A document's lower bound is the sum of the impacts met so far; its
    upper bound adds the next unread impact of every list in which it has not been met. Reading goes
    on until no unmet document can reach the top-th lower bound (or floor, a score that has been
    reached that often elsewhere) and every document that still can has equal bounds: then
    membership, ties and scores are settled.
    """
    low = np.zeros(size, np.int64)
    seen = np.zeros((len(lists), size), bool)
    heads = np.zeros(len(lists), np.int64)
    depth, step = 0, FIRST_READ
    while True:
        for j, (impacts, docs) in enumerate(lists):
            met = docs[depth : depth + step]
            low[met] += impacts[depth : depth + step]
            seen[j, met] = True
            heads[j] = impacts[depth + step] if depth + step < impacts.size else 0
        depth += step
        step = depth
        rest = int(heads.sum())
        met = np.flatnonzero(low)
        bound = max(floor, 1)
        if met.size >= top:
            bound = max(bound, int(np.partition(low[met], met.size - top)[met.size - top]))
        if rest >= bound:
            continue
        missing = rest - heads @ seen[:, met]
        able = low[met] + missing >= bound
        if not missing[able].any():
            return met[able], low[met[able]]


def _map_search(items, weights, documents: int, length: int, top: int, block_postings: int):
    """Per task the best documents of each item, block by block of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weigh = items.value, weights.value
        cap = max(1, SEEN_CELLS // max((t.size for t in wanted), default=1))
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(wanted)
        for batch in batches:
            ids = batch.column("doc_id").fill_null((1 << 63) - 1).to_numpy()
            ends = np.cumsum(batch.column("terms").value_lengths().to_numpy())
            terms, counts = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
            # Integers of any size: 50 x words x documents may pass 64 bits in a large corpus.
            norm = np.array([50 + 50 * n * documents // length for n in batch.column("n").to_pylist()], np.int64)
            at = 0
            while at < ids.size:
                first = int(ends[at - 1]) if at else 0
                end = min(max(int(np.searchsorted(ends, first + block_postings, "right")), at + 1), at + cap)
                part = slice(first, int(ends[end - 1]))
                docs = np.repeat(np.arange(end - at), np.diff(ends[at:end], prepend=first))
                tf = counts[part].astype(np.int64)
                impacts = weigh[terms[part]] * (1_000_000_000 * tf // (1000 * tf + 20 * norm[at:end][docs]))
                order = np.lexsort((-impacts, terms[part]))
                order = order[impacts[order] > 0]
                impacts, docs, listed = impacts[order], docs[order], terms[part][order]
                starts = np.searchsorted(listed, np.arange(weigh.size + 1))
                for i, of_item in enumerate(wanted):
                    lists = [(impacts[a:b], docs[a:b]) for a, b in zip(starts[of_item], starts[of_item + 1]) if a < b]
                    if not lists:
                        continue
                    held, scores = best[i]
                    found, fresh = search_block(lists, end - at, top, int(scores[-1]) if scores.size == top else 0)
                    held, scores = np.concatenate((held, ids[at:end][found])), np.concatenate((scores, fresh))
                    keep = np.lexsort((held, -scores))[:top]
                    best[i] = held[keep], scores[keep]
                at = end
        for i, (held, scores) in enumerate(best):
            held = pa.array(held, pa.int64(), mask=held == (1 << 63) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(scores.size, i, np.int32)), held, pa.array(scores)], names=["item", "doc_id", "score"]
            )

    return run


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_pass(docs: DataFrame, items: DataFrame, top: int, block_postings: int) -> DataFrame:
    """Search the items of one pass. items: item, item_id, terms (array of binary)."""
    spark = docs.sparkSession
    held = items.orderBy("item").toArrow()
    vocabulary = sorted({t for row in held["terms"].to_pylist() for t in row})
    place = {t: i for i, t in enumerate(vocabulary)}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = rows.mapInArrow(_map_index(spark.sparkContext.broadcast(place)), "doc_id long, n long, terms array<int>, counts array<int>")
    index = stash(index, "postings")
    size = index.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    frequencies = index.select("terms").mapInArrow(_map_frequencies(len(vocabulary)), "term int, df long")
    frequencies = frequencies.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in zip(frequencies["term"].to_pylist(), frequencies["df"].to_pylist()):
        weights[term] = weight(size["documents"], df)
    wanted = [np.array(sorted(place[t] for t in row), np.int64) for row in held["terms"].to_pylist()]
    broadcast = spark.sparkContext.broadcast
    search = _map_search(broadcast(wanted), broadcast(weights), size["documents"], size["length"] or 1, top, block_postings)
    found = index.mapInArrow(search, "item int, doc_id long, score long")
    # Every task reports each item: two steps keep both small, whatever the number of tasks.
    salts = max(1, math.isqrt(size["documents"] // 50_000))
    found = _best(found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))), ["item", "salt"], top).drop("rank", "salt")
    names = spark.createDataFrame(pa.table({"item": pa.array(range(held.num_rows), pa.int32()), "item_id": held["item_id"]}))
    return _best(found, ["item"], top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, pass_terms: int = PASS_TERMS, block_postings: int = BLOCK_POSTINGS
) -> DataFrame:
    """The best documents for each item: item_id, rank (from 1), doc_id, score.

    A document's score is the sum, over the terms that it shares with the item, of integer weights
    of the terms times integer saturations of their counts; statistics cover all documents. Equal
    scores go by ascending doc_id, null last; only scores above 0 are listed.

    1. Texts become postings for the terms of the items, written as a narrow index table.
    2. Every task cuts its part of the index into blocks of documents, sorts each block's lists by
       impact and searches every item in it by NRA (search_block). The best scores of the blocks
       before raise the bar, so most lists are left after their first postings. Blocks hold
       whole documents, so a block's answer is final and memory is bounded by the block.
    3. The tasks' answers, at most `top` an item, are ranked in two steps.
    Items are searched in passes of about pass_terms distinct terms, the only thing held
    by the driver and broadcast, with one weight each; a pass reads all documents.

    Rows with the same item_id are one item with the terms of all; items or documents without a term
    find nothing and are not found; a repeated document row is ranked each time; empty tables give
    an empty result. Only doc_id, text and item_id are read.
    """
    spark = docs.sparkSession
    ids = ranked(items.select("item_id").distinct(), ["item_id"], "item-ids").select("item_id", F.col("rank").alias("item"))
    ids = stash(ids, "items")
    named = items.select(F.col("item_id").alias("_id"), "text").join(ids, F.col("_id").eqNullSafe(F.col("item_id")))
    terms = stash(named.select("item", "text").mapInArrow(_map_items, "item long, term binary").distinct(), "item-terms")
    sizes = stash(terms.groupBy("item").agg(F.count("*").alias("size")), "item-sizes")
    passes = ranked(sizes, ["item"], "item-passes", weight="size")
    passes = stash(passes.select("item", F.floor(F.col("before") / F.lit(pass_terms)).alias("pass")), "passes")
    out = None
    for row in passes.select("pass").distinct().orderBy("pass").toLocalIterator():
        chosen = passes.where(F.col("pass") == row["pass"]).join(terms, "item").groupBy("item").agg(F.collect_list("term").alias("terms"))
        found = stash(_search_pass(docs, chosen.join(ids, "item"), top, block_postings), "found")
        out = found if out is None else out.union(found)
    if out is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
