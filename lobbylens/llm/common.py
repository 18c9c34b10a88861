"""Helpers the document operators share: word hashes, intermediate tables, global positions."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lobbylens.session import run_folder

#: Texts are turned into arrays in slices of about this many bytes, so that a very long
#: text needs eight bytes a word and no more.
SLICE_BYTES = 1 << 20
#: Bits of the fixed-size filters that are broadcast (4 MB).
FILTER_BITS = 25
#: Filters that grow with their rows have so many bits a row, and at most 2^MOST_BITS (64 MB).
ROW_BITS = 8
MOST_BITS = 29


#: Bytes of texts that a task hands to Python at a time, unless the session says how many.
HANDED_BYTES = 4 << 20
HANDED = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs inside hand rows to Python by bytes and not by thousands, whatever the length of the texts."""
    if spark.conf.get(HANDED, None) is not None:
        yield
        return
    spark.conf.set(HANDED, str(HANDED_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(HANDED)


def release() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable) -> Callable:
    """A map over batches whose worker, which Spark keeps for later stages, holds no freed memory after its task."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return mapped


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Lineage ends there: after the loss of an executor later jobs read the files again.
    Parquet keeps column pruning and gives the planner the real size.
    """
    path = run_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that no later job reads: what was made of them is written."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def sized(pairs: DataFrame, row_bytes: int = 16, limit: int = 8 << 20) -> DataFrame:
    """A table of narrow rows as the small side of a join with texts.

    Up to `limit` bytes it is broadcast, and the texts stay where they are; beyond, it is the hashed
    side, so that texts move once and need no sort.
    """
    return F.broadcast(pairs) if pairs.count() * row_bytes <= limit else pairs.hint("shuffle_hash")


def collect_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the files of shuffles that are done with.

    It does so once the driver's collector finds them unreferenced, which a driver with little
    else to collect would put off until the disks are full.
    """
    gc.collect()
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], name: str, weight: str | None = None) -> DataFrame:
    """Add `rank` (gapless from 0 in the order of keys, nulls first) and `total` rows.

    With weight also `before`, the weight of all earlier rows, and `total_weight`.
    Rows are range partitioned and counted per partition; the only thing that meets in one
    task is one row per partition. Rows equal in all keys take neighbouring ranks.
    """
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    laid = laid.withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    laid = stash(laid.drop("_at"), name)
    sums = {"_rows": F.count("*")}
    if weight:
        sums["_weight"] = F.sum(weight)
    parts = laid.groupBy("_part").agg(*[c.alias(n) for n, c in sums.items()])
    earlier = "OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bases = {"_base": f"coalesce(sum(_rows) {earlier}, 0L)", "total": "sum(_rows) OVER ()"}
    if weight:
        bases |= {"_wbase": f"coalesce(sum(_weight) {earlier}, 0L)", "total_weight": "sum(_weight) OVER ()"}
    parts = parts.select("_part", *[F.expr(sql).alias(n) for n, sql in bases.items()])
    # One row per partition of the sort: bounded by the partition count, whatever the data.
    out = laid.join(F.broadcast(parts), "_part").withColumn("rank", F.col("_base") + F.col("_place"))
    if weight:
        inside = f"sum({weight}) OVER (PARTITION BY _part ORDER BY _place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        out = out.withColumn("before", F.col("_wbase") + F.expr(f"coalesce({inside}, 0L)")).drop("_wbase")
    return out.drop("_part", "_place", "_base")


def null_last(column: str) -> Column:
    """An id that sorts after all others where it is null."""
    return F.coalesce(F.col(column), F.lit((1 << 63) - 1))


# Word hashes -----------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _mixed(seed: int, n: int) -> np.ndarray:
    """n scattered 64-bit numbers (splitmix)."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(7, 256)
_STEP = _mixed(11, 1 << 12) | np.uint64(1)


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """A 64-bit hash per word of [^\\x20\\x09-\\x0D]+, in order; A-Z may be folded."""
    if not text:
        return np.empty(0, np.uint64)
    out, at = [], 0
    while at < len(text):
        end = min(at + SLICE_BYTES, len(text))
        if end < len(text):
            cuts = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, end - at, at)])
            while not cuts.size and end < len(text):  # one word longer than a slice
                start, end = end, min(end + SLICE_BYTES, len(text))
                cuts = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, end - start, start)]) + (start - at)
            end = at + int(cuts[-1]) + 1 if cuts.size else end
        out.append(_slice_hashes(np.frombuffer(text, np.uint8, end - at, at), lower))
        at = end
    return out[0] if len(out) == 1 else np.concatenate(out)


def _slice_hashes(raw: np.ndarray, lower: bool) -> np.ndarray:
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edge[~space[edge]]
    if not space[0]:
        starts = np.concatenate(([0], starts))
    if not starts.size:
        return np.empty(0, np.uint64)
    ends = edge[space[edge]]
    if not space[-1]:
        ends = np.concatenate((ends, [raw.size]))
    size = ends - starts
    if lower:
        raw = _LOWER[raw]
    # Each byte is weighted by its place in its word; a word's hash is the sum over it.
    first = np.zeros(raw.size, np.int64)
    first[starts] = starts
    place = np.arange(raw.size) - np.maximum.accumulate(first)
    with np.errstate(over="ignore"):
        value = _BYTE[raw] * _STEP[place & 0xFFF]
        if int(size.max()) > 0xFFF + 1:  # weights repeat there; only bytes so far into a word change
            far = np.flatnonzero(place > 0xFFF)
            value[far] = mix(value[far] + place[far].astype(np.uint64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
        return mix(total[ends] - total[starts] + size.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def gram_hashes(words: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = words.size - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        steps = _mixed(seed, k) | np.uint64(1)
        total = words[:n] * steps[0]
        for i in range(1, k):
            total += words[i : i + n] * steps[i]
        return mix(total)


# Fixed-size filters ----------------------------------------------------------------------


def filter_width(rows: int) -> int:
    """Bits of a filter in which at most a quarter of the bits are set, for up to 2^MOST_BITS / ROW_BITS rows."""
    return min(max(FILTER_BITS, (ROW_BITS * rows - 1).bit_length()), MOST_BITS)


def filter_bits(df: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter over a 64-bit hash column: 2^bits bits whatever the number of rows.

    Set bits are gathered per 64-bit word before they reach the driver, so at most
    2^(bits - 6) rows do. It only ever lets more through than asked; the exact joins behind
    it decide. Once it is full everything passes, and the work is that without a filter.
    """
    mask = (1 << bits) - 1
    spots = F.explode(F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(mask)) for s in (0, 64 - bits)]))
    words = (
        df.select(spots.alias("spot"))
        .groupBy(F.shiftright("spot", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63L AS int)))").alias("set"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["set"].to_numpy()
    return out.view(np.uint64)


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    width = int(bits.size).bit_length() + 5
    mask = np.uint64((1 << width) - 1)
    found = np.ones(hashes.size, bool)
    for shift in (0, 64 - width):
        spot = (hashes >> np.uint64(shift)) & mask
        found &= (bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
    return found


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 of each text; null counts as empty."""
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py() or b""


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
