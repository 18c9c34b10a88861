"""Order-dependent operators that survive a hot key.

A plain window over `partitionBy(game)` puts a whole game on one task. Here a
key is first cut into chunks of its order column. Each chunk is folded on its
own task, the per-chunk totals (one row per key and chunk) are folded across
chunks, and the carried-in value is joined back on (key, chunk). Rows are
shuffled once, by (key, chunk), whatever the size of the largest key. A chunk
holds at most as many rows as its span of the order column, because order
columns are unique within a key. A NULL order sorts first and stays; a NULL key
raises an error. `numbered` needs no span: it cuts any order, of any type, where
the data lie.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobbylens.session import run_folder

FRAME_CHUNK = 1 << 16
ROW_CHUNK = 1 << 20
CHUNK = "_chunk"
# Before every chunk of a whole-number order: rows whose order is NULL.
NULL_CHUNK = -(1 << 62)


@dataclass(frozen=True)
class Fold:
    """One running value: sum, count, max, min or last (newest non-NULL).

    `exclusive` leaves the current row out; `whole` folds the entire key.
    """

    name: str
    how: str
    value: Column
    exclusive: bool = False
    whole: bool = False

    def aggregate(self) -> Column:
        return {
            "sum": F.sum, "count": F.count, "max": F.max, "min": F.min,
            "last": lambda c: F.last(c, ignorenulls=True),
        }[self.how](self.value)

    def chunk_total(self, order: Column) -> Column:
        if self.how == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), order))
        return self.aggregate()

    def carry(self, total: Column) -> Column:
        how = "sum" if self.how == "count" else self.how
        return Fold(self.name, how, total).aggregate()

    def combine(self, carried: Column, local: Column) -> Column:
        if self.how in ("sum", "count"):
            return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
        if self.how == "max":
            return F.greatest(carried, local)
        if self.how == "min":
            return F.least(carried, local)
        return F.coalesce(local, carried)


def span(order: str | Column, size: int = FRAME_CHUNK) -> Column:
    """Chunk number of a whole-number order column."""
    column = F.col(order) if isinstance(order, str) else order
    return F.floor(column / F.lit(size))


def scatter(*columns: str | Column, parts: int = 64) -> Column:
    """Chunk number that spreads rows evenly by the hash of the given columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts))


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    folds: Sequence[Fold],
    chunk: Column | None = None,
    reverse: bool = False,
    attach: DataFrame | None = None,
    keep_chunk: bool = False,
) -> DataFrame:
    """Add one column per fold, running over `order` within `keys`.

    `reverse` scans from the end. `attach` is a table with one row per key; its
    columns are carried along through the chunk totals, so a group-level value
    reaches every row without a shuffle by the bare key. With `keep_chunk` the
    chunk number stays in the result, and a following scan that finds it there
    works on the rows where they lie.
    """
    keys = list(keys)
    if chunk is None and CHUNK in df.columns:
        chunked = df
    else:
        cut = span(order[0]) if chunk is None else chunk
        chunked = df.withColumn(CHUNK, F.coalesce(cut.cast("bigint"), F.lit(NULL_CHUNK)))
    sort = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    position = F.struct(*order)
    part = W.partitionBy(*keys, CHUNK).orderBy(*sort)
    running = [f for f in folds if not f.whole]

    totals = chunked.groupBy(*keys, CHUNK).agg(
        *(
            (_first_in_scan(f, position) if reverse and f.how == "last" else f.chunk_total(position)).alias(
                f"_t_{f.name}"
            )
            for f in folds
        ),
        F.count(F.lit(1)).alias("_t_rows"),
    )
    group = W.partitionBy(*(keys or [F.lit(0)]))
    chunk_sort = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
    before = group.orderBy(chunk_sort).rowsBetween(W.unboundedPreceding, -1)
    everything = group.orderBy(chunk_sort).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carried = totals.select(
        *_given(totals, keys),
        CHUNK,
        *(
            f.carry(F.col(f"_t_{f.name}")).over(everything if f.whole else before).alias(f"_c_{f.name}")
            for f in folds
        ),
    )
    if attach is not None:
        carried = carried.join(attach, keys, "left")

    local = chunked.select(
        "*",
        *(
            f.aggregate()
            .over(part.rowsBetween(W.unboundedPreceding, -1 if f.exclusive else W.currentRow))
            .alias(f"_l_{f.name}")
            for f in running
        ),
    )
    out = local.join(carried, [*keys, CHUNK], "inner")
    attached = [c for c in (attach.columns if attach is not None else []) if c not in keys]
    return out.select(
        *(c for c in df.columns if c != CHUNK),
        *([CHUNK] if keep_chunk else []),
        *attached,
        *(
            (
                F.col(f"_c_{f.name}")
                if f.whole
                else f.combine(F.col(f"_c_{f.name}"), F.col(f"_l_{f.name}"))
            ).alias(f.name)
            for f in folds
        ),
    )


def _given(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """The keys, which must not be NULL: a join by key would lose rows without one silently."""
    return [
        F.when(F.col(k).isNull(), F.raise_error(F.lit(f"NULL in key column {k}")).cast(df.schema[k].dataType))
        .otherwise(F.col(k)).alias(k)
        for k in keys
    ]


def _first_in_scan(fold: Fold, position: Column) -> Column:
    return F.min_by(fold.value, F.when(fold.value.isNotNull(), position))


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    weight: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row within its key (`weight`: the weight before it).

    Works for orders of any type and density: rows are cut into ranges of (key, order) by
    the data themselves, counted per range and key, and the counts are summed up, so a
    key of any size lies on as many tasks as it needs. NULLs sort first. `total` adds the
    rows or weight of the whole key.
    """
    keys = list(keys)
    sort = [*(F.col(k) for k in keys), *(F.col(o) if isinstance(o, str) else o for o in order)]
    path = run_folder(df.sparkSession, "numbered")
    laid = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    laid.write.parquet(path)
    laid = df.sparkSession.read.schema(laid.schema).parquet(path).withColumn("_range", F.shiftright("_at", 33))
    amount = F.col(weight) if weight else F.lit(1)
    parts = laid.groupBy(*keys, "_range").agg(F.sum(amount).alias("_sum"), F.min("_at").alias("_first"))
    group = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_range")
    everything = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    parts = parts.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
        F.col("_range").alias("_kr"),
        F.coalesce(F.sum("_sum").over(group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_sum").over(everything).alias("_total"),
        "_first",
    )
    same = F.col("_range") == F.col("_kr")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = laid.join(parts, same)
    if weight:
        inside = W.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
        place = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    else:
        place = F.col("_at") - F.col("_first")
    return out.select(
        *df.columns, (F.col("_base") + place).alias(name), *([F.col("_total").alias(total)] if total else [])
    )


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    chunk: Column | None = None,
    reverse: bool = False,
) -> DataFrame:
    """0-based position within the key, without one task per key."""
    fold = Fold(name, "count", F.lit(1), exclusive=True)
    return prefix_scan(df, keys, order, [fold], chunk, reverse).withColumn(
        name, F.col(name).cast("bigint")
    )


def attach_group(
    df: DataFrame, attributes: DataFrame, keys: Sequence[str], chunk: Column, how: str = "left"
) -> DataFrame:
    """Join one-row-per-key attributes onto rows, spread by (key, chunk).

    The attributes are first copied to the chunks that occur, so the rows of a
    hot key meet them on many tasks. Rows without a chunk stay; a NULL key raises an error.
    """
    keys = list(keys)
    chunked = df.withColumn(CHUNK, F.coalesce(chunk.cast("bigint"), F.lit(NULL_CHUNK)))
    chunks = chunked.select(*keys, CHUNK).distinct()
    copies = chunks.select(*_given(chunks, keys), CHUNK).join(attributes, keys, how)
    return chunked.join(copies, [*keys, CHUNK], "inner").drop(CHUNK)


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    positions: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """Exact order statistics per key: name -> f(row count) = 0-based position.

    Equal values are counted map-side; the distinct values of a key are then
    ranked in ranges cut by the data, so no task sorts a whole group.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(counted, keys, [value], "_before", weight="_n", total="_rows")

    def at(position: Column) -> Column:
        hit = (position >= F.col("_before")) & (position < F.col("_before") + F.col("_n"))
        return F.max(F.when(hit, F.col(value)))

    picked = [at(f(F.col("_rows"))).alias(name) for name, f in positions.items()]
    return ranked.groupBy(*keys).agg(*picked, F.max("_rows").alias("n"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Midpoint median per key, for keys of any size."""
    both = order_statistics(
        df, keys, value, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)}
    )
    return both.withColumn(name, (F.col("_low") + F.col("_high")) / 2.0).drop("_low", "_high")


def lobby_list(member: Column, most: int = 6) -> Column:
    """The members of a lobby as an array; an error if there are more than a lobby holds."""
    too_many = F.raise_error(F.lit(f"more than {most} players in a lobby"))
    return F.when(F.count(F.lit(1)) > most, too_many).otherwise(F.collect_list(member))
