"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobbylens.llm.common import ranked

#: Bits of each dimension on the curve.
BITS = 6


def category_cells(docs: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(value, cell): values in their order, cut so that each cell holds about as many rows.

    Null is a value and comes first. The table has a row per distinct value and is counted
    before it moves; positions come from prefix sums over ranges, not from one sorted task.
    """
    counts = docs.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows"))
    placed = ranked(counts, ["value"], f"cells-{column}", weight="rows")
    middle = F.col("before") + F.col("rows") / 2
    cell = F.least(F.floor(middle * (1 << bits) / F.col("total_weight")), F.lit((1 << bits) - 1))
    return placed.select("value", cell.cast("int").alias("cell"))


def size_cell(size: Column, bits: int = BITS) -> Column:
    """Cells of equal ratios of sizes, up to the largest text there can be (two per doubling for 6 bits)."""
    per_doubling = (1 << bits) / 32
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * per_doubling).cast("int")


def with_hilbert(df: DataFrame, names: list[str], bits: int = BITS) -> DataFrame:
    """Add `hilbert`, the place of integer cells on the Hilbert curve (Skilling's transform).

    Native array functions over the few bits of a row; no lookup table, no Python.
    """
    n = len(names)

    def steps(low: int) -> str:
        return ", ".join(f"struct({1 << b}L AS q, {i} AS i)" for b in range(bits - 1, low - 1, -1) for i in range(n))

    # Undo the excess turns from the highest bit down.
    turn = "if((x[s.i] & s.q) <> 0, s.q - 1, (x[0] ^ x[s.i]) & (s.q - 1))"
    turned = f"CASE WHEN k = 0 OR (k = s.i AND (x[s.i] & s.q) = 0) THEN v ^ ({turn}) ELSE v END"
    undo = f"aggregate(array({steps(1)}), _cells, (x, s) -> transform(x, (v, k) -> {turned}))" if bits > 1 else "_cells"
    # Gray code: running xor over the dimensions, then one flip mask from the last of them.
    gray = "slice(aggregate(_turned, array(0L), (a, v) -> concat(a, array(element_at(a, -1) ^ v))), 2, 99)"
    levels = ", ".join(f"{1 << b}L" for b in range(bits - 1, 0, -1)) or "0L"
    flip = f"aggregate(array({levels}), 0L, (t, q) -> if((element_at(_gray, -1) & q) <> 0, t ^ (q - 1), t))"
    woven = f"aggregate(array({steps(0)}), 0L, (h, s) -> h * 2 + if(((_gray[s.i] ^ _flip) & s.q) <> 0, 1L, 0L))"
    out = df.withColumn("_cells", F.array(*[F.col(c).cast("long") for c in names]))
    for name, sql in (("_turned", undo), ("_gray", gray), ("_flip", flip), ("hilbert", woven)):
        out = out.withColumn(name, F.expr(sql))
    return out.drop("_cells", "_turned", "_gray", "_flip")


def hilbert_shards(
    docs: DataFrame, shards: int = 16, dims: tuple[str, ...] = ("lang", "source"), law: str = "rows", bits: int = BITS
) -> DataFrame:
    """Order documents along the curve over dims and size, cut the order into shards.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, hilbert, law, shard, slot (place in
    the shard, from 0), grown_shard (null: an added shard moves the cuts).
    law `rows`: counts differ by one at most. `bytes`: cuts at equal shares of the bytes.
    Neighbours on the curve agree in most dimensions, so files cut from it have narrow
    ranges in each. Rows with the same place are ordered by doc_id, so copies and a hot source
    spread over as many tasks and shards as they need. Null dimension values are a cell of
    their own; a null or empty text has size 1; repeated rows take neighbouring slots; columns
    besides dims, doc_id and text are not read.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
        *[F.col(d).cast("string").alias(f"dim_{i}") for i, d in enumerate(dims)],
    )
    for i, d in enumerate(dims):
        cells = category_cells(docs, d, bits).select(F.col("value").alias(f"value_{i}"), F.col("cell").alias(f"cell_{i}"))
        rows = rows.join(cells, F.col(f"dim_{i}").eqNullSafe(F.col(f"value_{i}")), "left").drop(f"value_{i}", f"dim_{i}")
    rows = rows.withColumn("cell_size", size_cell(F.col("size"), bits))
    names = [*[f"cell_{i}" for i in range(len(dims))], "cell_size"]
    rows = with_hilbert(rows, names, bits).drop(*names)
    placed = ranked(rows, ["hilbert", "doc_id", "text_crc32", "size"], "hilbert", weight="size" if law == "bytes" else None)
    if law == "rows":
        shard = F.expr(f"cast(rank * {shards} DIV total AS int)")
        placed = placed.withColumn("shard", shard)
        # The first rank of shard s is ceil(s * total / shards).
        first = F.expr(f"(shard * total + {shards - 1}) DIV {shards}")
        placed = placed.withColumn("slot", F.col("rank") - first)
    else:
        placed = placed.withColumn("shard", F.expr(f"cast((2 * before + size) * {shards} DIV (2 * total_weight) AS int)"))
        firsts = placed.groupBy(F.col("shard").alias("s")).agg(F.min("rank").alias("first"))
        placed = placed.join(F.broadcast(firsts), F.col("shard") == F.col("s"))  # one row per shard
        placed = placed.withColumn("slot", F.col("rank") - F.col("first"))
    return placed.select(
        "doc_id", "size", "text_crc32", "hilbert", F.lit(law).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write whole documents as shard=N folders in curve order; doc_id must be unique here."""
    place = placed.select(F.col("doc_id").alias("_id"), "shard", "slot")
    out = docs.drop("shard", "slot").join(place, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    out = out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)
