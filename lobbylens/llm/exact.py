"""Exact dedup: a tree-merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobbylens.llm.common import shuffle_width, stash

#: Bits of the digest that one round settles: 2^4 runs are merged at a time.
RADIX_BITS = 4
KEY = ["sha", "size", "check"]
ORDER = ["at", *KEY, "neg_chars", "id_last", "row"]
MERGED = "at int, sha binary, size int, check long, neg_chars int, id_last long, row long, doc_id long, copies long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the sorted runs of a partition: of each key its first row stays and copies add up.

    Only the last key of a batch is held back, so memory is one batch whatever the run.
    """
    held, names = None, [f.split()[0] for f in MERGED.split(", ")]
    for batch in batches:
        table = pa.table(batch.columns, names)  # every column may be null, in all batches alike
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        fresh = np.zeros(table.num_rows, bool)
        fresh[0] = True
        for name in ["at", *KEY]:
            column = table[name].combine_chunks()
            fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(fresh)
        copies = np.add.reduceat(table["copies"].to_numpy(), starts)
        table = table.take(pa.array(starts))
        table = table.set_column(table.schema.get_field_index("copies"), "copies", pa.array(copies))
        held = table.slice(table.num_rows - 1)
        yield from table.slice(0, table.num_rows - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def merged_runs(rows: DataFrame, partitions: int, radix_bits: int = RADIX_BITS) -> DataFrame:
    """One row per key: its smallest row and the number of copies.

    Run r sends, in each round, what belongs to another digit of the digest to the run that
    differs from r in that digit only; the receiver merges up to 2^radix_bits sorted runs.
    After the last round run r holds all keys whose leading digest bits are r. Copies melt at
    every level, so a group that fills a third of the table is one row per run from the start.
    """
    bits = max(1, (max(2, partitions) - 1).bit_length())
    runs = 1 << bits
    level = rows.withColumn("at", F.pmod(F.spark_partition_id(), F.lit(runs)).cast("int"))
    names = [f.split()[0] for f in MERGED.split(", ")]
    level = level.select(*names).sortWithinPartitions(*ORDER).mapInArrow(_merge, MERGED)
    home = F.expr("cast(conv(hex(substr(sha, 1, 3)), 16, 10) AS int)").bitwiseAND(F.lit(runs - 1))
    done = 0
    while done < bits:
        width = min(radix_bits, bits - done)
        mask = ((1 << width) - 1) << done
        to = F.col("at").bitwiseAND(F.lit(~mask)).bitwiseOR(home.bitwiseAND(F.lit(mask)))
        level = level.withColumn("at", to).select(*names).repartitionById(runs, F.col("at"))
        level = level.sortWithinPartitions(*ORDER).mapInArrow(_merge, MERGED)
        done += width
    return level


def exact_groups(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Group documents whose texts are equal after deleting [\\x20\\x09-\\x0D].

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256, key
    (xxhash64 of the text).
    Of a group the row with most code points stays, then the smallest doc_id, then (for
    repeated rows) one of them, so exactly one row per group has kept = true.
    Equality is SHA-256 of the normalised text, held against its length and a second hash at
    every merge: rows that differ in one of them are different keys. Null and empty texts are
    one group. A null doc_id comes after all others. An empty table gives an empty result;
    further columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).alias("n_chars"),
        F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "").alias("bare"),
        F.xxhash64("text").alias("key"),
    )
    rows = stash(
        bare.select(
            "doc_id",
            "key",
            F.unhex(F.sha2(F.col("bare"), 256)).alias("sha"),
            F.octet_length("bare").alias("size"),
            F.xxhash64("bare").alias("check"),
            (-F.col("n_chars")).alias("neg_chars"),
            F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("id_last"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "exact",
    )
    merged = merged_runs(rows.withColumn("copies", F.lit(1).cast("long")), partitions or shuffle_width(spark))
    groups = merged.where("copies > 1").select(
        *[F.col(k).alias(f"g_{k}") for k in KEY],
        F.col("doc_id").alias("g_id"), F.col("row").alias("g_row"), F.col("copies").alias("g_copies"),
    )
    # Only groups of two and more take part; a hot one is split by the adaptive skew join.
    out = rows.join(groups, [F.col(k) == F.col(f"g_{k}") for k in KEY], "left")
    return out.select(
        "doc_id",
        F.when(F.col("g_row").isNull(), F.col("doc_id")).otherwise(F.col("g_id")).alias("keep_id"),
        F.coalesce("g_copies", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("g_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "key",
    )
