"""Raw little-endian float32 blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.BinaryType())
def encode_block(values: pa.Array) -> pa.Array:
    """float array -> little-endian float32 bytes, all of a batch in one buffer."""
    sizes = values.value_lengths().fill_null(0).to_numpy()
    data = np.ascontiguousarray(values.flatten().to_numpy(zero_copy_only=False), "<f4")
    offsets = np.concatenate(([0], np.cumsum(sizes) * 4)).astype(np.int64)
    mask = pa.py_buffer(np.packbits(values.is_valid().to_numpy(zero_copy_only=False), bitorder="little"))
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [mask, pa.py_buffer(offsets), pa.py_buffer(data)])
    return packed.cast(pa.binary())


@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode_block(blocks: pa.Array) -> pa.Array:
    """Little-endian float32 bytes -> float array. The numbers of a batch are one view of its bytes."""
    blocks = blocks.cast(pa.large_binary())
    offsets = np.frombuffer(blocks.buffers()[1], np.int64)[blocks.offset : blocks.offset + len(blocks) + 1]
    raw = blocks.buffers()[2]
    data = np.frombuffer(raw, np.uint8, offsets[-1] - offsets[0], offsets[0]) if raw is not None else np.empty(0, np.uint8)
    values = pa.array(np.frombuffer(data.tobytes(), "<f4"))
    ends = pa.array((offsets - offsets[0]) // 4, pa.int32())
    return pa.ListArray.from_arrays(ends, values, mask=blocks.is_null())


def decode_blocks(df: DataFrame, content: str, expected_floats: int, into: str = "values") -> DataFrame:
    """Decode blocks of exactly the expected size; others get NULL and `is_bad`."""
    fits = F.octet_length(content) == expected_floats * 4
    return df.withColumn("is_bad", ~F.coalesce(fits, F.lit(False))).withColumn(
        into, decode_block(F.when(fits, F.col(content)))
    )


def read_blocks(spark: SparkSession, root: str, expected_floats: int) -> DataFrame:
    """Block files `{start}-{end}.features`; a file of another length is skipped
    by its listed length, before its content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.features")
        .load(root)
        .where(F.col("length") == expected_floats * 4)
        .select("path", "content")
    )
    return decode_blocks(files, "content", expected_floats).drop("content", "is_bad")
