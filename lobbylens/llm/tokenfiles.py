"""Token ids as flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobbylens.llm.common import shuffle_width, stash
from lobbylens.llm.tokens import encoder, vocabulary
from lobbylens.session import run_folder

END_ID = 0
MANIFEST = "part int, path string, width int, docs long, ids long"
#: Stands for a null doc_id in the id file; no document may have it.
NULL_ID = -(1 << 63)
#: Documents of a batch of read rows.
READ_DOCS = 4096


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder: a mounted path or a store that Arrow can write to."""
    if re.match(r"file:/|/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, partitions: int | None = None
) -> DataFrame:
    """Tokenise documents and write them in ascending doc_id order; return the manifest.

    Each range of doc_ids becomes three files: `.bin` (ids, little-endian, two bytes while the
    vocabulary allows, else four), `.off` (documents + 1 offsets in ids, 64 bits, from 0) and
    `.doc` (doc_ids, 64 bits). Parts follow each other in the manifest; the position of a
    part's first id in the whole is the prefix sum over the earlier parts (`base`).
    A task writes files of its own name and lists them when they are whole, so a repeated
    task leaves files that no manifest names, never a torn part.
    Null doc_ids come first, null texts are end_id alone, repeated doc_ids are ordered by text,
    an empty table has an empty manifest.
    """
    spark = docs.sparkSession
    path = path or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        part = TaskContext.get().partitionId()
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        coder = encoder(path, False)
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end, at, sink = int(end_id).to_bytes(4, "little"), 0, None
        offsets, ids_of = [0], []
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if sink is None:
                        store.create_dir(root, recursive=True)
                        sink = store.open_output_stream(f"{name}.bin")
                    raw = coder.ids(text.as_py() or "") + end
                    sink.write(np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes())
                    at += len(raw) // 4
                    offsets.append(at)
                    ids_of.append(NULL_ID if doc_id is None else doc_id)
        finally:
            if sink is not None:
                sink.close()
        if sink is not None:
            for kind, values in (("off", offsets), ("doc", ids_of)):
                with store.open_output_stream(f"{name}.{kind}") as out:
                    out.write(np.asarray(values, "<i8").tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "path": pa.array([name]), "width": pa.array([width], pa.int32()),
                    "docs": pa.array([len(ids_of)], pa.int64()), "ids": pa.array([at], pa.int64()),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    laid = rows.repartitionByRange(partitions or shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stash(laid.mapInArrow(run, MANIFEST), "token-manifest")
    # One row per part: the bases are prefix sums over the parts, not over documents.
    return manifest.withColumn(
        "base", F.expr("coalesce(sum(ids) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")
    )


def _mapped(store: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is a mounted file, read from a store."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype)


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    ids_crc32 is the crc32 of the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids = _mapped(store, f"{row['path']}.bin", f"<u{row['width']}")
                offsets = _mapped(store, f"{row['path']}.off", "<i8")
                doc_ids = _mapped(store, f"{row['path']}.doc", "<i8")
                for lo in range(0, doc_ids.size, READ_DOCS):
                    cuts = offsets[lo : lo + READ_DOCS + 1]
                    crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts, cuts[1:])]
                    some = doc_ids[lo : lo + READ_DOCS]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(some, pa.int64(), mask=some == NULL_ID),
                            "start": pa.array(cuts[:-1] + row["base"], pa.int64()),
                            "n_tokens": pa.array(np.diff(cuts), pa.int64()),
                            "ids_crc32": pa.array(crcs, pa.int64()),
                        }
                    )

    spread = manifest.repartition(parts or shuffle_width(spark))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write documents to a fresh folder of the shared folder and return what the files hold."""
    spark = docs.sparkSession
    folder = run_folder(spark, "token-files")
    return read_token_files(spark, write_token_files(docs, folder, path, end_id), folder)
