"""Language identification with error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobbylens.llm.common import stash, texts

#: Hashed features: byte trigrams of the text, A-Z lower-cased.
FEATURES = 1 << 12
#: Texts per language that the classifiers are fitted on, at most about this many, picked by a
#: hash of the text. They stay on the workers: what is summed up has a fixed size.
SAMPLE = 600
#: Longest code. More languages than this have codewords of random bits, still far apart.
LONGEST = 2047
#: Sampled texts that one task sums up, and rows of the sum in a block.
PART = 20_000
BLOCK = 256
RIDGE = 3.0
#: Codewords closer than this share of the code length are ambiguous.
MARGIN = 0.05
UNKNOWN = "und"
_SLICE = 1 << 20
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 32
_FOLD[[*range(0x21), *range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def features(text: bytes) -> np.ndarray:
    """Square roots of trigram counts, scaled to length 1; everything but letters is a space."""
    counts = np.zeros(FEATURES, np.int64)
    for at in range(0, len(text), _SLICE):
        b = _FOLD[np.frombuffer(text, np.uint8, min(_SLICE + 2, len(text) - at), at)]
        if b.size > 2:
            code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
            counts += np.bincount(((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=FEATURES)
    value = np.sqrt(counts).astype(np.float32)
    return value / max(float(np.sqrt(counts.sum())), 1.0)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and +1: rows of a Hadamard matrix without its constant column.

    Any two differ in half the bits, so many wrong bits can be mended. Beyond LONGEST bits the
    codewords are pseudo-random ones of that length, which differ in nearly half.
    """
    if n > LONGEST + 1:
        bits = np.random.default_rng(7).integers(0, 2, (n, LONGEST), np.int8)
        return (2 * bits - 1).astype(np.float32)
    size = 16
    while size < n:
        size *= 2
    code = np.ones((1, 1), np.int8)
    while code.shape[0] < size:
        code = np.block([[code, code], [code, -code]])
    return code[:n, 1:].astype(np.float32)


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-weighted decoding: nearest codeword, its score, and whether a second one is as near.

    The loss of a bit is log(1 + exp(-4 margin bit)). Its two values differ by 4 margin, so the sums
    of two codewords over all bits differ as their inner products with the margins do.
    """
    loss = -2.0 * (margins @ code.T.astype(np.float64))
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    best = loss.argmin(axis=1)
    score = share[np.arange(best.size), best] / share.sum(axis=1)
    if code.shape[0] < 2:
        return best, score, np.zeros(best.size, bool)
    two = np.partition(loss, 1, axis=1)[:, :2]
    return best, score, two[:, 1] - two[:, 0] < MARGIN * code.shape[1]


def with_bias(x: np.ndarray) -> np.ndarray:
    """A constant feature carries the bias."""
    return np.hstack([x, np.full((x.shape[0], 1), 0.1, x.dtype)])


def _map_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            vectors = [features(t).astype(np.float16).tobytes() for t in texts(part)]
            yield pa.RecordBatch.from_arrays([*part.select(["lang", "key"]).columns, pa.array(vectors, pa.binary())], names=["lang", "key", "vector"])


def _sums(batches: Iterator[pa.RecordBatch], place: dict[str, int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'WT of some sampled texts."""
    code = codewords(len(place))
    left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros((FEATURES + 1, code.shape[1]))
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            x = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.float16).reshape(-1, FEATURES)
            x = with_bias(x.astype(np.float32))
            y = np.asarray([place[lang] for lang in part.column("lang").to_pylist()], np.int64)
            weighted = x * weight[y][:, None].astype(np.float32)
            for at in range(0, FEATURES + 1, BLOCK):
                left[at : at + BLOCK] += weighted[:, at : at + BLOCK].T @ x
            right += weighted.T @ code[y]
    return left, right


def _solved(left: np.ndarray, right: np.ndarray) -> bytes:
    left[np.diag_indices_from(left)] += RIDGE
    return np.linalg.solve(left, right).astype(np.float32).tobytes()


def _map_solved(place: dict[str, int], weight: np.ndarray):
    """The weights, where one task holds the whole sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"sums": pa.array([_solved(*_sums(batches, place, weight))], pa.binary())})

    return run


def _map_blocks(place: dict[str, int], weight: np.ndarray):
    """A task's share of the sums, in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = _sums(batches, place, weight)
        for block, at in enumerate(range(0, FEATURES + 1, BLOCK)):
            both = np.hstack([left[at : at + BLOCK], right[at : at + BLOCK]])
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "sums": pa.array([both.tobytes()], pa.binary())})

    return run


def _add_blocks(blocks):
    """The tasks' blocks of one place added up; there are as many as tasks."""
    total = sum(np.frombuffer(b) for b in blocks["sums"])
    return blocks[:1].assign(sums=[total.tobytes()])


def _solve_blocks(blocks):
    """The weights from the added blocks, which together are one matrix of fixed size."""
    both = np.frombuffer(b"".join(blocks.sort_values("block")["sums"])).reshape(FEATURES + 1, -1)
    return blocks[:1].assign(sums=[_solved(both[:, : FEATURES + 1].copy(), both[:, FEATURES + 1 :])])


def _map_predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights, code = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raw = list(texts(part))
                names, scores, unsure = [UNKNOWN] * len(raw), np.zeros(len(raw)), np.zeros(len(raw), bool)
                if languages:
                    x = np.vstack([features(t) for t in raw])
                    margins = with_bias(x) @ weights
                    best, scores, unsure = decode(margins.astype(np.float64), code)
                    letters = [_has_letter(t) for t in raw]
                    names = [languages[b] if has else UNKNOWN for b, has in zip(best, letters)]
                    scores = np.where(letters, scores, 0.0)
                    unsure |= ~np.asarray(letters)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(names), pa.array(scores), pa.array(unsure)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


def learn_languages(docs: DataFrame, learnable, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, weights, codewords) from the text and lang of learnable rows with text.

    Ridge regression of the bits on the features, languages weighted alike. The tasks sum
    up the normal equations in feature space, one task solves them; the driver gets the weights
    and the names of the languages.
    """
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("key", F.xxhash64("text", F.lit(5)))
    counts = stash(known.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")), "language-counts")
    # Each language is thinned to about `sample` texts by a hash; a repeated text counts once.
    coin = F.pmod(F.col("key"), F.lit(1 << 20)) / float(1 << 20)
    rows = known.join(counts, "lang").where(coin * F.col("n") < sample)
    rows = rows.select("lang", "key", "text").mapInArrow(_map_features, "lang string, key long, vector binary")
    rows = stash(rows.groupBy("lang", "key").agg(F.first("vector").alias("vector")), "language-sample")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    languages, total = list(sizes), sum(sizes.values())
    code = codewords(len(languages))
    if not languages:
        return [], np.zeros((FEATURES + 1, 0), np.float32), code
    weight = np.asarray([total / (len(sizes) * n) for n in sizes.values()])
    place = {lang: i for i, lang in enumerate(languages)}
    parts = -(-total // PART)
    if parts == 1:
        solved = rows.repartition(1).mapInArrow(_map_solved(place, weight), "sums binary")
    else:
        blocks = rows.repartition(parts, "key").mapInArrow(_map_blocks(place, weight), "block int, sums binary")
        blocks = blocks.groupBy("block").applyInPandas(_add_blocks, "block int, sums binary")
        solved = blocks.groupBy().applyInPandas(_solve_blocks, "block int, sums binary")
    solved = solved.first()["sums"]
    return languages, np.frombuffer(bytes(solved), np.float32).reshape(FEATURES + 1, -1), code


def identify_languages(docs: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """Language of every document, learned from the rows outside the held-out fold.

    Rows with crc32(doc_id as text) mod folds = held are held out. Returns doc_id, held_out,
    lang_pred, score (0 to 1), ambiguous (two codewords about as near, or no letter). Each
    language is a codeword; a ridge classifier on hashed trigrams of the whole text predicts
    each bit; the codeword with the least logistic loss over all bits is the language.
    Null texts and texts without a letter are `und` with score 0, as is everything if no row
    has a lang. A null doc_id counts as held out. Repeated rows are predicted each; an empty
    table gives an empty result; columns besides doc_id, text and lang are not read.
    """
    bucket = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    docs = docs.withColumn("held_out", F.coalesce(bucket == held, F.lit(True)))
    model = docs.sparkSession.sparkContext.broadcast(learn_languages(docs, ~F.col("held_out"), sample))
    out = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return docs.select("doc_id", "held_out", "text").mapInArrow(_map_predict(model), out)
