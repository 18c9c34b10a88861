"""Quality by nearest neighbours among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobbylens.llm.common import mix, released, texts, word_hashes

#: Hashed features: trigrams of byte classes, the repetition of words and word pairs, and terms
#: (words, and runs of letters of other scripts, which may have no spaces).
SHAPES = 1 << 11
BINS = 32
TERMS = 1 << 11
FEATURES = SHAPES + 2 * BINS + TERMS
#: Bytes of a run of letters: two of three bytes or three of two.
LETTERS = 6
#: Labelled documents that vectors are fitted on and that vote, at most about this many per
#: label, picked by a hash of doc_id: SAMPLE x 2 x FEATURES x 2 bytes are collected once.
SAMPLE = 1500
RANK = 48
NEIGHBOURS = 31
#: Similarities are raised to this power as weights.
SHARPNESS = 8
#: Documents of a block of cosine products.
BLOCK = 256
THRESHOLD = 0.7
_SLICE = 1 << 20


def _classes() -> np.ndarray:
    """Classes of bytes: upper and lower case, digits, bytes of other scripts, each other byte."""
    out = np.arange(256, dtype=np.uint32)
    out[0x41:0x5B], out[0x61:0x7B], out[0x30:0x3A] = 1, 2, 3
    out[0x80:0xC0], out[0xC0:] = 4, 5
    return out


_CLASS = _classes()


def _repetition(words: np.ndarray) -> np.ndarray:
    """Where the share of distinct items lies, as a soft position among BINS bins."""
    out = np.zeros(BINS, np.float32)
    if words.size:
        place = np.unique(words).size / words.size * (BINS - 1)
        low = int(place)
        out[low] = 1 - (place - low)
        out[min(low + 1, BINS - 1)] += place - low
    return out


def _letter_runs(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of the runs of LETTERS bytes >= 0x80 that begin with a letter."""
    if text.isascii():
        return
    for at in range(0, len(text), _SLICE):
        raw = np.frombuffer(text, np.uint8, min(_SLICE + LETTERS - 1, len(text) - at), at)
        n = raw.size - LETTERS + 1
        if n <= 0:
            continue
        inside = raw[:n] >= 0xC0
        for i in range(1, LETTERS):
            inside &= raw[i : i + n] >= 0x80
        starts = np.flatnonzero(inside)
        code = np.zeros(starts.size, np.uint64)
        for i in range(LETTERS):
            code = code << np.uint64(8) | raw[starts + i]
        with np.errstate(over="ignore"):
            yield mix(code)


def features(text: bytes) -> np.ndarray:
    """Log counts of class trigrams per thousand, repetition of words and word pairs, log counts of terms."""
    counts, size = np.zeros(SHAPES, np.int64), 0
    for at in range(0, len(text), _SLICE):
        c = _CLASS[np.frombuffer(text, np.uint8, min(_SLICE + 2, len(text) - at), at)]
        if c.size > 2:
            code = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
            counts += np.bincount(((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(21), minlength=SHAPES)
            size += c.size - 2
    words = word_hashes(text, lower=True)
    pairs = mix(words[1:] * np.uint64(3) + words[:-1]) if words.size > 1 else words
    shapes = np.log1p(counts * (1000.0 / max(size, 1))).astype(np.float32)
    counts, size = np.zeros(TERMS, np.int64), 0
    for terms in (words, *_letter_runs(text)):
        counts += np.bincount((terms & np.uint64(TERMS - 1)).astype(np.int64), minlength=TERMS)
        size += terms.size
    tf = np.log1p(counts * (1000.0 / max(size, 1))).astype(np.float32)
    return np.concatenate((shapes, 2 * _repetition(words), 2 * _repetition(pairs), tf))


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Features with their terms as tf-idf of length 1."""
    x = x.copy()
    terms = x[:, -TERMS:]
    terms *= idf
    terms /= np.maximum(np.linalg.norm(terms, axis=1, keepdims=True), 1e-9)
    return x


@dataclass
class Model:
    """Term weights, projection to the latent space, labelled vectors with labels and vote weights."""

    idf: np.ndarray
    mean: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (_weighted(x, self.idf) - self.mean) @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors, over the exact cosines with all of them."""
        if not self.labels.size:
            return np.full(x.shape[0], self.prior)
        cosine = self.latent(x) @ self.vectors.T
        k = min(NEIGHBOURS, self.labels.size)
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3) ** SHARPNESS * self.weights[near]
        return np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


def _axes(x: np.ndarray) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a fixed start."""
    rank = min(RANK, *x.shape)
    basis = np.random.default_rng(1).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(x.dtype)
    for _ in range(6):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :rank]


def fit(x: np.ndarray, y: np.ndarray, positive: float) -> Model:
    """Latent-semantic vectors of labelled documents; votes are weighted back to the true share."""
    idf = (np.log((1 + x.shape[0]) / (1 + (x[:, -TERMS:] > 0).sum(axis=0))) + 1).astype(np.float32)
    centred = _weighted(x, idf)
    mean = centred.mean(axis=0)
    centred -= mean
    spread = (centred**2).mean(axis=0)
    scale = np.sqrt(spread) + np.float32(0.05)
    # Terms share one scale, so that idf counts, and vary as much as all other features together.
    others = (spread / scale**2)[:-TERMS].sum()
    scale[-TERMS:] = np.sqrt(max(spread[-TERMS:].sum(), 1e-6) / max(others, 1e-6))
    projection = (_axes(centred / scale) / scale[:, None]).astype(np.float32)
    share = max(float(y.mean()), 1e-9)
    weights = np.where(y == 1, positive / share, (1 - positive) / max(1 - share, 1e-9)).astype(np.float32)
    model = Model(idf, mean.astype(np.float32), projection, np.empty((0, 0), np.float32), y.astype(np.float32), weights, positive)
    model.vectors = model.latent(x.astype(np.float32)).astype(np.float32)
    return model


def _map_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            vectors = pa.array([features(t).astype(np.float16).tobytes() for t in texts(part)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.select(["l_id", "quality"]).columns, vectors], names=["l_id", "quality", "vector"])


def _map_scores(model, names: list[str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                scores = model.value.scores(np.vstack([features(t) for t in texts(part, "_text")])).astype(np.float64)
                columns = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=names)

    return run


def held_out(folds: int = 4, held: int = 2):
    """Whether a row is kept from learning: crc32(doc_id as text) mod folds = held, or no doc_id."""
    bucket = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(bucket == held, F.lit(True))


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of labelled documents outside the held-out fold."""
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("l_id"), "quality")
    # One label per document; rows that disagree teach nothing.
    marked = marked.groupBy("l_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    marked = marked.where("quality = other").select("l_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    empty = Model(*[np.zeros((0, 0), np.float32)] * 4, np.zeros(0, np.float32), np.zeros(0, np.float32), 0.5)
    if not total:
        return empty
    coin = F.pmod(F.xxhash64("l_id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("quality") == 1, min(1.0, sample / counts.get(1, 1))).otherwise(min(1.0, sample / counts.get(0, 1)))
    # A bounded number of ids and labels, so it may be broadcast.
    picked = F.broadcast(marked.where(coin < share))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, F.col("doc_id") == F.col("l_id"))
    rows = rows.select("l_id", "quality", "text").mapInArrow(_map_features, "l_id long, quality int, vector binary")
    # One row per id, however often it is repeated.
    table = rows.groupBy("l_id").agg(F.min("quality").alias("quality"), F.min("vector").alias("vector")).orderBy("l_id").toArrow()
    if not table.num_rows:
        return empty
    x = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float16).reshape(-1, FEATURES).astype(np.float32)
    return fit(x, table["quality"].to_numpy(), counts.get(1, 0) / total)


def score_quality(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The named narrow columns of every document with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("text").alias("_text"), *keep)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:]] + ["score double", "predicted int"]
    return rows.mapInArrow(_map_scores(sent, [f.split()[0] for f in fields], threshold), ", ".join(fields))


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows predicted 1, with all their columns as they are; each is judged and kept or dropped where it lies.

    Scores are those of quality_scores, so rows with equal texts stay or go together.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn_quality(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                scores = model.value.scores(np.vstack([features(t) for t in texts(part)]))
                yield part.filter(pa.array(scores.astype(np.float64) >= threshold))

    return docs.mapInArrow(released(run), docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Quality of every document: doc_id, held_out, key (xxhash64 of the text), score, predicted.

    Labels are learned outside the held-out fold only; labels, lang, source and doc_id are no
    inputs of a score. score is the share of votes for label 1 among the nearest labelled
    vectors (exact cosines with all of them, in blocks), predicted is 1 from 0.7 on. Null and
    empty texts get the score of their (empty) features; rows without doc_id count as held out;
    contradictory labels of one doc_id are not used, labels other than 0 and 1 neither; without
    labels every score is 0.5. Repeated rows are scored each; an empty table gives an empty
    result; further columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"), F.xxhash64("text").alias("key")
    )
    return score_quality(rows, learn_quality(docs, labels, sample), ["doc_id", "held_out", "key"])
