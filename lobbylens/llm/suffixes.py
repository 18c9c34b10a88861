"""Suffix-array dedup: a depth-limited radix sort of all suffixes, digit by digit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobbylens.llm.common import MOST_BITS, ROW_BITS, collect_shuffles, discard, filter_bits, filter_width, in_filter, mix, stash, texts

#: Bytes through which suffixes are ordered: the shortest repeat that is removed.
DEPTH = 50
#: Bytes of a gram. The first digit of a suffix is the smallest gram hash within its depth.
GRAM = 20
#: Places of a gram within the depth, and the longest run of suffixes in one row.
WIDTH = DEPTH - GRAM + 1
#: Neighbouring suffixes that share the second digit: the DEPTH - CLASS + 1 bytes common to them.
CLASS = 8
#: Bytes that are turned into arrays at a time: short texts together, long ones in parts.
SLICE = 1 << 17
#: Most rows of a batch that is handed to Spark.
BATCH = 1 << 18
#: Runs are compared a portion of the first digits at a time, and the last pass goes over the texts once for
#: each portion, which bounds what is on disk at once.
PORTIONS = 3
#: Repeated first digits of a round: as many as the largest filter holds. The passes behind run once for each round.
ROUND = (1 << MOST_BITS) // ROW_BITS
#: In place of a run: the whole text.
WHOLE_TEXT = -1

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_CLASSES = mix(np.arange(1, WIDTH + 2, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
RUNS = "ord long, key long, digit long, body long, start int, suffixes int"
SUFFIXES = "ord long, key long, digit long, suffix long, start int, offset int"
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for slices of the usual size."""
    size = 1 << max(12, (n - 1).bit_length())
    if not _POWERS or max(_POWERS) < size:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            one = np.concatenate(([np.uint64(1)], np.full(size - 1, _R)))
            back = np.concatenate(([np.uint64(1)], np.full(size - 1, _R_INVERSE)))
            _POWERS[size] = np.multiply.accumulate(one), np.multiply.accumulate(back)
    up, down = _POWERS[max(_POWERS)]
    return up[:n], down[:n]


def _scatter(x: np.ndarray) -> np.ndarray:
    """A cheaper finaliser, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class Digits:
    """Hashes of any part of some bytes, and the runs of suffixes with the same first digit.

    begins: where the texts in raw start. No suffix reaches from one text into the next.
    """

    def __init__(self, raw: np.ndarray, begins: np.ndarray | None = None) -> None:
        begins = np.zeros(1, np.int64) if begins is None else begins
        up, self._down = _powers(raw.size + 1)
        with np.errstate(over="ignore"):
            self._sums = np.zeros(raw.size + 1, np.uint64)
            np.cumsum(_BYTE[raw] * up[:-1], dtype=np.uint64, out=self._sums[1:])
            self._grams = _scatter((self._sums[GRAM:] - self._sums[:-GRAM]) * self._down[: raw.size - GRAM + 1])
        low, done = self._grams, 1
        while done < WIDTH:
            step = min(done, WIDTH - done)
            low = np.minimum(low[:-step], low[step:])
            done += step
        edge = np.ones(low.size + 1, bool)
        edge[1:-1] = low[1:] != low[:-1]
        inside = np.ones(low.size, bool)
        if begins.size > 1:
            step = np.zeros(raw.size + 1, np.int32)
            np.add.at(step, np.maximum(begins[1:] - DEPTH + 1, 0), 1)
            np.add.at(step, begins[1:], -1)
            inside = np.cumsum(step)[: low.size] == 0
            across = inside[1:] != inside[:-1]
            edge[1:-1] |= across
        places = np.flatnonzero(edge)
        self.starts, self.counts = places[:-1], np.diff(places)
        if begins.size > 1:
            real = inside[self.starts]
            self.starts, self.counts = self.starts[real], self.counts[real]
        if self.counts.size and self.counts.max() > WIDTH:  # the same gram over and over
            parts = -(-self.counts // WIDTH)
            run = np.repeat(np.arange(parts.size), parts)
            past = (np.arange(run.size) - np.repeat(np.cumsum(parts) - parts, parts)) * WIDTH
            self.starts, self.counts = self.starts[run] + past, np.minimum(self.counts[run] - past, WIDTH)
        self.digits = low[self.starts]
        #: The text that each run lies in.
        self.texts = np.searchsorted(begins, self.starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _scatter((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))

    def classes(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Some runs cut into classes of up to CLASS neighbours: run, first suffix, suffixes, second digit.

        A class is told by the distance of a suffix from the gram that is its first digit (the
        first of equal ones), so equal suffixes are in the same class wherever they occur. The
        second digit is the bytes that all suffixes of such a class share, whether they occur or not.
        """
        run, start, count = runs, self.starts[runs], self.counts[runs]
        pieces = []
        while run.size:
            at = start[:, None] + np.arange(WIDTH)
            place = start + np.argmax(self._grams[at] == self.digits[run][:, None], axis=1)
            n = np.minimum(count, place - start + 1)
            pieces.append((run, start, n, place))
            left = count > n
            run, start, count = run[left], (place + 1)[left], (count - n)[left]
        if not pieces:
            return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.uint64),)
        run, start, count, place = (np.concatenate(c) for c in zip(*pieces))
        far = place - start
        near = far - count + 1
        parts = far // CLASS - near // CLASS + 1
        each = np.repeat(np.arange(run.size), parts)
        c = near[each] // CLASS + np.arange(each.size) - np.repeat(np.cumsum(parts) - parts, parts)
        reach = np.minimum(far[each], c * CLASS + CLASS - 1)
        first = place[each] - reach
        core = place[each] - c * CLASS
        second = self.hashes(core, core + DEPTH - CLASS + 1) ^ _CLASSES[c]
        return run[each], first, reach - np.maximum(near[each], c * CLASS) + 1, second


def _parts(batches: Iterator[pa.RecordBatch], firsts=None):
    """The texts in parts of up to SLICE bytes, with the bytes behind that the last suffixes need.

    Yields per part the ord and key of its texts, the place in its text at which each begins, where that is in the
    part, and the digits. firsts: a filter of the rows that are not copies of an earlier text.
    """
    for batch in batches:
        orders, keys = batch.column("ord").to_numpy(), batch.column("key").to_numpy()
        text = batch.column("text").cast(pa.large_binary())
        keep = text.is_valid().to_numpy(zero_copy_only=False)
        if firsts is not None:
            keep = keep & in_filter(firsts.value, (keys ^ (orders << np.int64(17)) ^ orders).view(np.uint64))
        text, orders, keys = text.filter(pa.array(keep)), orders[keep], keys[keep]
        if not len(text) or text.buffers()[2] is None:
            continue
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8)
        i = 0
        while i < len(text):
            if offsets[i + 1] - offsets[i] > SLICE:
                for at in range(0, int(offsets[i + 1] - offsets[i]) - DEPTH + 1, SLICE):
                    raw = data[offsets[i] + at : min(offsets[i] + at + SLICE + DEPTH - 1, offsets[i + 1])]
                    yield orders[i : i + 1], keys[i : i + 1], np.array([at]), Digits(raw)
                i += 1
                continue
            end = int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1
            raw = data[offsets[i] : offsets[end]]
            if raw.size >= DEPTH:
                begins = offsets[i:end] - offsets[i]
                yield orders[i:end], keys[i:end], -begins, Digits(raw, begins)
            i = end


class _Rows:
    """Gathers columns of a mapped table and hands them on in batches."""

    def __init__(self, schema: str) -> None:
        fields = [field.split() for field in schema.split(", ")]
        self._names = [name for name, _ in fields]
        self._kinds = [np.int64 if kind == "long" else np.int32 for _, kind in fields]
        self._held: list[tuple] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        if columns[-1].size:
            self._held.append(columns)
            self.size += columns[-1].size

    def columns(self) -> list[np.ndarray]:
        held, self._held, self.size = self._held, [], 0
        wide = [np.concatenate(c) for c in zip(*held)]
        return [c.view(k) if c.dtype == np.uint64 else c.astype(k, copy=False) for c, k in zip(wide, self._kinds)]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in self.columns()], names=self._names)


def _map_digits(firsts):
    """First digits of the suffixes; n is 2 if several texts of the part have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            digits, n = rows.columns()
            by = np.argsort(digits, kind="stable")
            digits = digits[by]
            first = np.flatnonzero(np.concatenate(([True], digits[1:] != digits[:-1])))
            n = np.minimum(np.add.reduceat(n[by], first), 2).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(digits[first]), pa.array(n)], names=["digit", "n"])

        rows = _Rows("digit long, n int")
        for _, _, _, d in _parts(batches, firsts):
            if not d.digits.size:
                continue
            by = np.argsort(d.digits, kind="stable")
            digits, text = d.digits[by], d.texts[by]
            first = np.flatnonzero(np.concatenate(([True], digits[1:] != digits[:-1])))
            # The texts of a digit stay in their order, so the last differs if any does.
            last = np.concatenate((first[1:], [digits.size])) - 1
            rows.add(digits[first], 1 + (text[first] != text[last]))
            if rows.size >= 8 * BATCH:
                yield counted()
        if rows.size:
            yield counted()

    return run


class Share(NamedTuple):
    """The first digits of one round of several; the same code in SQL (DIGIT_ROUND)."""

    round: int = 0
    rounds: int = 1

    def of(self, d: Digits) -> np.ndarray:
        """Its runs."""
        if self.rounds == 1:
            return np.arange(d.digits.size)
        return np.flatnonzero((d.digits >> np.uint64(34)) % np.uint64(self.rounds) == self.round)


DIGIT_ROUND = "pmod(shiftrightunsigned(digit, 34), {rounds}) = {round}"
#: The smallest of many hashes has few high bits set, so a filter is given its low bits there too (as _digit_code).
DIGIT = "digit ^ shiftleft(digit, 32)"


def _digit_code(digits: np.ndarray) -> np.ndarray:
    return digits ^ (digits << np.uint64(32))


def _map_runs(firsts, bits, share: Share):
    """Runs whose first digit is in the filter, with a hash of all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(RUNS)
        for order, key, at, d in _parts(batches, firsts):
            keep = share.of(d)
            keep = keep[in_filter(bits.value, _digit_code(d.digits[keep]))]
            starts, counts, text = d.starts[keep], d.counts[keep], d.texts[keep]
            rows.add(order[text], key[text], d.digits[keep], d.hashes(starts, starts + counts + DEPTH - 1), starts + at[text], counts)
            if rows.size >= BATCH:
                yield rows.batch()
        if rows.size:
            yield rows.batch()

    return run


def _open(d: Digits, bits: np.ndarray, orders: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which of some runs are in the filter of open runs; the same code in SQL (OPEN)."""
    starts, order = d.starts[runs], orders[d.texts[runs]]
    body = d.hashes(starts, starts + d.counts[runs] + DEPTH - 1).view(np.int64)
    return runs[in_filter(bits, (d.digits[runs].view(np.int64) ^ body ^ (order << np.int64(17)) ^ order).view(np.uint64))]


OPEN = "digit ^ body ^ shiftleft(low, 17) ^ low"


def _map_classes(firsts, bits, share: Share):
    """Second digits of the open runs, with the lowest and highest document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            core, order = rows.columns()
            by = np.lexsort((order, core))
            core, order = core[by], order[by]
            first = np.concatenate(([True], core[1:] != core[:-1]))
            last = np.concatenate((first[1:], [True]))
            return pa.RecordBatch.from_arrays([pa.array(core[first]), pa.array(order[first]), pa.array(order[last])], names=["core", "low", "high"])

        rows = _Rows("core long, ord long")
        for order, _, _, d in _parts(batches, firsts):
            in_run, _, _, core = d.classes(_open(d, bits.value, order, share.of(d)))
            rows.add(core, order[d.texts[in_run]])
            if rows.size >= 8 * BATCH:
                yield packed()
        if rows.size:
            yield packed()

    return run


def _map_suffixes(firsts, bits, shared, share: Share, portion: int):
    """The suffixes of the open runs whose second digit is in the other filter, of a portion of the first digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(SUFFIXES)
        for order, key, at, d in _parts(batches, firsts):
            runs = share.of(d)
            runs = _open(d, bits.value, order, runs[d.digits[runs] % np.uint64(PORTIONS) == portion])
            in_run, first, count, core = d.classes(runs)
            keep = np.flatnonzero(in_filter(shared.value, core))
            in_run, first, count = in_run[keep], first[keep], count[keep]
            each = np.repeat(np.arange(keep.size), count)
            place = first[each] + np.arange(each.size) - np.repeat(np.cumsum(count) - count, count)
            in_run = in_run[each]
            start, text = d.starts[in_run], d.texts[in_run]
            rows.add(order[text], key[text], d.digits[in_run], d.hashes(place, place + DEPTH), start + at[text], place - start)
            if rows.size >= BATCH:
                yield rows.batch()
        if rows.size:
            yield rows.batch()

    return run


def copied_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (ord, key) whose whole text is that of an earlier document, and codes of the first rows of all texts.

    Texts are equal if their two hashes and lengths are.
    """
    narrow = rows.select("ord", "key", F.xxhash64("text", F.lit(17)).alias("check"), F.octet_length("text").alias("size"))
    narrow = stash(narrow.where(F.col("size") >= DEPTH), "texts")
    same = ["key", "check", "size"]
    groups = stash(narrow.groupBy(*same).agg(F.min("ord").alias("low"), F.max("ord").alias("high")), "text-groups")
    copies = narrow.join(groups.where("low < high").select(*same, "low"), same).where("ord > low").select("ord", "key").distinct()
    return stash(copies, "copies"), groups.select(F.expr("key ^ shiftleft(low, 17) ^ low").alias("code"))


def repeated_suffixes(rows: DataFrame) -> DataFrame:
    """Per document (ord, key) the runs of suffixes that also start in an earlier one.

    rows: ord, key, text. runs holds starts of runs with bit masks of their suffixes, start << 32 | mask,
    or WHOLE_TEXT. Equal suffixes fall into one group in every pass, and a group of one
    document is finished, so each pass writes less.
    0. Texts that are equal as a whole: all but the first document's are settled.
    1. First digit: the smallest gram in the depth. Neighbouring suffixes mostly share it,
       so a run of them is one row; only digits of two and more documents go on.
    2. Runs that are equal as a whole: all but the first document's are settled. Of the others,
       those whose digit has several different runs go on.
    3. Second digit: the bytes shared by up to CLASS neighbours.
    4. Last digit: the whole depth, suffix by suffix. What is equal now is equal through DEPTH bytes.
    Groups are only counted (lowest and highest document), never gathered. The passes read the texts
    again and keep what filters of the pass before let through. A filter grows with its rows; where the first
    digits are more than the largest holds, passes 2 to 4 are run for a share of them at a time. A full filter
    would make the next pass write more and change no result. Tables and shuffles that
    nothing reads any more are dropped along the way.
    """
    spark = rows.sparkSession
    copies, codes = copied_texts(rows)
    firsts = _filter(codes, "code")
    digits = rows.mapInArrow(_map_digits(firsts), "digit long, n int")
    digits = stash(digits.groupBy("digit").agg(F.sum("n").alias("n")).where("n > 1").select("digit"), "digits")
    rounds, found = max(1, -(-digits.count() // ROUND)), []
    for i in range(rounds):
        found += _settled(rows, firsts, digits, Share(i, rounds))
    discard(digits)
    collect_shuffles(spark)
    found.append(copies.select("ord", "key", F.lit(WHOLE_TEXT).cast("long").alias("run"), F.lit(0).cast("long").alias("mask")))
    # Both groupings use one shuffle by document.
    parts = reduce(DataFrame.union, found).repartition("ord", "key").groupBy("ord", "key", "run").agg(F.expr("bit_or(mask)").alias("mask"))
    out = stash(parts.groupBy("ord", "key").agg(F.collect_list(F.expr("run | mask")).alias("runs")), "doc-runs")
    discard(*found)
    collect_shuffles(spark)
    return out


def _filter(df: DataFrame, code: str):
    """A filter of the codes of stored rows, sent to all tasks."""
    coded = df.select(F.expr(code).alias("code"))
    return df.sparkSession.sparkContext.broadcast(filter_bits(coded, "code", filter_width(df.count())))


def _settled(rows: DataFrame, firsts, digits: DataFrame, share: Share) -> list[DataFrame]:
    """Passes 2 to 4 over a share of the repeated first digits: runs of suffixes (ord, key, run, mask) to remove."""
    spark = rows.sparkSession
    collect_shuffles(spark)
    mine = digits.where(DIGIT_ROUND.format(**share._asdict()))
    runs = stash(rows.mapInArrow(_map_runs(firsts, _filter(mine, DIGIT), share), RUNS), "runs")
    packed = F.expr("shiftleft(CAST(start AS BIGINT), 32)")
    found, open_runs = [], []
    for portion in range(PORTIONS):
        collect_shuffles(spark)
        some = runs.where(f"pmod(digit, {PORTIONS}) = {portion}")
        bodies = stash(some.groupBy("digit", "body").agg(F.min("ord").alias("low"), F.max("ord").alias("high")), "bodies")
        collect_shuffles(spark)
        several = bodies.groupBy("digit").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.count("*").alias("n"))
        several = bodies.join(several.where("a < b AND n > 1").select("digit"), "digit").select(F.expr(OPEN).alias("code"))
        open_runs.append(stash(several, "open-runs"))
        collect_shuffles(spark)
        whole = some.join(bodies.where("low < high").select("digit", "body", "low"), ["digit", "body"]).where("ord > low")
        mask = F.expr("shiftleft(1L, suffixes) - 1L").alias("mask")
        found.append(stash(whole.select("ord", "key", packed.alias("run"), mask), "whole-runs"))
        discard(bodies)
    discard(runs)
    collect_shuffles(spark)
    open_bits = _filter(reduce(DataFrame.union, open_runs), "code")
    discard(*open_runs)

    cores = rows.mapInArrow(_map_classes(firsts, open_bits, share), "core long, low long, high long")
    cores = cores.groupBy("core").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    shared = _filter(stash(cores.select("core"), "shared-classes"), "core")
    for portion in range(PORTIONS):
        collect_shuffles(spark)
        suffixes = stash(rows.mapInArrow(_map_suffixes(firsts, open_bits, shared, share, portion), SUFFIXES), "suffixes")
        for half in range(2):  # what is shuffled is half of what is stored
            some = suffixes.where(f"shiftrightunsigned(digit, 20) & 1 = {half}")
            equal = some.groupBy("digit", "suffix").agg(F.min("ord").alias("low"), F.max("ord").alias("high"))
            equal = stash(equal.where("low < high").select("digit", "suffix", "low"), "equal-suffixes")
            collect_shuffles(spark)
            single = some.join(equal, ["digit", "suffix"]).where("ord > low").groupBy("ord", "key", packed.alias("run"))
            found.append(stash(single.agg(F.expr("bit_or(shiftleft(1L, offset))").alias("mask")), "single-suffixes"))
            discard(equal)
            collect_shuffles(spark)
        discard(suffixes)
    return found


def spans_of(packed: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes from runs packed as start << 32 | mask."""
    set_bits = np.unpackbits((packed & 0xFFFFFFFF).astype("<u4").view(np.uint8), bitorder="little")
    at = np.flatnonzero(set_bits)
    starts = np.sort((packed >> 32)[at >> 5] + (at & 31))
    fresh = np.flatnonzero(np.diff(starts) > depth) + 1
    return starts[np.concatenate(([0], fresh))], starts[np.concatenate((fresh - 1, [-1]))] + depth


def _map_kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(5)]
            for text, runs in zip(texts(batch), batch.column("runs")):
                kept, removed, spans = text, 0, 0
                if runs.is_valid:
                    found = runs.values.to_numpy()
                    lo, hi = ([0], [len(text)]) if (found == WHOLE_TEXT).any() else spans_of(found)
                    lo, hi = np.asarray(lo), np.asarray(hi)
                    removed, spans = int((hi - lo).sum()), lo.size
                    edges = zip([0, *hi.tolist()], [*lo.tolist(), len(text)])
                    kept = b"".join(text[a:b] for a, b in edges)
                values = len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept
                for column, value in zip(out, values[: 4 + with_text]):
                    column.append(value)
            columns = [pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(out[3], pa.string())]
            if with_text:
                columns.append(pa.array(out[4], pa.binary()))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names[: 5 + with_text])

    return run


def without_repeated_bytes(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove every byte under a string of DEPTH bytes that also starts in a document with a smaller doc_id.

    Returns one row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, if asked for, kept, the remaining bytes (a cut may fall inside a character).
    Strings are judged on the input and never cross documents. Null texts are empty; texts
    shorter than DEPTH stay; repeats inside a document and between rows with the same doc_id stay;
    repeated rows lose the same bytes; a null doc_id comes after all others; an empty table gives
    an empty result; only doc_id (an integer) and text are read.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(order.alias("ord"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    runs = repeated_suffixes(rows.select("ord", "key", "text"))
    # The runs are the hashed side, so that whole texts move once and need no sort.
    joined = rows.join(runs.hint("shuffle_hash"), ["ord", "key"], "left").select("doc_id", "text", "runs")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return joined.mapInArrow(_map_kept(with_text), out)
