"""Repeated bytes against a dictionary of all strings of the depth."""

import hashlib

import numpy as np

from lobbylens.llm import common, suffixes
from lobbylens.llm.suffixes import Digits, spans_of, without_repeated_bytes
from tests.llm import corpus as c

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def repeats(rows, depth=50):
    first = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for doc_id, text in raw:
        for i in range(len(text) - depth + 1):
            s = text[i : i + depth]
            first[s] = min(first.get(s, 1 << 62), c.big(doc_id))
    out = []
    for doc_id, text in raw:
        gone = np.zeros(len(text) + 1, np.int64)
        for i in range(len(text) - depth + 1):
            if first[text[i : i + depth]] < c.big(doc_id):
                gone[i] += 1
                gone[i + depth if i + depth < gone.size else -1] -= 1
        gone = np.cumsum(gone)[:-1] > 0 if text else np.zeros(0, bool)
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    out = without_repeated_bytes(c.frame(spark, rows), with_text=True)
    expected = repeats(rows)
    got = out.collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert sorted((repr(tuple(r[k] for k in COLUMNS)) for r in got)) == sorted(map(repr, expected))
    return expected


def test_documents(spark):
    rng = c.rng(5)
    rows = [r for r in c.awkward(rng) if r[0] != 10] + c.near_copies(rng)
    rows += [(400 + i, "ab" * n) for i, n in enumerate((24, 25, 26, 400, 401))] + [(410, "é" * 30), (411, "x" + "é" * 30), (412, "é" * 25)]
    assert sum(r[2] > 0 for r in check(spark, rows)) > 30


def test_at_the_bound(spark):
    """49 bytes stay, 50 go; passages at any distance from each other, touching, nested and overlapping."""
    rng = c.rng(11)
    line = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    base = line(400)
    rows = [(1, base), (2, line(30) + base[:49] + line(30)), (3, line(17) + base[100:150] + line(9)), (4, base[60:110] + base[200:250] + base[330:])]
    rows += [(5 + i, line(i) + base[i : i + 40 + i] + line(7) + base[300 - i : 360]) for i in range(40)]
    rows += [(0, base[380:] + line(60)), (100, base[350:400] + line(3)), (-7, line(10) + base[33:100])]
    removed = {r[0]: r[2] for r in check(spark, rows)}
    assert removed[2] == 0 and removed[3] == 50 and removed[1] == 67


def test_texts_are_taken_together():
    """Runs of several texts in one part are those of each by itself; long texts give the same in slices."""
    rng = c.rng(3)
    texts = [c.sentence(rng, n, 300).encode() for n in (20, 1, 0, 7, 200, 9, 10, 11, 60)] + [b"x" * 49, b"y" * 50, b"ab" * 90]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.cumsum([0, *map(len, texts[:-1])])
    together = Digits(raw, begins)
    got = set(zip(together.texts.tolist(), (together.starts - begins[together.texts]).tolist(), together.counts.tolist(), together.digits.tolist()))
    want = set()
    for i, text in enumerate(texts):
        if len(text) >= 50:
            d = Digits(np.frombuffer(text, np.uint8))
            want |= set(zip([i] * d.starts.size, d.starts.tolist(), d.counts.tolist(), d.digits.tolist()))
    assert got == want


def test_long_text(spark):
    """3 MB, with a shared passage across the border of a slice, and one character over and over."""
    rng = c.rng(8)
    line = c.sentence(rng, 40, 4000)
    filler = "".join(chr(97 + b % 26) for b in np.random.default_rng(1).integers(0, 26, 1 << 20))
    long = filler[: (1 << 20) - 100] + line + "z" * (2 << 20)
    rows = [(1, line), (2, long), (3, "z" * 200), (4, filler[:60])]
    out = {r["doc_id"]: r["n_removed"] for r in without_repeated_bytes(c.frame(spark, rows)).collect()}
    assert out == {1: 0, 2: len(line), 3: 200, 4: 60}


def test_equal_suffixes_share_their_class():
    """Whatever surrounds them, also where the gram of the digit occurs more than once in the depth."""
    rng = np.random.default_rng(5)
    for inner in (rng.integers(97, 123, 60), np.tile(rng.integers(97, 123, 7), 12), np.full(70, 97), np.tile(rng.integers(97, 123, 25), 3)):
        inner, seen = inner.astype(np.uint8), []
        for before, after in ((0, 0), (13, 40), (200, 3), (31, 31)):
            raw = np.concatenate((rng.integers(65, 91, before), inner, rng.integers(65, 91, after))).astype(np.uint8)
            d = Digits(raw)
            run, first, count, core = d.classes(np.arange(d.starts.size))
            assert count.sum() == raw.size - 49 and count.max() <= 8
            place = {int(f) + i: int(c) for f, n, c in zip(first, count, core) for i in range(n)}
            seen.append([place[before + i] for i in range(inner.size - 49)])
        assert all(x == seen[0] for x in seen)


def test_runs_share_a_place():
    """No run is longer than the number of places of a gram, so its suffixes fit a mask."""
    raw = np.frombuffer(b"a" * 5000 + b"abc" * 900, np.uint8)
    d = Digits(raw)
    assert d.counts.max() <= 31 and d.counts.sum() == raw.size - 49
    lo, hi = spans_of(np.array([(100 << 32) | 0b1, (150 << 32) | 0b11, (300 << 32) | (1 << 30)], np.int64))
    assert lo.tolist() == [100, 330] and hi.tolist() == [201, 380]


def test_empty(spark):
    assert without_repeated_bytes(c.frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_a_portion_is_on_disk_at_a_time(spark, tmp_path, monkeypatch):
    """Tables of the runs are as many as the portions and small; all that was used up is gone at the end."""
    folders, sizes, rng = [], {}, c.rng(23)
    base = "".join(rng.choice("abcdefghij klm") for _ in range(6000))
    rows = [(i, base[i * 37 : i * 37 + 2500] + str(i)) for i in range(60)] + [(100, base[:300]), (101, base[:300])]

    def folder(_, name):
        folders.append((name, tmp_path / f"{name}-{len(folders)}"))
        return str(folders[-1][1])

    def discard(*tables):
        for df in tables:
            sizes.setdefault(df.inputFiles()[0].split("/")[-2].rsplit("-", 1)[0], []).append(df.count())
        common.discard(*tables)

    monkeypatch.setattr(common, "run_folder", folder)
    monkeypatch.setattr(suffixes, "discard", discard)
    got = without_repeated_bytes(c.frame(spark, rows))
    assert sorted(repr(tuple(r[k] for k in COLUMNS)) for r in got.collect()) == sorted(map(repr, repeats(rows)))
    assert len(sizes["bodies"]) == suffixes.PORTIONS and max(sizes["bodies"]) < 0.6 * sum(sizes["bodies"])
    left = {name for name, path in folders if path.exists()}
    assert left <= {"texts", "text-groups", "shared-classes", "doc-runs"}


def test_filters_grow_with_their_rows(spark, monkeypatch):
    """Before, a filter had the same bits for any number of rows, and let everything through once it was full."""
    widths, rng = [], c.rng(29)

    def filter_bits(df, column, bits=None):
        widths.append((df.count(), bits))
        out = common.filter_bits(df, column, bits)
        assert np.unpackbits(out.view(np.uint8)).mean() <= 0.25
        return out

    monkeypatch.setattr(common, "FILTER_BITS", 8)
    monkeypatch.setattr(suffixes, "filter_bits", filter_bits)
    base = "".join(rng.choice("abcdefghij klm") for _ in range(6000))
    check(spark, [(i, base[i * 37 : i * 37 + 2500] + str(i)) for i in range(60)] + [(100, base[:300])])
    assert len(widths) == 4 and len({bits for _, bits in widths}) > 1
    assert common.filter_width(0) == 8 and common.filter_width(1 << 40) == common.MOST_BITS


def test_first_digits_reach_every_bit_of_a_filter(spark):
    """Before, the high bits of a digit, the smallest of many hashes, named a small part of the filter only."""
    d = Digits(np.random.default_rng(2).integers(0, 256, 1 << 16).astype(np.uint8))
    assert np.unique(d.digits >> np.uint64(56)).size < 128
    code = suffixes._digit_code(d.digits)
    assert np.unique(code >> np.uint64(56)).size == 256
    df = spark.createDataFrame([(int(x),) for x in d.digits[:50].view(np.int64)], "digit long")
    same = [r[0] for r in df.selectExpr(suffixes.DIGIT).collect()]
    assert same == code[:50].view(np.int64).tolist()


def test_rounds_of_first_digits(spark, monkeypatch):
    """More first digits than the largest filter holds are settled a round at a time, with the same result."""
    rng = c.rng(31)
    base = "".join(rng.choice("abcdefghij klm") for _ in range(6000))
    rows = [(i, base[i * 37 : i * 37 + 2500] + str(i)) for i in range(60)] + [(100, base[:300]), (101, base[:300])]
    shares, settled = [], suffixes._settled

    def seen(rows, firsts, digits, share):
        shares.append((share, digits.where(suffixes.DIGIT_ROUND.format(**share._asdict())).count(), digits.count()))
        return settled(rows, firsts, digits, share)

    monkeypatch.setattr(suffixes, "_settled", seen)
    monkeypatch.setattr(suffixes, "ROUND", 250)
    check(spark, rows)
    assert len(shares) > 1 and sum(n for _, n, _ in shares) == shares[0][2] and all(n for _, n, _ in shares)
