"""Ranked search against scores of all documents, and its bounds on small lists."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lobbylens.llm import search
from lobbylens.llm.search import ranked_search, search_block, term_counts
from tests.llm import corpus as c

COLUMNS = ["item_id", "rank", "doc_id", "score"]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", c.lower(text))


def best(rows, items, top=50):
    docs = [(d, Counter(terms(t))) for d, t in rows if terms(t)]
    n, length = len(docs), sum(sum(x.values()) for _, x in docs)
    df = Counter(t for _, x in docs for t in x)
    queries = defaultdict(set)
    for item_id, text in items:
        queries[item_id] |= set(terms(text))
    out = []
    for item_id, wanted in queries.items():
        scored = []
        for doc_id, x in docs:
            m = 50 + 50 * sum(x.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * x[t] // (1000 * x[t] + 20 * m)) for t in wanted if t in x)
            if s > 0:
                scored.append((-s, c.big(doc_id), doc_id))
        out += [(item_id, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:top])]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = c.rng(21)
    rows = c.awkward(rng) + c.near_copies(rng) + [(2000 + i, c.sentence(rng, rng.randrange(1, 40), 60)) for i in range(300)]
    # Ties: many documents with the same score around the last place.
    rows += [(5000 - i, "tie tie apple") for i in range(90)] + [(None, "tie tie apple")]
    items = [
        (1, c.sentence(rng, 30, 60)), (2, "Tie APPLE"), (3, None), (4, "..."), (5, "nowhere"), (6, c.sentence(rng, 200, 400)),
        (7, "w1 w1 w2"), (7, "w3"), (None, "É ß 日本 don't 12 3.4"), (9, "one"), (10, "zz" * 3000),
    ]
    return rows, items


@pytest.mark.parametrize("block,passes", [(1 << 20, 1 << 19), (400, 60), (1, 1)])
def test_search(spark, corpus, block, passes):
    """One block; many small blocks and some passes; blocks of one document, a pass per item."""
    rows, items = corpus
    if passes == 1:
        rows, items = rows[-150:], items[:3] + items[6:8]
    bench = spark.createDataFrame([(*i, True) for i in items], c.ITEMS)
    out = ranked_search(c.frame(spark, rows), bench, 50, passes, block)
    c.same(out, best(rows, items), COLUMNS)


def test_block_reads_no_more_than_needed(monkeypatch):
    """Bounds settle membership and ties exactly, for any first read and any bar."""
    rng = np.random.default_rng(3)
    for trial in range(200):
        size, lists = 60, []
        for _ in range(rng.integers(1, 7)):
            docs = rng.permutation(size)[: rng.integers(1, size)]
            impacts = np.sort(rng.integers(1, 9, docs.size))[::-1].astype(np.int64)
            lists.append((impacts, docs))
        total = np.zeros(size, np.int64)
        for impacts, docs in lists:
            total[docs] += impacts
        top, floor = int(rng.integers(1, 8)), int(rng.integers(0, 12))
        monkeypatch.setattr(search, "FIRST_READ", int(rng.integers(1, 20)))
        found, scores = search_block(lists, size, top, floor)
        assert np.array_equal(scores, total[found])
        ordered = sorted((-s, d) for d, s in enumerate(total) if s >= max(floor, 1))[:top]
        assert sorted(zip(-scores, found))[: len(ordered)] == ordered


def test_long_texts():
    """Slices end between terms, and one term may be longer than a slice."""
    rng = c.rng(6)
    text = c.sentence(rng, 300_000, 5000) + " " + "é" * 800_000 + "A" * 700_000 + ", end"
    assert term_counts(text.encode()) == Counter(t.encode() for t in terms(text))


def test_empty(spark):
    docs = c.frame(spark, [(1, "x")])
    bench = spark.createDataFrame([(1, "x", True)], c.ITEMS)
    for d, b in ((docs.limit(0), bench), (docs, bench.limit(0)), (docs.limit(0), bench.limit(0))):
        out = ranked_search(d, b)
        assert out.columns == COLUMNS and out.count() == 0
