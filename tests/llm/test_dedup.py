"""Exact groups, near duplicates, repeats and benchmark leaks against plain Python."""

import pytest
from pyspark.sql import functions as F

from lobbylens.llm.common import stash
from lobbylens.llm.decontaminate import contamination
from lobbylens.llm.exact import exact_groups
from lobbylens.llm.graph import components
from lobbylens.llm.jaccard import near_duplicates
from lobbylens.llm.repeats import factors, parse, pieces_of, without_repeats
from tests.llm import corpus as c


def rows_of(seed):
    rng = c.rng(seed)
    return c.awkward(rng) + c.near_copies(rng)


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of(5)
    return rows, stash(c.frame(spark, rows), "test-docs")


@pytest.mark.parametrize("partitions", [1, 5, 300])
def test_exact_groups(docs, partitions):
    rows, df = docs
    out = exact_groups(df, partitions)
    c.same(out, c.exact(rows), ["doc_id", "keep_id", "group_size", "text_sha256"])
    kept = out.where("kept").groupBy("text_sha256").count()
    assert kept.where("count <> 1").isEmpty() and kept.count() == len({r[3] for r in c.exact(rows)})


def test_exact_group_over_many_runs(spark):
    """A group that fills most of the table, dealt over more runs than a round merges."""
    rows = [(i, "same text" if i % 3 else f"other {i % 7}") for i in range(600)]
    c.same(exact_groups(c.frame(spark, rows).repartition(40), 64), c.exact(rows), ["doc_id", "keep_id", "group_size", "text_sha256"])


def test_near_duplicates(docs):
    rows, df = docs
    out = near_duplicates(df)
    c.same(out, c.near_groups(rows), ["doc_id", "n_shingles", "component_id"])
    assert out.where("kept AND n_shingles > 0").select("component_id", "doc_id", "key").distinct().count() == (
        out.where("n_shingles > 0").select("component_id").distinct().count()
    )


def test_near_duplicates_chain(spark):
    """Neighbours in a chain are similar, its ends are not; a group of many near copies hangs on it."""
    rng = c.rng(9)
    base = c.sentence(rng, 200, 9000).split()
    rows = []
    for i in range(30):
        base[i * 6] = f"c{i}"
        rows.append((500 - i, " ".join(base)))
    core = c.sentence(rng, 60, 9000).split()
    for i in range(60):
        words = list(core)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((1000 + i, " ".join(words)))
    c.same(near_duplicates(c.frame(spark, rows)), c.near_groups(rows), ["doc_id", "n_shingles", "component_id"])


def test_components(spark):
    rng = c.rng(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    comp = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for u, v in links:
            low = min(comp[u], comp[v])
            changed |= comp[u] != low or comp[v] != low
            comp[u] = comp[v] = low
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {k: v for k, v in comp.items() if any(k in link and link[0] != link[1] for link in links)}


def test_without_repeats(docs):
    rows, df = docs
    out = without_repeats(df, with_text=True)
    c.same(out, c.repeats(rows), ["doc_id", "n_words", "n_removed", "kept_sha256"])
    c.same(out.select(F.sha2("kept_text", 256).alias("s")), [(r[3],) for r in c.repeats(rows)], ["s"])


def test_factors_are_their_references(docs):
    """Each factor holds the words of its reference, an earlier document; together they are all that repeats."""
    rows, df = docs
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append(c.words(text))
    covered = {}
    for f in factors(df).collect():
        assert c.big(f["ref_id"]) < c.big(f["doc_id"]) and f["length"] > 0
        own = [w[f["start"] : f["start"] + f["length"]] for w in texts[f["doc_id"]]]
        assert any(w[f["ref_start"] : f["ref_start"] + f["length"]] in own for w in texts[f["ref_id"]])
        key = f["doc_id"], f["key"]
        assert covered.get(key, 0) <= f["start"]  # in order of their places, none overlaps
        covered[key] = f["start"] + f["length"]
    assert len(covered) > 10


def test_parse_is_greedy():
    rng = c.rng(14)
    import numpy as np

    for _ in range(300):
        matches = [(lo, lo + rng.randrange(5, 30), rng.randrange(3), lo + rng.randrange(4) * 50) for lo in rng.sample(range(100), rng.randrange(0, 12))]
        # As the operator has them: what lies on one diagonal and meets is one match.
        got = parse(*(np.asarray([m[i] for m in matches], np.int64) for i in range(4)))
        reach = {}
        for lo, hi, ref, ref_lo in matches:
            for p in range(lo, hi):
                reach.setdefault(p, set()).add((ref, ref_lo - lo))
        expected, at = [], 0
        while at < 130:
            if at not in reach:
                at += 1
                continue
            ends = {}
            for way in reach[at]:
                end = at
                while way in reach.get(end, ()):
                    end += 1
                ends[way] = end
            end = max(ends.values())
            expected.append((at, end, {w for w, e in ends.items() if e == end}))
            at = end
        assert [(a, b) for a, b, _, _ in got] == [(a, b) for a, b, _ in expected]
        assert all((ref, ref_lo - a) in ways for (a, _, ref, ref_lo), (_, _, ways) in zip(got, expected))


def test_repeats_at_the_bound(spark):
    """49 shared words stay, 50 go; a factor that ends in the middle of another is found."""
    rng = c.rng(2)
    shared = c.sentence(rng, 120, 9000).split()
    tail = c.sentence(rng, 30, 9000).split()
    rows = [
        (1, " ".join(shared)), (2, " ".join(shared[:49] + tail)), (3, " ".join(tail + shared[10:60] + ["x"])),
        (4, " ".join(shared[:70] + shared[20:100])), (5, " ".join(shared[:60] + tail + shared[60:])),
    ]
    c.same(without_repeats(c.frame(spark, rows)), c.repeats(rows), ["doc_id", "n_words", "n_removed", "kept_sha256"])


def test_long_words_leave_others_alone(spark):
    """A word of 5,000 bytes that is added, missing or shortened changes no other word's hash."""
    rng = c.rng(12)
    blob = "".join(rng.choice("abcdefgh") for _ in range(5000))
    near = c.sentence(rng, 200, 9000).split()
    turned = blob[:4500] + ("b" if blob[4500] == "a" else "a") + blob[4501:]
    rows = [(i + 1, " ".join(near[:90] + word + near[90:])) for i, word in enumerate([[], [blob], [blob[:4096]], [blob[:4000]], [turned]])]
    passage = c.sentence(rng, 50, 9000).split()
    for i, word in enumerate(([], [blob], [blob[:4097]])):
        rows.append((10 + i, " ".join(c.sentence(rng, 60, 9000).split() + word + passage + c.sentence(rng, 60, 9000).split())))
    groups = c.near_groups(rows)
    assert len({r[2] for r in groups if r[0] < 10}) == 1 and {r[2] for r in c.repeats(rows) if r[0] > 10} == {50}
    df = c.frame(spark, rows)
    c.same(near_duplicates(df), groups, ["doc_id", "n_shingles", "component_id"])
    c.same(without_repeats(df), c.repeats(rows), ["doc_id", "n_words", "n_removed", "kept_sha256"])


def test_equal_windows_have_equal_anchors():
    import numpy as np

    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 60, 80, np.uint64)
    a = np.concatenate((rng.integers(0, 1 << 60, 33, np.uint64), shared))
    anchors, _, starts, counts = pieces_of(a)
    other, _, s2, c2 = pieces_of(shared)
    assert np.array_equal(np.repeat(anchors, counts)[33:], np.repeat(other, c2))
    assert counts.sum() == a.size - 49 and starts[0] == 0


def test_contamination(spark, docs):
    rows, df = docs
    rng = c.rng(8)
    texts = [t for _, t in rows if t]
    long_text = next(t for d, t in rows if d == 10)
    items = [
        (1, " ".join(long_text.split()[5000:5030])), (2, c.sentence(rng, 40, 9000)), (3, None), (4, ""), (5, "One, TWO; three!"),
        (6, "z z z z z z z z z z z z"), (7, texts[5]), (7, "É é ß"), (None, " ".join(long_text.split()[100:112])),
        (11, " ".join(long_text.split()[5010:5040])), (11, " ".join(long_text.split()[5010:5040])), (12, "w1"),
    ]
    bench = spark.createDataFrame([(*i, True) for i in items], c.ITEMS)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    c.same(contamination(df, bench), c.leaks(rows, items), columns)
    c.same(contamination(df, bench.limit(0)), c.leaks(rows, []), columns)


def test_empty_tables(spark):
    df = c.frame(spark, [(1, "x")]).limit(0)
    bench = spark.createDataFrame([(1, c.sentence(c.rng(1), 20), True)], c.ITEMS)
    for out in (exact_groups(df), near_duplicates(df), without_repeats(df), contamination(df, bench)):
        assert out.count() == 0
