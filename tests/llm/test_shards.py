"""Curve order, cuts and slots."""

import itertools
import zlib

import pytest

from lobbylens.llm.shards import hilbert_shards, with_hilbert, write_shards
from tests.llm import corpus as c


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 1)])
def test_curve_is_a_walk(spark, dims, bits):
    """Every cell once, and neighbours on the curve are neighbours in one dimension."""
    names = [f"d{i}" for i in range(dims)]
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    placed = with_hilbert(spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names)), names, bits)
    rows = sorted(placed.collect(), key=lambda r: r["hilbert"])
    assert [r["hilbert"] for r in rows] == list(range(len(cells)))
    for a, b in itertools.pairwise(rows):
        assert sum(abs(a[n] - b[n]) for n in names) == 1


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    rng = c.rng(1)
    rows = [(d, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", None])) for d, t in c.awkward(rng)]
    rows += [(200 + i, c.sentence(rng, rng.randrange(60)), "en", "hot") for i in range(300)]
    got = hilbert_shards(c.frame(spark, rows), law=law).collect()
    assert len(got) == len(rows)
    key = lambda d, t: (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((key(d, t) for d, t, _, _ in rows), key=repr) == sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr)
    by_shard = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in {r["shard"] for r in got}}
    assert all(slots == list(range(len(slots))) for slots in by_shard.values())
    assert set(by_shard) <= set(range(16)) and all(r["law"] == law and r["grown_shard"] is None for r in got)
    ends = {s: [r["hilbert"] for r in got if r["shard"] == s] for s in by_shard}
    for a, b in itertools.pairwise(sorted(ends)):
        assert max(ends[a]) <= min(ends[b])
    if law == "rows":
        assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1 and len(by_shard) == 16
    else:
        total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
        assert all(sum(r["size"] for r in got if r["shard"] == s) <= total / 16 + most for s in by_shard)


def test_few_rows_and_none(spark):
    rows = [(1, "a", "en", "s"), (1, "a", "en", "s"), (None, None, None, None)]
    got = hilbert_shards(c.frame(spark, rows)).collect()
    assert sorted(r["shard"] for r in got) == [0, 5, 10] and {r["slot"] for r in got} == {0}
    assert hilbert_shards(c.frame(spark, rows).limit(0)).count() == 0


def test_write(spark, folder):
    rows = [(i, f"text {i}", "en" if i % 2 else "de", f"s{i % 5}") for i in range(200)]
    df = c.frame(spark, rows)
    placed = hilbert_shards(df)
    write_shards(df, placed, f"{folder}/shards")
    read = spark.read.parquet(f"{folder}/shards").select("doc_id", "text", "shard").collect()
    assert {tuple(r) for r in read} == {(r["doc_id"], f"text {r['doc_id']}", r["shard"]) for r in placed.collect()}


def test_native_plan(spark):
    plan = hilbert_shards(c.frame(spark, [(1, "a", "en", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
