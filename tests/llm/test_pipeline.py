"""The pipeline's stages against plain Python, and its registered queries against their SQL."""

import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lobbylens.llm.common import stash
from lobbylens.llm.quality import quality_scores
from lobbylens.llm.queries import collect
from tests.llm import corpus as c

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    functions = dict(corpus_pipeline.STAGES)
    assert list(functions) == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    scored = {r["doc_id"]: r["predicted"] for r in collect()[0]["op2_neighbour_quality"](spark, SF).collect()}
    first = functions["quality_classifier"](spark, docs, SF)
    assert first.columns == docs.columns and ids(first) == sorted(d for d, p in scored.items() if p)
    assert ids(functions["exact_dedup"](spark, docs, SF)) == sorted({r[1] for r in c.exact(rows)})
    near = functions["ngram_jaccard_join"](spark, docs, SF)
    assert near.columns == docs.columns and ids(near) == sorted({r[2] for r in c.near_groups(rows)})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = functions["benchmark_decontamination"](spark, docs, SF)
    assert ids(clean) == sorted(r[0] for r in c.leaks(rows, items) if not r[5])


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
    assert ids(pieces.where("start = 0")) == ids(docs)


def test_repeated_rows_in_exact_dedup(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "ab"), (2, "ab"), (None, None), (None, None), (3, "x")]
    out = corpus_pipeline.exact_dedup(spark, c.frame(spark, rows), SF).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == [(1, "a b"), (3, "x"), (None, None)]


#: Names that the pipeline uses, or used, inside.
RESERVED = ["own_key", "ITS_ID", "its_key", "_key", "_id", "_named", "own_key_"]


@pytest.fixture(scope="module")
def awkward(spark):
    rng = c.rng(3)
    rows = c.awkward(rng) + c.near_copies(rng)
    docs = c.frame(spark, rows).withColumns({n: F.lit(n) for n in RESERVED})
    return rows, stash(docs, "awkward-docs")


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_on_awkward_rows(spark, awkward):
    """Nulls, empty and long texts, repeated rows, ties, and columns with clashing names."""
    rows, docs = awkward
    functions = dict(corpus_pipeline.STAGES)
    outs = {name: functions[name](spark, docs, SF) for name in list(functions)[:-1]}
    assert all(out.columns == docs.columns for out in outs.values())
    named = docs.select(F.xxhash64("text").alias("key"), "text").distinct()
    scored = quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    good = {r["text"] for r in scored.join(named, "key").collect()}
    assert texts(outs["quality_classifier"]) == sorted(((d, t) for d, t in rows if t in good), key=repr)
    assert ids_or_none(outs["exact_dedup"]) == sorted({(r[3], repr(r[1])) for r in c.exact(rows)})
    near = c.near_groups(rows)
    kept = texts(outs["ngram_jaccard_join"])
    assert [x for x in kept if not c.words(x[1])] == sorted((x for x in rows if not c.words(x[1])), key=repr)
    groups = {repr(r[2]) for r in near if r[1]}
    assert {repr(d) for d, t in kept if c.words(t)} == groups
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert texts(outs["benchmark_decontamination"]) == sorted((x for x, r in zip(rows, c.leaks(rows, items)) if not r[5]), key=repr)
    assert functions["packing"](spark, docs, SF).where("start = 0").count() == len(rows)


def ids_or_none(df):
    import hashlib

    bare = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    return sorted((bare(r["text"]), repr(r["doc_id"])) for r in df.collect())


def test_stages_on_no_rows(spark, awkward):
    empty = awkward[1].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_registered():
    queries, oracles = collect()
    assert set(queries) <= set(entry.queries()) and set(oracles) < set(queries)
    numbers = sorted(int(m[1]) for q in queries if (m := re.match(r"op(\d+)_", q)))
    assert numbers == list(range(1, 14)) and "pipeline" in queries


@pytest.mark.parametrize("name", sorted(collect()[1]))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_workers_hold_little_between_stages(spark, monkeypatch):
    """Long texts are handed to Python a few megabytes at a time; what a task frees goes back to the system."""
    from lobbylens.llm import common

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["size"])

    texts_ = spark.range(300, numPartitions=1).select(F.expr("repeat(chr(97 + id % 26), 100000)").alias("text"))
    got = [r["size"] for r in common.stash(texts_.mapInArrow(sizes, "size long"), "sizes").collect()]
    assert sum(got) > 29_000_000 and max(got) < 2 * common.HANDED_BYTES
    assert spark.conf.get(common.HANDED, None) is None
    spark.conf.set(common.HANDED, str(1 << 20))
    try:
        got = [r["size"] for r in common.stash(texts_.mapInArrow(sizes, "size long"), "sizes").collect()]
        assert max(got) < 2 << 20 and spark.conf.get(common.HANDED) == str(1 << 20)
    finally:
        spark.conf.unset(common.HANDED)
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["a"]})
    assert len(list(common.released(sizes)(iter([batch, batch])))) == 2 and calls == [1]
