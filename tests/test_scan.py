"""The chunked scans against pandas, with one key holding a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lobbylens.operators.scan import (
    Fold, attach_group, exact_median, numbered, order_statistics, prefix_scan, row_index, scatter, span,
)


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(5)
    parts = []
    for key, n in [(0, 900)] + [(k, 90) for k in range(1, 21)]:
        order = np.sort(rng.choice(5000, n, replace=False))
        parts.append(pd.DataFrame({"k": key, "i": order, "v": rng.normal(size=n).round(3)}))
    frame = pd.concat(parts, ignore_index=True)
    frame["maybe"] = frame["v"].where(rng.random(len(frame)) < 0.2)
    return frame


def run(spark, skewed, folds, **options):
    df = spark.createDataFrame(skewed.astype({"k": "int64", "i": "int64"})).withColumn(
        "maybe", F.when(~F.isnan("maybe"), F.col("maybe")))
    out = prefix_scan(df, ["k"], ["i"], folds, span("i", 64), **options).toPandas()
    return out.sort_values(["k", "i"]).reset_index(drop=True)


def test_running_folds(spark, skewed):
    v, maybe = F.col("v"), F.col("maybe")
    out = run(spark, skewed, [
        Fold("total", "sum", v), Fold("before", "sum", v, exclusive=True), Fold("n", "count", F.lit(1)),
        Fold("high", "max", v), Fold("low_before", "min", v, exclusive=True), Fold("seen", "last", maybe),
        Fold("seen_before", "last", maybe, exclusive=True), Fold("size", "count", F.lit(1), whole=True)])
    data = skewed.sort_values(["k", "i"]).reset_index(drop=True)
    g = data.groupby("k")
    assert np.allclose(out["total"], g["v"].cumsum())
    assert np.allclose(out["before"], g["v"].cumsum() - data["v"])
    assert (out["n"] == g.cumcount() + 1).all()
    assert np.allclose(out["high"], g["v"].cummax())
    assert np.allclose(out["low_before"].astype(float), g["v"].cummin().groupby(data["k"]).shift(), equal_nan=True)
    filled = g["maybe"].ffill()
    assert np.allclose(out["seen"].astype(float), filled, equal_nan=True)
    assert np.allclose(out["seen_before"].astype(float), filled.groupby(data["k"]).shift(), equal_nan=True)
    assert (out["size"] == g["v"].transform("size")).all()


def test_reverse_scan(spark, skewed):
    maybe = F.col("maybe")
    out = run(spark, skewed, [
        Fold("next_at", "min", F.when(maybe.isNotNull(), F.col("i")), exclusive=True),
        Fold("next_value", "last", maybe, exclusive=True)], reverse=True)
    data = skewed.sort_values(["k", "i"]).reset_index(drop=True)
    place = data["i"].where(data["maybe"].notna())
    want = place.groupby(data["k"]).bfill().groupby(data["k"]).shift(-1)
    assert np.allclose(out["next_at"].astype(float), want, equal_nan=True)
    value = data.groupby("k")["maybe"].bfill().groupby(data["k"]).shift(-1)
    assert np.allclose(out["next_value"].astype(float), value, equal_nan=True)


def test_row_index_and_attach(spark, skewed):
    df = spark.createDataFrame(skewed[["k", "i"]].astype("int64"))
    out = row_index(df, ["k"], ["i"], "at", span("i", 64)).toPandas().sort_values(["k", "i"])
    assert (out["at"].to_numpy() == skewed.sort_values(["k", "i"]).groupby("k").cumcount().to_numpy()).all()
    names = spark.createDataFrame([(0, "hot"), (1, "cold")], "k bigint, name string")
    joined = attach_group(df, names, ["k"], scatter("i"))
    assert joined.count() == len(skewed)
    counts = {r["name"]: r["n"] for r in joined.groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert counts == {"hot": 900, "cold": 90, None: len(skewed) - 990}


def test_order_statistics(spark, skewed):
    df = spark.createDataFrame(skewed[["k", "v"]].astype({"k": "int64"}))
    out = order_statistics(df, ["k"], "v", {"p99": lambda n: F.floor(n * 0.99)}).toPandas().set_index("k")
    medians = exact_median(df, ["k"], "v", "m").toPandas().set_index("k")["m"]
    for key, group in skewed.groupby("k"):
        ordered = np.sort(group["v"].to_numpy())
        assert out.loc[key, "p99"] == ordered[int(len(ordered) * 0.99)]
        assert np.isclose(medians[key], np.median(ordered))


def test_numbered(spark, skewed):
    df = spark.createDataFrame(skewed[["k", "v"]].astype({"k": "int64"}).assign(s=[f"{x:08.3f}" for x in skewed["v"]]))
    df = df.union(spark.createDataFrame([(None, 1.0, "x"), (None, 2.0, None), (1, None, None)], df.schema))
    out = numbered(df.repartition(9), ["k"], ["s"], "at", total="n").toPandas()
    for key, group in out.groupby("k", dropna=False):
        assert sorted(group["at"]) == list(range(len(group))) and (group["n"] == len(group)).all()
        texts = group.sort_values("at")["s"].fillna("").tolist()
        assert texts == sorted(texts)
    assert len(out) == len(skewed) + 3
    weighted = numbered(df.where("v > 0"), [], ["v"], "before", weight="v", total="all").toPandas().sort_values("v")
    assert np.allclose(weighted["before"], weighted["v"].cumsum() - weighted["v"])
    assert np.allclose(weighted["all"], weighted["v"].sum())


def test_null_orders_stay_and_null_keys_raise(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 2, 1), (1, 70_000, 1)], "k int, i bigint, v int")
    out = prefix_scan(df, ["k"], ["i"], [Fold("n", "sum", F.col("v"))])
    assert {r.i: r.n for r in out.collect()} == {None: 5, 2: 6, 70_000: 7}
    with pytest.raises(Exception, match="NULL in key column k"):
        prefix_scan(df.union(df.sparkSession.createDataFrame([(None, 1, 1)], df.schema)), ["k"], ["i"], [Fold("n", "sum", F.col("v"))]).collect()


def test_attached_groups_keep_or_refuse_nulls(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 2, 1), (2, 70_000, 1), (2, None, 8)], "k int, i bigint, v int")
    names = spark.createDataFrame([(1, "a")], "k int, name string")
    out = attach_group(df, names, ["k"], span("i"))
    assert sorted((r.k, r.v, r["name"]) for r in out.collect() if r.i is None) == [(1, 5, "a"), (2, 8, None)] and out.count() == 4
    with pytest.raises(Exception, match="NULL in key column k"):
        attach_group(df.union(spark.createDataFrame([(None, 1, 1)], df.schema)), names, ["k"], span("i")).collect()


def test_global_scan_needs_no_key(spark):
    df = spark.range(1000).withColumn("id", F.col("id") * 3)
    out = prefix_scan(df, [], ["id"], [Fold("n", "count", F.lit(1), exclusive=True)], span("id", 128))
    assert out.where(F.col("n") * 3 != F.col("id")).count() == 0
