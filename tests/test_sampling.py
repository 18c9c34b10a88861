import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lobbylens.operators import sampling

TWO64 = 1 << 64


def coin_by_hand(a, b):
    x = (a * 6364136223846793005 + b * 1442695040888963407 + 1) % TWO64
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD % TWO64
    x ^= x >> 33
    return float(np.float32(x >> 11) / np.float32(2**53))


def test_hash_uniform(spark):
    pairs = [(a, b) for a in range(5) for b in range(5)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {(r.a, r.b): r.u for r in df.select("a", "b", sampling.hash_uniform(F.col("a"), F.col("b")).alias("u")).collect()}
    assert all(0.0 <= u < 1.0 for u in got.values()) and len(set(got.values())) == 25
    assert all(abs(got[p] - coin_by_hand(*p)) < 1e-12 for p in pairs)
    big = spark.range(4000).select(sampling.hash_coin(F.lit(3), F.col("id"), 0.2).alias("c"))
    assert 0.15 < big.where("c").count() / 4000 < 0.25


def test_label_jitter(spark):
    rows = [(r, s, 1000.0 if s < 4 else None, r // 8, r % 8) for r in range(200) for s in range(6)]
    df = spark.createDataFrame(rows, "replay_id bigint, slot int, target_mmr double, batch bigint, row bigint")
    first = sampling.label_jitter(df, 2, "batch", "row").toPandas().sort_values(["replay_id", "slot"])
    again = sampling.label_jitter(df.repartition(7), 2, "batch", "row").toPandas().sort_values(["replay_id", "slot"])
    assert np.allclose(first["jitter"], again["jitter"])
    assert (first.loc[first["slot"] >= 4, "jitter"] == 0).all()
    known = first[first["slot"] < 4]
    assert np.allclose(known.groupby("replay_id")["jitter"].sum(), 0, atol=1e-9)
    assert 28 < known["jitter"].std() < 42
    assert not np.allclose(first["jitter"], sampling.label_jitter(df, 3, "batch", "row").toPandas().sort_values(["replay_id", "slot"])["jitter"])


def test_sticky_split(spark):
    rows = [(i, "training" if i < 20 else "evaluation" if i < 30 else None, "downloaded" if i % 5 else "failed") for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, dataset_split string, download_status string")
    out = sampling.sticky_split(df, 0.9, 1)
    counts = out.where("id >= 30").groupBy("dataset_split").count().collect()
    free = sum(1 for i in range(30, 500) if i % 5)
    assert {r.dataset_split: r["count"] for r in counts} == {"training": round(free * 0.9), "evaluation": free - round(free * 0.9), None: 94}
    assert out.where("id < 20 AND dataset_split <> 'training'").count() == 0
    assert out.exceptAll(sampling.sticky_split(df.repartition(9), 0.9, 1)).count() == 0
    assert out.exceptAll(sampling.sticky_split(out, 0.5, 2)).count() == 0


def test_shuffle_is_a_permutation(spark):
    out = sampling.shuffled(spark.range(1000), "id", 3).toPandas()
    assert sorted(out["position"]) == list(range(1000)) and (out["position"] != out["id"]).any()
    assert (out.sort_values("id")["position"].to_numpy() == sampling.shuffled(spark.range(1000).repartition(5), "id", 3).toPandas().sort_values("id")["position"].to_numpy()).all()


def test_tail_split(spark):
    def split(n, fraction):
        out = sampling.tail_split(spark.range(n), "id", fraction)
        return [r.id for r in out.where("is_validation").orderBy("id").collect()]

    assert split(10, 0.2) == [8, 9] and split(3, 0.1) == [2]


def test_first_k_of_any_size(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"g": np.where(np.arange(6000) % 3 == 0, 1, rng.integers(2, 9, 6000)), "id": rng.permutation(6000)})
    df = spark.createDataFrame(data.astype("int64"))
    for k in (5, 1500):
        got = sampling.first_k(df, ["g"], ["id"], k).toPandas()
        want = data.sort_values("id").groupby("g").head(k)
        assert sorted(map(tuple, got[["g", "id"]].to_numpy())) == sorted(map(tuple, want[["g", "id"]].to_numpy()))


def test_stratified_sample(spark):
    rows = [(i, i % 23, "downloaded" if i % 4 else "failed") for i in range(2300)]
    df = spark.createDataFrame(rows, "id bigint, rank_index int, download_status string")
    got = sampling.stratified_sample(df, 50).toPandas()
    assert len(got) == 50 and (got["rank_index"] > 0).all() and (got["rank_index"].value_counts() <= 3).all()
    assert (got["id"] % 4 != 0).all()


def test_stratified_sample_with_text_ids(spark):
    rows = [(str(uuid.UUID(int=i * 7919 % 100_003)), 1 + i % 22, "downloaded") for i in range(40_000)]
    df = spark.createDataFrame(rows, "id string, rank_index int, download_status string")
    for n in (1000, 30_000):
        got = sampling.stratified_sample(df, n).toPandas()
        assert len(got) == n and got["rank_index"].value_counts().max() == -(-n // 22)
        lowest = sorted(r[0] for r in rows if r[1] == 5)[: -(-n // 22)]
        assert set(got.loc[got["rank_index"] == 5, "id"]) <= set(lowest)


def test_null_orders_stay(spark):
    df = spark.createDataFrame([(None,), (3,), (1,), (2,)], "id bigint")
    out = {r.id: r.is_validation for r in sampling.tail_split(df, "id", 0.5).collect()}
    assert out == {None: False, 1: False, 2: True, 3: True}


def test_capped_sample_is_a_soft_cap(spark):
    rows = [(1, r, r * 100 + s) for r in range(20) for s in range(4 if r else 2)]
    got = sampling.capped_sample(spark.createDataFrame(rows, "rank_index int, replay_id int, segment_id int"), ["segment_id"])
    taken = got.groupBy("replay_id").count().orderBy("replay_id").collect()
    # 2 + 3 + 3 + 3 + 3 = 14 is still below 15, so one more replay of 3 is taken.
    assert [(r.replay_id, r["count"]) for r in taken] == [(0, 2), (1, 3), (2, 3), (3, 3), (4, 3), (5, 3)]


def test_oversample(spark):
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 5), (4, 9)], "segment_id int, rank_index int")
    factors = spark.createDataFrame([(1, 1), (5, 4), (9, 0)], "rank_index int, factor int")
    out = sampling.oversample(rows, factors, "segment_id", 1).toPandas()
    assert out["segment_id"].value_counts().to_dict() == {3: 4, 1: 1, 2: 1} and sorted(out["position"]) == list(range(6))


def test_mixed_lobbies(spark):
    rows = spark.createDataFrame([(i, 1 + 3 * (i % 3)) for i in range(90)], "segment_id bigint, rank_index int")
    out = sampling.mixed_lobbies(rows, "segment_id", [1, 4, 7, 22], 50)
    assert out.count() == 150 and out.groupBy("lobby").count().where("count <> 3").count() == 0
    assert out.where("(segment_id % 3) * 3 + 1 <> rank_index").count() == 0
    assert sampling.mixed_lobbies(rows, "segment_id", [1, 22], 50).count() == 0
