import os

import numpy as np
from pyspark.sql import functions as F

from lobbylens.operators import actors, probe
from lobbylens.operators import telemetry as tel
from lobbylens.queries import catalog as catalog_queries
from lobbylens.sources import blocks, inventory


def test_state_does_not_leak_between_lifetimes(spark):
    rows = [
        (1, 0, "update", 9.0), (1, 1, "new", None), (1, 2, "update", 5.0), (1, 3, "tick", None), (1, 4, "delete", None),
        (1, 5, "update", 7.0), (1, 6, "new", None), (1, 7, "tick", None), (1, 8, "update", 8.0),
    ]
    log = spark.createDataFrame(rows, "actor int, i bigint, kind string, v double")
    state = {r.i: r.state for r in actors.carry_forward(log, ["actor"], "i", "v", 0.0).collect()}
    assert state == {1: 0.0, 2: 5.0, 3: 5.0, 6: 0.0, 7: 0.0, 8: 8.0}
    lives = {r.i: r.lifetime for r in actors.lifetimes(log, ["actor"], "i").where("is_alive").collect()}
    assert lives == {1: 1, 2: 1, 3: 1, 6: 2, 7: 2, 8: 2}


def test_team_sources(spark):
    rows = [("a", 0, None, None), ("a", 1, 1, None), ("a", 2, None, 0), ("b", 0, None, 0), ("c", 0, None, None)]
    log = spark.createDataFrame(rows, "name string, i bigint, team int, header int")
    out = actors.resolve_team(log, ["name"], "i", "team", "header", F.lit(-3.0))
    assert {(r.name, r.i): r.resolved_team for r in out.collect()} == {("a", 0): 0, ("a", 1): 1, ("a", 2): 1, ("b", 0): 0, ("c", 0): 0}


def test_rising_edges(spark):
    rows = [(1, i, on) for i, on in enumerate([True, True, False, True, None, True])]
    out = tel.rising_edges(spark.createDataFrame(rows, "game_id int, frame_idx bigint, on boolean"), F.col("on"))
    assert sorted(r.frame_idx for r in out.collect()) == [0, 3, 5]


def nearest_records(links, cars, records):
    """Brute force: walk outwards from every car, level by level."""
    refs, back = {}, {}
    for s, d in links:
        refs.setdefault(s, set()).add(d)
        back.setdefault(d, set()).add(s)
    out = {}
    for start in cars:
        seen, level, step = {start}, {start}, 0
        found = None
        while level and found is None:
            components = set().union(*(back.get(n, set()) for n in level))
            direct = components & records
            shared = set().union(*(refs.get(c, set()) for c in components)) if components else set()
            if direct:
                found = (2 * step + 1, min(direct))
            elif shared & records:
                found = (2 * step + 2, min(shared & records))
            own = refs.get(start, set()) & records if step == 0 else set()
            if own and (found is None or found > (1, min(own))):
                found = (1, min(own))
            level = shared - seen - records
            seen |= level
            step += 1
        out[start] = found
    return out


def test_link_resolution_with_cycles(spark):
    rng = np.random.default_rng(2)
    links = {(f"c{rng.integers(40)}", f"n{rng.integers(60)}") for _ in range(110)}
    links |= {("hub", f"n{i}") for i in range(0, 60, 2)} | {("r9", "n7"), ("n7", "n8"), ("n8", "n7")}
    links |= {("c3", "r1"), ("c5", "r2"), ("island", "n99")}
    cars, records = [f"n{i}" for i in range(60)] + ["n99", "alone"], {"r1", "r2", "r9"}
    out = actors.resolve_links(
        spark.createDataFrame(sorted(links), "src string, dst string"),
        spark.createDataFrame([(c,) for c in cars], "id string"),
        spark.createDataFrame([(r,) for r in records], "id string"))
    got = {r.car: r.record and (r.distance, r.record) for r in out.collect()}
    assert got == nearest_records(links, cars, records)
    assert got["n7"] == (1, "r9") and got["alone"] is None


def test_links_far_away_and_direct(spark):
    links = {(f"c{i}", f"n{i}") for i in range(40)} | {(f"c{i}", f"n{i + 1}") for i in range(40)}
    links |= {("c39", "r9"), ("car", "r5"), ("car", "r7"), ("c40", "car"), ("c40", "r8"), ("c41", "car"), ("c41", "other")}
    cars, records = [f"n{i}" for i in range(41)] + ["car", "other"], {"r5", "r7", "r8", "r9"}
    out = actors.resolve_links(
        spark.createDataFrame(sorted(links), "src string, dst string"),
        spark.createDataFrame([(c,) for c in cars], "id string"),
        spark.createDataFrame([(r,) for r in records], "id string"))
    got = {r.car: r.record and (r.distance, r.record) for r in out.collect()}
    assert got == nearest_records(links, cars, records)
    assert got["n0"] == (80, "r9") and got["car"] == (1, "r5") and got["other"] == (4, "r8")


def resolved(spark, links, cars, records):
    out = actors.resolve_links(
        spark.createDataFrame(sorted(links), "src string, dst string"),
        spark.createDataFrame([(c,) for c in cars], "id string"),
        spark.createDataFrame([(r,) for r in records], "id string"))
    return {r.car: r.record and (r.distance, r.record) for r in out.collect()}


def test_links_through_chains_rings_and_branches(spark):
    """Far nodes: chains between branches, rings on chains, dead ends, a ring nobody reaches."""
    rng = np.random.default_rng(7)
    links = set()

    def chain(name, start, end, hops):
        at = [start, *(f"{name}{i}" for i in range(hops - 1)), end]
        for i, (x, y) in enumerate(zip(at, at[1:])):
            links.update({(f"c-{name}{i}", x), (f"c-{name}{i}", y)})

    chain("a", "r1", "hub", 9)
    chain("b", "hub", "hub2", 14)
    chain("b2", "hub", "hub2", 11)
    chain("d", "hub2", "hub2", 8)
    chain("e", "hub2", "end", 13)
    chain("f", "r2", "end", 30)
    chain("g", "ring", "ring", 6)
    for i in range(30):
        links.add((f"c-b{rng.integers(14)}", f"leaf{i}"))
    cars = sorted({d for _, d in links} - {"r1", "r2"})
    assert resolved(spark, links, cars, ["r1", "r2"]) == nearest_records(links, cars, {"r1", "r2"})


def test_links_of_hot_nodes_are_dealt(spark, monkeypatch):
    """Only nodes with many links are cut into parts; before, the parts of every node were a table as long as the links."""
    monkeypatch.setattr(actors, "HOT_LINKS", 2)
    monkeypatch.setattr(actors, "HOT_PARTS", 3)
    links = {("hub", f"n{i}") for i in range(8)} | {(f"c{i}", "n0") for i in range(6)} | {("c1", "r1"), ("c2", "m1"), ("c9", "m1"), ("c9", "m2")}
    cars = [*(f"n{i}" for i in range(8)), "m1", "m2", "alone"]
    assert resolved(spark, links, cars, ["r1"]) == nearest_records(links, cars, {"r1"})


def test_a_thousand_hops(spark):
    links = {(f"c{i}", f"n{i + d}") for i in range(1000) for d in (0, 1)} | {("c999", "r9")}
    cars = [f"n{i}" for i in range(1001)]
    got = resolved(spark, links, cars, ["r9"])
    assert got == {f"n{i}": (2 * max(1, 1000 - i), "r9") for i in range(1001)}
    inner = [(i, i - 1, i + 1) for i in range(1, 2000)] + [(-1, -2, -3), (-2, -3, -1), (-3, -1, -2)]
    ends, rounds = actors.chain_ends(spark.createDataFrame(inner, "v int, w0 int, w1 int"))
    assert rounds <= 12
    assert {(r.v, r.end, r.steps) for r in ends.collect()} == {x for i in range(1, 2000) for x in ((i, 0, i), (i, 2000, 2000 - i))}


def test_block_files(spark, folder):
    values = np.arange(12, dtype="<f4") / 8
    (tmp := __import__("pathlib").Path(folder) / "a").mkdir()
    (tmp / "0-2.features").write_bytes(values.tobytes())
    (tmp / "2-4.features").write_bytes(values[:5].tobytes())
    (tmp / "note.txt").write_text("x")
    rows = blocks.read_blocks(spark, folder, 12).collect()
    assert len(rows) == 1 and np.allclose(rows[0]["values"], values)
    assert inventory.list_files(spark, folder, "*.features").count() == 2


def test_replay_listing(spark, folder):
    path = __import__("pathlib").Path(folder) / "replays" / "ranked-standard" / "gold-1"
    path.mkdir(parents=True)
    (path / "abc.replay").write_bytes(b"123")
    row = inventory.list_replay_files(spark, folder).first()
    assert (row.length, row.game_mode, row["rank"], row.id) == (3, "ranked-standard", "gold-1", "abc")


def test_wide_trees_are_listed_by_tasks(spark, folder):
    """Before, one folder was handed to Spark, which the driver lists by itself."""
    names = [f"replays/m{i % 5}/r{i % 9}/{i}.replay" for i in range(90)] + ["replays/r3/x y%20.replay", "replays/m1/_hidden/a.replay", "replays/.b/a.replay"]
    rows = spark.createDataFrame([(n, b"ab") for n in names], "path string, content binary")
    inventory.write_files(rows, folder)
    found = inventory.branches(spark, folder)
    assert len(found) == 46 and len(set(found)) == 46 and not any("hidden" in f for f in found)
    listed = inventory.list_files(spark, folder, "*.replay")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.replay").load(folder)
    assert sorted(listed.collect()) == sorted(whole.select("path", "length").collect()) and listed.count() == 91
    os.makedirs(f"{folder}/empty/a/b")
    assert len(inventory.branches(spark, f"{folder}/empty")) == 1 and inventory.list_files(spark, f"{folder}/empty").count() == 0
    # A folder with files of its own is one branch, and so is one whose name Spark takes for a pattern.
    assert len(inventory.branches(spark, f"{folder}/replays/r3")) == 1
    inventory.write_files(spark.createDataFrame([(f"odd/{n}/1.replay", b"a") for n in ("a[1]", "a1", "b")], "path string, content binary"), folder)
    assert inventory.list_files(spark, f"{folder}/odd").count() == 3


def test_a_file_is_replaced(spark, folder):
    """A task that runs again, or a path that is repeated, leaves the content of the last write only."""
    for content in (b"long content", b"s", b""):
        inventory.write_files(spark.createDataFrame([("a/b.replay", content)], "path string, content binary"), folder)
        assert (__import__("pathlib").Path(folder) / "a" / "b.replay").read_bytes() == content


def test_files_lie_there_a_portion_at_a_time(spark, folder):
    rows = spark.createDataFrame([(f"replays/hoops/gold-1/{i % 20}.replay", b"x" * (i % 20 + 1)) for i in range(25)], "path string, content binary")
    most = []

    def read(spark, root):
        there = inventory.list_replay_files(spark, root)
        most.append(there.count())
        return there

    got = inventory.in_portions(rows, f"{folder}/files", read, size=5)
    assert sorted((int(r.id), r.length) for r in got.collect()) == [(i, i + 1) for i in range(20)]
    assert len(most) == 5 and sum(most) == 20 and max(most) < 20
    assert not [f for _, _, names in os.walk(f"{folder}/files") for f in names]


def test_the_listed_files_do_not_stay(spark, folder, monkeypatch):
    """Before, a file per replay stayed in the shared folder."""
    monkeypatch.setattr(catalog_queries, "run_folder", lambda spark, name: f"{folder}/{name}")
    orders = spark.range(40).selectExpr(
        "id AS o_orderkey", "DATE '2024-01-01' AS o_orderdate", "'F' AS o_orderstatus", "'3-MEDIUM' AS o_orderpriority", "7.5D AS o_totalprice")
    orders.write.parquet(f"{folder}/orders.parquet")
    got = {(r.id, r.length) for r in catalog_queries.replay_listing(spark, folder).collect()}
    # Files of the catalogue; those in a folder too few or of another ending are not listed.
    assert got == {(str(i), i % 50 + 1) for i in range(40) if i % 7}
    assert not [f for _, _, names in os.walk(f"{folder}/files") for f in names]


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = np.c_[rng.normal(size=(80, 3)), np.ones(80)]
    y = x @ [3.0, -2.0, 0.5, 5.0] + rng.normal(size=80)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, o double, y double")
    xs = [F.col(n) for n in "abco"]
    weights = probe.ridge_fit(df, xs, F.col("y"), 0.7)
    want = np.linalg.solve(x.T @ x + 0.7 * np.eye(4), x.T @ y)
    assert np.allclose(weights.first()[0], want)
    scored = probe.ridge_score(df, weights, xs).withColumn("mu", F.lit(float(y.mean())))
    row = probe.verdict(scored, "pred", "y", F.col("mu")).first()
    assert row.carries_signal and row.pearson_r > 0.9
