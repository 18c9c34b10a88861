"""Actor event logs: lifetimes, carried-forward state, teams and link resolution.

Log rows are keyed by an actor and ordered by a unique whole number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobbylens.operators.scan import Fold, prefix_scan, scatter
from lobbylens.session import materialize


def lifetimes(log: DataFrame, keys: Sequence[str], order: str, kind: str = "kind") -> DataFrame:
    """Add `lifetime` (number of creations so far) and `is_alive`.

    Ids are reused: a creation starts a new lifetime, a deletion ends it.
    """
    at = F.col(order)
    folds = [
        Fold("lifetime", "sum", (F.col(kind) == "new").cast("int")),
        Fold("_born", "max", F.when(F.col(kind) == "new", at)),
        Fold("_died", "max", F.when(F.col(kind) == "delete", at)),
    ]
    scanned = prefix_scan(log, keys, [order], folds)
    alive = F.col("_born").isNotNull() & (F.coalesce("_died", F.lit(-1)) < F.col("_born"))
    return scanned.withColumn("is_alive", alive).drop("_born", "_died")


def carry_forward(
    log: DataFrame, keys: Sequence[str], order: str, value: str, default, kind: str = "kind"
) -> DataFrame:
    """State of each living actor: the newest update of this lifetime, else the default.

    One scan is enough: an update counts exactly if it is newer than the
    creation that opened the lifetime.
    """
    at = F.col(order)
    seen = F.when((F.col(kind) == "update") & F.col(value).isNotNull(), F.struct(at.alias("at"), F.col(value).alias("v")))
    folds = [
        Fold("_born", "max", F.when(F.col(kind) == "new", at)),
        Fold("_died", "max", F.when(F.col(kind) == "delete", at)),
        Fold("_seen", "last", seen),
    ]
    scanned = prefix_scan(log, keys, [order], folds)
    alive = scanned.where(F.col("_born").isNotNull() & (F.coalesce("_died", F.lit(-1)) < F.col("_born")))
    current = F.when(F.col("_seen.at") > F.col("_born"), F.col("_seen.v"))
    return alive.withColumn("state", F.coalesce(current, F.lit(default))).drop("_born", "_died", "_seen")


def resolve_team(
    log: DataFrame, keys: Sequence[str], order: str, team: str, header_team: str, side: Column
) -> DataFrame:
    """Team from the record, else last known for the name, else header, else field side."""
    scanned = prefix_scan(log, keys, [order], [Fold("_known", "last", F.col(team))])
    return scanned.withColumn(
        "resolved_team", F.coalesce(F.col(team), F.col("_known"), F.col(header_team), (side > 0).cast("int"))
    ).drop("_known")


#: Nodes with more links are dealt to several tasks.
HOT_LINKS = 4096
HOT_PARTS = 64
#: Rounds that walk the links hop by hop; what is farther away is reached by doubling.
NEAR_ROUNDS = 3


def resolve_links(
    links: DataFrame, cars: DataFrame, records: DataFrame
) -> DataFrame:
    """Car -> player record over `links(src, dst)`: a component `src` refers to `dst`.

    A car belongs to a record that refers to it or that it refers to itself, or that
    one of its components also refers to, or, failing that, to whatever its
    components lead to next, however far. Each node keeps only its best (distance, record)
    pair, ties to the smaller record; a record that is itself the component counts before a
    record the component refers to.

    The first rounds walk outwards; a round costs two combining aggregations over the links of the
    components that still lead to an open node, with no pairs listed per node, and there is none
    once every node has its record. Nodes that are still open then are
    mostly strung in chains, which `_far` shortens by doubling. Every state is written out
    and replaces the one before.
    """
    known = records.select(F.col("id").alias("node")).distinct()
    edges = materialize(links.select("src", "dst").distinct())
    # The links of a hot node lie in several parts, which its value is sent to.
    hot = {end: materialize(edges.groupBy(end).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_LINKS).select(
        end, F.lit(True).alias(f"hot_{end}"))) for end in ("src", "dst")}

    def at(end: str, other: str, values: DataFrame) -> DataFrame:
        part, is_hot = f"{end}_part", F.coalesce(f"hot_{end}", F.lit(False))
        parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
        dealt = F.when(is_hot, scatter(other, parts=HOT_PARTS).cast("int")).otherwise(F.lit(0))
        sent = values.join(hot[end], end, "left").withColumn(part, F.explode(parts)).drop(f"hot_{end}")
        laid = edges.join(hot[end], end, "left").withColumn(part, dealt).drop(f"hot_{end}")
        return laid.join(sent, [end, part]).drop(part)

    def at_src(values: DataFrame) -> DataFrame:
        return at("src", "dst", values)

    def at_dst(values: DataFrame) -> DataFrame:
        return at("dst", "src", values)

    # Distance 1: the component is a record itself; distance 2: it refers to one.
    direct = at_src(known.withColumnRenamed("node", "src")).select(
        F.col("dst").alias("node"), F.lit(1).alias("distance"), F.col("src").alias("record")
    )
    named = materialize(at_dst(known.withColumnRenamed("node", "dst")).groupBy("src").agg(F.min("dst").alias("record")))
    shared = at_src(named).select(F.col("dst").alias("node"), F.lit(2).alias("distance"), "record")
    best = frontier = materialize(_best(direct.unionByName(shared).join(known, "node", "left_anti")))
    open_nodes = materialize(edges.select(F.col("dst").alias("node")).distinct().join(best, "node", "left_anti").join(known, "node", "left_anti"))
    rounds = NEAR_ROUNDS if not open_nodes.isEmpty() else 0
    if rounds:
        # Only components that lead to an open node can pass anything on.
        edges = materialize(at_src(at_dst(open_nodes.withColumnRenamed("node", "dst")).select("src").distinct()))
    for _ in range(rounds):
        reached = (
            at_dst(frontier.withColumnRenamed("node", "dst"))
            .groupBy("src")
            .agg(F.min(F.struct("distance", "record")).alias("b"))
        )
        found = at_src(reached).select(
            F.col("dst").alias("node"), (F.col("b.distance") + 2).alias("distance"), F.col("b.record").alias("record")
        )
        frontier = materialize(_best(found.join(best, "node", "left_anti").join(known, "node", "left_anti")))
        if frontier.isEmpty():
            break
        best = materialize(best.unionByName(frontier))
    else:
        if not rounds:
            return _with_own(cars, known, named, best)
        done = best.select("node").union(known).withColumnRenamed("node", "dst")
        left = materialize(edges.select("src", "dst").join(done, "dst", "left_anti"))
        starts = at_dst(frontier.withColumnRenamed("node", "dst")).groupBy("src").agg(F.min(F.struct("distance", "record")).alias("b"))
        starts = starts.select("src", (F.col("b.distance") + 1).alias("distance"), F.col("b.record").alias("record"))
        best = best.unionByName(_far(left, starts.join(left.select("src").distinct(), "src", "left_semi")))
    return _with_own(cars, known, named, best)


def _with_own(cars: DataFrame, known: DataFrame, named: DataFrame, best: DataFrame) -> DataFrame:
    """Cars with their records. A car's own link to a record counts for that car only, not for what leads to it."""
    own = named.select(F.col("src").alias("node"), F.lit(1).alias("distance"), "record")
    own = own.join(cars.select(F.col("id").alias("node")).distinct(), "node", "left_semi").join(known, "node", "left_anti")
    return cars.select(F.col("id").alias("car")).join(
        _best(best.unionByName(own)).withColumnRenamed("node", "car"), "car", "left"
    )


def _best(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("node").agg(F.min(F.struct("distance", "record")).alias("b")).select(
        "node", F.col("b.distance").alias("distance"), F.col("b.record").alias("record")
    )


def _far(left: DataFrame, starts: DataFrame) -> DataFrame:
    """Best (distance, record) of the open nodes. left: their links; starts: components with a value.

    Components and nodes are the ends of undirected edges of length 1. Those with two neighbours and no value
    are inner parts of chains; `chain_ends` replaces each chain by one edge in a logarithmic
    number of rounds. Values then spread over what remains, the ends, until none gets better,
    and the inner parts take the better of their two ends.
    """
    a, b = F.struct(F.lit("c").alias("side"), F.col("src").alias("id")), F.struct(F.lit("n").alias("side"), F.col("dst").alias("id"))
    both = left.select(a.alias("v"), b.alias("w")).union(left.select(b.alias("v"), a.alias("w")))
    both = materialize(both)
    valued = materialize(starts.select(a.alias("v"), "distance", "record"))
    inner = both.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("w0"), F.max("w").alias("w1"))
    inner = materialize(inner.where("n = 2").join(valued, "v", "left_anti").drop("n"))
    ends, _ = chain_ends(inner)
    chains = ends.groupBy("v").agg(F.min(F.struct("end", "steps")).alias("x"), F.max(F.struct("end", "steps")).alias("y"), F.count(F.lit(1)).alias("n"))
    # Rings without an end have no value to take.
    chains = materialize(chains.where("n = 2").select(
        "v", F.col("x.end").alias("x"), F.col("x.steps").alias("to_x"), F.col("y.end").alias("y"), F.col("y.steps").alias("to_y")))
    outer = both.join(inner.select("v"), "v", "left_anti").join(inner.select(F.col("v").alias("w")), "w", "left_anti")
    joined = chains.select("x", "y", (F.col("to_x") + F.col("to_y")).alias("steps")).distinct()
    edges = outer.select("v", "w", F.lit(1).alias("steps"))
    edges = edges.union(joined.select("x", "y", "steps")).union(joined.select("y", "x", "steps"))
    edges = materialize(edges.where("v <> w").groupBy("v", "w").agg(F.min("steps").alias("steps")))
    values = valued.select(F.col("v").alias("node"), "distance", "record")
    moved = values
    while True:
        found = moved.withColumnRenamed("node", "v").join(edges, "v").select(
            F.col("w").alias("node"), (F.col("distance") + F.col("steps")).alias("distance"), "record")
        better = _best(found).alias("f").join(values.alias("o"), F.col("f.node") == F.col("o.node"), "left").where(
            F.col("o.node").isNull() | (F.struct("f.distance", "f.record") < F.struct("o.distance", "o.record")))
        moved = materialize(better.select("f.*"))
        if moved.isEmpty():
            break
        values = materialize(_best(values.unionByName(moved)))
    inside = reduce(DataFrame.unionByName, [
        chains.join(values.withColumnRenamed("node", end), end).select(
            F.col("v").alias("node"), (F.col("distance") + F.col(f"to_{end}")).alias("distance"), "record")
        for end in ("x", "y")
    ])
    out = values.unionByName(_best(inside)).where("node.side = 'n'")
    return out.select(F.col("node.id").alias("node"), F.col("distance").cast("int").alias("distance"), "record")


def chain_ends(inner: DataFrame) -> tuple[DataFrame, int]:
    """The two ends of the chain that each inner part lies in: (v, end, steps) and the rounds taken.

    inner: parts v with their two neighbours w0 and w1. A pointer leaves v in each direction;
    in every round it jumps as far as the pointer at its tip, so it doubles, and stops at
    the first part that is not inner. Rings never stop and have no ends.
    """
    ways = [("w0", "w1"), ("w1", "w0")]
    pointers = reduce(DataFrame.union, [
        inner.select("v", F.col(back).alias("back"), F.col(ahead).alias("end"), F.col("v").alias("prev"), F.lit(1).alias("steps"))
        for back, ahead in ways
    ])
    # Where both neighbours are the same part, it is passed once in each direction.
    tips = inner.select(F.col("v").alias("end"), F.lit(True).alias("open"))
    pointers = materialize(pointers.join(tips, "end", "left").withColumn("open", F.coalesce("open", F.lit(False))))
    rounds, before = 0, None
    while True:
        waiting = pointers.where("open").count()
        if not waiting or waiting == before:
            return pointers.where("NOT open").select("v", "end", "steps"), rounds
        tip = pointers.select(
            F.col("v").alias("end"), F.col("back").alias("prev"), F.col("end").alias("_end"), F.col("prev").alias("_prev"),
            F.col("steps").alias("_steps"), F.col("open").alias("_open"))
        jumped = pointers.where("open").join(tip, ["end", "prev"]).select(
            "v", "back", F.col("_end").alias("end"), F.col("_prev").alias("prev"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_open").alias("open"))
        pointers = materialize(pointers.where("NOT open").select(*jumped.columns).union(jumped))
        rounds, before = rounds + 1, waiting
