"""Merkle dataset manifest: subtrees of bounded size, exchanged by cogrouping."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobbylens.llm.common import ranked, stash

#: Children of a node.
ARITY = 3
#: Levels that one superblock reduces: it holds 3^7 = 2,187 neighbouring nodes of a tree.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Stands for the node itself in a path; levels are divided by a comma.
OWN = "*"
NODES = "tree long, place long, total long, digest string"
PATHS = "tree long, place long, subroot string, root string, path string"
PROVEN = "doc string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(**fields: Column) -> Column:
    """The hash of a row: each value as byte count, colon and text, or - where it is null."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def reduction(digests: list[str], finish: bool, levels: int = LEVELS) -> list[list[str]]:
    """The levels of a superblock, from its nodes up: to the one that remains, or just so many."""
    rows = [digests]
    while (len(rows[-1]) > 1) if finish else (len(rows) <= levels):
        row = rows[-1]
        rows.append([digest("".join(row[i : i + ARITY])) for i in range(0, len(row), ARITY)])
    return rows


def paths(rows: list[list[str]], outer: str) -> list[str]:
    """Per node of the lowest level its run, level by level, with the path of the superblock behind."""
    above = [outer] * len(rows[-1])
    for row in reversed(rows[:-1]):
        here = []
        for i in range(len(row)):
            start = i - i % ARITY
            run = "".join(row[start:i]) + OWN + "".join(row[i + 1 : start + ARITY])
            tail = above[i // ARITY]
            here.append(f"{run},{tail}" if tail else run)
        above = here
    return above


def fold(leaf: str, path: str) -> str:
    """The root that follows from a leaf and the runs it is put into."""
    for run in path.split(",") if path else []:
        leaf = digest(run.replace(OWN, leaf))
    return leaf


def _block(levels: int) -> Column:
    return F.floor(F.col("place") / F.lit(ARITY**levels)).cast("long").alias("block")


def _reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """One node per superblock, as the nodes of the next round."""
    size = ARITY**levels

    def run(key, group):
        total = int(group["total"].iloc[0])
        rows = reduction(group.sort_values("place")["digest"].tolist(), total <= size, levels)
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "total": [-(-total // size)], "digest": rows[-1]})

    return nodes.groupBy("tree", _block(levels)).applyInPandas(run, NODES)


def _with_paths(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """Nodes meet the path of their superblock: each gets its own path to the root."""
    size = ARITY**levels

    def run(key, group, above):
        group = group.sort_values("place")
        rows = reduction(group["digest"].tolist(), int(group["total"].iloc[0]) <= size, levels)
        top = above.iloc[0]
        return pd.DataFrame(
            {"tree": key[0], "place": group["place"], "subroot": top["subroot"], "root": top["root"], "path": paths(rows, top["path"])}
        )

    return _cogrouped(nodes, outer, levels).applyInPandas(run, PATHS)


def _proven(leaves: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """Leaves meet the path of their superblock: reduce it, join the proofs and fold them."""
    size = ARITY**levels

    def run(group, above):
        group = group.sort_values("place")
        rows = reduction(group["digest"].tolist(), int(group["total"].iloc[0]) <= size, levels)
        top = above.iloc[0]
        routes = paths(rows, top["path"])
        seen = group["seen"].where(group["seen"].notna(), group["digest"])
        return pd.DataFrame(
            {
                "doc": group["doc"], "leaf": group["digest"], "subroot": top["subroot"], "root": top["root"],
                "proof_sha256": [digest(p.replace(",", "").replace(OWN, "")) for p in routes],
                "folded_root": [fold(leaf, p) for leaf, p in zip(seen, routes)],
            }
        )

    return _cogrouped(leaves, outer, levels).applyInPandas(run, PROVEN)


def _cogrouped(nodes: DataFrame, outer: DataFrame, levels: int):
    # Both sides may stem from the same table; columns of their own keep them apart.
    outer = outer.select(*[F.col(name).alias(name) for name in outer.columns])
    return nodes.groupBy("tree", _block(levels)).cogroup(outer.groupBy("tree", F.col("place").alias("block")))


def _rounds(total: int, levels: int) -> int:
    """Rounds of superblocks until a tree of that many nodes is one node, one at least."""
    rounds = 1
    while total > ARITY**levels:
        total = -(-total // ARITY**levels)
        rounds += 1
    return rounds


def _climb(nodes: DataFrame, largest: int, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The open nodes of each round, and the tops of all trees."""
    rounds, tops = [nodes], []
    for _ in range(_rounds(largest, levels)):
        above = stash(_reduced(rounds[-1], levels), name)
        tops.append(above.where("total = 1"))
        rounds.append(above.where("total > 1"))
    return rounds[:-1], reduce(DataFrame.union, tops)


def _descend(rounds: list[DataFrame], outer: DataFrame, levels: int, name: str) -> DataFrame:
    """Paths of the superblocks of the lowest round. outer: a path per tree, at place 0."""
    paths_here = None
    for nodes in reversed(rounds[1:]):
        ending = nodes.where(F.col("total") <= ARITY**levels).select("tree").distinct()
        here = outer.join(ending, "tree", "left_semi")
        here = here if paths_here is None else paths_here.union(here)
        paths_here = stash(_with_paths(nodes, here, levels), name)
    if paths_here is None:
        return outer
    # Trees that end in the lowest round have no path from above.
    higher = paths_here.select("tree").distinct()
    return paths_here.union(outer.join(higher, "tree", "left_anti"))


def merkle_manifest(docs: DataFrame, seen: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Hash every row into a tree per source and a tree of sources, and prove each row against the root.

    A leaf is the SHA-256 of the row's fields. Leaves of a source ascend by doc_id (null first,
    then by hash); three neighbours become the hash of their concatenated digests until one is
    left, the subroot; subroots in the order of source (null first, bytewise) make the root in
    the same way. seen: the text as found when checking, null where it is unchanged; its leaf is
    folded with the siblings of the original one. Returns one row per input row: doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified.

    The unit of work is a superblock of 3^levels neighbouring nodes. Going up, each is reduced to
    one node of the next round, so a source of any size takes a logarithmic number of rounds and
    no group holds more than a superblock. Going down, the nodes of a superblock are cogrouped
    with its own path to the root (two digests a level), reduced again and given their paths; in
    the last round the leaves' proofs are joined and folded there and then.
    Repeated rows are leaves of their own; null fields, empty and long texts are hashed as they are; an
    empty table has no root and an empty result; a table of one row is its own root. Only the
    five fields are read, doc_id and n_chars as integers.
    """
    fields = {name: F.col(name) for name in FIELDS}
    fields |= {"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("long")}
    bent = F.lit(None).cast("string")
    if seen is not None:
        bent = F.when(seen.isNotNull(), leaf_of(**(fields | {"text": seen})))
    leaves = docs.select(
        fields["doc_id"].alias("doc_id"), F.col("source").cast("string").alias("source"),
        leaf_of(**fields).alias("digest"), bent.alias("seen"),
    )
    leaves = ranked(stash(leaves, "leaves"), ["source", "doc_id", "digest", "seen"], "ranked-leaves").drop("total")
    sources = leaves.groupBy("source").agg(F.min("rank").alias("first"), F.count("*").alias("leaves"))
    sources = stash(ranked(stash(sources, "sources"), ["source"], "ranked-sources").drop("total"), "placed-sources")
    sizes = sources.agg(F.coalesce(F.max("leaves"), F.lit(0)).alias("largest"), F.count("*").alias("n")).first()

    named = sources.select(F.col("source").alias("_source"), F.col("rank").alias("tree"), "first", F.col("leaves").alias("total"))
    nodes = leaves.join(named, F.col("source").eqNullSafe(F.col("_source"))).select(
        "tree", (F.col("rank") - F.col("first")).alias("place"), "total", "digest", "seen", F.col("doc_id").cast("string").alias("doc")
    )
    nodes = stash(nodes, "nodes")
    rounds, subroots = _climb(nodes.select("tree", "place", "total", "digest"), sizes["largest"], levels, "up")
    # The tree of sources: its nodes are the subroots.
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(sizes["n"]).cast("long").alias("total"), "digest")
    source_rounds, root = _climb(tops, sizes["n"], levels, "up-sources")
    root = root.select("tree", "place", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.lit("").alias("path"))
    of_sources = _descend(source_rounds, root, levels, "down-sources")
    of_sources = stash(_with_paths(tops, of_sources, levels), "source-paths").select(F.col("place").alias("tree"), "root", "path")
    outer = subroots.select("tree", "place", F.col("digest").alias("subroot")).join(of_sources, "tree")
    outer = _descend(rounds, outer, levels, "down")
    proven = _proven(nodes, outer, levels)
    return proven.select(
        F.col("doc").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
