"""Merkle manifests against a plain walk over the trees."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lobbylens.llm.manifest import merkle_manifest
from tests.llm import corpus as c

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root, and per node its runs from below: (place in the run, run)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for way, i in zip(ways, range(len(at))):
            way.append((at[i] % 3, runs[at[i] // 3]))
            at[i] //= 3
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], ways


def manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    def order(r):
        return (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(*r))

    rows = sorted(rows, key=order)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    trees = {s: climb([leaf(*r) for r in g]) for s, g in groups.items()}
    root, tops = climb([t[0] for t in trees.values()])
    out = []
    for (source, group), top in zip(groups.items(), tops):
        for r, way in zip(group, trees[source][1]):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node, proof = leaf(*r[:4], text), ""
            for place, run in way + top:
                proof += "".join(run[:place] + run[place + 1 :])
                node = h("".join(run[:place] + [node] + run[place + 1 :]))
            out.append((r[0], leaf(*r), trees[source][0], root, h(proof), node, node == root))
    return out


def build(spark, rows):
    df = spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, place string"
    )
    return df.repartition(5)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(spark, levels):
    """A hot source, many small ones, nulls everywhere, repeated rows; superblocks of 3, 9 and 2,187 nodes."""
    rng = c.rng(4)
    rows = [(i, "hot", "en", 5, f"line {i}\nnext") for i in range(100)]
    rows += [(1000 + i, f"s{rng.randrange(25)}", None, None, c.sentence(rng, 3) + "\n" * (i % 2)) for i in range(60)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (7, None, "é", 0, ""), (8, "", "x", 1, "a\n" * 50_000)]
    rows += [(5, "hot", "en", 5, "line 5\nnext"), (5, "hot", "en", 5, "other"), (-3, "日本", "ja", 2, "\n")]
    expected = manifest(rows)
    out = merkle_manifest(build(spark, rows), tampered(), levels)
    c.same(out, expected, COLUMNS)
    assert len({r[6] for r in expected}) == 2


@pytest.mark.parametrize("n", [1, 4, 28])
def test_sizes(spark, n):
    """Full and broken last runs, in the leaves of a source and in the tree of sources."""
    rows = [(i, "a", "en", i, f"t{i}\n") for i in range(n)]
    c.same(merkle_manifest(build(spark, rows), tampered(), 1), manifest(rows), COLUMNS)
    rows = [(i, f"s{i}", "en", i, f"t{i}\n") for i in range(n)]
    c.same(merkle_manifest(build(spark, rows), None, 1).where("verified").drop("folded_root", "verified"), [r[:5] for r in manifest(rows)], COLUMNS[:5])


def test_no_rows(spark):
    assert merkle_manifest(build(spark, [(1, "a", "b", 1, "c")]).limit(0)).count() == 0
