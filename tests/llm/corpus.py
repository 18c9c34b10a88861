"""Small documents with the awkward cases, and plain-Python versions of the operators."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

# Columns besides the documents' own, with names that the operators use inside.
CLASHING = ["shard", "rank", "key", "h", "words", "score", "kept", "n", "fp", "spans", "cell"]
SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
     StructField("source", StringType()), StructField("n_chars", LongType())]
    + [StructField(c, StringType()) for c in CLASHING]
)
LABELS = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])
ITEMS = StructType([StructField("item_id", LongType()), StructField("text", StringType()), StructField("k", BooleanType())])


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), *["x"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def sentence(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def awkward(rng):
    """Nulls, empty and blank texts, odd white space, a long text, repeated rows, equal texts."""
    base = sentence(rng, 120)
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "One two  three"), (6, base), (7, base.upper()), (8, base),
        (8, base), (9, "\x0b" + base.replace(" ", "\t\n") + "\x0c"), (10, sentence(rng, 30_000, 3000)), (None, base),
        (None, None), (11, "É é ß ı İ 日本 🙂 don't 12 3.4"), (12, "a" * 5000), (13, "z z z z z z z z z z z z " * 20),
        (14, "z z z z z z z z z z z z " * 20 + "tail"), (15, "word\x1cword word"), (16, base + " more"),
    ]


def near_copies(rng, groups=6, start=100):
    """Groups of texts that differ in a few words, and texts that share long passages."""
    out, at = [], start
    passage = sentence(rng, 70, 5000)
    for _ in range(groups):
        base = sentence(rng, rng.randrange(5, 140), 5000).split()
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
            if rng.random() < 0.3:
                words += passage.split()[rng.randrange(30) :]
            if rng.random() < 0.3:
                words = sentence(rng, 20, 5000).split() + passage.split() + words
            out.append((at, " ".join(words)))
            at += 1
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def big(doc_id):
    return 1 << 62 if doc_id is None else doc_id


def near_groups(rows):
    """(doc_id, n_shingles, component_id) of rows by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    lowest = defaultdict(lambda: 1 << 62)
    for i, (doc_id, _) in enumerate(rows):
        lowest[find(i)] = min(lowest[find(i)], big(doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        low = lowest[find(i)]
        out.append((doc_id, len(sets[i]), None if low == 1 << 62 else low))
    return out


def repeats(rows, window=50):
    first = {}
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, 1 << 62), big(doc_id))
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < big(doc_id):
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def leaks(rows, items):
    windows = defaultdict(set)
    for item_id, text in items:
        w = item_words(text)
        k = min(len(w), 10)
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(item_id)
    out = []
    for doc_id, text in rows:
        w = item_words(text)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (ids := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= ids
        listed = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return out


def exact(rows):
    groups = defaultdict(list)
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    for i, (doc_id, text) in enumerate(rows):
        groups[bare[i]].append((-len(text or ""), big(doc_id), i))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        best = rows[min(groups[bare[i]])[2]][0]
        out.append((doc_id, best, len(groups[bare[i]]), hashlib.sha256(bare[i].encode()).hexdigest()))
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def rng(seed=5):
    return random.Random(seed)


def same(df, expected, columns):
    got = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
