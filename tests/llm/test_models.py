"""Quality and language: held-out accuracy, folds and awkward rows."""

import zlib

import numpy as np
import pytest

from lobbylens.llm.language import RIDGE, codewords, decode, features, identify_languages, with_bias
from lobbylens.llm.quality import quality_scores
from tests.llm import corpus as c

SF = "/root/testdata/sf0.01"


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def auc(pairs):
    good = [s for q, s in pairs if q]
    bad = [s for q, s in pairs if not q]
    return np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(r["held_out"] == (remainder(d, 4) == 2) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert auc(held) > 0.97


def test_quality_cut_held_out(spark):
    """What the pipeline deletes: the share of each label on its side of the cut."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    marked = labels.select("doc_id", "quality").where("quality IN (0, 1)")
    held = quality_scores(docs, labels).where("held_out").join(marked, "doc_id").collect()
    good = [r["predicted"] for r in held if r["quality"] == 1]
    bad = [r["predicted"] for r in held if r["quality"] == 0]
    print(f"kept {sum(good)} of {len(good)} with label 1, rejected {len(bad) - sum(bad)} of {len(bad)} with label 0")
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_quality_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    first = {r["doc_id"]: r["score"] for r in quality_scores(docs, labels).collect()}
    assert first == {r["doc_id"]: r["score"] for r in quality_scores(other, turned).collect()}


def test_quality_by_words_alone(spark):
    """Labels that only the choice of words tells apart: same shapes, lengths and repetition."""
    rng = c.rng(4)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x4F00)))):
        vocab = ["".join(rng.choice(alphabet) for _ in range(5)) for _ in range(400)]
        gap = " " if alphabet[0] == "a" else ""
        rows = [(i, gap.join(rng.choice(vocab[i % 2 :: 2]) for _ in range(120))) for i in range(240)]
        labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], c.LABELS)
        got = quality_scores(c.frame(spark, rows), labels).where("held_out").collect()
        assert auc([(r["doc_id"] % 2, r["score"]) for r in got]) > 0.95


def test_quality_awkward(spark):
    rows = c.awkward(c.rng(2))
    docs = c.frame(spark, rows)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, 0), (6, 1, None), (12, 0, 0), (None, 1, 0), (7, None, 0), (9, 3, 0)], c.LABELS)
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in identify_languages(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert all(got[r["doc_id"]]["held_out"] == (remainder(r["doc_id"], 3) == 1) for r in rows)
    held = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if got[r["doc_id"]]["held_out"]]
    assert np.mean(held) > 0.98


def test_language_awkward(spark):
    rows = [(d, t, "en" if i % 2 else "de", None) for i, (d, t) in enumerate(c.awkward(c.rng(2)))]
    got = identify_languages(c.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["lang_pred"] == by_id[2]["lang_pred"] == by_id[3]["lang_pred"] == "und" and by_id[1]["score"] == 0.0
    assert {r["lang_pred"] for r in got} <= {"en", "de", "und"} and all(0 <= r["score"] <= 1 for r in got)
    unknown = identify_languages(c.frame(spark, [(d, t, None, None) for d, t, _, _ in rows])).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}
    assert identify_languages(c.frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("part", [20_000, 30])
def test_language_by_hand(spark, monkeypatch, part):
    """Ridge regression per bit and logistic losses of all codewords, in plain NumPy; one task and several."""
    monkeypatch.setattr("lobbylens.llm.language.PART", part)
    rng = c.rng(3)
    vocab = {lang: ["".join(rng.choice(letters) for _ in range(4)) for _ in range(60)] for lang, letters in
             (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "ijklmnop"), ("dd", "mnopabcd"), ("ee", "éèüößñ"))}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(3, 30))), lang, None)
            for i in range(150) for lang in [rng.choice("abcde") * 2]]
    got = {r["doc_id"]: r for r in identify_languages(c.frame(spark, rows)).collect()}
    learnt = [r for r in rows if remainder(r[0], 3) != 1]
    languages = sorted({r[2] for r in learnt})
    x = with_bias(np.vstack([features(r[1].encode()).astype(np.float16).astype(np.float64) for r in learnt]))
    y = np.asarray([languages.index(r[2]) for r in learnt])
    code = codewords(5).astype(np.float64)
    weight = (len(y) / (5 * np.bincount(y)))[y]
    solved = np.linalg.solve((x * weight[:, None]).T @ x + RIDGE * np.eye(x.shape[1]), (x * weight[:, None]).T @ code[y])
    for doc_id, text, _, _ in rows:
        margins = with_bias(features(text.encode())[None].astype(np.float64)) @ solved
        loss = np.log1p(np.exp(-4 * margins * code)).sum(axis=1)
        share = np.exp(loss.min() - loss)
        assert got[doc_id]["lang_pred"] == languages[loss.argmin()]
        assert abs(got[doc_id]["score"] - 1 / share.sum()) < 1e-4


def test_any_number_of_languages(spark):
    """1,500 values of lang, each with its own letters."""
    rows = [(i, f"{chr(0x4E00 + i % 1500) * 3} {chr(0x4E00 + i % 1500) * 5}", f"l{i % 1500}", None) for i in range(6000)]
    got = identify_languages(c.frame(spark, rows)).where("held_out").collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] % 1500}" for r in got]) > 0.9


def test_one_text_in_most_rows(spark):
    """A repeated row is learned from once."""
    hot = next(i for i in range(100) if remainder(i, 3) != 1)
    rows = [(hot, "la la la la", "aa", None)] * 3000 + [(200 + i, f"xu xo xi {i}", "bb", None) for i in range(9)]
    got = identify_languages(c.frame(spark, rows)).groupBy("doc_id", "lang_pred").count().collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in got} == {(hot, "aa")} | {(200 + i, "bb") for i in range(9)}


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 2048, 2100])
def test_codewords_mend_wrong_bits(n):
    code = codewords(n)
    apart = np.einsum("ik,jk->ij", code[:300], code[:300]) - 2 * code.shape[1] * np.eye(min(n, 300))
    assert apart.max() <= code.shape[1] - 16
    margins = code.copy()
    margins[:, :3] *= -1
    assert decode(margins.astype(float), code)[0].tolist() == list(range(n))
