"""From raw documents to packed training sequences: the document operators in a row.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the
documents it keeps with their columns; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobbylens.llm.common import sized, stash
from lobbylens.llm.decontaminate import contamination
from lobbylens.llm.exact import exact_groups
from lobbylens.llm.jaccard import near_duplicates
from lobbylens.llm.packing import pack
from lobbylens.llm.quality import good_documents
from lobbylens.sources.tables import table

#: The fitted classifier and the tokenizer's ids cannot be written in SQL.
ORACLE_SQL = None


#: Words that a Python worker keeps ids of while packing: it shares its executor with what the stages before left in the JVM.
PACKING_WORDS = 100_000


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of the documents has, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _joined(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents (not) named by rows (doc_id, key), key being xxhash64 of the text."""
    own, its_id, its_key = (_fresh(docs, n) for n in ("own_key", "its_id", "its_key"))
    pairs = stash(rows.select(F.col("doc_id").alias(its_id), F.col("key").alias(its_key)).distinct(), "named")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(its_id)) & (F.col(own) == F.col(its_key))
    return docs.withColumn(own, F.xxhash64("text")).join(sized(pairs), same, how).drop(own)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Repeated rows and equal texts get equal scores; null and empty texts are scored like any other; without
    labels every document has score 0.5 and goes; an empty table stays empty.
    """
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, whatever its other columns hold.

    Null, empty and blank texts are one group; of a row repeated in doc_id and text one stays.
    """
    rows = exact_groups(docs).groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    rows = stash(rows.where("NOT kept OR n > 1"), "not-alone")
    out = _joined(docs, rows, "left_anti")
    repeated = rows.where("kept")
    if repeated.isEmpty():
        return out
    # The same doc_id and text more than once: one of the rows stays.
    own = _fresh(docs, "own_key")
    again = _joined(docs, repeated, "left_semi").withColumn(own, F.xxhash64("text"))
    return out.union(again.dropDuplicates(["doc_id", own]).drop(own))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id.

    Texts without words are near nothing and all stay; rows equal in doc_id and text stay or go together.
    """
    return _joined(docs, near_duplicates(docs).where("NOT kept"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; without items, or without words, none does."""
    hits = contamination(docs, table(spark, sf_dir, "benchmark"))
    return _joined(docs, hits.where("contaminated"), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in packed sequences; an empty or null text is its end id."""
    return pack(docs, cache_words=PACKING_WORDS)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
